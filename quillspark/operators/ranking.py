"""Re-ranking of keyword candidates by match quality and exact vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, term_variants


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    scaled = lambda p: F.transform(p["v"], lambda x: (x / p["norm"]).cast("float"))
    with_norm = lambda w: let(F.struct(w.alias("v"), F.greatest(l2_norm(w), F.lit(1e-12)).alias("norm")), scaled)
    return let(v, with_norm)  # vector and norm are made once, not once an element


def haystack(content: Column, caption: Column, heading: Column, case_sensitive: bool = False) -> Column:
    text = F.concat_ws("\n", F.coalesce(content, F.lit("")), F.coalesce(caption, F.lit("")), F.coalesce(heading, F.lit("")))
    return text if case_sensitive else F.lower(text)


def matched_terms(text: Column, variants: list[tuple[str, ...]], case_sensitive: bool = False) -> Column:
    """Terms with any form as a substring."""
    out = F.lit(0)
    for group in variants:
        forms = group if case_sensitive else [v.lower() for v in group]
        hit = F.lit(False)
        for v in forms:
            hit = hit | text.contains(v)
        out = out + hit.cast("int")
    return out


def sequence_match(text: Column, variants: list[tuple[str, ...]], case_sensitive: bool = False) -> Column:
    """struct(rank, gap): 2 for the raw terms as a phrase, 1 for all in order with the distance from the
    first's start to the last's end, 0 otherwise. Only terms that occur count; fewer than two: 0."""
    return let(text, lambda t: _sequence(t, variants, case_sensitive))


def _sequence(text: Column, variants: list[tuple[str, ...]], case_sensitive: bool) -> Column:
    groups = [[v if case_sensitive else v.lower() for v in g] for g in variants]
    terms = F.array(*[F.array(*[F.lit(v) for v in g]) for g in groups])
    present = F.filter(terms, lambda g: F.exists(g, lambda v: text.contains(v)))
    phrase = F.array_join(F.transform(present, lambda g: F.element_at(g, 1)), " ")
    start = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("first"), F.lit(0).alias("end"), F.lit(True).alias("ok"))

    def step(state, group):
        def best(acc, form):
            at = _locate_from(text, form, state["pos"])
            better = (at > 0) & ((acc["at"] == 0) | (at < acc["at"]))
            return F.when(better, F.struct(at.alias("at"), F.length(form).alias("n"))).otherwise(acc)

        found = F.aggregate(group, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), best)
        ok = state["ok"] & (found["at"] > 0)
        return F.when(ok, F.struct(
            (found["at"] + found["n"]).alias("pos"), F.when(state["first"] == 0, found["at"]).otherwise(state["first"]).alias("first"),
            (found["at"] + found["n"]).alias("end"), F.lit(True).alias("ok"),
        )).otherwise(F.struct(state["pos"].alias("pos"), state["first"].alias("first"), state["end"].alias("end"), F.lit(False).alias("ok")))

    walked = F.aggregate(present, start, step)
    none = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("gap"))
    return (
        F.when(F.size(present) < 2, none).when(text.contains(phrase), F.struct(F.lit(2).alias("rank"), F.lit(0).alias("gap")))
        .when(walked["ok"], F.struct(F.lit(1).alias("rank"), (walked["end"] - walked["first"]).alias("gap"))).otherwise(none)
    )


def _locate_from(text: Column, form: Column, pos: Column) -> Column:
    """locate() with column arguments."""
    return F.call_function("locate", form, text, pos)


def rerank(candidates: DataFrame, query: str, *, vectors: DataFrame | None = None, query_vector: list[float] | None = None,
           threshold: float = 0.5, limit: int = 50, case_sensitive: bool = False) -> DataFrame:
    """Candidates (seq, score, content, caption, heading) in the order of six keys, then score and seq.

    Keys: low relevance last, more matched terms, better sequence, smaller gap, longer content, higher
    similarity (missing: 0). Low relevance: similarity under the threshold without a full match. With no
    query vector the first and last key fall away and similarity is null. A vector of another length is
    as if missing.
    """
    variants = term_variants(query)
    text = haystack(F.col("content"), F.col("caption"), F.col("heading"), case_sensitive)
    out = candidates.withColumn("_h", text)
    out = out.withColumn("matched", matched_terms(F.col("_h"), variants, case_sensitive)).withColumn("_s", sequence_match(F.col("_h"), variants, case_sensitive))
    if vectors is not None and query_vector is not None:
        q = F.array(*[F.lit(float(x)) for x in query_vector])
        out = out.join(vectors.select("seq", F.col("vector").alias("_v")), "seq", "left")
        out = out.withColumn("similarity", F.when(F.size("_v") == len(query_vector), dot(F.col("_v"), q)))
        low = F.coalesce(F.col("similarity") < threshold, F.lit(False)) & (F.col("matched") < len(variants))
    else:
        out = out.withColumn("similarity", F.lit(None).cast("double"))
        low = F.lit(False)
    out = out.withColumn("is_low_relevance", low).withColumn("rank", F.col("_s.rank")).withColumn("gap", F.col("_s.gap"))
    order = [F.col("is_low_relevance"), F.desc("matched"), F.desc("rank"), F.col("gap"), F.desc(F.length("content")), F.desc(F.coalesce("similarity", F.lit(0.0))), F.col("score"), F.col("seq")]
    out = out.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.orderBy(*order))  # of at most ``limit`` rows
    return out.select(
        "seq", place.alias("place"), "score", "matched", F.lit(len(variants)).alias("total"), "rank", "gap", "similarity", "is_low_relevance",
        ((F.lit(len(variants)) > 0) & (F.col("matched") == 0)).alias("is_filename_only"),
    )
