"""Lookups that keep an order, and reports of measured runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import is_abstention, keywords_hit


def in_order(wanted: DataFrame, rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``rows`` of the wanted keys, in the order of ``pos``; an error for a key that isn't there."""
    one = rows.withColumn("_there", F.lit(True))
    found = wanted.join(one, key, "left")
    said = F.concat(F.lit(f"no row with {key} "), F.col(key).cast("string"))
    checked = F.when(F.col("_there"), F.col(key)).otherwise(F.raise_error(said).cast(rows.schema[key].dataType))
    return found.withColumn(key, checked).drop("_there").orderBy(pos)


def excerpts_of_cases(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, pos, chunk columns) of each case's ``chunk_ids`` in their order; an error for a missing one."""
    wanted = cases.select("id", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    return in_order(wanted, chunks, "chunk_id").orderBy("id", "pos")


def rescore(outcomes: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes (case_id, answer, ...) judged anew by the cases (id, expect_abstain, keywords), the case_ids
    that no case has, which are left out)."""
    known = cases.select(F.col("id").alias("case_id"), "expect_abstain", "keywords")
    judged = outcomes.drop("expect_abstain", "abstained", "keywords_hit").join(known, "case_id")
    judged = judged.withColumn("abstained", is_abstention(F.col("answer"))).withColumn("keywords_hit", keywords_hit(F.col("answer"), F.col("keywords")))
    return judged.drop("keywords"), outcomes.join(known, "case_id", "left_anti").select("case_id").distinct()


def hallucinations(outcomes: DataFrame) -> DataFrame:
    """(flagged, caught, missed, caught_ids, missed_ids): answers that the checks flagged, and of answers where none
    should be how many they caught and missed, and which. The lists are ids alone, in one row;
    ``hallucination_cases`` has them as rows."""
    slip = F.col("expect_abstain") & ~F.col("abstained")
    ids = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("case_id"))))
    return outcomes.agg(
        F.count_if("needs_review").alias("flagged"), F.count_if(slip & F.col("needs_review")).alias("caught"), F.count_if(slip & ~F.col("needs_review")).alias("missed"),
        ids(slip & F.col("needs_review")).alias("caught_ids"), ids(slip & ~F.col("needs_review")).alias("missed_ids"),
    )


def hallucination_cases(outcomes: DataFrame) -> DataFrame:
    """(case_id, caught) of every answer where none should be."""
    slip = F.col("expect_abstain") & ~F.col("abstained")
    return outcomes.where(slip).select("case_id", F.col("needs_review").alias("caught"))


def similarity_report(pairs: DataFrame, good: float = 0.99, fair: float = 0.95) -> DataFrame:
    """(method, least, median, mean, good, fair, poor, best) of similarities (method, similarity): how many are
    how near, and the method with the highest median, of equal ones the first by name."""
    s = F.col("similarity")
    out = pairs.groupBy("method").agg(
        F.min(s).alias("least"), F.median(s).alias("median"), F.avg(s).alias("mean"), F.count_if(s >= good).alias("good"),
        F.count_if((s >= fair) & (s < good)).alias("fair"), F.count_if(s < fair).alias("poor"),
    )
    best = out.agg(F.max_by("method", F.struct("median", F.lit(0))).alias("_m"), F.max("median").alias("_top"))
    first = out.join(F.broadcast(best.select("_top")), F.col("median") == F.col("_top")).agg(F.min("method").alias("_best"))  # one row
    return out.crossJoin(F.broadcast(first)).withColumn("best", F.col("method") == F.col("_best")).drop("_best")


def provenance(references: DataFrame, known: DataFrame, paths_enough: int, least: int, line: float = 0.5) -> DataFrame:
    """(text_id, n, matched, ratio, inconclusive, belongs): whether texts belong with a set of known names.

    references: (text_id, kind "path" or "symbol", name), each once counted. Paths alone decide where a text
    has ``paths_enough`` of them, else symbols count too; under ``least`` references nothing is decided.
    """
    rows = references.distinct().join(known.select("name").distinct().withColumn("_known", F.lit(1)), "name", "left")
    path = F.col("kind") == "path"
    out = rows.groupBy("text_id").agg(F.count_if(path).alias("_p"), F.count("*").alias("_all"), F.count_if(path & F.col("_known").isNotNull()).alias("_ph"), F.count("_known").alias("_h"))
    by_path = F.col("_p") >= paths_enough
    out = out.select("text_id", F.when(by_path, F.col("_p")).otherwise(F.col("_all")).alias("n"), F.when(by_path, F.col("_ph")).otherwise(F.col("_h")).alias("matched"))
    out = out.withColumn("ratio", F.coalesce(F.col("matched") / F.nullif("n", F.lit(0)), F.lit(0.0))).withColumn("inconclusive", F.col("n") < least)
    return out.withColumn("belongs", ~F.col("inconclusive") & (F.col("ratio") >= line))


def failures_first(outcomes: DataFrame, n: int) -> DataFrame:
    """``n`` outcomes for a person to look at, those against what was expected first, then by case."""
    grounded = ~F.col("expect_abstain")
    wrong = (F.col("expect_abstain") != F.col("abstained")) | (grounded & ~F.col("keywords_hit"))
    return outcomes.withColumn("wrong", wrong).orderBy(F.desc("wrong"), "case_id").limit(n)


def merge_reports(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports of several machines as one table with the ``machine`` each is from; what a report lacks is null."""
    parts = [r.withColumn("machine", F.lit(name)) for name, r in reports.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def page(ranked: DataFrame, order: list, number: int, size: int = 5) -> DataFrame:
    """One page of a ranked result, pages from 0."""
    return ranked.orderBy(*order).offset(number * size).limit(size)


def checkpoints(done: DataFrame, every: int, by: str = "job", order: str = "n") -> DataFrame:
    """Of each job's steps (by, order) those at which progress is told: every so many, and the last."""
    line = Window.partitionBy(by).orderBy(order)
    last = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))) == 1
    return done.withColumn("place", F.row_number().over(line)).withColumn("_last", last).where((F.col("place") % every == 0) | F.col("_last")).drop("_last")


TABLE = "caption string, header_row array<string>, rows array<array<string>>"
IMAGE = "image_path string, width int, height int"


def decode_note(note: Column, schema: str) -> Column:
    """A table or image as JSON; null where the note is null or damaged."""
    found = F.from_json(note, schema + ", _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    return F.when(found["_damaged"].isNull() & found.isNotNull(), found.dropFields("_damaged"))


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("error").json(path)


def write_csv(trace: DataFrame, path: str) -> None:
    trace.write.mode("error").option("header", True).csv(path)


def lines(report: DataFrame, n: int = 20) -> str:
    """The first rows as a person reads them."""
    return report.limit(n).toPandas().to_string(index=False)
