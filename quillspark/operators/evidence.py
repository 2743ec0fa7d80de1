"""Grounded answers: evidence selection, prompts, and checks of an answer against its evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized, overlaps, sentences
from ..workspace import ship

ABSTAIN = "문서에서 찾을 수 없습니다."  # fixed value
INTRODUCTION = "Answer from the numbered excerpts only and cite them as [n]. If they do not say: " + ABSTAIN


def select_excerpts(results: DataFrame, threshold: float = 0.5, most: int = 5, by: str = "question_id") -> DataFrame:
    """Results (question_id, place, content, similarity) fit as evidence: at the threshold (null: no),
    of equal contents the first, the first ``most`` of a question; numbered from 1."""
    rows = results.where(F.col("similarity") >= threshold)
    first = Window.partitionBy(by, "content").orderBy("place")
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    line = Window.partitionBy(by).orderBy("place")
    return rows.withColumn("n", F.row_number().over(line)).where(F.col("n") <= most).drop("_r")


def truncate(text: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def format_excerpts(excerpts: Column, limit: int = 1200) -> Column:
    """array<struct(file_name, location, text)> as numbered blocks; none: one fixed sentence."""
    blocks = F.transform(excerpts, lambda x, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] "), x["file_name"], F.lit(" · "), x["location"], F.lit("\n"), truncate(x["text"], limit)))
    return F.when(F.size(excerpts) > 0, F.array_join(blocks, "\n\n")).otherwise("(no excerpts)")


def format_history(turns: Column, last: int = 3, limit: int = 300) -> Column:
    """array<struct(question, answer)> to a block of its last turns; none: empty."""
    kept = F.when(F.size(turns) > last, F.slice(turns, -last, last)).otherwise(turns)
    return F.array_join(F.transform(kept, lambda t: F.concat(F.lit("Q: "), t["question"], F.lit("\nA: "), truncate(t["answer"], limit))), "\n")


def messages(question: Column, excerpts: Column, turns: Column) -> Column:
    """The prompt; without history exactly what it would be had there never been any."""
    past = format_history(turns)
    body = F.concat(F.lit(INTRODUCTION + "\n\n"), format_excerpts(excerpts))
    return F.concat(body, F.when(past != "", F.concat(F.lit("\n\n"), past)).otherwise(""), F.lit("\n\nQuestion: "), question)


def clean_answer(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, r"(?U)^\s*\[?\s*답변\s*\]?\s*[:：]?\s*", ""))


def is_abstention(answer: Column) -> Column:
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return squeeze(answer).contains("".join(ABSTAIN.rstrip(".").split()))


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def invalid_citations(answer: Column, n: Column) -> Column:
    """Cited numbers outside 1..n, each once, in order of appearance."""
    return F.array_distinct(F.filter(citations(answer), lambda x: (x < 1) | (x > n)))


def expand_citations(answer: Column, excerpts: Column) -> Column:
    """[n] to [file, location] for the excerpts there are."""
    numbered = F.transform(excerpts, lambda x, i: F.struct(F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("a"),
                                                           F.concat(F.lit("["), x["file_name"], F.lit(", "), x["location"], F.lit("]")).alias("b")))
    return F.aggregate(numbered, answer, lambda s, x: F.replace(s, x["a"], x["b"]))


def verify(answer: Column, excerpts: Column, threshold: float = 0.5, least: int = 8) -> Column:
    """struct(needs_review, weak_sentences, invalid_citations, scores) of an answer as the model gave it.

    A sentence is weak if less than ``threshold`` of its character pairs is in the evidence; sentences
    under ``least`` characters don't count. Blank and abstaining answers pass."""
    evidence = F.array_join(F.transform(excerpts, lambda x: x["text"]), "\n")
    said = F.transform(sentences(answer), lambda s: F.regexp_replace(s, r"\[\d+\]", ""))
    said = F.filter(said, lambda s: F.length(normalized(s)) >= least)
    scored = F.zip_with(said, overlaps(said, evidence), lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    weak = F.transform(F.filter(scored, lambda x: x["v"] < threshold), lambda x: x["s"])
    bad = invalid_citations(answer, F.size(excerpts))
    passes = (F.trim(answer) == "") | is_abstention(answer)
    none, no_int = F.array().cast("array<string>"), F.array().cast("array<int>")
    return F.struct(
        F.when(passes, False).otherwise((F.size(weak) > 0) | (F.size(bad) > 0)).alias("needs_review"),
        F.when(passes, none).otherwise(weak).alias("weak_sentences"), F.when(passes, no_int).otherwise(bad).alias("invalid_citations"),
        F.when(passes, F.array().cast("array<double>")).otherwise(F.transform(scored, lambda x: x["v"])).alias("scores"),
    )


def status(n_excerpts: Column, error: Column, answer: Column) -> Column:
    return (F.when(n_excerpts == 0, "no_evidence").when(error.isNotNull(), "failed").when(is_abstention(answer), "abstained").otherwise("ok"))


def ask_model(rows: DataFrame, model, batch: int = 16) -> DataFrame:
    """(id, answer, error, status) of prompts (id, prompt, n_excerpts): ``model`` takes a list of prompts and
    returns their answers, on executors. Prompts without excerpts never reach it; an error of a
    batch is the status of its rows and stops nothing."""
    ship(rows.sparkSession)

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    answers, error = list(model(part["prompt"].tolist())), None
                except Exception as e:  # a failed call is a result
                    answers, error = [None] * len(part), str(e)[:500]
                yield pd.DataFrame({"id": part["id"], "answer": answers, "error": [error] * len(part), "n_excerpts": part["n_excerpts"]})

    kind = rows.schema["id"].dataType.simpleString()
    asked = rows.where("n_excerpts > 0").select("id", "prompt", "n_excerpts").mapInPandas(run, f"id {kind}, answer string, error string, n_excerpts int")
    bare = rows.where("n_excerpts <= 0").select("id", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"), F.col("n_excerpts").cast("int").alias("n_excerpts"))
    found = asked.unionAll(bare)
    return found.select("id", "answer", "error", status(F.col("n_excerpts"), F.col("error"), F.coalesce("answer", F.lit(""))).alias("status"))


def keywords_hit(answer: Column, keywords: Column, across_spaces: bool = True) -> Column:
    """Every slot of an array of synonym lists has a synonym in the answer; no slots: false. across_spaces: a
    synonym is found also where white space parts it ("is cum" holds "scum")."""
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", "") if across_spaces else c)
    return (F.size(keywords) > 0) & F.forall(keywords, lambda slot: F.exists(slot, lambda k: squeeze(answer).contains(squeeze(k))))


def answer_metrics(outcomes: DataFrame) -> DataFrame:
    """Abstain accuracy, over-abstain rate and answer accuracy; null where no case is of the kind."""
    grounded, mean = ~F.col("expect_abstain"), lambda who, what: F.avg(F.when(who, what.cast("double")))
    return outcomes.agg(
        mean(F.col("expect_abstain"), F.col("abstained")).alias("abstain_accuracy"), mean(grounded, F.col("abstained")).alias("over_abstain_rate"),
        mean(grounded, F.col("keywords_hit") & ~F.col("abstained")).alias("answer_accuracy"),
    )


def latency_metrics(outcomes: DataFrame) -> DataFrame:
    ok = outcomes.where("error is null")
    return ok.agg(F.coalesce(F.median("elapsed_sec"), F.lit(0.0)).alias("median_sec"),
                  F.coalesce(F.sum("completion_tokens") / F.nullif(F.sum("elapsed_sec"), F.lit(0.0)), F.lit(0.0)).alias("tokens_per_sec"))
