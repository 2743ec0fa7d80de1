"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of domains, languages and sources in proportion to their weights. A
node can't take more than its tokens times the epochs allowed; what it can't take goes to its
siblings by their weights, and only what they can't take either goes up to its parent's siblings.
Quotas are whole tokens and add up to the budget as long as there are tokens for it.
Each leaf then takes whole epochs and a prefix of one more, in an order seeded by epoch.
DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Scratch
from .buckets import free_name

UNKNOWN = "unknown"
LEVELS = ["domain", "lang", "source"]
#: Bits of a leaf's order that one refinement step resolves: at most 256 sums a leaf and step.
STEP_BITS = 8


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"([^\x09-\x0D\x20]+)"), F.lit(1))).cast("long"), F.lit(0).cast("long"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A row's place in an epoch: the first 60 bits of an MD5 of seed, epoch and id."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def weight_of(column: str, weights: Mapping[str, int]) -> Column:
    """Whole-number weight of a node's name; 1 where none is given."""
    out = F.lit(1).cast("long")
    for name, weight in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(weight).cast("long")).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """children (parent..., node, w, cap, budget of the parent) with ``got``: each child's part.

    A child is filled if the level at which it is full (cap / w) asks no more than the budget of all
    children together. The others share what the full ones leave by their weights; the tokens that
    whole numbers leave over go one each to the largest fractions, of equal ones to the first name.
    So the parts add up to the budget, or to all caps if they are less. Whole numbers throughout.
    """
    own = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    line = own.orderBy(F.col("cap") / F.col("w"), node)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    out = children.withColumn("before", F.sum("cap").over(line) - F.col("cap"))
    out = out.withColumn("behind", F.sum("w").over(own) - F.sum("w").over(line) + F.col("w"))
    out = out.withColumn("full", wide("cap") * wide("behind") <= wide("w") * (wide("budget") - wide("before")))
    out = out.withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(own))
    out = out.withColumn("weights", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(own))
    exact = "cast(w as decimal(19,0)) * cast(rest as decimal(19,0))"
    out = out.withColumn("whole", F.when(~F.col("full"), F.expr(f"({exact}) div cast(weights as decimal(19,0))")).otherwise(0))
    out = out.withColumn("part", F.when(~F.col("full"), F.expr(f"({exact}) % cast(weights as decimal(19,0))")).otherwise(0))
    out = out.withColumn("over", F.when(F.col("weights") > 0, F.col("rest")).otherwise(0) - F.sum("whole").over(own))
    place = F.row_number().over(own.orderBy(F.desc("part"), node))
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.col("whole") + (place <= F.col("over")).cast("long"))
    return out.withColumn("got", got.cast("long")).drop("before", "behind", "full", "rest", "weights", "whole", "part", "over")


def quotas(leaves: DataFrame, budget: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens) of leaves to the same with ``quota``."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs).where("cap > 0")
    for name in LEVELS:  # what is left out at any level is no part of its parents' caps
        caps = caps.where(weight_of(name, weights.get(name, {})) > 0)
    total = None
    for depth in range(len(LEVELS)):
        keys = LEVELS[: depth + 1]
        level = caps.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        for name in LEVELS[depth : depth + 1]:
            level = level.withColumn("w", weight_of(name, weights.get(name, {}))).where("w > 0")
        if total is None:
            level = level.withColumn("budget", F.lit(budget).cast("long"))
        else:
            level = level.join(total, keys[:-1])
        total = share_out(level, keys[:-1], keys[-1]).select(*keys, F.col("got").alias("budget"))
    return leaves.join(total.withColumnRenamed("budget", "quota"), LEVELS)


def cutoffs(rows: DataFrame, quota: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """(leaf, epochs, cut): whole epochs of each leaf and the last key of the started one (-1: none).

    The key's bits are resolved in steps. In each, the tokens of 256 ranges a leaf are summed, which
    combines before the shuffle, and the range where the quota ends is searched on. No task holds
    a leaf, however large.
    """
    quota = quota.select(
        *LEVELS, F.expr("cast(quota div tokens as long)").alias("epochs"), (F.col("quota") % F.col("tokens")).alias("rest")
    )
    quota = scratch.keep(quota)
    keyed = rows.join(quota.where("rest > 0"), LEVELS)
    keyed = scratch.keep(keyed.withColumn("key", order_key(seed, F.col("epochs"), F.col("id"))).drop("epochs", "id"))
    at = quota.where("rest > 0").select(*LEVELS, "rest", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(60 - STEP_BITS, 60 - 6 * STEP_BITS, -STEP_BITS):
        inside = keyed.drop("rest").join(at, LEVELS).where(F.shiftright("key", shift + STEP_BITS) == F.col("prefix"))
        sums = inside.groupBy(*LEVELS, "rest", "base", F.shiftright("key", shift).alias("part")).agg(F.sum("tokens").alias("t"))
        line = Window.partitionBy(*LEVELS).orderBy("part")
        sums = sums.withColumn("before", F.col("base") + F.sum("t").over(line) - F.col("t"))
        # the last range that begins below the quota holds its end
        at = sums.where("before < rest").groupBy(*LEVELS, "rest").agg(F.max_by("before", "part").alias("base"), F.max("part").alias("prefix"))
        at = scratch.keep(at)
    inside = keyed.drop("rest").join(at, LEVELS).where(F.shiftright("key", shift) == F.col("prefix"))
    peers = inside.groupBy(*LEVELS, "rest", "base", "key").agg(F.sum("tokens").alias("t"))
    line = Window.partitionBy(*LEVELS).orderBy("key")
    last = peers.withColumn("before", F.col("base") + F.sum("t").over(line) - F.col("t")).where("before < rest")
    cut = last.groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    return quota.join(cut, LEVELS, "left").select(*LEVELS, "epochs", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut"))


def mix_sources(
    spark: SparkSession, docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]],
    budget: int | None = None, share: float = 0.5, max_epochs: int = 3, seed: int = 11, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The rows of docs that the mixture takes, all their columns, and ``_quill_copies`` (1 or more),
    ``_quill_domain`` and ``_quill_tokens``.

    budget: tokens of the mixture (words between ASCII white space); without it, ``share`` of all
    tokens. weights: of the names at "domain", "lang" and "source", whole numbers, 1 where none is
    given, 0 to leave a name out. A null domain, language or source is the name "unknown". A row is
    taken once for each whole epoch of its leaf and once more if its key is in the prefix of the next;
    the prefix ends with the key that reaches the quota, so it passes it by less than the rows of one
    id. Rows that repeat an id share its key and so its fate. Texts without words cost nothing and
    follow their key. Null ids share one key. An empty table, and one without words, gives an empty
    result. Input columns keep their names and values; an added name that a column has already is longer by
    underscores (``mixture_columns``).
    """
    scratch = Scratch(spark, "mixing")
    named = lambda c: F.coalesce(c.cast("string"), F.lit(UNKNOWN))
    leaf = {"domain": named(domain), "lang": named(F.col(lang_col)), "source": named(F.col(source_col))}
    rows = docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in leaf.items()], token_count(F.col(text_col)).alias("tokens"))
    rows = scratch.keep(rows)
    leaves = scratch.keep(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    cut = scratch.keep(cutoffs(rows, quotas(leaves, budget, weights, max_epochs), scratch, seed))
    places, copies, tokens = mixture_columns(docs)
    epochs, last = free_name(docs, "_quill_epochs"), free_name(docs, "_quill_cut")
    cut = cut.toDF(*places, epochs, last)
    out = docs.withColumns(dict(zip(places, (leaf[k] for k in LEVELS))))
    out = out.join(cut, list(places))  # broadcast while its file is small
    key = order_key(seed, F.col(epochs), F.col(id_col))
    out = out.withColumn(copies, F.col(epochs) + (key <= F.col(last)).cast("long"))
    out = out.where(F.col(copies) > 0).withColumn(tokens, token_count(F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], copies, places[0], tokens)


def mixture_columns(docs: DataFrame) -> tuple[tuple[str, str, str], str, str]:
    """((domain, language, source), copies, tokens): names that ``mix_sources`` adds and no column of docs has."""
    domain, lang, source, copies, tokens = (free_name(docs, f"_quill_{x}") for x in ("domain", "lang", "source", "copies", "tokens"))
    return (domain, lang, source), copies, tokens
