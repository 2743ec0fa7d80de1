"""The operators as stages over a documents table (doc_id, text, lang, source, n_chars)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Scratch, batches_of
from .buckets import free_name, sieve, sifted
from .mixing import mix_sources, mixture_columns
from .packing import pack
from .shingle_join import similar_components, text_sets
from .toxicity import score_documents, train

#: Words in a run; documents are near copies at 4/5 of their runs in common.
RUN = 5
#: Bytes of texts or sets of runs that go to Python at once: both it and Spark hold them, twice at times.
BATCH = 4 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the toxicity model doesn't reject, unchanged.

    The model learns from the labelled rows of docs outside the held-out fold; each row is judged by its
    own whole text. Null, empty and word-less texts stay, and so do rows without an id; rows that repeat
    are judged each, alike. Labels of no document teach nothing, and without any label nothing goes.
    An empty table gives an empty one; other columns pass as they are, whatever their names. The rows are
    written once, in batches of at most ``BATCH`` bytes: what executors took for larger ones they would keep.
    """
    scratch = Scratch(spark, "stage-toxicity", batch=BATCH)
    with batches_of(spark, BATCH):
        model = train(spark, docs, labels, "doc_id", "text", "toxic")
    return scratch.keep(score_documents(docs, model, "text", reject=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id.

    Documents link where the sets of their runs of five words have a similarity (common runs / all runs)
    of 0.8 or more; every such pair is found and no other. A text of fewer words is one run. Null,
    empty and blank texts are one group. A null doc_id is kept only where the group has no other. Of
    rows that repeat a doc_id in one group one stays, chosen by a hash of its values. Rows stay as they
    are, whatever the names of their columns; an empty table gives an empty one. Runs and sets are
    told apart by 64-bit hashes.

    The rows are written once with a number of their own. A sieve (``buckets.sieve``) of the numbers that
    are to be verified, and in the end of those that go, lets the other rows pass where they lie: only
    rows that may be among them are sent, few as long as the sieve has bits enough for them.
    """
    scratch = Scratch(spark, "stage-shingles", batch=BATCH)
    row = free_name(docs, "_quill_row")
    held = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()))
    values = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = held.select(F.col(row).alias("row"), "doc_id", F.xxhash64(*values).alias("mark"), "text")
    rows = scratch.keep(text_sets(rows, ["row", "doc_id", "mark"], RUN))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "mark", "row"))
    classes = rows.groupBy("node").agg(first.alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    classes = scratch.keep(classes)
    scratch.drop(rows)

    def texts(nodes: DataFrame) -> DataFrame:
        of = scratch.keep(classes.join(nodes, "node").select("node", F.col("first.row").alias("id")))
        rows, _ = sifted(held.select(F.col(row).alias("id"), "text"), "id", sieve(of.select("id"), scratch))
        return rows.join(of, "id").select("node", "text")

    linked = scratch.keep(similar_components(classes.drop("first"), texts, RUN, scratch))
    joined = classes.select("node", "first").join(linked, "node", "left")
    stay = joined.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    stay = scratch.keep(stay.select(F.col("first.row").alias("id")))
    gone = scratch.keep(held.select(F.col(row).alias("id")).join(stay, "id", "left_anti"))
    maybe, sure = sifted(held, row, sieve(gone, scratch))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return sure.select(*columns).unionAll(maybe.join(gone.toDF(row), row, "left_anti").select(*columns))


def mix(spark: SparkSession, docs: DataFrame, weights, budget_share: float, max_epochs: int, domain) -> DataFrame:
    """The mixture's rows, each as often as it is taken, with the columns of docs.

    Null domains, languages and sources are the name "unknown"; rows that repeat an id share its fate,
    null ids share one. Texts without words cost nothing and follow their key. An empty table, and one
    without words, gives an empty result. For the rules see ``mix_sources``.
    """
    taken = mix_sources(spark, docs, domain, weights, share=budget_share, max_epochs=max_epochs)
    copy = free_name(taken, "_quill_copy")
    taken = taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(mixture_columns(docs)[1]))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The corpus as sequences: a row per piece with its ids (``pack``). Each row of docs is a document of
    its own, also where it repeats; a null or empty text has the end token alone; an empty table
    gives no piece."""
    return pack(spark, docs, tokenizer_path)
