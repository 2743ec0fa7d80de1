"""Incremental indexing over immutable snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import file_system, save


def classify(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """scan (path, mtime, hash) against stored (path, mtime, hash): (path, change, refresh_mtime).

    Unknown: new. Equal mtime: unchanged, whatever the hash. Equal hash: unchanged, the stored mtime is
    to be refreshed. Else changed."""
    s = stored.select("path", F.col("mtime").alias("_m"), F.col("hash").alias("_h"))
    rows = scan.join(s, "path", "left")
    same_time, same_hash = F.col("mtime") == F.col("_m"), F.col("hash") == F.col("_h")
    change = F.when(F.col("_m").isNull(), "new").when(same_time | same_hash, "unchanged").otherwise("changed")
    return rows.select("path", change.alias("change"), F.coalesce(F.col("_m").isNotNull() & ~same_time & same_hash, F.lit(False)).alias("refresh_mtime"))


def prune(stored: DataFrame, scan: DataFrame) -> DataFrame:
    """Stored documents that are gone."""
    low = scan.select(F.lower("path").alias("_p")).distinct()
    return stored.join(low, F.lower(stored["path"]) == low["_p"], "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """The snapshot after incoming documents replace those of the same id."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def cascade(children: DataFrame, parents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def missing_vectors(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the model, in order."""
    return chunks.join(vectors.where(F.col("model") == model).select("seq"), "seq", "left_anti").orderBy("seq")


def index_report(changes: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("change") == c)
    return changes.agg(F.count("*").alias("scanned"), n("new").alias("created"), n("changed").alias("updated"), n("unchanged").alias("skipped"))


def stale(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of the old snapshot that the new one lacks."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def needs_reindex(change: Column) -> Column:
    return change != "unchanged"


def lingering(chunks: DataFrame, folders: DataFrame) -> DataFrame:
    """(image_path) of chunks whose image lies below one of the folders (folder), case aside. Damaged
    image notes and chunks without one are left out."""
    path = F.get_json_object("image_json", "$.image_path")
    rows = chunks.select(path.alias("image_path")).where("image_path is not null")
    parts = F.split(F.lower(F.regexp_replace("image_path", r"\\", "/")), "/")
    # each leading part of the path, so that folders meet by equality
    above = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.array_join(F.slice("_p", F.lit(1), i), "/"))
    rows = rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("_p", F.slice(parts, F.lit(1), F.size(parts) - 1)).where(F.size("_p") > 0)
    names = folders.select(F.rtrim(F.lower(F.regexp_replace("folder", r"\\", "/")), F.lit("/")).alias("_f")).distinct()
    hit = rows.select("_n", "image_path", F.explode(above).alias("_f")).join(names, "_f", "left_semi")
    return hit.select("_n", "image_path").distinct().select("image_path")


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = file_system(spark, f"{root}/_versions")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(path)) if fs.exists(path) else []


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame | str]) -> int:
    """Writes a version of a store: tables by name, or the path of one that is there already.

    The tables are written first, then one small file that names them, created under the next number. A
    reader takes the highest number, so it sees the old version or the new one, whatever fails in
    between; a second writer of the same version gets an error.
    """
    version = max(versions(spark, root), default=0) + 1
    paths = {}
    for name, table in tables.items():
        paths[name] = table if isinstance(table, str) else f"{root}/{name}/{version:012d}-{uuid.uuid4().hex[:8]}"
        if not isinstance(table, str):
            save(table, paths[name])
    fs, path = file_system(spark, f"{root}/_versions/{version:012d}")
    temporary = file_system(spark, f"{root}/_writing/{uuid.uuid4().hex}")[1]
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(paths).encode()))
    out.close()
    fs.mkdirs(path.getParent())
    if fs.exists(path) or not fs.rename(temporary, path):  # a rename onto a file fails
        raise RuntimeError(f"version {version} of {root} was written by another job")
    return version


def current(spark: SparkSession, root: str) -> dict[str, str]:
    """The paths of the newest version's tables by name; none: empty."""
    found = versions(spark, root)
    if not found:
        return {}
    return json.loads("".join(r[0] for r in spark.read.text(f"{root}/_versions/{found[-1]:012d}").collect()))
