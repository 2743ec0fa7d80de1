"""Tables that a job writes for itself, and its code on executors.

A table written here cuts lineage: losing an executor costs the tasks that ran on it, never the
steps before. The folder is ``spark.checkpoint.dir``; a local session without that setting gets one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to what Python workers import, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillspark-code-")) / "quillspark_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; an error on a cluster that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
    return context.getCheckpointDir().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


@contextmanager
def setting(spark: SparkSession, name: str, value: str | None):
    """A setting of the session in what runs meanwhile; None: as it is."""
    if value is None:
        yield
        return
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def batches_of(spark: SparkSession, size: int | None):
    """Arrow batches of at most ``size`` bytes, or one row, to Python in what runs meanwhile."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", None if size is None else str(size))


def save(frame: DataFrame, path: str, row_group: int | None = None) -> None:
    """Writes a table as Parquet. What its plan shuffled goes with the job: else those files stay on the executors'
    disks until the driver happens to collect its garbage, and those of a run's jobs add up."""
    writer = frame.write.option("parquet.block.size", row_group) if row_group else frame.write
    with setting(frame.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        writer.parquet(path)


class Scratch:
    """Tables of one operator call. ``keep`` writes and rereads one, ``drop`` deletes early.

    What a returned, still lazy DataFrame reads must stay; it goes when the driver ends. ``batch``: bytes of an
    Arrow batch to Python while a table is written, where rows are wide; else the session's.
    """

    def __init__(self, spark: SparkSession, label: str, batch: int | None = None) -> None:
        ship(spark)
        self.spark = spark
        self.batch = batch
        self.root = f"{shared_dir(spark)}/quillspark-{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        try:
            fs, found = file_system(self.spark, path)
            fs.delete(found, True)
        except Exception:  # the session is gone already; the folder's owner clears it
            pass

    def keep(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        with batches_of(self.spark, self.batch):
            save(frame, path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._quill_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(frame._quill_path)

    def clear(self) -> None:
        """Deletes all its tables."""
        self._delete(self.root)
