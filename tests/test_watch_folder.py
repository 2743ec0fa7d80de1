"""A folder watched by a stream, over restarts."""

import os

from quillspark.streaming import events


def test_changes_of_a_folder_are_told_once_over_restarts(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    for name in ("a", "b", "c"):
        (folder / f"{name}.txt").write_text(name * 5)
    (folder / "~$lock.txt").write_text("x")

    def told():
        events.watch_folder(spark, str(folder), state, once=True)
        rows = spark.read.parquet(f"{state}/changes")
        last = max(int(x.removeprefix("batch=")) for x in os.listdir(f"{state}/changes"))  # a batch without changes has no row
        return {(os.path.basename(r["path"]), r["kind"], r["source"] and os.path.basename(r["source"])) for r in rows.where(f"batch = {last}").collect()}

    assert told() == {(f"{x}.txt", "created", None) for x in "abc"}
    (folder / "a.txt").write_text("longer than before")
    os.rename(folder / "b.txt", folder / "moved.txt")
    os.remove(folder / "c.txt")
    (folder / "d.txt").write_text("new file")
    expected = {("a.txt", "modified", None), ("moved.txt", "moved", "b.txt"), ("c.txt", "deleted", None), ("d.txt", "created", None)}
    assert told() == expected
    assert told() == set()
    stream = events.watched(spark, state)
    events.run_available(stream, "folder_told", str(tmp_path / "reader"))
    assert spark.table("folder_told").count() == 3 + 4
    assert len(os.listdir(f"{state}/listing")) <= 2
