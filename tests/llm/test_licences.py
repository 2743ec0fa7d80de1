import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.llm import licences

SCHEMA = "doc_id long, text string, _id long, n string, unit string"
FOLDER = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0-text", "GPL-3": "GPL-3.0-text", "GPL-2": "GPL-2.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0-text", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause-UC"}


def plain_canonical(text):
    out = text.lower()
    out = re.sub(r"(?m)^[ \t#*/;-]*(\(c\)|©|copyright.*(\(c\)|©|[12]\d\d\d|<year>|\[yyyy\])).*$", " ", out)
    out = re.sub(r"(?m)^[ \t#*/;-]*all rights reserved[ \t.]*$", " ", out)
    out = " ".join(re.findall(r"[^\W_]+", out))
    for said, form in licences.SPELLINGS:
        out = re.sub(rf"\b{said}\b", form, out)
    return out


def plain_scan(rows, known):
    digests = {}
    for i, text in sorted(known):
        if plain_canonical(text):
            digests.setdefault(plain_canonical(text), i)
    whole = {d: i for i, d, _ in licences.WHOLE}
    found = Counter()
    for doc, text in rows:
        if text is None:
            continue
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        for unit, pieces in (("document", [text]), ("paragraph", re.split(r"\n[ \t]*\n\s*", text)), ("line", text.split("\n"))):
            for c in map(plain_canonical, pieces):
                if name := digests.get(c) or whole.get(hashlib.md5(c.encode()).hexdigest()):
                    found[doc, unit, name] += 1
    return found


def scanned(spark, rows):
    frame = spark.createDataFrame([(i, t, 7, "n", "u") for i, t in rows], SCHEMA)
    return {(r["doc_id"], r["unit"], r["licence_id"]): r["n"] for r in licences.scan(frame, licences.known_licences(spark)).collect()}


def test_units_are_those_of_the_plain_version(spark):
    mit = dict(licences.KNOWN)["MIT-text"]
    wrapped = re.sub(r"(.{1,46})(?: |$)", r"\1\n", mit).replace("OR COPYRIGHT", "OR\nCOPYRIGHT")
    notice = "Released under the MIT License."
    rows = [
        (1, "Copyright 2020 Me\n" + mit.upper().replace(",", " ,")), (2, "x\nlicenced  under CC-BY NC 4.0\ny"), (2, "RELEASED under the MIT licence"), (None, notice),
        (3, None), (4, ""), (5, " \n\t"), (6, f"{notice}\n\n{notice}\r\n \t\r\n\n  {notice}\nand"), (7, wrapped), (8, "a\n\n" + wrapped + "\n\nb"),
        (9, f"\n\n{notice}\n"), (10, f"(c) Somebody\n{notice}\nAll rights reserved."), (11, "plain words " * 100_000 + "\n" + notice), (12, f"Copyright notice\n{notice}"),
    ]
    got = scanned(spark, rows)
    assert got == plain_scan(rows, licences.KNOWN)
    assert got[7, "document", "MIT-text"] == 1 and got[1, "document", "MIT-text"] == 1 and got[6, "paragraph", "MIT"] == 2 and got[11, "line", "MIT"] == 1


@pytest.mark.skipif(not FOLDER.is_dir(), reason="the system has no licence texts")
def test_whole_licences_are_known(spark):
    texts = {name: (FOLDER / file).read_text(errors="replace") for file, name in FILES.items()}
    rows = [(n, t.replace("\n", "\r\n")) for n, (_, t) in enumerate(sorted(texts.items()))]
    got = scanned(spark, rows)
    assert {(n, "document", name): 1 for n, name in enumerate(sorted(texts))}.items() <= got.items()
    assert got == plain_scan(rows, licences.KNOWN)


def test_empty_tables_and_licences_without_text(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 7, "n", "u"), (2, "...", 7, "n", "u")], SCHEMA)
    odd = spark.createDataFrame([("a", None), (None, "plain"), ("b", ""), ("c", "--"), ("z", "released UNDER the mit licence"), ("y", "Released under the MIT License")], "licence_id string, text string")
    known = licences.known_digests(odd)
    assert [r["licence_id"] for r in known.collect()] == ["y"]
    assert {(r["doc_id"], r["unit"], r["licence_id"], r["n"]) for r in licences.scan(docs, known).collect()} == {(1, u, "y", 1) for u in ("document", "paragraph", "line")}
    none = known.where(F.lit(False))
    assert licences.scan(docs, none).count() == 0 and licences.scan(docs.limit(0), known).count() == 0
