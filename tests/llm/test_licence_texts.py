"""Whole licences as they stand in repositories, against the known texts and digests; the SQL on the same rows."""

from pathlib import Path

import duckdb
import pytest

from lecturelab.llm import licenses

TEXTS: dict[str, str] = {}
for name, text in licenses.KNOWN:
    TEXTS.setdefault(name, text) if len(text) > 200 else None


def commented(text, sign):
    return "\n".join(f"{sign} {line}" for line in text.split("\n"))


def rows():
    mit, bsd = TEXTS["MIT"], TEXTS["BSD-3-Clause"]
    out = [
        ("MIT", "MIT License\n\nCopyright (c) 2024 Jane Doe\n\n" + mit), ("MIT", "The MIT License (MIT)\nCopyright Jane Doe and others\n" + mit),
        ("MIT", commented("MIT License\n\nCopyright (c) 2024 Jane Doe\n\n" + mit, "#")), ("MIT", commented("Copyright 2020 Jane Doe\nAll rights reserved.\n" + mit, " *")),
        ("MIT", mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("sublicense", "sub-licence")), ("MIT", "# COPYRIGHT (C) 1999\r\n" + mit.replace("\n", "\r\n")),
        ("BSD-3-Clause", "Copyright (c) 2001, The Authors\nAll rights reserved.\n\n" + bsd.replace("copyright notice", "Copyright Notice")),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + bsd), (None, mit + "\nAnd one condition more."), (None, "MIT License\n"), (None, ""), (None, None),
        (None, bsd.replace("must retain", "need not retain"))]
    out += [(name, text) for name, text in TEXTS.items()] + [(name, text.upper()) for name, text in TEXTS.items()]
    return out + [(name, f"{head}\n\nCopyright (c) 2024 Jane Doe\n\n{TEXTS[name]}") for name, head in licenses.HEADINGS]


def test_whole_licences(spark):
    cases = rows()
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "doc_id int, text string")
    got = {r.doc_id: r.licence for r in licenses.scan(df).collect()}
    assert got == {i: name for i, (name, _) in enumerate(cases)}
    con = duckdb.connect()
    con.execute("create table documents (doc_id int, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, text) for i, (_, text) in enumerate(cases)])
    want = sorted(con.execute(f"select doc_id, digest, licence, notice, n_notices from ({licenses.oracle()})").fetchall())
    assert sorted(tuple(r) for r in licenses.scan(df).select("doc_id", "digest", "licence", "notice", "n_notices").collect()) == want


FOLDER = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no folder of licence texts on this machine")
def test_long_licences_by_digest(spark):
    found = [(name, FOLDER / file) for name, file in FILES.items() if (FOLDER / file).is_file()]
    texts = [(name, path.read_text()) for name, path in found]
    df = spark.createDataFrame([*texts, *[(name, commented(text, "//").upper()) for name, text in texts]], "doc_id string, text string")
    assert all(r.doc_id == r.licence for r in licenses.scan(df).collect())


def test_own_lists(spark):
    df = spark.createDataFrame([(1, "House rules apply."), (2, "MIT License\n" + TEXTS["MIT"])], "doc_id int, text string")
    digest = licenses.scan(df).where("doc_id = 1").first()["digest"]
    assert {r.doc_id: r.licence for r in licenses.scan(df, known=[("House", "House rules  apply")], digests=[]).collect()} == {1: "House", 2: None}
    assert {r.doc_id: r.licence for r in licenses.scan(df, digests=[("House", digest)]).collect()} == {1: "House", 2: "MIT"}
