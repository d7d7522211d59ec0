"""Licence scans: whole licences as documents, and blocks of several lines inside a document."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
from stationclim.llm import licences

TEXTS = Path(licences.__file__).parent / "known_licences"


def test_whole_licences_and_blocks(spark, docs_of, monkeypatch):
    names = sorted(f.stem for f in TEXTS.glob("*.txt"))
    body = {n: (TEXTS / f"{n}.txt").read_text("utf-8") for n in names}
    rows = [(i, f"Copyright (c) 2021 B. Person\n\n{body[n]}") for i, n in enumerate(names)]
    header = "\n".join("# " + x for x in licences._APACHE_NOTICE.split("\n"))
    mit = "MIT License\n\nCopyright (c) 2021 B. Person\n\n" + body["MIT"]
    rows += [(100, f"{header}\n\nimport os\n"), (101, f"About this package\n\n{mit}\n\nint main() {{}}\n"),
             (102, f"{header}\n\nimport os\n\n{mit}\n\nmore\n"), (103, header.replace("may not use", "may use") + "\n\nimport os\n")]
    known = licences.known_texts(spark)
    for small in (True, False):
        if not small:
            monkeypatch.setattr(licences, "broadcast_if_small", lambda df, n: (df, False))
        got = {r.doc_id: r for r in licences.scan(docs_of(rows), known).collect()}
        assert [got[i].license_id for i in range(len(names))] == names and all(got[i].n_notices == 0 for i in range(len(names)))
        assert [(got[i].license_id, got[i].n_notices, got[i].notice_ids) for i in (100, 101, 102, 103)] == [
            (None, 1, "Apache-2.0"), (None, 1, "MIT"), (None, 2, "Apache-2.0,MIT"), (None, 0, "")]


def _planted(names, body):
    """Rows with notices, whole licences, licences between other blocks, licences side by side and almost-licences."""
    mit, bsd = body["MIT"], body["BSD-2-Clause"]
    notice = "Released under the MIT Licence."
    flat = " ".join(licences._APACHE_NOTICE.split("\n\n")[0].split()) + "\n \n---\n" + licences._APACHE_NOTICE.split("\n\n")[1]
    texts = [None, "", "\n\n \n", notice, f"{notice}\n{notice}\n\ncode", mit, f"intro\n\n{mit}", f"{mit}\n\nend", f"a\n\n{mit}\n\n{bsd}\n\nb",
             f"a\n\n{mit}\n\n{mit}", f"x\n\nMIT License\n\n{mit}\n\n{notice}", f"x\n\n{flat}\n\ny", f"x\n{mit}\ny", "héllo wörld\n\n" + mit.upper(),
             f"x\n\n{mit.replace('copies', 'copy')}"]
    texts += [f"first\n\n{body[n]}\n\n\n\nlast" for n in names]
    return [(i, t) for i, t in enumerate(texts)] + [(6, texts[6])]


def test_runs_equal_the_sql(spark, docs_of, monkeypatch):
    """Both ways of the lookup against the query's SQL, which lists every pair of a block's begin and end."""
    names = sorted(f.stem for f in TEXTS.glob("*.txt"))
    rows = _planted(names, {n: (TEXTS / f"{n}.txt").read_text("utf-8") for n in names})
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = sorted(con.sql(licences.oracle()).fetchall(), key=repr)
    assert sum(r[3] for r in want) > len(names)
    known = licences.known_texts(spark)
    for small in (True, False):
        if not small:
            monkeypatch.setattr(licences, "broadcast_if_small", lambda df, n: (df, False))
        df = licences.scan(docs_of(rows), known)
        assert df.columns == ["doc_id", "text_digest", "license_id", "n_notices", "notice_ids"]
        assert sorted((tuple(r) for r in df.collect()), key=repr) == want
        if small:
            assert "NestedLoop" not in df._jdf.queryExecution().toString()
