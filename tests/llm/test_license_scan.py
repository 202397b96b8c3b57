from __future__ import annotations

import hashlib
import re
from pathlib import Path

import pytest
import regex

from framewright.llm import license_scan as s
from framewright.llm.license_texts import DIGESTS, TEXTS, known_notices, known_texts


def canonical(text):
    text = regex.sub(s.COPYRIGHT_LINES.replace("\\x{A9}", "©"), " ", text or "")
    text = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip(" ")
    if re.search("licen[cs]e|copyright|warrant", text):
        for pattern, written in s.SPELLINGS:
            text = re.sub(pattern, lambda m, w=written: w.replace("$1", (m[1] or "") if m.re.groups else ""), text)
    return hashlib.sha256(text.encode()).hexdigest()


def test_known_texts_in_other_spelling(spark):
    texts = [(name, f"Copyright (c) 2019, Someone Else\n  Copyright © 2020 An Owner. All rights reserved.\n\n{text.upper().replace(' ', '   ').replace('LICENSE', 'LICENCE')}") for name, text in TEXTS.items()]
    rows = [(k, name, text) for k, (name, text) in enumerate(texts)] + [(99, "none", TEXTS["MIT"] + " and more"), (98, "none", TEXTS["MIT"][:-60])]
    got = {r.doc_id: r.license_id for r in s.licenses(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()}
    assert got == {k: None if name == "none" else name for k, name, _ in rows}


def test_notices_and_digests_of_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {canonical(line): name for name, lines in sorted(known_notices().items(), reverse=True) for line in lines}
    for r in s.licenses(docs).collect():
        assert r.digest == canonical(texts[r.doc_id])
        named = [known[d] for line in texts[r.doc_id].split("\n") if "licen" in line.lower() and (d := canonical(line)) in known]
        assert (r.n_notices, r.notices) == (len(named), ",".join(sorted(set(named))))


#: Files that many systems carry.
SHARED = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "BSD-3-Clause": "BSD", "CC0-1.0": "CC0-1.0", "GFDL-1.2-only": "GFDL-1.2", "GFDL-1.3-only": "GFDL-1.3", "GPL-1.0-only": "GPL-1", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.0-only": "LGPL-2", "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not SHARED.exists(), reason="no licence texts on this machine")
def test_planted_whole_texts(spark):
    whole = {name: (SHARED / f).read_text() for name, f in FILES.items()}
    rows = []
    for name, text in whole.items():
        rows += [(name, text), (name, re.sub(r"[^\S\n]+", "  ", text.upper()).replace("\n", "\r\n")), (None, text + "\nOne clause more."), (None, text[: len(text) // 2])]
    apart = whole["Apache-2.0"].index("APPENDIX: How"), whole["GPL-3.0-only"].index("How to Apply These"), whole["MPL-2.0"].index("Exhibit A - ")
    rows += [(name, whole[name][:at]) for name, at in zip(("Apache-2.0", "GPL-3.0-only", "MPL-2.0"), apart)]
    got = {r.doc_id: r.license_id for r in s.licenses(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert got == {k: name for k, (name, _) in enumerate(rows)}
    assert set(DIGESTS) == set(whole)


def test_titles_and_notices(spark):
    rows = [(name, text, "") for name, texts in known_texts().items() for text in texts]
    rows += [(None, f"x\n// {line.upper()}!\nThis is no license line", name) for name, lines in known_notices().items() for line in lines if line.startswith(("SPDX", "Licensed under the"))]
    got = {r.doc_id: (r.license_id, r.notices) for r in s.licenses(spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert got == {k: (name, said) for k, (name, _, said) in enumerate(rows)}


def test_known_tables_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "House rules: be kind. No warranty."), (2, "a\nUnder the house license\nb"), (3, None)], "doc_id long, text string")
    texts = spark.createDataFrame([("House", "HOUSE RULES - be kind; no warranty"), ("Z", "house rules be kind no warranty")], "license_id string, text string")
    got = {r.doc_id: (r.license_id, r.n_notices, r.notices) for r in s.licenses(docs, texts, {"House": ["under the house licence."]}).collect()}
    assert got == {1: ("House", 0, ""), 2: (None, 1, "House"), 3: (None, 0, "")}


def test_edges(edge, empty):
    got = s.licenses(edge).collect()
    assert len(got) == 11 and {r.license_id for r in got} == {None}
    assert s.licenses(empty).collect() == []
