from panelwright.llm import licenses
from panelwright.llm.license_texts import ISC, MIT, TEXTS, ZLIB

VARIANT = "MIT LICENCE\n\nCopyright (c) 2020 Somebody\n(c) 2021 Else\nAll rights reserved.\n\n" + MIT.upper().replace("LICENSE", "LICENCE").replace('"', "'").replace(",", " ,\n")


def test_variants_of_a_text_have_its_licence(spark):
    rows = [(1, VARIANT), (2, MIT + " Extra words."), (3, "Some prose.\n  Released under the MIT License!  \nMore."), (4, None), (5, ""),
            (6, "!!! ... ---"), (7, ZLIB.replace("acknowledgment", "acknowledgement")), (7, ZLIB), (8, "the licence text is long"),
            (9, "Copyright 2020 A\n" * 2000 + MIT), (10, "SPDX-License-Identifier: MIT\nlicensed under CC0 1.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS digest", "1 AS license", "2 AS lines", "3 AS ids")
    got = licenses.scan(docs).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert {i: r.license for i, r in by_id.items() if r.license} == {1: "MIT", 7: "Zlib", 9: "MIT"}
    assert by_id[3].notices == "MIT" and by_id[10].notices == "CC0-1.0,MIT" and by_id[8].notices == ""
    assert by_id[4].digest == by_id[5].digest == by_id[6].digest
    assert licenses.scan(docs.limit(0)).count() == 0


def wrapped(text, words=7):
    """The paragraphs of a text in short lines behind comment marks."""
    parts = [p.split() for p in text.split("\n\n")]
    return "\n#\n".join("\n".join("# " + " ".join(p[k : k + words]) for k in range(0, len(p), words)) for p in parts)


def test_notices_inside_documents(spark):
    rows = [(1, "A file.\n" + " ".join(ISC.split()) + "\nMore of it."), (2, "#!/bin/sh\n\n" + wrapped(MIT) + "\n\necho done"),
            (3, "Intro.\n# Copyright (c) 2020 Somebody\n" + wrapped(ISC, 5) + "\n\nThe rest.\n\n" + ZLIB + "\n\nEnd."),
            (4, "One.\n\n" + wrapped(MIT).replace("restriction", "limit") + "\n\nTwo."), (5, "One. " + " ".join(MIT.split()) + " Two."),
            (None, "x\n\n" + ISC), (None, "x\n\n" + ISC), (None, "y")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS text_key", "2 AS `a.b`")).collect()
    assert sorted((r.doc_id or 0, r.notices) for r in got) == [(0, ""), (0, "ISC"), (0, "ISC"), (1, "ISC"), (2, "MIT"), (3, "ISC,Zlib"), (4, ""), (5, "")]
    assert all(r.license is None for r in got)


def test_every_known_text_is_found_in_short_lines(spark):
    rows = [(k, "Before.\n\n" + wrapped(text) + "\n\nAfter.") for k, (_, text) in enumerate(TEXTS)]
    names = {k: r for k, r in enumerate(i for i, _ in TEXTS)}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(names[r.doc_id] in r.notices.split(",") for r in got)


def test_known_texts_can_be_a_table(spark):
    own = spark.createDataFrame([("X-1", "Do what you like."), ("A-1", "do WHAT you like"), ("E", "")], "license string, text string")
    docs = spark.createDataFrame([(1, "Do what you like!"), (2, "")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs, own).collect()} == {1: "A-1", 2: None}


def test_every_fixed_text_is_known_once(spark):
    known = licenses.known_digests(spark).collect()
    assert {r.license for r in known} == {i for i, _ in TEXTS}
