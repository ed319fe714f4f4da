import hashlib

from panelwright.llm import spans
from panelwright.llm.tables import importable

A = "The first sentence of this passage has quite a few words in it. The second one is nearly as long as the first was! Third?\n"
B = "Another passage begins here and goes on for a number of words. It too has a second sentence which is long enough. "
LONE = "One sentence that is long enough to stand for a run of its own has twenty words or more of any kind. "
ROWS = [(2, "Start here. " + A + "Mine alone ends it."), (1, A + "Other words."), (3, None), (4, ""), (5, "\n \n"), (6, B + B), (7, "x. " + A + B),
        (8, "Short. Too. Short. Too."), (8, "Short. Too."), (9, "word " * 30_000 + ". End."), (10, "Start here. " + A + "Mine alone ends it."),
        (11, "\nBefore it. " + LONE + "After it."), (12, LONE + "Something else."), (13, "\n" + LONE.upper()), (14, "a. " * 45), (15, "\n" + "a. " * 25)]
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LEAST = 20


def cut(text):
    """Sentences, read letter by letter."""
    out, now, at = [], "", 0
    while at < len(text):
        now += text[at]
        ends = text[at] == "\n" or text[at] in ".!?" and text[at + 1 : at + 2] and text[at + 1] in SPACE
        at += 1
        if ends:
            while at < len(text) and text[at] in SPACE:
                now += text[at]
                at += 1
            out.append(now)
            now = ""
    return out + [now] if now else out


def brute(rows):
    """All runs of twenty words or more, of any number of sentences."""
    pieces = {row: cut(row[1] or "") for row in rows}
    words = {row: [tuple(p.lower().split()) for p in ps] for row, ps in pieces.items()}
    places = {row: [(a, b) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if sum(map(len, w[a:b])) >= LEAST] for row, w in words.items()}
    first, out = {}, {}
    for row in sorted(rows, key=lambda r: r[0]):
        for a, b in places[row]:
            first.setdefault(tuple(words[row][a:b]), (row[0], a))
    for row in rows:
        gone, holders, w = set(), set(), words[row]
        for a, b in places[row]:
            at = first[tuple(w[a:b])]
            if at != (row[0], a):
                gone |= set(range(a, b))
                shortest = sum(map(len, w[a : b - 1])) < LEAST or sum(map(len, w[a + 1 : b])) < LEAST
                holders |= {at[0]} if shortest else set()
        kept = "".join(p for k, p in enumerate(pieces[row]) if k not in gone)
        out[row] = (len(pieces[row]), len(gone), hashlib.sha256(kept.encode()).hexdigest(), ",".join(map(str, sorted(holders))))
    return out


def documents(spark, rows):
    importable(spark)
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS start", "1 AS n_removed", "2 AS spans", "3 AS key", "4 AS _spans", "5 AS _doc", "6 AS `a.b`")


def test_report_equals_brute_force(spark):
    rows = ROWS + ROWS[:1]  # a repeated row is the same document
    got = spans.span_report(documents(spark, rows).repartition(3)).collect()
    known = brute(ROWS)
    assert sorted(tuple(r) for r in got) == sorted((row[0], *known[row]) for row in rows)
    # whole passages go, their ends and lone long sentences too
    assert {r.doc_id: r.n_removed for r in got if r.n_removed} == {2: 3, 6: 2, 7: 5, 10: 5, 12: 1, 13: 1, 14: 44, 15: 25}


def test_chance_texts_equal_brute_force(spark):
    import random

    dice = random.Random(5)
    stock = [" ".join(dice.choice("a b c d e f".split()) for _ in range(dice.choice([1, 4, 9, 23]))) + dice.choice([". ", "!\n", "\n", ".\t"]) for _ in range(30)]
    rows = []
    for k in range(60):
        text, at = "", 0
        for _ in range(dice.randrange(12)):
            at = at + 1 if dice.random() < 0.8 else dice.randrange(30)
            text += stock[at % 30]
        rows.append((k, text))
    got = spans.span_report(documents(spark, rows).repartition(4)).collect()
    known = brute(rows)
    assert sorted(tuple(r) for r in got) == [(row[0], *known[row]) for row in rows]


def test_sentences_join_to_the_text_and_runs_are_long_enough():
    for _, text in ROWS:
        pieces = spans.sentences(text or "")
        assert "".join(pieces) == (text or "") and pieces == cut(text or "")
        found = [(start, n) for start, n, _ in spans.runs(pieces)]
        assert len(found) == len(set(found)) <= 2 * len(pieces)
        for start, n in found:
            words = [len(p.split()) for p in pieces[start : start + n]]
            assert sum(words) >= LEAST and (sum(words[:-1]) < LEAST or sum(words[1:]) < LEAST)


def test_stage_keeps_columns(spark):
    docs = documents(spark, ROWS)
    out = spans.drop_repeated_spans(docs)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed_", "copied_from"]
    assert {r.doc_id: r.text for r in out.collect()}[2] == "Start here. Mine alone ends it."
    assert spans.drop_repeated_spans(docs.limit(0)).count() == 0
