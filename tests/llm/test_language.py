import numpy as np
import pytest
from panelwright.llm import language
from panelwright.llm.queries import vocabulary
from panelwright.llm.tables import importable

PATH = vocabulary("piece_bpe_32k.model")
TEXTS = {"aa": "mama lala mala nana lama banana", "bb": "krzk brzt strk zrtk krst tzrk"}


def segmentations(text, pieces, unknown):
    """All ways to cut a marked word, as lists of piece numbers."""
    if not text:
        return [[]]
    out = []
    for end in range(1, len(text) + 1):
        k = pieces.get(text[:end], -1)
        if k < 0 and end == 1:
            k = unknown
        if k >= 0:
            out += [[k, *rest] for rest in segmentations(text[end:], pieces, unknown)]
    return out


@pytest.mark.parametrize("word", ["a", "there", "ciónñ", "łx漢z", "banana"])
def test_forward_sums_all_segmentations(word):
    pieces, unknown = language.pieces(PATH)
    chance = np.random.default_rng(1).random((unknown + 1, 3)) * 0.1
    ways = segmentations(language.START + word, pieces, unknown)
    want = np.log(sum(np.prod(chance[w], axis=0) for w in ways))
    assert np.allclose(language.word_scores([word], pieces, unknown, chance)[0], want)
    assert np.allclose(language.long_word(word, pieces, unknown, chance), want)


def test_expected_uses_weigh_segmentations():
    pieces, unknown = language.pieces(PATH)
    chance = np.random.default_rng(2).random((unknown + 1, 1)) * 0.1
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 2), pa.array(["hand", "and"]), pa.array([3, 2])], ["lang", "word", "n"])
    (got,) = language._expected(PATH, ["x"], chance)([batch])
    want = np.zeros(unknown + 1)
    for word, n in (("hand", 3), ("and", 2)):
        ways = segmentations(language.START + word, pieces, unknown)
        mass = [np.prod(chance[w, 0]) for w in ways]
        for w, m in zip(ways, mass, strict=True):
            np.add.at(want, w, n * m / sum(mass))
    found = np.zeros(unknown + 1)
    found[got.column(0).to_numpy()] = got.column(1).to_numpy()
    assert np.allclose(found, want)


def test_long_words_do_not_underflow():
    pieces, unknown = language.pieces(PATH)
    chance = np.full((unknown + 1, 2), 1e-6)
    short, long = (language.word_scores(["zqx" * n], pieces, unknown, chance)[0] for n in (10, 4000))
    assert np.isfinite(long).all() and (long < short).all()


@pytest.mark.parametrize("n", range(36, 51))
def test_unseen_letters_do_not_underflow(n):
    pieces, unknown = language.pieces(PATH)
    chance = np.full((unknown + 1, 2), 1e-3)
    chance[:, 0] = 5e-9  # this language saw none of it
    word = "漢字仮名" * 13
    got = language.word_scores([word[:n]], pieces, unknown, chance)[0]
    assert np.isfinite(got).all() and np.allclose(got, language.long_word(word[:n], pieces, unknown, chance))


def test_a_text_is_scored_the_same_beside_any_others():
    pieces, unknown = language.pieces(PATH)
    chance = np.random.default_rng(3).random((unknown + 1, 2)) * 1e-9 + 1e-10
    chance[[k for p, k in pieces.items() if k >= 0 and p.lstrip(language.START).isascii()], 1] = 1e-3
    texts = ["", "漢字仮名" * 11, "plain words", "12", "漢字仮名" * 12, "", "more plain words", ""]
    together = language.Scorer(PATH, ["aa", "bb"], np.log([0.5, 0.5]), chance).score(texts)
    alone = [language.Scorer(PATH, ["aa", "bb"], np.log([0.5, 0.5]), chance).score([t]) for t in texts]
    assert together == ([x[0][0] for x in alone], [x[1][0] for x in alone])
    assert [together[0][k] for k in (0, 2, 3, 6, 7)] == ["und", "bb", "und", "bb", "und"]
    assert np.isfinite(together[1]).all()


def test_learning_from_a_long_word_of_rare_letters():
    import pyarrow as pa

    pieces, unknown = language.pieces(PATH)
    chance = np.full((unknown + 1, 1), 1e-8)
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array(["漢字仮名" * 12]), pa.array([1])], ["lang", "word", "n"])
    (got,) = language._expected(PATH, ["x"], chance)([batch])
    assert np.isfinite(got.column(1).to_numpy()).all() and got.column(1).to_numpy().sum() > 1


def test_prediction_and_defined_results(spark):
    importable(spark)
    rows = [(i, lang, " ".join([TEXTS[lang]] * 3)) for i, lang in enumerate([*TEXTS] * 20)]
    rows += [(100, None, "lama lala"), (101, None, None), (102, "aa", "123 !? ²"), (None, None, "krzk"), (103, None, ""), (104, None, "KRZK " * 50_000), (100, None, "lama lala")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 AS score", "'u' AS held_out").repartition(3)
    got = language.identify(docs, PATH).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == lang for i, lang, _ in rows[:40])
    assert [by_id[i].lang_pred for i in (100, 101, 102, None, 103, 104)] == ["aa", "und", "und", "bb", "und", "bb"]
    assert by_id[101].score == 0
    blank = language.identify(docs.withColumn("lang", docs["lang"].substr(100, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang"), PATH)
    assert {(r.lang_pred, r.score) for r in blank.collect()} == {("und", 0.0)}
    assert language.identify(docs.limit(0), PATH).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, PATH).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
