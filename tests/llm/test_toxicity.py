import numpy as np
from panelwright.llm import toxicity
from panelwright.llm.tables import importable


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    n = labels.sum()
    return (rank[labels == 1].mean() - (n - 1) / 2) / (len(scores) - n)


def test_scores_equal_a_plain_convolution():
    net = toxicity.Network.untrained(3)
    texts = ["one two three two", "", "Alpha, beta!", None]
    rows = []
    for t in texts:
        words = toxicity.words_of(t)
        vectors = [np.mean([net.vectors[k] for k in toxicity.features(w)], axis=0) for w in words]
        vectors += [np.zeros(toxicity.DIMENSIONS)] * toxicity.padding(len(words))
        pooled = []
        for width, f in zip(toxicity.WIDTHS, net.filters, strict=True):
            pooled.append(np.max([np.concatenate(vectors[k : k + width]) @ f for k in range(len(vectors) - width + 1)], axis=0))
        rows.append(np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.weights + net.shift)
    got = [toxicity.Scorer(net).logits([t])[0] for t in texts]
    assert np.allclose(got, rows, atol=1e-4)
    assert np.allclose(toxicity.Scorer(net).scores(texts), toxicity.sigmoid(np.array(rows)), atol=1e-4)


def test_training_finds_the_words_and_their_forms():
    rng = np.random.default_rng(5)
    texts, toxic = [], []
    for k in range(600):
        words = [f"word{rng.integers(400)}" for _ in range(30)]
        if k % 4 == 0:
            words[rng.integers(30)] = "grubble" + "abcdefgh"[rng.integers(6)]
        texts.append(" ".join(words))
        toxic.append(k % 4 == 0)
    toxic = np.array(toxic, np.float32)
    net = toxicity.train(texts, toxic, np.ones(len(texts), np.float32))
    assert auc(toxicity.Scorer(net).logits(texts), toxic) > 0.99
    forms = [texts[1] + " grubblezz", texts[2] + " grubbleh", texts[1], texts[2]]
    scores = toxicity.Scorer(net).logits(forms)
    assert scores[:2].min() > scores[2:].max()


def test_best_cut_separates():
    scores, toxic = np.array([0.1, 0.9, 0.4, 0.8]), np.array([0, 1, 0, 1])
    assert 0.4 < toxicity.best_cut(scores, toxic, np.ones(4)) < 0.8


def test_held_out_rows_and_pipeline_stage(spark, sf):
    sf = "/root/testdata/sf0.1"
    importable(spark)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.judge(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert auc(np.array([r.score for r in got]), np.array([r.toxic for r in got])) > 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    odd = docs.selectExpr("*", "1 AS score", "'x' AS `a.b`", "2 AS _score")
    left = toxicity.drop_toxic(odd, labels)
    assert left.columns == odd.columns
    flags = {r.doc_id: r.toxic for r in labels.collect()}
    kept = [flags.get(r.doc_id) for r in left.select("doc_id").collect()]
    assert kept.count(1) < 0.3 * sum(flags.values()) and kept.count(0) > 0.98 * list(flags.values()).count(0)


def test_defined_results(spark):
    importable(spark)
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "a b", "en"), (None, "c", "fr"), (3, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == 5 and all(r.score == 0 and r.predicted == 0 and not r.rejected for r in got)
    both = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, both)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if not r.text}) == 1
    assert toxicity.judge(docs.limit(0), both).count() == 0 and toxicity.drop_toxic(docs, labels).count() == 5
