import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import toxicity as X

def categories():
    return [("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]



def corpus(prose, n=400):
    r = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        words = prose(k, 60, 300).split()
        bad, ugly = r.random() < 0.3, r.random() < 0.3
        for _ in range(4):
            if bad:
                words[r.randrange(60)] = r.choice(["Scoundrel,", "villain!", "rascal"])
            if ugly:
                words[r.randrange(60)] = r.choice(["###buy", "cheappills"])
        rows.append((k, " ".join(words), "s"))
        labels.append((k, 0 if ugly else 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, docs, prose):
    rows, labels = corpus(prose)
    table = docs([*rows, (900, None, "s"), (901, "", "s"), (None, "villain rascal scoundrel", "s"), (5, rows[5][1], "s")], extra=("p_toxic", "feature", "quality"))
    seen = spark.createDataFrame([*labels[:280], (None, 1, 0), (7, None, None), (8888, 0, 1)], "doc_id long, quality int, toxic int")
    chain, vocabulary = X.fit(table, seen, categories())
    got = X.score(table, chain, vocabulary).collect()
    assert len(got) == len(rows) + 4
    p = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in got}
    truth = {k: (1 - q, t) for k, q, t in labels[280:]}
    for k in (0, 1):
        assert np.mean([(p[d][k] > 0.5) == bool(t[k]) for d, t in truth.items()]) > 0.95
    assert p[900] == p[901] and p[None][1] > 0.5


def sample(lists, y, size, fold=None):
    n = len(lists)
    fold = np.arange(n) % X.FOLDS if fold is None else fold
    return X.Sample(np.array([f for x in lists for f in x], dtype=np.int32), np.array([len(x) for x in lists]), np.asarray(y), fold, np.ones((np.shape(y)[1], X.FOLDS + 1, size), dtype=bool))


def test_chain_uses_earlier_categories():
    r = np.random.default_rng(1)
    y1 = (r.random(600) < 0.5).astype(int)
    chain, odds = X.fit_chain(sample([[0] * y for y in y1], np.column_stack([y1, y1]), 1), ["a", "b"])
    assert chain.models[1].extra[0] > 0.1 and ((odds[:, 0] > 0) == (y1 == 1)).all()


def literal_fit(x, y, l2=0.3):
    """Newton's method on the dense penalised likelihood; the bias is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([l2] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    return w


def test_linear_model_matches_newton():
    r = np.random.default_rng(5)
    x = (r.random((400, 6)) < 0.3).astype(float)
    extra = r.normal(size=(400, 1))
    y = (r.random(400) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1] + extra[:, 0])))).astype(float)
    row, feature = np.nonzero(x)
    got = X.fit_linear(row, feature, extra, y, 6, steps=3000, rate=0.02)
    assert np.allclose([*got.weights, *got.extra, got.bias], literal_fit(np.column_stack([x, extra]), y), atol=0.02)


MARKS = set("!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~-")


def literal_features(text):
    words = "".join(" " if c in MARKS else c.lower() if c.isascii() else c for c in text).split()
    return {(w, 0) for w in words} | {(w.encode()[:k], k) for w in words for k in X.STEMS if len(w.encode()) > k}


def literal_chi_square(n, y, rows, positive):
    p = min(max(positive / rows, 1e-6), 1 - 1e-6)
    return (y - n * p) ** 2 / (n * p * (1 - p) * (1 - n / (rows + 1)))


def test_features_are_chosen_within_folds(spark, prose, monkeypatch):
    monkeypatch.setattr(X, "MIN_CHI_SQUARE", 2.0)
    rows = [(f"{prose(k, 12, 30)} {'Vile,' if k % 3 == 0 else 'kind'} {'wordbeginning' + str(k) if k % 4 == 0 else ''}", k % 5, int(k % 3 == 0), int(k % 4 == 0)) for k in range(90)]
    frame = spark.createDataFrame(rows, "text string, fold int, __y0 int, __y1 int").repartition(3)
    got = Counter((r.k, r.f) for r in X.select_features(frame, ["a", "b"]).collect())
    want = Counter()
    seen = [literal_features(t) for t, *_ in rows]
    for f in range(6):
        used = [i for i in range(90) if rows[i][1] != f]
        for w in set().union(*seen):
            on = [i for i in used if w in seen[i]]
            if len(on) >= X.MIN_DOCS and sum(w in s for s in seen) >= X.MIN_DOCS:
                for k in (0, 1):
                    want[k, f] += literal_chi_square(len(on), sum(rows[i][2 + k] for i in on), len(used), sum(rows[i][2 + k] for i in used)) >= 2.0
    assert got == +want


def test_out_of_fold_odds_have_not_seen_the_row():
    r = np.random.default_rng(2)
    n = 200
    y = (r.random((n, 1)) < 0.5).astype(int)
    fold = r.integers(0, 5, n)
    # Each row has a feature of its own: a model that saw the row would know its label.
    chain, odds = X.fit_chain(sample([[i] for i in range(n)], y, n, fold), ["a"])
    for f in range(5):
        assert len(set(np.round(odds[fold == f, 0], 9))) == 1
    assert (np.sign(chain.models[0].log_odds(np.arange(n), np.arange(n), np.zeros((n, 0)), n)) == 2 * y[:, 0] - 1).all()


def test_executors_and_driver_fit_alike(spark):
    r = np.random.default_rng(3)
    s = sample([list(r.integers(0, 12, 3)) for _ in range(80)], (r.random((80, 2)) < 0.4).astype(int), 12)
    a, b = X.fit_chain(s, ["a", "b"]), X.fit_chain(s, ["a", "b"], X.on_executors(spark, s))
    assert np.allclose(a[1], b[1]) and all(np.allclose(p.weights, q.weights) for p, q in zip(a[0].models, b[0].models, strict=True))


def test_very_long_texts(spark, docs, prose):
    rows, labels = corpus(prose, 120)
    table = docs([*rows, (900, "villain " * 600_000, "s"), (901, " " * 5_000_000, "s"), (902, "x" * 5_000_000, "s")])
    chain, vocabulary = X.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), categories())
    got = {r.doc_id: r.p_toxic for r in X.score(table, chain, vocabulary).collect()}
    assert got[900] > 0.5 and got[901] == got[902] < 0.5


def test_without_labels(spark, docs):
    table = docs([(1, "a b", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain, vocabulary = X.fit(table, none, categories())
    assert [(r.p_low_quality, r.p_toxic) for r in X.score(table, chain, vocabulary).collect()] == [(0.5, 0.5)]
    assert X.score(docs([]), chain, vocabulary).count() == 0
