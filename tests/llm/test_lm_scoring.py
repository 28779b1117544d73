import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import gru
from panelwright.llm import lm_scoring as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = gru.Shape(12, 4, 3)


@pytest.fixture
def small():
    r = np.random.default_rng(0)
    p = gru.initial(SHAPE, r.random(15) + 0.1)
    return {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in p.items()}


def literal(p, symbols):
    """One document, one token at a time."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    n, h, total, x = gru.HIDDEN, np.zeros(gru.HIDDEN), 0.0, SHAPE.inputs - 1
    for y in symbols:
        a, b = p["emb"][x] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = sig(a[:n] + b[:n]), sig(a[n : 2 * n] + b[n : 2 * n])
        h = (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :]) + z * h
        c = y // 4 if y < 12 else 3 + y - 12
        total += math.log(softmax(h @ p["wc"] + p["bc"])[c])
        if y < 12:
            k = y // 4 * 4
            total += math.log(softmax(h @ p["wo"][k : k + 4].T + p["bo"][k : k + 4])[y - k])
        x = y
    return total


def test_whole_documents_with_carried_state(small):
    r = np.random.default_rng(1)
    sizes = [1, 0, 130, 7, 300, 25, 1]
    symbols, offsets = r.integers(0, 15, sum(sizes)).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
    got = gru.score_documents(small, SHAPE, symbols, offsets)
    want = [literal(small, symbols[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_probabilities_sum_to_one(small):
    total = sum(math.exp(gru.score_documents(small, SHAPE, np.array([3, y], dtype=np.int32), np.array([0, 2]))[0] - gru.score_documents(small, SHAPE, np.array([3], dtype=np.int32), np.array([0, 1]))[0]) for y in range(15))
    assert total == pytest.approx(1, abs=1e-4)


def test_gradient_matches_differences(small, monkeypatch):
    r = np.random.default_rng(2)
    x, y, fresh = r.integers(0, 15, (5, 3)), r.integers(0, 15, (5, 3)), np.zeros((5, 3), dtype=bool)
    fresh[0] = fresh[2, 1] = True
    x[fresh] = SHAPE.inputs - 1
    p = {k: v.astype(np.float64) for k, v in small.items()}

    def loss(q):
        h, total = np.zeros((3, gru.HIDDEN)), 0.0
        for t in range(5):
            h = gru._step(h * ~fresh[t][:, None], q["emb"][x[t]] @ q["wx"] + q["b"], q["wh"])[0]
            total -= gru.token_log_probs(q, SHAPE, h, y[t]).sum()
        return total / 15

    found = {}
    monkeypatch.setattr(gru.Trainer, "_adam", lambda self, g: found.update(g))
    gru.Trainer(small, SHAPE)._window(np.zeros((3, gru.HIDDEN), dtype=np.float32), x, y, fresh)
    for k in p:
        for at in [tuple(r.integers(0, s) for s in p[k].shape) for _ in range(4)]:
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert found[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=2e-4)


def test_table_finds_ranks():
    r = np.random.default_rng(3)
    h = r.integers(1, 1 << 62, 5000).astype(np.uint64)
    h[:50] = (h[:50] & np.uint64(0xFFFFFFFF00000000)) | np.uint64(7)
    t = L.Table(h, np.ones(5000, dtype=np.int64))
    assert (t.find(h) == np.arange(5000)).all() and (t.find(r.integers(1, 1 << 62, 1000).astype(np.uint64)) == -1).all() and (L.Table(h[:0], np.zeros(0, dtype=np.int64)).find(h) == -1).all()


def test_base_contract_and_learning(docs, prose):
    rows = [(k, (prose(k, 80, 60) if k % 2 else prose(k, 80, 60).replace("w", "V")), "s") for k in range(300)] + [(301, None, "s"), (302, "", "s"), (303, "Unseen words only here", "s"), (None, "w1 w2", "s"), (5, "dup", "s"), (5, "dup", "s")]
    table = docs(rows, extra=("row", "word", "n"))
    got = L.score(table, L.fit(table)).collect()
    assert len(got) == len(rows)
    low = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] + [None]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    c = Counter(w for k, t, _ in rows if not held(k) for w in low(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for k, t, _ in rows:
        words = low(t)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[k, held(k), len(words), sum(c[w] > 0 for w in words), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_held_out_documents_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in L.score(docs, L.fit(docs)).collect() if r.held_out]
    assert len(got) > 100 and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_table(docs):
    assert L.score(docs([]), L.fit(docs([]))).count() == 0
    only = docs([(next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1), "a b", "s")])
    r = L.score(only, L.fit(only)).collect()[0]
    assert (r.train_tokens, r.n_known, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_every_token_of_a_stream_is_learned(small):
    symbols = np.random.default_rng(3).integers(0, 15, 3 * 64 * gru.STEPS + 2)
    firsts = np.arange(len(symbols)) % 50 == 0
    other = symbols.copy()
    other[-1] = (other[-1] + 1) % 15
    a, b = gru.Trainer(small, SHAPE), gru.Trainer(small, SHAPE)
    a.learn(symbols, firsts)
    b.learn(other, firsts)
    assert a.tokens == len(symbols) and any((a.p[k] != b.p[k]).any() for k in small)


def test_state_is_packed_and_unpacked(small):
    trainer = gru.Trainer(small, SHAPE)
    trainer.learn(np.random.default_rng(3).integers(0, 15, 4000), np.arange(4000) % 40 == 0)
    state = trainer.state()
    again = gru.State.from_flat(state.flat(), state.steps, small)
    assert again.steps == trainer.t > 0 and all((getattr(again, part)[k] == getattr(state, part)[k]).all() for part in ("params", "m", "v") for k in small)


def test_the_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = []
    for n in (1, 32, 128):
        dealt = docs.repartition(n)
        # Three streams, so that replicas are averaged.
        held = L.score(dealt, L.fit(dealt, stream_tokens=120_000)).where("held_out")
        r = held.agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).collect()[0]
        found.append((r["sum(score)"] / r["sum(n_tokens)"], r["sum(base_score)"] / r["sum(n_tokens)"]))
    assert all(score == pytest.approx(found[0][0], abs=1e-6) and score > base + 0.15 for score, base in found)


def test_a_round_that_worsens_is_undone(docs):
    table = docs([(k, " ".join(f"w{(k + i) % 7}" for i in range(60)), "s") for k in range(400)])
    begin, learned, spoiled = L.fit(table, rounds=0), L.fit(table), L.fit(table, rate=50.0)
    assert all((begin.params[k] == spoiled.params[k]).all() for k in begin.params) and any((begin.params[k] != learned.params[k]).any() for k in begin.params)


def test_very_long_texts(docs):
    table = docs([(1, "a b " * 500_000, "s"), (2, " " * 10_000_000, "s"), (3, "x" * 10_000_000, "s")])
    got = {r.doc_id: r for r in L.score(table, L.fit(table)).collect()}
    assert (got[1].n_tokens, got[2].n_tokens, got[3].n_tokens) == (1_000_001, 1, 2) and got[1].score > got[1].base_score
