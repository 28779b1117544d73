import re

from panelwright.llm import mixing


def shares(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = budget * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        if not rest:
            return full
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s: cap * sizes[s] for s in rest if t[s] >= cap * sizes[s]}
        if not over:
            return full | t
        full |= over


def test_targets_and_taken(docs):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), ["a", "b", "B", "é", None, "z"][min(5, i % 11)]) for i in range(900)]
    rows += [(5, None, "a"), (6, "", "empty"), (None, "one two", "a"), (7, "dup dup", "b"), (7, "dup dup", "b")]
    got = mixing.mix(docs(rows, extra=("size", "target", "__x"))).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(mixing.WORD, t or ""))
    want = shares(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_prefix_of_keys_is_taken_across_ranges(docs, monkeypatch):
    monkeypatch.setattr(mixing, "_BUCKET_ROWS", 10)
    rows = [(i, "a b c", "s" if i % 3 else "t") for i in range(400)]
    got = {r.doc_id: r for r in mixing.mix(docs(rows)).collect()}
    monkeypatch.setattr(mixing, "_BUCKET_ROWS", 10_000)
    assert {k: r.taken for k, r in got.items()} == {r.doc_id: r.taken for r in mixing.mix(docs(rows)).collect()}


def test_reruns_agree_and_empty(docs):
    rows = [(i, f"x {i}", "s") for i in range(50)]
    assert sorted(mixing.mix(docs(rows)).collect()) == sorted(mixing.mix(docs(rows[::-1])).collect())
    assert mixing.mix(docs([])).count() == 0


def test_heavier_documents_come_first(docs):
    from pyspark.sql import functions as F

    rows = [(i, "a b", "s" if i < 2000 else "t") for i in range(2400)]
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)
    got = mixing.mix(docs(rows), weight=weight, budget=0.5, cap=2.0).where("source = 's'").collect()
    heavy = sum(r.taken for r in got if r.doc_id % 2 == 0)
    assert heavy > 2 * sum(r.taken for r in got if r.doc_id % 2)


def test_very_long_texts(docs):
    rows = [(1, "w " * 3_000_000, "s"), (2, "x" * 10_000_000, "s"), (3, " " * 10_000_000, "t"), (4, "\n" * 5_000_000 + "end", "t")]
    got = {r.doc_id: r for r in mixing.mix(docs(rows)).collect()}
    assert [got[k]["size"] for k in range(1, 5)] == [3_000_000, 1, 0, 1]
    assert abs(sum(r.taken for r in got.values()) - 1.5 * 3_000_002) <= 2
