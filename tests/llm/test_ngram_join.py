import random
import re
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import ngram_join as J
from panelwright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    low = {}
    for k, (i, _) in enumerate(sets):
        low.setdefault(find(k), []).append(i)
    return Counter((i, len(s), None if i is None else min(low[find(k)])) for k, (i, s) in enumerate(sets))


def edited(r, words, share):
    out = list(words)
    for k in range(len(out)):
        if r.random() < share:
            out[k] = f"e{r.randrange(10**6)}"
    return out


def planted(seed):
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(70)]
    rows, n = [], 0
    for group in range(25):
        base = [f"g{group}w{k}" for k in range(r.choice([2, 5, 6, 9, 14, 30, 90, 250]))]
        for _ in range(r.choice([1, 2, 3, 9])):
            words = edited(r, base, r.choice([0, 0.01, 0.03, 0.06]))
            if r.random() < 0.4:
                at = r.randrange(len(words) + 1)
                words = words[:at] + passage + words[at:]
            text = " ".join(words)
            rows.append((n * 7 % 1009, text.upper() if r.random() < 0.1 else text.replace(" ", r.choice([" ", "\n", "  "]))))
            n += 1
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(docs, seed):
    rows = planted(seed) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "a"), (5004, "A"), (5005, "a b c d"), (None, "a b c d"), (5005, "a b c d")]
    got = J.near_duplicates(docs([(i, t, "s") for i, t in rows], extra=("key", "sid", "n")))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_every_boundary_gives_the_same_links(docs, monkeypatch):
    rows = planted(9)
    want = brute(rows)
    for light in (1, 8, 40):
        monkeypatch.setattr(J, "boundary", lambda sizes, scan, light=light: light)
        got = J.near_duplicates(docs([(i, t, "s") for i, t in rows]))
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_frequent_shingles_only_change_the_order(docs, monkeypatch):
    rows = planted(4)
    monkeypatch.setattr(J, "FREQUENT_MIN", 2)
    got = J.near_duplicates(docs([(i, t, "s") for i, t in rows]))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def lists_of_many(seed, members=130):
    """Texts that share a long passage but link in several groups of like sizes only, so that lists above ``SHORT`` stay open."""
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(members):
        own = [f"g{k % 23}w{i}" for i in range(r.choice([40, 44, 70]))]
        rows.append((k * 31 % 1009, " ".join(passage + edited(r, own, r.choice([0, 0.02, 0.3])))))
    return rows


@pytest.mark.parametrize("seed, block, long", [(1, 512, 4096), (2, 40, 30), (3, 16, 7)])
def test_long_lists_match_brute_force(docs, monkeypatch, seed, block, long):
    scanned = []
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "LONG", long)
    monkeypatch.setattr(J, "SHORT", 8)
    monkeypatch.setattr(J, "FREQUENT_MIN", 10**9)
    blocks = J._blocks
    monkeypatch.setattr(J, "_blocks", lambda m: (scanned.append(m.count()), blocks(m))[1])
    rows = lists_of_many(seed)
    got = J.near_duplicates(docs([(i, t, "s") for i, t in rows]))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)
    assert (scanned[0] > 0) == (block < 100)


def test_frequent_lists_in_parts_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(J, "LONG", 9)
    rows = lists_of_many(4)
    got = J.near_duplicates(docs([(i, t, "s") for i, t in rows]))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_blocks_meet_every_comparable_pair_once(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 10)
    r = random.Random(6)
    n = {sid: r.choice([4, 9, 10, 12, 13, 100, 130]) for sid in range(60)}
    members = spark.createDataFrame([(7, 60, s, k, 0, s) for s, k in n.items()], "key long, k long, sid long, n long, place long, root long")
    units = {}
    for x in J._blocks(members).collect():
        units.setdefault(x.key, []).append(x)
    met = Counter(frozenset((x.sid, y.sid)) for u in units.values() for i, x in enumerate(u) for y in u[:i] if x.side != y.side or x.side == 0)
    assert max(met.values()) == 1
    assert all(met[frozenset((a, b))] == 1 for a in n for b in range(a) if 100 * min(n[a], n[b]) >= 75 * max(n[a], n[b]))


def test_ids_are_drawn_anew_when_two_sets_share_one(docs):
    grams, limits = np.array([1, 2, 3], dtype=np.uint64), np.array([0, 1, 3])
    assert len({tuple(J.set_ids(grams, limits, d)) for d in range(4)} | {tuple(J.set_ids(grams, limits, ~d & 0xFFFF)) for d in range(4)}) == 8
    assert (J.set_ids(grams, limits, 2) == J.set_ids(grams, limits, 2)).all()


def test_very_long_texts(docs):
    text = " ".join(f"w{k}" for k in range(300_000))
    rows = [(1, text, "s"), (2, "x " + text, "s"), (3, " " * 10_000_000, "s"), (4, "y" * 10_000_000, "s"), (5, "z " * 2_000_000, "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs(rows)).collect()}
    assert got == {1: (299_996, 1), 2: (299_997, 1), 3: (0, 3), 4: (1, 4), 5: (1, 5)}


def test_boundary_follows_cost():
    assert J.boundary({n: 10 for n in range(1, 65)}, 1.0) < J.boundary({n: 10 for n in range(1, 65)}, 50.0)


def test_keep_one(docs):
    rows = [(3, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "x", "s"), (2, "x", "s"), (None, "a b c d e f", "s"), (9, None, "s")]
    table = docs(rows, extra=("count", "component_id"))
    kept = J.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect()) == [(-1, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (9, "")]


def test_empty_table(docs):
    assert J.near_duplicates(docs([])).count() == 0
    assert J.keep_one(docs([])).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (7000, 7000)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}
