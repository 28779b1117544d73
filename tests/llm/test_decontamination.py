import random
import time

from panelwright.llm import decontamination as D


def brute(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, start=1):
        new = [i]
        for j, d in enumerate(text, start=1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance_matches_the_table():
    r = random.Random(1)
    for _ in range(400):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 60)))
        assert D.edit_distance_within(p, t)[0] == brute(p, t)


def test_pieces_cover_the_item():
    assert "".join(x for _, x in D.pieces("abcdefghij", 3)) == "abcdefghij" and len(D.pieces("abcdefghij", 3)) == 4


def test_finds_every_item_within_budget(spark, docs, prose):
    r = random.Random(2)
    items = [(k, prose(100 + k, 40)) for k in range(6)] + [(9, None), (10, ""), (11, "tiny")]
    rows, want = [], set()
    for n in range(40):
        text, (item, body) = prose(n, 60), items[n % 6]
        if n % 2:
            chars, edits = list(D.normalize(body)), r.choice([0, 3, 8, 40])
            for at in r.sample(range(len(chars)), edits):
                chars[at] = r.choice(["", "zz"[: r.randint(1, 2)], "q"])
            text = text + "\n" + "".join(chars).upper() + " " + prose(n + 500, 30)
        norm = D.normalize(text)
        for i, b in items[:6]:
            if brute(D.normalize(b), norm) <= D.budget(len(D.normalize(b))):
                want.add((n, i))
        rows.append((n, text, "s"))
    rows += [(None, items[0][1], "s"), (50, None, "s"), (51, "", "s"), (52, "a Tiny  thing", "s"), (52, "a Tiny  thing", "s")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    table = docs(rows, extra=("item_id", "distance"))
    got = [(x.doc_id, x.item_id) for x in D.matches(table, bench).collect()]
    assert want and set(got) - {(None, 0), (52, 11)} == want
    assert got.count((52, 11)) == 2 and (None, 0) in got
    assert {(x.item_id, x.distance) for x in D.matches(table.where("doc_id = 52"), bench).collect()} == {(11, 0)}
    clean = D.drop_contaminated(table, bench)
    assert clean.columns == table.columns
    assert sorted(x.doc_id for x in clean.collect()) == sorted(k for k, _, _ in rows if k is not None and k != 52 and k not in {d for d, _ in want})


def test_several_blocks_and_empty_tables(spark, docs, prose, monkeypatch):
    items = [(k, prose(k, 30)) for k in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs([(k, t, "s") for k, t in items])
    monkeypatch.setattr(D, "BLOCK_CHARS", 200)
    monkeypatch.setattr(D, "SLAB_BYTES", 300)
    assert len(D._blocks(bench, "item_id", "text")) > 2
    assert {(x.doc_id, x.item_id) for x in D.matches(table, bench).collect()} == {(k, k) for k in range(5)}
    assert D.drop_contaminated(table, bench).count() == 0
    assert D.matches(docs([]), bench).count() == 0 and D.matches(table, bench.where("item_id < 0")).count() == 0


def test_ids_of_any_kind_and_none(spark, docs, prose):
    bench = spark.createDataFrame([("a", prose(1, 20)), (None, prose(2, 20)), (None, prose(3, 20)), ("b", None)], "item_id string, text string")
    table = docs([(1, prose(1, 20), "s"), (2, prose(2, 20), "s"), (3, prose(3, 20), "s"), (4, prose(4, 20), "s")])
    assert sorted((x.doc_id, x.item_id) for x in D.matches(table, bench).collect()) == [(1, "a"), (2, None), (3, None)]
    assert [x.doc_id for x in D.drop_contaminated(table, bench).collect()] == [4]


def test_short_items_have_the_same_budget():
    assert [D.budget(n) for n in (1, 16, 17, 33, 34, 100)] == [0, 0, 1, 1, 2, 6]
    matcher = D.Matcher([(1, "abcdefghij klmnop")], D.MAX_ERROR)
    assert [len(matcher.search(t)) for t in ("xx abcdefgh-j klmnop", "xx abcdefghj klmnop x", "xx abcdef--ij klmnop")] == [1, 1, 0]


def test_very_long_texts():
    began = time.monotonic()
    item = D.normalize("the quick brown fox jumps over the lazy dog and then sleeps under the old tree")
    matcher = D.Matcher([(1, item), (2, "a" * 120), (3, "ab" * 40)], D.MAX_ERROR)
    assert [x[0] for x in matcher.search("z " * 1_000_000 + item.replace("fox", "fix") + " z" * 1_000_000)] == [1]
    assert matcher.search("a" * 2_000_000) == [(2, 0, 120)]
    assert matcher.search(" " * 10_000_000) == [] and matcher.search("\n" * 10_000_000 + "x") == []
    assert [x[:2] for x in matcher.search("ab" * 1_000_000)] == [(3, 0)]
    # No occurrence within the budget, but hits everywhere.
    assert matcher.search(("a" * 60 + "b" * 20) * 2_000) == []
    assert time.monotonic() - began < 120
