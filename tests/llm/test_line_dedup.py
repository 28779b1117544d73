import re

from panelwright.llm import line_dedup


def brute(rows, ratio, least):
    hosts = {}
    for _, t, s in rows:
        hosts.setdefault(s, []).append((t or "").split("\n"))
    drop = {}
    for s, pages in hosts.items():
        lines = {x for p in pages for x in p if re.search(r"[^\x20\x09-\x0D]", x)}
        on = {x: [tuple(p) for p in pages if x in p] for x in lines}
        drop[s] = {x for x, found in on.items() if len(set(found)) >= least and len(found) > ratio * len(pages)}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x not in drop[s])) for i, t, s in rows]


def same(got, rows, ratio, least):
    return sorted(map(repr, [(r.doc_id, r.text) for r in got.collect()])) == sorted(map(repr, brute(rows, ratio, least)))


def test_matches_brute_force(docs):
    rows = [(i, f"menu\nbody {i}\n\nfooter" if i % 3 else f"body {i}\nrare", "a" if i % 2 else None) for i in range(60)]
    rows += [(i, None if i % 7 else "", "b") for i in range(60, 80)] + [(90, "menu\nmenu\n\tx\nlast\n", "a"), (90, "menu\nmenu\n\tx\nlast\n", "a")]
    got = line_dedup.drop_boilerplate(docs(rows, extra=("host", "ratio", "n_lines_")), ratio=0.3, min_pages=5)
    assert got.columns[-3:] == ["host", "ratio", "n_lines_"]
    assert same(got, rows, 0.3, 5)


def test_many_boilerplate_lines_meet_brute_force(docs, prose):
    rows = [(i, "\n".join(f"line {(i * 7 + k * k) % 90}" for k in range(12)) + f"\nown {i}", "ab"[i % 2]) for i in range(200)]
    rows += [(300 + i, "copied\npage", "a") for i in range(40)]
    assert same(line_dedup.drop_boilerplate(docs(rows)), rows, line_dedup.RATIO, line_dedup.MIN_PAGES)


def test_copies_of_one_page_do_not_make_boilerplate(docs):
    rows = [(i, "same\ntext", "a") for i in range(50)] + [(i, f"other {i}", "a") for i in range(50, 90)]
    got = line_dedup.drop_boilerplate(docs(rows), min_pages=2)
    assert {r.text for r in got.where("doc_id < 50").collect()} == {"same\ntext"}


def test_copies_count_as_pages(docs):
    # A line on 3 different pages goes when their copies make them more than the ratio, not before.
    few = [(i, f"shared\nown {i}", "a") for i in range(3)] + [(i, f"other {i}", "a") for i in range(10, 40)]
    assert same(line_dedup.drop_boilerplate(docs(few), ratio=0.2), few, 0.2, 3)
    more = few + [(k, "shared\nown 0", "a") for k in range(100, 120)]
    assert same(line_dedup.drop_boilerplate(docs(more), ratio=0.2), more, 0.2, 3) and brute(more, 0.2, 3)[1][1] == "own 1"


def test_lines_without_a_word_stay(docs):
    rows = [(i, f" \n\t\n\t\x0b \r\nmenu\nown {i}", "a") for i in range(20)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs(rows)).collect()}
    assert got == {i: f" \n\t\n\t\x0b \r\nown {i}" for i in range(20)}


def test_very_long_texts(docs):
    rows = [(i, f"menu\n{chr(97 + i) * 3_000_000}\n" + f"l{i}\n" * 200_000, "a") for i in range(3)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs(rows), counts=True).collect()}
    assert all(got[i].text == t[5:] and got[i].n_dropped == 1 and got[i].n_lines == 200_003 for i, t, _ in rows)


def test_all_lines_dropped_and_counts(docs):
    rows = [(i, "menu" if i < 10 else f"menu\nbody {i}", "a") for i in range(30)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs(rows), counts=True).collect()}
    assert got[0].text == "" and (got[0].n_lines, got[0].n_dropped) == (1, 1)
    assert got[20].text == "body 20" and (got[20].n_lines, got[20].n_dropped) == (2, 1)


def test_a_shuffled_join_gives_the_same(docs, monkeypatch):
    rows = [(i, f"menu\nbody {i}", "abc"[i % 3]) for i in range(60)]
    monkeypatch.setattr(line_dedup, "BROADCAST_HOSTS", 0)
    assert same(line_dedup.drop_boilerplate(docs(rows)), rows, line_dedup.RATIO, line_dedup.MIN_PAGES)


def test_empty_table(docs):
    assert line_dedup.drop_boilerplate(docs([])).count() == 0
