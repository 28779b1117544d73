import itertools
import random
import time
from collections import Counter

import pytest

from panelwright.llm import html_extract as H
from panelwright.llm import html_tokens as T


def page(body, nav="Home"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x";</script></head><body><nav><a href="/">{nav}</a></nav><!-- <p>no</p> --><div class="ad">Buy</div>{body}<footer>&copy; me</footer></body></html>'


def wrapper(pages):
    out = H.Wrapper()
    for p in pages:
        out = H.align(out, H.page_wrapper(T.Page(p)))
    return out


def by_host(pages):
    return H.frozen(H.hints(wrapper(pages)))


def texts(spark, sources, host="t.example", partitions=3):
    rows = [(k, f"http://{host}/{k}", s) for k, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)
    return {r.page_id: r.text for r in H.main_text(df).collect()}


def test_article_only_and_references_decoded():
    got = H.extract(page('<article><header><h1>Big  &amp;\nbold</h1></header><p><b>One &lt;two&gt;<br><p>Th&eacute; <i>end</i>.<aside>side</aside><form>f</form><div class="comments"><p>first!</p></div></article><p>outside</p>'))
    assert got == "Big & bold\n\nOne <two>\n\nThé end."


def test_lists_tables_and_unclosed_tags():
    assert H.extract("<main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><p>tail") == "a\n\nb\n\nc\n\nd\n\ntail"


def test_inline_elements_make_no_blocks_and_may_be_adverts():
    assert H.extract('<p>Hello <span class="x"><span>dear</span> old</span> world') == "Hello dear old world"
    assert H.extract('<article><p>Hello <span class="ad"><span>Buy</span> now</span> world</p></article>') == "Hello world"


@pytest.mark.parametrize("name", ["post comments-open", "notice-period", "search-results", "notice", "comments"])
def test_a_marked_name_does_not_empty_a_page(name):
    assert H.extract(page(f'<article class="{name}"><h1>Title</h1><p>The text of the page</p></article>')) == "Title\n\nThe text of the page"


def test_names_are_evidence_only():
    levels = {"comments": 2, "post-comments": 2, "ad-container": 2, "comments-open": 1, "notice-period": 1, "story": 0, "masthead": 3, "reloads": 0}
    assert {n: T.token_of("div", f'class="{n}"')[1] for n in levels} == levels
    # A form around the whole page is no form of the page.
    assert H.extract("<form><nav>menu</nav><div><h1>Title</h1><p>All of the text, and some more</p></div></form>") == "Title\n\nAll of the text, and some more"


def test_the_wrapper_and_not_the_names_finds_the_main_text(monkeypatch):
    pages = [page(f"<article><h1>Title {k}</h1><p>Body {k} of its own, long enough</p></article>", nav=f"Home {k}") for k in range(6)]
    want = [H.extract(p, by_host(pages)) for p in pages]
    monkeypatch.setattr(T, "MARKED", frozenset())
    monkeypatch.setattr(T, "STRONG_TAGS", frozenset())
    T.token_of.cache_clear()
    try:
        assert [H.extract(p, by_host(pages)) for p in pages] == want and want[2] == "Title 2\n\nBody 2 of its own, long enough"
    finally:
        T.token_of.cache_clear()


def test_without_article_the_wrapper_decides():
    pages = [page(f'<div class="box"><p>Story {k} text that differs</p><p>more {k}</p></div><div class="legal"><p>All rights reserved here</p></div>') for k in range(5)]
    w = wrapper(pages)
    assert w.nodes[H.hints(w)["content"]].token == "div.box" and len(H.template_of(w)) == 4
    assert H.extract(pages[3], by_host(pages)) == "Story 3 text that differs\n\nmore 3"
    assert H.extract(pages[3]).startswith("Story 3 text that differs\n\nmore 3")


def test_alignment_gives_slots_options_and_repeats():
    w = wrapper([f"<div>{x}</div>" for x in ("<p>one</p><p>two</p><h2>same</h2>", "<p>three</p><h2>same</h2><ul><li>x</li></ul>")])
    assert H.expression(w) == "(div (h2 #) (p #)+ (ul (li #))?)"
    w = wrapper([f"<div><h2>same</h2><p>{k}</p></div>" for k in range(3)])
    assert H.expression(w).startswith("(div (h2 '") and H.expression(w).endswith(") (p #))")


def brute_nodes(pages):
    """Pages, most siblings and pages with text of every path, from a literal walk with lists of open elements."""
    pages_of, most, texts_of = Counter(), Counter(), Counter()
    for p in pages:
        siblings, seen = Counter(), set()
        stack = [((), 0)]
        born = itertools.count(1)
        for piece in p:
            if piece.startswith("</"):
                stack.pop()
            elif piece.startswith("<"):
                path = (*stack[-1][0], piece[1:-1])
                siblings[stack[-1][1], path] += 1
                stack.append((path, next(born)))
            else:
                seen.add(stack[-1][0])
        for path in {path for _, path in siblings}:
            pages_of[path] += 1
            most[path] = max(most[path], max(n for (_, q), n in siblings.items() if q == path))
        texts_of.update(seen)
    return {path: (pages_of[path], most[path], texts_of[path]) for path in pages_of}


def random_page(rng):
    def part(depth):
        out = []
        for _ in range(rng.randint(0, 3)):
            tag = rng.choice(["div", "section", "blockquote"])
            out += [f"<{tag}>", *(part(depth - 1) if depth and rng.random() < 0.7 else [rng.choice(["same", str(rng.random())])]), f"</{tag}>"]
        return out

    return part(3)


def test_wrappers_equal_a_literal_count_in_any_order(spark):
    rng = random.Random(4)
    pieces = [random_page(rng) for _ in range(12)]
    pages = ["".join(p) for p in pieces]
    w = wrapper(pages)

    def path(n):
        return (*path(w.nodes[n].parent), w.nodes[n].token) if n else ()

    assert {path(n): (x.pages, x.most, x.texts) for n, x in w.nodes.items() if n} == brute_nodes(pieces)
    for _ in range(3):
        rng.shuffle(pages)
        assert wrapper(pages) == w and H.expression(wrapper(pages)) == H.expression(w)
    # The tables of a host hold the same, for distinct pages.
    once = wrapper(sorted(set(pages)))
    df = spark.createDataFrame([(k, "http://w.example/", p) for k, p in enumerate(pages + pages[:4])], "page_id long, url string, html string").repartition(5)
    nodes, template = H.host_wrappers(df)
    assert {r.node: (r.parent, r.token, r.pages, r.most, r.texts, r.chars, r.links) for r in nodes.collect()} == {n: (x.parent, x.token, x.pages, x.most, x.texts, x.chars, x.links) for n, x in once.nodes.items()}
    assert {r.pair: (r.node, r.n, r["size"]) for r in template.collect()} == H.template_of(once)


def test_rows(spark):
    html = page("<article><p>text</p></article>")
    rows = [(1, "http://A.example/x", html), (2, None, html), (None, "notaurl", None), (3, "http://a.example", ""), (3, "http://a.example", "<"), (4, "http://a.example", "<p>" * 3000 + "deep"), (5, "http://u:p@b.example:80/?q", "<article><p>" + "y " * 60000)]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, host string, hint string")
    got = {(r.page_id, r.url): r for r in H.main_text(df).collect()}
    assert len(H.main_text(df).collect()) == len(rows)
    assert got[1, "http://A.example/x"].text == got[2, None].text == "text" and got[None, "notaurl"].text == ""
    assert got[4, "http://a.example"].text == "deep" and got[5, rows[-1][1]].n_chars == 2 * 60000 - 1
    assert H.main_text(df.limit(0)).count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"http://h{k % 3}.example/{k}", page(f"<div><p>{k} own</p></div>")) for k in range(30)], "page_id long, url string, html string")
    want = sorted(H.main_text(df).collect())
    monkeypatch.setattr(H, "_HINT_BYTES", 1)
    assert sorted(H.main_text(df).collect()) == want


def test_template_text_goes_inside_an_article_too(spark):
    pages = [page(f"<article><h1>Title {k}</h1><p>Body {k} of its own</p><p>more {k}</p><p>Pass this on to a friend</p></article>") for k in range(6)]
    assert texts(spark, pages)[4] == "Title 4\n\nBody 4 of its own\n\nmore 4"
    assert H.extract(pages[4]).endswith("Pass this on to a friend")


def test_an_article_stays_whole_and_a_heading_outside_the_content_element_stays(spark):
    pages = [page(f'<article><h1>Title {k}</h1><p>Lead {k}</p><div class="body"><p>{f"Long {k} text " * 9}</p></div></article>') for k in range(6)]
    assert texts(spark, pages)[2] == "Title 2\n\nLead 2\n\n" + T.collapse("Long 2 text " * 9)
    pages = [page(f'<div><h1>Title {k}</h1><div class="body"><p>{f"Long {k} text " * 9}</p></div><div class="x"><p>See {k}</p></div></div>') for k in range(6)]
    assert texts(spark, pages)[2] == "Title 2\n\n" + T.collapse("Long 2 text " * 9)


def test_a_page_without_the_content_element_of_its_host_is_its_own_wrapper(spark):
    pages = [page(f"<article><p>{f'Body {k} of its own ' * 5}</p><p>Pass this on</p></article>") for k in range(8)]
    odd = page('<div class="a"><p>Pass this on</p></div><div class="story"><p>' + "Another layout altogether " * 9 + "</p></div>")
    assert texts(spark, [*pages, odd])[8] == T.collapse("Another layout altogether " * 9)


def test_long_deep_and_rare_template_text_goes(spark):
    legal = "We keep some data on your device. " * 12
    deep = "<div>" * 60 + "<p>Deep line</p>" + "</div>" * 60
    rare = "<blockquote><p>Shop closed today</p></blockquote>"
    pages = [page(f"<div><p>Story {k} as told</p><p>more {k}</p><section><p>{legal}</p></section>{deep}{rare if k % 10 == 0 else ''}</div>") for k in range(40)]
    got = texts(spark, pages, partitions=8)
    assert got[10] == "Story 10 as told\n\nmore 10" and got[11] == "Story 11 as told\n\nmore 11"
    assert texts(spark, pages, partitions=2) == got


def test_siblings_and_copies_of_one_page_are_no_template(spark):
    one = page("<div><ul><li>x</li><li>x</li><li>x</li></ul><p>tail</p></div>")
    assert not H.template_of(wrapper([one]))
    assert texts(spark, [one])[0] == "x\n\nx\n\nx\n\ntail"
    odd = page("<div><h2>Odd head</h2><h3>Odd words</h3><p>Odd main text</p></div>")
    pages = [odd] * 4 + [page(f"<div><p>Story {k}</p></div>") for k in range(8)]
    assert texts(spark, pages)[0] == "Odd head\n\nOdd words\n\nOdd main text"


@pytest.mark.parametrize("source, n", [("<a " * 700_000, 2_099_999), ("<a x='\"><b y=\">" * 100_000, 0), ("<div>" * 100_000 + "</x></ul>" * 100_000, 0), ("<b>" * 100_000 + "<div></div>" * 50_000 + "</i>" * 100_000, 0), ("<ul><article>" + "<table>" * 60_000 + "</ul>" * 100_000, 0), ("<svg><script " * 200_000, 0), (" " * 10_000_000, 0), ("x" * 10_000_000, 10_000_000), ("<" * 1_000_000, 1_000_000)])
def test_long_pages_take_linear_time(source, n):
    began = time.monotonic()
    assert len(H.extract(source)) == n
    assert time.monotonic() - began < 40
