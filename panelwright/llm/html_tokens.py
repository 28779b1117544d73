"""Token streams of HTML pages: open elements, blocks and the nodes they stand at.

One pass, linear in the length of the page whatever it holds.  Every element
that is a block, or that its tag or attributes mark as possible boilerplate,
is a node: the hash of its parent's node and its own token (tag, id, classes
and role, numbers left out).  Text belongs to the innermost node.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import blake2b

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template iframe svg textarea title select datalist".split())
#: Of those the ones that run to the end of the page when they are not closed.
_TO_END = frozenset(("script", "style", "textarea", "title", "iframe"))
#: End tags inside one of these do not reach elements around it.
_SCOPES = frozenset("article body caption dl main menu ol table td th ul".split())
#: End tags of other elements never reach beyond one of these.
_BARRIERS = frozenset(("article", "main", "body"))
_CELLS = frozenset(("td", "th", "caption"))
_ROWS = frozenset(("tr", "tbody", "thead", "tfoot"))
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Blocks whose id tells sections of a page apart; other ids are anchors.
_NAMED = frozenset("article aside body div footer form header main nav ol section table td ul".split())

#: Tags that are evidence of boilerplate, and of the surroundings of an article.
STRONG_TAGS = frozenset("head nav footer aside form menu".split())
OUTER_TAGS = frozenset(("header",))
#: Names (whole class, id or role) that are evidence of menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
MARKED = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer form gdpr login menu nav navbar navigation newsletter notice notices promo promoted replies search sidebar signup sponsor sponsored subscribe".split())
OUTER = frozenset(("header", "masthead"))
#: Words that say where or of what kind a box is; a name of such and marked words alone is a marked name.
NEUTRAL = frozenset("area article bar block body bottom box container entry google group holder inline inner item items left link links list main outer page panel post reader right section site slot top unit user wrap wrapper".split())

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: Up to the end of a start tag; quoted values may hold the closing bracket.
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
_NAMES = re.compile(r"class|id|role", re.IGNORECASE)
_SIGNS = {"id": "#", "class": ".", "role": "@"}
_SEPARATORS = re.compile(r"[^a-z0]+")
_DIGITS = re.compile(r"\d+")
#: Longer attributes are read without being remembered.
_REMEMBERED = 400
_CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def _level(name: str, names: list[str]) -> int:
    level = 2 if name in STRONG_TAGS else 3 if name in OUTER_TAGS else 0
    for n in names:
        words = [w for w in _SEPARATORS.split(n) if w and w != "0"]
        if any(w in MARKED for w in words):
            level = 2 if all(w in MARKED or w in NEUTRAL for w in words) else level or 1
        elif any(w in OUTER for w in words):
            level = level if level == 2 else 3 if all(w in OUTER or w in NEUTRAL for w in words) else level or 1
    return level


@lru_cache(maxsize=1 << 14)
def token_of(name: str, attrs: str) -> tuple[str, int]:
    """Token of a start tag, and its evidence of boilerplate.

    0 is none, 1 a marked word within some other name, 2 a marked name or tag,
    3 the same but outside an article only.  ``html``, ``body``, ``article`` and
    ``main`` carry no names, which say what the one page is about.
    """
    shown: dict[str, str] = {}
    names: list[str] = []
    for m in _ATTR.finditer(attrs):
        key = m.group(1).lower()
        value = _DIGITS.sub("0", (m.group(2) or m.group(3) or m.group(4) or "").lower()).split()
        names += value
        if key not in shown and value and (key != "id" or name in _NAMED):
            shown[key] = _SIGNS[key] + ".".join(value)
    if name in ("html", "body"):
        return name, 0
    level = _level(name, names)
    if name in ("article", "main"):
        return f"{name}!{level}" if level else name, level
    return name + "".join(shown.get(k, "") for k in _SIGNS), level


@lru_cache(maxsize=1 << 16)
def node_of(parent: int, token: str) -> int:
    return int.from_bytes(blake2b(f"{parent} {token}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def pair_of(node: int, text: str) -> int:
    """Hash of a text at a node."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=node.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def collapse(text: str) -> str:
    """Each run of white space as one space, none at the ends."""
    return " ".join(text.split())


class Element:
    """An open element.

    ``outer`` is the block it stands in, ``scope`` and ``barrier`` the innermost
    ones that hold it.  A scope counts its open blocks, a barrier its open
    scopes, a block its open inline elements and the nodes within it.
    """

    __slots__ = ("name", "node", "block", "parent", "outer", "scope", "barrier", "open", "scopes", "inline", "seen", "article", "state")

    def __init__(self, name: str, block: bool, parent: Element | None, outer: Element | None):
        self.name, self.block, self.parent, self.outer = name, block, parent, outer
        if parent is None:
            self.node, self.article, self.state, self.scope, self.barrier = 0, False, None, self, self
        else:
            self.node, self.article, self.state, self.scope, self.barrier = parent.node, parent.article, parent.state, parent.scope, parent.barrier
        # Most elements hold nothing that needs counting.
        self.inline: dict[str, int] | None = None
        self.seen: dict[int, int] | None = None
        if parent is None or block and name in _SCOPES:
            self.scope, self.open = self, {}
            if parent is None or name in _BARRIERS:
                self.barrier, self.scopes = self, {}


#: A run of text of a block: node, state of the element, text, characters in links.
Run = tuple[int, object, str, int]


class Page:
    """Reads a page once.

    ``enter`` is told each element that is a node: its parent's state, whether
    it is inside an article, its node, evidence and tag; its result is the state of
    the element, which inner elements inherit and which the runs of text carry.
    ``blocks`` holds the runs of each block.  ``nodes`` holds for each node its
    parent, token, depth, evidence and the largest number of such siblings.

    End tags without a start tag are ignored; elements left open end with their
    parent or the page; what follows a ``<`` that never closes is text.
    """

    def __init__(self, source: str | None, enter: Callable | None = None, start: object = None):
        self.blocks: list[list[Run]] = []
        self.nodes: dict[int, list] = {}
        self._enter = enter
        self._runs: list[tuple[Element, str, bool]] = []
        self._links = 0
        self._barriers: dict[str, int] = {}
        self._root = Element("", True, None, None)
        self._root.state = start
        self._top = self._block = self._root
        self._read(source or "")
        self._flush()

    def _read(self, s: str) -> None:
        at, n, quotes, unclosed = 0, len(s), True, set()
        while at < n:
            lt = s.find("<", at)
            if lt < 0 or lt + 1 >= n:
                break
            c = s[lt + 1]
            if c == "!" and s.startswith("<!--", lt):
                self._text(s[at:lt])
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            name = _NAME.match(s, lt + 2 if c == "/" else lt + 1)
            if not name and c not in "!?/":
                self._text(s[at : lt + 1])
                at = lt + 1
                continue
            gt = -1
            if quotes and name and c != "/":
                m = _QUOTED.match(s, name.end())
                if m:
                    gt = m.end() - 1
                else:
                    # A quote that never closes: from here on quotes mean nothing, so no part is searched twice.
                    quotes = False
            if gt < 0:
                gt = s.find(">", lt)
                if gt < 0:
                    break
            if lt > at:
                self._text(s[at:lt])
            at = gt + 1
            if not name:
                continue
            tag = name.group().lower()
            if c == "/":
                self._close(tag)
            elif tag in RAW:
                if tag in unclosed:
                    continue
                end = _CLOSERS[tag].search(s, at)
                if end:
                    at = s.find(">", end.end()) + 1 or n
                elif tag in _TO_END:
                    at = n
                else:
                    unclosed.add(tag)
            else:
                self._start(tag, s[name.end() : gt])
        if at < n:
            self._text(s[at:])

    def _text(self, text: str) -> None:
        if text:
            self._runs.append((self._top, text, self._links > 0))

    def _flush(self) -> None:
        runs, self._runs = self._runs, []
        if not runs:
            return
        found: list[Run] = []
        k = 0
        while k < len(runs):
            element = runs[k][0]
            parts, links = [], 0
            while k < len(runs) and runs[k][0].node == element.node:
                text = runs[k][1]
                parts.append(entities.unescape(text) if "&" in text else text)
                if runs[k][2]:
                    links += len(text)
                k += 1
            found.append((element.node, element.state, "".join(parts), links))
        if any(not text.isspace() for _, _, text, _ in found):
            self.blocks.append(found)

    def _start(self, name: str, attrs: str) -> None:
        if name in VOID:
            if name == "hr":
                self._flush()
            elif name == "br":
                self._text(" ")
            return
        block = name in BLOCKS
        if not block:
            if name == "a":
                self._links += 1
            token, level = self._token(name, attrs) if "=" in attrs and _NAMES.search(attrs) else ("", 0)
            self._open(name, token, level, False)
            return
        self._flush()
        scope = self._top.scope
        if name != "head" and scope.open.get("head"):
            self._pop_to("head", scope)
        if scope.open.get("p") and name not in _CELLS:
            self._pop_to("p", scope)
        if name in _CELLS or name in _ROWS:
            if self._top.scope.name in _CELLS:
                self._pop(self._top.scope)
            scope = self._top.scope
            if name in _ROWS and scope.open.get("tr"):
                self._pop_to("tr", scope)
        elif name in _ITEMS:
            for item in _ITEMS[name]:
                if scope.open.get(item):
                    self._pop_to(item, scope)
        self._open(name, *self._token(name, attrs), True)

    @staticmethod
    def _token(name: str, attrs: str) -> tuple[str, int]:
        return token_of(name, attrs) if len(attrs) <= _REMEMBERED else token_of.__wrapped__(name, attrs)

    def _open(self, name: str, token: str, level: int, block: bool) -> None:
        parent = self._top
        element = Element(name, block, parent, self._block)
        if block or level:
            node = element.node = node_of(parent.node, token)
            # Equal siblings are counted within the innermost block.
            seen = self._block.seen
            if seen is None:
                seen = self._block.seen = {}
            times = seen[node] = seen.get(node, 0) + 1
            known = self.nodes.get(node)
            if known is None:
                self.nodes[node] = [parent.node, token, 1 + (self.nodes[parent.node][2] if parent.node else 0), level, 1]
            elif times > known[4]:
                known[4] = times
            if self._enter is not None:
                element.state = self._enter(parent.state, parent.article, node, level, name)
        if name in ("article", "main"):
            element.article = True
        if block:
            holder = parent.scope.open
            holder[name] = holder.get(name, 0) + 1
            if name in _BARRIERS:
                self._barriers[name] = self._barriers.get(name, 0) + 1
            elif name in _SCOPES:
                within = parent.barrier.scopes
                within[name] = within.get(name, 0) + 1
            self._block = element
        else:
            inline = self._block.inline
            if inline is None:
                inline = self._block.inline = {}
            inline[name] = inline.get(name, 0) + 1
        self._top = element

    def _close(self, name: str) -> None:
        if name not in BLOCKS:
            if self._block.inline and self._block.inline.get(name):
                while self._top.name != name:
                    self._drop_top()
                self._drop_top()
            return
        top = self._top
        if name in _BARRIERS:
            if self._barriers.get(name):
                barrier = top.barrier
                while barrier.name != name:
                    barrier = barrier.parent.barrier
                self._pop(barrier)
        elif name in _SCOPES:
            if top.barrier.scopes.get(name):
                scope = top.scope
                while scope.name != name:
                    scope = scope.parent.scope
                self._pop(scope)
        elif top.scope.open.get(name):
            self._pop_to(name, top.scope)

    def _pop_to(self, name: str, scope: Element) -> None:
        """Close elements up to the innermost open ``name`` right within a scope that holds one."""
        while not (self._top.block and self._top.name == name and self._top.parent.scope is scope):
            self._drop_top()
        self._drop_top()

    def _pop(self, element: Element) -> None:
        while self._top is not element:
            self._drop_top()
        self._drop_top()

    def _drop_top(self) -> None:
        x = self._top
        if x.block:
            self._flush()
            x.parent.scope.open[x.name] -= 1
            if x.name in _BARRIERS:
                self._barriers[x.name] -= 1
            elif x.name in _SCOPES:
                x.parent.barrier.scopes[x.name] -= 1
            self._block = x.outer
            if x.scope is x:
                # Nothing refers to itself any longer, so it is freed at once.
                x.scope = x.barrier = None
        else:
            self._block.inline[x.name] -= 1
            if x.name == "a":
                self._links -= 1
        self._top = x.parent
