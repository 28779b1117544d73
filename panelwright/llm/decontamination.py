"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs with at most ``k`` edits leaves at least one of ``k + 1``
pieces untouched.  All pieces of all items are searched at once in every
document; where one hits, the item is compared with the text around it by
Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelwright.llm._text import tidy

#: Edits allowed per character of an item.
MAX_ERROR = 0.06
#: Characters of items that a task searches for at a time; it goes over its documents slab by slab, block by block.
BLOCK_CHARS, SLAB_BYTES = 8_000_000, 64_000_000


def normalize(text: str | None) -> str:
    """Lower case, each run of white space one blank, none at the ends."""
    return " ".join((text or "").lower().split())


def budget(length: int, max_error: float = MAX_ERROR) -> int:
    """Edits allowed in an item of ``length`` characters: below 1 / ``max_error`` none."""
    return int(length * max_error)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``item`` cut into ``k + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def edit_distance_within(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and where the first such substring ends."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, start=1):
        eq = masks.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(zero | plus))
        down = plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(zero | up))
        minus = up & zero
        if score < best:
            best, end = score, j
            if not best:
                break
    return best, end


class Matcher:
    """All items of a block, ready for search."""

    def __init__(self, items: list[tuple[object, str]], max_error: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), max_error)) for i, t in items if t]
        # For each piece the items that hold it, with its first and last offset there.
        found: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
        for at, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                first, last = found[piece].get(at, (offset, offset))
                found[piece][at] = (min(first, offset), max(last, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), [(at, first, last) for at, (first, last) in where.items()]))
        if found:
            self.automaton.make_automaton()
        self.empty = not found
        self._widths = [max(2 * k + 1, len(t)) for _, t, k in self.items]

    def search(self, text: str | None) -> list[tuple[object, int, int]]:
        """``(item, distance, end)`` for each item within its budget; the end is that of its first best occurrence in the normalised text.

        Hits only mark stretches of the text in which an occurrence may begin,
        as long as the item each, so what is held is bounded by the text.
        """
        if self.empty or not text:
            return []
        text = normalize(text)
        stretches: dict[int, set[int]] = defaultdict(set)
        for last, (size, where) in self.automaton.iter(text):
            begin = last + 1 - size
            for at, low, high in where:
                width = self._widths[at]
                marked = stretches[at]
                for s in range((begin - high) // width, (begin - low) // width + 1):
                    marked.add(s)
        out = []
        for at, marked in stretches.items():
            item, pattern, k = self.items[at]
            best = None
            for a, b in _regions(sorted(marked), self._widths[at]):
                lo = max(0, a - k)
                distance, end = edit_distance_within(pattern, text[lo : b + len(pattern) + k])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, lo + end)
            if best:
                out.append((item, *best))
        return out


def _regions(marked: list[int], width: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of adjacent stretches."""
    a = b = None
    for s in marked:
        if b is None or s > b + 1:
            if b is not None:
                yield a * width, (b + 1) * width
            a = s
        b = s
    if b is not None:
        yield a * width, (b + 1) * width


@lru_cache(maxsize=2)
def _matcher(key: str, max_error: float, items: _Items) -> Matcher:
    return Matcher(items.value, max_error)


class _Items:
    """A broadcast block; equal to any other, since the key tells blocks apart."""

    def __init__(self, shared: Broadcast):
        self._shared = shared

    @property
    def value(self) -> list[tuple[object, str]]:
        return self._shared.value

    def __eq__(self, other: object) -> bool:
        return True

    def __hash__(self) -> int:
        return 0


def _blocks(items: DataFrame, item_id: str, text: str) -> list[tuple[str, Broadcast]]:
    """Items in blocks of about ``BLOCK_CHARS``, normalised and broadcast one by one; those without text match nothing."""
    spark = items.sparkSession
    given = items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    size = given.agg(F.sum(F.length("t"))).collect()[0][0] or 0
    n = 1 + int(size // BLOCK_CHARS)
    out = []
    for b in range(n):
        part = given.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b).orderBy("t", "i").collect()
        block = [(r["i"], x) for r in part if (x := normalize(r["t"]))]
        if block:
            out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(block)))
    return out


def _searched(batches: Iterator[pa.RecordBatch], at: int, blocks: list[tuple[str, Broadcast]], max_error: float) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Each batch with, for each of its rows, the items its text contains: id to least distance and end."""
    held: list[tuple[pa.RecordBatch, list[dict]]] = []

    def flush() -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        for key, shared in blocks:
            search = _matcher(key, max_error, _Items(shared)).search
            for batch, found in held:
                for k, value in enumerate(batch.column(at)):
                    for item, distance, end in search(value.as_py()):
                        found[k][item] = min(found[k].get(item, (distance, end)), (distance, end))
        yield from held
        held.clear()

    for batch in batches:
        held.append((batch, [{} for _ in range(batch.num_rows)]))
        if len(blocks) < 2 or sum(b.nbytes for b, _ in held) >= SLAB_BYTES:
            yield from flush()
    yield from flush()


def matches(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_error: float = MAX_ERROR) -> DataFrame:
    """``doc_id, item_id, distance, end``: every item that a document contains within the item's error budget.

    One row per row of ``docs`` and item id, with the least distance.  Null or
    empty texts contain nothing; ids of both sides may be of any type or null
    and are passed through; repeated rows are matched alike; of items that
    share an id (or have none) the best is reported.  Texts of any length are
    searched whole.  Empty tables give an empty result.  The items go to the
    executors in broadcast blocks; the documents are read once and not shuffled.
    """
    blocks = _blocks(items, item_id, item_text)
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    own = items.select(F.col(item_id).alias("item_id")).schema
    id_kind = to_arrow_type(own["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _searched(batches, 1, blocks, max_error):
            rows = [(k, item, *hit) for k, x in enumerate(found) for item, hit in sorted(x.items(), key=repr)]
            at, ids, distance, end = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, id_kind), pa.array(distance, pa.int32()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "distance", "end"])

    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(tidy(run), f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, end long")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_error: float = MAX_ERROR) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; null and empty texts contain none, and items without an id count like any other."""
    at, blocks = docs.columns.index(text), _blocks(items, item_id, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _searched(batches, at, blocks, max_error):
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema) if blocks else docs
