"""N-gram Jaccard join by the size-aware heavy-light method.

Documents become sets of word shingles.  All sets agree on one order of the
shingles: frequent ones last, otherwise by hash.  Two sets within the threshold
must share ``k`` shingles among the first ``n - required(n) + k`` of each.

* Light sets (few shingles) enumerate the subsets of size two of that prefix
  (k = 2); light pairs meet on a common subset.
* Heavy sets scan inverted lists: they post the shingles of the prefix for
  k = 1 and meet every set, light ones of comparable size included, on a list.

The boundary between light and heavy minimises the number of subsets to
enumerate plus the postings to scan, from the histogram of set sizes.  Pairs
that pass the length and position filters are verified on the whole sets.

Within a list the links wanted are those that connect components.  So every
member is first compared with the hub of its list, the member that most lists
share (among edited copies of a text that is the one nearest to the original).
Lists whose members are then still in different components are scanned.

Before whole sets are fetched, a pair must pass a bound on its sketches: bit k
of a sketch is the parity of the shingles whose hash ends in k, so the bits in
which two sketches differ are a lower bound of the shingles in which the sets
do.  The bound never rejects a link.  Copies of one set are one node throughout.

No list meets in one task.  Those of shingles counted often are dealt by set to
parts; a long list that has to be scanned is cut into blocks by size and hash,
and pairs of blocks of comparable size are compared, each pair in a task.

Sets are told apart by 128 bits: should two share the 64 of their id, which the
second half shows, all ids are drawn anew.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm._storage import broadcast_if_small, largest, materialize
from panelwright.llm._text import Hasher, mix, ngrams, slices, spans, tidy
from panelwright.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 75
#: Sizes considered for light sets.
LIGHT_MAX = 64
#: Frequent shingles moved to the end of the order.  Any choice of them gives the same links; it only affects how long lists get.
FREQUENT_MAX, FREQUENT_MIN = 200_000, 8
_COUNT_SLAB = 4_000_000
#: Members up to which lists are scanned together.
SHORT = 48
#: Postings of a frequent shingle that stay together, about, and members of a block of a list.
LONG, BLOCK = 4096, 512
_BROADCAST_IDS = 1_000_000
#: Draws of set ids after which equal ids of different sets cannot be chance.
_DRAWS = 4


def required(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of ``n`` shingles with any set it links with."""
    return -(-PERCENT * n // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, and the offsets of the rows in them.

    A row with fewer words than ``width`` has its whole word sequence as its one
    shingle; a row without words has none.
    """
    words = spans(data, offsets)
    hashes = Hasher(data, lower=True).span(words.starts, words.ends)
    counts = words.counts()
    grams, rows = [], []
    for n in range(1, width + 1):
        at, gram = ngrams(hashes, words, n)
        row = words.row[at]
        if n < width:
            gram, row = gram[counts[row] == n], row[counts[row] == n]
        grams.append(gram)
        rows.append(row)
    gram, row = np.concatenate(grams), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    gram, row = gram[order], row[order]
    limits = np.searchsorted(row, np.arange(len(offsets)))
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        gram[a:b].sort()
    keep = np.ones(len(gram), dtype=bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[keep], np.searchsorted(row[keep], np.arange(len(offsets)))


def set_ids(grams: np.ndarray, limits: np.ndarray, draw: int = 0) -> np.ndarray:
    """A 64-bit id of each set; other draws give independent ids."""
    total = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(mix(grams ^ mix(np.array([0x5851F42D4C957F2D + draw], dtype=np.uint64))), out=total[1:])
    return mix(total[limits[1:]] - total[limits[:-1]] + np.diff(limits).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of ``n`` shingles: the power of two from ``2 n`` on."""
    return 1 << max(6, (2 * n - 1).bit_length())


def sketch(grams: np.ndarray) -> bytes:
    bits = sketch_bits(len(grams))
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(words: np.ndarray) -> np.ndarray:
    """Sketches (rows of 64-bit words) at half their bits."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most shingles in which linked sets of sizes ``a`` and ``b`` can differ."""
    return a + b - 2 * -(-PERCENT * (a + b) // (100 + PERCENT))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _describe(draw: int):
    """Rows ``kind 0``: id, set id, size, a second id, and for the first of a set its sketch.  Rows ``kind 1``: shingle, sets of this task that hold it, for shingles that several hold."""
    names = ["kind", "a", "b", "c", "other", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            gram, n = gram[n >= 4], n[n >= 4]
            held.clear()
            none = pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), dtype=np.int8)), _long(gram), _long(n), none, none, pa.nulls(len(n), pa.binary())], names=names)

        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                grams, limits = shingle_sets(data, offsets)
                sizes = np.diff(limits)
                ids = set_ids(grams, limits, draw)
                fresh = np.zeros(b - a, dtype=bool)
                for k, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[k] = True
                held.append(grams[np.repeat(fresh, sizes)])
                drawn = [sketch(grams[limits[k] : limits[k + 1]]) if fresh[k] and sizes[k] else None for k in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, dtype=np.int8)), batch.column(0).slice(a, b - a), pa.array(ids, mask=sizes == 0), _long(sizes), pa.array(set_ids(grams, limits, ~draw & 0xFFFF)), pa.array(drawn, pa.binary())], names=names)
                if sum(map(len, held)) >= _COUNT_SLAB:
                    yield frequent()
        yield frequent()

    return run


def boundary(sizes: dict[int, int], scan: float) -> int:
    """The largest light size: least subsets enumerated plus ``scan`` times the postings of heavy sets and of the light sets they can link with.

    ``sizes``: number of distinct sets of each size up to ``LIGHT_MAX``.
    """

    def cost(x: int) -> float:
        total = 0.0
        for n, k in sizes.items():
            if 2 <= n <= x:
                total += k * comb(n - required(n) + 2, 2)
            if n > x or n >= required(x + 1):
                total += k * scan * (n - required(n) + 1)
        return total

    return min(range(1, LIGHT_MAX + 1), key=cost)


def _postings(light: int, frequent: np.ndarray, times: np.ndarray, draw: int):
    """``key, sid, n, place, part`` of every set; ``part`` is -1 but for keys that are counted more than ``LONG`` times.  ``times``: counts of the ``frequent`` shingles."""
    bits = np.zeros(1 << 22, dtype=bool)
    bits[(frequent & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def counted(gram: np.ndarray) -> np.ndarray:
        """Counts of frequent shingles, 0 for others."""
        out = np.zeros(len(gram), dtype=np.int64)
        at = np.flatnonzero(bits[(gram & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(frequent, gram[at]), len(frequent) - 1)
            out[at] = np.where(frequent[place] == gram[at], times[place], 0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                grams, limits = shingle_sets(data, offsets)
                sizes, ids = np.diff(limits), set_ids(grams, limits, draw)
                fresh = np.zeros(len(sizes), dtype=bool)
                for k, x in enumerate(ids.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[k] = True
                row = np.repeat(np.arange(len(sizes)), sizes)
                often = counted(grams)
                late = often > 0
                before = np.concatenate([[0], np.cumsum(~late)])
                early = before[limits[1:]] - before[limits[:-1]]
                rank = before[:-1] - before[limits[:-1]][row]
                rank = np.where(late, early[row] + np.arange(len(grams)) - limits[:-1][row] - rank, rank)

                prefix = np.where(fresh & (sizes >= required(light + 1)) & (sizes > 1), sizes - required(sizes) + 1, 0)
                take = rank < prefix[row]
                keys, whose, place, length = [grams[take]], [row[take]], [rank[take]], [often[take]]
                for k in np.flatnonzero(fresh & (sizes > 1) & (sizes <= light)):
                    a, b = limits[k], limits[k + 1]
                    chosen = rank[a:b] < sizes[k] - required(int(sizes[k])) + 2
                    first, known = grams[a:b][chosen], often[a:b][chosen]
                    i, j = np.triu_indices(len(first), 1)
                    # The lower hash first: the same pair gives the same key in every set.
                    keys.append(mix(np.minimum(first[i], first[j]) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(first[i], first[j])))
                    whose.append(np.full(len(i), k))
                    place.append(np.zeros(len(i), dtype=np.int64))
                    length.append(np.minimum(known[i], known[j]))
                key, who, at = np.concatenate(keys), np.concatenate(whose), np.concatenate(place)
                parts = -(-np.concatenate(length) // LONG)
                sid = ids[who]
                part = np.where(parts > 1, (mix(sid.view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), -1)
                yield pa.RecordBatch.from_arrays([_long(key), pa.array(sid), pa.array(sizes[who].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32))], names=["key", "sid", "n", "place", "part"])

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of rows sorted by their first column, cut only between its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column(0)[batch.num_rows - 1].as_py()
        if held[0].column(0)[0].as_py() == last:
            continue
        whole = pa.Table.from_batches(held)
        end = int(np.searchsorted(whole.column(0).to_numpy(), last))
        yield whole.slice(0, end)
        held = whole.slice(end).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _need(n0: np.ndarray, n: np.ndarray) -> np.ndarray:
    return -(-PERCENT * (n0 + n) // (100 + PERCENT))


def partnered(key: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Which members of lists have a partner there (of another root, where roots are known) within the length and position filters; in lists above ``SHORT`` all count."""
    mark = np.zeros(len(key), dtype=bool)
    for d in range(1, SHORT + 1):
        i = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else np.zeros(0, dtype=np.int64)
        if not len(i):
            break
        j = i + d
        if d == SHORT:
            mark |= np.isin(key, key[i])
            break
        good = (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= _need(n[i], n[j]))
        if root is not None:
            good &= root[i] != root[j]
        mark[i[good]] = True
        mark[j[good]] = True
    return mark


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by key and set: each set once a key, and of those the ones that have a possible partner in their list.  Of a list in parts all are kept."""
    names = ["key", "sid", "n", "place"]
    for whole in _whole_keys(batches):
        x = {c: whole.column(k).to_numpy().astype(np.int64) for k, c in enumerate([*names, "part"])}
        keep = np.ones(len(x["key"]), dtype=bool)
        keep[1:] = (x["key"][1:] != x["key"][:-1]) | (x["sid"][1:] != x["sid"][:-1])
        x = {c: v[keep] for c, v in x.items()}
        cut = x["part"] >= 0
        keep = cut | partnered(x["key"], x["n"], x["place"])
        yield pa.RecordBatch.from_arrays([pa.array(x[c][keep]) for c in names], names=names)


def _open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``key, sid, n, place, root`` sorted by key those that have a possible partner of another root."""
    for whole in _whole_keys(batches):
        good = partnered(*(whole.column(k).to_numpy() for k in (0, 2, 3, 4)))
        yield from whole.filter(pa.array(good)).combine_chunks().to_batches()


def _possible(n0: str, place0: str, n: str, place: str):
    """Length and position filters; at the first common shingle of a link both hold."""
    need = F.ceil(F.lit(PERCENT / 100.0) / F.lit(1 + PERCENT / 100.0) * (F.col(n0) + F.col(n)) - F.lit(1e-9))
    return (F.lit(100) * F.least(n0, n) >= F.lit(PERCENT) * F.greatest(n0, n)) & (F.least(F.col(n0) - F.col(place0), F.col(n) - F.col(place)) >= need)


def _sets(draw: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                grams, limits = shingle_sets(data, offsets)
                raw = grams.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(grams, limits, draw)), pa.array([raw[8 * a : 8 * b] for a, b in zip(limits[:-1], limits[1:], strict=True)], pa.binary())], names=["sid", "grams"])

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            place = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[place] == small).sum())
            good.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs ``a, b, n of a, n of b, sketch of a, sketch of b`` those whose sketches allow a link."""
    for batch in batches:
        n = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
        limit = allowed(*n)
        good = []
        for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64)[None, :] for v in (x, y))
            while x.shape[1] > y.shape[1]:
                x = fold(x)
            while y.shape[1] > x.shape[1]:
                y = fold(y)
            good.append(int(np.bitwise_count(x ^ y).sum()) <= limit[k])
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def scan_list(sid: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, side: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of one list that are in different components and pass the length, position and sketch bounds.

    Members are taken in order of size; each looks back only at those large
    enough, whose sketches are compared in one go.  Of a pair of blocks, sides
    1 and 2, only members of different sides are compared.
    """
    order = np.argsort(n, kind="stable")
    sid, n, place, root, side = sid[order], n[order], place[order], root[order], side[order]
    width = np.array([sketch_bits(int(x)) // 64 for x in n])
    by_width = {int(w): np.stack([np.frombuffer(sketches[order[k]], dtype=np.uint64) for k in np.flatnonzero(width == w)]) for w in np.unique(width)}
    first = {w: int(np.searchsorted(width, w)) for w in by_width}
    left, right = [], []
    low = np.searchsorted(n, required(n))
    for k in range(1, len(n)):
        for w, words in by_width.items():
            a, b = max(int(low[k]), first[w]), min(k, first[w] + len(words))
            if a >= b:
                continue
            own = by_width[int(width[k])][k - first[int(width[k])]][None, :]
            while own.shape[1] > w:
                own = fold(own)
            need = _need(n[a:b], n[k])
            good = (root[a:b] != root[k]) & ((side[a:b] != side[k]) | (side[k] == 0)) & (np.minimum(n[a:b] - place[a:b], n[k] - place[k]) >= need)
            good[good] = np.bitwise_count(words[a - first[w] : b - first[w]][good] ^ own).sum(axis=1) <= allowed(n[a:b], n[k])[good]
            hit = np.flatnonzero(good) + a
            left.append(sid[hit])
            right.append(np.full(len(hit), sid[k]))
    if not left:
        return sid[:0], sid[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def scan_short(key: np.ndarray, sid: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for many lists of at most ``SHORT`` members at once: members are compared with the d-th after them for each d."""
    left, right = [], []
    for d in range(1, SHORT):
        i = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else np.zeros(0, dtype=np.int64)
        if not len(i):
            break
        j = i + d
        good = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        good &= np.minimum(n[i] - place[i], n[j] - place[j]) >= _need(n[i], n[j])
        left.append(i[good])
        right.append(j[good])
    if not left:
        return sid[:0], sid[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    pair = np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], axis=1)
    _, once = np.unique(pair, axis=0, return_index=True) if len(pair) else (None, np.zeros(0, dtype=np.int64))
    pair, i, j = pair[once], i[once], j[once]
    limit = allowed(n[i], n[j])
    width = lambda k: np.array([len(sketches[x]) // 8 for x in k], dtype=np.int64)
    wi, wj = width(i), width(j)
    good = np.zeros(len(i), dtype=bool)
    for a, b in {(int(x), int(y)) for x, y in zip(wi, wj, strict=True)}:
        at = np.flatnonzero((wi == a) & (wj == b))
        x, y = (np.frombuffer(b"".join(sketches[k] for k in side[at]), dtype=np.uint64).reshape(len(at), w) for side, w in ((i, a), (j, b)))
        while x.shape[1] > y.shape[1]:
            x = fold(x)
        while y.shape[1] > x.shape[1]:
            y = fold(y)
        good[at] = np.bitwise_count(x ^ y).sum(axis=1) <= limit[at]
    return pair[good, 0], pair[good, 1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, sid, n, place, root, side, sketch`` sorted by key to candidate pairs, each at most once a batch of lists."""
    for whole in _whole_keys(batches):
        key = whole.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        cols = [whole.column(k).to_numpy() for k in range(1, 6)]
        raw = whole.column(6).to_pylist()
        # Blocks are scanned by themselves, whatever is left of them.
        long = np.flatnonzero((np.diff(cuts) > SHORT) | (cols[4][cuts[:-1]] > 0))
        found = [scan_list(*(c[cuts[k] : cuts[k + 1]] for c in cols), raw[cuts[k] : cuts[k + 1]]) for k in long]
        short = np.flatnonzero(~np.repeat(np.isin(np.arange(len(cuts) - 1), long), np.diff(cuts)))
        found.append(scan_short(key[short], *(c[short] for c in cols[:4]), [raw[k] for k in short]))
        pairs = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])


def _blocks(members: DataFrame) -> DataFrame:
    """Members of long lists (``key, k, sid, n, place, root``) to the pairs of blocks that may hold links: the pair as ``key``, and the ``side`` of the member.

    A block holds members of one size class of a list, dealt by hash so that it
    has about ``BLOCK`` of them at most.  Sizes of linked sets differ by less
    than a class, so a block meets those of its own class and of the next.
    """
    blocks = F.ceil(F.col("k") / F.lit(BLOCK))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + F.lit(1e-9))
    own = F.pmod(F.xxhash64("sid", F.lit("block")), blocks)
    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    same = F.transform(every, lambda h: F.struct(F.col("__c").alias("c1"), F.least(F.col("__h"), h).alias("h1"), F.col("__c").alias("c2"), F.greatest(F.col("__h"), h).alias("h2"), F.when(F.col("__h") == h, 0).when(F.col("__h") < h, 1).otherwise(2).alias("side")))
    up = F.transform(every, lambda h: F.struct(F.col("__c").alias("c1"), F.col("__h").alias("h1"), (F.col("__c") + 1).alias("c2"), h.alias("h2"), F.lit(1).alias("side")))
    down = F.transform(every, lambda h: F.struct((F.col("__c") - 1).alias("c1"), h.alias("h1"), F.col("__c").alias("c2"), F.col("__h").alias("h2"), F.lit(2).alias("side")))
    dealt = members.withColumns({"__c": size.cast("long"), "__h": own}).withColumn("u", F.explode(F.concat(same, up, down)))
    return dealt.select(F.xxhash64("key", "u.c1", "u.h1", "u.c2", "u.h2").alias("key"), "sid", "n", "place", "root", F.col("u.side").cast("long").alias("side"))


def _verify(docs: DataFrame, by_set: DataFrame, pairs: DataFrame, draw: int) -> DataFrame:
    """The pairs ``a, b`` of set ids whose sets reach the threshold.  Sets are built anew from the text of one document each."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = materialize(nodes.join(by_set.select("sid", "doc"), "sid").select(F.col("doc").alias("__doc")).distinct(), "join-wanted")
    text = docs.join(broadcast_if_small(wanted, _BROADCAST_IDS), F.col("doc_id") == F.col("__doc"), "left_semi").select("text")
    sets = text.mapInArrow(tidy(_sets(draw)), "sid long, grams binary").groupBy("sid").agg(F.first("grams").alias("grams"))
    left = pairs.join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(tidy(_linked), "a long, b long"), "join-links")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Words are lower-cased in A-Z.  A document's set holds its distinct five-word
    shingles; a shorter one has its whole word sequence.  Documents link at 75 %
    Jaccard; ``component_id`` is the smallest id reachable.  Null, empty and
    wordless texts have no shingles, link with nothing and are their own
    component.  Copies and repeated rows share a component.  A row whose id is
    null is not linked and has a null component.  Ids are whole numbers; other
    columns are ignored.  Texts of any length are read whole.  An empty table
    gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    for draw in range(_DRAWS):
        described = materialize(docs.mapInArrow(tidy(_describe(draw)), "kind byte, a long, b long, c long, other long, sketch binary"), "join-sets")
        rows = described.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sid"), F.col("c").alias("n_shingles"), "other", "sketch")
        known = rows.where("doc_id is not null and n_shingles > 0")
        by_set = materialize(known.groupBy("sid").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), (F.min("other") != F.max("other")).alias("mixed")), "join-distinct")
        if by_set.where("mixed").isEmpty():
            break
    else:
        raise RuntimeError(f"different sets share an id in each of {_DRAWS} draws")
    by_set = by_set.drop("mixed")

    counted = described.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= FREQUENT_MIN)
    counted = largest(materialize(counted, "join-frequent"), "n", FREQUENT_MAX).toPandas()
    frequent = counted["a"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(frequent)
    frequent, times = frequent[order], counted["n"].to_numpy(dtype=np.int64)[order]
    few = by_set.groupBy(F.least("n", F.lit(LIGHT_MAX + 1)).alias("size")).agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total")).collect()
    total = sum(r["total"] for r in few)
    scan = 1.0 + 8.0 * float(counted["n"].sum()) / max(1, total)
    light = boundary({r["size"]: r["sets"] for r in few if r["size"] <= LIGHT_MAX}, scan)

    post = _postings(light, frequent, times, draw)
    postings = docs.where("doc_id is not null").select("text").mapInArrow(tidy(post), "key long, sid long, n int, place int, part int")
    listed = postings.repartition("key", "part").sortWithinPartitions("key", "part", "sid")
    lists = materialize(listed.mapInArrow(tidy(_lists), "key long, sid long, n long, place long"), "join-lists")

    shared = lists.groupBy("sid").agg(F.count(F.lit(1)).alias("lists"))
    hubs = lists.join(shared, "sid").groupBy("key").agg(F.max(F.struct("lists", "sid", "n", "place")).alias("h"))
    hubs = materialize(hubs.select("key", F.col("h.sid").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.place").alias("hub_place")), "join-hubs")
    near = lists.join(hubs, "key").where((F.col("sid") != F.col("hub")) & _possible("hub_n", "hub_place", "n", "place"))
    pairs = near.select(F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b")).distinct()
    side = lambda c: by_set.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    drawn = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    pairs = materialize(drawn.mapInArrow(tidy(_near), "a long, b long"), "join-near")
    links = _verify(docs, by_set, pairs, draw)
    roots = components(links)

    hung = lists.join(broadcast_if_small(roots, _BROADCAST_IDS), F.col("sid") == F.col("node"), "left").select("key", "sid", "n", "place", F.coalesce("root", "sid").alias("root"))
    digests = [F.bit_xor(F.xxhash64(F.lit(name), "sid", "place")).alias(name) for name in ("x", "y")]
    mixed = hung.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k"), *digests).where("lo <> hi")
    # Lists with the same members at the same places (by 128 bits) say the same; one of them is enough.
    open_lists = materialize(mixed.groupBy("k", "x", "y", "lo", "hi").agg(F.min("key").alias("key")).select("key", "k"), "join-open")
    fields = "key long, sid long, n long, place long, root long"
    # Where the open lists are few, members are picked in place and no list meets by key before it is cut.
    few, many = (broadcast_if_small(open_lists.where(c)) for c in (F.col("k") <= BLOCK, F.col("k") > BLOCK))
    short = hung.join(few, "key").select("key", "sid", "n", "place", "root").repartition("key").sortWithinPartitions("key")
    members = short.mapInArrow(tidy(_open_members), fields).withColumn("side", F.lit(0).cast("long"))
    members = members.unionByName(_blocks(hung.join(many, "key").select("key", "k", "sid", "n", "place", "root")))
    members = members.join(by_set.select("sid", "sketch"), "sid").select("key", "sid", "n", "place", "root", "side", "sketch")
    rest = members.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_scan), "a long, b long").distinct()
    rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), "join-rest")
    if not rest.isEmpty():
        more = _verify(docs, by_set, rest, draw)
        if not more.isEmpty():
            roots = components(links.unionByName(more))

    rooted = by_set.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "doc", F.coalesce("root", "sid").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("doc").alias("component_id")), "root").select(F.col("sid").alias("__sid"), "component_id")
    linked = known.join(named, F.col("sid") == F.col("__sid")).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id, and all its columns.

    Rows whose id is null stay.  Rows that share an id share its fate; of rows
    with the same id and text one stays.
    """
    found = materialize(near_duplicates(docs, doc_id=doc_id, text=text), "join-result")
    drop = materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__drop")).distinct(), "join-drop")
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")), "join-again")
    kept = docs.join(broadcast_if_small(drop, _BROADCAST_IDS), F.col(doc_id) == F.col("__drop"), "left_anti")
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again, _BROADCAST_IDS)
    once = kept.join(again, F.col(doc_id) == F.col("__again"), "left_anti")
    return once.unionByName(kept.join(again, F.col(doc_id) == F.col("__again"), "left_semi").dropDuplicates([doc_id, text]))
