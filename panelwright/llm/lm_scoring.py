"""LM scoring: whole-document log probability under a gated recurrent model.

Training words are counted first (one shuffle of words and counts); the model
starts as the unigram model.  Training documents are dealt by hash to streams,
whose number follows from the number of training tokens, and to rounds.  In
each round a replica of the model learns each stream's documents, in the order
of a hash; then the replicas and the state of their optimiser are averaged,
weighted by tokens.  A small share of the training documents is only counted:
a round after which the model predicts them worse is undone and ends the
training.  So the model depends on the documents alone, not on the files or
partitions they lie in, and a replica's share does not shrink as the corpus
grows.  Last, every document is scored where it is read; only words outside the
bounded table of frequent ones are shuffled, to meet their counts.

Words are 64-bit hashes: with v distinct words two of them share a count with a
probability of about v * v / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import gru
from panelwright.llm._storage import largest, materialize
from panelwright.llm._text import Hasher, slices, spans

#: Words with a softmax of their own, and the size of their classes.
HEAD, WIDTH = 2048, 64
#: Words whose counts every task holds; the rest meets its counts in a join.
TABLE = 1 << 18
ROUNDS = 4
#: Step length of the optimiser.
RATE = 0.004
#: Training tokens of a stream, about.
STREAM_TOKENS = 2_000_000
#: One in so many training documents is counted and judges the rounds, but is not learned.
JUDGES = 50
_SLAB = 3_000_000
#: The hash that stands for the end of a document.
END = np.uint64(0x45)
_CHUNK = 2048
#: Stands for the log probability under parameters that are no numbers any more.
_WORST = 1e18


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the rows of a slice, each row closed by ``END``, and the offsets of the rows."""
    words = spans(data, offsets)
    hashes = Hasher(data, lower=True).span(words.starts, words.ends)
    limits = words.first + np.arange(len(words.first))
    out = np.empty(limits[-1], dtype=np.uint64)
    out[limits[1:] - 1] = END
    inside = np.ones(len(out), dtype=bool)
    inside[limits[1:] - 1] = False
    out[inside] = hashes
    return out, limits


@dataclass
class Table:
    """Frequent words by falling count: open-addressed hash table to their rank."""

    hashes: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        size = 1 << max(4, int(4 * len(self.hashes)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.rank = np.full(size, -1, dtype=np.int32)
        todo = np.arange(len(self.hashes))
        slot = self.hashes & self.mask
        while len(todo):
            at = slot[todo].astype(np.int64)
            free = self.rank[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = todo[free][first]
            self.rank[slot[won].astype(np.int64)] = won
            self.keys[slot[won].astype(np.int64)] = self.hashes[won]
            todo = todo[self.rank[slot[todo].astype(np.int64)] != todo]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def find(self, x: np.ndarray) -> np.ndarray:
        """Rank of each hash, -1 where it is not in the table."""
        slot = (x & self.mask).astype(np.int64)
        out = self.rank[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != x))
        out[todo] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            rank = self.rank[slot[todo]]
            hit = (rank >= 0) & (self.keys[slot[todo]] == x[todo])
            out[todo[hit]] = rank[hit]
            todo = todo[(rank >= 0) & ~hit]
        return out


@dataclass
class Model:
    """Everything that scoring needs; bounded in size but for ``counts``, which is a table."""

    table: Table
    shape: gru.Shape
    params: dict[str, np.ndarray]
    n: int
    v: int
    counts: DataFrame

    @property
    def rare_n(self) -> int:
        return self.n - int(self.table.counts.sum())

    @property
    def rare_v(self) -> int:
        return self.v - len(self.table.counts)


def bin_of(rank: np.ndarray) -> np.ndarray:
    """Bins of the ranks from ``HEAD`` on, each twice as long as the one before; rank -1 is the last bin."""
    last = int(np.ceil(np.log2(TABLE / HEAD)))
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.floor(np.log2(np.maximum(rank, HEAD) / HEAD)).astype(np.int32)
    return np.where(rank < 0, last, np.minimum(b, last - 1))


def symbols_of(rank: np.ndarray) -> np.ndarray:
    return np.where((rank >= 0) & (rank < HEAD), rank, HEAD + bin_of(rank)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            held.append(tokens(data, offsets)[0])
            if sum(map(len, held)) >= _SLAB:
                yield flush()
    yield flush()


def _held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5 == 1


def _encode(table: Table) -> Callable:
    """Rows ``round, stream, key, text`` to ``round, stream, key, symbols``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(3)):
                hashes, limits = tokens(data, offsets)
                raw = symbols_of(table.find(hashes)).astype(np.int16).tobytes()
                rows = pa.array([raw[2 * x : 2 * y] for x, y in zip(limits[:-1], limits[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), rows], names=["round", "stream", "key", "symbols"])

    return run


def _train(shape: gru.Shape, start: gru.State, rate: float) -> Callable:
    """Rows ``stream, symbols``, all of a stream together, to the replica of each stream in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0
        trainer = gru.Trainer(start.params, shape, rate, start)

        def learn() -> None:
            nonlocal size
            if held:
                first = np.zeros(size, dtype=bool)
                first[np.cumsum([0, *(len(x) for x in held[:-1])])] = True
                trainer.learn(np.concatenate(held).astype(np.int32), first)
            held.clear()
            size = 0

        def replica() -> pa.RecordBatch:
            flat = trainer.state().flat()
            cuts = range(0, len(flat), _CHUNK)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([k // _CHUNK for k in cuts], pa.int32()), "stream": pa.array([current] * len(cuts), pa.int32()), "tokens": pa.array([trainer.tokens] * len(cuts), pa.int64()), "steps": pa.array([trainer.t] * len(cuts), pa.int64()), "values": pa.array([flat[k : k + _CHUNK] for k in cuts], pa.list_(pa.float32()))})

        for batch in batches:
            for stream, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if stream != current:
                    learn()
                    if trainer.tokens:
                        yield replica()
                    current, trainer = stream, gru.Trainer(start.params, shape, rate, start)
                held.append(np.frombuffer(row.as_buffer(), dtype=np.int16))
                size += len(held[-1])
                if size >= _SLAB:
                    learn()
        learn()
        if trainer.tokens:
            yield replica()

    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """Token-weighted sum of a chunk over streams, in their order."""
    pdf = pdf.sort_values("stream")
    weights = pdf["tokens"].to_numpy(dtype=float)
    values = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["values"]])
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "tokens": [int(weights.sum())], "steps": [int(pdf["steps"].max())], "values": [(weights[:, None] * values).sum(axis=0) / weights.sum()]})


def _judge(shape: gru.Shape, params: dict[str, np.ndarray]) -> Callable:
    """Rows ``key, symbols`` to the key and the log probability of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x.as_buffer(), dtype=np.int16) for x in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            found = gru.score_documents(params, shape, np.concatenate([*rows, np.zeros(0, dtype=np.int16)]).astype(np.int32), offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.nan_to_num(found, nan=-_WORST, neginf=-_WORST))], names=["key", "score"])

    return run


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, stream_tokens: int = STREAM_TOKENS, rate: float = RATE) -> Model:
    """Learn from the rows whose ``crc32(id as text) mod 5`` is not 1 (a null id counts as 0).

    Counts are over all of these.  Of the documents one in ``JUDGES``, by hash,
    judges the rounds; each of the others is learned in exactly one round,
    unless a round was undone and ended the training.  Repeated rows are
    learned as often as they occur.  Without training rows the model knows no
    word and gives every token probability 1, as the base score does.
    """
    spark = docs.sparkSession
    train = docs.where(~_held_out(doc_id)).select(F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("key"))
    counts = train.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "lm-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    # Words seen once stand for those not seen: they stay out of the table, so the last bin learns how often new words come.
    top = largest(counts.where("n >= 2"), "n", TABLE).toPandas().sort_values(["n", "word"], ascending=[False, True])
    table = Table(top["word"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64))
    shape = gru.Shape(HEAD, WIDTH, int(bin_of(np.array([-1]))[0]) + 1)
    n = int(total["n"] or 0)
    seen = np.bincount(symbols_of(np.arange(len(table.counts))), weights=table.counts, minlength=HEAD + shape.bins)
    seen[-1] = n - table.counts.sum() + 0.5 * (int(total["v"]) - len(table.counts) + 1)
    state = gru.State.begin(gru.initial(shape, seen))
    if n and rounds:
        state = _rounds(train, table, shape, state, rounds, max(1, -(-n // stream_tokens)), rate)
    return Model(table, shape, state.params, n, int(total["v"]), counts)


def _rounds(train: DataFrame, table: Table, shape: gru.Shape, state: gru.State, rounds: int, streams: int, rate: float) -> gru.State:
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encode(shared.value)(batches)

    part = lambda name, k: F.pmod(F.xxhash64("key", F.lit(name)), F.lit(k)).cast("int")
    dealt = train.select(F.when(part("judge", JUDGES) == 0, F.lit(-1)).otherwise(part("round", rounds)).alias("round"), part("stream", streams).alias("stream"), "key", "text")
    dealt = materialize(dealt.mapInArrow(encode, "round int, stream int, key long, symbols binary"), "lm-symbols")
    judges = dealt.where("round = -1").select("key", "symbols")

    def judged(params: dict[str, np.ndarray]) -> float:
        scored = judges.mapInArrow(_judge(shape, params), "key long, score double")
        # Rounded to be the same in whatever order and company documents are scored.
        return float(scored.agg(F.sum(F.round("score", 2).cast("decimal(28,2)")).alias("s")).collect()[0]["s"] or 0)

    best = judged(state.params)
    for k in range(rounds):
        # All of a stream in one task, in the order of the hash: what a replica learns is the same wherever the rows came from.
        rows = dealt.where(F.col("round") == k).repartitionByRange(streams, "stream").sortWithinPartitions("stream", "key").select("stream", "symbols")
        replicas = rows.mapInArrow(_train(shape, state, rate), "chunk int, stream int, tokens long, steps long, values array<float>")
        found = replicas.groupBy("chunk").applyInPandas(_average, "chunk int, tokens long, steps long, values array<double>").toPandas().sort_values("chunk")
        if not len(found):
            continue
        after = gru.State.from_flat(np.concatenate(found["values"].to_list()), int(found["steps"].max()), state.params)
        score = judged(after.params)
        if score < best:
            break
        state, best = after, score
    return state


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the smoothed unigram score in log10; ``score`` the log10
    probability of the whole text under the model.  Null and empty texts have
    one token, their end.  Texts of any length are read whole.  A null id is passed through (and is not held out);
    repeated rows score alike; an empty table gives an empty result.
    """
    shape, params = model.shape, model.params
    n, v, rare_n, rare_v = model.n, model.v, model.rare_n, model.rare_v
    base_total = np.log10(n + 0.5 * (v + 1))
    rare_total = np.log10(rare_n + 0.5 * (rare_v + 1))
    shared = docs.sparkSession.sparkContext.broadcast(model.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Table = shared.value
        symbol = symbols_of(np.arange(len(table.counts)))
        mass = np.bincount(symbol, weights=table.counts, minlength=HEAD + shape.bins)
        base = np.append(np.log10(table.counts + 0.5) - base_total, 0.0)
        # Within a bin the counts decide; head words have their own softmax.
        within = np.append(np.where(symbol < HEAD, 0.0, np.log10(table.counts / np.maximum(mass[symbol], 1))), 0.0) if len(symbol) else np.zeros(1)
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        done = 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            hashes = np.concatenate([h for _, h, _ in held])
            sizes = np.concatenate([np.diff(x) for _, _, x in held])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            rank = table.find(hashes)
            model_part = gru.score_documents(params, shape, symbols_of(rank), offsets) / np.log(10) if n else np.zeros(len(sizes))
            sums = lambda x: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.concatenate([[0.0], np.cumsum(x)]))
            known = sums(rank >= 0).astype(np.int64)
            base_part, within_part = sums(base[rank]), sums(within[rank])
            rare = np.flatnonzero(rank < 0)
            cut = np.searchsorted(rare, offsets).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(hashes[rare].view(np.int64)))
            at = 0
            for batch, _, _ in held:
                m = batch.num_rows
                pick = slice(at, at + m)
                yield pa.RecordBatch.from_arrays([pa.array(part + done + np.arange(m)), batch.column(1), batch.column(2), pa.array(sizes[pick]), pa.array(known[pick]), pa.array(base_part[pick]), pa.array(model_part[pick] + within_part[pick]), lists.slice(at, m)], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"])
                done += m
                at += m
            held.clear()

        for batch in batches:
            for a, b, data, offsets in slices(batch.column(0)):
                held.append((batch.slice(a, b - a), *tokens(data, offsets)))
                if sum(len(h) for _, h, _ in held) >= _SLAB:
                    yield from flush()
        if held:
            yield from flush()

    kind = docs.schema[doc_id].dataType.simpleString()
    selected = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"), _held_out(doc_id).alias("held_out"))
    scored = materialize(selected.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, rare array<long>"), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(model.counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    missed = rare.groupBy("row").agg(F.sum((c > 0).cast("long")).alias("k"), F.sum(F.log10(c + 0.5) - F.lit(float(base_total))).alias("b"), F.sum(F.log10(c + 0.5) - F.lit(float(rare_total))).alias("m"))
    joined = scored.drop("rare").join(missed, "row", "left")
    zero = F.lit(0.0)
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("model") + F.coalesce("m", zero)).alias("score"))
