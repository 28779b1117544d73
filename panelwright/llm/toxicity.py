"""Toxicity by classifier chains.

Categories are predicted in order.  The model of a category is linear in the
presence of word and word-beginning features and in the log odds that the
earlier categories were given; for training, those come from models that did
not see the row (out of fold): neither it nor a copy of it served to choose
their features or to fit them.  The models of a category are fitted side by
side on the executors.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm._storage import bounded_sample, broadcast_if_small, materialize
from panelwright.llm._text import IS_WORD, Hasher, slices, spans

#: Labelled documents a chain is fitted on, at most; chosen by a hash of the id.
MAX_LABELLED = 20_000
#: Features kept for each category.
FEATURES_PER_CATEGORY = 6_000
#: Least chi-square of a feature with its category; below it the association may be chance.
MIN_CHI_SQUARE = 40.0
MIN_DOCS = 4
FOLDS = 5
#: Lengths in bytes of the word beginnings that are features.
STEMS = (5, 6, 7, 8)

_MARKS = np.frombuffer(b"!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~-", dtype=np.uint8)
_BODY = IS_WORD.copy()
_BODY[_MARKS] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (punctuation separates them too) and their beginnings, with the row of each; not distinct."""
    words = spans(data, offsets, _BODY)
    hasher = Hasher(data, lower=True)
    hashes, rows = [hasher.span(words.starts, words.ends)], [words.row]
    for size in STEMS:
        long = words.ends - words.starts > size
        starts = words.starts[long]
        hashes.append(hasher.span(starts, starts + size) ^ np.uint64(size))
        rows.append(words.row[long])
    return np.concatenate(hashes), np.concatenate(rows)


def _distinct(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]


class Vocabulary:
    """Selected feature hashes, sorted; the place of a hash is its number."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self._bits = np.zeros(1 << 20, dtype=bool)
        self._bits[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature number) pairs, distinct and ordered by row."""
        hashes, rows = features(data, offsets)
        maybe = self._bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
        hashes, rows = hashes[maybe], rows[maybe]
        if not len(hashes) or not len(self.hashes):
            return rows[:0], np.zeros(0, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        real = self.hashes[place] == hashes
        pairs = np.unique(rows[real].astype(np.int64) * len(self.hashes) + place[real])
        return pairs // len(self.hashes), pairs % len(self.hashes)


@dataclass
class Linear:
    """Logistic model over present features and dense extras."""

    weights: np.ndarray
    extra: np.ndarray
    bias: float

    def log_odds(self, row: np.ndarray, feature: np.ndarray, extra: np.ndarray, n: int) -> np.ndarray:
        z = np.bincount(row, weights=self.weights[feature], minlength=n) if len(row) else np.zeros(n)
        return z + extra @ self.extra + self.bias


def fit_linear(row: np.ndarray, feature: np.ndarray, extra: np.ndarray, y: np.ndarray, size: int, *, l2: float = 0.3, steps: int = 150, rate: float = 0.1) -> Linear:
    """L2-penalised logistic regression by full-batch Adam, from zero."""
    n = len(y)
    p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    theta = np.zeros(size + extra.shape[1] + 1)
    theta[-1] = np.log(p / (1 - p))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    penalty = np.full(len(theta), l2 / max(1, n))
    penalty[-1] = 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=theta[:size][feature], minlength=n) if len(row) else np.zeros(n)
        z = z + extra @ theta[size:-1] + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / max(1, n)
        g = np.concatenate([np.bincount(feature, weights=error[row], minlength=size) if len(row) else np.zeros(size), extra.T @ error, [error.sum()]]) + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Linear(theta[:size], theta[size:-1], float(theta[-1]))


@dataclass
class Chain:
    """Models in category order; each sees the log odds of those before it."""

    names: tuple[str, ...]
    models: list[Linear]

    def probabilities(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        odds = np.zeros((n, 0))
        for model in self.models:
            z = np.clip(model.log_odds(row, feature, odds, n), -8, 8)
            odds = np.column_stack([odds, z])
        return 1 / (1 + np.exp(-odds))


@dataclass
class Sample:
    """Encoded rows: features one row after another, how many each has, labels, folds, and which features each model may use.

    ``allowed`` tells for each category, fold and feature whether the model that
    leaves out the fold may use it (the last place is the model of all rows).
    Held in the smallest types, since every executor gets a copy.
    """

    feature: np.ndarray
    sizes: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    allowed: np.ndarray
    folds: int = FOLDS

    def fit(self, k: int, f: int, odds: np.ndarray) -> tuple[Linear, np.ndarray]:
        """Model of category ``k`` from the rows outside fold ``f``, and its log odds of those inside."""
        n, size = len(self.y), self.allowed.shape[2]
        row, feature = np.repeat(np.arange(n), self.sizes), self.feature.astype(np.int64)
        usable = self.allowed[k, f][feature]
        row, feature = row[usable], feature[usable]
        train = np.flatnonzero(self.fold != f)

        def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            inside = place[row] >= 0
            return place[row[inside]], feature[inside]

        model = fit_linear(*part(train), odds[train], self.y[train, k].astype(float), size)
        test = np.flatnonzero(self.fold == f)
        return model, np.clip(model.log_odds(*part(test), odds[test], len(test)), -8, 8)


def fit_chain(sample: Sample, names: Sequence[str], run: Callable | None = None) -> tuple[Chain, np.ndarray]:
    """A chain, and the out-of-fold log odds of every category.  ``run`` does the fits of a category: all folds and the whole."""
    run = run or (lambda k, odds: [sample.fit(k, f, odds) for f in range(sample.folds + 1)])
    odds = np.zeros((len(sample.y), 0))
    models = []
    for k in range(len(names)):
        found = run(k, odds)
        held = np.zeros(len(sample.y))
        for f in range(sample.folds):
            held[sample.fold == f] = found[f][1]
        models.append(found[sample.folds][0])
        odds = np.column_stack([odds, held])
    return Chain(tuple(names), models), odds


def on_executors(spark: SparkSession, sample: Sample) -> Callable:
    """The fits of a category as one task each; the sample is sent once."""
    shared = spark.sparkContext.broadcast(sample)

    def run(k: int, odds: np.ndarray) -> list[tuple[Linear, np.ndarray]]:
        def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield pd.DataFrame({"f": part["id"], "found": [pickle.dumps(shared.value.fit(k, int(f), odds)) for f in part["id"]]})

        rows = spark.range(0, sample.folds + 1, 1, sample.folds + 1).mapInPandas(each, "f long, found binary").collect()
        return [pickle.loads(bytes(r["found"])) for r in sorted(rows, key=lambda r: r["f"])]

    return run


def _feature_counts(names: Sequence[str]):
    """Rows ``text, fold, y0, y1, ...`` to features with their fold, rows and positive rows of each category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, *labels = (batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1 + len(names)))
            for a, b, data, offsets in slices(batch.column(0)):
                hashes, rows = _distinct(*features(data, offsets))
                of = fold[a:b][rows]
                order = np.lexsort((of, hashes))
                hashes, rows, of = hashes[order], rows[order], of[order]
                first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])])) if len(hashes) else np.zeros(0, dtype=np.int64)
                cols = [pa.array(hashes[first].view(np.int64)), pa.array(of[first]), pa.array(np.diff(np.append(first, len(hashes))))]
                for y in labels:
                    cols.append(pa.array(np.add.reduceat(y[a:b][rows], first) if len(first) else np.zeros(0, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays(cols, names=["feature", "fold", "n", *(f"y{k}" for k in range(len(names)))])

    return run


def chi_square(n: Column, y: Column, rows: float, positive: float) -> Column:
    """Of a feature on ``n`` of ``rows`` rows, ``y`` of the ``positive`` ones among them."""
    p = min(max(positive / rows if rows else 0.0, 1e-6), 1 - 1e-6)
    gap = y - n * F.lit(p)
    return F.try_divide(gap * gap, n * F.lit(p * (1 - p)) * (F.lit(1.0) - n / F.lit(float(rows + 1))))


def select_features(rows: DataFrame, names: Sequence[str], folds: int = FOLDS) -> DataFrame:
    """``feature, k, f``: the features that the model of category ``k`` without fold ``f`` may use (``f = folds``: the model of all rows), by the counts of the rows that it is fitted on.

    ``rows``: ``text, fold, __y0, ...``.  At most ``FEATURES_PER_CATEGORY`` each.
    """
    labels = [f"__y{k}" for k in range(len(names))]
    counts = rows.select("text", "fold", *labels).mapInArrow(_feature_counts(names), "feature long, fold long, n long, " + ", ".join(f"y{k} long" for k in range(len(names))))
    every = ["n", *(f"y{k}" for k in range(len(names)))]
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(folds) for c in every]
    counts = counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in every], *sums).where(F.col("n") >= MIN_DOCS)
    sizes = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"y{k}") for k, c in enumerate(labels)]).collect()}
    total = {c: sum(r[c] for r in sizes.values()) for c in every}
    scores = []
    for k in range(len(names)):
        for f in range(folds + 1):
            less = lambda c, f=f: F.col(c) - F.col(f"{c}_{f}") if f < folds else F.col(c)
            out = lambda c, f=f: total[c] - (sizes[f][c] if f in sizes else 0)
            score = F.when(less("n") >= MIN_DOCS, chi_square(less("n"), less(f"y{k}"), out("n"), out(f"y{k}")))
            scores.append(F.struct(F.lit(k).alias("k"), F.lit(f).alias("f"), score.alias("score")))
    found = counts.select("feature", F.explode(F.array(*scores)).alias("s")).select("feature", "s.*").where(F.col("score") >= MIN_CHI_SQUARE)
    best = Window.partitionBy("k", "f").orderBy(F.desc("score"), "feature")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FEATURES_PER_CATEGORY).select("feature", "k", "f")


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, Column]], *, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> tuple[Chain, Vocabulary]:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of the id.

    ``categories``: name and condition on ``labels``, in chain order; labels for
    which a condition is null are ignored.  An id that repeats is one document,
    with the text that comes first.  Copies of a text share a fold.  Without
    usable labels every probability is one half.
    """
    spark, names = docs.sparkSession, [name for name, _ in categories]
    own = [f"__y{k}" for k in range(len(names))]
    given = labels.select(F.col(doc_id).alias("__id"), *[c.cast("int").alias(y) for y, (_, c) in zip(own, categories, strict=True)]).dropna().groupBy("__id").agg(F.max(F.struct(*own)).alias("y")).select("__id", "y.*")
    chosen = materialize(bounded_sample(given, "__id", max_labelled), "chain-labels")
    rows = docs.join(broadcast_if_small(chosen), F.col(doc_id) == F.col("__id")).select("__id", *own, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.groupBy("__id", *own).agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    rows = materialize(rows, "chain-rows")
    picked = select_features(rows, names).toPandas()
    vocabulary = Vocabulary(np.unique(picked["feature"].to_numpy(dtype=np.int64).view(np.uint64)))
    size = len(vocabulary.hashes)
    allowed = np.zeros((len(names), FOLDS + 1, size), dtype=bool)
    allowed[picked["k"].to_numpy(dtype=np.int64), picked["f"].to_numpy(dtype=np.int64), np.searchsorted(vocabulary.hashes, picked["feature"].to_numpy(dtype=np.int64).view(np.uint64))] = True

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(0)):
                row, feature = vocabulary.encode(data, offsets)
                cut = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(1, batch.num_columns)), lists], names=[*batch.schema.names[1:], "f"])

    schema = "id string, fold int, " + ", ".join(f"{y} int" for y in own) + ", f array<int>"
    x: pd.DataFrame = rows.select("text", F.col("__id").cast("string").alias("id"), "fold", *own).mapInArrow(encode, schema).toPandas().sort_values("id", kind="stable", ignore_index=True)
    if not len(x):
        return Chain(tuple(names), [Linear(np.zeros(size), np.zeros(k), 0.0) for k in range(len(names))]), vocabulary
    lists = [np.asarray(f, dtype=np.int64) for f in x["f"]]
    kind = np.uint16 if size <= 1 << 16 else np.int32
    sample = Sample(np.concatenate(lists).astype(kind), np.array([len(f) for f in lists], dtype=np.int32), x[own].to_numpy(dtype=np.int8), x["fold"].to_numpy(dtype=np.int8), allowed)
    return fit_chain(sample, names, on_executors(spark, sample))[0], vocabulary


def score(docs: DataFrame, chain: Chain, vocabulary: Vocabulary, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``p_<category>`` for every row, from its whole text.

    Null and empty texts have no features and get the models' bias; repeated
    rows score alike; a null id is passed through; texts of any length are read
    whole; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                row, feature = vocabulary.encode(data, offsets)
                p = chain.probabilities(row, feature, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["doc_id", *(f"p_{n}" for n in chain.names)])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"p_{n} double" for n in chain.names)
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, schema)
