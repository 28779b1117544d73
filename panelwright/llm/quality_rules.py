"""Quality rules: decision lists learned by sequential covering.

Statistics of whole texts are computed where they are read.  From labelled
statistics, rules (conjunctions of thresholds) that cover bad documents are
grown by information gain and pruned on held-out rows, one after another; the
resulting ordered list is emitted as a Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm._storage import bounded_sample, broadcast_if_small, materialize
from panelwright.llm._text import IS_HEAD, IS_WORD, Hasher, mix, ngrams, per_row, slices, spans, tidy

#: Fixed values of the base contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: Labels that rules are learned from, at most; chosen by a hash of the id.
MAX_LABELLED = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines")
#: What rules may test: name to an expression over the counts, the same for columns and arrays.
FEATURES = {
    "n_words": lambda c: c["n_words"] * 1.0,
    "mean_word": lambda c: c["word_chars"] / (c["n_words"] + 1.0),
    "symbol_share": lambda c: c["n_symbols"] / (c["word_chars"] + 1.0),
    "dup_line_share": lambda c: c["n_dup_lines"] / (c["n_lines"] + 1.0),
    "repeat_share": lambda c: c["n_repeat_words"] / (c["n_words"] + 1.0),
    "upper_share": lambda c: c["n_upper"] / (c["word_chars"] + 1.0),
    "digit_share": lambda c: c["n_digits"] / (c["word_chars"] + 1.0),
    "mark_share": lambda c: c["n_marks"] / (c["word_chars"] + 1.0),
}


def _member(chars: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[np.frombuffer(chars, dtype=np.uint8)] = True
    return found


_SYMBOL, _UPPER, _DIGIT = _member(SYMBOLS), _member(bytes(range(65, 91))), _member(bytes(range(48, 58)))
_MARK = _member(b"!?.,;:\"'()[]{}-_/\\~^@+=`")


def _repeats(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often the hash at each place occurs in its row."""
    key = mix(hashes ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.ones(len(key), dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(head) - 1
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.bincount(group)[group] if len(key) else 0
    return out


def count_text(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every row of a string column; nulls count as empty."""
    parts: list[dict[str, np.ndarray]] = []
    for a, b, data, offsets in slices(column):
        words = spans(data, offsets)
        head = IS_HEAD[data]
        c = {"n_words": words.counts(), "word_chars": per_row(head & IS_WORD[data], offsets)}
        for name, member in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
            c[name] = per_row(member[data], offsets)
        hasher = Hasher(data, lower=False)

        at, gram = ngrams(hasher.span(words.starts, words.ends), words, 3)
        again = at[_repeats(words.row[at], gram) > 1]
        covered = np.zeros(len(words.starts), dtype=bool)
        for k in range(3):
            covered[again + k] = True
        c["n_repeat_words"] = per_row(covered, words.first)

        # Lines end at a newline or at the end of their row; only those with a word count.
        starts, ends = _line_spans(data, offsets)
        inside = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(IS_WORD[data], out=inside[1:])
        worded = inside[ends] > inside[starts]
        starts, ends = starts[worded], ends[worded]
        row = np.searchsorted(offsets, starts, side="right") - 1
        line = hasher.span(starts, ends)
        key = mix(line ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, first = np.unique(key, return_index=True)
        dup = np.ones(len(key), dtype=bool)
        dup[first] = False
        c["n_lines"] = np.bincount(row, minlength=b - a).astype(np.int64)
        c["n_dup_lines"] = np.bincount(row[dup], minlength=b - a).astype(np.int64)
        parts.append(c)
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in COUNTS}


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each non-empty line: from a row's start or behind a newline to the next newline or row end."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([breaks + 1, offsets[:-1]]))
    starts = starts[starts < len(data)]
    starts = starts[data[starts] != 10]
    limits = np.unique(np.concatenate([breaks, offsets[1:]]))
    return starts, limits[np.searchsorted(limits, starts, side="right")] if len(starts) else starts


def document_counts(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` columns and the counts of each row's whole text (all 0 for null or empty), with ``__text`` if wanted; texts are not shuffled."""
    keep = list(keep)
    first = 0 if with_text else 1
    names = [*(["__text"] if with_text else []), *keep, *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                counts = count_text(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[first:], *(pa.array(counts[c], pa.int64()) for c in COUNTS)], names=names)

    selected = docs.select(F.col(text).cast("string").alias("__text"), *keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in selected.select(names[: len(names) - len(COUNTS)]).schema] + [f"{c} long" for c in COUNTS])
    return selected.mapInArrow(tidy(run), schema)


def base_failed(counts: dict[str, Column] | None = None) -> Column:
    c = counts or {k: F.col(k) for k in COUNTS}
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, ">=" or "<=", threshold)`` that marks a document as bad."""

    tests: tuple[tuple[str, str, float], ...]
    covered: int = 0
    precision: float = 0.0

    def matches(self, x: pd.DataFrame) -> np.ndarray:
        hit = np.ones(len(x), dtype=bool)
        for name, sign, value in self.tests:
            hit &= (x[name] >= value).to_numpy() if sign == ">=" else (x[name] <= value).to_numpy()
        return hit

    def column(self) -> Column:
        c = {k: F.col(k) for k in COUNTS}
        found = F.lit(True)
        for name, sign, value in self.tests:
            f = FEATURES[name](c)
            found = found & ((f >= value) if sign == ">=" else (f <= value))
        return found

    def __str__(self) -> str:
        return " and ".join(f"{n} {s} {v:.6g}" for n, s, v in self.tests)


def _best_test(x: pd.DataFrame, bad: np.ndarray) -> tuple[float, tuple[str, str, float] | None]:
    """The threshold with the greatest FOIL gain over the rows given; ties go to the earlier feature."""
    p, n = int(bad.sum()), int((~bad).sum())
    base = np.log2(p / (p + n))
    best: tuple[float, tuple[str, str, float] | None] = (1e-9, None)
    for name in x.columns:
        v = x[name].to_numpy()
        order = np.argsort(v, kind="stable")
        s, b = v[order], bad[order]
        cut = np.flatnonzero(s[1:] > s[:-1])
        if not len(cut):
            continue
        low_p, low_all = np.cumsum(b)[cut], cut + 1
        middle = (s[cut] + s[cut + 1]) / 2
        for sign, cp, call in (("<=", low_p, low_all), (">=", p - low_p, p + n - low_all)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(cp > 0, cp * (np.log2(cp / call) - base), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (name, sign, float(middle[k])))
    return best


def learn_rules(x: pd.DataFrame, bad: np.ndarray, *, max_rules: int = 16, max_tests: int = 4, min_precision: float = 0.95, min_covered: int = 3) -> list[Rule]:
    """Sequential covering over feature rows ``x`` with ``bad`` flags.

    Each round splits what is left two to one, grows a conjunction on the
    larger part until it covers no good row, drops final tests while that
    raises (bad - good) / (bad + good) on the other part, and accepts the rule
    when it is precise enough over all rows left.  It stops at the first
    rule that is not, when no bad row is left, or when the list has
    ``max_rules``: what later rules would have covered is then kept.  A rule
    has at most ``max_tests`` tests.  No labels, or labels of one kind only,
    give no rules.
    """
    rules: list[Rule] = []
    left = np.arange(len(x))
    while len(rules) < max_rules and bad[left].any() and not bad[left].all():
        place = np.arange(len(left))
        grow, prune = left[place % 3 != 2], left[place % 3 == 2]
        tests: list[tuple[str, str, float]] = []
        at = grow
        while len(tests) < max_tests and bad[at].any() and not bad[at].all():
            _, test = _best_test(x.iloc[at], bad[at])
            if test is None:
                break
            tests.append(test)
            at = at[Rule((test,)).matches(x.iloc[at])]
        if not tests:
            break

        def worth(k: int, tests: list = tests, prune: np.ndarray = prune) -> float:
            hit = Rule(tuple(tests[:k])).matches(x.iloc[prune])
            good, wrong = int(bad[prune][hit].sum()), int((~bad[prune])[hit].sum())
            return (good - wrong) / (good + wrong) if good + wrong else -1.0

        k = max(range(1, len(tests) + 1), key=lambda k: (worth(k), k))
        candidate = Rule(tuple(tests[:k]))
        hit = candidate.matches(x.iloc[left])
        precision = float(bad[left][hit].mean()) if hit.any() else 0.0
        if precision < min_precision or hit.sum() < min_covered:
            break
        rules.append(Rule(candidate.tests, int(hit.sum()), precision))
        left = left[~hit]
    return rules


def label_sample(labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``__id, __label`` of at most ``max_labelled`` labels, chosen by a hash of the id; null ids and labels are left out."""
    given = labels.select(F.col(doc_id).alias("__id"), F.col(label).alias("__label")).dropna().distinct()
    return materialize(bounded_sample(given, "__id", max_labelled), "quality-labels")


def labelled_features(counts: DataFrame, sample: DataFrame, *, doc_id: str = "doc_id") -> tuple[pd.DataFrame, np.ndarray]:
    """Feature rows of the sampled documents that pass the base rules, one for each label however often its document is repeated, and whether each is bad (label 0)."""
    rows = counts.where(~base_failed()).join(broadcast_if_small(sample), F.col(doc_id) == F.col("__id")).select("__id", "__label", F.struct(*COUNTS).alias("c"))
    p = rows.groupBy("__id", "__label").agg(F.min("c").alias("c")).select("__id", "__label", "c.*").toPandas().sort_values(["__id", "__label"], ignore_index=True)
    c = {k: p[k].to_numpy(dtype=float) for k in COUNTS}
    order = np.argsort(mix(pd.util.hash_array(p["__id"].to_numpy())), kind="stable")
    x = pd.DataFrame({k: f(c) for k, f in FEATURES.items()})
    return x.iloc[order].reset_index(drop=True), p["__label"].to_numpy(dtype=float)[order] == 0


def rejected_by(rules: Sequence[Rule]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that matches, or null."""
    chain = None
    for k, rule in enumerate(rules, start=1):
        chain = F.when(rule.column(), F.lit(k)) if chain is None else chain.when(rule.column(), F.lit(k))
    return (chain.otherwise(F.lit(None)) if chain is not None else F.lit(None)).cast("int")


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list[Rule]]:
    """Counts, ``base_failed``, ``rule`` and ``kept`` of every row, and the rules.

    Null, empty and short texts fail the base rules.  Repeated rows are judged
    alike.  Rows whose id is null have no label but are judged.  Labels that
    are null or have no document are ignored; without usable labels only the
    base rules decide.  Texts of any length are counted whole.  An empty table
    gives an empty result.
    """
    counts = materialize(document_counts(docs, text=text, keep=keep or (doc_id,)), "quality-counts")
    x, bad = labelled_features(counts, label_sample(labels, doc_id=doc_id, max_labelled=max_labelled), doc_id=doc_id)
    rules = learn_rules(x, bad) if len(x) else []
    judged = counts.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rejected_by(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; the verdicts are those of ``judge``.

    The rules are learned from the sampled documents alone; one pass over the
    corpus then counts every text and applies the list as a conditional
    expression.  No text is shuffled.
    """
    sample = label_sample(labels, doc_id=doc_id, max_labelled=max_labelled)
    known = docs.join(broadcast_if_small(sample.select(F.col("__id").alias("__known")).distinct()), F.col(doc_id) == F.col("__known"), "left_semi")
    x, bad = labelled_features(document_counts(known.select(F.col(doc_id).alias("__doc"), F.col(text)), text=text, keep=("__doc",)), sample, doc_id="__doc")
    rules = learn_rules(x, bad) if len(x) else []
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    counts = document_counts(docs.select(F.col(text), F.struct(F.lit(0).alias("__none"), *others).alias("__row")), text=text, keep=("__row",), with_text=True)
    kept = counts.where(~base_failed() & rejected_by(rules).isNull())
    return kept.select(*[F.col("__text").cast(docs.schema[c].dataType).alias(c) if c == text else F.col(f"__row.`{c}`") for c in docs.columns])
