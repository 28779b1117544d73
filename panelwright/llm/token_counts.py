"""Token counts from an exact length histogram.

Documents are reduced to their encoded length where they are read; only
(length, documents) pairs are shuffled.  Suffix sums over the distinct lengths
then answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._text import slices

#: Vocabulary file where neither a parameter nor the session's setting ``TOKENIZER_SETTING`` names one.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TOKENIZER_SETTING = "spark.panelwright.tokenizer"
#: Fixed value: the pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space (of the pattern's kind) in runs that the pattern's look-ahead would walk back through; they are cut out beforehand.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{500,}")


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_length(text: str, path: str = TOKENIZER, pattern: str = PATTERN) -> int:
    """Tokens of a text of any length.

    The pattern takes a run of white space but for its last character as one
    piece, or all of it at the end of the text; the last one goes with what
    follows.  So a long run is encoded as that piece, apart from the rest,
    and no token differs.
    """
    encoding = _encoding(path, pattern)
    total, at = 0, 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        total += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def encoded_lengths(texts: Sequence[str], path: str = TOKENIZER, pattern: str = PATTERN) -> list[int]:
    return [encoded_length(t, path, pattern) for t in texts]


def length_histogram(docs: DataFrame, *, text: str = "text", tokenizer: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``length long, docs long``: how many rows encode to each length.

    Every row counts, repeated ones too.  A null or empty text has length 0.
    Text that looks like a special token is ordinary text.  Texts of any length
    are encoded whole.  An empty table gives an empty histogram.  The
    vocabulary file (``tokenizer``, else the session's ``TOKENIZER_SETTING``,
    else ``TOKENIZER``) is read on the executors.
    """
    tokenizer = tokenizer or docs.sparkSession.conf.get(TOKENIZER_SETTING, TOKENIZER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.zeros(0, dtype=np.int64)
        tally: dict[int, int] = {}
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                lengths, n = np.unique(encoded_lengths(texts, tokenizer, pattern), return_counts=True)
                for length, k in zip(lengths.tolist(), n.tolist(), strict=True):
                    tally[length] = tally.get(length, 0) + k
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(tally), pa.int64()), "docs": pa.array(list(tally.values()), pa.int64())})

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "length long, docs long")
    return parts.groupBy("length").agg(F.sum("docs").alias("docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit, what a corpus cut at it holds.

    Adds ``tokens`` (of the documents of that length), ``docs_longer`` and
    ``tokens_longer`` (suffix sums over greater lengths), ``total_docs``,
    ``total_tokens``, ``truncated_tokens``, the sum of min(length, limit) over
    all documents, and ``quantile``, the share of documents that are not longer.
    The windows span the distinct lengths, whose number the longest document
    bounds (and the root of twice the total tokens), not the number of
    documents.
    """
    above = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = F.lit(0)
    h = histogram.withColumn("tokens", F.col("length") * F.col("docs"))
    h = h.withColumns({"docs_longer": F.coalesce(F.sum("docs").over(above), zero), "tokens_longer": F.coalesce(F.sum("tokens").over(above), zero), "total_docs": F.sum("docs").over(whole), "total_tokens": F.sum("tokens").over(whole)})
    h = h.withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer"))
    return h.withColumn("quantile", (F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs"))


def truncated_total(limits: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``, for any limit, from the table of ``limit_table``; 0 for an empty one."""
    row = limits.where(F.col("length") > limit).orderBy("length").limit(1).collect()
    if not row:
        first = limits.limit(1).collect()
        return first[0]["total_tokens"] if first else 0
    r = row[0]
    return r["total_tokens"] - r["tokens_longer"] - r["tokens"] + limit * (r["docs_longer"] + r["docs"])


def length_quantile(limits: DataFrame, q: float) -> int | None:
    """Smallest length that at least the share ``q`` of documents do not exceed; null for an empty table."""
    row = limits.where(F.col("total_docs") - F.col("docs_longer") >= F.lit(float(q)) * F.col("total_docs")).orderBy("length").limit(1).collect()
    return row[0]["length"] if row else None
