"""Line dedup by site-relative frequency.

A line is boilerplate on a host when the share of the host's pages that contain
it exceeds a ratio.  It must stand on a few different pages for that: a page
that was merely copied many times does not turn its own text into boilerplate.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm._storage import broadcast_if_small, materialize

#: Share of a host's pages above which a line goes, and different pages it must stand on.
RATIO, MIN_PAGES = 0.005, 3
#: Rows (hosts) up to which boilerplate may be broadcast, besides the bound on its bytes.
BROADCAST_HOSTS = 1_000_000
#: Boilerplate lines of a host that share one list, on average.
_LIST = 4
_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host the hashes of its boilerplate lines: ``__host`` and ``__drop`` (array of arrays of long).

    A hash stands in the array at its remainder, so a line meets only a few.
    One row per host; it holds at most (lines per page) / ``ratio`` hashes,
    whatever the number of pages.  Copies of a page are counted and then read
    once; the counts are map-side combined per (host, line), so a hot host
    costs no more than its distinct lines.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(_lines(F.col(text)), lambda x: x.rlike(_WORD))
    pages = docs.select(F.col(host).alias("__host"), F.xxhash64(content).alias("__page"), F.array_distinct(F.transform(worded, lambda x: F.xxhash64(x))).alias("__lines"))
    pages = materialize(pages.groupBy("__host", "__page").agg(F.first("__lines").alias("__lines"), F.count(F.lit(1)).alias("__copies")), "line-pages")
    total = pages.groupBy("__host").agg(F.sum("__copies").alias("__total"))
    line = pages.select("__host", "__copies", F.explode("__lines").alias("__line")).groupBy("__host", "__line").agg(F.sum("__copies").alias("__n"), F.count(F.lit(1)).alias("__different"))
    frequent = line.where(F.col("__different") >= min_pages).join(total.withColumnRenamed("__host", "__of"), F.col("__host").eqNullSafe(F.col("__of")))
    frequent = materialize(frequent.where(F.col("__n") > F.lit(float(ratio)) * F.col("__total")).select("__host", "__line"), "line-frequent")
    lists = frequent.groupBy("__host").agg(F.ceil(F.count(F.lit(1)) / F.lit(_LIST)).cast("long").alias("__k")).withColumnRenamed("__host", "__of")
    dealt = frequent.join(lists, F.col("__host").eqNullSafe(F.col("__of"))).select("__host", F.pmod("__line", "__k").alias("__at"), "__line")
    every = lists.select(F.col("__of").alias("__host"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)).alias("__at")).withColumn("__line", F.lit(None).cast("long"))
    return dealt.unionByName(every).groupBy("__host", "__at").agg(F.collect_list("__line").alias("__some")).groupBy("__host").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__some"))), lambda x: x["__some"]).alias("__drop"))


def drop_boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; all rows, all other columns.

    Lines are separated by ``\\n`` and compared as they are, by a 64-bit hash.
    A line goes when more than ``ratio`` of its host's pages contain it and at
    least ``min_pages`` of these differ; all its occurrences go.  A line without
    a word (only blanks, tabs and the like) is never boilerplate.  So a host
    with fewer than ``min_pages`` different pages keeps all its lines.  Rows
    with a null host form a host of their own.  A null text is an empty page and
    stays null; an empty text stays empty; repeated rows are pages each; texts
    of any length are split once; an empty table stays empty.  With ``counts``,
    ``n_lines`` and ``n_dropped`` are added (0 and 0 for null).
    """
    drop = broadcast_if_small(materialize(boilerplate(docs, host=host, text=text, ratio=ratio, min_pages=min_pages), "boilerplate"), BROADCAST_HOSTS)
    joined = docs.join(drop, F.col(host).eqNullSafe(F.col("__host")), "left")
    lines, hashes = _lines(F.col(text)), lambda x: F.element_at(F.col("__drop"), (F.pmod(F.xxhash64(x), F.size("__drop")) + 1).cast("int"))
    kept = F.filter(lines, lambda x: ~F.array_contains(hashes(x), F.xxhash64(x)))
    clean = F.when(F.col("__drop").isNull() | F.col(text).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
        out += [n.alias("n_lines"), F.when(F.col("__drop").isNull() | F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_dropped")]
    return joined.select(*out)
