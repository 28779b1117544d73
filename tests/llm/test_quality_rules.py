import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from panelwright.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


TEXTS = [None, "", " \n\t", "a", "a b c a b c", "é ñ x y 中文", "x\nx\n\nx \n", "\n\nq\n\nq", "#*$ %&|<> a", "a a a a a", "b\x0bc\x0cd\re\nf", "long " * 3000, "A a A a A a", "tail\n", "\x85 　 z z z"]


def test_counts_match_brute_force():
    got = Q.count_text(pa.array(TEXTS, pa.string()))
    for i, t in enumerate(TEXTS):
        assert tuple(int(got[c][i]) for c in Q.COUNTS[:5]) == brute(t), repr(t)


def test_counts_across_slices(monkeypatch):
    from panelwright.llm import _text

    whole = Q.count_text(pa.array(TEXTS * 3, pa.string()))
    monkeypatch.setattr(_text.slices, "__defaults__", (16,))
    cut = Q.count_text(pa.array(TEXTS * 3, pa.string()))
    assert all((whole[c] == cut[c]).all() for c in Q.COUNTS)


@pytest.mark.parametrize("name", ["sf0.001"])
def test_counts_on_documents(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: tuple(r[c] for c in Q.COUNTS[:5]) for r in Q.document_counts(docs).collect()}
    assert got == want


def test_learned_rules_find_the_planted_ones():
    r = np.random.default_rng(1)
    x = pd.DataFrame({k: r.random(600) for k in Q.FEATURES})
    bad = ((x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["mean_word"] < 0.5))).to_numpy()
    rules = Q.learn_rules(x, bad)
    hit = np.any([rule.matches(x) for rule in rules], axis=0)
    assert (hit == bad).mean() > 0.97 and (hit & ~bad).sum() <= 5


def test_no_rules_without_both_labels():
    x = pd.DataFrame({k: np.arange(9.0) for k in Q.FEATURES})
    assert Q.learn_rules(x, np.zeros(9, dtype=bool)) == [] and Q.learn_rules(x, np.ones(9, dtype=bool)) == []


def test_judge_and_keep_agree(spark, docs, prose):
    rows = [(i, prose(i, 80) if i % 2 else prose(i, 80).upper() + " ###" * 20, "s") for i in range(120)]
    rows += [(200, None, None), (201, "", "s"), (202, "few words", "s"), (203, "x y z " * 40, "s"), (None, prose(7, 80), "s"), (1, prose(1, 80), "s")]
    table = docs(rows, extra=("n_words", "kept", "quality"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 0, 0), (7777, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    judged, rules = Q.judge(table.drop("n_words", "kept", "quality"), labels)
    assert rules
    verdict = {(r.doc_id, r.n_words): r.kept for r in judged.collect()}
    assert not any(verdict[k, n] for k, n in verdict if k in (200, 201, 202, 203))
    assert verdict[None, 80] and all(v == (k % 2 == 1) for (k, n), v in verdict.items() if k is not None and k < 120)
    kept = Q.keep_good(table, labels)
    assert kept.columns == table.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(k if k is not None else -1 for (k, _, _), v in zip(rows, [verdict[k, len(WORD.findall(t or ""))] for k, t, _ in rows], strict=True) if v)


def test_the_list_is_an_ordered_spark_conditional(spark, docs, prose):
    from pyspark.sql import functions as F

    rules = [Q.Rule((("n_words", ">=", 90.0),)), Q.Rule((("n_words", ">=", 70.0), ("upper_share", "<=", 0.5)))]
    counts = Q.document_counts(docs([(i, prose(i, 50 + i), "s") for i in range(60)]))
    got = {r.doc_id: r.rule for r in counts.withColumn("rule", Q.rejected_by(rules)).collect()}
    assert got == {i: 1 if i >= 40 else 2 if i >= 20 else None for i in range(60)}
    assert counts.select(Q.rejected_by([]).alias("r")).where("r is not null").count() == 0


def test_one_document_that_repeats_is_one_example(spark, docs, prose):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    table = docs([(i % 20, prose(i % 20, 60), "s") for i in range(400)])
    x, bad = Q.labelled_features(Q.document_counts(table), Q.label_sample(labels))
    assert len(x) == 20 and bad.sum() == 10


def test_very_long_texts(docs):
    got = {r.doc_id: r for r in Q.document_counts(docs([(1, " " * 10_000_000, "s"), (2, "x" * 10_000_000, "s"), (3, "ab \n" * 2_000_000, "s"), (4, "#" * 3_000_000 + " é", "s")])).collect()}
    assert (got[1].n_words, got[2].word_chars, got[3].n_words, got[3].n_dup_lines, got[3].n_repeat_words) == (0, 10_000_000, 2_000_000, 1_999_999, 2_000_000)
    assert (got[4].n_symbols, got[4].word_chars, got[4].n_words) == (3_000_000, 3_000_001, 2)


def test_without_labels_only_base_rules(spark, docs, prose):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged, rules = Q.judge(docs([(1, prose(1, 60), "s"), (2, "a", "s")]), labels)
    assert rules == [] and {r.doc_id: r.kept for r in judged.collect()} == {1: True, 2: False}
    assert Q.judge(docs([]), labels)[0].count() == 0
