import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from panelwright.llm import _storage
from panelwright.llm import decontamination as D


def test_stages_take_effect_and_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frames, columns = [docs], docs.columns
    for name, stage in P.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir).cache())
        if name != P.STAGES[-1][0]:
            assert frames[-1].columns == columns
    quality, lines, joined, clean, mix = [{r.doc_id: r for r in f.collect()} for f in frames[1:]]
    assert set(mix) == set(clean) <= set(joined) <= set(lines) == set(quality)
    items = [D.normalize(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in D.normalize(r.text) for r in clean.values() for i in items if i)
    assert {k for k in joined if any(i in D.normalize(joined[k].text) for i in items)} <= set(joined) - set(clean)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in clean.values())
    assert abs(sum(r.taken for r in mix.values()) - 1.5 * words) <= len({r.source for r in clean.values()})
    assert all(r.n_chars == len(r.text) for r in lines.values())


def test_run_equals_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(P.run(spark, sf_dir).collect()) == sorted(docs.collect())


def test_a_run_leaves_one_stage(spark, sf_dir):
    folder = _storage._application_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    mix = P.run(spark, sf_dir)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert {x for x in left if x.startswith("stage-")} == {"stage-decontamination"} and all(x.startswith(("stage-", "mix-")) for x in left)
    assert mix.count() > 0


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Session.conf

    with pytest.raises(RuntimeError, match="shares"):
        _storage.shared_dir(Session)


def test_every_operator_is_registered():
    numbers = {m[1] for q in entry.queries() if (m := re.match(r"op(\d+)_", q))}
    assert numbers == {str(k) for k in range(1, 11)} and entry.queries()["pipeline"] is P.run


def test_lines_on_a_small_share_of_a_large_source_go(spark, sf_dir, docs):
    rows = [(k, f"own {k}\nfew" if k % 33 == 0 else f"own {k}", "large") for k in range(400)]
    got = {r.doc_id: r.text for r in P.drop_boilerplate_lines(spark, docs(rows), sf_dir).collect()}
    assert got == {k: f"own {k}" for k in range(400)}


def test_small_sources_lose_their_boilerplate_too(spark, sf_dir, docs):
    rows = [(10 * n + k, f"own {n} {k}\nmenu", f"source of {n}") for n in (2, 3, 9) for k in range(n)]
    got = {r.doc_id: r.text for r in P.drop_boilerplate_lines(spark, docs(rows), sf_dir).collect()}
    assert got == {i: t if s == "source of 2" else t.split("\n")[0] for i, t, s in rows}
