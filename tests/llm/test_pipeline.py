"""The pipeline's stages against plain versions, and its end result on the small tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def test_columns_and_order(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])
    assert [n.split()[0] for n, _ in corpus_pipeline.STAGES] == ["quality", "n-gram", "suffix-array", "mixing", "byte-level"]


def test_each_stage(spark, stages):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good, unique, cut, mixed, ids = [{r.doc_id: r for r in s.collect()} for s in stages]
    assert set(good) < set(docs)
    groups = brute(sorted((d, r.text) for d, r in good.items()), 5, 80, 100)
    assert set(unique) == {c for _, _, c in groups}
    assert set(cut) <= set(unique) and set(mixed) <= set(cut) and set(ids) == set(mixed)
    w, starts = corpus_pipeline.REPEAT_BYTES, {}
    for d, r in unique.items():
        raw = r.text.encode()
        for i in range(len(raw) - w + 1):
            starts.setdefault(hash(raw[i : i + w]), []).append((d, i))
    gone = {}
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone.setdefault(d, set()).update(range(i, i + w))
    for d, r in unique.items():
        raw = r.text.encode()
        want = bytes(b for i, b in enumerate(raw) if i not in gone.get(d, ())).decode("utf-8", "ignore")
        if d not in cut:
            assert d in gone and not want.strip(" ")
        else:
            assert cut[d].text == want and cut[d].n_chars == len(want)
    import tiktoken
    import public_tokenizers
    from gneiss.llm.byte_bpe import read_ranks

    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for d, r in ids.items():
        assert r.text == mixed[d].text and r.ids == theirs.encode_ordinary(r.text) and r.n_tokens == len(r.ids)


def test_run_gives_the_last_stage(spark, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in stages[-1].collect()}


def test_repeats_are_cut_once_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus_pipeline.repeats(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
