"""Every operator and stage on tables with nulls, empty texts, repeated rows, no rows, and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import byte_bpe, html_text, jaccard_join, kneser_ney, lattice_dedup, log_bilinear, mixing, suffix_dedup, url_cascade, voronoi_topk

#: Names that operators use inside or give to what they return.
CLASHES = (
    "id row rows key keys own_id own_key text_key stay_id stay_key copies n p v0 m0 w f s t c word words code host path rule verdict probability sampled n_tokens topic mix_source "
    "_id _key _0 _1 _n _hit _keys _html cell shell block group distance vector node label_key component component_id kept whole before less runs first last held_out score gain found hit ids decoded value margin"
).split()
SENTENCE = "one two three four five six seven eight nine ten and so on it goes until there is enough of it to be cut. "


def with_clashes(df):
    own = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in own])


def documents(spark):
    rows = [(1, SENTENCE * 5, "en", "a", 9), (2, SENTENCE * 5, "en", "a", 9), (2, SENTENCE * 5, "en", "a", 9), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "some words of no id", "fr", "b", 3), (None, None, None, None, None), (5, "Zeile | mit 12 é", "de", "c", 4)]
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def labels(spark):
    return with_clashes(spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, None, 0), (None, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int"))


def pages(spark):
    rows = [(1, "http://A.example.com/en/x", "<p>one two</p>"), (1, "http://A.example.com/en/x", "<p>one two</p>"), (2, None, None), (None, "", ""), (3, "://", "<nav>x</nav>")]
    return with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))


def embeddings(spark):
    rows = [(0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (1, [1.0, 0.5], 0), (2, [1.0, 0.51], 0), (3, None, None), (None, [1.0, 0.5], 0), (4, [], 0), (100, [0.2, None], 0)]
    return with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))


def mixture(docs):
    return mixing.mixed(docs, {"source": F.col("source"), "lang": F.col("lang")}, F.coalesce(F.length("text"), F.lit(0)))


OPERATORS = {
    "op1": (documents, suffix_dedup.remove_repeats, 8),
    "op1 cut": (documents, lambda d: suffix_dedup.without_repeats(d, window=50), 8),
    "op2": (embeddings, lambda d: voronoi_topk.top_inner(d, F.col("vec_id") % 100 == 0), 2),
    "op3": (documents, byte_bpe.encoded, 8),
    "op4": (documents, lambda d: jaccard_join.jaccard_groups(d, k=3, num=90, den=100), 8),
    "op4 kept": (documents, jaccard_join.deduplicated, 6),
    "op5": (embeddings, lattice_dedup.near_vectors, 8),
    "op6": (documents, mixture, 8),
    "op7": (pages, lambda d: url_cascade.judged(d, [("block", "example.com", "/en/")]), 5),
    "op8": (documents, lambda d: kneser_ney.classified(d, labels(d.sparkSession)), 8),
    "op9": (documents, log_bilinear.scored, 8),
    "op10": (pages, html_text.extracted, 5),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    table, run, n = OPERATORS[name]
    df = table(spark)
    out = run(df)
    rows = out.collect()
    assert len(rows) == n and len(set(out.columns)) == len(out.columns)
    empty = run(df.limit(0))
    assert empty.columns == out.columns and empty.count() == 0


def test_results_of_the_cases(spark):
    docs = documents(spark)
    groups = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in OPERATORS["op4"][1](docs).collect())
    assert [g[2] for g in groups] == [-1, -1, 1, 1, 1, 3, 4, 5] and [g[1] for g in groups][-3:-1] == [0, 0]
    cut = {(r.doc_id, r.text) for r in OPERATORS["op1 cut"][1](docs).collect()}
    assert (1, "") in cut and (3, None) in cut and (4, "") in cut and (None, "some words of no id") in cut
    mixed = mixture(docs).collect()
    assert all(r.probability is not None and r.sampled is not None for r in mixed)
    judged = {r.url: (r.host, r.path, r.rule, r.verdict) for r in OPERATORS["op7"][1](pages(spark)).collect()}
    assert judged == {"http://A.example.com/en/x": ("a.example.com", "/en/x", "example.com/en/", "block"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "://": ("", "", None, "allow")}


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, tmp_path, at):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark)
    _, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    assert len(rows) <= 8 and (at == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns)
    if at < len(corpus_pipeline.STAGES) - 1:
        assert all(r[c] == "x" for r in rows for c in CLASHES if c in docs.columns)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
