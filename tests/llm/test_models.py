import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import kneser_ney, log_bilinear, mixing
from gneiss.llm.hashing import Lookup


def docs_rows(seed, n=200):
    rnd = random.Random(seed)
    common = ["the", "of", "und", "la", "a", "in"]
    made = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(1, 60)):
            words.append(rnd.choice(common))
            if rnd.random() < 0.6:
                words.append("".join(rnd.choice(["an", "er", "tho", "ing", "Re", "é"]) for _ in range(rnd.randint(1, 3))))
        text = " ".join(words)
        made.append((i, text if i % 9 else "$$ %% " * 30, "en" if i % 3 else None, f"src{i % 4}", 7))
    return made + [(n, None, "en", "src0", 0), (n + 1, "", "xx", None, 0), (None, "the of", "en", "src1", 0), (3, made[3][1], "de", "src2", 0)]


SCHEMA = "doc_id long, text string, lang string, source string, p int"


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64))
    table = Lookup(keys[::2], np.arange(len(keys[::2])))
    value, hit = table(keys, -1)
    assert hit[::2].all() and not hit[1::2].any() and (value[::2] == np.arange(len(keys[::2]))).all() and (value[1::2] == -1).all()
    assert not Lookup(keys[:0], np.empty(0))(keys)[1].any()


def brute_scores(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t, *_ in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted((-1 if r[0] is None else r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for r, t, h in zip(rows, tokens, held))


@pytest.mark.parametrize("frequent,single,groups", [(1 << 18, 510, 16), (40, 16, 3), (40, 8, 2), (3, 2, 1)])
def test_scores_against_brute_force(spark, frequent, single, groups):
    rows = docs_rows(1)
    got = log_bilinear.scored(spark.createDataFrame(rows, SCHEMA), n_single=single, n_groups=groups, n_frequent=frequent, rounds=1).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_scores(rows)
    if frequent > 100:
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("frequent,single", [(1 << 18, 510), (30, 8)])
def test_probabilities_of_all_words_add_up_to_one(spark, frequent, single):
    rows = docs_rows(1)
    words = {w for i, t, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10 for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())}
    held = (i for i in range(10_000, 10**9) if zlib.crc32(str(i).encode()) % 10 == 0)
    asked = ["", "neverseen", *sorted(words)]
    texts = [(next(held), w, None, None, 0) for w in asked]
    got = {r.doc_id: r.score for r in log_bilinear.scored(spark.createDataFrame(rows + texts, SCHEMA), n_single=single, n_frequent=frequent, rounds=0).collect()}
    end = got[texts[0][0]]
    # Without training, tokens do not depend on those before them.
    assert 10**end + sum(10 ** (got[i] - end) for i, *_ in texts[1:]) == pytest.approx(1, abs=1e-4)


def test_model_beats_word_shares_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet", "/root/testdata/sf0.01/documents.parquet")
    per_token = []
    for rounds in (0, 1, 4):
        got = log_bilinear.scored(docs, rounds=rounds).groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).collect()
        per_token.append({r.held_out: (r.s, r.b) for r in got})
    for held in (False, True):
        assert per_token[0][held][0] < per_token[1][held][0] < per_token[2][held][0]
        assert per_token[2][held][0] > per_token[2][held][1] + 0.08
    # What training adds, beside what the unseen word's part does.
    assert per_token[2][True][0] > per_token[0][True][0] + 0.08


def test_scores_without_training_text(spark):
    assert log_bilinear.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = log_bilinear.scored(spark.createDataFrame([(only, "a b", "en", "s", 1)], SCHEMA)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.base_score) < 1e-9 and math.isfinite(r.score)


def test_classes_are_normalised_and_learn():
    rnd = np.random.default_rng(2)
    k = 512
    one, two = rnd.integers(2, 40, 20000), rnd.integers(2, 40, 20000)
    w = np.where(rnd.random(20000) < 0.8, (one + 1) % 40, rnd.integers(2, 40, 20000))
    w[w < 2] = 2
    codes = (two * k + one) * k + w
    share = np.full(k, 0.5)
    np.add.at(share, w, 1)
    share /= share.sum()
    model = log_bilinear.Model(share)
    before = model.log_probability(codes, model.normalisers()).mean()
    for _ in range(5):
        model.train(codes, rnd, 0.1)
    z = model.normalisers()
    after = model.log_probability(codes, z).mean()
    assert after > before + 0.5 and after == pytest.approx(model.log_probability(codes).mean(), abs=1e-4)
    every = (5 * k + 7) * k + np.array([i for i in range(k) if i != log_bilinear.START])
    assert abs(np.exp(model.log_probability(every, z).astype(np.float64)).sum() - 1) < 1e-3
    assert (model.with_parameters(model.flat()).flat() == model.flat()).all()


def test_kneser_ney_is_normalised(spark):
    rows = [("en", r[1]) for r in docs_rows(4, 60) if r[1]] + [("de", "abcabcabd")]
    models = kneser_ney.load(*kneser_ney.fit(spark.createDataFrame(rows, "lang string, text string")))
    assert set(models) == {"en", "de"}
    model = models["en"]
    symbols = model.p[1].keys[model.p[1].keys != np.uint64(0xFFFFFFFFFFFFFFFF)]
    for context in ("the ", "f th", "zzzz", "\x02\x02\x02\x02", "q the"[:4], "ing "):
        head = 0
        for ch in context:
            head = (head << kneser_ney.BITS) | ord(ch)
        total = (10 ** model.log10((np.uint64(head) << np.uint64(kneser_ney.BITS)) | symbols)).sum()
        unseen = 10 ** model.log10(np.array([(head << kneser_ney.BITS) | 4000], dtype=np.uint64))[0]
        assert abs(total + unseen - 1) < 1e-4, context


def test_classifier(spark):
    rows = docs_rows(5, 600)
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(600) if i % 2] + [(1, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classified(df, labels).collect()
    assert len(got) == len(rows)
    bad = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 9 == 0]
    good = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 9 and r.lang != "de"]
    assert not any(r.kept for r in bad) and np.mean([r.kept for r in good]) > 0.95
    assert all(r.kept and r.perplexity is None for r in got if r.lang == "xx")
    assert all(r.kept for r in kneser_ney.classified(df, labels.limit(0)).collect())
    assert kneser_ney.classified(df.limit(0), labels).count() == 0


def test_symbols_are_distinct():
    points = [*range(4, 0x3200), *range(0x4DF0, 0x4F00), 0xFFFF, 0x1F600, 0x1F601, 0x10FFFF]
    code, bounds = kneser_ney.codes([chr(c) for c in points])
    assert len({tuple(code[a:b]) for a, b in zip(bounds[:-1], bounds[1:])}) == len(points)
    texts = ["ab", "", "漢字a", "é😀", "a"]
    code, bounds = kneser_ney.codes(texts)
    assert np.diff(bounds).tolist() == [3, 1, 6, 4, 2] and bounds[-1] == len(code)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert (kneser_ney.codes([t])[0] == code[a:b]).all()


def test_classifier_of_chinese(spark):
    rnd = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    words = ["".join(rnd.sample(letters, 2)) for _ in range(80)]
    rows = []
    for i in range(600):
        t = [c for _ in range(rnd.randint(40, 60)) for c in rnd.choice(words)]
        if i % 9 == 0:
            rnd.shuffle(t)
        rows.append((i, "".join(t), "zh"))
    labels = spark.createDataFrame([(i, int(i % 9 != 0), 0) for i in range(600) if i % 2], "doc_id long, quality int, toxic int")
    got = kneser_ney.classified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    assert len(got) == 600 and not any(r.kept for r in got if r.doc_id % 9 == 0)
    assert np.mean([r.kept for r in got if r.doc_id % 9]) > 0.95


def test_mixing(spark):
    df = spark.createDataFrame(docs_rows(6, 3000), SCHEMA)
    names = mixing.topics(df, F.col("text"), 3)
    assert len(names) == 3
    plain = df
    df = mixing.described(plain, F.col("text"), names).select("row.*", F.col("n_tokens").alias("own_tokens"), F.col("topic").alias("own_topic"))
    assert df.columns == [*plain.columns, "own_tokens", "own_topic"]
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("own_topic")}
    out = mixing.mixed(df, margins, F.col("own_tokens"))
    rows = out.collect()
    assert out.columns == [*df.columns, "mix_source", "mix_lang", "mix_topic", "n_tokens", "probability", "sampled"] and len(rows) == 3004
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        have = Counter(w for w in words if w in names)
        assert r.n_tokens == len(words) and r.mix_topic == min(have, key=lambda w: (-have[w], w), default="none")
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.8 * total, rel=1e-6)
    kept = sum(r.sampled for r in rows)
    assert abs(kept - sum(r.probability for r in rows)) < 5 * math.sqrt(len(rows) / 4)
    # Cells that are wanted more than they have stay whole; with fewer tokens wanted in all, every margin is met.
    fair = mixing.mixed(df, margins, F.col("own_tokens"), keep=0.05)
    for r in mixing.margins_reached(fair, ["source", "lang", "topic"]).collect():
        have = Counter()
        for x in rows:
            have[x[f"mix_{r.margin}"]] += x.n_tokens
        powers = {v: n**0.8 for v, n in have.items() if n}
        assert r.share == pytest.approx(have[r.value] / total) and r.expected == pytest.approx(powers.get(r.value, 0) / sum(powers.values()), abs=1e-6)
    for keep in (0.3, 0.8, 1.0):
        other = {(r.doc_id, r.text): r.probability for r in mixing.mixed(df, margins, F.col("own_tokens"), max_cells=2, rounds=3, keep=keep).collect()}
        same = {(r.doc_id, r.text): r.probability for r in mixing.mixed(df, margins, F.col("own_tokens"), rounds=3, keep=keep).collect()}
        assert all(abs(other[k] - same[k]) < 1e-9 for k in same)
    assert mixing.mixed(df.limit(0), margins, F.col("own_tokens")).count() == 0
    given = mixing.mixed(df, {"source": F.col("source")}, F.col("own_tokens"), targets=[{"src0": 0.5, "src1": 0.5, "none": 1.0}]).collect()
    assert {r.source for r in given if r.sampled} <= {"src0", "src1"}
    assert mixing.topics(plain.limit(0), F.col("text")) == []


def test_accepted_are_the_rows_that_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    more = [(None, None), (10**9, ""), (10**9 + 1, "日本語の文章です。" * 30), (10**9 + 2, "a" * 300_000)]
    extra = spark.createDataFrame(more, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    docs = docs.unionByName(extra, allowMissingColumns=True)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = kneser_ney.classified(docs, labels, fit_docs=150)
    want = sorted((r[0] or 0) for r in judged.where("kept").select("doc_id").collect())
    got = kneser_ney.accepted(docs, labels, fit_docs=150)
    assert got.columns == docs.columns
    assert sorted((r[0] or 0) for r in got.select("doc_id").collect()) == want
    assert 4 < len(want) < docs.count()


def test_models_are_fitted_on_all_trusted_texts_that_are_not_held_out(spark, monkeypatch):
    assert not hasattr(kneser_ney, "FIT_DOCS")
    seen, real = [], kneser_ney.fit
    monkeypatch.setattr(kneser_ney, "fit", lambda texts: seen.append(texts.count()) or real(texts))
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert kneser_ney.classified(docs, labels).count() == n
    assert seen == [spark.range(n).where(kneser_ney._part() < 7).count()] and seen[0] > 4000


def test_each_round_of_training_goes_through_all_trigrams():
    rnd = np.random.default_rng(2)
    code, n = np.arange(300_000), np.ones(300_000, dtype=np.int64)
    n[:10] = 200_000
    got, weight = log_bilinear._round(code, n, rnd)
    assert len(np.unique(got)) == len(code) and len(got) <= len(code) + log_bilinear.PLACES + 10
    share = np.bincount(got, weight, len(code)) / weight.sum()
    assert np.allclose(share, n / n.sum()) and abs(weight.mean() - 1) < 1e-9


def test_likelihood_is_that_of_all_trigrams():
    import pyarrow as pa

    share = np.array([1e-9, 0.5, 0.3, 0.2])
    model = log_bilinear.Model(share)
    model.q += np.random.default_rng(3).standard_normal(model.q.shape).astype(np.float32)
    code = np.array([c for c in range(64) if c % 4])
    n = np.arange(1, len(code) + 1)

    class Given:
        value = (share, model.flat())

    (row,) = log_bilinear._gain_batches(Given)(iter([pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "c"])]))
    assert row.column("n")[0].as_py() == n.sum()
    assert abs(row.column("gain")[0].as_py() - (n * model.log_probability(code)).sum()) < 1e-2
