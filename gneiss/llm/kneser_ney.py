"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model has an n-gram of characters for each language.  Counts of trusted text are summed by n-gram; lower orders
count the different characters that precede; for each context its total and its numbers of n-grams seen
once, twice and more often are summed, and joined to the n-grams with the discounts and the next lower
order's probability.  All of these tables are spread by their keys.  The finished model is
broadcast as hash tables, and one pass over all texts gives every document's perplexity.

A document is rejected when its perplexity lies above the language's threshold: ``margin`` times a quantile over
those trusted documents that were not fitted on.  To be fair to short texts the decision adds ``prior`` characters of
average perplexity to each text; the plain perplexity is returned beside.

Fitted on all trusted documents but those held out, seven of ten parts by a hash of the id; thresholds cover all of the
three held out, and scores all documents, whole.  The model has no bound but the number of different n-grams of characters,
which grows slower than the text.  Only a caller's ``fit_docs`` takes fewer, about so many of each language.

A symbol has 12 bits.  Code points below 3824 are one symbol, all others two: one of 272 leads that no character has alone,
then the 4096 that follow it.  So no two texts have the same symbols; in scripts above, such as Chinese, an n-gram of order 5
spans two to three characters, and ``n_symbols`` and the perplexity count symbols.

Cases: null and empty texts have a perplexity of their end alone and are kept; a null language is a language;
languages with no trusted text have no model: their perplexity is null and they are kept; languages with
fewer than ``enough`` documents for a threshold use that of all languages together; of repeated labels the worst
counts; repeated rows are judged alike; a null id has no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.hashing import Lookup
from gneiss.llm.work import give_back, packed, take, text_pieces, tidied, unpacked, written

ORDER, BITS = 5, 12
ENOUGH, PRIOR, QUANTILE, MARGIN = 30, 60, 0.99, 1.1
PIECE = 1 << 18
_PAD, _END = 2, 3
#: Code points from here on are a lead and a follower.
_WIDE = (1 << BITS) - 272


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of order ``ORDER`` that end at each symbol or at the end of each text, and text bounds."""
    pad = chr(_PAD) * (ORDER - 1)
    data = np.frombuffer("".join([pad + t + chr(_END) for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c, size = data.astype(np.uint64), np.array([len(t) + ORDER for t in texts])
    wide = data >= _WIDE
    if wide.any():
        size += np.add.reduceat(wide, np.cumsum(size) - size, dtype=np.int64)
        c = np.repeat(c, 1 + wide)
        lead = np.flatnonzero(wide) + np.arange(np.count_nonzero(wide))
        over = c[lead] - np.uint64(_WIDE)
        c[lead], c[lead + 1] = np.uint64(_WIDE) + (over >> np.uint64(BITS)), over & np.uint64((1 << BITS) - 1)
    h = np.zeros(max(len(c) - ORDER + 1, 0), dtype=np.uint64)
    for i in range(ORDER):
        h = (h << np.uint64(BITS)) | c[i : i + len(h)]
    begin = np.cumsum(size) - size
    good = np.ones(len(h) + ORDER - 1, dtype=bool)
    for i in range(ORDER - 1):
        good[begin + size - 1 - i] = False
    return h[good[: len(h)]], np.concatenate(([0], np.cumsum(size - ORDER + 1)))


def _low(code: np.ndarray, k: int) -> np.ndarray:
    return code & np.uint64((1 << (BITS * k)) - 1)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for first, stop, raw, at in text_pieces(batch.column("text"), PIECE):
            data, own = raw.tobytes(), langs[first:stop]
            for lang in set(own):
                rows = np.flatnonzero(own == lang)
                code, n = np.unique(codes([data[at[i] : at[i + 1]].decode() for i in rows])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], names=["lang", "code", "c"])


def _mask(code: str, k: int) -> Column:
    return F.col(code).bitwiseAND(F.lit((1 << (BITS * k)) - 1))


def fit(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``lang`` and ``text``: log10 probabilities (``k``, ``lang``, ``code``, ``p``) and back-off weights (``k``, ``lang``, ``context``, ``g``)."""
    types = {ORDER: written(texts.mapInArrow(tidied(_count_batches), "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        types[k] = types[k + 1].groupBy("lang", _mask("code", k).alias("code")).agg(F.count(F.lit(1)).alias("c"))
        types[k] = written(types[k], "grams")
    probability, backoff, lower = [], [], None
    for k in range(1, ORDER + 1):
        of = [F.sum((F.col("c") == i).cast("double")).alias(f"t{i}") for i in (1, 2, 3, 4)]
        y = F.when(F.col("t1") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(F.lit(0.5))
        step = lambda i: F.greatest(F.lit(0.1 * i), F.coalesce(i - (i + 1) * y * F.col(f"t{i + 1}") / F.nullif(F.col(f"t{i}"), F.lit(0.0)), F.lit(0.5 * i)))  # noqa: B023, E731
        discounts = types[k].groupBy("lang").agg(*of).select("lang", *[F.least(step(i), F.lit(float(i)) * 0.95).alias(f"d{i}") for i in (1, 2, 3)])
        rows = types[k].withColumn("context", F.shiftright("code", BITS))
        sums = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), *[F.sum(x.cast("long")).alias(f"n{i}") for i, x in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))])
        sums = sums.join(F.broadcast(discounts), "lang")
        sums = sums.withColumn("gamma", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.join(sums, ["lang", "context"]).withColumn("own", (F.col("c") - discount) / F.col("total"))
        if k == 1:
            rows = rows.withColumn("p", F.col("own") + F.col("gamma") / (F.col("n1") + F.col("n2") + F.col("n3") + 1))
            backoff.append(sums.select(F.lit(1).alias("k"), "lang", "context", F.log10(F.col("gamma") / (F.col("n1") + F.col("n2") + F.col("n3") + 1)).alias("g")))
        else:
            rows = rows.withColumn("suffix", _mask("code", k - 1)).join(lower.select("lang", F.col("code").alias("suffix"), F.col("p").alias("less")), ["lang", "suffix"])
            rows = rows.withColumn("p", F.col("own") + F.col("gamma") * F.col("less"))
            backoff.append(sums.select(F.lit(k).alias("k"), "lang", "context", F.log10("gamma").alias("g")))
        lower = written(rows.select("lang", "code", "p"), "orders")
        probability.append(lower.select(F.lit(k).alias("k"), "lang", "code", F.log10("p").alias("p")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(probability), union(backoff)


class Model:
    """A language's tables by order."""

    def __init__(self, p: dict[int, tuple[np.ndarray, np.ndarray]], g: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.p = {k: Lookup(*x) for k, x in p.items()}
        self.unknown = float(g[1][1][0])
        self.g = {k: Lookup(*x) for k, x in g.items() if k > 1}

    def log10(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            own = _low(code[left], k)
            value, hit = self.p[k](own)
            out[left[hit]] += value[hit]
            left, own = left[~hit], own[~hit]
            if k > 1:
                out[left] += self.g[k](own >> np.uint64(BITS))[0]
            else:
                out[left] += self.unknown
        return out


def load(probability: DataFrame, backoff: DataFrame) -> dict[str, Model]:
    """The tables as hash tables: 12 bytes for each n-gram and context, and the free places."""
    parts: dict[str, tuple[dict, dict]] = {}
    for side, df, key, value in ((0, probability, "code", "p"), (1, backoff, "context", "g")):
        table = df.select("lang", "k", key, F.col(value).cast("float").alias(value)).toArrow()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        own, order, code, number = langs.indices.to_numpy(), *(table.column(x).to_numpy() for x in ("k", key, value))
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            for k in range(1, ORDER + 1):
                rows = np.flatnonzero((own == i) & (order == k))
                if len(rows):
                    parts.setdefault(lang, ({}, {}))[side][k] = (code[rows].astype(np.int64).view(np.uint64), number[rows])
        del table, langs, own, order, code, number
    models = {lang: Model(*x) for lang, x in parts.items()}
    del parts
    give_back()
    return models


def _score_batches(models, id_type: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = models.value
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for first, stop, raw, at in text_pieces(batch.column("text"), PIECE):
                data, own = raw.tobytes(), langs[first:stop]
                total, n = np.full(stop - first, np.nan), np.zeros(stop - first, dtype=np.int64)
                for lang in set(own) & set(known):
                    rows = np.flatnonzero(own == lang)
                    code, bounds = codes([data[at[i] : at[i + 1]].decode() for i in rows])
                    total[rows] = np.add.reduceat(known[lang].log10(code), bounds[:-1])
                    n[rows] = np.diff(bounds)
                where = np.arange(first, stop)
                yield pa.RecordBatch.from_arrays([take(batch, "id", where), take(batch, "text_key", where), take(batch, "lang", where), pa.array(n), pa.array(total, from_pandas=True)], names=["id", "text_key", "lang", "n", "total"])

    return run, T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])


def _scores(models):
    """A function of text and language to ``n`` symbols and their ``total`` log10 probability, null without a model."""

    @F.pandas_udf("n long, total double")
    def score(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        known = models.value
        total, n = np.full(len(text), np.nan), np.zeros(len(text), dtype=np.int64)
        texts, langs = text.fillna("").tolist(), lang.to_numpy(dtype=object)
        for own in set(langs) & set(known):
            rows = np.flatnonzero(langs == own)
            piece = np.cumsum([len(texts[i]) for i in rows]) // PIECE
            for some in np.split(rows, np.flatnonzero(np.diff(piece)) + 1):
                code, bounds = codes([texts[i] for i in some])
                total[some], n[some] = np.add.reduceat(known[own].log10(code), bounds[:-1]), np.diff(bounds)
        return pd.DataFrame({"n": n, "total": total})

    return score


def _part() -> Column:
    """A hash of the id parts trusted documents: of ten parts, seven may be fitted on and three set thresholds."""
    return F.pmod(F.xxhash64("id", F.lit("part")), F.lit(10))


def _named(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))


def _trusted(labels: DataFrame, id_col: str) -> DataFrame:
    rows = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return rows.where("q = 1 and t = 0 and id is not null").select("id")


def _models(base: DataFrame, trusted: DataFrame, fit_docs: int | None):
    """A broadcast of the models by language, fitted on all trusted texts that are not held out, or on about ``fit_docs`` of each."""
    open_to_fit = trusted.where(_part() < 7)
    if fit_docs is not None:
        spot = F.pmod(F.xxhash64("id", F.lit("spot")), F.lit(1 << 30)) / float(1 << 30)
        pool = base.select("id", "lang").join(open_to_fit, "id", "left_semi")
        share = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", (F.lit(float(fit_docs)) / F.col("n")).alias("share"))
        open_to_fit = written(pool.join(F.broadcast(share), "lang").where(spot < F.col("share")).select("id").distinct(), "picked")
    # One plan at any size: ids that are few enough to be broadcast on a small table are not on a large one.
    texts = base.where(_part() < 7).join(open_to_fit.hint("merge"), "id", "left_semi").select("lang", "text")
    shared = base.sparkSession.sparkContext.broadcast(load(*fit(texts)))
    give_back()
    return shared


def _damped(prior: int) -> Column:
    """Minus log10 of the perplexity, that of short texts drawn to their language's mean."""
    return -(F.col("total") + prior * F.col("mean")) / (F.col("n") + prior)


def _limits(held: DataFrame, quantile: float, prior: int, enough: int, margin: float) -> DataFrame:
    """``mean`` and ``limit`` of each language, from the scores of trusted texts that were not fitted on."""
    means = held.groupBy("lang").agg((F.sum("total") / F.sum("n")).alias("mean"))
    held = held.join(F.broadcast(means), "lang").withColumn("damped", _damped(prior))
    limits = held.groupBy("lang").agg(F.count(F.lit(1)).alias("m"), F.percentile_approx("damped", F.lit(quantile), F.lit(10_000)).alias("limit"), F.first("mean").alias("mean"))
    whole = held.agg(F.percentile_approx("damped", F.lit(quantile), F.lit(10_000)).alias("whole"))
    limits = limits.crossJoin(F.broadcast(whole)).select("lang", "mean", (F.when(F.col("m") >= enough, F.col("limit")).otherwise(F.col("whole")) + F.log10(F.lit(margin))).alias("limit"))
    return written(limits, "limits")


def _kept(prior: int) -> Column:
    return F.coalesce((_damped(prior) <= F.col("limit")) | (F.col("n") <= 1), F.lit(True))


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int | None = None, quantile: float = QUANTILE, prior: int = PRIOR, enough: int = ENOUGH, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` that :func:`classified` keeps, in one pass without a shuffle of texts: limits are set beforehand."""
    base, trusted = _named(docs, id_col, text_col, lang_col), _trusted(labels, id_col)
    shared = _models(base, trusted, fit_docs)
    run, schema = _score_batches(shared, base.schema["id"].dataType)
    held = written(base.where(_part() >= 7).join(trusted, "id", "left_semi").mapInArrow(tidied(run), schema).where("total is not null"), "held")
    limits = _limits(held, quantile, prior, enough, margin)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    rows = docs.select(packed(docs).alias("row"), lang.alias("lang"), _scores(shared)(F.col(text_col), lang).alias("score"))
    rows = rows.select("row", "lang", "score.n", F.when(~F.isnan("score.total"), F.col("score.total")).alias("total"))
    return rows.join(F.broadcast(limits), "lang", "left").where(_kept(prior)).select(*unpacked("row", docs.columns))


def classified(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int | None = None, quantile: float = QUANTILE, prior: int = PRIOR, enough: int = ENOUGH, margin: float = MARGIN) -> DataFrame:
    """One row for each input row: ``id_col``, ``text_key``, ``lang``, ``n_symbols``, ``perplexity``, ``threshold`` and ``kept``.

    ``labels`` has the same id, ``quality`` and ``toxic``; trusted is what has a quality of 1 and is not toxic.
    """
    base, trusted = _named(docs, id_col, text_col, lang_col), _trusted(labels, id_col)
    shared = _models(base, trusted, fit_docs)
    run, schema = _score_batches(shared, base.schema["id"].dataType)
    scored = written(base.mapInArrow(tidied(run), schema), "scores")
    shared.unpersist()
    held = scored.where((_part() >= 7) & F.col("total").isNotNull()).join(trusted, "id", "left_semi")
    limits = _limits(held, quantile, prior, enough, margin)
    out = scored.join(F.broadcast(limits), "lang", "left")
    return out.select(
        F.col("id").alias(id_col),
        "text_key",
        "lang",
        F.col("n").alias("n_symbols"),
        F.pow(F.lit(10.0), -F.col("total") / F.col("n")).alias("perplexity"),
        F.pow(F.lit(10.0), "limit").alias("threshold"),
        _kept(prior).alias("kept"),
    )
