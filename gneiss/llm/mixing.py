"""Sampling of documents so that token weights meet target shares of sources, languages and topics.

Tokens are summed by cell, a combination of source, language and topic.  Iterative proportional fitting scales the cells to
one margin after another until all fit, or for ``rounds`` rounds.  The factor of each cell, times one number for all cells and at most 1, is
the probability with which each of its documents stays; the number is such that ``keep`` of all tokens are expected to stay.
A cell that is wanted more than it has stays whole, and the others make up for it in proportion.  A hash of the id decides,
so a result can be repeated.  :func:`margins_reached` tells what shares a mixture comes to.

Topics are words of the texts.  The ``n_topics`` commonest words of at least four letters, and nothing but letters, that are in
a tenth of the documents at most stand for topics, counted over all documents; a document's topic is the one of them that it has most often,
of equals the smallest, and ``none`` without any.

Without given targets, each margin's target is its own shares raised to ``temper`` and normalised, which moves weight from
large sources to small ones.  The cells are gathered where they number ``max_cells`` at most; beyond that they stay spread and are
scaled by aggregations, with the same result.

Cases: a null value of a margin is a value of its own; null and empty texts have no tokens and the topic ``none``; documents without
tokens have the probability of their cell; very long texts count whole; repeated rows, with one id, stay or go
together; a null id is hashed as an empty text; topics that are equally common go by their bytes; an empty table gives
an empty table; targets for values without tokens are passed over, and values without a target keep none; where an input column
has the name of an output column, it gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.work import packed, unpacked, written

ROUNDS, TEMPER, MAX_CELLS, KEEP, TOPICS = 20, 0.8, 100_000, 0.8, 32
_CLOSE = 1e-10
_GAP = "[\\x20\\x09-\\x0D]+"
TOPIC_WORD, COMMON = "^\\p{L}{4,}$", 0.1


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _GAP), lambda w: w != "")


def topics(docs: DataFrame, text: Column, n_topics: int = TOPICS) -> list[str]:
    """The words that stand for topics."""
    within = docs.select(words(text).alias("w")).select(F.array_distinct(F.filter("w", lambda w: F.length(w) >= 4)).alias("w"))
    counts = within.select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where((F.col("n") <= F.lit(docs.count() * COMMON)) & F.col("w").rlike(TOPIC_WORD)).orderBy(F.desc("n"), "w").limit(n_topics).collect()
    return [r["w"] for r in rows]


def described(docs: DataFrame, text: Column, names: list[str]) -> DataFrame:
    """The rows of ``docs`` as ``row``, with their ``n_tokens`` (words) and ``topic`` by the words that stand for topics.

    Each step is a projection of its own, so a text is split once.
    """
    out = docs.select(packed(docs).alias("row"), words(text).alias("words"))
    found = F.filter("words", lambda w: w.isin(names)) if names else F.array().cast("array<string>")
    out = out.select("row", F.size("words").cast("long").alias("n_tokens"), found.alias("found"))
    often = F.transform(F.array_distinct("found"), lambda w: F.struct((-F.size(F.filter("found", lambda x: x == w))).alias("n"), w.alias("w")))
    return out.select("row", "n_tokens", F.coalesce(F.array_min(often)["w"], F.lit("none")).alias("topic"))


def rake(cells: list[tuple], targets: list[dict], rounds: int = ROUNDS) -> list[float]:
    """Weights of cells (values of each margin, then tokens), scaled in turn to the targets of each margin until none changes."""
    weight = [float(c[-1]) for c in cells]
    for _ in range(rounds):
        before = weight
        for k, target in enumerate(targets):
            have: dict = {}
            for c, w in zip(cells, weight, strict=True):
                have[c[k]] = have.get(c[k], 0.0) + w
            weight = [w * target.get(c[k], 0.0) / have[c[k]] if have[c[k]] > 0 else 0.0 for c, w in zip(cells, weight, strict=True)]
        if all(abs(a - b) <= _CLOSE * abs(b) for a, b in zip(weight, before, strict=True)):
            break
    return weight


def tempered(cells: list[tuple], k: int, temper: float) -> dict:
    have: dict = {}
    for c in cells:
        have[c[k]] = have.get(c[k], 0.0) + c[-1]
    some = {v: n**temper for v, n in have.items() if n > 0}
    total = sum(some.values())
    return {v: n / total for v, n in some.items()}


def _level(sums, goal: float) -> float:
    """The number for all cells; ``sums(x)`` gives tokens of cells that ``x`` makes whole and weight of the others."""
    number, whole = 0.0, -1.0
    while True:
        full, rest = sums(number)
        if full == whole or rest <= 0 or full >= goal:
            return number if rest > 0 else float("inf")
        number, whole = (goal - full) / rest, full


def _rake_spread(cells: DataFrame, margins: list[str], targets: list[dict] | None, temper: float, rounds: int) -> DataFrame:
    """The same as :func:`rake` over a table of cells; ``w`` is the weight."""
    spark = cells.sparkSession
    out = cells.withColumn("w", F.col("n").cast("double"))
    goals = []
    for k, m in enumerate(margins):
        if targets is None:
            sums = cells.groupBy(F.col(m).alias("m")).agg(F.sum("n").alias("s")).where("s > 0").select("m", F.pow("s", F.lit(temper)).alias("t"))
            every = sums.agg(F.sum("t")).first()[0] or 1.0
            goals.append(written(sums.select("m", (F.col("t") / F.lit(every)).alias("t")), "targets"))
        else:
            goals.append(spark.createDataFrame(list(targets[k].items()), f"m {cells.schema[m].dataType.simpleString()}, t double"))
    for _ in range(rounds):
        for m, goal in zip(margins, goals, strict=True):
            sums = out.groupBy(F.col(m).alias("v")).agg(F.sum("w").alias("s")).join(goal, F.col("v").eqNullSafe(F.col("m")), "left").select("v", F.when(F.col("s") > 0, F.coalesce("t", F.lit(0.0)) / F.col("s")).otherwise(0.0).alias("f"))
            out = out.join(sums, F.col(m).eqNullSafe(F.col("v"))).select(*margins, "n", (F.col("w") * F.col("f")).alias("w"))
        out = written(out, "rake")
    return out


def _probabilities(named: DataFrame, margins: list[str], targets: list[dict] | None, temper: float, rounds: int, keep: float, max_cells: int) -> DataFrame:
    """Margin values ``v0``, ``v1``... of each cell and its ``p``."""
    spark = named.sparkSession
    cells = written(named.groupBy(*margins).agg(F.sum("n").alias("n")), "cells")
    goal = keep * (cells.agg(F.sum("n")).first()[0] or 0)
    as_v = [F.col(m).alias(f"v{i}") for i, m in enumerate(margins)]
    if cells.limit(max_cells + 1).count() <= max_cells:
        rows = [tuple(r) for r in cells.orderBy(*margins).collect()]
        goals = targets if targets is not None else [tempered(rows, k, temper) for k in range(len(margins))]
        weight = rake(rows, goals, rounds)
        factor = [w / r[-1] if r[-1] else 0.0 for w, r in zip(weight, rows, strict=True)]
        number = _level(lambda x: (sum(r[-1] for r, f in zip(rows, factor, strict=True) if f * x >= 1), sum(w for w, f in zip(weight, factor, strict=True) if f * x < 1)), goal)
        schema = ", ".join(f"v{i} {cells.schema[m].dataType.simpleString()}" for i, m in enumerate(margins))
        return F.broadcast(spark.createDataFrame([(*r[:-1], min(1.0, f * number) if f > 0 else 0.0) for r, f in zip(rows, factor, strict=True)], f"{schema}, p double"))
    spread = _rake_spread(cells, margins, targets, temper, rounds).withColumn("f", F.when(F.col("n") > 0, F.col("w") / F.col("n")).otherwise(0.0))

    def sums(x: float) -> tuple[float, float]:
        full = F.col("f") * F.lit(x) >= 1
        r = spread.agg(F.sum(F.when(full, F.col("n"))), F.sum(F.when(~full, F.col("w")))).first()
        return float(r[0] or 0), float(r[1] or 0)

    number = _level(sums, goal)
    return spread.select(*as_v, F.when(F.col("f") > 0, F.least(F.lit(1.0), F.col("f") * F.lit(number))).otherwise(0.0).alias("p"))


def _drawn(docs: DataFrame, margins: dict[str, Column], n_tokens: Column, id_col: str, targets, temper, rounds, keep, seed, max_cells) -> DataFrame:
    """``row``, the margins ``m0``, ``m1``..., ``n``, ``p`` and ``sampled``."""
    names = [f"m{i}" for i in range(len(margins))]
    named = docs.select(packed(docs).alias("row"), *[c.alias(m) for m, c in zip(names, margins.values(), strict=True)], n_tokens.alias("n"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    table = _probabilities(named, names, targets, temper, rounds, keep, max_cells)
    match = None
    for i, m in enumerate(names):
        one = F.col(m).eqNullSafe(F.col(f"v{i}"))
        match = one if match is None else match & one
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return named.join(table, match, "left").withColumn("sampled", drawn < F.col("p"))


def mixed(docs: DataFrame, margins: dict[str, Column], n_tokens: Column, *, id_col: str = "doc_id", targets: list[dict] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, keep: float = KEEP, seed: str = "mix", max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows of ``docs`` with ``n_tokens``, ``probability`` and ``sampled``; margins come as columns of their names, prefixed ``mix_``."""
    out = _drawn(docs, margins, n_tokens, id_col, targets, temper, rounds, keep, seed, max_cells)
    more = {f"mix_{m}": F.col(f"m{i}") for i, m in enumerate(margins)} | {"n_tokens": F.col("n"), "probability": F.col("p"), "sampled": F.col("sampled")}
    return out.select(*unpacked("row", docs.columns, tuple(more)), *[c.alias(m) for m, c in more.items()])


def sampled(docs: DataFrame, margins: dict[str, Column], n_tokens: Column, *, id_col: str = "doc_id", targets: list[dict] | None = None, temper: float = TEMPER, rounds: int = ROUNDS, keep: float = KEEP, seed: str = "mix", max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows of ``docs`` that the mixture takes."""
    out = _drawn(docs, margins, n_tokens, id_col, targets, temper, rounds, keep, seed, max_cells)
    return out.where("sampled").select(*unpacked("row", docs.columns))


def margins_reached(mixture: DataFrame, margins: list[str]) -> DataFrame:
    """``margin``, ``value``, ``share`` of all tokens and ``expected`` share of the mixture, from what :func:`mixed` gives."""
    named = mixture.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"mix_{m}").cast("string").alias("value")) for m in margins])).alias("k"), "n_tokens", (F.col("n_tokens") * F.col("probability")).alias("w"))
    sums = named.groupBy("k").agg(F.sum("n_tokens").alias("n"), F.sum("w").alias("w"))
    every = mixture.agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("w")).first()
    return sums.select("k.margin", "k.value", (F.col("n") / F.lit(float(every["n"] or 1))).alias("share"), (F.col("w") / F.lit(float(every["w"] or 1))).alias("expected"))
