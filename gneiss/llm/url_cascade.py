"""Verdicts on urls by rules of hosts and path prefixes, with Bloom filter cascades in place of joins.

A url's keys are its host and all parent domains, each followed by the path's prefixes of those lengths that
rules have.  The keys of the whole corpus are the universe.  For each verdict a cascade is built: level 0
holds the verdict's rules, level 1 those other keys of the universe that level 0 takes for rules, level 2 the
rules that level 1 takes for others, and so on until a level has no false positives.  Over the universe
membership is then exact, so each url needs only a look at the levels, and nothing is joined.

Level 0 has as many bits a rule as it takes for half as many false positives as there are rules, by the number of keys in the
universe: 1.44 bits for each doubling of keys a rule.  So the false positives, and with them all levels above, are bound by
the list of rules and not by the corpus: about 45 bits a rule at ten billion keys for five rules, less than
the list itself, which the caller holds.  One pass over the keys finds those that level 0 takes; the other levels need only these.

Cases: the longest rule wins, at equal length (a tie) the one with the longer host.  Without a rule the verdict is that of
an empty list, ``allow``.  A null url, an empty one or one without ``://``, has an empty host and path; very long urls have
no more keys than labels times lengths of rules; repeated rows are judged alike; an empty table gives an empty table; where an
input column has the name of an output column, it gives way.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.rolling import mix
from gneiss.llm.work import packed, unpacked

Rule = tuple[str, str, str]
#: Bits a key of the levels above the first.
BITS_PER_KEY = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Filter:
    """A Bloom filter over pairs of 64-bit hashes; ``level`` makes its hashing its own."""

    def __init__(self, n: int, level: int, bits_per_key: float = BITS_PER_KEY):
        self.bits = max(64, math.ceil(n * bits_per_key / 64) * 64)
        self.hashes = max(1, round(bits_per_key * math.log(2)))
        self.level = np.uint64(level + 1)
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)

    def _places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            a, b = mix(one + self.level * np.uint64(0x9E3779B97F4A7C15)), mix(two ^ self.level) | np.uint64(1)
            return (a[:, None] + b[:, None] * np.arange(self.hashes, dtype=np.uint64)) % np.uint64(self.bits)

    def add(self, one: np.ndarray, two: np.ndarray) -> Filter:
        place = self._places(one, two).ravel()
        np.bitwise_or.at(self.words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        return self

    def has(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        place = self._places(one, two)
        return ((self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).all(axis=1)


def member(levels: list[Filter], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The first level that rejects a key decides: an even one says no."""
    out = np.zeros(len(one), dtype=bool)
    left = np.arange(len(one))
    for k, f in enumerate(levels):
        hit = f.has(one[left], two[left])
        out[left[~hit]] = k % 2 == 1
        left = left[hit]
    out[left] = len(levels) % 2 == 1
    return out


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("one"), F.xxhash64(key, F.lit(1)).alias("two")


def cascade(listed: DataFrame, universe: DataFrame, n_universe: int) -> list[Filter]:
    """Levels that tell ``listed`` from the rest of ``universe`` (hash pairs, of which there are ``n_universe`` at most)."""
    yes = _pairs(listed)
    n = len(yes)
    if not n:
        return []
    first = Filter(n, 0, max(BITS_PER_KEY, math.log2(max(2 * n_universe / n, 2)) / math.log(2))).add(*yes.T)
    given = universe.sparkSession.sparkContext.broadcast(first)

    @F.pandas_udf("boolean")
    def taken(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(given.value.has(one.to_numpy().view(np.uint64), two.to_numpy().view(np.uint64)))

    found = _pairs(universe.where(taken("one", "two")).distinct())
    no = np.array(sorted(set(map(tuple, found.tolist())) - set(map(tuple, yes.tolist()))), dtype=np.uint64).reshape(-1, 2)
    levels = [first]
    while len(no):
        levels.append(Filter(len(no), len(levels)).add(*no.T))
        yes, no = no, yes[levels[-1].has(*yes.T)]
    return levels


def _pairs(df: DataFrame) -> np.ndarray:
    table = df.toArrow()
    return np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("one", "two")], axis=1)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that a rule for the url can have, the longest first."""
    labels = F.split(host, "\\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(parents, lambda p: F.transform(fits, lambda n: F.struct((-F.length(p) - n).alias("size"), (-F.length(p)).alias("host_size"), F.concat(p, F.substring(path, 1, n)).alias("key")))))
    return F.transform(F.array_sort(F.array_distinct(keys)), lambda k: k["key"])


def judged(pages: DataFrame, rules: list[Rule], *, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule`` (null without one) and ``verdict``.

    ``rules`` are (verdict, host, path) with the verdicts allow and block.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    lengths = sorted({len(p) for _, _, p in rules}) or [0]
    parts = pages.select(packed(pages).alias("row"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    keyed = parts.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths))
    n_universe = keyed.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    universe = keyed.select(F.explode("keys").alias("key")).select(*_hashes(F.col("key")))

    verdicts = {"allow": 1, "block": 2}
    listed = {v: spark.createDataFrame([(h + p,) for w, h, p in rules if w == v], "key string").distinct() for v in verdicts}
    levels = [(code, cascade(listed[v].select(*_hashes(F.col("key"))), universe, n_universe)) for v, code in verdicts.items()]
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("struct<at:int,verdict:int>")
    def look(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        size = np.array([len(x) for x in one])
        a, b = (np.concatenate([*map(np.asarray, x), np.empty(0, dtype=np.int64)]).astype(np.int64).view(np.uint64) for x in (one, two))
        kind = np.zeros(len(a), dtype=np.int32)
        for code, x in shared.value:
            kind[member(x, a, b)] = code
        row = np.repeat(np.arange(len(size)), size)
        hit = np.flatnonzero(kind)
        rows, first = np.unique(row[hit], return_index=True)
        out = pd.DataFrame({"at": np.zeros(len(size), dtype=np.int32), "verdict": np.zeros(len(size), dtype=np.int32)})
        start = np.cumsum(size) - size
        out.loc[rows, "at"] = (hit[first] - start[rows] + 1).astype(np.int32)
        out.loc[rows, "verdict"] = kind[hit[first]]
        return out

    pair = [F.transform("keys", lambda k: F.xxhash64(k)), F.transform("keys", lambda k: F.xxhash64(k, F.lit(1)))]
    hit = keyed.withColumn("hit", look(*pair))
    more = {
        "host": F.col("host"),
        "path": F.col("path"),
        "rule": F.when(F.col("hit.at") > 0, F.element_at("keys", F.col("hit.at"))),
        "verdict": F.when(F.col("hit.verdict") == 2, "block").otherwise("allow"),
    }
    return hit.select(*unpacked("row", pages.columns, tuple(more)), *[c.alias(m) for m, c in more.items()])
