import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import gneiss.llm.jaccard_join as m
from gneiss.llm.jaccard_join import deduplicated, jaccard_groups
from gneiss.llm.work import written


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda c: c.group().lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    low = lambda g: min((d for d in groups[g] if d is not None), default=None)
    return sorted((-1 if d is None else d, len(sets[i]), low(root(i))) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefGé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 4)):
                if words:
                    i = rnd.randrange(len(words))
                    words[i : i + rnd.randint(0, 1)] = [rnd.choice(vocabulary)]
            texts.append(" ".join(words).swapcase() if rnd.random() < 0.1 else "\t".join(words))
        else:
            texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 90))))
    return texts + [None, "", " \n", "one", "One", "one two", "two one", "w " * 500]


def got(spark, rows, **more):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, node string, cluster int")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(df, **more).collect())


@pytest.mark.parametrize("k,num,blocks", [(3, 90, None), (5, 80, None), (2, 70, 8)])
def test_against_brute_force(spark, monkeypatch, k, num, blocks):
    if blocks:
        monkeypatch.setattr(m, "BLOCK_SETS", blocks)
        monkeypatch.setattr(m, "CROWD", 3)
    rows = list(enumerate(corpus(k + num, 160)))
    random.Random(k).shuffle(rows)
    assert got(spark, rows, k=k, num=num) == brute(rows, k, num, 100)


def near_copies(n):
    """A text in many versions of one changed word each, versions half as long, and texts linked with few of them."""
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(n):
        own = words[:60] if i % 5 == 0 else words[: rnd.randint(100, 120)]
        own[rnd.randrange(len(own))] = f"x{i}"
        texts.append(" ".join(own))
    return texts + [" ".join(words[i : i + 80]) for i in range(0, 40, 8)]


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_SETS", 16)
    monkeypatch.setattr(m, "CROWD", 8)
    seen = {}
    for name in ("head_tiles", "rest_tiles"):

        def counted(rows, name=name, tiles=getattr(m, name)):
            seen[name] = (rows.count(), tiles(rows).count())
            return tiles(rows)

        monkeypatch.setattr(m, name, counted)
    rows = list(enumerate(near_copies(400)))
    assert got(spark, rows, k=3, num=85) == brute(rows, 3, 85, 100)
    sets, met = seen["head_tiles"]
    assert sets > 300 and met < 8 * sets
    assert seen["rest_tiles"][1] < sets * sets / 16


@pytest.mark.parametrize("num,den", [(1, 3), (1, 2), (80, 100), (90, 100), (100, 100)])
def test_sets_that_link_are_of_neighbouring_bands(spark, num, den):
    sizes = [x for x in range(1, 3000)] + [den**i // num**i for i in range(1, 8)]
    df = spark.createDataFrame([(x, -(-num * x // den)) for x in sizes], "n long, least long")
    far = df.where(m._band(F.col("n"), num, den) - m._band(F.col("least"), num, den) > (0 if num == den else 1))
    assert far.count() == 0


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, ""), (8, ""), (3, "other words of the same id here")]
    assert got(spark, rows, k=3, num=90) == brute(rows, 3, 90, 100)
    assert got(spark, []) == []
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, keeper string")
    left = deduplicated(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, ""), (3, "a b c d e f"), (3, "other words of the same id here"), (7, ""), (8, "")]


def test_bitmaps_bound_the_overlap():
    import numpy as np

    rnd = np.random.default_rng(3)
    for n in (5, 300, 3000):
        a = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rnd.integers(0, 1 << 63, n // 2, dtype=np.uint64))))
        x, y = m.bitmap(a), m.bitmap(b)
        while len(x) > len(y):
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] | y[len(y) // 2 :]
        assert len(a) - int(np.bitwise_count(x & ~y).sum()) >= len(np.intersect1d(a, b))


def test_tiles_of_sets_with_bitmaps_of_many_widths():
    import numpy as np

    rnd = np.random.default_rng(8)
    base = np.unique(rnd.integers(0, 1 << 63, 5000, dtype=np.uint64))
    sets = [np.sort(rnd.permutation(base)[:n]) for n in (4999, 4600, 4200, 2000, 1100, 1020, 1000, 990, 3, 3)]
    sets += [np.sort(np.concatenate((s[:-1], rnd.integers(0, 1 << 63, 1, dtype=np.uint64)))) for s in sets]
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j])):
                a, b = up[i], up[j]
                up = [a if x == b else x for x in up]
    label = list(range(len(sets)))
    for i, j in m.link_tile(sets, np.zeros(len(sets)), 90, 100):
        a, b = label[i], label[j]
        label = [a if x == b else x for x in label]
    assert len(set(zip(up, label))) == len(set(up)) == len(set(label))


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    summed = spark.range(1000).groupBy((F.col("id") % 77).alias("k")).agg(F.sum("id").alias("s"))
    assert written(summed.join(spark.range(50).withColumnRenamed("id", "k").repartition(3), "k"), "test")._gneiss_path
    for _ in range(50):  # they are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left


def test_tables_with_prefixes_and_bitmaps_are_dropped(spark, monkeypatch):
    made = []
    monkeypatch.setattr(m, "written", lambda df, name: made.append((name, written(df, name))) or made[-1][1])
    got(spark, list(enumerate(corpus(3, 60))))
    there = {name for name, df in made if os.path.exists(df._gneiss_path.removeprefix("file://"))}
    assert not there & {"signatures", "classes", "posts", "sets"} and {"signatures", "classes", "posts", "sets"} <= {name for name, _ in made}


def test_classes_that_fit_no_other_leave_before_bitmaps(spark):
    # key: node, size and members from the n-gram on
    posts = {1: [(1, 100, 100), (2, 100, 100), (3, 50, 50)], 2: [(4, 100, 89), (5, 100, 88)], 3: [(4, 100, 80), (6, 100, 95)], 4: [(1, 100, 20), (2, 100, 20), (3, 50, 10)]}
    df = spark.createDataFrame([(k, *x) for k, xs in posts.items() for x in xs], "key long, node long, n int, rest int")
    assert sorted(r.nodes for r in m.fitting(df, 80, 100).collect()) == [[1, 2]]
    # 89 of the 111 members of both are more than 80 %, 88 of 112 fewer.
    more = df.union(spark.createDataFrame([(5, 4, 100, 89), (5, 7, 100, 89)], df.schema))
    assert sorted(r.nodes for r in m.fitting(more, 80, 100).collect()) == [[1, 2], [4, 7]]
