"""Removal of byte strings that occur more than once in a corpus, by a sampled suffix array.

A full suffix array of a corpus is an order of magnitude larger than the corpus.  Here only suffixes at
sampled places enter the sort, and the places depend on content alone:

1. Every window of ``window`` bytes names one anchor, the smallest fingerprint among its half-window
   grams.  Runs of windows that name the same anchor form an *interval*; its context is the bytes that its
   windows cover.  Equal windows name the same anchor at the same place, so they meet in one bucket.
2. Anchor grams are the initial buckets.  Buckets of one member are unique and leave at once.
3. Within a bucket, intervals with equal whole contexts are repeats as they stand.  They are found by a
   count that is combined before the shuffle, so a passage in a third of all rows costs one row a task.
4. What remains lies at the ends of repeats.  One member for each distinct context goes to its bucket,
   where bucket-pointer refinement sorts the suffixes (:func:`refine`): equal grams first, then by the
   bucket of the suffix one gram later, two grams later and so on, each round reading the buckets that
   the round before has split.  Buckets with very many different contexts are split over tasks and
   compared by 128-bit window fingerprints instead, so no bucket grows into a task.

Cases: null text is empty; texts shorter than a window have nothing to remove; repeated rows are
occurrences of each other; a null id is an id like any other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.rolling import every, mix, prefix, sliding_argmin, span
from gneiss.llm.work import drop_written, packed, take, text_pieces, tidied, written

#: Bytes of text handled at once in a Python worker; longer texts are cut with an overlap of one window.
PIECE = 1 << 20
#: Distinct contexts in one bucket above which it is split over tasks.
HOT = 10_000


def intervals(text: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """First and last window start, anchor, anchor fingerprint and context fingerprint of each interval."""
    gram = window // 2
    found = []
    for begin in range(0, max(len(text) - window + 1, 0), PIECE):
        part = text[begin : begin + PIECE + window - 1]
        p = prefix(part)
        h = mix(every(p, gram))
        m = sliding_argmin(h, window - gram + 1)
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        last = np.concatenate((first[1:], [len(m)])) - 1
        a = m[first]
        shape = mix(((a - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64))
        found.append((first + begin, last + begin, a + begin, h[a], mix(span(p, first, last + window) ^ shape)))
    if not found:
        z = np.empty(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def refine(text: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of all suffixes of ``text`` by their first ``depth`` bytes.

    ``end[i]`` is where the context of position ``i`` ends.  Two positions with ``depth`` bytes before
    their ends get the same pointer exactly when those bytes are equal; other positions have no meaning.
    Grams of ``depth / 4`` bytes are bucketed by fingerprint; each round sorts the members of
    buckets that still have several by the pointer at the depth reached, which the round before refined.
    """
    n = len(text)
    gram = -(-depth // 4)
    here = np.arange(n - gram + 1, dtype=np.int32)
    here = here[here + gram <= end[: n - gram + 1]]
    pointer = np.full(n, -1, dtype=np.int32)
    if not len(here):
        return pointer
    key = _grams(text, gram)[here]
    order = np.argsort(key, kind="stable")
    active, key = here[order], key[order]
    del here, order
    pointer[active] = _bucket_ends(key[1:] != key[:-1])
    del key
    reached = gram
    while reached < depth:
        step = min(reached, depth - reached)
        active = active[active + (step + reached) <= end[active]]
        active = active[np.bincount(pointer[active], minlength=n)[pointer[active]] > 1]
        if not len(active):
            break
        own, later = pointer[active], pointer[active + step]
        order = np.lexsort((later, own))
        active, own, later = active[order], own[order], later[order]
        del order
        new = own[1:] != own[:-1]
        start = np.flatnonzero(np.concatenate(([True], new)))
        count = np.diff(np.concatenate((start, [len(own)])))
        base = np.repeat((own[start] - count - start + 1).astype(np.int32), count)
        pointer[active] = _bucket_ends(new | (later[1:] != later[:-1])) + base
        reached += step
    return pointer


def _grams(text: np.ndarray, gram: int) -> np.ndarray:
    """Fingerprints of all grams, piece by piece: a worker keeps tables as long as the longest piece."""
    n = len(text) - gram + 1
    return np.concatenate([every(prefix(text[i : min(i + PIECE, n) + gram - 1]), gram) for i in range(0, n, PIECE)])


def _bucket_ends(new: np.ndarray) -> np.ndarray:
    """For sorted rows the index of the last row of each one's bucket; ``new`` tells where the next row is of another."""
    last = np.flatnonzero(np.concatenate((new, [True]))).astype(np.int32)
    return np.repeat(last, np.diff(np.concatenate(([-1], last))))


def _interval_batches(window: int, id_type: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, raw, at in text_pieces(batch.column("text"), PIECE):
                rows, parts = [], []
                for i in range(stop - first):
                    if at[i + 1] - at[i] >= window:
                        x = intervals(raw[at[i] : at[i + 1]], window)
                        parts.append(x)
                        rows.append(np.full(len(x[0]), first + i))
                if not parts:
                    continue
                s, e, a, anchor, context = (np.concatenate(x) for x in zip(*parts, strict=True))
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [take(batch, "id", row), take(batch, "text_key", row), *(pa.array(x.astype(np.int32)) for x in (s, e, a)), *(pa.array(x.view(np.int64)) for x in (anchor, context))],
                    names=["id", "text_key", "first", "last", "anchor_at", "anchor", "context"],
                )

    schema = T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.LongType()), *(T.StructField(x, T.IntegerType()) for x in ("first", "last", "anchor_at")), T.StructField("anchor", T.LongType()), T.StructField("context", T.LongType())])
    return run, schema


def _context_batches(window: int, id_type: T.DataType):
    """From texts with the intervals asked of them to one row for each interval, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                raw = text.encode() if isinstance(text, str) else text
                wanted = asked[i].as_py()
                row = np.full(len(wanted), i)
                yield pa.RecordBatch.from_arrays(
                    [take(batch, "id", row), take(batch, "text_key", row), pa.array([x["first"] for x in wanted], pa.int32()), pa.array([x["last"] for x in wanted], pa.int32()), pa.array([x["anchor"] for x in wanted], pa.int64()), pa.array([x["hot"] for x in wanted], pa.bool_()), pa.array([raw[x["first"] : x["last"] + window] for x in wanted], pa.binary())],
                    names=["id", "text_key", "first", "last", "anchor", "hot", "bytes"],
                )

    schema = T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("anchor", T.LongType()), T.StructField("hot", T.BooleanType()), T.StructField("bytes", T.BinaryType())])
    return run, schema


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _repeated_runs(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Runs of window starts that occur twice among the contexts of ``batch``."""
    column = batch.column("bytes").cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]]
    size = np.diff(at)
    stop = np.cumsum(size)
    end = np.repeat(stop.astype(np.int32), size)
    pointer = refine(text, end, window)
    starts = np.flatnonzero(np.arange(len(text), dtype=np.int32) + window <= end)
    of = pointer[starts]
    flag = np.zeros(len(text) + 1, dtype=bool)
    flag[starts] = np.bincount(of, minlength=len(text) + 1)[of] > 1
    a, b = _runs(flag)
    owner = np.searchsorted(stop, a, side="right")
    shift = batch.column("first").to_numpy()[owner] - (stop - size)[owner]
    return pa.RecordBatch.from_arrays([take(batch, "id", owner), take(batch, "text_key", owner), pa.array((a + shift).astype(np.int32)), pa.array((b + shift).astype(np.int32))], names=["id", "text_key", "first", "last"])


def _refine_batches(window: int):
    """Rows come sorted by anchor; whole buckets are handled together, many in one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            begin = 0
            anchor = batch.column("anchor").to_numpy()
            weight = np.cumsum([len(x) for x in batch.column("bytes").to_pylist()])
            while begin < batch.num_rows:
                if held and held[-1].column("anchor")[-1].as_py() != anchor[begin] and size >= PIECE:
                    yield _repeated_runs(_joined(held), window)
                    held, size = [], 0
                before = weight[begin - 1] if begin else 0
                cut = min(int(np.searchsorted(weight, before + PIECE)) + 1, batch.num_rows)
                while cut < batch.num_rows and anchor[cut] == anchor[cut - 1]:
                    cut += 1
                held.append(batch.slice(begin, cut - begin))
                size += int(weight[cut - 1] - before)
                begin = cut
        if held:
            yield _repeated_runs(_joined(held), window)

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _window_batches(window: int, id_type: T.DataType):
    """One row with a 128-bit fingerprint for each window of a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column("bytes")[i].as_py(), dtype=np.uint8)
                p, q = prefix(raw), prefix(mix(raw.astype(np.uint64) + np.uint64(257)))
                one, two = every(p, window), every(q, window)
                row = np.full(len(one), i)
                yield pa.RecordBatch.from_arrays([take(batch, "id", row), take(batch, "text_key", row), pa.array((batch.column("first")[i].as_py() + np.arange(len(one))).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["id", "text_key", "first", "one", "two"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType())])
    return run, schema


def _apply_batches(window: int, id_type: T.DataType):
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            for begin, stop, raw, at in text_pieces(batch.column("text"), PIECE):
                kept, spans, sizes = [], [], []
                for i in range(stop - begin):
                    part = raw[at[i] : at[i + 1]]
                    sizes.append(len(part))
                    runs = lists[begin + i].as_py()
                    if not runs:
                        kept.append(part.tobytes())
                        spans.append([])
                        continue
                    edge = np.zeros(len(part) + 1, dtype=np.int32)
                    np.add.at(edge, [x["first"] for x in runs], 1)
                    np.add.at(edge, [x["last"] + window for x in runs], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept.append(part[~gone].tobytes())
                    spans.append([{"start": int(x), "stop": int(y) + 1} for x, y in zip(*_runs(gone), strict=True)])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                rows = np.arange(begin, stop)
                yield pa.RecordBatch.from_arrays([take(batch, "id", rows), take(batch, "text_key", rows), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["id", "text_key", "n_bytes", "spans", "kept"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", spans_type), T.StructField("kept", T.BinaryType())])
    return run, schema


def text_key(text: Column) -> Column:
    """Tells rows of one id apart; rows with the same id and text get the same spans."""
    return F.xxhash64(text)


def repeated_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 400, hot: int = HOT) -> DataFrame:
    """Runs ``first..last`` of window starts whose ``window`` bytes start anywhere else too, by id and ``text_key``."""
    if window < 16:
        raise ValueError("window must be 16 bytes at least")
    base = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    id_type = base.schema["id"].dataType
    run, schema = _interval_batches(window, id_type)
    found = written(base.where(F.octet_length("text") >= window).mapInArrow(tidied(run), schema), "intervals")

    # Written, so that both sides of the join are plain exchanges and a hot anchor can be split over tasks.
    shared = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    alike = written(found.join(shared, "anchor", "left_semi"), "shared")
    drop_written(found)
    contexts = alike.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "text_key", "first", "last")).alias("member"))
    contexts = written(contexts, "contexts")
    whole = alike.join(contexts.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select("id", "text_key", "first", "last")

    buckets = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least")).where("members > 1 and least = 1").select("anchor", (F.col("members") > hot).alias("hot"))
    asked = contexts.join(buckets, "anchor").select("anchor", "hot", "member.*").groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "last", "anchor", "hot")).alias("asked"))
    once = base.alias("b").join(asked.alias("a"), F.col("b.id").eqNullSafe(F.col("a.id")) & (F.col("b.text_key") == F.col("a.text_key"))).select("b.id", "b.text_key", "b.text", "a.asked")
    run, schema = _context_batches(window, id_type)
    members = written(once.mapInArrow(tidied(run), schema), "members")

    runs_schema = T.StructType([members.schema[x] for x in ("id", "text_key", "first", "last")])
    near = members.where("not hot").select("id", "text_key", "first", "anchor", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidied(_refine_batches(window)), runs_schema)
    run, schema = _window_batches(window, id_type)
    windows = members.where("hot").mapInArrow(tidied(run), schema)
    twice = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    far = windows.join(twice, ["one", "two"], "left_semi").select("id", "text_key", "first", F.col("first").alias("last"))
    return whole.unionByName(near).unionByName(far)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 400, hot: int = HOT) -> DataFrame:
    """One row for each input row: ``id_col``, ``text_key``, ``n_bytes``, removed ``spans`` and the ``kept`` bytes.

    Every byte covered by a ``window``-byte string that also starts anywhere else in the corpus goes, in all
    its places; what starts elsewhere is judged on the input, and spans are maximal.
    """
    base = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    runs = repeated_runs(docs, id_col=id_col, text_col=text_col, window=window, hot=hot)
    runs = written(runs.groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "runs")
    joined = base.alias("b").join(runs.alias("r"), F.col("b.id").eqNullSafe(F.col("r.id")) & (F.col("b.text_key") == F.col("r.text_key")), "left").select("b.id", "b.text_key", "b.text", "r.runs")
    run, schema = _apply_batches(window, base.schema["id"].dataType)
    return joined.mapInArrow(tidied(run), schema).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 400, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` with the repeats cut out of ``text_col``; parts of characters at the cuts go too."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, r in zip(text, runs, strict=True):
            raw = np.frombuffer(t.encode(), dtype=np.uint8)
            edge = np.zeros(len(raw) + 1, dtype=np.int32)
            np.add.at(edge, [x["first"] for x in r], 1)
            np.add.at(edge, [x["last"] + window for x in r], -1)
            out.append(raw[np.cumsum(edge[:-1]) <= 0].tobytes().decode("utf-8", "ignore"))
        return pd.Series(out)

    runs = repeated_runs(docs, id_col=id_col, text_col=text_col, window=window, hot=hot)
    runs = written(runs.groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "runs")
    rows = docs.select(packed(docs).alias("row"), F.col(id_col).alias("own_id"), text_key(F.col(text_col)).alias("own_key"), F.col(text_col).alias("text"))
    joined = rows.join(runs, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key")), "left")
    none = F.array().cast("array<struct<first:int,last:int>>")
    changed = F.col("runs").isNotNull()
    # As a random function is: else a filter on the text is pushed below it, and each task cuts twice, in two Python workers.
    less = cut.asNondeterministic()(F.when(changed, F.col("text")).otherwise(""), F.coalesce("runs", none))
    kept = joined.withColumn("less", F.when(changed, less).otherwise(F.col("text")))
    return kept.select(*[F.col("less").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
