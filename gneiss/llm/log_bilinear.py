"""Language-model scores: a log-bilinear neural model over word classes, trained by noise-contrastive estimation.

1. All training tokens are counted: words by 64-bit fingerprint, summed in each task before the shuffle.
2. Words that occur at least twice, the commonest ``n_frequent`` of them, are the model's vocabulary.  The commonest
   ``n_single`` are classes of their own.  The others share classes by the company they keep and by how common they are:
   the single words are clustered by their neighbours among themselves, and each other word goes with the cluster that
   precedes it most beyond chance, counted over all training tokens.  Words outside of the vocabulary are one class more.
3. Class trigrams of all training texts are counted.
4. The model predicts a class vector from the two classes before it, by one weight vector for each place, and scores
   classes by inner products.  It starts as the share of each class.  In each round each part of the trigram table goes through
   all of its trigrams, weighted by their counts (very common ones in several places of the round), in small steps of
   noise-contrastive estimation with AdaGrad; parameters and AdaGrad's sums are averaged over the parts, round after
   round, and the round with the best likelihood of all training trigrams is kept.
5. Batched matrix products give the normaliser of every pair of classes once; each token then needs one inner product.
   Within its class a word has its share of the smoothed counts.  In the class outside of the vocabulary a part is kept
   for one unseen word, by the counts of words seen once (Good-Turing).  So the probabilities of all words and of one
   unseen word add up to one.
6. Texts are scored in one pass.  Vocabulary is looked up in a table of bounded size; the other words, of which none is
   frequent, are joined to the counts.

Counts and trigrams grow with the corpus; the number of vocabulary words has the bound ``n_frequent``, that of classes
``n_single + n_groups`` times the octaves of counts.

Cases: null and empty texts have one token, the end; very long texts are cut nowhere; a null id is hashed as an empty text;
ties in counts go by fingerprint; repeated rows are scored alike and counted as often as they come; an empty table gives an
empty table; with no training text at all every token is unseen; only the named columns are read, so others may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm.hashing import Lookup
from gneiss.llm.work import drop_written, take, text_pieces, tidied, written
from gneiss.llm.words import fingerprints

PIECE = 1 << 20
#: Words that are classes of their own, clusters of them, and numbers in a class's vector.
SINGLE, GROUPS, WIDTH = 510, 16, 32
#: Words of the vocabulary at most; they are looked up without a join.
FREQUENT = 1 << 18
ROUNDS, NOISE, BATCH, RATE = 4, 256, 512, 0.05
#: Rows of the trigram table that a part holds at once, and places of a round beside one for each row: common trigrams take several.
PART, PLACES = 1 << 20, 1 << 17
#: Parts of the table at most: each sends its parameters, some 400 kB, to the driver once a round.
PARTS = 256
#: Distinct words that a task gathers before it hands their counts on.
_GATHERED = 1 << 19
END = np.uint64(0x656E64206F662074)
START, OTHER = 0, 1


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)


def _counted(pieces: Iterator[np.ndarray], key: str) -> Iterator[pa.RecordBatch]:
    """Sums of equal keys, handed on whenever many have come together."""
    held, size = [], 0

    def out():
        u, n = _sum_by_key(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return u, n

    for keys in pieces:
        held.append(np.unique(keys, return_counts=True))
        size += len(held[-1][0])
        if size > 2 * _GATHERED:
            held = [out()]
            size = len(held[0][0])
            if size > _GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=[key, "c"])
                held, size = [], 0
    if held:
        u, n = out()
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=[key, "c"])


def _with_ends(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and fingerprint of all tokens: the words of each text and then its end."""
    row, word = fingerprints(raw, at)
    stops = np.cumsum(np.bincount(row, minlength=n))
    return np.insert(row, stops, np.arange(n)), np.insert(word, stops, END)


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces():
        for batch in batches:
            for first, stop, raw, at in text_pieces(batch.column("text"), PIECE):
                yield _with_ends(raw, at, stop - first)[1]

    return _counted(pieces(), "word")


def _trigrams(cls: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Codes of the two classes before each token and of its own."""
    first = np.zeros(len(row), dtype=bool)
    second = np.zeros(len(row), dtype=bool)
    first[np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))] = True
    second[1:] = first[:-1]
    one, two = np.full(len(cls), START, dtype=np.int64), np.full(len(cls), START, dtype=np.int64)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    one[first] = START
    two[first | second] = START
    return (two * k + one) * k + cls


def _coded(encode) -> object:
    """Counts of the codes that ``encode`` makes of each piece's rows and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for first, stop, raw, at in text_pieces(batch.column("text"), PIECE):
                    yield encode(*_with_ends(raw, at, stop - first)).astype(np.uint64)

        return _counted(pieces(), "code")

    return run


def _nearest_single(single: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The single word last seen before each token of the same text, -1 without one; ``single`` is -1 for other tokens."""
    last = np.maximum.accumulate(np.where(single >= 0, np.arange(len(single)), -1))
    last = np.concatenate(([-1], last[:-1])) if len(last) else last
    same = (last >= 0) & (row[np.maximum(last, 0)] == row) if len(last) else np.zeros(0, dtype=bool)
    return np.where(same, single[np.maximum(last, 0)], -1)


def _clusters(pairs: np.ndarray, count: np.ndarray, n_groups: int) -> np.ndarray:
    """Groups of the single words, by spectral k-means on square roots of their neighbour shares."""
    n = len(pairs)
    if n <= n_groups:
        return np.arange(n)
    both = pairs + pairs.T + 0.01
    x = np.sqrt(both / both.sum(axis=1, keepdims=True))
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    x, weight = u[:, :n_groups] * s[:n_groups], np.sqrt(count)
    centres = x[[0]]
    for _ in range(n_groups - 1):
        away = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack((centres, x[np.argmax(away * weight)]))
    for _ in range(30):
        group = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(group):
            centres[g] = np.average(x[group == g], axis=0, weights=weight[group == g])
    return group


def _classes(training: DataFrame, word: np.ndarray, count: np.ndarray, n_single: int, n_groups: int) -> tuple[np.ndarray, int]:
    """The class of each vocabulary word (commonest first) and the number of classes."""
    spark = training.sparkSession
    n_single = min(n_single, len(word))
    place = np.arange(len(word))
    end = np.flatnonzero(word == END)
    if len(end) and end[0] >= n_single:  # the end of a text is a single word, however many words are commoner
        place[[n_single - 1, end[0]]] = place[[end[0], n_single - 1]]
    cls = np.empty(len(word), dtype=np.int32)
    cls[place[:n_single]] = 2 + np.arange(n_single)
    if len(word) <= n_single:
        return cls, 2 + n_single
    single = place[:n_single]
    close = np.flatnonzero(word[single] != END)  # ends precede nothing
    number = np.full(len(word), -1, dtype=np.int64)
    number[single[close]] = np.arange(len(close))
    table = spark.sparkContext.broadcast((Lookup(word, np.arange(len(word), dtype=np.int32)), number))
    n = max(len(close), 1)

    def pairs(row: np.ndarray, words: np.ndarray) -> np.ndarray:
        at, known = table.value[0](words)
        one = np.where(known, table.value[1][at], -1)
        near = _nearest_single(one, row)
        good = (one >= 0) & (near >= 0)
        return near[good] * n + one[good]

    got = training.mapInArrow(tidied(_coded(pairs)), "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    matrix = np.zeros(n * n)
    matrix[got.column("code").to_numpy()] = got.column("c").to_numpy()
    group = _clusters(matrix.reshape(n, n), count[single[close]].astype(np.float64), n_groups) if len(close) else np.zeros(1, dtype=np.int64)
    company = spark.sparkContext.broadcast(np.append(group, -1))

    def met(row: np.ndarray, words: np.ndarray) -> np.ndarray:
        at, known = table.value[0](words)
        one = np.where(known, table.value[1][at], -1)
        near = company.value[_nearest_single(one, row)]
        good = known & (one < 0) & (near >= 0) & (words != END)
        return at[good].astype(np.int64) * n_groups + near[good]

    seen = training.mapInArrow(tidied(_coded(met)), "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))
    seen = written(seen.select(F.expr(f"code div {n_groups}").cast("int").alias("at"), (F.col("code") % n_groups).cast("int").alias("g"), "c"), "company")
    share = np.ones(n_groups)
    for r in seen.groupBy("g").agg(F.sum("c").alias("c")).collect():
        share[r["g"]] += r["c"]
    beyond = F.col("c") / F.element_at(F.array(*[F.lit(float(x)) for x in share]), F.col("g") + 1)
    best = seen.groupBy("at").agg(F.max_by("g", F.struct(beyond, -F.col("g"))).alias("g")).toArrow()
    drop_written(seen)
    of = np.full(len(word), n_groups, dtype=np.int64)
    of[best.column("at").to_numpy()] = best.column("g").to_numpy()
    others = place[n_single:]
    octave = np.floor(np.log2(count[others])).astype(np.int64)
    kinds, kind = np.unique(of[others] * 64 + octave, return_inverse=True)
    cls[others] = 2 + n_single + kind
    return cls, 2 + n_single + len(kinds)


class Model:
    """Parameters: vectors of classes as context and as target, a weight vector for each place, and biases."""

    def __init__(self, share: np.ndarray):
        rnd = np.random.Generator(np.random.PCG64(11))
        self.share, self.k = share, len(share)
        self.r = (0.1 * rnd.standard_normal((self.k, WIDTH))).astype(np.float32)
        self.q = np.zeros((self.k, WIDTH), dtype=np.float32)
        self.c = np.ones((2, WIDTH), dtype=np.float32) * np.float32(0.5)
        self.b = np.log(share).astype(np.float32)
        self.sums = [np.full(x.shape, 1e-4, dtype=np.float32) for x in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.c, self.b]

    def with_parameters(self, flat: np.ndarray) -> Model:
        out = Model(self.share)
        at = 0
        for x in out.parameters() + out.sums:
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return out

    def flat(self) -> np.ndarray:
        """Parameters and AdaGrad's sums."""
        return np.concatenate([x.ravel() for x in self.parameters() + self.sums])

    def train(self, codes: np.ndarray, rnd: np.random.Generator, rate: float, weights: np.ndarray | None = None) -> None:
        """Steps of noise-contrastive estimation over trigrams in the order given; a batch shares its noise.

        ``weights`` are relative to their mean: a trigram counts so many times.
        """
        log_noise = (np.log(self.share) + np.log(NOISE)).astype(np.float32)
        ends = np.cumsum(self.share)
        for i in range(0, len(codes), BATCH):
            code = codes[i : i + BATCH]
            w, one, two = code % self.k, code // self.k % self.k, code // self.k**2
            noise = np.minimum(np.searchsorted(ends, rnd.random(NOISE) * ends[-1], side="right"), self.k - 1)
            near, far = self.r[one], self.r[two]
            pred = self.c[0] * near + self.c[1] * far
            real = (pred * self.q[w]).sum(axis=1) + self.b[w] - log_noise[w]
            false = pred @ self.q[noise].T + self.b[noise] - log_noise[noise]
            share = np.full(len(code), 1 / len(code), dtype=np.float32) if weights is None else (weights[i : i + BATCH] / len(code)).astype(np.float32)
            d_real = (_sigmoid(real) - 1) * share
            d_false = _sigmoid(false) * share[:, None]
            d_pred = d_real[:, None] * self.q[w] + d_false @ self.q[noise]
            grads = [
                _scatter(np.concatenate((one, two)), np.concatenate((self.c[0] * d_pred, self.c[1] * d_pred)), self.k),
                _scatter(np.concatenate((w, noise)), np.concatenate((d_real[:, None] * pred, d_false.T @ pred)), self.k),
                np.stack(((d_pred * near).sum(axis=0), (d_pred * far).sum(axis=0))),
                (np.bincount(w, d_real, self.k) + np.bincount(noise, d_false.sum(axis=0), self.k)).astype(np.float32),
            ]
            for x, g, s in zip(self.parameters(), grads, self.sums, strict=True):
                s += g * g
                x -= np.float32(rate) * g / np.sqrt(s)

    def normalisers(self) -> np.ndarray:
        """Log of the summed scores after each pair of classes, ``[two, one]``; START is never predicted."""
        return np.stack([self._normaliser(self.c[0] * self.r + self.c[1] * self.r[two]) for two in range(self.k)])

    def _normaliser(self, pred: np.ndarray) -> np.ndarray:
        s = pred @ self.q.T + self.b
        s[:, START] = -np.inf
        top = s.max(axis=1)
        return top + np.log(np.exp(s - top[:, None]).sum(axis=1))

    def log_probability(self, code: np.ndarray, normaliser: np.ndarray | None = None) -> np.ndarray:
        """Natural logarithms, by a table of :meth:`normalisers` or by normalising each."""
        w, one, two = code % self.k, code // self.k % self.k, code // self.k**2
        pred = self.c[0] * self.r[one] + self.c[1] * self.r[two]
        below = normaliser[two, one] if normaliser is not None else self._normaliser(pred)
        return (pred * self.q[w]).sum(axis=1) + self.b[w] - below


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scatter(rows: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of ``values`` that go to each class."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    out = np.zeros((k, values.shape[1]), dtype=np.float32)
    out[rows[start]] = np.add.reduceat(values[order], start, axis=0)
    return out


def _round(code: np.ndarray, n: np.ndarray, rnd: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams in a random order with weights of mean 1; common ones come several times, their count dealt to the places."""
    times = np.maximum(1, -(-n // max(1, int(n.sum()) // PLACES)))
    order = rnd.permutation(int(times.sum()))
    weight = np.repeat(n / times, times)[order]
    return np.repeat(code, times)[order], weight / weight.mean()


def _train_batches(model, rate: float, number: int):
    """What the part makes of the model given, by all of its trigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.value[0]).with_parameters(model.value[1])
        rnd = np.random.Generator(np.random.PCG64(7 + number))
        seen = 0
        for code, n in _parts(batches):
            seen += int(n.sum())
            codes, weights = _round(code, n, rnd)
            own.train(codes, rnd, rate, weights)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([own.flat().tobytes()], pa.binary())], names=["n", "parameters"])

    return run


def _gain_batches(model):
    """The likelihood of all trigrams, a row for each batch; those after one pair of classes come together, so each normaliser is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.value[0]).with_parameters(model.value[1])
        for code, n in _parts(batches):
            pair, at = np.unique(code // own.k, return_inverse=True)
            below = np.empty(len(pair))
            for i in range(0, len(pair), BATCH):
                one, two = pair[i : i + BATCH] % own.k, pair[i : i + BATCH] // own.k
                below[i : i + BATCH] = own._normaliser(own.c[0] * own.r[one] + own.c[1] * own.r[two])
            gain = 0.0
            for i in range(0, len(code), 1 << 16):
                some = code[i : i + (1 << 16)]
                w, one, two = some % own.k, some // own.k % own.k, some // own.k**2
                score = ((own.c[0] * own.r[one] + own.c[1] * own.r[two]) * own.q[w]).sum(axis=1) + own.b[w]
                gain += float((n[i : i + (1 << 16)] * (score - below[at[i : i + (1 << 16)]])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())], pa.int64()), pa.array([gain])], names=["n", "gain"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        held.append((batch.column("code").to_numpy(), batch.column("c").to_numpy()))
        size += batch.num_rows
        if size >= PART:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def trained(trigrams: DataFrame, share: np.ndarray, rounds: int = ROUNDS, by_pair: DataFrame | None = None) -> Model:
    """Averages of what the parts learn, round after round; the one with the best likelihood of all trigrams.

    ``by_pair`` has the same trigrams, those after one pair of classes together; without it ``trigrams`` is read for the likelihood.
    """
    spark = trigrams.sparkSession
    now = best = Model(share)
    least = -np.inf
    for k in range(rounds + 1):
        given = spark.sparkContext.broadcast((share, now.flat()))
        rows = (trigrams if by_pair is None else by_pair).mapInArrow(tidied(_gain_batches(given)), "n long, gain double").collect()
        total = sum(r["n"] for r in rows)
        if not total:
            break
        gain = sum(r["gain"] for r in rows) / total
        if gain > least:
            best, least = now, gain
        if k < rounds:
            rows = trigrams.mapInArrow(tidied(_train_batches(given, RATE / (1 + k) ** 0.5, k)), "n long, parameters binary").collect()
            flat = sum(np.frombuffer(r["parameters"], dtype=np.float32).astype(np.float64) * (r["n"] / total) for r in rows)
            now = now.with_parameters(flat)
        given.unpersist()
    return best


def _score_batches(tables, id_type: T.DataType):
    """One row for each text: what its vocabulary words add up to, and its other words for the join.

    ``gain`` is the score without the other words' shares of their class.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cls_of, base_of, share_of, model, normaliser = tables.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, stop, raw, at in text_pieces(batch.column("text"), PIECE):
                n = stop - first
                row, word = _with_ends(raw, at, n)
                place, common = vocabulary(word)
                cls = np.where(common, cls_of[place], OTHER).astype(np.int64)
                code, back = np.unique(_trigrams(cls, row, model.k), return_inverse=True)
                log_p = model.log_probability(code, normaliser)[back].astype(np.float64) / np.log(10) + np.where(common, share_of[place], 0.0)
                own = np.where(common, base_of[place], 0.0)
                rare = np.flatnonzero(~common)
                order = rare[np.lexsort((word[rare], row[rare]))]
                cut = np.flatnonzero(np.concatenate(([True], (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])))) if len(order) else np.empty(0, dtype=np.int64)
                times = np.diff(np.concatenate((cut, [len(order)])))
                bounds = np.concatenate(([0], np.cumsum(np.bincount(row[order[cut]], minlength=n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + n)),
                        take(batch, "id", np.arange(first, stop)),
                        take(batch, "held_out", np.arange(first, stop)),
                        pa.array(np.bincount(row, minlength=n)),
                        pa.array(np.bincount(row, common, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(row, own, minlength=n)),
                        pa.array(np.bincount(row, log_p, minlength=n)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(word[order[cut]].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))),
                    ],
                    names=["row", "id", "held_out", "n_tokens", "known", "base", "gain", "words", "times"],
                )
                number += n

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "known")), *(T.StructField(x, T.DoubleType()) for x in ("base", "gain")), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])
    return run, schema


class Smoothed:
    """log10((c + 0.1) / (N + 0.1 * (V + 1)))"""

    def __init__(self, tokens: int, words: int):
        self.below = tokens + 0.1 * (words + 1)

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / self.below)


def _vocabulary(counts: DataFrame, n_frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of words seen at least twice, commonest first: as many levels of counts as fit."""
    level = F.floor(F.log2("c") * 8).cast("int")
    least, total = None, 0
    for r in counts.where("c > 1").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        total += r["n"]
        if total > n_frequent:
            break
        least = r["level"]
    top = counts.where((F.col("c") > 1) & (level >= least) if least is not None else F.lit(False)).toArrow()
    word, c = top.column("word").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.lexsort((word, -c))
    return word[order], c[order]


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 10, n_single: int = SINGLE, n_groups: int = GROUPS, n_frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """One row for each input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Texts whose id's CRC-32, as text, is a multiple of ``held_out_of`` are held out of training.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.crc32(own.cast("binary")) % held_out_of == 0).alias("held_out"), F.col(text_col).alias("text"))
    training = base.where("not held_out").select("text")

    counts = written(training.mapInArrow(tidied(_word_batches), "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("c") == 1, 1)), F.lit(0))).first()
    tokens, words, once = (int(x) for x in sums)
    smoothed = Smoothed(tokens, words)
    word, c = _vocabulary(counts, n_frequent)
    cls, k = _classes(training, word, c, n_single, n_groups)
    vocabulary = Lookup(word, np.arange(len(word), dtype=np.int32))
    # The unseen word's part of its class, by the tokens that would be unseen, or in the class, were each left out in turn.
    outside = tokens - int(c.sum())
    least = int(c.min()) if len(c) else 0
    unseen = (once + 0.5) / (outside + least * int((c == least).sum()) + 1) if outside else 1.0
    share = np.full(k, 0.5) + np.bincount(cls, weights=c, minlength=k)
    share[OTHER] += outside
    share[START] = 1e-9
    share /= share.sum()
    base_of = smoothed(c.astype(np.float64))
    share_of = base_of - np.log10(np.maximum(np.bincount(cls, weights=10.0**base_of, minlength=k), 1e-300))[cls]

    shared = spark.sparkContext.broadcast((vocabulary, cls))

    def trigrams_of(row: np.ndarray, words: np.ndarray) -> np.ndarray:
        at, known = shared.value[0](words)
        return _trigrams(np.where(known, shared.value[1][at], OTHER).astype(np.int64) if len(word) else np.full(len(words), OTHER, dtype=np.int64), row, k)

    trigrams = written(training.mapInArrow(tidied(_coded(trigrams_of)), "code long, c long").groupBy("code").agg(F.sum("c").alias("c")), "trigrams")
    parts = min(PARTS, -(-max(trigrams.count(), 1) // PART))
    spread = written(trigrams.repartition(parts, F.xxhash64("code")), "parts")
    by_pair = written(trigrams.repartition(F.expr(f"code div {k}")), "pairs")
    drop_written(trigrams)
    model = trained(spread.coalesce(parts), share, rounds, by_pair)
    drop_written(spread, by_pair)
    if not len(word):
        cls, base_of, share_of = np.zeros(1, dtype=np.int32), np.zeros(1), np.zeros(1)
    tables = spark.sparkContext.broadcast((vocabulary, cls, base_of, share_of, model, model.normalisers()))
    run, schema = _score_batches(tables, base.schema["id"].dataType)
    rows = written(base.mapInArrow(tidied(run), schema), "scores")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(counts, "word", "left")
    seen = F.col("c") > 0
    below = F.lit(smoothed.below)
    found = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / below)).alias("rare_base"),
        F.sum(F.when(seen, F.col("times") * F.log10((F.col("c") + 0.1) / below))).alias("seen_base"),
        F.sum(F.when(seen, F.col("times"))).alias("rare_known"),
    )
    out = rows.drop("words", "times").join(found, "row", "left")
    whole = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    known = F.coalesce("rare_known", F.lit(0)) + F.col("known")
    # Words outside of the vocabulary share what the unseen word leaves of their class.
    left = float(np.log10((outside + 0.1 * (words - len(c))) / smoothed.below)) if outside else 0.0
    inside = F.coalesce("seen_base", F.lit(0.0)) + F.coalesce("rare_known", F.lit(0)) * F.lit(float(np.log10(max(1 - unseen, 1e-300))) - left)
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        whole.alias("base_score"),
        (F.col("gain") + inside + (F.col("n_tokens") - known) * F.lit(float(np.log10(unseen)))).alias("score"),
    )
