import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm.suffix_dedup import refine, remove_repeats


def brute(texts, window):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - window + 1):
            seen.setdefault(raw[i : i + window], []).append((d, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + window] = True
    out = []
    for raw, g in zip(raws, gone):
        edge = np.diff(np.concatenate(([0], g.astype(np.int8), [0])))
        out.append((len(raw), int(g.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~g])).hexdigest()))
    return out


def result(spark, rows, window, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kept int, id string, runs int")
    out = remove_repeats(df, window=window, **more)
    got = out.select("doc_id", "n_bytes", F.size("spans"), F.sha2("kept", 256), F.octet_length("kept")).collect()
    return sorted((r[0] if r[0] is not None else -1, r[1], r[1] - r[4], r[2], r[3]) for r in got)


def corpus(seed, n, window):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rnd.randint(5, 80))) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.1 and texts:
            texts.append(rnd.choice(texts))
        elif kind < 0.2 and texts:
            t = list(rnd.choice(texts) or "")
            for _ in range(3):
                if t:
                    t[rnd.randrange(len(t))] = "#"
            texts.append("".join(t))
        else:
            parts = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
            for _ in range(rnd.randint(0, 3)):
                parts += [rnd.choice(passages), " ".join(word() for _ in range(rnd.randint(0, 20)))]
            texts.append(" ".join(parts))
    return texts + [None, "", "ab " * window, "x" * (3 * window), "y" * (window - 1), "z" * window, passages[0] * 3]


@pytest.mark.parametrize("window,hot", [(40, 20_000), (40, 2), (64, 3)])
def test_against_brute_force(spark, window, hot):
    texts = corpus(window + hot, 120, window)
    rows = [(i, t, "s", 1, "i", 2) for i, t in enumerate(texts)]
    assert result(spark, rows, window, hot=hot) == sorted((i, *x) for i, x in enumerate(brute(texts, window)))


def test_long_text_in_pieces(spark, monkeypatch):
    import gneiss.llm.suffix_dedup as m

    texts = corpus(5, 30, 40)
    text = np.frombuffer(" ".join(t or "" for t in texts).encode(), dtype=np.uint8)
    whole = m.intervals(text, 40)
    monkeypatch.setattr(m, "PIECE", 1000)
    parts = m.intervals(text, 40)
    own = lambda x: {int(p): int(a) for f, l, a in zip(*x[:3]) for p in range(f, l + 1)}
    assert own(whole) == own(parts)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 26) % 26) for i in range(120))
    rows = [(1, text, "", 0, "", 0), (1, text, "", 0, "", 0), (None, "short", "", 0, "", 0), (None, None, "", 0, "", 0)]
    got = result(spark, rows, 40)
    assert [r[:4] for r in got] == [(-1, 0, 0, 0), (-1, 5, 0, 0), (1, 120, 120, 1), (1, 120, 120, 1)]
    assert result(spark, [], 40) == []


def test_refine_orders_by_content():
    rnd = np.random.default_rng(1)
    text = rnd.integers(97, 99, 600).astype(np.uint8)
    text[300:500] = text[50:250]
    pointer = refine(text, np.full(600, 600), 37)
    grams = {}
    for i in range(600 - 37 + 1):
        grams.setdefault(text[i : i + 37].tobytes(), set()).add(int(pointer[i]))
    assert all(len(x) == 1 for x in grams.values())
    assert len({next(iter(x)) for x in grams.values()}) == len(grams)


def test_texts_without_repeats(spark):
    from gneiss.llm.suffix_dedup import without_repeats

    texts = corpus(7, 80, 40)
    df = spark.createDataFrame([(i, t, "s", 1, "i", 2) for i, t in enumerate(texts)], "doc_id long, text string, first string, kept int, id string, runs int")
    out = without_repeats(df, window=40)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    kept = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in remove_repeats(df, window=40).collect()}
    assert {k: v or "" for k, v in got.items()} == kept and got[texts.index(None)] is None
