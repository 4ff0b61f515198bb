import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken

import gneiss.llm.byte_bpe as m

NAME = "byte_bpe_multi_50k.tiktoken"
POOL = list("aabcdeéeinrst  \n\t'.,!?09ßñ日本語🙂  \x1c\x85́ÀΩж") + ["the ", "ing", "'s", "'ll", "12345", " und", "   ", "\r\n", "$$$", "keit"]


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.read_ranks(public_tokenizers.path(NAME)), special_tokens={})


def texts(seed):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 120))) for _ in range(300)]
    made += ["".join(rnd.choice("abcdeinrst") for _ in range(n)) for n in (3, 31, 33, 200, 511, 513, 5000)]
    return made + ["", " ", "a" * 700, "é" * 400, " " * 300, "<|endoftext|>", "the" * 300, "!" * 600]


@pytest.mark.parametrize("remembered", [300_000, 50])
def test_as_tiktoken(theirs, monkeypatch, remembered):
    monkeypatch.setattr(m, "REMEMBERED", remembered)
    own = m.Codec(m.read_ranks(public_tokenizers.path(NAME)), public_tokenizers.PATTERN)
    for seed in range(3):
        made = texts(seed)
        ids, bounds = own.encode(made)
        back, edges = own.decode(ids, bounds)
        for i, t in enumerate(made):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == theirs.encode_ordinary(t), repr(t)
            assert back[edges[i] : edges[i + 1]].tobytes() == t.encode()


def test_long_pieces_as_in_a_matrix(theirs):
    own = m.codec(NAME)
    rnd = random.Random(4)
    for _ in range(200):
        piece = "".join(rnd.choice("ethaindEé") for _ in range(rnd.randint(2, 60))).encode()
        assert own._merge_long(piece).tolist() == own._merge_matrix([piece], -(-len(piece) // 4) * 4)[0].tolist()


def test_pair_table():
    rnd = np.random.default_rng(1)
    pairs = {(int(a), int(b)): i for i, (a, b) in enumerate(rnd.integers(0, 300, (5000, 2)))}
    table = m.PairTable(pairs)
    a, b = np.meshgrid(np.arange(-1, 300, dtype=np.int32), np.arange(-1, 300, dtype=np.int32))
    found = table(a, b)
    assert all(found[i, j] == pairs.get((a[i, j], b[i, j]), np.iinfo(np.int32).max) for i in range(0, 301, 7) for j in range(0, 301, 3))


def test_query(spark, theirs):
    made = [(i, t, [1]) for i, t in enumerate(texts(9))] + [(None, None, []), (3, "again", [])]
    df = spark.createDataFrame(made, "doc_id long, text string, ids array<int>")
    rows = m.encoded(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.ids), bytes(r.decoded)) for r in rows) == sorted((d if d is not None else -1, tuple(theirs.encode_ordinary(t or "")), (t or "").encode()) for d, t, _ in made)
    assert m.encoded(df.limit(0)).count() == 0
