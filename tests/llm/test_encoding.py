import base64
import os
import random

import pytest

from threadlake.llm import encoding

tiktoken = pytest.importorskip("tiktoken")
PATH = os.path.join(encoding.TOKENIZERS, encoding.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        raw = f.read()
    e = encoding.ForcedBoundaryEncoder(raw)
    return e, tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=e.rank, special_tokens={})


def test_forced_cuts_never_lie_inside_a_token(both):
    e, _ = both
    assert 0.5 < (~e.joined).mean() < 1
    assert all(e.joined[a, b] for t in list(e.rank)[::97] for a, b in zip(t, t[1:]))


def test_same_ids_as_the_public_library(both):
    e, t = both
    rng = random.Random(2)
    letters = " \n\t\r'sStTrevldD.,!?0123456789abcé đàạ😀👩🏽‍💻​\xa0한國ÁỀ<|endoftext|>"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert e.encode(s) == t.encode_ordinary(s)
    for s in ("", "a" * 5000, "ạ" * 3000, " " * 4000, "\n\n \n", "<|endoftext|>", "xyz" * 20000):
        assert e.encode(s) == t.encode_ordinary(s)
        assert b"".join(dict((v, k) for k, v in e.rank.items())[i] for i in e.encode(s)[:50]) == s.encode()[: len(b"".join(dict((v, k) for k, v in e.rank.items())[i] for i in e.encode(s)[:50]))]


def test_query_edge_cases(spark, both):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Chào bạn", "x"), (3, "Chào bạn", "x"), (None, "hi", "x")], "doc_id long, text string, ids string")
    out = sorted(encoding.encode_corpus(d).collect(), key=str)
    by = {r.doc_id: r.ids for r in out}
    assert len(out) == 5 and by[1] == [] and by[2] == [] and by[3] == both[1].encode_ordinary("Chào bạn") and by[None] == both[1].encode_ordinary("hi")
    assert encoding.encode_corpus(d.limit(0)).count() == 0
    assert dict(encoding.encode_corpus(d).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


def test_whole_corpus(spark, data, both):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r.doc_id: r.ids for r in encoding.encode_corpus(docs).collect()}
    assert all(ids[r.doc_id] == both[1].encode_ordinary(r.text or "") for r in docs.collect())
    assert base64.b64decode("YQ==") in both[0].rank
