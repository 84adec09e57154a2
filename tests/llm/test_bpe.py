import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from driftgrid.llm import bpe

TRICKY = [
    "",
    "a  b\n\n c \t d",
    "'S 's it's we'LL we'll",
    "x\x1c\x1dy \x1e z",
    "²½Ⅷ 3² a²b ١٢٣",
    "_foo __ bar_1",
    "日本語テスト１２３　全角 ",
    "नमस्ते \x85a\x85 b\xa0 c",
    "😀😀 a😀",
    "aaaa" * 5000,
    "ab" * 30_000,
    "-" * 3000,
    "\U00016b54 𝟘𝟙 𝔸 ㊀",
    "\x00\x01",
]


@pytest.fixture(scope="module")
def library():
    encoder, _ = bpe.load(bpe.RANKS)
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={}
    )


def made():
    rng = random.Random(5)

    def char():
        return chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0xE000, 0x20000)]))

    return ["".join(rng.choice([char(), " ", "\n", "'s"]) for _ in range(rng.randrange(50))) for _ in range(800)]


def test_ids_are_those_of_the_library(spark, library):
    texts = TRICKY + made()
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    got = docs.select("doc_id", bpe.encode(F.col("text")).alias("n")).withColumn("back", bpe.decode(F.col("n")))
    for r in got.collect():
        text = texts[r.doc_id] if r.doc_id >= 0 else ""
        assert r.n == library.encode_ordinary(text)
        assert bytes(r.back) == text.encode()


def test_a_small_memory_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe.Encoder, "KEPT", 10)
    encoder = bpe.Encoder(bpe.load(bpe.RANKS)[0].ranks)
    for t in TRICKY * 2:
        assert encoder.block([t, t])[1].tolist() == library.encode_ordinary(t)


@pytest.mark.parametrize("wide", [1, 4, 10**9])
def test_wide_and_narrow_buckets_give_the_same(monkeypatch, library, wide):
    monkeypatch.setattr(bpe.Encoder, "WIDE", wide)
    encoder = bpe.Encoder(bpe.load(bpe.RANKS)[0].ranks)
    texts = TRICKY + made()
    got = encoder.block(texts)
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]


def test_queue_gives_ranks_in_order():
    rng = random.Random(3)
    queue = bpe.RankQueue(300_000)
    ranks = [rng.randrange(300_000) for _ in range(2000)]
    for i, r in enumerate(ranks):
        queue.push(r, i)
    out = []
    while (r := queue.least()) >= 0:
        out += [r] * len(queue.buckets[r])
        queue.buckets[r].clear()
        queue.drop(r)
    assert out == sorted(ranks) and not queue.buckets


def test_no_rows(spark, empty):
    assert empty("text string").select(bpe.decode(bpe.encode(F.col("text")))).count() == 0


def test_digests_in_one_pass(spark, library):
    texts = TRICKY + made() + ["long words " * 60_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (-1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (2 << 20, 100):
        got = {r.doc_id: r for r in bpe.digests(docs, limit=limit).collect()}
        assert len(got) == len(rows)
        for doc_id, text in rows:
            ids, r = library.encode_ordinary(text or ""), got[doc_id]
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0
