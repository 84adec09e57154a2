import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftgrid.llm import token_files as tf


@pytest.mark.parametrize("kind", [tf.BYTES, tf.BITS])
@pytest.mark.parametrize("top", [0, 1, 255, 256, 49_407, 2**32 - 1])
def test_blocks_come_back(kind, top):
    rng = np.random.default_rng(top)
    for n in (1, 7, 64, 1000):
        ids = rng.integers(0, top + 1, n).astype("<u4")
        planes = tf.to_planes(ids, kind)
        width = int(ids.max()).bit_length()
        assert len(planes) == (width if kind == tf.BITS else -(-width // 8))
        settings = tf.Settings(kind=kind)
        assert tf.unpack_block(tf.pack_block(ids, settings)).tolist() == ids.tolist()


def written(tmp_path, documents, settings):
    path = f"{tmp_path}/one.planes"
    out = tf.Writer(path, pa.int64(), settings)
    for k in range(0, len(documents), 3):
        some = documents[k : k + 3]
        ids = np.concatenate([np.array(d, "<u4") for d in some])
        out.add(pa.array(range(k, k + len(some))), np.array([len(d) for d in some]), ids)
    out.close()
    return path


@pytest.mark.parametrize("kind", [tf.BYTES, tf.BITS])
def test_file_round_trip_and_spans(tmp_path, kind):
    rng = random.Random(4)
    documents = [[rng.randrange(50_000) for _ in range(rng.choice([0, 1, 5, 300]))] for _ in range(40)]
    path = written(tmp_path, documents, tf.Settings(block=64, kind=kind))
    flat = [i for d in documents for i in d]
    reader = tf.Reader(path)
    assert reader.total == len(flat)
    assert len(reader.places) - 1 == -(-len(flat) // 64)
    for start, end in [(0, 0), (0, 1), (63, 65), (100, 900), (5, 10**9), (10**9, 10**9 + 1)]:
        assert reader.span(start, end).tolist() == flat[start:end]
    for batch in (1, 100, 10**6):
        got = {}
        for docs, ids in reader.documents(batch):
            at = 0
            for row in docs.to_pylist():
                got[row["doc_id"]] = ids[at : at + row["n_tokens"]].tolist()
                at += row["n_tokens"]
            assert at == len(ids)
        assert got == dict(enumerate(documents))


def test_a_span_reads_only_its_blocks(tmp_path):
    path = written(tmp_path, [list(range(1000))], tf.Settings(block=64))
    reader = tf.Reader(path)
    seen = []
    reader.blocks = lambda a, b, whole=reader.blocks: (seen.append((a, b)), whole(a, b))[1]
    assert reader.span(130, 190).tolist() == list(range(130, 190))
    assert seen == [(2, 3)]


def test_damaged_files_are_refused(tmp_path):
    path = written(tmp_path, [[1, 2, 3]], tf.Settings())
    data = bytearray(open(path, "rb").read())
    for at, name in ((0, "magic"), (len(data) - 60, "index"), (len(data) - 1, "end")):
        bad = bytearray(data)
        bad[at] ^= 1
        spot = f"{tmp_path}/{name}"
        open(spot, "wb").write(bad)
        with pytest.raises(Exception):
            tf.Reader(spot)
    open(f"{tmp_path}/short", "wb").write(b"x")
    with pytest.raises(ValueError):
        tf.Reader(f"{tmp_path}/short")


TEXTS = [
    None, "", " ", "\n\n", "One, two. Three", "don't I'LL we've o'clock.", "Árbol, ́x é.", "ΣΑΣ ΟΔΟΣ. ΤΕΛΟΣ,",
    "x),. y!? z;", "mid.dle 3.14, 1,000. ", "İstanbul. ǅ Ǆ", "<|endoftext|> a <|startoftext|>b", "tab\tand\x0bvt\x0cff\rcr\x85nel\xa0nbsp",
    "\x1c\x1d x y　z", "日本語。 テキスト, 한국어. ", "é, ß. µ! ÿ? ª; ²: ¼, _. -, ", "a" * 3000, "ab1" * 900 + ". end", "é" * 200,
    "\x02", "a\x02 \x02b c", "x \x02\x02. y",
    "emoji 👩‍👩‍👧‍👦. flags 🇫🇷, ok", "WORDİ. İ, KK. ſ,",
]


def plain(texts):
    library = Tokenizer.from_file(tf.TOKENIZER)
    return [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_ids_are_those_of_the_library():
    rng = random.Random(9)
    signs = "abcABC .,;:!?'\n\t-_19éÉßÀΣσſİ́̈\xa0\x02‍日"
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    encoder = tf.Encoder(tf.TOKENIZER)
    encoder.KEPT, encoder.TOGETHER = 900, 50  # starts anew several times
    want = plain(texts)
    for low in range(0, len(texts), 50):
        sizes, ids = encoder.encode(texts[low : low + 50], 2)
        ends = np.cumsum(sizes)
        got = [ids[e - n : e].tolist() for e, n in zip(ends, sizes)]
        assert got == want[low : low + 50]


def test_documents_in_order_of_their_ids(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(TEXTS[4:14]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    rows = [(i * 7 - 50, t, 5, "k") for i, t in enumerate(texts)]
    rows += [(None, "no id", 1, None), (3, "the same", 1, "a"), (3, "the same", 2, "b"), (3, "other", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ids int, path string").repartition(5)
    for settings in (tf.Settings(), tf.Settings(block=32, kind=tf.BITS, chars=40, batch=16)):
        files = tf.write(docs, settings=settings)
        listed = files.orderBy("file").collect()
        assert sum(r.n_docs for r in listed) == len(rows)
        assert [r.start for r in listed] == [sum(x.n_ids for x in listed[:k]) for k in range(len(listed))]
        got = sorted(tf.read(files, "bigint", settings).collect(), key=lambda r: (r.start, r.n_tokens))
        order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
        assert order == sorted(order)
        at = 0
        for r in got:
            assert r.start == at and len(r.ids) == 4 * r.n_tokens
            at += r.n_tokens
        want = sorted((r[0] is not None, r[0] or 0, ids) for r, ids in zip(rows, plain([r[1] for r in rows])))
        have = sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in got)
        assert have == want


def test_names_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "z")], "doc_id string, text string")
    got = tf.read(tf.write(docs, end=None), "string").orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in got] == [("a", 0), ("b", 1)]


def test_no_documents(spark, empty):
    files = tf.write(empty("doc_id long, text string"))
    assert files.count() == 0 and tf.read(files, "bigint").count() == 0


def test_query_equals_the_library_on_every_document(spark):
    from driftgrid.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op11_token_files"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    at = 0
    for doc_id in sorted(docs):
        ids = np.array(plain([docs[doc_id]])[0], "<u4")
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
