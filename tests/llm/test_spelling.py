import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftgrid.llm import spelling

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def near(a, b):
    """One inserted, deleted or replaced code point, by trying all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(vocab, ratio=5):
    """(word, n, n_near, form, form_n, root) by comparing all words."""
    found, form = {}, {}
    for w in vocab:
        found[w] = [v for v in vocab if near(w, v)]
        if found[w]:
            best = min(found[w], key=lambda v: (-vocab[v], v))
            if vocab[best] >= ratio * vocab[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n, len(found[w]), form.get(w), vocab.get(form.get(w)), root(w)) for w, n in vocab.items()}


def made(seed, n, letters="ab", sizes=(6, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(n)}
    return {w: rng.choice([5, 6, 24, 25, 26, 130, 700, 5000]) for w in words}


@pytest.mark.parametrize("seed,letters,n", [(0, "ab", 150), (1, "abcé", 300), (2, "aé", 90), (3, "abcdefgh", 200)])
def test_blocks_find_all_near_words(seed, letters, n):
    vocab = made(seed, n, letters)
    for s in range(6, 9):
        words = np.array(sorted(w for w in vocab if len(w) in (s, s + 1)), object)
        if not len(words):
            continue
        counts = np.array([vocab[w] for w in words], np.int64)
        for block in (7, 64, 1000):
            got = spelling.search(words, counts, s, 0, s + 1, block)
            want = {}
            for w in words:
                # Two words that are both longer belong to the next length.
                others = [v for v in words if near(w, v) and min(len(w), len(v)) == s]
                if others:
                    best = min(others, key=lambda v: (-vocab[v], v))
                    want[w] = (len(others), vocab[best], best)
            assert {r.word: (r.n_near, r.best_n, r.best) for r in got.itertuples()} == want


@pytest.mark.parametrize("crowd,block", [(16_384, 2048), (40, 16), (3, 5)])
def test_groups_equal_brute_force(spark, crowd, block):
    vocab = made(5, 160, "abé") | made(6, 120, "a", (6, 14)) | made(7, 200, "ab", (6, 8))
    # A stem that most words share, so that its files are crowded.
    vocab |= {"gemein" + w: n for w, n in made(8, 150, "abc", (1, 5)).items()}
    vocab |= {w + "gemein": n for w, n in made(9, 150, "abc", (1, 5)).items()}
    # A chain of forms.
    vocab |= {"kettena": 5, "kettenab": 25, "kettenabc": 125, "kettenabcd": 625, "kettenabcde": 3125, "kettenabcdef": 20000}
    rows = spark.createDataFrame(list(vocab.items()), "word string, n long")
    settings = spelling.Settings(crowd=crowd, block=block)
    got = spelling.group(rows, settings).select("word", "n", "n_near", "form", "form_n", "root")
    assert {tuple(r) for r in got.collect()} == brute(vocab)
    assert any(r.root == "kettenabcdef" and r.word == "kettena" for r in got.collect())


def test_every_pair_meets_in_exactly_one_file(spark):
    vocab = made(3, 150, "ab", (6, 8))
    rows = spark.createDataFrame(list(vocab.items()), "word string, n long")
    for crowd in (10_000, 20, 2):
        filed = spelling.filed(rows, spelling.Settings(crowd=crowd)).collect()
        files = defaultdict(set)
        for r in filed:
            files[(r.s, r.low, r.high, r["head"], r.tail)].add(r.word)
        for key, words in files.items():
            assert len(words) <= crowd or key[2] - key[1] == 1
        met = Counter()
        for (s, low, high, *_), words in files.items():
            for a in words:
                for b in words:
                    if a < b and near(a, b) and min(len(a), len(b)) == s:
                        first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), s)
                        met[(a, b)] += low <= first < high
        assert met == Counter({(a, b): 1 for a in vocab for b in vocab if a < b and near(a, b)})


def words_of(rows, one_in):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_whole_texts(spark):
    rng = random.Random(1)
    stems = ["Straße", "STRASSE", "Überall", "ÜBERALL", "letters", "LETTERS", "fünfÿÿ", "x×y÷zz", "abcdef", "abcdeg"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice([",", "", "1", "ſ", "́"]) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    rows += [(None, "abcdef " * 9), (5, None), (6, ""), (7, "123 !"), (8, "wörtlich " * 5000), (8, "wörtlich")]
    docs = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int")
    for one_in in (3, 199):
        got = spelling.variants(docs, one_in=one_in).select("word", "n", "n_near", "form", "form_n", "root")
        vocab = words_of(rows, one_in)
        assert {tuple(r) for r in got.collect()} == brute(vocab)


def test_query_on_a_table(spark):
    from driftgrid.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_spelling_variants"](spark, sf)
    want = {(w, form, root, n, k, m) for w, n, k, form, m, root in brute(words_of(rows, 199))}
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want


def test_no_words(spark, empty):
    assert spelling.variants(empty("doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few words")], "doc_id long, text string")).count() == 0
