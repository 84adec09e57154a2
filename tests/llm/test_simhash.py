import random

import numpy as np
import pytest
import xxhash

from driftgrid.llm import simhash as S
from driftgrid.llm.components import components


def slow_fingerprint(text, size):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps, distance):
    up = {f: f for f in fps}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    keys = list(up)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= distance:
                up[find(a)] = find(b)
    return {f: find(f) for f in keys}


TEXTS = [None, "", " \t\n", "One", "a b c d", "A B  C\nD", "é É x y z", "x" * 300, "w " * 20_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    got = S.fingerprint(text, 1, 4)
    assert int.from_bytes(got, "big") == slow_fingerprint(text, 4)


def test_gray_ranks_are_inverted_and_neighbours_differ_in_one_bit():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, (500, 4)).astype(np.uint64)
    assert np.array_equal(S.gray_code(S.gray_rank(codes)), codes)
    ranks = np.arange(1000, dtype=np.uint64).reshape(-1, 1)
    steps = S.gray_code(ranks)
    assert np.all(np.bitwise_count(steps[1:] ^ steps[:-1]) == 1)


@pytest.mark.parametrize("words,distance", [(1, 4), (1, 12), (4, 45)])
def test_tree_links_what_nested_loops_link(words, distance):
    rng = np.random.default_rng(words * distance)
    base = rng.integers(0, 2**63, (30, words)).astype(np.uint64)
    codes = np.repeat(base, 20, axis=0)
    for row in codes:
        for _ in range(rng.integers(0, distance)):
            b = int(rng.integers(0, 64 * words))
            row[b // 64] ^= np.uint64(1 << (b % 64))
    codes = np.unique(codes, axis=0)
    codes = codes[np.lexsort(S.gray_rank(codes).T[::-1])]
    forest = S.Forest(len(codes))
    tree = S.Tree(codes)
    S.link(forest, tree, tree, 0, distance, True)
    whole = [int.from_bytes(r, "big") for r in S._rows(codes)]
    want = slow_classes(whole, distance)
    got = forest.find(np.arange(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            assert (got[i] == got[j]) == (want[whole[i]] == want[whole[j]])
    # Two halves of unequal height, linked across.
    a, b = codes[:7], codes[7:]
    cross = S.Forest(len(codes))
    S.link(cross, S.Tree(a), S.Tree(b), len(a), distance, False)
    found = cross.find(np.arange(len(codes)))
    for i in range(len(a)):
        for j in range(len(a), len(codes)):
            if (whole[i] ^ whole[j]).bit_count() <= distance:
                assert found[i] == found[j]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{n: 100 for n in [100, *range(200, 500)]}}


def made_texts(n=60):
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(500)]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(words))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    return texts


def test_classes_equal_nested_loops(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)  # buckets of several blocks
    texts = made_texts() + TEXTS + ["a b c d"] * 30
    rows = [(i, t, "x", b"y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp binary")
    got = {r.doc_id: r for r in S.near_duplicates(docs, S.exact_scheme()).collect()}
    fps = [slow_fingerprint(t, 4) for t in texts]
    want = slow_classes(fps, 4)
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(want[f], i)
    assert len(got) == len(texts)
    for i, f in enumerate(fps):
        assert int.from_bytes(got[i].fp, "big") == f
        assert got[i].component_id == least[want[f]]


def test_null_ids_repeated_rows_and_no_rows(spark, empty):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "a b"), (5, "a b"), (None, "q")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in S.near_duplicates(docs, S.exact_scheme()).collect())
    assert got == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "5"), ("None", "None")]
    none = empty("doc_id long, text string")
    assert S.near_duplicates(none, S.exact_scheme()).count() == 0
    assert S.drop_copies(none).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(9)
    rows, groups = [], 0
    for g in range(25):
        words = ["t%d" % rng.randrange(4000) for _ in range(300)]
        groups += 1
        for _ in range(rng.randint(1, 5)):
            near = list(words)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(300)] = "z%d" % rng.randrange(99)
            rows.append((len(rows), " ".join(near), g))
    passage = " ".join("p%d" % i for i in range(60))
    for g in range(100, 106):  # a shared passage makes no copy
        own = " ".join("o%d" % rng.randrange(9000) for _ in range(250))
        rows.append((len(rows), own + " " + passage, g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = S.drop_copies(docs).collect()
    assert sorted(r.row for r in kept) == [*range(groups), *range(100, 106)]
    first = {}
    for i, _, g in rows:
        first.setdefault(g, i)
    assert sorted(r.doc_id for r in kept) == sorted(first.values())


def test_groups_of_null_ids_stay_apart(spark):
    texts = [" ".join(f"{c}{i}" for i in range(80)) for c in "abc"]
    rows = [(None, t) for t in texts for _ in range(3)] + [(4, texts[0] + " x"), (4, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = S.drop_copies(docs).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("4", "a"), ("4", "b"), ("None", "c")]


def slow_kept(sets, similarity):
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                low, high = sorted((find(i), find(j)))
                up[high] = low
    return [i for i in range(len(sets)) if find(i) == i]


@pytest.mark.parametrize("part", [1024, 3])
def test_links_are_verified_by_whole_sets(spark, monkeypatch, part):
    monkeypatch.setattr(S, "PART_TEXTS", part)
    rng = random.Random(12)
    texts = []
    for g in range(40):  # pairs of a similarity of 0.6 to 0.95, chains among them
        words = ["g%dw%d" % (g, i) for i in range(200)]
        for k in range(5):
            texts.append(" ".join(words))
            for at in rng.sample(range(0, 200, 5), rng.choice([1, 3, 4, 6, 8])):
                words[at] = "x%d" % rng.randrange(10**6)
    line = " ".join("r%d" % i for i in range(12))
    for k in range(4):  # one long repeated line is one line
        texts.append(" ".join([line] * 30 + ["k%dv%d" % (k, i) for i in range(40)]))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in S.drop_copies(docs).collect()) == slow_kept(sets, 0.8)


def test_tables_find_as_much_at_any_size():
    share = np.arccos(1.6 / 1.8) / np.pi
    for n in (10**3, 10**5, 15 * 10**6):
        scheme = S.similarity_scheme(n)
        drawn = np.random.default_rng(1).random((4000, 256)) < share
        found = np.zeros(4000, bool)
        for bits in scheme.tables:
            found |= ~drawn[:, list(bits)].any(axis=1)
        assert (found & (drawn.sum(axis=1) <= scheme.distance)).mean() > 0.97
