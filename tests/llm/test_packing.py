import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from driftgrid.llm import packing


def check_plan(plan, counts, capacity):
    got = Counter()
    for filling, times in plan.fillings:
        assert times > 0 and sum(x * k for x, k in filling) <= capacity
        for x, k in filling:
            got[x] += k * times
    assert got == Counter({x: n for x, n in counts.items() if n})


def least_by_search(sizes, capacity):
    """The true least number of sequences, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= sizes[i]:
                left = list(rooms)
                left.remove(room)
                place(i + 1, [*left, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_small_plans_are_optimal(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(3, 20) for _ in range(rng.randint(1, 9))]
    counts = Counter(sizes)
    plan = packing.complete(counts, 30)
    check_plan(plan, counts, 30)
    assert plan.sequences == least_by_search(sizes, 30)
    assert packing.least_sequences(counts, 30) <= plan.sequences


@pytest.mark.parametrize("seed", range(4))
def test_large_plans(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 2048), 700, 1]) for _ in range(20_000))
    plan = packing.complete(counts, 2048, nodes=50)
    check_plan(plan, counts, 2048)
    assert plan.sequences <= packing.best_fit(counts, 2048).sequences
    check_plan(packing.best_fit(counts, 2048), counts, 2048)


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 5000])
def test_only_the_first_piece_is_short(n):
    cuts = packing.cut(np.zeros(n), 2048)
    assert cuts[0][0] == 0 and cuts[-1][1] == n
    assert [b for _, b in cuts[:-1]] == [a for a, _ in cuts[1:]]
    assert all(b - a == 2048 for a, b in cuts[1:]) and 0 < cuts[0][1] <= 2048


def test_pieces_and_places(spark):
    rng = random.Random(8)
    texts = [None, "", "<|endoftext|> x", "a" * 9000, "日本 " * 900]
    texts += [" ".join("word%d" % rng.randrange(50) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    texts += ["same text here"] * 40
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {r[0] for r in rows}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)[:: 2 if i == 3 else 1]
        assert [x for r in pieces for x in r.ids] == ids
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) >= -(-sum(r.length for r in got) // 2048)


def test_no_rows(spark, empty):
    assert packing.pack(empty("doc_id long, text string")).count() == 0
