import numpy as np
from pyspark.sql import functions as F

from driftgrid.llm import ann


def slow(rows, k=5, every=50):
    """Nearest by plain loops over the usable rows."""
    usable = {}
    for i, v in rows:
        ok = i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        if ok:
            usable[i] = np.array(v, np.float32).astype(np.float64)
    out = {}
    for q, a in usable.items():
        if q % every:
            continue
        near = []
        for i, b in usable.items():
            if i != q and len(b) == len(a):
                near.append((float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i))
        out[q] = sorted(near, key=lambda e: (-e[0], e[1]))[:k]
    return out


def frame(spark, rows):
    full = [(i, v, 1) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, rank int")


def made(n=700, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d)) * 3
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d))
    return [(i, x[i].astype(np.float32).tolist()) for i in range(n)]


def test_exact_in_one_partition_with_odd_rows(spark):
    rows = made(300)
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # copies and ties
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [])]
    rows += [(1200, [1.0, 2.0]), (1201, [2.0, 1.0]), (None, rows[0][1])]
    rows[5] = (5, [None, *rows[5][1][1:]])
    small = ann.Settings(block=64, query_block=3)
    got = {}
    for r in ann.nearest(frame(spark, rows + rows[:20]), F.col("vec_id") % 50 == 0, settings=small).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {q: near for q, near in slow(rows).items() if near}
    assert set(got) == set(want)
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert [i for _, i, _ in mine] == [i for _, i in near]
        assert np.allclose([s for _, _, s in mine], [s for s, _ in near], atol=1e-12)


def test_recall_over_many_partitions(spark):
    rows = made(3000)
    some = ann.Settings(rows=200, sample=1500, epochs=15)
    router = ann.fit(np.array([v for _, v in rows[:1500]], np.float64), 3000, some)
    assert router.parts == 16 and router.probes < 16
    found = ann.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, settings=some).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = slow(rows)
    hits = sum(len(got[q] & {i for _, i in near}) for q, near in want.items())
    assert hits / (5 * len(want)) >= 0.9


def test_partitions_are_balanced():
    x = ann._unit(np.array([v for _, v in made(1600)], np.float64))
    part = ann.partition(ann.neighbour_graph(x, 10), 8, 1)
    size = np.bincount(part, minlength=8)
    assert size.max() <= 1.1 * 200 + 1 and size.min() >= 100


def test_no_rows(spark, empty):
    none = empty("vec_id long, embedding array<float>")
    assert ann.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
    one = frame(spark, [(50, [1.0, 2.0])])
    assert ann.nearest(one, F.col("vec_id") % 50 == 0).count() == 0
