"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a small
classifier that routes queries to the most probable partitions for exact ranking."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """``sample`` vectors at most fit the index; all are indexed.

    Partitions are a power of two, about one per ``rows`` vectors, ``most_parts`` at most.
    Queries go to as many partitions as the sample's own neighbours need for a recall of
    ``recall``.  ``block`` and ``query_block`` bound the rows that meet in one group.
    """

    sample: int = 6000
    rows: int = 4000
    most_parts: int = 64
    neighbours: int = 10
    hidden: int = 128
    epochs: int = 30
    recall: float = 0.97
    block: int = 4096
    query_block: int = 2048
    seed: int = 5


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of every unit vector, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for low in range(0, len(x), 1024):
        near = x[low : low + 1024] @ x.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -np.inf
        out[low : low + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _halves(rows: np.ndarray, cols: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two equal halves of a graph along its second eigenvector, by power iteration."""
    degree = np.maximum(np.bincount(rows, minlength=n) + np.bincount(cols, minlength=n), 1)
    scale = 1 / np.sqrt(degree)
    trivial = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
    v = rng.normal(size=n)
    for _ in range(60):
        v -= trivial * (trivial @ v)
        s = v * scale
        spread = np.bincount(rows, s[cols], n) + np.bincount(cols, s[rows], n)
        v = 0.5 * (v + spread * scale)
        v /= np.linalg.norm(v) + 1e-30
    half = np.zeros(n, np.int64)
    half[np.argsort(v, kind="stable")[n // 2 :]] = 1
    return half


def partition(graph: np.ndarray, parts: int, seed: int, slack: float = 0.1) -> np.ndarray:
    """A balanced partition of the graph that cuts few edges: halves of halves, then moves
    of single vertices to the part most of their neighbours are in, while it has room."""
    rng = np.random.default_rng(seed)
    n = len(graph)
    rows, cols = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    part = np.zeros(n, np.int64)
    for _ in range(int(log2(parts))):
        fresh = np.zeros(n, np.int64)
        for p in range(part.max() + 1):
            own = np.flatnonzero(part == p)
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            inside = (at[rows] >= 0) & (at[cols] >= 0)
            fresh[own] = 2 * p + _halves(at[rows[inside]], at[cols[inside]], len(own), rng)
        part = fresh
    room = int(ceil((1 + slack) * n / parts))
    size = np.bincount(part, minlength=parts)
    both = [[] for _ in range(n)]
    for a, b in zip(rows.tolist(), cols.tolist(), strict=True):
        both[a].append(b)
        both[b].append(a)
    for _ in range(4):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and size[best] < room:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer and a softmax over partitions; ``probes`` partitions are searched."""

    first: np.ndarray
    offset: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.bias)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(_unit(x) @ self.first + self.offset, 0) @ self.second + self.bias

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def _classifier(x: np.ndarray, target: np.ndarray, s: Settings) -> Router:
    """Cross-entropy against the share of each vector's neighbours per partition."""
    rng = np.random.default_rng(s.seed)
    d, m = x.shape[1], target.shape[1]
    net = [
        rng.normal(0, np.sqrt(2 / d) * 2, (d, s.hidden)),
        np.zeros(s.hidden),
        rng.normal(0, 0.05, (s.hidden, m)),
        np.zeros(m),
    ]
    mean, square, t = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], 0
    for epoch in range(s.epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(x), 128):
            at = order[low : low + 128]
            h = np.maximum(x[at] @ net[0] + net[1], 0)
            z = h @ net[2] + net[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[at]) / len(at)
            back = (g @ net[2].T) * (h > 0)
            grads = [x[at].T @ back, back.sum(0), h.T @ g, g.sum(0)]
            t += 1
            rate = 0.003 * (1 - epoch / s.epochs)
            for k, grad in enumerate(grads):
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad * grad
                step = mean[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
                net[k] = net[k] - rate * step
    return Router(*net, probes=1)


def fit(vectors: np.ndarray, total: int, s: Settings) -> Router:
    """Partition a sample, learn to route, and find how many partitions a query needs.

    The last is measured on a fifth of the sample that takes no part in the fit, against
    its true neighbours in the sample.
    """
    x = _unit(np.unique(vectors, axis=0))
    x = x[np.random.default_rng(s.seed).permutation(len(x))]
    wanted = max(1, total // s.rows)
    parts = min(s.most_parts, 1 << max(0, ceil(log2(wanted))), 1 << max(0, int(log2(max(1, len(x) // 60)))))
    if parts == 1:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    held, base = x[: len(x) // 5], x[len(x) // 5 :]
    graph = neighbour_graph(base, s.neighbours)
    part = partition(graph, parts, s.seed)
    share = np.zeros((len(base), parts))
    np.add.at(share, (np.repeat(np.arange(len(base)), graph.shape[1]), part[graph].ravel()), 1)
    share[np.arange(len(base)), part] += 2
    router = _classifier(base, share / share.sum(axis=1, keepdims=True), s)
    home = router.home(base)
    near = np.argsort(-(held @ base.T), axis=1)[:, :5]
    router.probes = parts
    routes = router.routes(held)
    place = (routes[:, None, :] == home[near][:, :, None]).argmax(axis=2)
    for probes in range(1, parts + 1):
        if (place < probes).mean() >= s.recall:
            router.probes = probes
            break
    return router


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    finite = F.forall(
        vector,
        lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))),
    )
    some = F.exists(vector, lambda c: c != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & some, F.lit(False))


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack(list(values)).astype(np.float64)


def _rank_block(k: int):
    """Best k of one block of vectors for one block of queries, by exact cosine."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(vectors) or not len(queries):
            return none.astype({"query_id": np.int64, "vec_id": np.int64, "score": np.float64})
        ids = vectors["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _stack(vectors["v"])[order]
        # Copies of a vector are ranked once; of their ids the least can be in a result.
        unique, group = np.unique(x, axis=0, return_inverse=True)
        group = group.ravel()
        by_group = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by_group], np.arange(len(unique) + 1))
        norms = np.sqrt((unique * unique).sum(axis=1))
        units = unique / norms[:, None]
        q = _stack(queries["v"])
        out = []
        for low in range(0, len(q), 256):
            near = _unit(q[low : low + 256]) @ units.T
            top = min(len(unique), k + 1)
            least = np.partition(near, len(unique) - top, axis=1)[:, len(unique) - top]
            for row, (a, bound) in enumerate(zip(q[low : low + 256], least, strict=True)):
                own = int(queries["vec_id"].iloc[low + row])
                norm = np.sqrt((a * a).sum())
                found: dict[int, float] = {}
                for g in np.flatnonzero(near[row] >= bound - 1e-9).tolist():
                    score = float((a * unique[g]).sum() / (norm * norms[g]))
                    members = ids[by_group[starts[g] : starts[g + 1]]]
                    for i in np.unique(members)[: k + 1].tolist():
                        if i != own:
                            found[i] = max(score, found.get(i, -2.0))
                best = sorted(found.items(), key=lambda e: (-e[1], e[0]))[:k]
                out += [(own, i, score) for i, score in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    settings: Settings = Settings(),
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found for each query.

    ``is_query`` is a condition on the column ``vec_id``.  Nearness is the cosine in double
    precision; ties go to the lesser id.  Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without an id, take no part; vectors of another length
    than the query's are no candidates.  Rows with the query's id are the query itself;
    repeated rows count once.  Fewer candidates give fewer rows, an empty table none.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{embedding}`")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("d", F.size("v"))
    lengths = {r.d: r.n for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()}
    main, total = next(iter(lengths.items()), (0, 0))
    sample = rows.where(F.col("d") == main).orderBy(F.xxhash64("vec_id"), "vec_id")
    points = [r.v for r in sample.select("v").limit(settings.sample).collect()]
    router = fit(np.array(points, np.float64), total, settings) if points else None
    shared = spark.sparkContext.broadcast(router)  # its size is set by the settings

    @F.pandas_udf("array<int>")
    def routes(values: pd.Series) -> pd.Series:
        out = np.zeros((len(values), shared.value.probes), np.int32)
        long_ = values.map(len).to_numpy() == main
        if long_.any():
            out[long_] = shared.value.routes(_stack(values[long_]))
        # Other lengths have one partition each.
        return pd.Series([list(o) if f else [0] for o, f in zip(out, long_, strict=True)])

    routed = cut_lineage(rows.withColumn("routes", routes("v")), "routed")
    homes = routed.select("vec_id", "v", "d", F.col("routes")[0].alias("part"))
    asked = routed.where(is_query).select("vec_id", "v", "d", F.explode("routes").alias("part"))
    size = homes.groupBy("d", "part").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("int").alias("nv"))
    load = asked.groupBy("d", "part").agg(
        F.ceil(F.count(F.lit(1)) / settings.query_block).cast("int").alias("nq")
    )
    blocks = cut_lineage(size.join(load, ["d", "part"]), "blocks")

    def dealt(df: DataFrame, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        """Each row in its own block, once for each block of the other side."""
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(names[0])
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1])
        same = [F.col(c).alias(c) for c in ("vec_id", "v", "d", "part")]
        return df.join(blocks, ["d", "part"]).select(*same, mine, every)

    left = dealt(homes, "nv", "nq", ("bv", "bq")).groupBy("d", "part", "bv", "bq")
    right = dealt(asked, "nq", "nv", ("bq", "bv")).groupBy("d", "part", "bv", "bq")
    found = left.cogroup(right).applyInPandas(_rank_block(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
