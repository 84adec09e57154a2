"""SimHash near-duplicates: fingerprints in Gray order under a hierarchical index.

Equal fingerprints fall together first.  Each distinct one is filed in several tables, by
some of its bits in each, so that close fingerprints share a bucket of at least one table.
Inside the buckets fingerprints are sorted by Gray rank, which brings those with long common
bit patterns side by side, and cut into blocks.  A block is a tree: a node keeps the bits
all its members share, a child only what it adds to its parent.  Two nodes are compared on
the bits both fix; differences add up on the way down and a pair of groups is dropped as
soon as they exceed the distance, or joined as a whole once no member can exceed it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.components import components
from driftgrid.llm.frames import WORD_BYTES, tasks, utf8
from driftgrid.session import cut_lineage

FANOUT = 16
BLOCK = 1024
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Scheme:
    """``words`` 64-bit words of fingerprint over shingles of ``shingle`` words; a link is a
    distance of ``distance`` bits or less.  ``tables`` lists, per table, the bits that key
    its buckets (bit 0 is the highest)."""

    words: int
    shingle: int
    distance: int
    tables: tuple[tuple[int, ...], ...]


def exact_scheme(shingle: int = 4, distance: int = 4) -> Scheme:
    """64 bits in ``distance + 1`` runs: two fingerprints that close agree on a whole run,
    so that no link is lost."""
    cuts = [round(64 * i / (distance + 1)) for i in range(distance + 2)]
    runs = tuple(tuple(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False))
    return Scheme(1, shingle, distance, runs)


def similarity_scheme(
    n: int, similarity: float = 0.8, shingle: int = 5, words: int = 4, missed: float = 0.01
) -> Scheme:
    """Candidates for texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    The angle of such texts gives the mean distance of their fingerprints; two and a half
    standard deviations are added.  Keys grow with the logarithm of the number ``n`` of
    fingerprints, so that buckets stay small, and tables are as many as make the share of
    texts of just that similarity which no table or distance finds ``missed`` at most, over
    all distances they may have, whatever ``n``.
    """
    bits = 64 * words
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(cosine) / np.pi
    distance = int(bits * share + 2.5 * np.sqrt(bits * share * (1 - share)))
    width = min(48, max(10, ceil(log2(max(2, n) / 128))))
    near = range(distance + 1)
    likely = np.array([comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in near])
    agree = np.array([comb(bits - d, width) / comb(bits, width) for d in near])
    # What the distance alone loses is no matter of tables.
    least = (1 - missed) * likely.sum()
    count = 1
    while likely @ (1 - (1 - agree) ** count) < least:
        count += 1
    rng = np.random.default_rng(20)
    tables = tuple(tuple(sorted(map(int, rng.choice(bits, width, False)))) for _ in range(count))
    return Scheme(words, shingle, distance, tables)


# ---------------------------------------------------------------- fingerprints


def _shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles of a text, A-Z lower-cased."""
    words = WORD_BYTES.findall(utf8(text).lower())
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: len(words) - size]])
    stops = ends[size - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(line[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)],
        np.uint64,
    )


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of a hash; the first are the hash itself."""
    if k == 0:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, words: int, size: int, distinct: bool = False) -> bytes:
    """Big-endian bits, each 1 if set in over half the shingle hashes; 0 without a word.

    ``distinct`` takes each shingle once, however often it is repeated."""
    h = _shingle_hashes(text or "", size)
    h = np.unique(h) if distinct else h
    out = b""
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for low in range(0, len(h), 1 << 16):
            part = _mixed(h[low : low + (1 << 16)], k).astype(">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, np.int64)
        out += np.packbits(2 * ones > len(h)).tobytes()
    return out


def fingerprints(scheme: Scheme, distinct: bool = False):
    """Column function: text to fingerprint, as binary."""
    words, size = scheme.words, scheme.shingle

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        whole = (t if isinstance(t, str) else None for t in texts)
        return pd.Series([fingerprint(t, words, size, distinct) for t in whole])

    return of


# ---------------------------------------------------------------- Gray order and keys


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code (rows of words, highest first) in the order of Gray codes."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    for w in range(1, rank.shape[1]):
        rank[:, w] ^= np.where(rank[:, w - 1] & _ONE, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    return rank


def gray_code(ranks: np.ndarray) -> np.ndarray:
    """The codes at these places."""
    down = ranks >> _ONE
    down[:, 1:] |= ranks[:, :-1] << np.uint64(63)
    return ranks ^ down


def _words(values: pd.Series | list[bytes], words: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), ">u8").reshape(-1, words).astype(np.uint64)


def _rows(array: np.ndarray) -> list[bytes]:
    data, size = array.astype(">u8").tobytes(), 8 * array.shape[1]
    return [data[i : i + size] for i in range(0, len(data), size)]


def _filed(scheme: Scheme) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each fingerprint once per table: bucket and Gray rank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = _words(batch["fp"], scheme.words)
            ranks = _rows(gray_rank(codes))
            for t, bits in enumerate(scheme.tables):
                key = np.full(len(codes), t, np.int64)
                for b in bits:
                    bit = (codes[:, b // 64] >> np.uint64(63 - b % 64)) & _ONE
                    key = (key << 1) | bit.astype(np.int64)
                yield pd.DataFrame({"bucket": key, "rank": ranks})

    return run


# ---------------------------------------------------------------- blocks


def _shared(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits each group shares, and their values."""
    ones = np.bitwise_and.reduceat(codes, starts, axis=0)
    some = np.bitwise_or.reduceat(codes, starts, axis=0)
    return ones | ~some, ones


def _blocks(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Cut sorted rows into blocks: runs of one bucket of ``BLOCK`` ranks at most.

    The last run of a batch is held back, as its bucket may go on in the next.
    """

    def cut(bucket: np.ndarray, ranks: list[bytes]) -> pd.DataFrame:
        change = np.flatnonzero(np.diff(bucket)) + 1
        starts = []
        for a, b in zip([0, *change], [*change, len(bucket)], strict=True):
            starts += range(a, b, BLOCK)
        codes = gray_code(_words(ranks, words))
        mask, value = _shared(codes, np.array(starts))
        stops = [*starts[1:], len(bucket)]
        return pd.DataFrame(
            {
                "bucket": bucket[starts],
                "first": [ranks[a] for a in starts],
                "n": np.array(stops) - np.array(starts),
                "mask": _rows(mask),
                "value": _rows(value),
                "ranks": [b"".join(ranks[a:b]) for a, b in zip(starts, stops, strict=True)],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, ranks = np.zeros(0, np.int64), []
        for batch in batches:
            bucket = np.concatenate([bucket, batch["bucket"].to_numpy(np.int64)])
            ranks += list(batch["rank"])
            if not len(bucket):
                continue
            # Whole blocks go out; what may still grow stays.
            start = int(np.searchsorted(bucket, bucket[-1], side="left"))
            start += (len(bucket) - start) // BLOCK * BLOCK
            if start:
                yield cut(bucket[:start], ranks[:start])
                bucket, ranks = bucket[start:], ranks[start:]
        if len(bucket):
            yield cut(bucket, ranks)

    return run


BLOCK_SCHEMA = "bucket long, first binary, n int, mask binary, value binary, ranks binary"


# ---------------------------------------------------------------- the index


class Tree:
    """Levels of groups over codes in Gray order, from single codes up to one root.

    ``masks[l]`` has the bits that a node of level l fixes, ``values[l]`` their values.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.masks = [np.full_like(codes, np.uint64(0xFFFFFFFFFFFFFFFF))]
        self.values = [codes]
        while len(self.values[-1]) > 1:
            starts = np.arange(0, len(self.values[-1]), FANOUT)
            mask = np.bitwise_and.reduceat(self.masks[-1], starts, axis=0)
            ones = np.bitwise_and.reduceat(self.values[-1], starts, axis=0)
            some = np.bitwise_or.reduceat(self.values[-1] | ~self.masks[-1], starts, axis=0)
            mask &= ones | ~some
            self.masks.append(mask)
            self.values.append(ones & mask)

    @property
    def height(self) -> int:
        return len(self.values)

    def lift(self, height: int) -> None:
        """Repeat the root until the tree has this height."""
        while self.height < height:
            self.masks.append(self.masks[-1])
            self.values.append(self.values[-1])

    def size(self, level: int) -> int:
        return FANOUT**level


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, at: np.ndarray) -> np.ndarray:
        root = self.up[at]
        while True:
            above = self.up[root]
            if np.array_equal(above, root):
                return root
            root = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            # One parent per root at a time; the others try again.
            self.up[high] = low
            a, b = low, high
        self.up = self.find(np.arange(len(self.up)))


PAIRS = 1 << 18


def link(forest: Forest, left: Tree, right: Tree, shift: int, distance: int, same: bool) -> None:
    """Join in ``forest`` all members of two trees (right ones at ``shift``) that are linked.

    Pairs of nodes are taken down level by level.  The differences on bits both nodes fix
    add up; over ``distance`` the pair is dropped.  If those and the bits not yet fixed stay
    within it, every member is linked to every other and the two groups are joined whole.
    Pairs of groups that are one component already need no look.
    """
    height = max(left.height, right.height)
    left.lift(height)
    right.lift(height)
    nl, nr = len(left.codes), len(right.codes)
    top = height - 1
    words = left.codes.shape[1]
    stack = [
        (top, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, words), np.uint64))
    ]
    while stack:
        level, i, j, spent, known = stack.pop()
        if len(i) > PAIRS:
            half = len(i) // 2
            stack.append((level, i[half:], j[half:], spent[half:], known[half:]))
            i, j, spent, known = i[:half], j[:half], spent[:half], known[:half]
        both = left.masks[level][i] & right.masks[level][j]
        differ = (left.values[level][i] ^ right.values[level][j]) & both & ~known
        spent = spent + np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        near = spent <= distance
        i, j, spent, both = i[near], j[near], spent[near], both[near]
        if not len(i):
            continue
        if level == 0:
            forest.join(i, j + shift)
            continue
        size = left.size(level)
        # A lifted level has one node for all members.
        loose = 64 * words - np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        whole = spent + loose <= distance
        for a, b in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
            one = np.arange(a * size, min(nl, (a + 1) * size))
            two = np.arange(b * size, min(nr, (b + 1) * size)) + shift
            forest.join(one, np.full(len(one), two[0]))
            forest.join(two, np.full(len(two), one[0]))
        open_ = ~whole
        i, j, spent, both = i[open_], j[open_], spent[open_], both[open_]
        if not len(i):
            continue
        if level == 1:
            # Groups whose members are one component already are done.
            roots = forest.find(np.arange(len(forest.up)))
            sl = np.arange(0, nl, FANOUT)
            sr = np.arange(0, nr, FANOUT)
            rl, rr = roots[:nl], roots[shift : shift + nr]
            low_l, high_l = np.minimum.reduceat(rl, sl), np.maximum.reduceat(rl, sl)
            low_r, high_r = np.minimum.reduceat(rr, sr), np.maximum.reduceat(rr, sr)
            done = (low_l[i] == high_l[i]) & (low_r[j] == high_r[j]) & (low_l[i] == low_r[j])
            i, j, spent, both = i[~done], j[~done], spent[~done], both[~done]
        below_l, below_r = len(left.values[level - 1]), len(right.values[level - 1])
        step = np.arange(FANOUT)
        lifted_l = len(left.values[level]) == below_l and below_l == 1
        lifted_r = len(right.values[level]) == below_r and below_r == 1
        kids_l = i[:, None] if lifted_l else i[:, None] * FANOUT + step
        kids_r = j[:, None] if lifted_r else j[:, None] * FANOUT + step
        a = np.repeat(kids_l, kids_r.shape[1], axis=1).ravel()
        b = np.tile(kids_r, (1, kids_l.shape[1])).ravel()
        times = kids_l.shape[1] * kids_r.shape[1]
        fit = (a < below_l) & (b < below_r)
        if same:
            fit &= a <= b
        stack.append(
            (level - 1, a[fit], b[fit], np.repeat(spent, times)[fit], np.repeat(both, times, axis=0)[fit])
        )


def _star_edges(forest: Forest, nodes: np.ndarray) -> pd.DataFrame:
    root = forest.find(np.arange(len(nodes)))
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[at], "v": nodes[root[at]]})


def _nodes(codes: np.ndarray) -> np.ndarray:
    """A fingerprint as one long: itself if it is one word, else its hash."""
    if codes.shape[1] == 1:
        return codes[:, 0].view(np.int64)
    return np.array([xxhash.xxh64_intdigest(c) for c in _rows(codes)], np.uint64).view(np.int64)


def _links(words: int, distance: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links inside each block, as stars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for ranks in batch["ranks"]:
                if len(ranks) > 8 * words:
                    codes = gray_code(_words([ranks], words))
                    tree, forest = Tree(codes), Forest(len(codes))
                    link(forest, tree, tree, 0, distance, True)
                    found.append(_star_edges(forest, _nodes(codes)))
            if found:
                yield pd.concat(found)

    return run


def _near_blocks(words: int, distance: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs of blocks whose shared bits do not yet differ by more than ``distance``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                both = _words(b["mask"], words) & _words(b["mask2"], words)
                differ = (_words(b["value"], words) ^ _words(b["value2"], words)) & both
                near = np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= distance
                yield b.loc[near, ["bucket", "first", "first2"]]

    return run


def _links_between(words: int, distance: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links between the two blocks of each row, as stars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, two in zip(batch["ranks"], batch["ranks2"], strict=True):
                a, b = gray_code(_words([one], words)), gray_code(_words([two], words))
                forest = Forest(len(a) + len(b))
                link(forest, Tree(a), Tree(b), len(a), distance, False)
                yield _star_edges(forest, _nodes(np.concatenate([a, b])))

    return run


def linked(fps: DataFrame, scheme: Scheme) -> DataFrame:
    """Edges ``u``, ``v`` between the nodes of distinct fingerprints ``fp`` that connect all
    within the distance and that share a bucket.

    A bucket may hold any number of fingerprints: its blocks are bounded, lie in different
    tasks, and meet in pairs that spread by block.
    """
    words, distance = scheme.words, scheme.distance
    filed = fps.select("fp").mapInPandas(_filed(scheme), "bucket long, rank binary")
    spread = filed.repartitionByRange(tasks(fps), "bucket", "rank").sortWithinPartitions("bucket", "rank")
    blocks = cut_lineage(spread.mapInPandas(_blocks(words), BLOCK_SCHEMA), "blocks")
    inside = blocks.where("n > 1").select("ranks").mapInPandas(_links(words, distance), "u long, v long")
    several = blocks.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    parts = blocks.join(several, "bucket", "left_semi")
    heads = parts.select("bucket", "first", "mask", "value")
    other = heads.select("bucket", *(F.col(c).alias(f"{c}2") for c in ("first", "mask", "value")))
    near = heads.join(other, "bucket").where("first < first2")
    near = near.mapInPandas(_near_blocks(words, distance), "bucket long, first binary, first2 binary")
    body = parts.select("bucket", "first", "ranks")
    second = body.select("bucket", F.col("first").alias("first2"), F.col("ranks").alias("ranks2"))
    pairs = near.join(body, ["bucket", "first"]).join(second, ["bucket", "first2"])
    between = pairs.select("ranks", "ranks2").mapInPandas(_links_between(words, distance), "u long, v long")
    return inside.unionByName(between)


def node_of(fp: Column, scheme: Scheme) -> Column:
    """The node of a fingerprint column, as ``linked`` names it."""
    if scheme.words == 1:
        return F.conv(F.hex(fp), 16, -10).cast("long")

    @F.pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh64_intdigest(v) for v in values], dtype=np.uint64).astype(np.int64)

    return hashed(fp)


def classes(marked: DataFrame, scheme: Scheme, doc_id: str = "doc_id") -> DataFrame:
    """``fp``, ``root`` (its component's least node) and ``component_id`` (the least document
    id in that component) of each distinct fingerprint of ``marked``, which has the columns ``doc_id`` and ``fp``."""
    fps = marked.groupBy("fp").agg(F.min(F.col(f"`{doc_id}`")).alias("least"))
    fps = cut_lineage(fps.withColumn("node", node_of(F.col("fp"), scheme)), "fingerprints")
    roots = components(linked(fps, scheme))
    rooted = fps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, scheme: Scheme, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (binary) and ``component_id``.

    Texts without a word, null ones included, have fingerprint zero and are linked like any
    other.  A null id counts for no minimum; a component of null ids only has a null id.
    Repeated rows stay repeated.  An empty table gives an empty one.
    """
    marked = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), fingerprints(scheme)(F.col(f"`{text}`")).alias("fp")
    )
    marked = cut_lineage(marked, "marked")
    return marked.join(classes(marked, scheme), "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- exact similarity

# A part of a group of candidates holds about so many texts and so many shingles at most.
PART_TEXTS = 1024
PART_SHINGLES = 1 << 20


def _shingle_sets(size: int):
    """Column function: text to its distinct shingle hashes in order, as binary."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        whole = (t if isinstance(t, str) else "" for t in texts)
        return pd.Series([np.unique(_shingle_hashes(t, size)).tobytes() for t in whole])

    return of


def similar(sets: list[bytes], similarity: float, forest: Forest, first: int) -> None:
    """Join in ``forest`` the sets of at least this Jaccard similarity, each of the first
    ``first`` with all that follow it.  Two empty sets are alike.

    It ends when all are joined.  Pairs joined already are compared only with others.
    """
    sizes = np.array([len(s) // 8 for s in sets], np.int64)
    codes = pd.factorize(np.frombuffer(b"".join(sets), np.uint64))[0]
    ends = np.cumsum(sizes)
    marked = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
    for i in range(first):
        root = forest.find(np.arange(len(sets)))
        if np.all(root == root[0]):
            return
        if np.all(root[i + 1 :] == root[i]):
            continue
        own, start = codes[ends[i] - sizes[i] : ends[i]], int(ends[i])
        marked[own] = 1
        total = np.concatenate([[0], np.cumsum(marked[codes[start:]])])
        marked[own] = 0
        both = total[ends[i + 1 :] - start] - total[ends[i + 1 :] - sizes[i + 1 :] - start]
        near = np.flatnonzero(both >= similarity * (sizes[i] + sizes[i + 1 :] - both) - 1e-9) + i + 1
        forest.join(np.full(len(near), i), near)


def verified(candidates: DataFrame, similarity: float) -> DataFrame:
    """Edges ``u``, ``v`` that connect what links of at least this similarity connect.

    ``candidates`` has ``root`` (its group), ``node`` and ``shingles``.  All pairs of a group
    count, by their whole sets.  A group is dealt into parts of bounded size; the least node
    stands in all of them, so that copies of one text are connected without a look at pairs
    of parts.  Only parts of a group that is not connected by then meet in pairs.
    """
    edge = "u long, v long"

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        forest = Forest(len(group))
        similar(list(group["shingles"]), similarity, forest, len(group))
        return _star_edges(forest, group["node"].to_numpy(np.int64))

    def between(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("side")
        forest = Forest(len(group))
        known = group.groupby("label").ngroup().to_numpy()
        at = np.unique(known, return_index=True)[1]
        forest.join(np.arange(len(group)), at[known])
        similar(list(group["shingles"]), similarity, forest, int((group["side"] == 0).sum()))
        return _star_edges(forest, group["node"].to_numpy(np.int64))

    sizes = candidates.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / PART_TEXTS),
            F.ceil(F.sum(F.octet_length("shingles") / 8) / PART_SHINGLES),
            F.lit(1),
        ).cast("int").alias("parts"),
        F.min("node").alias("least"),
    )
    # Only groups of several parts need to be looked up.
    large = cut_lineage(sizes.where("parts > 1"), "large-groups")
    dealt = candidates.join(large.select("root", "parts"), "root", "left").select(
        "root", "node", "shingles", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    )
    heads = large.join(candidates.withColumnRenamed("node", "least"), ["root", "least"]).select(
        "root", F.col("least").alias("node"), "shingles", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")
    )
    whole = dealt.unionByName(heads).repartition("root", "part")
    edges = cut_lineage(whole.groupBy("root", "part").applyInPandas(inside, edge), "verified")
    if large.isEmpty():
        return edges
    members = candidates.select("root", "node").join(large.select("root"), "root", "left_semi")
    own = edges.join(members.select(F.col("node").alias("u")), "u", "left_semi")
    labels = components(own).withColumnRenamed("root", "label")
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = labelled.groupBy("root").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
    labelled = cut_lineage(labelled.join(apart.select("root"), "root", "left_semi"), "labels")
    if labelled.isEmpty():
        return edges
    rows = dealt.join(labelled.select("node", "label"), "node").join(large.select("root", "parts"), "root")
    other = F.explode(F.expr("filter(sequence(0, parts - 1), x -> x <> part)"))
    rows = rows.select("root", "node", "shingles", "label", "part", other.alias("other"))
    rows = rows.select(
        "root", "node", "shingles", "label",
        F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"),
        F.when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
    ).repartition("root", "one", "two")
    return edges.unionByName(rows.groupBy("root", "one", "two").applyInPandas(between, edge))


def drop_copies(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each group of near-copies: the one with the least id.

    Fingerprints of 256 bits over the distinct shingles bring candidates together; a link is
    a Jaccard similarity of their shingle sets of ``similarity`` or more, worked out whole.
    Texts of equal fingerprints count as one.  Among rows of one group with the same id one
    stays; a group of null ids only keeps one row.
    """
    first = similarity_scheme(2, similarity, shingle)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    marked = docs.select(
        row,
        F.col(f"`{doc_id}`").alias("id"),
        fingerprints(first, True)(F.col(f"`{text}`")).alias("fp"),
        F.monotonically_increasing_id().alias("place"),
    )
    marked = cut_lineage(marked, "marked")
    fps = marked.groupBy("fp").agg(F.min("place").alias("place"))
    fps = cut_lineage(fps.withColumn("node", node_of(F.col("fp"), first)), "fingerprints")
    scheme = similarity_scheme(fps.count(), similarity, shingle)
    near = fps.select("node", "place").join(components(linked(fps, scheme)), "node")
    texts = marked.select("place", F.col("row").getField(text).alias("text"))
    sets = near.join(texts, "place").select("root", "node", _shingle_sets(shingle)(F.col("text")).alias("shingles"))
    roots = components(verified(cut_lineage(sets, "shingles"), similarity))
    rooted = fps.select("fp", "node").join(roots, "node", "left")
    rooted = rooted.select("fp", F.coalesce("root", "node").alias("root"))
    # The least id, null last, then the least place; texts move once.
    slim = marked.select("id", "fp", "place").join(rooted, "fp")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place"))
    places = slim.groupBy("root").agg(best.alias("best")).select(F.col("best.place").alias("place"))
    kept = marked.join(places, "place", "left_semi")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
