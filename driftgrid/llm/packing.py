"""Best-fit packing of tokenised documents into sequences, by bin completion.

Lengths are whole numbers up to the capacity, so a table of any size has a bounded
histogram of lengths.  The search works on that histogram and yields fillings with
multiplicities; the documents themselves never leave their tasks: each is ranked among
those of its length and takes the place that the plan has for that rank.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.frames import text_blocks
from driftgrid.session import cut_lineage

CAPACITY = 2048
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# ---------------------------------------------------------------- the search

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


@dataclass
class Plan:
    """Fillings and how many sequences each makes."""

    fillings: list[tuple[Filling, int]]

    @property
    def sequences(self) -> int:
        return sum(m for _, m in self.fillings)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, many equal documents at a time: the first incumbent."""
    by_room: dict[int, list[tuple[Filling, int]]] = {}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in sorted(r for r in by_room if r >= length):
            k = room // length  # a sequence filled once is the best fit again
            groups = by_room.pop(room)
            while groups and n >= k:
                filling, m = groups.pop()
                taken = min(m, n // k)
                _add(by_room, room - k * length, (*filling, (length, k)), taken)
                n -= taken * k
                if taken < m:
                    groups.append((filling, m - taken))
            if groups and n:
                filling, m = groups.pop()
                _add(by_room, room - n * length, (*filling, (length, n)), 1)
                n = 0
                if m > 1:
                    groups.append((filling, m - 1))
            for filling, m in groups:
                _add(by_room, room, filling, m)
            if not n:
                break
        if n:
            k = capacity // length
            if n // k:
                _add(by_room, capacity - k * length, ((length, k),), n // k)
            if n % k:
                _add(by_room, capacity - n % k * length, ((length, n % k),), 1)
    return Plan([g for groups in by_room.values() for g in groups])


def _add(by_room: dict, room: int, filling: Filling, m: int) -> None:
    by_room.setdefault(room, []).append((filling, m))


def completions(
    counts: dict[int, int], lengths: list[int], room: int, most: int, looks: int
) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``room`` with their waste, least waste first.

    A document that fits the room left exactly dominates every set that would, and a set
    that still has room for a document is dominated by the set with it.  Larger documents
    are tried first; ``looks`` bounds the steps, ``most`` the fillings kept.
    """
    found: dict[tuple[int, ...], int] = {}
    used: dict[int, int] = {}
    left = [looks]

    def fill(room: int, top: int, taken: tuple[int, ...]) -> None:
        left[0] -= 1
        if counts.get(room, 0) > used.get(room, 0) and (not taken or room <= taken[-1]):
            found[(*taken, room)] = 0
            return
        closed = True
        at = bisect_right(lengths, min(room, top)) - 1
        while at >= 0:
            x = lengths[at]
            at -= 1
            if counts[x] <= used.get(x, 0):
                continue
            closed = False
            if left[0] <= 0 and found:
                return
            used[x] = used.get(x, 0) + 1
            fill(room - x, x, (*taken, x))
            used[x] -= 1
            if sum(1 for w in found.values() if w == 0) >= most:
                return
        if closed and not (lengths and any(
            counts[x] > used.get(x, 0) for x in lengths[: bisect_right(lengths, room)]
        )):
            found[taken] = room

    fill(room, room, ())
    ranked = sorted((w, len(t), tuple(-x for x in t), t) for t, w in found.items())
    return [(w, t) for w, _, _, t in ranked[:most]]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: for each size, documents over half the capacity stand alone, and those
    of at least that size must fit beside them or in sequences of their own."""
    n = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        n[length] = count
    number = np.concatenate([[0], np.cumsum(n)])
    weight = np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    half = capacity // 2
    best = -(-int(weight[-1]) // capacity)
    for k in range(half + 1):
        over = int(number[-1] - number[half + 1])
        beside = int(number[capacity - k + 1] - number[half + 1])
        room = beside * capacity - int(weight[capacity - k + 1] - weight[half + 1])
        small = int(weight[half + 1] - weight[k])
        best = max(best, over + max(0, -(-(small - room) // capacity)))
    return best


def complete(counts: dict[int, int], capacity: int, nodes: int = 4_000, most: int = 6) -> Plan:
    """Bin completion by branch and bound on a histogram of lengths.

    Sequences are filled around the longest document left, one branch per undominated
    filling, least waste first.  A filling is used for as many sequences as the counts
    allow.  A branch ends where its waste exceeds what a better plan than the incumbent may
    waste; a plan that meets the lower bound ends the search, as do ``nodes`` branches.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    bound = least_sequences(counts, capacity)
    left = nodes
    # Depth-first: the state before a branch, and the branches not yet taken there.
    stack: list[tuple[dict, int, list, list]] = []
    now, wasted, path = dict(counts), 0, []

    def branches(now: dict[int, int]) -> list[tuple[int, tuple[int, ...]]]:
        lengths = sorted(now)
        largest = lengths[-1]
        rest = dict(now)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        return completions(rest, sorted(rest), capacity - largest, most, 400)

    while best.sequences > bound and left > 0:
        left -= 1
        allowed = (best.sequences - 1) * capacity - total
        if not now:
            best = Plan(list(path))
            options = []
        else:
            options = [o for o in branches(now) if wasted + o[0] <= allowed]
        while not options and stack:
            now, wasted, path, options = stack.pop()
            allowed = (best.sequences - 1) * capacity - total
            options = [o for o in options if wasted + o[0] <= allowed]
        if not options:
            break
        (waste, taken), *others = options
        if others:
            stack.append((dict(now), wasted, list(path), others))
        largest = max(now)
        filling: dict[int, int] = {largest: 1}
        for x in taken:
            filling[x] = filling.get(x, 0) + 1
        times = min(now[x] // k for x, k in filling.items())
        if waste:
            times = min(times, max(1, (allowed - wasted) // waste))
        for x, k in filling.items():
            now[x] -= k * times
            if not now[x]:
                del now[x]
        wasted += waste * times
        path = [*path, (tuple(sorted(filling.items(), reverse=True)), times)]
        if not now and sum(m for _, m in path) < best.sequences:
            best = Plan(list(path))
    return best


@dataclass
class Places:
    """Per length, runs of ranks: first rank, copies per sequence, first sequence, offset."""

    runs: dict[int, np.ndarray]

    @classmethod
    def of(cls, plan: Plan) -> Places:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for filling, times in plan.fillings:
            offset = 0
            for length, k in filling:
                first = ranks.get(length, 0)
                runs.setdefault(length, []).append((first, k, sequence, offset))
                ranks[length] = first + k * times
                offset += k * length
            sequence += times
        return cls({x: np.array(r, np.int64) for x, r in runs.items()})

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros_like(ranks), np.zeros_like(ranks)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            runs = self.runs[int(length)]
            run = runs[np.searchsorted(runs[:, 0], ranks[at], side="right") - 1]
            inside = ranks[at] - run[:, 0]
            sequence[at] = run[:, 2] + inside // run[:, 1]
            offset[at] = run[:, 3] + inside % run[:, 1] * length
        return sequence, offset


# ---------------------------------------------------------------- tokens


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from text to ids like that of the tokenizers file ``path``.

    The file's own ranks run in tiktoken, which gives the same ids in less time; special
    tokens in a text are found as that library finds them.  The few texts that defeat its
    pattern matcher go to the tokenizers library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
    # Byte-level vocabularies write printable bytes as they are, the others from U+0100 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {
        bytes(byte[c] for c in token): i
        for token, i in spec["model"]["vocab"].items()
        if token not in special
    }
    fast = tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:
            if type(e).__name__ != "PanicException":
                raise
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Start and end of each piece; only the first may be short of the capacity."""
    first = len(ids) % capacity or capacity
    ends = range(first, len(ids) + 1, capacity)
    return [(max(0, e - capacity), e) if e > first else (0, first) for e in ends]


def _pieces(tokenizer: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for block in text_blocks(batches, "text"):
            out = []
            for doc_id, text in zip(block["doc_id"], block["text"], strict=True):
                ids = encode(text) if isinstance(text, str) and text else np.zeros(0, np.uint32)
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                for k, (a, b) in enumerate(cut(ids, capacity)):
                    row = (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    out.append((*row, ids[a:b].astype(np.int32)) if keep_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            yield pd.DataFrame(out, columns=names)

    return run


def pieces(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Token pieces of every document: its ids and an end token 0, cut to the capacity.

    ``start`` counts the document's ids before the piece.  A null or empty text is the end
    token alone.  A whole text is encoded at once, however long.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if keep_ids else ""
    slim = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    cuts = slim.mapInPandas(_pieces(tokenizer, capacity, keep_ids), schema.replace("doc_id long", "doc_id string"))
    return cuts.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``pieces`` with the ``sequence_id`` and ``offset`` each takes.

    Every row of the input is a document, repeated rows and null ids too; an empty table
    gives an empty one.  Equal lengths share a rank order by part of the table, so that a
    length that a third of all documents have is ranked in many tasks.
    """
    cuts = pieces(docs, tokenizer, capacity, keep_ids, doc_id, text)
    cuts = cut_lineage(cuts.withColumn("part", F.spark_partition_id()), "pieces")
    sizes = cut_lineage(cuts.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # One row per length: at most ``capacity`` of them.
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The plan has at most one step per length and 64 lengths a step.
    places = docs.sparkSession.sparkContext.broadcast(Places.of(complete(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cuts.withColumn("rank", F.row_number().over(within).cast("long"))
    ranked = ranked.join(ahead, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("rank") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("__at", place("length", "rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    return placed.select(*names, "__at.sequence_id", "__at.offset")
