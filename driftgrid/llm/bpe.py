"""Byte-level BPE encoding and decoding with a rank queue on a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.frames import row_runs, text_blocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class RankQueue:
    """Positions by merge rank, the least rank first.

    Each rank in use has a bucket of positions.  Bit r of the lowest bitmap says that bucket
    r is not empty, a bit of a higher one that a 64-bit word below has a bit; the least rank
    is found by the first set bit of one word per level, whatever the number of entries.
    """

    def __init__(self, ranks: int):
        self.levels = []
        while True:
            ranks = ranks + 63 >> 6
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        for words in self.levels:
            word = rank >> 6
            old = words[word]
            words[word] = old | 1 << (rank & 63)
            if old:
                break
            rank = word

    def least(self) -> int:
        """The least rank with a bucket, or -1."""
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return -1
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def drop(self, rank: int) -> None:
        """Take an empty bucket away."""
        del self.buckets[rank]
        for words in self.levels:
            word = rank >> 6
            words[word] &= ~(1 << (rank & 63))
            if words[word]:
                break
            rank = word


class _Links:
    """The linked list of parts, for array operations and (``views``) for single steps."""

    def __init__(self, data: bytes, edge, after, before, token, rank_at):
        self.data, self.edge, self.edge_bytes = data, edge, edge.tobytes()
        self.after, self.before, self.token, self.rank_at = after, before, token, rank_at
        # Positions where a part begins; edges are none.
        self.live = 1 - edge
        self.views = tuple(memoryview(a) for a in (after, before, token, rank_at, self.live))
        self.again: list[np.ndarray] = []


class Index(dict):
    """Numbers for pre-tokens, in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


class Encoder:
    """Ids of pre-tokens by the ranks of a tiktoken file.

    Texts are first written as numbers of pre-tokens.  The new ones of all texts at hand are
    then merged, ``TOGETHER`` at a time in one pass of the queue: parts of many of them share
    a rank, so that a bucket, once found, serves them all.  Known pre-tokens are kept from
    one call to the next up to ``KEPT`` of them, or ``CHARS`` characters; a call that ends
    above starts the next anew.
    """

    KEPT = 250_000
    CHARS = 8 << 20
    TOGETHER = 60_000
    # From so many positions on, a bucket's parts are joined by array operations.
    WIDE = 128

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        keys, joint = array("q"), array("i")
        for t, rank in ranks.items():
            for k in range(1, len(t)):
                if t[:k] in ranks and t[k:] in ranks:
                    keys.append(ranks[t[:k]] << 32 | ranks[t[k:]])
                    joint.append(rank)
        keys, joint = np.array(keys, np.int64), np.array(joint, np.int32)
        order = np.argsort(keys)
        self.joint, self.joint_rank = keys[order], joint[order]
        self.single = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int32)
        self.forget()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the join of tokens, -1 where the vocabulary has none."""
        if not len(self.joint):
            return np.full(len(left), -1, np.int64)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.joint, key), len(self.joint) - 1)
        return np.where(self.joint[at] == key, self.joint_rank[at], -1)

    def forget(self) -> None:
        self.index, self.chars = Index(), 0
        # Ids of the known pre-tokens one after the other, and where each begins.
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)

    def learn(self) -> None:
        """Ids of the pre-tokens that have a number but no ids yet."""
        known = len(self.begin) - 1
        new = list(islice(self.index, known, None))
        self.chars += sum(map(len, new))
        flat, sizes = [self.flat], []
        for low in range(0, len(new), self.TOGETHER):
            packed = self.ids_of([w.encode("utf-8", "replace") for w in new[low : low + self.TOGETHER]])
            flat.append(np.frombuffer(b"".join(packed), np.int32))
            sizes += [len(p) // 4 for p in packed]
        self.flat = np.concatenate(flat)
        ends = self.begin[-1] + np.cumsum(np.array(sizes, np.int64))
        self.begin = np.concatenate([self.begin, ends])

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: of one token if the vocabulary has it whole, else merged."""
        whole = [self.ranks.get(p) for p in pieces]
        merged = iter(self.merge([p for p, w in zip(pieces, whole, strict=True) if w is None]))
        return [next(merged) if w is None else w.to_bytes(4, sys.byteorder) for w in whole]

    def merge(self, pieces: list[bytes], together: bool = True) -> list[bytes]:
        """Join the neighbours of least rank in each piece, leftmost first, to the end.

        Pieces lie one after the other with an edge between them.  Parts are a linked list
        over their first bytes.  ``rank_at`` holds the rank of the pair that starts at a
        part; a queued position whose pair has since changed is stale and passed over.

        A wide bucket is emptied at once.  Should that make a pair of lesser rank, which had
        to come before the rest of the bucket, its piece is merged again step by step.
        """
        if not pieces:
            return []
        queue, buckets = self.queue, self.queue.buckets
        data = b"\0".join(pieces) + b"\0"
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1) - 1
        n = len(data)
        edge = np.zeros(n, np.uint8)
        edge[ends] = 1
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        before[ends + 1] = -1
        # First pairs: all at once, by the rank of two bytes, one bucket per rank.
        codes = np.frombuffer(data, np.uint8)
        token = self.single[codes]
        rank_at = np.full(n, -1, np.int32)
        rank_at[:-1] = self.pairs[codes[:-1].astype(np.int64) << 8 | codes[1:]]
        rank_at[ends] = -1
        rank_at[ends[sizes > 0] - 1] = -1
        self._queue(np.flatnonzero(rank_at >= 0), rank_at)
        links = _Links(data, edge, after, before, token, rank_at)
        rank = queue.least()
        while rank >= 0:
            bucket = buckets[rank]
            if together and len(bucket) >= self.WIDE:
                buckets[rank] = []
                self._join_many(rank, bucket, links)
            else:
                self._join_each(rank, bucket, links)
            if not buckets[rank]:
                queue.drop(rank)
            rank = queue.least()
        live = links.live.view(bool)
        packed = token[live].tobytes()
        cuts = 4 * np.concatenate([[0], np.cumsum(live)])
        spans = zip(cuts[ends - sizes].tolist(), cuts[ends].tolist(), strict=True)
        out = [packed[a:b] for a, b in spans]
        if links.again:
            redo = np.unique(np.searchsorted(ends, np.concatenate(links.again))).tolist()
            for i, ids in zip(redo, self.merge([pieces[i] for i in redo], False), strict=True):
                out[i] = ids
        return out

    def _queue(self, spots: np.ndarray, rank_at: np.ndarray) -> None:
        """Put positions into the buckets of their ranks."""
        if not len(spots):
            return
        ranks = rank_at[spots]
        order = np.argsort(ranks, kind="stable")
        spots, ranks = spots[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        all_spots, firsts = spots.tolist(), ranks[cuts].tolist()
        buckets = self.queue.buckets
        for rank, a, b in zip(firsts, cuts, [*cuts[1:], len(all_spots)], strict=True):
            bucket = buckets.get(rank)
            if bucket is None:
                self.queue.push(rank, all_spots[a])
                buckets[rank] = all_spots[a:b]
            else:
                bucket += all_spots[a:b]

    def _join_many(self, rank: int, bucket: list[int], links: _Links) -> None:
        """Join all live pairs of a rank at once; of pairs that overlap every second one."""
        after, before, token, rank_at = links.after, links.before, links.token, links.rank_at
        at = np.array(bucket, np.int32)
        at = np.sort(at[rank_at[at] == rank])
        if not len(at):
            return
        # A position may have been queued twice.
        at = at[np.diff(at, prepend=-1) > 0]
        gone = after[at]
        chained = np.zeros(len(at), bool)
        chained[1:] = at[1:] == gone[:-1]
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(chained, 0, place))
        first = (place - start) % 2 == 0
        at, gone = at[first], gone[first]
        end = after[gone]
        after[at] = end
        token[at] = rank
        links.live[gone] = 0
        rank_at[gone] = -1
        rank_at[at] = -1
        inner = links.edge[end] == 0
        left_of, follows = at[inner], end[inner]
        before[follows] = left_of
        rank_at[left_of] = self.rank_of(token[left_of], token[follows])
        previous = before[at]
        has = previous >= 0
        previous, at = previous[has], at[has]
        rank_at[previous] = self.rank_of(token[previous], token[at])
        spots = np.concatenate([left_of, previous])
        spots = spots[rank_at[spots] >= 0]
        lesser = spots[rank_at[spots] < rank]
        if len(lesser):
            links.again.append(lesser)
        self._queue(spots, rank_at)

    def _join_each(self, rank: int, bucket: list[int], links: _Links) -> None:
        """Join the live pairs of a rank one by one, until a lesser rank comes up."""
        after, before, token, rank_at, live = links.views
        data, edge, rank_of = links.data, links.edge_bytes, self.ranks.get
        buckets, push = self.queue.buckets, self.queue.push
        bucket.sort(reverse=True)
        while bucket:
            at = bucket.pop()
            if rank_at[at] != rank:
                continue
            gone = after[at]
            end = after[gone]
            after[at] = end
            token[at] = rank
            live[gone] = 0
            rank_at[gone] = rank_at[at] = -1
            lower = False
            if not edge[end]:
                before[end] = at
                r = rank_of(data[at : after[end]])
                if r is not None:
                    rank_at[at] = r
                    if r in buckets:
                        buckets[r].append(at)
                    else:
                        push(r, at)
                    lower = r < rank
            left = before[at]
            if left >= 0:
                r = rank_of(data[left:end])
                if r is None:
                    rank_at[left] = -1
                else:
                    rank_at[left] = r
                    if r in buckets:
                        buckets[r].append(left)
                    else:
                        push(r, left)
                    lower = lower or r < rank
            if lower:
                return

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        number = self.index.__getitem__
        coded = [np.fromiter(map(number, parts(t)), np.int32) for t in texts]
        self.learn()
        out = [self._gather(c) for c in coded]
        if len(self.index) > self.KEPT or self.chars > self.CHARS:
            self.forget()
        return out

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        """The ids of numbered pre-tokens, one after the other."""
        begin = self.begin[codes]
        size = self.begin[codes + 1] - begin
        stop = np.cumsum(size)
        shift = np.repeat(begin - (stop - size), size)
        return self.flat[shift + np.arange(len(shift))]


# The pattern of the vocabularies in the classes of the standard library, which are those of
# tiktoken but for a few characters; these are replaced by plain ones of their class.
_PATTERN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)
_STANDS_FOR = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\t"}
# Characters met so far: those of one class in both, and what stands for the others.
_alike: set[str] = set()
_odd: dict[str, str] = {}


@lru_cache(maxsize=1)
def _probes():
    """Encodings that give ids for characters of one class only, as tiktoken has them."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    return [
        (tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={}), plain)
        for kind, plain in _STANDS_FOR.items()
    ]


def _sort_out(c: str) -> None:
    """Note whether the two have a character in different classes."""
    kind = unicodedata.category(c)
    if kind not in ("Nl", "No", "Cn") and not "\x1c" <= c <= "\x1f" and c.isalnum() == (kind[0] in "LN"):
        _alike.add(c)
    else:
        _odd[c] = next((plain for probe, plain in _probes() if probe.encode_ordinary(c)), "!")


def parts(text: str) -> list[str]:
    """The pre-tokens of a text, all of it."""
    new = set(text).difference(_alike)
    for c in new.difference(_odd):
        _sort_out(c)
    if new.isdisjoint(_odd):
        return _PATTERN.findall(text)
    plain = text.translate(str.maketrans(_odd))
    return [text[m.start() : m.end()] for m in _PATTERN.finditer(plain)]


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Encoder, list[bytes]]:
    """Encoder and the bytes of each id, once per process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f))}
    names = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        names[i] = token
    return Encoder(ranks), names


def encode(text: Column, path: str = RANKS) -> Column:
    """Ids of each whole text, no special tokens; a null or empty text has none.

    Repeated and tied rows get the same ids.  A text is cut into pre-tokens at once, and a
    pre-token of any length costs time in proportion to its length.
    """

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encoder, _ = load(path)
        out: list[np.ndarray] = []
        frame = pd.DataFrame({"text": texts})
        for run in text_blocks(iter([frame]), "text", 8 << 20):
            out += encoder.block([t if isinstance(t, str) else "" for t in run["text"]])
        return pd.Series(out, dtype=object)

    return ids(text)


def decode(ids: Column, path: str = RANKS) -> Column:
    """The bytes that ids stand for; null has none.  An id outside the vocabulary fails."""

    @F.pandas_udf("binary")
    def named(values: pd.Series) -> pd.Series:
        _, names = load(path)
        name = names.__getitem__
        return pd.Series([b"" if v is None else b"".join(map(name, v.tolist())) for v in values])

    return named(ids)


def digests(docs: DataFrame, path: str = RANKS, limit: int = 2 << 20) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to, in one pass.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and
    decoded_sha256 (of the decoded bytes).  Texts are encoded about ``limit`` characters at a
    time and ids never leave their task.  Null and empty texts have no ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = load(path)
        number, name = [str(i) for i in range(len(names))].__getitem__, names.__getitem__
        for batch in batches:
            texts = batch.column(1)
            for low, high in row_runs(texts, limit):
                found = encoder.block([t or "" for t in texts.slice(low, high - low).to_pylist()])
                out = []
                for ids in map(np.ndarray.tolist, found):
                    listed = ",".join(map(number, ids)).encode()
                    decoded = b"".join(map(name, ids))
                    out.append((len(ids), *(hashlib.sha256(x).hexdigest() for x in (listed, decoded))))
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.string(), pa.string())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                made = [batch.column(0).slice(low, high - low), *arrays]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
