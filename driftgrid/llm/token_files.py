"""Token-id files: blocks of ids as byte or bit planes, each compressed with zstandard.

A file holds the documents of one range of ids, one after the other::

    magic
    block 0, block 1, …      count u32, kind u8, planes u8, size u32 per plane, planes
    index                    zstandard of: an Arrow stream (doc_id, n_tokens), then the
                             place of every block as u64
    trailer                  Arrow bytes u64, index offset u64, index bytes u64, ids u64,
                             ids per block u32, crc32 of the index u32, magic

All blocks but the last hold the same number of ids, so id ``i`` of a file is in block
``i // block``: any span is read without the rest of the file.  Numbers are little-endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.bpe import Index
from driftgrid.llm.frames import row_runs, tasks
from driftgrid.session import cut_lineage, fresh_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
MAGIC = b"IDPLANE1"
_TRAILER = struct.Struct("<QQQQII8s")
_HEAD = struct.Struct("<IBB")
BYTES, BITS = 0, 1


@dataclass(frozen=True)
class Settings:
    """``block`` ids a block, the planes' ``kind`` and the compression ``level``.  Texts are
    encoded ``chars`` characters at a time, and the reader gives out ``batch`` ids at a time
    (one document at least)."""

    block: int = 1 << 16
    kind: int = BYTES
    level: int = 3
    chars: int = 1 << 21
    batch: int = 1 << 20


# ---------------------------------------------------------------- blocks


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block, lowest first; planes above the largest id are left out."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTES:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range((top + 7) // 8)]
    bits = np.unpackbits(octets[:, : (top + 7) // 8], axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T[:top]), axis=1, bitorder="little")
    return [plane.tobytes() for plane in packed]


def from_planes(planes: list[bytes], count: int, kind: int) -> np.ndarray:
    octets = np.zeros((count, 4), np.uint8)
    if planes and kind == BYTES:
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, np.uint8)
    elif planes:
        packed = np.stack([np.frombuffer(p, np.uint8) for p in planes])
        bits = np.zeros((32, count), np.uint8)
        bits[: len(planes)] = np.unpackbits(packed, axis=1, count=count, bitorder="little")
        octets = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4")


def pack_block(ids: np.ndarray, settings: Settings) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=settings.level).compress
    planes = [squeeze(p) for p in to_planes(ids, settings.kind)]
    sizes = np.array([len(p) for p in planes], "<u4").tobytes()
    return b"".join([_HEAD.pack(len(ids), settings.kind, len(planes)), sizes, *planes])


def unpack_block(data: bytes) -> np.ndarray:
    count, kind, n = _HEAD.unpack_from(data)
    at = _HEAD.size + 4 * n
    planes, open_up = [], zstandard.ZstdDecompressor().decompress
    for size in np.frombuffer(data, "<u4", n, _HEAD.size).tolist():
        planes.append(open_up(data[at : at + size]))
        at += size
    return from_planes(planes, count, kind)


# ---------------------------------------------------------------- files


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style name."""
    scheme, mark, rest = uri.partition("://")
    if mark and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    elif uri.startswith("file:") and not mark:
        uri = uri[5:]
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """Writes documents to one file; holds one block and the lengths at most."""

    def __init__(self, path: str, kind: pa.DataType, settings: Settings = Settings()):
        store, name = place(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.settings = store.open_output_stream(name), settings
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.schema = pa.schema([("doc_id", kind), ("n_tokens", pa.int64())])
        self.ids, self.held, self.total = [], 0, 0
        self.docs, self.places = [], []

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents: their names, numbers of ids, and ids one after the other."""
        self.docs.append(pa.record_batch([doc_ids, pa.array(sizes, pa.int64())], schema=self.schema))
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.settings.block:
            self._blocks(final=False)

    def _blocks(self, final: bool) -> None:
        ids, block = np.concatenate(self.ids), self.settings.block
        end = len(ids) if final else len(ids) // block * block
        for low in range(0, end, block):
            data = pack_block(ids[low : min(low + block, end)], self.settings)
            self.places.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.ids, self.held = [ids[end:].copy()], len(ids) - end

    def close(self) -> None:
        if self.held:
            self._blocks(final=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as stream:
            for docs in self.docs:
                stream.write_batch(docs)
        table = sink.getvalue().to_pybytes()
        index = table + np.array(self.places, "<u8").tobytes()
        index = zstandard.ZstdCompressor(level=self.settings.level).compress(index)
        self.out.write(index)
        numbers = (len(table), self.at, len(index), self.total, self.settings.block, zlib.crc32(index))
        self.out.write(_TRAILER.pack(*numbers, MAGIC))
        self.out.close()


class Reader:
    """Reads spans of ids, and the documents, of one file."""

    def __init__(self, path: str):
        store, name = place(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        if size < len(MAGIC) + _TRAILER.size:
            raise ValueError(f"{path} is no token file")
        table, at, length, self.total, self.block, check, magic = _TRAILER.unpack(
            self.file.read_at(_TRAILER.size, size - _TRAILER.size)
        )
        if magic != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        index = self.file.read_at(length, at)
        if zlib.crc32(index) != check:
            raise ValueError(f"the index of {path} is damaged")
        index = zstandard.ZstdDecompressor().decompress(index)
        self.docs = pa.ipc.open_stream(pa.py_buffer(index[:table])).read_all()
        self.places = np.append(np.frombuffer(index, "<u8", offset=table), at).astype(np.int64)

    def blocks(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Ids of the blocks ``first`` to ``last`` - 1."""
        for k in range(first, last):
            start, end = int(self.places[k]), int(self.places[k + 1])
            yield unpack_block(self.file.read_at(end - start, start))

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids ``start`` to ``end`` - 1 of the file; only their blocks are read."""
        end = min(end, self.total)
        if start >= end:
            return np.zeros(0, "<u4")
        first = start // self.block
        ids = np.concatenate(list(self.blocks(first, (end - 1) // self.block + 1)))
        return ids[start - first * self.block : end - first * self.block]

    def documents(self, batch: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Runs of documents with their ids, ``batch`` ids or one document at a time."""
        ends = np.cumsum(self.docs["n_tokens"].to_numpy())
        low = done = 0
        held = np.zeros(0, "<u4")
        source = self.blocks(0, len(self.places) - 1)
        while low < len(ends):
            high = max(low + 1, int(np.searchsorted(ends, done + batch, side="right")))
            need, parts = int(ends[high - 1]) - done, [held]
            got = len(held)
            while got < need:
                parts.append(next(source))
                got += len(parts[-1])
            ids = np.concatenate(parts)
            yield self.docs.slice(low, high - low), ids[:need]
            held, low, done = ids[need:], high, done + need


# ---------------------------------------------------------------- tokens


# A point or comma behind a letter or digit and before a blank is a pre-token of its own.
_POINT = re.compile(r"(?<=[^\W_])([.,;:!?])(?=[ \n])")

# No letter, digit or blank: a pre-token of its own between blanks.
_MARK = "\x02"


class Encoder:
    """Ids by a file of the tokenizers library, which encodes each stretch between blanks once.

    The vocabulary's pattern never takes in a blank, so a text's ids are those of its
    stretches.  Texts of Latin-1 are put in lower case first, as the vocabulary does, and
    points cut off, which leaves fewer different stretches.  Texts are written as numbers of
    stretches, whose ids lie in one array; above ``KEPT`` stretches, or ``CHARS`` characters
    of them, the next call starts anew.
    """

    KEPT = 500_000
    TOGETHER = 512
    CHARS = 24 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.lower = any(
            n.get("type") == "Lowercase"
            for n in (json.loads(self.library.to_str())["normalizer"] or {}).get("normalizers", [])
        )
        (self.mark,) = self.ids(_MARK)
        self.forget()

    def forget(self) -> None:
        self.index, self.chars = Index(), 0
        # Ids of the known stretches one after the other, and where each begins.
        self.flat, self.begin = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Ids of the stretches that have a number but no ids yet."""
        known = len(self.begin) - 1
        new = list(islice(self.index, known, None))
        flat, sizes = [self.flat], []
        # Many are encoded in one go, a mark of one id between them; one with the mark alone.
        cuts = [i for i, s in enumerate(new) if _MARK in s]
        for low, high in zip([0, *(i + 1 for i in cuts)], [*cuts, len(new)], strict=True):
            for at in range(low, high, self.TOGETHER):
                some = new[at : min(at + self.TOGETHER, high)]
                ids = self.ids(f" {_MARK} ".join([*some, ""]))
                ends = np.flatnonzero(ids == self.mark)
                flat.append(np.delete(ids, ends))
                sizes.append(np.diff(ends, prepend=-1) - 1)
            if high < len(new):
                flat.append(self.ids(new[high]))
                sizes.append([len(flat[-1])])
        self.chars += sum(map(len, new))
        self.flat = np.concatenate(flat)
        sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])

    def ids(self, text: str) -> np.ndarray:
        found = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, "<u4")

    def stretches(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.lower:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                text = _POINT.sub(r" \1", text.lower())
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def encode(self, texts: list[str | None], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text and all ids, with ``end`` behind each text if given."""
        cut = [self.stretches(t) for t in texts]
        upto = np.cumsum([0, *map(len, cut)])
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int32, upto[-1])
        self.learn()
        begin = self.begin[codes]
        size = self.begin[codes + 1] - begin
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(begin - (stop - size), size) + np.arange(int(size.sum()))]
        ends = np.concatenate([[0], stop])[upto]
        sizes = np.diff(ends)
        if end is not None:
            ids, sizes = np.insert(ids, ends[1:], end), sizes + 1
        if len(self.index) > self.KEPT or self.chars > self.CHARS:
            self.forget()
        return sizes, ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ---------------------------------------------------------------- Spark


def write(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    end: int | None = 2,
    settings: Settings = Settings(),
    doc_id: str = "doc_id",
    text: str = "text",
    folder: str | None = None,
) -> DataFrame:
    """Write the ids of all documents to files in ascending order of their ids.

    Gives the table of files, itself written: ``file`` (their order, from 0 up with gaps),
    ``path``, ``n_docs``, ``n_ids``, ``start`` (ids in the files before).  Documents are dealt
    by ranges of ``doc_id`` and sorted there; nulls come first, equal ids in the order of
    their texts' hashes, so that one id with very many rows is spread too.  A null or empty
    text is the end token alone; no rows, no files.  Each task streams to a file of its own
    name; only those whose task succeeded are in the table, what a lost one leaves is not read.
    """
    spark = docs.sparkSession
    folder = (folder or fresh_dir(spark, "token-files")).rstrip("/")
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    order = ["doc_id", "_tie"]
    dealt = slim.withColumn("_tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(tasks(docs), *order).sortWithinPartitions(*order, "text")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, n = TaskContext.get().partitionId(), None, 0
        path = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for low, high in row_runs(texts, settings.chars):
                if out is None:
                    out = Writer(path, names.type, settings)
                some = texts.slice(low, high - low).to_pylist()
                out.add(names.slice(low, high - low), *encoder(tokenizer).encode(some, end))
                n += high - low
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file": [part], "path": [path], "n_docs": [n], "n_ids": [out.total]}
            )

    made = dealt.select("doc_id", "text").mapInArrow(store, "file long, path string, n_docs long, n_ids long")
    files = cut_lineage(made, "token-file-table")
    # One row per file.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(files: DataFrame, kind: str, settings: Settings = Settings()) -> DataFrame:
    """The documents in files of ``write``, whose ``doc_id`` has the type ``kind``.

    Columns: doc_id, start (ids of all documents before), n_tokens, ids (binary: little-endian
    unsigned 32-bit numbers).  A task reads whole files, one block at a time.
    """
    schema = f"doc_id {kind}, start long, n_tokens long, ids binary"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                start = file["start"]
                for docs, ids in Reader(file["path"]).documents(settings.batch):
                    sizes = docs["n_tokens"].to_numpy()
                    ends = np.cumsum(sizes)
                    data = ids.tobytes()
                    spans = zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            docs["doc_id"].combine_chunks(),
                            pa.array(start + ends - sizes, pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array([data[a:b] for a, b in spans], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    start += len(ids)

    return files.repartitionByRange(tasks(files), "file").mapInArrow(load, schema)
