"""Spelling variants: words one edit apart, found with bit-sliced position indexes.

Two words one edit apart agree outside a short stretch.  Let ``s`` be the length of the
shorter one and cut the positions 0 to s into stretches: the edit (their first difference)
lies in one of them, and everything before and behind it is equal.  So words are filed under
(s, stretch, letters before it, letters behind it) and meet there.  A file with too many words
is refiled with its stretch halved, down to single positions, where few words can differ.

Within a task, files are searched a block of words at a time: for every position and letter
a bitset tells which words of the block have that letter there, and the recurrence over the
positions of all searching words keeps the words equal so far, those with one letter
replaced, and those one position ahead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.frames import tasks
from driftgrid.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Settings:
    """Words have ``length`` letters and ``support`` occurrences or more; the form of a word is
    ``ratio`` times as frequent.  Files of over ``crowd`` words are refiled, blocks hold about
    ``block``; neither changes results."""

    length: int = 6
    support: int = 5
    ratio: int = 5
    crowd: int = 16_384
    block: int = 2048


# ---------------------------------------------------------------- words


def runs_of_letters(text: Column) -> Column:
    """Maximal runs of Latin letters, A-Z in lower case."""
    lowered = F.translate(text, UPPER, UPPER.lower())
    return F.regexp_extract_all(lowered, F.lit("([a-z\\u00C0-\\u00FF]+)"), F.lit(1))


def with_slips(word: Column, doc_id: Column, one_in: int = 199) -> Column:
    """The word, or for one in ``one_in`` of (document, word) without one of its letters."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % one_in == 0, cut).otherwise(word)


def vocabulary(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word`` and its number ``n`` for the rows of ``words`` that are long and frequent enough."""
    long = words.where(F.length("word") >= settings.length)
    counts = long.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= settings.support)


# ---------------------------------------------------------------- one block


def letters_of(words: np.ndarray, width: int) -> np.ndarray:
    """Code points of the words, one row each, zeros behind the end."""
    padded = np.array(words, dtype=f"U{width}")
    return padded.view(np.uint32).reshape(len(words), width)


class PositionIndex:
    """Bitsets over the words of a block: bit w of (position, letter) is set if word w has it."""

    def __init__(self, letters: np.ndarray):
        size, width = letters.shape
        self.size, self.lanes = size, -(-size // 64)
        self.alphabet = np.unique(letters)
        codes = np.searchsorted(self.alphabet, letters)
        self.sets = np.zeros((width, len(self.alphabet), self.lanes), np.uint64)
        padded = np.zeros((len(self.alphabet), self.lanes * 64), bool)
        rows = np.arange(size)
        for p in range(width):
            padded[:] = False
            padded[codes[:, p], rows] = True
            self.sets[p] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        # Words that end before a position have the letter 0 there.
        none = self.sets[:, 0] if len(self.alphabet) and self.alphabet[0] == 0 else np.zeros_like(self.sets[:, 0])
        padded = np.zeros(self.lanes * 64, bool)
        padded[:size] = True
        self.all = np.packbits(padded, bitorder="little").view(np.uint64)
        self.present = self.all & ~none

    def having(self, letters: np.ndarray, position: int) -> np.ndarray:
        """For each searching word the set of those with its letter at ``position``."""
        at = np.searchsorted(self.alphabet, letters)
        at[at == len(self.alphabet)] = 0
        known = self.alphabet[at] == letters
        return np.where(known[:, None], self.sets[position][at], np.uint64(0))

    def near(self, searched: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (searching word, word): one letter replaced, or one more in the second.

        ``searched`` are words of ``length`` letters; those of the index have as many or one
        more.  Step i takes letter i: ``equal`` words had all letters so far in place,
        ``replaced`` all but one, and ``ahead`` have had one letter put in, so that letter i
        is looked up at position i + 1.
        """
        shape = (len(searched), self.lanes)
        equal = np.broadcast_to(self.all, shape).copy()
        replaced = np.zeros(shape, np.uint64)
        ahead = np.broadcast_to(self.present[0], shape).copy()
        for i in range(length):
            here = self.having(searched[:, i], i)
            replaced &= here
            replaced |= equal & ~here & self.present[i]
            equal &= here
            ahead &= self.having(searched[:, i], i + 1)
            ahead |= equal & self.present[i + 1]
        found = (replaced & ~self.present[length]) | (ahead & self.present[length])
        who, lane = np.nonzero(found)
        bits = np.unpackbits(found[who, lane].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, bit = np.nonzero(bits)
        return who[hit], lane[hit] * 64 + bit


def search(words: np.ndarray, counts: np.ndarray, s: int, low: int, high: int, block: int) -> pd.DataFrame:
    """Number and best of the near words of each word, among words of ``s`` or ``s`` + 1 letters.

    Only pairs whose first difference is at ``low`` or later and before ``high`` count.  The
    best is the most frequent one, among equals the least in code-point order.
    """
    letters = letters_of(words, s + 1)
    # Place in the order of preference.
    place = np.empty(len(words), np.int64)
    order = np.lexsort((*letters.T[::-1], -counts))
    place[order] = np.arange(len(words))
    number = np.zeros(len(words), np.int64)
    best = np.full(len(words), len(words), np.int64)
    short = np.flatnonzero(letters[:, s] == 0)
    for at in range(0, len(words), block):
        index = PositionIndex(letters[at : at + block])
        for q in range(0, len(short), block):
            asking = short[q : q + block]
            u, v = index.near(letters[asking], s)
            u, v = asking[u], v + at
            first = (letters[u] != letters[v]).argmax(axis=1)
            inside = (first >= low) & (first < high)
            u, v = u[inside], v[inside]
            # Words of equal length find each other; a longer one is only found.
            longer = letters[v, s] != 0
            u, v = np.concatenate([u, v[longer]]), np.concatenate([v, u[longer]])
            number += np.bincount(u, minlength=len(words))
            np.minimum.at(best, u, place[v])
    has = np.flatnonzero(number)
    top = order[best[has]]
    return pd.DataFrame(
        {"word": words[has], "n_near": number[has], "best_n": counts[top], "best": words[top]}
    )


# ---------------------------------------------------------------- Spark

_FILE = ("s", "low", "high", "head", "tail")


def _filed(words: DataFrame, stretches: Column) -> DataFrame:
    """Every word (with its ``s``) under each of the stretches (low, high)."""
    spread = words.select("word", "n", "s", F.inline(stretches))
    behind = F.greatest(F.col("s") - F.col("high"), F.lit(0))
    size = F.length("word")
    return spread.select(
        "word",
        "n",
        "s",
        "low",
        "high",
        F.substring("word", F.lit(1), F.col("low")).alias("head"),
        F.substring(F.col("word"), size - behind + 1, behind).alias("tail"),
    )


def _stretch(low: Column, high: Column) -> Column:
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def filed(vocab: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The words (word, n) under the keys in which each of their near words meets them.

    A word of m letters is filed for s = m and s = m - 1, each with two stretches; crowded
    files are cut in halves until none is crowded or its stretch is a single position.
    """
    size = F.length("word")
    both = vocab.select("word", "n", F.explode(F.array(size, size - 1)).alias("s"))
    half, end = F.floor(F.col("s") / 2), F.col("s") + 1
    now = _filed(both, F.array(_stretch(F.lit(0), half), _stretch(half, end)))
    done = None
    while True:
        now = cut_lineage(now, "filed")
        sizes = now.groupBy(*_FILE).agg(F.count(F.lit(1)).alias("_n"))
        crowded = sizes.where((F.col("_n") > settings.crowd) & (F.col("high") - F.col("low") > 1))
        crowded = cut_lineage(crowded.drop("_n"), "crowded")
        if not crowded.take(1):
            return now if done is None else done.unionByName(now)
        calm = now.join(crowded, list(_FILE), "left_anti")
        done = calm if done is None else done.unionByName(calm)
        # A crowded file is no group of its own here: its rows stay where they are if the
        # table of crowded files (one row per ``crowd`` words) is small, as Spark decides.
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        halves = F.array(_stretch(F.col("low"), middle), _stretch(middle, F.col("high")))
        hot = now.join(crowded, list(_FILE), "left_semi").select("word", "n", "s", halves.alias("_halves"))
        now = _filed(hot.select("word", "n", "s", "_halves"), F.col("_halves"))


def _searched(settings: Settings):
    columns = ["word", "n", *_FILE]

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        s, low, high = (int(rows[c].iat[0]) for c in ("s", "low", "high"))
        words = rows["word"].to_numpy(object)
        return search(words, rows["n"].to_numpy(np.int64), s, low, high, settings.block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, None
        for batch in batches:
            batch = batch[columns]
            keys = list(zip(*(batch[c].tolist() for c in _FILE), strict=True))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                key = keys[a]
                # Files of one stretch share a block; a file is never parted from its rest.
                if held and key != last and (size >= settings.block or key[:3] != last[:3]):
                    yield flush(held)
                    held, size = [], 0
                held.append(batch.iloc[a:b])
                size += b - a
                last = key
        if held:
            yield flush(held)

    return run


def near_words(vocab: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``word``, ``n_near`` and the best near word (``best_n``, ``best``) of those that have any."""
    dealt = filed(vocab, settings).repartition(tasks(vocab), *_FILE).sortWithinPartitions(*_FILE)
    # One row per file and word: pairs are counted where they are found.
    found = dealt.mapInPandas(
        _searched(settings), "word string, n_near long, best_n long, best string"
    )
    least = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    totals = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("_b"))
    return totals.select("word", "n_near", (-F.col("_b.m")).alias("best_n"), F.col("_b.best").alias("best"))


def group(vocab: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Form and root of every word of a vocabulary (word, n).

    Columns: word, n, n_near, form, form_n, root.  The form is the best near word if it is
    ``ratio`` times as frequent, else null; the root is the end of the chain of forms, the
    word itself without one.  Words must be distinct; no words, no rows.
    """
    vocab = cut_lineage(vocab.select("word", "n"), "vocabulary")
    near = near_words(vocab, settings)
    ok = F.col("best_n") >= settings.ratio * F.col("n")
    rows = cut_lineage(
        vocab.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(ok, F.col("best")).alias("form"),
            F.when(ok, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    # Frequencies grow ``ratio``-fold along a chain, so that doubling takes a few rounds.
    # A word is the form of its near words alone, a bounded number of rows a key.
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        links = cut_lineage(links, "links")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = links.join(further, "root", "left")
        if not joined.where("_next is not null").take(1):
            break
        links = joined.select("word", F.coalesce("_next", "root").alias("root"))
    return rows.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, settings: Settings = Settings(), one_in: int = 199) -> DataFrame:
    """``group`` over the words of whole documents (doc_id, text), slips put in on purpose.

    Null texts have no words; repeated rows count again; a null doc_id reads as nothing
    before the colon, so that its words' slips are the same in all such rows.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    words = docs.select(name.alias("_doc"), F.explode(runs_of_letters(F.col("text"))).alias("word"))
    slipped = words.select(with_slips(F.col("word"), F.col("_doc"), one_in).alias("word"))
    return group(vocabulary(slipped, settings), settings)
