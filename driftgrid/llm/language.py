"""Language ID: averaged hashed subword embeddings under a linear softmax, with rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.frames import utf8

UNKNOWN = "und"
# ASCII letters and the bytes of other scripts stay; digits, marks and controls part words.
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
_PIECE = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled texts per language at most train the model, a longer one than
    ``sample_chars`` as several; up to ``pieces`` parts of each are learned from.  Every text is
    then predicted whole."""

    sample: int = 800
    sample_chars: int = 60_000
    pieces: int = 12
    buckets: int = 1 << 15
    dim: int = 16
    lengths: tuple[int, ...] = (2, 3, 4)
    epochs: int = 4
    rate: float = 4.0
    # Share of rightly predicted documents that the rejection may cost on held-out labels.
    lost: float = 0.001
    # Rejection is calibrated apart for texts of up to so many subwords, and for longer ones.
    classes: tuple[int, ...] = (32, 128, 512, 2048)
    seed: int = 7


def words_of(text: str) -> list[bytes]:
    return utf8(text.lower()).translate(_KEEP).split()


def pieces(words: list[bytes]) -> list[bytes]:
    """Words with a blank around each, cut between words into runs of bounded length."""
    out, run, size = [], [], 0
    for w in words:
        run.append(w)
        size += len(w) + 1
        if size >= _PIECE:
            out.append(b" " + b" ".join(run) + b" ")
            run, size = [], 0
    if run:
        out.append(b" " + b" ".join(run) + b" ")
    return out


def grams(data: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords and where each starts; none reaches over a blank."""
    blank = data == 32
    wide = data.astype(np.uint32)
    buckets, starts = [], []
    for n in settings.lengths:
        if len(data) < n:
            continue
        last = len(data) - n + 1
        h = np.full(last, np.uint32(n), np.uint32)
        whole = np.ones(last, bool)
        for j in range(n):
            h = (h ^ wide[j : j + last]) * _FACTORS[j % len(_FACTORS)]
            h ^= h >> np.uint32(15)
            if 0 < j < n - 1:
                whole &= ~blank[j : j + last]
        if n == 2:
            whole &= ~(blank[:last] & blank[1 : 1 + last])
        at = np.flatnonzero(whole)
        buckets.append((h[at] & np.uint32(settings.buckets - 1)).astype(np.int32))
        starts.append(at)
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(starts)


@dataclass
class Model:
    """``table[b]`` is what bucket b adds to the logits: its embedding times the softmax layer.

    ``usual[b]`` is the log frequency of bucket b in the language that has it most.  A text is
    rejected if its probability is below ``floor`` (no language stands out, not even as in a
    text half of one and half of another), or its mean ``usual`` below ``limits`` of its class
    of lengths (no learned language has such subwords: another language, or gibberish).
    """

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    usual: np.ndarray
    temperature: float
    floor: float
    limits: np.ndarray
    settings: Settings

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """Language, calibrated probability, rejection and mean ``usual`` of every whole text,
        and its class of lengths.

        A null text or one without a letter is ``und`` with score 0, rejected.
        """
        pred = np.full(len(texts), UNKNOWN, object)
        score = np.zeros(len(texts))
        parts: list[tuple[int, bytes]] = []
        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)) and self.langs:
                parts += [(i, p) for p in pieces(words_of(t))]
        sums = np.zeros((len(texts), len(self.langs)))
        counts = np.zeros(len(texts))
        usual = np.zeros(len(texts))
        low = 0
        while low < len(parts):
            high, size = low, 0
            while high < len(parts) and (high == low or size + len(parts[high][1]) <= _PIECE):
                size += len(parts[high][1])
                high += 1
            data = np.frombuffer(b"".join(p for _, p in parts[low:high]), np.uint8)
            owner = np.repeat(
                np.array([i for i, _ in parts[low:high]]), [len(p) for _, p in parts[low:high]]
            )
            buckets, at = grams(data, self.settings)
            rows = owner[at]
            first = int(owner[0])
            span = int(owner[-1]) - first + 1
            counts[first : first + span] += np.bincount(rows - first, minlength=span)
            usual[first : first + span] += np.bincount(
                rows - first, weights=self.usual[buckets], minlength=span
            )
            for k in range(len(self.langs)):
                sums[first : first + span, k] += np.bincount(
                    rows - first, weights=self.table[buckets, k], minlength=span
                )
            low = high
        seen = np.flatnonzero(counts)
        if len(seen):
            p = softmax((sums[seen] / counts[seen, None] + self.bias) / self.temperature)
            best = p.argmax(axis=1)
            pred[seen] = np.array(self.langs, object)[best]
            score[seen] = p[np.arange(len(seen)), best]
            usual[seen] /= counts[seen]
        kind = np.searchsorted(self.settings.classes, counts, side="left")
        rejected = (pred == UNKNOWN) | (score < self.floor) | (usual < self.limits[kind])
        return pd.DataFrame(
            {"lang_pred": pred, "score": score, "rejected": rejected, "usual": usual, "kind": kind}
        )


def unlearned(settings: Settings) -> Model:
    """A model that knows no language: every text is unknown."""
    none, open_ = np.zeros(0, np.float32), np.full(len(settings.classes) + 1, -np.inf)
    table = np.zeros((settings.buckets, 0), np.float32)
    return Model([], table, none, np.zeros(settings.buckets, np.float32), 1.0, 0.0, open_, settings)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], settings: Settings) -> Model:
    """Stochastic gradient descent over pieces of the texts of varied length.

    One text in five is held out of it to calibrate the probabilities and the rejection.
    """
    langs = sorted(set(labels))
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    # Buckets and counts of a piece, in the narrowest types that hold them.
    small = np.min_scalar_type(settings.buckets - 1)
    samples: list[tuple[np.ndarray, np.ndarray, int]] = []
    seen = np.zeros((len(langs), settings.buckets))
    for i in used:
        words, at = words_of(texts[i]), 0
        label = langs.index(labels[i])
        taken = 0
        while at < len(words) and taken < settings.pieces:
            step = int(rng.integers(3, 120))
            data = np.frombuffer(b" " + b" ".join(words[at : at + step]) + b" ", np.uint8)
            ids, n = np.unique(grams(data, settings)[0], return_counts=True)
            samples.append((ids.astype(small), n.astype(np.min_scalar_type(n.max())), label))
            seen[label, ids] += n
            # Pieces are spread over the whole text, however long it is.
            at += max(step, len(words) // settings.pieces)
            taken += 1
    embed = rng.normal(0, 0.1, (settings.buckets, settings.dim)).astype(np.float32)
    layer = np.zeros((settings.dim, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    steps, done = max(1, settings.epochs * len(samples)), 0
    for _ in range(settings.epochs):
        for s in rng.permutation(len(samples)):
            ids, n, label = samples[s]
            share = n.astype(np.float32) / np.float32(n.sum())
            rate = settings.rate * (1 - done / steps)
            hidden = share @ embed[ids]
            g = softmax(hidden @ layer + bias).astype(np.float32)
            g[label] -= 1
            back = layer @ g
            layer -= rate * 0.1 * np.outer(hidden, g)
            bias -= rate * 0.01 * g
            embed[ids] -= np.outer(rate * share, back)
            done += 1
    share = (seen + 0.5) / (seen + 0.5).sum(axis=1, keepdims=True)
    model = unlearned(settings)
    model.langs, model.table, model.bias = langs, (embed @ layer).astype(np.float32), bias
    model.usual = np.log(share.max(axis=0)).astype(np.float32)
    return calibrated(model, [texts[i] for i in held], [labels[i] for i in held])


def _trials(texts: list[str], labels: list[str], settings: Settings) -> list[tuple[str, set[str]]]:
    """Held-out texts and the languages they hold: whole, beginnings of several lengths, and
    for every second one its first half after that of the next text of another language."""
    out = []
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        words = text.split()
        out += [(text, {label})]
        out += [(" ".join(words[:n]), {label}) for n in (2, 6, 24, 100) if n < len(words)]
        other = next((j for j in range(i + 1, min(i + 20, len(texts))) if labels[j] != label), None)
        if i % 2 == 0 and other is not None:
            more = texts[other].split()
            size = max(1, min(len(words), len(more)) // 2)
            out.append((" ".join(words[:size] + more[:size]), {label, labels[other]}))
    return out


def calibrated(model: Model, texts: list[str], labels: list[str]) -> Model:
    """The temperature with the least log loss on whole texts, then the highest bounds that
    lose no more than ``lost`` of the right predictions, loosened as the sample is small: of
    all for the probability, half-way to chance; of each class of lengths for the subwords,
    less their distance to the median again.  A class without trials takes the loosest limit."""
    if not texts or len(model.langs) < 1:
        return model
    truth, best = np.array(labels, object), (np.inf, 1.0)
    for temperature in (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0):
        model.temperature = temperature
        out = model.predict(texts)
        others = max(1, len(model.langs) - 1)
        right = np.where(out.lang_pred == truth, out.score, (1 - out.score) / others)
        best = min(best, (float(-np.log(np.clip(right, 1e-9, 1)).mean()), temperature))
    model.temperature = best[1]
    trials = _trials(texts, labels, model.settings)
    out = model.predict([t for t, _ in trials])
    out = out[[p in held for p, (_, held) in zip(out.lang_pred, trials, strict=True)]]

    limits = np.full(len(model.limits), np.nan)
    for kind, values in out.groupby("kind").usual:
        least = values.quantile(model.settings.lost)
        limits[kind] = least - (values.median() - least)
    if len(out):
        model.limits = np.where(np.isnan(limits), np.nanmin(limits), limits)
        chance = 1 / len(model.langs)
        model.floor = (chance + float(out.score.quantile(model.settings.lost))) / 2
    return model


def learn(docs: DataFrame, usable: Column, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """Train on at most ``settings.sample`` labelled rows of each language, chosen by the
    hash of their text; a long text counts as several of ``sample_chars``.  Without labelled
    rows the model knows no language."""
    t, y = F.col(f"`{text}`"), F.col(f"`{lang}`")
    chars = settings.sample_chars
    cut = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    parts = F.explode(F.when(F.length(t) <= chars, F.array(t)).otherwise(cut))
    able = docs.where(usable & y.isNotNull() & t.isNotNull()).select(y.alias("label"), parts.alias("text"))
    able = able.where(F.col("text").rlike(r"\p{L}"))
    able = able.withColumn("h", F.xxhash64("text"))
    # Only hashes are ranked: first in 64 parts of each language, then the best of the parts.
    within = Window.partitionBy("label", F.pmod("h", F.lit(64))).orderBy("h")
    across = Window.partitionBy("label").orderBy("h")
    marks = able.select("label", "h")
    for window in (within, across):
        marks = marks.withColumn("r", F.row_number().over(window))
        marks = marks.where(F.col("r") <= settings.sample).select("label", "h")
    marks = marks.distinct()
    rows = able.join(F.broadcast(marks), ["label", "h"]).dropDuplicates(["label", "h"])
    found = sorted((r.label, r.text) for r in rows.select("label", "text").collect())
    if not found:
        return unlearned(settings)
    return train([t for _, t in found], [y for y, _ in found], settings)


def predictor(df: DataFrame, model: Model):
    """A column function: text to struct of ``lang_pred``, ``score`` and ``rejected``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is set by the settings

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        sizes = texts.str.len().fillna(0).to_numpy(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (4 << 20))) + 1
        for low, high in zip([0, *cuts], [*cuts, len(texts)], strict=True):
            part = [t if isinstance(t, str) else None for t in texts.iloc[low:high]]
            out.append(shared.value.predict(part)[["lang_pred", "score", "rejected"]])
        return pd.concat(out, ignore_index=True)

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add struct ``language`` (``lang_pred``, ``score``, ``rejected``) to every row.

    Repeated rows get the same prediction, empty tables give empty ones; an input column of
    the same name is replaced.
    """
    return docs.withColumn("language", predictor(docs, model)(F.col(f"`{text}`")))
