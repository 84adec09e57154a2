"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.frames import text_blocks
from driftgrid.session import cut_lineage

# Letters of other scripts that look like Latin ones, and digits used for letters.
HOMOGLYPHS = dict(zip("аеорсухіѕкмтнвјԁɡαοεικνρτυχ", "aeopcyxiskmthbjdgaoeikvptux", strict=True))
DIGITS = dict(zip("013456789", "oieasgtbg", strict=True))
# Marks that stand for a letter when letters are next to them.
MARKS = dict(zip("@$!|", "asii", strict=True))


def _table() -> dict[int, str]:
    """Folds one character: base letter without accents, look-alikes, digits; l falls
    together with i, as 1 may mean either; all else parts words."""
    table = {}
    for code in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF00, 0xFF5F)]:
        plain = unicodedata.normalize("NFKD", chr(code)).lower()
        folded = ""
        for c in plain:
            c = HOMOGLYPHS.get(c, DIGITS.get(c, c))
            folded += "i" if c in "lı" else "ss" if c == "ß" else c if "a" <= c <= "z" else ""
        if not folded and chr(code).isalpha():
            folded = chr(code).lower()
        table[code] = folded or " "
    for mark in range(0x300, 0x370):  # accents that stand alone
        table[mark] = ""
    return table


FOLD = _table()
_MARKED = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])|(?<![^\W_])[@$](?=[^\W\d_])")
_LONG_RUN = re.compile(r"([a-z])\1\1+")
_SPELLED = re.compile(r"(?: [a-z]){4,}(?= )")


def fold(text: str) -> str:
    """Lower case, look-alikes and digit letters undone, runs of a letter cut to one,
    spelled-out words joined; words stand between single blanks."""
    if any(m in text for m in MARKS):
        text = _MARKED.sub(lambda m: MARKS[m.group()], text)
    words = text.lower().translate(FOLD).split()
    folded = f" {' '.join(words)} "
    folded = _LONG_RUN.sub(r"\1", folded)
    return _SPELLED.sub(lambda m: " " + m.group().replace(" ", ""), folded)


# Ends an entry that counts from its second hit on.
AGAIN = "+"


@dataclass(frozen=True)
class Settings:
    """At most ``sample`` toxic and ``sample_clean`` clean labelled texts teach the lexicon;
    every text is then scored whole.  One in ``trial`` of them (0: none) is kept back: an entry
    must be ``trial_ratio`` times as common in the toxic as in the clean ones there, if at least
    ``least_trial`` are toxic."""

    sample: int = 3000
    sample_clean: int = 6000
    trial: int = 5
    trial_ratio: float = 3.0
    least_trial: int = 20
    entries: int = 300
    stem: tuple[int, int] = (4, 10)
    support: float = 0.002
    least_support: int = 5
    least_ratio: float = 30.0
    company: int = 8
    phrases: int = 20


@dataclass
class Lexicon:
    """Weights of words (`` word ``) and word beginnings (`` stem``), phrases in which they
    mean no harm, and the logistic curve over the normalised weight.  An entry that ends in
    ``+`` counts from its second hit on."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    offset: float = -4.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for key, weight in self.weights.items():
            plain = key.rstrip(AGAIN)
            _, once, again = found.get(plain, (0, 0.0, 0.0))
            once, again = (once, weight) if key != plain else (weight, again)
            found.add_word(plain, (len(plain), once, again))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None, None))
        found.make_automaton()
        return found

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -40, 40)))


def weigh(folded: str, found: ahocorasick.Automaton) -> tuple[float, int]:
    """Summed weight of the hits that lie in no exception phrase, and their number."""
    hits, shelter = [], []
    for end, (size, once, again) in found.iter(folded):
        (shelter if once is None else hits).append((end - size + 1, end, once, again))
    if shelter:
        # Both lists are in order of their ends; phrases of one length class may overlap.
        starts = np.array([h[0] for h in shelter])
        ends = np.array([h[1] for h in shelter])
        hits = [h for h in hits if not np.any((starts <= h[0]) & (ends >= h[1]))]
    total, seen = 0.0, {}
    for start, end, once, again in hits:
        total += once
        if again:
            key = folded[start : end + 1]
            total += again if key in seen else 0.0
            seen[key] = True
    return total, len(hits)


def normalised(weight: float, folded: str) -> float:
    """Weight by length: the summed weight over the logarithm of the word count."""
    return weight / np.log(np.e + folded.count(" ") - 1)


def _entries(folded: str, stem: tuple[int, int]) -> set[str]:
    """Words and word beginnings of a text; those found twice or more also with ``+``."""
    once, again = set(), set()
    for w in folded.split():
        if len(w) >= stem[0]:
            new = {f" {w} ", *(f" {w[:n]}" for n in range(stem[0], min(stem[1], len(w)) + 1))}
            again |= new & once
            once |= new
    return once | {e + AGAIN for e in again}


def _related(entry: str, others: Iterable[str]) -> bool:
    """Whether the letters of an entry begin with those of another, or the other way round."""
    bare = entry.rstrip(f" {AGAIN}")
    rest = (o.rstrip(f" {AGAIN}") for o in others)
    return any(bare.startswith(o) or o.startswith(bare) for o in rest)


def _curve(lexicon: Lexicon, x: np.ndarray, y: np.ndarray) -> Lexicon:
    """A logistic curve over the normalised weight, by Newton's steps with a light penalty."""
    # In one order, so that sums come out the same.
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    # Both classes weigh the same, so that 0.5 parts them wherever they can be parted.
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    a = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (p - y)) + 0.05 * beta
        hess = (a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
    lexicon.slope, lexicon.offset = map(float, beta)
    return lexicon


def _phrases(folded: str, known: set[str]) -> dict[str, list[tuple[str, str]]]:
    """For each known word of a text its neighbours on both sides, as phrases, per place."""
    tokens = ["", *folded.split(), ""]
    out: dict[str, list[tuple[str, str]]] = {}
    for i, w in enumerate(tokens):
        if w in known:
            out.setdefault(w, []).append((f" {tokens[i - 1]} {w} ", f" {w} {tokens[i + 1]} "))
    return out


class _Class:
    """Sizes of the learning part and the trial part of a class of texts."""

    def __init__(self, sizes: dict[tuple[int, bool], int], kind: int):
        self.learn, self.trial = sizes.get((kind, False), 0), sizes.get((kind, True), 0)


def _sample(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings) -> DataFrame:
    """The folded labelled texts that teach: toxic, number in its class, trial, folded."""
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic").where(usable)
    marks = None
    for kind, most in ((1, settings.sample), (0, settings.sample_clean)):
        one = known.where(F.col("toxic") == kind).distinct()
        one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        marks = one if marks is None else marks.unionByName(one)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(marks), "doc_id").select("toxic", "text").distinct()
    trial = F.lit(False)
    if settings.trial:
        trial = F.crc32(F.col("text").cast("binary")) % settings.trial == 0

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    # Numbers of the sampled texts, a bounded number of them.
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("text"), "text")
    return cut_lineage(
        rows.select(
            "toxic",
            (F.row_number().over(order) - 1).alias("number"),
            trial.alias("trial"),
            folded("text").alias("folded"),
        ),
        "toxicity-sample",
    )


def _tally(sample: DataFrame, names: Callable[[str], Iterable[str]], name: str) -> DataFrame:
    """Texts of the sample per name that ``names`` finds in them: ``bad`` and ``good`` that
    teach, ``t_bad`` and ``t_good`` on trial.  Names are counted within blocks of texts first."""
    columns = ["bad", "good", "t_bad", "t_good"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in text_blocks(batches, "folded", 1 << 19):
            found: dict[str, list[int]] = {}
            for toxic, trial, text in zip(block["toxic"], block["trial"], block["folded"], strict=True):
                at = 2 * bool(trial) + (toxic != 1)
                for n in names(text):
                    found.setdefault(n, [0, 0, 0, 0])[at] += 1
            if found:
                rows = pd.DataFrame(list(found.values()), columns=columns, dtype="int64")
                yield rows.assign(**{name: list(found)})

    schema = ", ".join(f"{c} long" for c in columns) + f", {name} string"
    parts = sample.select("toxic", "trial", "folded").mapInPandas(run, schema)
    return parts.groupBy(name).agg(*(F.sum(c).alias(c) for c in columns))


def _members(sample: DataFrame, stem: tuple[int, int], only: set[str]) -> DataFrame:
    """The numbers of the sample's texts that have each entry of ``only``."""

    @F.pandas_udf("array<string>")
    def entries(texts: pd.Series) -> pd.Series:
        return pd.Series([list(_entries(t, stem) & only) for t in texts], dtype=object)

    rows = sample.select("number", F.explode(entries("folded")).alias("entry"))
    return rows.groupBy("entry").agg(F.collect_list("number").alias("numbers"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings()) -> Lexicon:
    """Lexicon of the labelled documents that ``usable`` (of ``doc_id``) allows.

    The texts with the least hashes are taken, whole, as many of each class as the settings
    say.  Words, word beginnings and neighbour phrases are counted by Spark; the driver sees
    those that mark toxic texts, with the numbers of their toxic texts.

    Entries are chosen one after the other, each for the toxic texts that none has covered.
    So a word that merely comes with a toxic one, as in copies of a text, is not taken.
    Words whose texts are all covered are taken afterwards if they come in as varied company:
    beside at least ``company`` different sets of chosen entries.  All must hold on the texts
    kept for trial too.
    """
    sample = _sample(docs, labels, usable, settings)
    sizes = {(r.toxic, r.trial): r["count"] for r in sample.groupBy("toxic", "trial").count().collect()}
    bad, good = _Class(sizes, 1), _Class(sizes, 0)
    if not bad.learn or not good.learn:
        return Lexicon()
    least = max(settings.least_support, settings.support * bad.learn)

    def ratio(n: float, m: float) -> float:
        return ((n + 0.5) / (bad.learn + 1)) / ((m + 0.5) / (good.learn + 1))

    counts = _tally(sample, lambda t: _entries(t, settings.stem), "entry").where(F.col("bad") >= least)
    share = ((F.col("bad") + 0.5) / (bad.learn + 1)) * (good.learn + 1)
    # Whole words may do once the phrases in which they are harmless are left out.
    word = F.col("entry").endswith(" ") & (F.col("good") > 0)
    spared = F.when(word, 0.5).otherwise(F.col("good") + 0.5)
    found = counts.where(share / spared >= settings.least_ratio * (1 - 1e-9)).collect()
    stats = {r.entry: [r.bad, r.good, r.t_bad, r.t_good] for r in found}
    known = {e[1:-1] for e, n in stats.items() if e.endswith(" ") and n[1]}
    phrases = _harmless(sample, known, stats, bad.learn, good.learn, settings)

    def holds(e: str) -> bool:
        n, m, t_bad, t_good = stats[e]
        if ratio(n, m) < settings.least_ratio:
            return False
        if bad.trial < settings.least_trial:
            return True
        on_trial = ((t_bad + 0.5) / (bad.trial + 1)) / ((t_good + 0.5) / (good.trial + 1))
        return t_bad > 0 and on_trial >= settings.trial_ratio

    kept = {e for e in stats if holds(e)}
    lists = _members(sample.where("toxic = 1 and not trial"), settings.stem, kept).collect()
    holders = {r.entry: sum(1 << i for i in r.numbers) for r in lists}
    weight = {e: float(np.log(ratio(*stats[e][:2]))) for e in holders}
    left, weights = dict(holders), {}
    while left and len(weights) < settings.entries:

        def worth(e: str) -> tuple:
            gain = left[e].bit_count() * np.log(ratio(*stats[e][:2]))
            return (gain, e.endswith(" "), len(e), e)

        best = max(left, key=worth)
        covered = left.pop(best)
        if covered.bit_count() < least:
            break
        weights[best] = weight[best]
        left = {e: rest for e, h in left.items() if (rest := h & ~covered).bit_count() >= least}
    chosen: dict[int, frozenset] = {}
    for i in range(max((h.bit_length() for h in holders.values()), default=0)):
        chosen[i] = frozenset(e for e in weights if holders[e] >> i & 1)
    rest = [
        e
        for e, h in holders.items()
        if not _related(e, weights)
        and len({chosen[i] for i in chosen if h >> i & 1}) >= settings.company
    ]
    for e in sorted(rest, key=lambda e: (holders[e].bit_count(), e.endswith(" "), len(e), e), reverse=True):
        if len(weights) < settings.entries and not _related(e, weights):
            weights[e] = weight[e]
    exceptions = sorted({p for e in weights for p in phrases.get(e, ())})
    return _fitted(Lexicon(weights, tuple(exceptions)), sample)


def _harmless(
    sample: DataFrame, known: set[str], stats: dict[str, list], n_bad: int, n_good: int, settings: Settings
) -> dict[str, list[str]]:
    """Phrases in which words that may mark toxic texts mean no harm.

    A phrase is the word with a neighbour, found in clean texts far more than in toxic ones;
    a word has ``phrases`` of them at most.  ``stats`` of such a word then counts only the
    clean texts in which it stands outside of its phrases.
    """
    if not known:
        return {}

    def listed(text: str) -> set[str]:
        return {p for spots in _phrases(text, known).values() for two in spots for p in two}

    share = settings.least_ratio * (F.col("bad") + 0.5) / n_bad
    enough = (F.col("good") >= settings.least_support) & (F.col("good") / n_good >= share)
    mild = {r.phrase: r.good for r in _tally(sample, listed, "phrase").where(enough).collect()}
    phrases: dict[str, list[str]] = {}
    for p in sorted(mild, key=lambda p: (-mild[p], p)):
        for w in p.split():
            if w in known and len(phrases.setdefault(w, [])) < settings.phrases:
                phrases[w].append(p)
    if not phrases:
        return {}

    def outside(text: str) -> list[str]:
        spots = _phrases(text, set(phrases)).items()
        return [w for w, s in spots if any(not set(phrases[w]).intersection(two) for two in s)]

    left = {r.word: r for r in _tally(sample.where("toxic = 0"), outside, "word").collect()}
    for w in phrases:
        stats[f" {w} "][1] = left[w].good if w in left else 0
        stats[f" {w} "][3] = left[w].t_good if w in left else 0
    return {f" {w} ": found for w, found in phrases.items()}


def _fitted(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """The lexicon with its curve, from one number per text of the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def weight(texts: pd.Series) -> pd.Series:
        found = shared.value.automaton()
        return texts.map(lambda t: float(normalised(weigh(t, found)[0], t)) if len(found) else 0.0)

    rows = sample.where(~F.col("trial")).select("toxic", weight("folded").alias("x")).collect()
    return _curve(lexicon, np.array([r.x for r in rows]), np.array([float(r.toxic) for r in rows]))


def scorer(df: DataFrame, lexicon: Lexicon):
    """A column function: text to struct of ``score`` and ``hits``."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # its size is set by the settings

    @F.pandas_udf("score double, hits int")
    def score(texts: pd.Series) -> pd.DataFrame:
        found = shared.value.automaton()
        x, n = np.zeros(len(texts)), np.zeros(len(texts), np.int32)
        for i, t in enumerate(texts):
            if isinstance(t, str) and t and len(found):
                folded = fold(t)
                weight, n[i] = weigh(folded, found)
                x[i] = normalised(weight, folded)
        return pd.DataFrame({"score": shared.value.probability(x), "hits": n})

    return score


def rate(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add struct ``toxicity`` (``score``, ``hits``) to every row.

    A null or empty text, or one without a hit, gets the score of a clean text.  Repeated
    rows get the same score, an empty table gives an empty one; an input column of the same
    name is replaced.
    """
    return docs.withColumn("toxicity", scorer(docs, lexicon)(F.col(f"`{text}`")))
