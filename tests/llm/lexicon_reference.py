"""The lexicon as lists in memory give it, for small samples: what the Spark jobs must equal."""

from collections import Counter

import numpy as np

from driftgrid.llm.toxicity import Lexicon, Settings, _curve, _entries, _related, fold, normalised, weigh


def build(toxic: list[str], clean: list[str], settings: Settings = Settings()) -> Lexicon:
    """Choose entries one after the other, each for the toxic texts that none has covered.

    So a word that merely comes with a toxic one, as in copies of a text, is not taken.
    Words whose texts are all covered are taken afterwards if they come in as varied company:
    beside at least ``company`` different sets of chosen entries.
    """
    if not toxic or not clean:
        return Lexicon()
    bad, good = [fold(t) for t in toxic], [fold(t) for t in clean]
    least = max(settings.least_support, settings.support * len(bad))
    holders: dict[str, list[int]] = {}
    for i, text in enumerate(bad):
        for e in _entries(text, settings.stem):
            holders.setdefault(e, []).append(i)
    holders = {e: h for e, h in holders.items() if len(h) >= least}
    in_clean: Counter[str] = Counter()
    for text in good:
        in_clean.update(e for e in _entries(text, settings.stem) if e in holders)

    phrases, eased = _harmless(set(holders), in_clean, bad, good, settings)
    in_clean.update({e: n - in_clean[e] for e, n in eased.items()})

    def ratio(e: str, n: float) -> float:
        return ((n + 0.5) / (len(bad) + 1)) / ((in_clean[e] + 0.5) / (len(good) + 1))

    left = {e: set(h) for e, h in holders.items() if ratio(e, len(h)) >= settings.least_ratio}
    weights: dict[str, float] = {}
    while left and len(weights) < settings.entries:

        def worth(e: str) -> tuple:
            return (len(left[e]) * np.log(ratio(e, len(holders[e]))), e.endswith(" "), len(e), e)

        best = max(left, key=worth)
        covered = left.pop(best)
        if len(covered) < least:
            break
        weights[best] = float(np.log(ratio(best, len(holders[best]))))
        left = {e: rest for e, h in left.items() if len(rest := h - covered) >= least}
    chosen = [frozenset(weights.keys() & _entries(text, settings.stem)) for text in bad]
    rest = [
        e
        for e, h in holders.items()
        if ratio(e, len(h)) >= settings.least_ratio
        and not _related(e, weights)
        and len({chosen[i] for i in h}) >= settings.company
    ]
    for e in sorted(rest, key=lambda e: (len(holders[e]), e.endswith(" "), len(e), e), reverse=True):
        if len(weights) < settings.entries and not _related(e, weights):
            weights[e] = float(np.log(ratio(e, len(holders[e]))))
    exceptions = sorted({p for e in weights for p in phrases.get(e, ())})
    lexicon = Lexicon(weights, tuple(exceptions))
    found = lexicon.automaton()
    x = [normalised(weigh(t, found)[0], t) if len(found) else 0.0 for t in bad + good]
    return _curve(lexicon, np.array(x), np.array([1.0] * len(bad) + [0.0] * len(good)))


def _harmless(
    words: set[str], in_clean: Counter[str], bad: list[str], good: list[str], settings: Settings
) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Words that mark toxic texts once some phrases are left out: their phrases, and in how
    many clean texts they stand outside of these.

    A phrase is the word with a neighbour, found in clean texts far more than in toxic ones;
    a word has ``phrases`` of them at most.
    """
    known = {e[1:-1] for e in words if e.endswith(" ") and in_clean[e]}

    def pairs(text: str) -> dict[str, list[tuple[str, str]]]:
        tokens = ["", *text.split(), ""]
        out: dict[str, list[tuple[str, str]]] = {}
        for i, w in enumerate(tokens):
            if w in known:
                out.setdefault(w, []).append((f" {tokens[i - 1]} {w} ", f" {w} {tokens[i + 1]} "))
        return out

    in_good = [pairs(t) for t in good]
    harmless = Counter(p for d in in_good for p in {p for spots in d.values() for two in spots for p in two})
    harmful = Counter(p for t in bad for p in {p for spots in pairs(t).values() for two in spots for p in two})
    mild = {
        p: n
        for p, n in harmless.items()
        if n >= settings.least_support
        and n / len(good) >= settings.least_ratio * (harmful[p] + 0.5) / len(bad)
    }
    phrases: dict[str, list[str]] = {}
    for p in sorted(mild, key=lambda p: (-mild[p], p)):
        for w in p.split():
            if w in known and len(phrases.setdefault(w, [])) < settings.phrases:
                phrases[w].append(p)
    outside: Counter[str] = Counter()
    for d in in_good:
        for w in phrases.keys() & d.keys():
            safe = set(phrases[w])
            outside[w] += any(not safe.intersection(two) for two in d[w])
    return (
        {f" {w} ": found for w, found in phrases.items()},
        {f" {w} ": outside[w] for w in phrases},
    )
