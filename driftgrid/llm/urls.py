"""URL filters: wildcard rules packed into Shift-And masks and run over all URLs at once."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.frames import utf8, without


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, all its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}*"


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

# Hosts that no rule names are blocked when one of these fits.
BLOCKED_HOSTS = ("*casino*", "*poker*", "*pills*", "*viagra*", "*spam*", "*porn*")


class GlobSet:
    """Globs over ``.host/path`` as one bit-parallel automaton of several 64-bit words.

    ``*`` stands for any bytes; before the first ``/`` of a glob it does not match ``/``, so
    it stays in the host.  ``?`` stands for one byte.
    A glob of m symbols gets m + 1 state bits in a row.  Bit i of ``step[c]`` lets byte c
    lead from state i to the next, bit i of ``stay[c]`` keeps state i: all states of all
    globs move in one shift.
    """

    def __init__(self, globs: Sequence[str]):
        step: list[tuple[int, int | None]] = []  # (state, byte or any)
        stay: list[tuple[int, bool]] = []  # (state, may eat a slash)
        starts, ends, state = [], [], 0
        for glob in globs:
            in_host = True
            starts.append(state)
            for byte in utf8(glob):
                if byte == ord("*"):
                    stay.append((state, not in_host))
                    continue
                in_host = in_host and byte != ord("/")
                step.append((state, None if byte == ord("?") else byte))
                state += 1
            ends.append(state)
            state += 1
        words = state // 64 + 1
        self.step = np.zeros((256, words), np.uint64)
        self.stay = np.zeros((256, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        self.ends = ends
        bit = [np.uint64(1 << (s % 64)) for s in range(state + 1)]
        for s, byte in step:
            self.step[slice(None) if byte is None else byte, s // 64] |= bit[s]
        for s, slash in stay:
            self.stay[:, s // 64] |= bit[s]
            if not slash:
                self.stay[ord("/"), s // 64] &= ~bit[s]
        for s in starts:
            self.start[s // 64] |= bit[s]

    def match(self, subjects: Sequence[bytes]) -> np.ndarray:
        """Which glob (column) fits which whole subject (row)."""
        lengths = np.array([len(s) for s in subjects], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        text = np.frombuffer(b"".join(subjects[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(order) else lengths
        states = np.tile(self.start, (len(order), 1))
        for at in range(int(lengths[0]) if len(order) else 0):
            live = int(np.searchsorted(-lengths, -at, side="left"))  # those longer than ``at``
            byte = text[begin[:live] + at]
            now = states[:live]
            moved = now & self.step[byte]
            shifted = moved << np.uint64(1)
            shifted[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            states[:live] = shifted | (now & self.stay[byte])
        fits = np.empty((len(order), len(self.ends)), bool)
        for k, end in enumerate(self.ends):
            fits[order, k] = (states[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) == 1
        return fits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(raw) + F.lit(1))
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(tail, r"^[^?#]*", 0)


def judge(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    blocked_hosts: Sequence[str] = BLOCKED_HOSTS,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    Of the rules that fit, the longest wins, of equals the one that blocks.  Without one,
    ``rule`` is null and a host that fits a glob of ``blocked_hosts`` is blocked, any other
    URL, also null, empty or without a host, is allowed.  Input columns of the four names
    are replaced.  Rows are judged one by one: repeated rows get the same verdict, an empty
    table gives an empty one.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    # A host glob without a path, then with any path.
    hosts_only = [g + tail for g in blocked_hosts for tail in ("", "/*")]
    globs = GlobSet([r.glob for r in ranked] + hosts_only)
    n = len(ranked)

    @F.pandas_udf("rule string, verdict string")
    def verdicts(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        subjects = [utf8(f".{h}{p}") for h, p in zip(hosts, paths, strict=True)]
        fits = globs.match(subjects)
        blocked = fits[:, n:].any(axis=1)
        rule = np.full(len(subjects), None, object)
        verdict = np.where(blocked, "block", "allow").astype(object)
        for k in reversed(range(n)):
            rule[fits[:, k]] = ranked[k].name
            verdict[fits[:, k]] = ranked[k].verdict
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    host, path = host_and_path(F.col(f"`{url}`"))
    kept = [f"`{c}`" for c in without(pages, ["host", "path", "rule", "verdict"]).columns]
    found = pages.select(*kept, host.alias("host"), path.alias("path"))
    found = found.withColumn("__v", verdicts("host", "path"))
    return found.select(*kept, "host", "path", "__v.rule", "__v.verdict")
