"""Conversation repair: the cheapest edits that make the roles take turns.

Rows of a conversation, in the order of ``turn``, become a few letters each: the initial of
the role and whether the row is whole, cut short, or must go.  Over these runs a dynamic
programme on four states (nothing yet, after ``s``, after ``u``, after ``a``); what follows a
row costs least when it ends with nothing or after ``a``.  Costs of what follows are kept at
every root-of-n-th row only; walking forward, each stretch between two such rows is worked
out anew and the ASCII-least of the tight edits is taken.  A conversation of n rows so needs
n bytes and some multiple of the root of n; texts are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.frames import BLANKS, tasks
from driftgrid.plans import ordered
from driftgrid.session import cut_lineage


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


# ---------------------------------------------------------------- one conversation

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  A missing user turn follows all
# but u, a missing assistant turn u alone.
_SPEAKS = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
_KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_FAR = 1 << 60
_INITIALS = "sua?"
# A row's code: place of its initial in _INITIALS, plus 4 if cut short, or 8 if it must go.
TRUNCATED, GONE = 4, 8
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


class Repair:
    """Edits for strings of row codes under given costs."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        # For each code: what keeping and reroling cost (None: not allowed), and the states
        # keeping leads to.
        self.keep, self.rerole = [], []
        for code in range(16):
            extra = costs.truncated if code & TRUNCATED else 0
            initial = _INITIALS[code & 3]
            moves = [_KEPT.get((initial, q)) for q in range(4)]
            self.keep.append([None if r is None or code >= GONE else (extra, r) for r in moves])
            self.rerole.append(None if code >= GONE else extra + costs.rerole)

    def _filled(self, raw: list[int]) -> tuple[int, ...]:
        """Costs of what follows when turns may be put in first."""
        best, put = list(raw), self.costs.insert
        for _ in range(2):  # no more than two in a row are ever of use
            for q in range(4):
                best[q] = min(best[q], put + best[_SPEAKS[q]])
        return tuple(best)

    def _before(self, code: int, after: tuple[int, ...]) -> tuple[int, ...]:
        keep, rerole, drop = self.keep[code], self.rerole[code], self.costs.delete
        raw = []
        for q in range(4):
            cost = drop + after[q]
            if keep[q] is not None:
                extra, r = keep[q]
                cost = min(cost, extra + after[r])
            if rerole is not None:
                cost = min(cost, rerole + after[_SPEAKS[q]])
            raw.append(cost)
        return self._filled(raw)

    def edits(self, codes: bytes) -> tuple[int, str]:
        """Least cost, and the ASCII-least of the cheapest edits."""
        n = len(codes)
        step = max(1, isqrt(n))
        last = self._filled([0, _FAR, _FAR, 0])
        kept = {n: last}
        now = last
        for i in range(n - 1, -1, -1):
            now = self._before(codes[i], now)
            if i % step == 0:
                kept[i] = now
        cost, state, out = now[0], 0, []
        for low in range(0, n, step):
            high = min(low + step, n)
            block = [kept.pop(high)]
            for i in range(high - 1, low - 1, -1):
                block.append(self._before(codes[i], block[-1]))
            for i in range(low, high):
                state = self._walk(codes[i], state, block[high - i], block[high - i - 1], out)
            kept[high] = block[0]
        while state in (1, 2):
            out.append("I")
            state = _SPEAKS[state]
        return cost, "".join(out)

    def _walk(self, code: int, q: int, here: tuple, after: tuple, out: list[str]) -> int:
        """Append the least tight edits up to this row's own; the state behind it."""
        while True:
            left = here[q]
            if self.costs.delete + after[q] == left:
                out.append("D")
                return q
            if self.costs.insert + here[_SPEAKS[q]] == left:
                out.append("I")
                q = _SPEAKS[q]
                continue
            keep = self.keep[code][q]
            if keep is not None and keep[0] + after[keep[1]] == left:
                out.append("K")
                return keep[1]
            out.append("R")
            return _SPEAKS[q]


def illegal(codes: bytes) -> int:
    """Neighbouring rows whose initials are not su, ua or au."""
    names = [_INITIALS[c & 3] for c in codes]
    return sum(pair not in _LEGAL for pair in zip(names, names[1:], strict=False))


# ---------------------------------------------------------------- Spark

# Rows of a conversation that are packed into one string of codes at first.
BLOCK = 4096


def key(conv_id: Column) -> Column:
    """A text that tells conversations apart, null ones too."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def placed(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with their place ``_pos`` in the conversation.

    Order: turn, nulls first; rows of one turn by role and text's digest, so that equal ones
    are neighbours.  Null roles and texts count as empty.  A conversation of any size is
    spread over many tasks.
    """
    slim = rows.select(
        key(F.col("conv_id")).alias("_conv"),
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    marked = slim.withColumn("_digest", F.md5(F.concat_ws(":", F.md5("role"), "text")))
    # Repeats of a row need not be told apart: any order of theirs gives the same places.
    return ordered.positions(marked, ["_conv"], ["turn", "role", "_digest"], "_pos")


def report(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: what is wrong with it, and its cheapest repair.

    ``rows`` come from ``placed``.  Columns: _conv, conv_id, n_rows, gaps, blank, duplicate,
    truncated, illegal, cost, audit.  Each row's first fault counts.  Repeats are found as
    all but the first row of a digest, by partial minima; codes are packed a block of rows at
    a time.
    """
    solid = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select(
        "_conv",
        "conv_id",
        "turn",
        "_pos",
        "_digest",
        F.substring("role", 1, 1).alias("_initial"),
        (F.length(solid) == 0).alias("_blank"),
        (~F.substring(solid, -1, 1).isin(*".!?")).alias("_cut"),
    )
    light = cut_lineage(light, "light")
    first = light.groupBy("_conv", "_digest").agg(F.min("_pos").alias("_pos"))
    first = first.select("_conv", "_pos", F.lit(True).alias("_first"))
    blank = F.col("_blank")
    again = ~blank & F.col("_first").isNull()
    cut = ~blank & ~again & F.col("_cut")
    initial = F.array_position(F.array(*(F.lit(c) for c in _INITIALS[:3])), F.col("_initial"))
    kind = F.when(initial == 0, 3).otherwise(initial - 1)
    judged = light.join(first, ["_conv", "_pos"], "left").select(
        "_conv",
        "conv_id",
        "turn",
        "_pos",
        blank.cast("long").alias("_b"),
        again.cast("long").alias("_d"),
        cut.cast("long").alias("_t"),
        (kind + F.when(blank | again, GONE).when(cut, TRUNCATED).otherwise(0)).cast("int").alias("_code"),
    )
    judged = cut_lineage(judged, "judged")
    turns = F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count_distinct("turn")
    counts = judged.groupBy("_conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        F.sum("_b").alias("blank"),
        F.sum("_d").alias("duplicate"),
        F.sum("_t").alias("truncated"),
    )
    blocks = (
        judged.withColumn("_block", F.floor(F.col("_pos") / BLOCK))
        .groupBy("_conv", "_block")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_code"))).alias("_rows"))
        .select("_conv", "_block", F.array_join(F.transform("_rows", lambda r: F.hex(r["_code"])), "").alias("_codes"))
    )
    # As long as the audit itself, which is one value of the result.
    strings = blocks.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_block", "_codes"))).alias("_all"))
    strings = strings.select("_conv", F.array_join("_all._codes", "").alias("_codes"))

    @F.pandas_udf("illegal long, cost long, audit string")
    def solve(texts: pd.Series) -> pd.DataFrame:
        repair, out = Repair(costs), []
        for t in texts:
            codes = bytes(int(c, 16) for c in t)
            out.append((illegal(codes), *repair.edits(codes)))
        return pd.DataFrame(out, columns=["illegal", "cost", "audit"])

    solved = strings.select("_conv", solve("_codes").alias("_s")).select("_conv", "_s.*")
    return counts.join(solved, "_conv")


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired conversations: rows (_conv, conv_id, step, role, text), in order.

    ``rows`` come from ``placed``, ``reports`` from ``report``.  A conversation is streamed
    through one task, its edits ahead of its rows; neither is gathered.  Conversations of which
    nothing is left give no row.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = F.lit(None).cast("string")
    plans = reports.select(
        "_conv", "conv_id", F.lit(-1).cast("long").alias("_pos"), none.alias("role"), F.col("audit").alias("text")
    )
    stream = plans.unionByName(rows.select("_conv", "conv_id", F.col("_pos").cast("long").alias("_pos"), "role", "text"))
    dealt = stream.repartition(tasks(rows), "_conv").sortWithinPartitions("_conv", "_pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        audit, at, state, step = "", 0, 0, 0
        last = (None, None)

        def rest(out: list) -> None:
            nonlocal at, state, step
            while at < len(audit) and audit[at] == "I":
                out.append((*last, step, ROLES[state], ""))
                state = _SPEAKS[state]
                at, step = at + 1, step + 1

        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in ("_conv", "conv_id", "_pos", "role", "text"))
            for conv, name, pos, role, text in zip(*columns, strict=True):
                if pos < 0:
                    rest(out)
                    audit, at, state, step, last = text, 0, 0, 0, (conv, name)
                    continue
                rest(out)
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "R":
                    role, state = ROLES[state], _SPEAKS[state]
                else:
                    state = _KEPT[(role[:1], state)]
                out.append((*last, step, role, text))
                step += 1
            yield pd.DataFrame(out, columns=["_conv", "conv_id", "step", "role", "text"])
        out = []
        rest(out)
        yield pd.DataFrame(out, columns=["_conv", "conv_id", "step", "role", "text"])

    # Names travel as text, so that nulls stay nulls.
    named = dealt.withColumn("conv_id", F.col("conv_id").cast("string"))
    made = named.mapInPandas(run, "_conv string, conv_id string, step long, role string, text string")
    return made.withColumn("conv_id", F.col("conv_id").cast(kind))


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ``role:text`` lines of each conversation: (_conv, sha256).

    ``rows`` must come straight from ``repaired``: each conversation whole and in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch[c].tolist() for c in ("_conv", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if held is not None and conv == last:
                    held.update(b"\n" + line)
                    continue
                if held is not None:
                    out.append((last, held.hexdigest()))
                last, held = conv, hashlib.sha256(line)
            yield pd.DataFrame(out, columns=["_conv", "sha256"])
        if held is not None:
            yield pd.DataFrame([(last, held.hexdigest())], columns=["_conv", "sha256"])

    return rows.mapInPandas(run, "_conv string, sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Faults put in on purpose, by crc32 of ``conv_id:turn`` modulo 20; nulls read as a blank.

    0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question
    marks out, 3 repeats it, 4 makes it the user's.
    """

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    role = F.when(case == 4, "user").otherwise(known("role"))
    copies = F.when(case == 3, F.array(F.lit(0), F.lit(1))).when(case != 0, F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")
