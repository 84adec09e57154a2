import hashlib
import heapq
import random
import tracemalloc
import zlib
from collections import defaultdict

import pytest

from driftgrid.llm import conversations as cv

BLANKS = " \t\n\x0b\f\r"


def cheapest(rows):
    """Least (cost, edits, repaired lines) by uniform search over all edit sequences.

    ``rows``: (role, text, fault).  States come off the heap by cost, then edits.
    """
    heap = [(0, "", 0, "0", ())]
    seen = set()
    while heap:
        cost, edits, i, last, lines = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in "0a":
            return cost, edits, lines
        turn = {"0": "user", "s": "user", "a": "user", "u": "assistant"}[last]
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if last + role[:1] in ("0s", "0u", "su", "au", "ua"):
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if last + new[0] in ("0u", "su", "au", "ua"):
                        line = f"{new}:{text}"
                        heapq.heappush(heap, (cost + extra + 3, edits + "R", i + 1, new[0], (*lines, line)))
        heapq.heappush(heap, (cost + 3, edits + "I", i, turn[0], (*lines, f"{turn}:")))


def judged(rows):
    """Faults of (turn, role, text) rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANKS)
        if not end:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif end[-1] not in ".!?":
            fault = "truncated"
        else:
            fault = None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(rows):
    """All columns of the query for a conversation's rows after damage, in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = {t for t, _, _ in rows if t is not None}
    marked = judged(rows)
    faults = [f for _, _, f in marked]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = cheapest(marked)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        case = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        out[conv]
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if case == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if case == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def code(role, fault):
    initial = cv._INITIALS.index(role[:1]) if role[:1] in ("s", "u", "a") else 3
    return initial + {"blank": cv.GONE, "duplicate": cv.GONE, "truncated": cv.TRUNCATED, None: 0}[fault]


@pytest.mark.parametrize("seed", range(6))
def test_edits_are_the_least_of_the_cheapest(seed):
    rng = random.Random(seed)
    repair = cv.Repair()
    for _ in range(400):
        roles = ["user", "assistant", "system", "tool", "", "use", "sys"]
        rows = [
            (rng.choice(roles[: rng.randint(2, 7)]), "t", rng.choice(["blank", "duplicate", "truncated", None, None]))
            for _ in range(rng.randint(0, 9))
        ]
        codes = bytes(code(role, fault) for role, _, fault in rows)
        assert repair.edits(codes) == cheapest(rows)[:2]


def test_long_runs_keep_few_cost_vectors():
    rng = random.Random(1)
    codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 8]) for _ in range(40_000))
    tracemalloc.start()
    cost, audit = cv.Repair().edits(codes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Four numbers for each of the rows would take over 5 MB; the edits themselves take one.
    assert most < 2_000_000, most
    assert len(audit.replace("I", "")) == len(codes)
    # The cost is that of the audit.
    state, total, i = 0, 0, 0
    for e in audit:
        if e == "I":
            total, state = total + 3, cv._SPEAKS[state]
            continue
        c = codes[i]
        i += 1
        if e == "D":
            total += 4
            continue
        assert c < cv.GONE
        total += 3 * bool(c & cv.TRUNCATED) + 3 * (e == "R")
        state = cv._SPEAKS[state] if e == "R" else cv._KEPT[(cv._INITIALS[c & 3], state)]
    assert total == cost and state in (0, 3)


def run(spark, rows, monkeypatch, kind="long"):
    from driftgrid.llm import queries

    df = spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = queries.QUERIES["op13_conversation_repair"](spark, "")
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in got.collect()}


def made(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "why?", "", "  ", "\x0b\t", " trail. \n", "u. ", "é…", "nbsp\xa0", "a:b\nc."]
    rows = []
    for conv in [None, *range(n)]:
        turns = [rng.choice([None, *range(12)]) for _ in range(rng.randint(0, 9))]
        for t in sorted(set(turns), key=str):
            rows.append((conv, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice([*texts, None])))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_query_equals_search(spark, monkeypatch, block):
    monkeypatch.setattr(cv, "BLOCK", block)
    rows = made(3, 150)
    # One conversation of many turns, with many repeats.
    rng = random.Random(4)
    rows += [(-7, t, rng.choice(["user", "assistant"]), rng.choice(["same.", "same!", f"text {t}.", "x"])) for t in range(700)]
    # Texts that are very long, and only of blanks.
    rows += [(-8, 0, "user", "long " * 200_000 + "."), (-8, 1, "assistant", " " * 500_000)]
    rng.shuffle(rows)
    assert run(spark, rows, monkeypatch) == {c: expected(r) for c, r in damaged(rows).items()}


def test_rows_of_one_turn_and_names_that_are_text(spark, monkeypatch):
    rows = [("a", 1, "user", "x."), ("a", 1, "user", "x."), ("a", 1, "assistant", "y."), ("a", None, "system", "z."), ("b=", 2, "user", "q?")]
    assert run(spark, rows, monkeypatch, "string") == {c: expected(r) for c, r in damaged(rows).items()}


def test_no_rows(spark, monkeypatch):
    assert run(spark, [], monkeypatch) == {}


def test_repaired_rows_take_turns(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("assistant", "a."), ("user", "b."), ("user", "c."), ("system", "d.")])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id int, turn int, role string, text string, step int")
    placed = cv.placed(df)
    found = cv.report(placed)
    got = cv.repaired(placed, found).orderBy("step").collect()
    want = cheapest(judged([r[1:] for r in rows]))
    assert found.first().audit == want[1] and found.first().cost == want[0]
    assert [f"{r.role}:{r.text}" for r in got] == list(want[2])
    assert [r.step for r in got] == list(range(len(got))) and {r.conv_id for r in got} == {1}


def test_query_on_a_table(spark):
    from driftgrid.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_conversation_repair"](spark, sf).collect()
    assert {r.conv_id: tuple(r[n] for n in NAMES) for r in got} == {c: expected(r) for c, r in damaged(rows).items()}
