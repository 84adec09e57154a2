import random
import re
from collections import Counter

from driftgrid.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "a b",
    "a b c",
    "a a a a a",
    "x y z x y z\nx y z\n\n \nx y z",
    "é\u00a0ü #*$%&|<> 日本",
    " ".join("w%d" % (i % 700) for i in range(30_000)),
    " ".join("v%d" % (i * i % 9973) for i in range(9_000)),
    "a b c d e a b c d f a b c d g " * 9,
    "\x0b\x0c\r x",
]


def test_counts_equal_loops(spark):
    rows = [(i, t, -1, "k") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words int, __other string")
    got = {r.doc_id: r for r in quality.with_counts(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert {c: got[i][c] for c in quality.COUNTS} == slow_counts(t), i


def corpus(n=400):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = ["word%d" % rng.randrange(3000) for _ in range(rng.randint(60, 300))]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else None, "s%d" % (i % 2), "x"))
    return rows


def test_bounds_part_junk_from_clean(spark):
    docs = spark.createDataFrame(corpus(), "doc_id int, text string, lang string, source string, kept string")
    got = quality.judge(docs).collect()
    assert len(got) == 400
    for r in got:
        assert r.kept == (r.doc_id % 20 != 0) and not r.base_failed


def test_bounds_follow_their_group(spark):
    rng = random.Random(5)
    rows = []
    for lang, length, most in (("en", 4.0, 0.05), ("de", 6.0, 0.12)):
        for i in range(900):
            dup = rng.uniform(0, most) if i % 3 == 0 else 0.0
            rows.append((lang, "s", 100, 0, rng.gauss(length, length / 20), 0.0, dup, dup / 2))
    ddl = "lang string, source string, n_words long, n_repeat_words long"
    measured = spark.createDataFrame(rows, f"{ddl}, {', '.join(f'{m} double' for m in quality.MEASURES)}")
    got = {r["__lang"]: r for r in quality.bounds(measured).collect()}
    for m in ("chars_per_word", "dup_line_share", "repeat_word_share"):
        assert got["en"][f"__most_{m}"] < 0.8 * got["de"][f"__most_{m}"], m
    # Nothing but the outer tenth decides: nearly five times the distance from the median to it.
    assert 0.12 < got["en"]["__most_dup_line_share"] < 0.2
    assert 4.8 < got["en"]["__most_chars_per_word"] < 5.6
    assert 2.4 < got["en"]["__least_chars_per_word"] < 3.2


def test_kept_rows_come_back_whole(spark):
    rows = corpus(40) + [(None, None, None, None, None), (7, "", "en", "s1", "x")] + corpus(40)[:2]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, `n words` string")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = [r for r in rows if r[1] and "#" not in r[1]]
    assert sorted(tuple(r) for r in kept.collect()) == sorted(want)


def test_no_rows(spark, empty):
    docs = empty("doc_id int, text string, lang string, source string")
    assert quality.judge(docs).count() == 0
    assert quality.keep_good(docs).count() == 0


def test_plan_holds_no_python(spark):
    docs = spark.createDataFrame(corpus(5), "doc_id int, text string, lang string, source string, kept string")
    plan = quality.judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
