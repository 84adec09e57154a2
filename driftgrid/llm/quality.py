"""Quality rules with adaptive bounds, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.frames import BLANKS, without
from driftgrid.session import cut_lineage

SYMBOLS = "#*$%&|<>"

# The least spread of the lengths, far below the usual one (0.3 to 0.5): it decides only where
# the documents of a language or source are all alike.
LEAST_SPREAD = 0.1
# Few texts have a symbol at all and hardly any clean one, so no quantile tells a bound: it is fixed.
MOST_SYMBOLS = 0.09
# Repeats that are never passed, however usual they are in a language or source.
MOST_REPEATS = {"dup_line_share": 0.36, "repeat_word_share": 0.45}
MEASURES = ("chars_per_word", "symbols_per_word", *MOST_REPEATS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# Up to so many different repeated windows, positions are looked up in their list; beyond,
# the windows are sorted with their positions.  Both give the same positions.
SHORT_LIST = 16


def _count_chars(text: Column, chars: str) -> Column:
    """How often ASCII characters of a set occur: what the text loses when they go."""
    total = F.octet_length(text)
    return reduce(
        lambda a, b: a + b,
        (total - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars),
    )


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the base rules; null counts as an empty text.

    ``n_words`` (runs of anything but blank, tab, line feed, vertical tab, form feed and
    return), ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (lines with a
    word), ``n_dup_lines`` (those of them that equal an earlier line), ``n_repeat_words``
    (words inside 3-word windows found at least twice, the first time included).  Windows are compared by the 64-bit hash
    of their three words.  All work on a text is linear but for sorting its windows, so a
    very long text costs no more per word.  Input columns of the same names are replaced.
    """
    df = without(docs, COUNTS)
    kept = [f"`{c}`" for c in df.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    inner = F.btrim(body, F.lit(BLANKS))
    df = df.select(
        *kept,
        F.when(inner == "", F.array().cast("array<string>"))
        .otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
        .alias("__words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
        _count_chars(body, SYMBOLS).cast("long").alias("n_symbols"),
    )
    counted = [*kept, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    words = F.col("__words")
    df = df.select(
        *kept,
        "n_symbols",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(words) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("__windows"),
    )
    # Most texts repeat no window and need no sort.
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.select(
        *counted, "__windows", F.when(repeats, F.sort_array("__windows")).alias("__sorted")
    )
    df = df.select(
        *counted,
        "__windows",
        F.coalesce(
            F.array_distinct(
                F.filter("__sorted", lambda h, i: (i > 0) & (h == F.get("__sorted", i - 1)))
            ),
            F.array().cast("array<bigint>"),
        ).alias("__twice"),
    )
    few = F.size("__twice") <= SHORT_LIST
    by_list = F.filter(
        F.sequence(F.lit(0), F.size("__windows") - 1),
        lambda i: F.array_contains("__twice", F.get("__windows", i)),
    )
    df = df.select(
        *counted,
        F.when((F.size("__twice") > 0) & few, by_list).alias("__listed"),
        F.when(
            ~few,
            F.array_sort(
                F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ).alias("__ranked"),
    )
    twins = F.filter(
        "__ranked",
        lambda s, j: s["h"].eqNullSafe(F.get("__ranked", j - 1)["h"])
        | s["h"].eqNullSafe(F.get("__ranked", j + 1)["h"]),
    )
    by_rank = F.sort_array(F.transform(twins, lambda s: s["i"]))
    df = df.select(*counted, F.coalesce("__listed", by_rank).alias("__at"))
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda acc, p: F.struct(
            p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total")
        ),
        lambda acc: acc["total"],
    )
    return df.select(*counted, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    """The fixed base rules: under 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_measures(counted: DataFrame) -> DataFrame:
    """Per-word and per-line shares of the counts; a text without words has 0 in all."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return without(counted, MEASURES).withColumns(
        {
            "chars_per_word": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_word_share": F.col("n_repeat_words") / words,
        }
    )


def bounds(
    measured: DataFrame,
    lang: str = "lang",
    source: str = "source",
    least_docs: int = 200,
    reach: float = 4.0,
) -> DataFrame:
    """Per language and source: the highest (and for lengths the lowest) share that passes.

    Quantile sketches of the documents that pass the base rules are made per language and
    source, in parts that merge; a pair with fewer than ``least_docs`` documents takes the
    merged sketch of its language, a language with fewer that of all documents.  Most texts
    repeat nothing, so the sketches of repeats hold only the shares above 0, and a group
    counts as many documents as have one.  A bound lies ``reach`` spreads outside the outer
    tenth of the group; a spread is the distance from its median to that tenth, for lengths
    ``LEAST_SPREAD`` at least.  Repeats are bounded by ``MOST_REPEATS`` too, which decides
    alone where all documents have too few of them, and symbols by ``MOST_SYMBOLS`` alone.
    A null language or source is a value like any other.
    """
    sketched = {"chars_per_word": F.col("chars_per_word")}
    sketched |= {m: F.when(F.col(m) > 0, F.col(m)) for m in MOST_REPEATS}
    able = measured.where(~base_failed())
    pairs = able.groupBy(F.col(f"`{lang}`").alias("__lang"), F.col(f"`{source}`").alias("__source")).agg(
        *(F.count(v).alias(f"n_{m}") for m, v in sketched.items()),
        *(F.kll_sketch_agg_double(v).alias(m) for m, v in sketched.items()),
    )
    merged = [
        *(F.sum(f"n_{m}").alias(f"n_{m}") for m in sketched),
        *(F.kll_merge_agg_double(m).alias(m) for m in sketched),
    ]
    langs = pairs.groupBy("__lang").agg(*merged)
    # One row, read as a scalar.
    every = langs.agg(*merged)
    every = every.select(F.struct(*every.columns)).scalar()
    pick = (
        pairs.alias("p")
        .join(langs.alias("l"), F.col("p.__lang").eqNullSafe(F.col("l.__lang")))
        .withColumn("__all", every)
    )

    def chosen(m: str) -> Column:
        enough = F.lit(1 if m == "chars_per_word" else least_docs)
        return (
            F.when(F.col(f"p.n_{m}") >= least_docs, F.col(f"p.{m}"))
            .when(F.col(f"l.n_{m}") >= least_docs, F.col(f"l.{m}"))
            .when(F.col(f"__all.n_{m}") >= enough, F.col(f"__all.{m}"))
        )

    pick = pick.select("p.__lang", "p.__source", *(chosen(m).alias(m) for m in sketched))
    quantiles = pick.select(
        "__lang",
        "__source",
        *(
            F.kll_sketch_get_quantile_double(m, F.lit(q)).alias(f"{m}_{name}")
            for m in sketched
            for q, name in ((0.1, "low"), (0.5, "mid"), (0.9, "high"))
        ),
    )

    def beyond(m: str, side: str, least: float = 0.0) -> Column:
        away = F.col(f"{m}_{side}") - F.col(f"{m}_mid")
        far = F.greatest(F.abs(away), F.lit(least)) * reach
        return F.col(f"{m}_{side}") + (far if side == "high" else -far)

    # The least of several passes over nulls.
    return quantiles.select(
        "__lang",
        "__source",
        beyond("chars_per_word", "low", LEAST_SPREAD).alias("__least_chars_per_word"),
        beyond("chars_per_word", "high", LEAST_SPREAD).alias("__most_chars_per_word"),
        F.lit(MOST_SYMBOLS).alias("__most_symbols_per_word"),
        *(F.least(beyond(m, "high"), F.lit(most)).alias(f"__most_{m}") for m, most in MOST_REPEATS.items()),
    )


def filter_rows(
    measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Join every document with the bounds of its language and source; add ``kept``."""
    at = (F.col(f"`{lang}`").eqNullSafe(F.col("__lang"))) & (
        F.col(f"`{source}`").eqNullSafe(F.col("__source"))
    )
    inside = reduce(
        lambda a, b: a & b,
        (F.col(m) <= F.col(f"__most_{m}") for m in MEASURES),
        F.col("chars_per_word") >= F.col("__least_chars_per_word"),
    )
    joined = without(measured, ["base_failed", "kept"]).join(limits, at, "left")
    joined = joined.withColumn("base_failed", base_failed())
    joined = joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return joined.drop(*limits.columns)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Every row with its counts, measures, ``base_failed`` and ``kept``, without the text.

    The measures are worked out once and written to the shared folder: the sketches and the
    filter both read them.  A null or empty text has no words and fails the base rules; an
    empty table gives an empty one.  Repeated rows are judged each for itself.
    """
    measured = with_measures(with_counts(docs, text).drop(text))
    stored = cut_lineage(measured, "quality")
    return filter_rows(stored, bounds(stored, lang, source), lang, source)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    slim = docs.select(
        row,
        F.col(f"`{text}`").alias("__text"),
        F.col(f"`{lang}`").alias("__doc_lang"),
        F.col(f"`{source}`").alias("__doc_source"),
    )
    good = judge(slim, "__text", "__doc_lang", "__doc_source").where("kept")
    return good.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))
