"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm import (
    ann,
    bpe,
    conversations,
    html,
    language,
    packing,
    pii,
    quality,
    simhash,
    spelling,
    token_files,
    toxicity,
    urls,
)
from driftgrid.llm.frames import table
from driftgrid.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def fold(parts: int) -> Column:
    """The remainder that deals documents to learning and held-out folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-copies of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, simhash.exact_scheme())
    return found.select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component_id")
    )


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with keyed surrogates for the personal data in it."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every token piece of every document in sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, keep_ids=False)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; its lexicon is learned from the folds 1 to 4 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    rated = toxicity.rate(docs, lexicon)
    score = F.col("toxicity.score")
    return rated.select(
        "doc_id",
        F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
        F.col("toxicity.hits").alias("hits"),
    )


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the model is trained on the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs, fold(4) != 2)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        F.col("language.lang_pred").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def _fits(rule: urls.Rule) -> str:
    return (
        f"(host = '{rule.host}' or ends_with(host, '.{rule.host}'))"
        f" and starts_with(path, '{rule.path}')"
    )


def _op6_sql() -> str:
    ranked = sorted(urls.RULES, key=lambda r: -len(r.name))
    rules = "\n".join(f"when {_fits(r)} then '{r.name}'" for r in ranked)
    verdicts = "\n".join(f"when rule = '{r.name}' then '{r.verdict}'" for r in ranked)
    bad = " or ".join(f"host like '{g.replace('*', '%')}'" for g in urls.BLOCKED_HOSTS)
    return f"""
        with cut as (
          select page_id, case when strpos(url, '://') > 0
                 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
        split as (
          select page_id, regexp_extract(rest, '^[^/?#]*') raw, rest from cut),
        parts as (
          select page_id,
                 translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from split),
        ruled as (
          select *, case {rules} else null end rule from parts)
        select page_id, host, path, rule,
               case {verdicts} when {bad} then 'block' else 'allow' end verdict
        from ruled"""


ORACLES["op6_url_filters"] = _op6_sql()


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the base rules and the adaptive verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality.judge(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of all embeddings for each whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, F.col("vec_id") % 50 == 0)


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the bytes those ids decode to."""
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to token files in the order of doc_id and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_files.write(docs)
    back = token_files.read(files, docs.schema["doc_id"].dataType.simpleString())
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, each with its likely form and the root of its group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text of every conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    placed = cut_lineage(conversations.placed(conversations.damage(rows)), "placed")
    found = cut_lineage(conversations.report(placed), "reports")
    digests = conversations.digests(conversations.repaired(placed, found))
    every = rows.select(conversations.key(F.col("conv_id")).alias("_conv"), "conv_id").distinct()
    both = every.join(found.drop("conv_id"), "_conv", "left").join(digests, "_conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
