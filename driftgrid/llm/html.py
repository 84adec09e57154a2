"""Main text of web pages: landmarks of the markup, and a suffix array per host.

The token streams of a host's pages are concatenated and their suffixes sorted; substrings
that stand on several pages are template text.  By itself that cannot give the main text: a
passage that several articles quote is theirs, and a page may be the only one with its menu.
So elements that are no article text by tag, role or class never count, and a page that marks
its article gives that article.  Pages where this leaves a choice are decided by the array: on
pages without landmarks blocks covered by repeated runs go and unique runs stay; of a main
part and an article the one with more text that repeats nowhere is taken.

A host of many pages is dealt into shards.  Where one of its pages is for the array to decide,
runs are also counted over all pages of the host, by hashes of windows, and each shard gets
those that repeat: what a page gives does not depend on how its host was dealt.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.frames import utf8
from driftgrid.llm.urls import host_and_path
from driftgrid.plans import sizing
from driftgrid.session import cut_lineage

# Elements of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg canvas audio video select".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE_TAGS = set("nav footer aside form dialog menu button label head search".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
OUTSIDE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr "
    "notice notices alert ad ads advert adverts advertisement sponsor sponsored promo promotion comment "
    "comments commentlist disqus respond reply replies share sharing social related recommended "
    "subscribe subscription newsletter popup modal overlay widget login signup pagination pager toc "
    "skip copyright legal banner topbar toolbar tags teaser".split()
)
HEADER_WORDS = {"header"}
# Blocks of running text; in an article only words that name no part of it count on these.
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th tr".split())
FOREIGN_WORDS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments commentlist "
    "cookie cookies consent gdpr newsletter popup".split()
)
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)[_-]?(?:body|content|text)(?:$|[\s_-])")
_MAIN = re.compile(r"(?:^|\s)(?:content|main|main[_-]?content|page[_-]?content)(?:$|\s)")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}

# INNER is an article inside a main part.
OUTSIDE, OPEN, MAIN, ARTICLE, INNER = range(5)


@dataclass
class Block:
    text: str
    zone: int


def _zone(tag: str, attributes: str, now: int) -> int:
    """Zone inside an element that stands in zone ``now``; outside stays outside."""
    if now == OUTSIDE or tag in OUTSIDE_TAGS:
        return OUTSIDE
    article = INNER if now in (MAIN, INNER) else ARTICLE
    if tag == "header" and now < ARTICLE:
        return OUTSIDE
    if attributes and not attributes.isspace():
        at = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
        role = at.get("role", "").lower()
        names = f"{at.get('class', '')} {at.get('id', '')}".lower()
        words = set(re.split(r"[\s_-]+", names))
        hidden = "hidden" in at or at.get("aria-hidden") == "true"
        hidden = hidden or "display:none" in at.get("style", "").replace(" ", "").lower()
        foreign = FOREIGN_WORDS if now >= MAIN and tag in TEXT_TAGS else OUTSIDE_WORDS
        if hidden or role in OUTSIDE_ROLES or words & foreign:
            return OUTSIDE
        if words & HEADER_WORDS and now < ARTICLE and tag != "body":
            return OUTSIDE
        if role == "article" or at.get("itemprop", "").lower() == "articlebody" or _ARTICLE.search(names):
            return article
        if (role == "main" or _MAIN.search(names)) and tag not in ("body", "html"):
            return max(now, MAIN)
    if tag == "article":
        return article
    return max(now, MAIN) if tag == "main" else now


def blocks(html: str) -> list[Block]:
    """Blocks of a page in order: character references decoded, white space made one blank."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    buffers: dict[int, list[str]] = {}

    def flush() -> None:
        for zone, pieces in buffers.items():
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, zone))
        buffers.clear()

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        zone = stack[-1][1] if stack else OPEN
        if stop > at:
            buffers.setdefault(zone, []).append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag, closing = name.lower(), bool(m.group(1) or m.group(4))
        if tag == "br":
            buffers.setdefault(zone, []).append(" ")
        if closing:
            open_at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag == "p" or tag in BLOCK and open_at is not None:
                flush()
            if open_at is not None:
                del stack[open_at:]
            continue
        if tag in BLOCK:
            flush()
        attributes = m.group(3) or m.group(6) or ""
        if tag in RAW:
            close = _RAW_END[tag].search(html, at)
            if attributes.endswith("/"):
                continue
            at = close.end() if close else end
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and stack and stack[-1][0] == "p":
            stack.pop()
            zone = stack[-1][1] if stack else OPEN
        stack.append((tag, _zone(tag, attributes, zone)))
    flush()
    return out


# ---------------------------------------------------------------- the suffix array


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` tokens (a power of two), by doubling.

    Suffixes of one rank share their first ``depth`` tokens.
    """
    rank, width = tokens, 1
    while width < depth:
        follow = np.zeros(len(rank), np.int64)
        follow[:-width or None] = rank[width:] + 1 if width < len(rank) else 0
        key = rank * (int(rank.max(initial=0)) + 2) + follow
        rank = np.unique(key, return_inverse=True)[1].ravel().astype(np.int64)
        width *= 2
    return rank


def repeated(pages: list[list[str]], depth: int) -> list[np.ndarray]:
    """For each page's tokens, which lie in a run of ``depth`` tokens or more that stands on
    another page too.  Pages of equal tokens count as one."""
    sizes = np.array([len(p) for p in pages], np.int64)
    words = [w for p in pages for w in [*p, None]]
    codes = pd.factorize(np.array(words, object))[0].astype(np.int64)
    ends = np.cumsum(sizes + 1) - 1
    # Ends of pages differ from all else and from each other: no run crosses one.
    codes[ends] = codes.max(initial=0) + 1 + np.arange(len(pages))
    distinct: dict[tuple, int] = {}
    same = np.array([distinct.setdefault(tuple(p), i) for i, p in enumerate(pages)], np.int64)
    owner = np.repeat(same, sizes + 1)
    rank = suffix_ranks(codes, depth)
    order = np.lexsort((owner, rank))
    r, o = rank[order], owner[order]
    low = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    several = np.minimum.reduceat(o, low) != np.maximum.reduceat(o, low)
    starts = order[np.repeat(several, np.diff([*low, len(r)]))]
    edge = np.zeros(len(codes) + depth + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + depth, -1)
    covered = np.cumsum(edge)[: len(codes)] > 0
    return [covered[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]


def undecided(page: list[Block]) -> bool:
    """Whether landmarks leave a choice: there are none, or a main part beside an article."""
    zones = {b.zone for b in page} - {OUTSIDE}
    return zones == {OPEN} or MAIN in zones and bool(zones & {ARTICLE, INNER})


def _chosen(page: list[Block], own: list[int], shares: list[float], template: float) -> list[bool]:
    """Which blocks are main text; ``own`` counts a block's tokens that do not repeat."""
    zones = {b.zone for b in page}
    articles = {ARTICLE, INNER}
    if zones <= {OUTSIDE, OPEN}:
        return [b.zone == OPEN and s < template for b, s in zip(page, shares, strict=True)]
    if MAIN not in zones:
        taken = articles
    elif not zones & articles:
        taken = {MAIN}
    else:
        in_article = sum(n for b, n in zip(page, own, strict=True) if b.zone in articles)
        in_main = sum(n for b, n in zip(page, own, strict=True) if b.zone == MAIN)
        taken = articles if in_article >= in_main else {MAIN, INNER}
    return [b.zone in taken for b in page]


def main_texts(
    pages: list[str], depth: int = 8, template: float = 0.5, marks: list[np.ndarray | None] | None = None
) -> list[tuple[str, float]]:
    """Main text of each of a host's pages, and the share of its tokens that repeat.

    ``marks`` are places in a page's tokens where runs of ``depth`` tokens begin that are
    known to repeat elsewhere.
    """
    cut = [blocks(p) for p in pages]
    tokens = [[b.text.split() for b in page] for page in cut]
    flags = repeated([[w for t in page for w in t] for page in tokens], depth) if pages else []
    for covered, known in zip(flags, marks or [], strict=False):
        if known is not None and len(known):
            edge = np.zeros(len(covered) + 1, np.int64)
            np.add.at(edge, known, 1)
            np.add.at(edge, np.minimum(known + depth, len(covered)), -1)
            covered |= np.cumsum(edge)[:-1] > 0
    out = []
    for page, words, covered in zip(cut, tokens, flags, strict=True):
        own, shares, at = [], [], 0
        for t in words:
            part = covered[at : at + len(t)]
            own.append(len(t) - int(part.sum()))
            shares.append(float(part.mean()))
            at += len(t)
        taken = _chosen(page, own, shares, template)
        kept = [b.text for b, yes in zip(page, taken, strict=True) if yes]
        out.append(("\n".join(kept), float(covered.mean()) if len(covered) else 0.0))
    return out


# ---------------------------------------------------------------- runs of a whole host

# Windows a task gives out at once.
CHUNK_WINDOWS = 200_000
# An odd factor for rolling hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(tokens: list[str], depth: int) -> np.ndarray:
    """A hash of every run of ``depth`` tokens."""
    n = len(tokens) - depth + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    codes = pd.util.hash_array(np.array(tokens, object), categorize=False)
    out = np.zeros(n, np.uint64)
    for k in range(depth):
        out = out * FACTOR + codes[k : k + n]
    return out.view(np.int64)


def _hosts_to_decide(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        asked = {
            host
            for host, html in zip(batch["host"], batch["html"], strict=True)
            if isinstance(html, str) and undecided(blocks(html))
        }
        yield pd.DataFrame({"host": sorted(asked)}, dtype=object)


def _windows(depth: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for host, key, html in zip(batch["host"], batch["html_key"], batch["html"], strict=True):
                page = blocks(html) if isinstance(html, str) else []
                tokens = [w for b in page for w in b.text.split()]
                found = window_hashes(tokens, depth)
                if len(found) == 0:
                    continue
                held.append(
                    pd.DataFrame(
                        {
                            "host": host,
                            "html_key": key,
                            "page": xxhash.xxh64_intdigest(utf8(" ".join(tokens))) - (1 << 63),
                            "asked": undecided(page),
                            "at": np.arange(len(found), dtype=np.int32),
                            "window": found,
                        }
                    )
                )
                n += len(found)
                if n >= CHUNK_WINDOWS:
                    yield pd.concat(held, ignore_index=True)
                    held, n = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return run


def host_marks(rows: DataFrame, depth: int) -> DataFrame:
    """``host``, ``html_key``, ``marks``: where runs begin, on pages for the array to decide,
    that stand on another page of the host; pages of equal tokens count as one."""
    schema = "host string, html_key long, page long, asked boolean, at int, window long"
    windows = cut_lineage(rows.select("host", "html_key", "html").mapInPandas(_windows(depth), schema), "windows")
    several = (
        windows.groupBy("host", "window")
        .agg(F.min("page").alias("low"), F.max("page").alias("high"), F.max("asked").alias("wanted"))
        .where("wanted and low <> high")
        .select("host", "window")
    )
    # A window that very many pages have is one row on one side: adaptive execution splits the other.
    places = windows.where("asked").select("host", "window", "html_key", "at")
    return places.join(several, ["host", "window"]).groupBy("host", "html_key").agg(F.collect_set("at").alias("marks"))


def _small(df: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """A frame written and measured, for a broadcast if it is small; and whether it has rows."""
    df = cut_lineage(df, label)
    size = sizing.measure(df)
    fits = sizing.fits_broadcast(df, size["n_bytes"])
    return (F.broadcast(df) if fits else df), bool(size["n_rows"])


def extract(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    shard_chars: int = 1 << 20,
    depth: int = 8,
) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` and ``repeated_share`` of every row.

    A null or empty page has an empty text.  Null URLs and URLs without a host share the
    empty host.  A host's pages are dealt at random into shards of about ``shard_chars``
    characters, each with a suffix array of its own; ``text`` is the same for any
    ``shard_chars``, ``repeated_share`` (a report) counts repeats inside a shard and, on hosts
    with pages for the array to decide, those of the host on such pages.  Repeated rows stay,
    each with its text; an empty table gives an empty one.
    """
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")
    )
    rows = rows.withColumn("host", host_and_path(F.col("url"))[0])
    sizes = rows.groupBy("host").agg(
        F.ceil(F.sum(F.coalesce(F.length("html"), F.lit(0)) + 1) / shard_chars).cast("int").alias("shards")
    )
    # Only hosts of several shards need to be looked up.
    heavy, several = _small(sizes.where("shards > 1"), "heavy-hosts")
    rows = rows.withColumn("html_key", F.xxhash64("html", F.length("html")))
    if several:
        of_heavy = rows.join(heavy.select("host"), "host")
        asked = of_heavy.select("host", "html").mapInPandas(_hosts_to_decide, "host string").distinct()
        asked, some = _small(asked, "hosts-to-decide")
    else:
        some = False
    if some:
        marks, _ = _small(host_marks(rows.join(asked, "host"), depth), "marks")
        rows = rows.join(marks, ["host", "html_key"], "left")
    else:
        rows = rows.withColumn("marks", F.lit(None).cast("array<int>"))
    own = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("shards", F.lit(1))).cast("int")
    dealt = rows.join(heavy, "host", "left").withColumn("shard", own)
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long, repeated_share double"

    def of_shard(group: pd.DataFrame) -> pd.DataFrame:
        marks = [None if m is None else np.asarray(m, np.int64) for m in group["marks"]]
        found = main_texts([h if isinstance(h, str) else "" for h in group["html"]], depth, marks=marks)
        texts = [t for t, _ in found]
        return pd.DataFrame(
            {
                "page_id": group["page_id"].to_numpy(),
                "url": group["url"].to_numpy(),
                "text": texts,
                "n_chars": [len(t) for t in texts],
                "repeated_share": [s for _, s in found],
            }
        )

    # By host and shard, else a plan may deem pages dealt by host alone good enough.
    columns = dealt.select("host", "shard", "page_id", "url", "html", "marks").repartition("host", "shard")
    return columns.groupBy("host", "shard").applyInPandas(of_shard, schema)
