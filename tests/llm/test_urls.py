import fnmatch
import random
import re

from driftgrid.llm import urls


def slow(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        r
        for r in urls.RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    bad = any(fnmatch.fnmatchcase("." + host, g) for g in urls.BLOCKED_HOSTS)
    return host, path, None, "block" if bad else "allow"


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http://net",
    "http://net/",
    "http://a.net?x=/",
    "http://a.net#/",
    "https://x.example.net/en/",
    "https://x.example.net/en",
    "https://x.Example.NET/en/a?b#c",
    "https://notexample.net/en/",
    "http://a.org/x.net/y",
    "http://a.org/fr/",
    "http://a.org/fr/.net/",
    "http://example.com/de/" + "x" * 5000,
    "http://casino.example.com",
    "http://a.com/casino/",
    "http://b.spam-farm.com/q",
    "x://y://z.net/",
    "http://ÄÖ.net/é",
    "http://user@a.net:80/",
    "http:///net/",
]


def test_verdicts_equal_loops(spark):
    rng = random.Random(1)
    parts = ["http://", "a.", "net", "example.", "com", "org", "/", "en/", "fr/", "de/", "?", "#", "casino", "é"]
    made = URLS + ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(500)]
    rows = [(i, u, "x") for i, u in enumerate(made)] + [(0, None, "again")]
    pages = spark.createDataFrame(rows, "page_id int, url string, rule string")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == slow(made[r.page_id])


def test_globs_over_several_words():
    globs = ["*" + "ab" * 40 + "*", "?b*/c?", "x*y*z", "*/*/end"] * 5
    subjects = [b"zz" + b"ab" * 41, b"ab/cd", b"abc/c", b"x-y-yz", b"x/yz", b"a/b/c/end", b""]
    want = [
        [True, False, False, False],
        [False, True, False, False],
        [False, False, False, False],
        [False, False, True, False],
        [False, False, False, False],
        [False, False, False, True],
        [False, False, False, False],
    ]
    assert urls.GlobSet(globs).match(subjects).tolist() == [w * 5 for w in want]


def test_no_rows(spark, empty):
    assert urls.judge(empty("page_id int, url string")).count() == 0
