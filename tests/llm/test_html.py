import numpy as np

from driftgrid.llm import html as H


def text(page):
    return H.main_texts([page])[0][0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy</div><article><header><h1>Head &amp; &lt;b&gt;</h1></header><p>One<br>two
 three&nbsp;four <b>bold</b>.<p>Second &#233; <span class="ad">AD</span>part</p><aside>See also</aside>
<div class="comments"><p>Nice post</p></div><form>Name <input></form></article><footer>&copy; x</footer>"""


def test_article_without_its_surroundings():
    assert text(PAGE) == "Head & <b>\nOne two three four bold.\nSecond é part"


def test_main_role_and_class_landmarks():
    assert text("<div id=content><p>a</p><div class='sidebar'>b</div></div><p>c") == "a"
    assert text("<main><p>a</p></main><p>c") == "a"
    assert text("<main><p>m</p><article>a</article></main>") == "a"
    assert text("<div class='post-content'>x</div><div class='share'>y</div>") == "x"
    assert text("<p>only</p><div hidden>h</div><div style='display: none'>d</div>") == "only"


def test_the_larger_of_main_part_and_article():
    assert text("<main><h1>Title</h1><p>lead of some words</p><article>teaser</article><p>rest</p></main>") == "Title\nlead of some words\nteaser\nrest"
    assert text("<div class=story-text>teaser</div><main><p>the whole body</p></main>") == "the whole body"
    # What every page of the host says does not speak for its part.
    same = "<main><p>the house shows these same ten words on all pages</p></main>"
    pages = [f"{same}<article>own{k} text{k} only</article>" for k in range(3)]
    assert [t for t, _ in H.main_texts(pages)] == [f"own{k} text{k} only" for k in range(3)]


def test_text_blocks_of_an_article_stay():
    page = "<article><p class=legal>a</p><h2 class='tags-intro'>b</h2><p class=related>c</p><p class=ad>d</p><div class=related>e</div><p>x <math><mi>y</mi></math><object>z</object></p></article>"
    assert text(page) == "a\nb\nc\nx yz"
    assert text("<p class=legal>a</p><p>b</p>") == "b"


def test_odd_markup():
    assert text("") == "" and text("plain < text") == "plain < text"
    assert text("<p title='a>b'>x</p><P>y") == "x\ny"
    assert text("<p>a</b></div>b<p>c") == "ab\nc"
    assert text("<script>never closed <p>x") == ""
    assert text("<p>q <a href='x>y</p>") == "q y"
    assert text("<p>" + "w " * 200_000) == ("w " * 200_000).strip()


def slow_repeated(pages, depth):
    distinct = {tuple(p) for p in pages}
    places = {}
    for p in distinct:
        for i in range(len(p) - depth + 1):
            places.setdefault(p[i : i + depth], set()).add(p)
    out = []
    for p in pages:
        flags = [False] * len(p)
        for i in range(len(p) - depth + 1):
            if len(places[tuple(p[i : i + depth])]) > 1:
                flags[i : i + depth] = [True] * depth
        out.append(flags)
    return out


def test_runs_on_several_pages_equal_loops():
    rng = np.random.default_rng(4)
    pages = [[f"t{x}" for x in rng.integers(0, 3, rng.integers(0, 60))] for _ in range(30)]
    pages += [[], pages[3], ["t0"] * 40]
    for depth in (2, 4, 8):
        got = [f.tolist() for f in H.repeated(pages, depth)]
        assert got == slow_repeated(pages, depth)


def test_without_landmarks_unique_runs_stay():
    menu = "".join(f"<li>entry {i}</li>" for i in range(8))
    pages = [f"<ul>{menu}</ul><p>{' '.join(f'own{k}x{i}' for i in range(20))}</p><div>all rights kept by the host of this site</div>" for k in range(4)]
    for k, (found, share) in enumerate(H.main_texts(pages)):
        assert found == " ".join(f"own{k}x{i}" for i in range(20))
        assert 0.4 < share < 0.7


def test_rows(spark, empty):
    rows = [(1, "http://a.net/1", PAGE, "x"), (1, "http://a.net/1", PAGE, "x"), (2, None, None, "x"), (None, "odd", "", "x")]
    rows += [(10 + i, "http://a.net/q", f"<p>text {i}", "x") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(pages, shard_chars=500).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id == 1:
            assert r.text == text(PAGE)
        elif r.page_id is None or r.page_id == 2:
            assert r.text == ""
        else:
            assert r.text == f"text {r.page_id - 10}"
        assert r.n_chars == len(r.text)
    assert H.extract(empty("page_id long, url string, html string")).count() == 0


def site(n, menu_on):
    """Pages without landmarks, some with a menu, one pair of equal ones, one with an article."""
    menu = "<ul>" + "".join(f"<li>entry number {i}</li>" for i in range(6)) + "</ul>"
    pages = [f"{menu if k in menu_on else ''}<p>{' '.join(f'w{k}x{i}' for i in range(30))}</p>" for k in range(n)]
    pages += [pages[-1], f"<div>{menu}</div><article>own text</article>", "", None]
    return pages


def test_texts_do_not_depend_on_the_size_of_shards(spark):
    pages = site(120, {3, 50, 90})
    rows = [(i, "http://b.org/x", p) for i, p in enumerate(pages)] + [(500, "http://c.org/", pages[3])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    whole = {r.page_id: r.text for r in H.extract(df, shard_chars=1 << 20).collect()}
    parts = {r.page_id: r.text for r in H.extract(df, shard_chars=600).collect()}
    assert whole == parts and len(whole) == len(rows)
    assert not any("entry number" in whole[i] for i in (3, 50, 90))
    # A host of its own has no other page to compare with.
    assert whole[500].startswith("entry number 0") and whole[121] == "own text"
    for i in range(121):
        assert whole[i].startswith("w")


def test_window_hashes_meet_where_runs_are_equal():
    rng = np.random.default_rng(5)
    tokens = [f"t{x}" for x in rng.integers(0, 2, 300)]
    got = H.window_hashes(tokens, 4)
    runs = [tuple(tokens[i : i + 4]) for i in range(297)]
    assert len(got) == 297 and len({*got.tolist()}) == len({*runs})
    assert len({*zip(got.tolist(), runs, strict=True)}) == len({*runs})
    assert len(H.window_hashes(tokens[:3], 4)) == 0
