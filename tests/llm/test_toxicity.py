import random

import pytest
from pyspark.sql import functions as F

from driftgrid.llm import toxicity as X

from tests.llm.lexicon_reference import build


@pytest.mark.parametrize(
    "text,want",
    [
        ("", "  "),
        ("Hello, World", " heiio worid "),
        ("l0ser 10ser LOSER", " ioser ioser ioser "),
        ("$tupid st@r", " stupid star "),
        ("stupid!!! trash$$$", " stupid trash "),
        ("ѕсum mоrоn", " scum moron "),
        ("stuuuupid", " stupid "),
        ("s t u p i d", " stupid "),
        ("café ＳＴＵＰＩＤ ß", " cafe stupid ss "),
    ],
)
def test_folding(text, want):
    assert X.fold(text) == want


def made(n, toxic, seed):
    rng = random.Random(seed)
    words = ["plain%s" % "abcdefghij"[rng.randrange(10)] * 2 for _ in range(40)] + "the a of and to".split()
    bad = ["grumble", "snarkle", "vexer", "vexed", "vexing"]
    out = []
    for _ in range(n):
        text = rng.choices(words, k=rng.randint(5, 200))
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad)
        elif rng.random() < 0.2:
            k = rng.randrange(len(text))
            text[k : k + 1] = ["harmless", "grumble"]
        out.append(" ".join(text))
    return out


def taught(spark, toxic, clean, **settings):
    texts = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    return X.learn(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), F.lit(True), X.Settings(**settings))


@pytest.fixture(scope="module")
def lexicon(spark):
    return taught(spark, made(300, True, 1), made(900, False, 2))


def score(lexicon, *texts):
    found = lexicon.automaton()
    folded = [X.fold(t) for t in texts]
    x = [X.normalised(X.weigh(t, found)[0], t) for t in folded]
    return lexicon.probability(__import__("numpy").array(x))


def test_words_stems_and_exceptions_are_learned(lexicon):
    assert any(k.startswith(" vex") for k in lexicon.weights)
    assert " harmiess grumbie " in lexicon.exceptions
    bad = score(lexicon, "a Gruмbl3 of the", "to 5narkle", "vexed", "and V E X E R to", "plain " * 900 + "snarkle")
    assert (bad >= 0.5).all()
    good = score(lexicon, "", "the plain word", "a harmless grumble to")
    assert (good < 0.5).all()


def test_held_out_texts(lexicon):
    assert (score(lexicon, *made(200, True, 3)) >= 0.5).mean() > 0.97
    assert (score(lexicon, *made(200, False, 4)) < 0.5).mean() > 0.97


def test_words_of_copied_texts_are_not_learned(spark):
    copies = ["grumble " + " ".join(f"only{c}{d}" for c in "abcd" for d in "wxyz")] * 60
    lexicon = taught(spark, made(200, True, 5) + copies, made(600, False, 6))
    assert not any("oniy" in k for k in lexicon.weights)


def test_rows(spark, empty):
    bad, good = made(240, True, 7), made(480, False, 8)
    rows = [(i, t, "x") for i, t in enumerate(bad + good)] + [(900, None, "x"), (901, "", "x"), (0, bad[0], "x"), (None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, int(i < 240)) for i in range(720)] + [(5, 1), (7000, 0)], "doc_id long, toxic int")
    lexicon = X.learn(docs, labels, F.col("doc_id") % 5 != 0)
    got = X.rate(docs, lexicon).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None or r.doc_id >= 720:
            assert r.toxicity.score < 0.5
    right = sum((r.toxicity.score >= 0.5) == (r.doc_id < 240) for r in got if r.doc_id is not None and r.doc_id < 720)
    assert right / 721 > 0.95
    none = empty("doc_id long, text string")
    blank = X.learn(none, empty("doc_id long, toxic int"), F.col("doc_id") > 0)
    assert X.rate(none, blank).count() == 0
    assert {r.toxicity.hits for r in X.rate(docs, blank).collect()} == {0}


@pytest.mark.parametrize("seed,n", [(11, 60), (12, 300)])
def test_spark_counts_give_the_lexicon_of_lists(spark, seed, n):
    toxic, clean = sorted(set(made(n, True, seed))), sorted(set(made(3 * n, False, seed + 1)))
    got, want = taught(spark, toxic, clean, trial=0), build(toxic, clean)
    assert got.weights == want.weights and got.exceptions == want.exceptions
    assert (got.slope, got.offset) == pytest.approx((want.slope, want.offset))


def test_lexicon_of_a_table_is_that_of_lists(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = X.learn(docs, labels, F.lit(True), X.Settings(trial=0))
    rows = docs.join(labels.where("toxic in (0, 1)"), "doc_id").select("toxic", "text").distinct().collect()
    texts = [sorted(r.text for r in rows if r.toxic == k and r.text is not None) for k in (1, 0)]
    want = build(*texts)
    assert got.weights and got.weights == want.weights and got.exceptions == want.exceptions


def test_words_that_fail_the_trial_are_left_out(spark):
    """Words that mark some toxic texts that teach, and none on trial."""
    import zlib

    toxic, clean = made(400, True, 21), made(900, False, 22)
    toxic = [t + " byccance" if zlib.crc32(t.encode()) % 5 and i % 8 == 0 else t for i, t in enumerate(toxic)]
    toxic = [t for t in toxic if "byccance" not in t or zlib.crc32(t.encode()) % 5]
    settings = {"company": 2}
    assert any("bycc" in e for e in taught(spark, toxic, clean, trial=0, **settings).weights)
    assert not any("bycc" in e for e in taught(spark, toxic, clean, **settings).weights)


def test_very_long_texts_teach_too(spark):
    toxic, clean = made(60, True, 31), made(120, False, 32)
    toxic = [t + " of the" * 12_000 for t in toxic]
    assert score(taught(spark, toxic, clean), "a vexer to", "a snarkle to").min() >= 0.5


def test_entries_that_count_from_the_second_hit_on():
    lexicon = X.Lexicon({" vex+": 4.0, " snark ": 2.0, " snark +": 1.0}, (" no vexing ",), 1.0, 0.0)
    found = lexicon.automaton()

    def weight(text):
        return X.weigh(X.fold(text), found)

    assert weight("vexed") == (0.0, 1) and weight("vexed and vexing") == (4.0, 2)
    assert weight("vexed, no vexing") == (0.0, 1)
    assert weight("vexed vexer vex snark") == (10.0, 4)
    assert weight("snark or snark") == (5.0, 2)


def test_words_that_clean_texts_have_once(spark):
    """A stem in a clean text now and then, and several times in toxic ones."""
    rng = random.Random(41)
    toxic = [t + " aggri" + rng.choice("abcdef") * 3 + " and aggri" + rng.choice("ghij") * 2 for t in made(200, False, 42)]
    clean = [t + (" aggri" + rng.choice("abcdefghij") * 2 if rng.random() < 0.3 else "") for t in made(900, False, 43)]
    lexicon = taught(spark, toxic, clean)
    assert score(lexicon, "the aggrixx plain aggriyy of").min() >= 0.5
    assert score(lexicon, "the aggrixx plain of", "the plain of").max() < 0.5
