import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftgrid.llm import language
from driftgrid.llm.queries import QUERIES

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "eit"], "cc": ["ção", "nho", "lhe"]}


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = made(300)
    return language.train([t for _, t, _ in rows], [y for _, _, y in rows], language.Settings())


def test_held_out_texts(model):
    rows = made(200, 2)
    out = model.predict([t for _, t, _ in rows])
    assert (out.lang_pred == [y for _, _, y in rows]).mean() >= 0.98
    assert out.score.between(0, 1).all() and out.rejected.mean() < 0.02


def test_no_letter_is_unknown(model):
    out = model.predict([None, "", "12 3.4 !?", "☃", "ka", "é" * 50_000])
    assert out.lang_pred.tolist()[:4] == [language.UNKNOWN] * 4
    assert out.score.tolist()[:4] == [0.0] * 4 and out.rejected.tolist()[:4] == [True] * 4
    assert set(out.lang_pred[4:]) <= set(SYLLABLES)


def test_long_texts_are_read_whole(model, monkeypatch):
    text = "schung " * 3000 + "lhe nho " * 9000
    whole = model.predict([text, "ka lo mi"])
    monkeypatch.setattr(language, "_PIECE", 500)
    pieces = model.predict([text, "ka lo mi"])
    assert whole.lang_pred.tolist() == pieces.lang_pred.tolist() == ["cc", "aa"]
    assert abs(whole.score[0] - pieces.score[0]) < 1e-9


@pytest.mark.parametrize("left", ["aa", "bb", "cc"])
def test_languages_never_learned_are_rejected(left):
    rows = [r for r in made(600) if r[2] != left]
    model = language.train([t for _, t, _ in rows], [y for _, _, y in rows], language.Settings())
    fresh = made(300, 3)
    out = model.predict([t for _, t, _ in fresh])
    foreign = [y == left for _, _, y in fresh]
    assert out.rejected[foreign].mean() >= 0.95
    assert out.rejected[[not f for f in foreign]].mean() <= 0.02
    one, other = ([t for _, t, y in fresh if y == k][:20] for k in model.langs)
    mixed = model.predict([f"{a} {b}" for a, b in zip(one, other)])
    assert mixed.rejected.sum() <= 1


def test_rejection_with_one_language():
    rows = [r for r in made(300) if r[2] == "aa"]
    model = language.train([t for _, t, _ in rows], [y for _, _, y in rows], language.Settings())
    fresh = made(200, 4)
    out = model.predict([t for _, t, _ in fresh])
    own = [y == "aa" for _, _, y in fresh]
    assert out.rejected[own].mean() <= 0.05
    assert out.rejected[[not o for o in own]].mean() >= 0.9


def test_long_labelled_texts_are_learned_from(spark):
    long = {y: " ".join(t for _, t, z in made(400, 5) if z == y) for y in SYLLABLES}
    docs = spark.createDataFrame([(t * 3, y) for y, t in long.items()], "text string, lang string")
    model = language.learn(docs, F.lit(True), language.Settings(sample_chars=2000))
    assert model.langs == sorted(SYLLABLES)
    out = model.predict([t for _, t, _ in made(100, 6)])
    assert (out.lang_pred == [y for _, _, y in made(100, 6)]).mean() >= 0.95


def test_rows(spark, empty):
    rows = [(*r, "x") for r in made(150)] + [(900, None, None, "x"), (901, "ka lo", None, "x"), (0, "ka", "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    model = language.learn(docs, F.col("doc_id") < 800)
    assert model.langs == sorted(SYLLABLES)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    assert [r.language.lang_pred for r in got if r.doc_id == 900] == ["und"]
    none = empty("doc_id long, text string, lang string")
    unlearned = language.learn(none, F.lit(True))
    assert language.identify(none, unlearned).count() == 0
    assert {r.language.lang_pred for r in language.identify(docs, unlearned).collect()} == {"und"}


def test_accuracy_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_language_id"](spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97
