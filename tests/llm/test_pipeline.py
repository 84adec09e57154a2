import random

import corpus_pipeline
from driftgrid.llm import queries

SF = "/root/testdata/sf0.001"


def made():
    """Documents of which is known what each stage must do with them."""
    rng = random.Random(6)
    roots = {"en": ["the", "an", "of", "er", "th", "ing"], "de": ["ung", "sch", "ein", "ü", "keit", "ß"]}

    def prose(lang, n):
        return ["".join(rng.choices(roots[lang], k=rng.randint(1, 4))) for _ in range(n)]

    rows = []

    def add(words, kind, lang):
        text = None if words is None else " ".join(words)
        rows.append((len(rows), text, lang, "s", len(text or ""), kind))

    for i in range(260):
        lang = "en" if i % 2 else "de"
        words = prose(lang, rng.randint(80, 400))
        add(words, "clean", lang)
        if i % 10 == 0:
            near = list(words)
            near[len(near) // 2] = "other"
            add(near if len(near) > 150 else words, "copy", lang)
    add(None, "no language", "en")
    add(["12", "34"] * 60, "no language", "en")
    add(prose("en", 20), "short", "en")
    add([w + "###" for w in prose("en", 200)], "symbols", "en")
    add([*prose("de", 90), "mail", "jo.doe@mail.example.com"], "private", "de")
    return rows


def test_stages(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string")
    kinds = {r[0]: r[5] for r in rows}
    left = {k for k in kinds}
    stages = dict(corpus_pipeline.STAGES)
    drops = {"language ID": {"no language"}, "quality rules": {"short", "symbols"}, "SimHash near-dedup": {"copy"}, "PII surrogates": set()}
    for name, gone in drops.items():
        docs = corpus_pipeline.cut_lineage(stages[name](spark, docs, ""), "test")
        left -= {d for d, k in kinds.items() if k in gone}
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(left), name
        assert [f for f, _ in docs.dtypes] == ["doc_id", "text", "lang", "source", "n_chars", "kind"]
    for r in docs.collect():
        assert r.n_chars == len(r.text)
        old = rows[r.doc_id][1]
        if r.kind == "private":
            assert "jo.doe" not in r.text and len(r.text) == len(old)
        else:
            assert r.text == old
    places = stages["best-fit packing"](spark, docs, "").collect()
    assert {r.doc_id for r in places} == left


def test_run_over_the_tables(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and len({(r.doc_id, r.piece) for r in got}) == len(got)


def test_no_rows(spark, empty):
    none = empty("doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, none, "")
        assert docs.count() == 0


def test_url_verdicts_equal_their_sql(spark):
    import oracle

    con = oracle.connect(SF)
    for name, sql in queries.ORACLES.items():
        assert oracle.compare(queries.QUERIES[name](spark, SF), con, sql) is None
