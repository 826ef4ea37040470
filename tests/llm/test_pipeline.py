import corpus_pipeline as cp
from quartzfolio.llm import language_id, quality_classifier
from quartzfolio.llm.common import table
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    _, scorer = quality_classifier.learn(docs)
    good = cp.quality(spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {i for i, t in texts.items() if scorer.score(t) >= cp.LEAST_QUALITY}
    known = cp.language(spark, good, sf_dir).cache()
    model = language_id.learn(good)
    want = set()
    for r in good.collect():
        x = language_id.features(r["text"])[None, :]
        if language_id.has_letter(r["text"]) and model.fits(x, [len(r["text"])], model.predict(x)[0]) == [True]:
            want.add(r["doc_id"])
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in known.collect()} == want
    single = cp.deduplicate(spark, known, sf_dir).cache()
    assert single.columns == docs.columns
    left = sorted(r["doc_id"] for r in single.collect())
    assert left == sorted({v[0] for v in brute([(i, texts[i]) for i in want]).values()})
    check(cp.pack(spark, single, sf_dir).collect(), {i: texts[i] for i in left}, 4096)


def test_clean_documents_stay(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1")
    kept = cp.language(spark, cp.quality(spark, docs, sf_dir), sf_dir)
    n = docs.join(labels, "doc_id").count()
    assert kept.join(labels, "doc_id").count() > 0.93 * n


def test_a_language_that_was_not_learned_goes(spark, sf_dir):
    from tests.llm.test_language_id import NOISE, POLISH

    docs = table(spark, sf_dir, "documents")
    more = spark.createDataFrame([(10**9 + i, t * 12, None, "s", len(t)) for i, t in enumerate([POLISH, NOISE])], docs.schema)
    kept = {r["doc_id"] for r in cp.language(spark, docs.unionByName(more), sf_dir).collect()}
    assert not kept & {10**9, 10**9 + 1}
    assert len(kept) > 0.8 * docs.count()


def test_clashing_columns_and_no_rows(spark):
    rows = [(i, " ".join(f"word{'abcdefgh'[j % 8]} and the river{'xyz'[j % 3]}" for j in range(i, i + 40)), "en", "said", 1, 2) for i in range(30)]
    docs = spark.createDataFrame([*rows, (99, None, None, None, None, None)], "doc_id long, text string, lang string, row string, said int, id int")
    out = docs
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns
        assert out.count() > 0
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0
