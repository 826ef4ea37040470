import zlib

import numpy as np
import pytest

from quartzfolio.llm import language_id as li
from quartzfolio.llm.common import MIX_1, table


def test_features_are_the_counts():
    text = "Ab ç🐘ab"
    low = text.lower()
    want = np.zeros(li.DIMENSIONS)
    for n in li.ORDERS:
        for i in range(len(low) - n + 1):
            h = 0
            for j, c in enumerate(low[i : i + n], 1):
                h = (h + ord(c) + j) * int(MIX_1) % 2**64
            want[h >> (64 - li.BITS)] += 1
    want = np.sqrt(want)
    assert np.allclose(li.features(text), want / np.linalg.norm(want), atol=1e-6)
    assert not li.features("").any()


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in li.predict(docs, li.learn(docs)).collect()}
    rows = docs.select("doc_id", "lang").collect()
    clean = {r["doc_id"] for r in table(spark, sf_dir, "labels").where("quality = 1").collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= got[r["doc_id"]]["score"] <= 1
    told = [got[r["doc_id"]]["fits"] for r in rows if got[r["doc_id"]]["held_out"] and r["doc_id"] in clean]
    assert np.mean(told) > 0.97
    out = [r["lang"] == got[r["doc_id"]]["lang_pred"] for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(out) > 20
    assert np.mean(out) >= 0.9


POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. "
NOISE = "xq zzkv jjwq qqpx vvkz bbnq wxyz kqj zpx vqv jxq kkzz "


@pytest.mark.parametrize("text", [POLISH, POLISH * 9, NOISE, NOISE * 20, "日本語の文章です。" * 9, "x " * 400])
def test_what_was_not_learned_does_not_fit(spark, sf_dir, text):
    model = li.learn(table(spark, sf_dir, "documents"))
    x = li.features(text)[None, :]
    assert model.fits(x, [len(text)], model.predict(x)[0]) == [False]


def test_no_language_is_left_out(spark):
    rows = [(i, f"word{chr(97 + i % 26)} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} text {i % 300}", f"l{i % 300}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({r["lang"] for r in li.sample(docs, 500, 4_000_000, 900).collect()}) > 250
    assert li.sample(docs, 500, 4_000_000, 900).count() < 1200


def predicted_by_hand(model, x):
    """Votes of all pairs of the best family, in plain loops."""
    margin = [(float(x @ model.weights[:-1, j]) + float(model.weights[-1, j])) / float(model.spread[j]) for j in range(model.weights.shape[1])]
    names = list(model.families)
    family = max(names, key=lambda f: (margin[names.index(f)], -names.index(f))) if len(names) > 1 else names[0]
    base = len(names) if len(names) > 1 else 0
    votes = {m: [0, 0.0] for m in model.families[family]}
    for j, (a, b) in enumerate(model.pairs):
        if a in votes:
            votes[a if margin[base + j] >= 0 else b][0] += 1
            votes[a][1] += margin[base + j]
            votes[b][1] -= margin[base + j]
    return max(sorted(votes), key=lambda m: tuple(votes[m]))


def test_predictions_against_plain_loops(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = li.learn(docs)
    for r in li.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        want = predicted_by_hand(model, li.features(r["text"])) if li.has_letter(r["text"]) else li.UNKNOWN
        assert r["lang_pred"] == want


def test_columns_other_than_text_are_not_inputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(60)
    model = li.learn(table(spark, sf_dir, "documents"))
    a = [tuple(r)[2:] for r in li.predict(docs, model).orderBy("doc_id").collect()]
    b = [tuple(r)[2:] for r in li.predict(docs.selectExpr("doc_id + 1000 AS doc_id", "text", "'xx' AS lang", "'s' AS source", "1 AS score"), model).orderBy("doc_id").collect()]
    assert a == b


@pytest.mark.parametrize("langs", [[], ["en"], ["en", "fr"], ["en", "xx", "de"]])
def test_few_languages_and_odd_texts(spark, langs):
    words = {"en": "the thing with that and this ", "fr": "les eaux sont très éloignées où ", "xx": "qqzz zzqq kkww ", "de": "über schöne größe und ähnlich "}
    rows = [(i, words[x] * (1 + i % 3), x) for x in langs for i in range(40)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 !?", None), (1003, "a" * 300_000, None), (None, "the thing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(docs)
    got = li.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is None or r["doc_id"] >= 1000}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert (by[1003]["lang_pred"] in langs) if langs else (by[1003]["lang_pred"] == "und")
    if len(langs) > 1:
        assert all(r["lang_pred"] == x for r, x in zip(got, [x for x in langs for _ in range(40)], strict=False))
    assert li.predict(docs.limit(0), model).count() == 0
