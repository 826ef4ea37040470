"""What SQL can't express, against plain Python."""

import itertools
import random

import pytest
from quartzfolio.functions.similarity import jaro, jaro_winkler_of
from quartzfolio.operators import budget, dedup, graph, learning, likeness, search


def test_jaro_winkler():
    assert round(jaro("martha", "marhta"), 4) == 0.9444
    assert round(jaro_winkler_of("martha", "marhta"), 4) == 0.9611
    assert jaro("", "a") == 0.0 and jaro("a", "a") == 1.0


def test_knapsack_is_the_best_set(spark):
    rng = random.Random(3)
    rows = [("v", i, float(rng.randint(1, 99)), float(rng.randint(1, 20) * 1000)) for i in range(10)]
    df = spark.createDataFrame(rows, "vendor string, id long, score double, cost double")
    got = {r["id"] for r in budget.knapsack(df, "vendor", 40_000.0).collect()}
    worth = lambda ids: sum(s for _, i, s, _ in rows if i in ids)
    cost = lambda ids: sum(c for _, i, _, c in rows if i in ids)
    best = max(worth(set(s)) for n in range(11) for s in itertools.combinations(range(10), n) if cost(set(s)) <= 40_000)
    assert cost(got) <= 40_000 and worth(got) == best


def test_knapsack_sends_few_items_of_a_large_group(spark, monkeypatch):
    rows = [("v", i, float(i % 977), float(i % 5 * 1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "vendor string, id long, score double, cost double")
    sent, frame = [], type(df)
    group_by = frame.groupBy
    monkeypatch.setattr(frame, "groupBy", lambda self, *c: (sent.append(self), group_by(self, *c))[1])
    got = budget.knapsack(df, "vendor", 20_000.0).collect()
    assert sent[-1].count() <= 20 + 10 + 6 + 5
    worth = [0.0] * 21
    for _, _, score, cost in rows:
        for left in range(20, int(cost // 1000) - 1, -1):
            worth[left] = max(worth[left], worth[left - int(cost // 1000)] + score)
    assert sum(r["cost"] for r in got) <= 20_000 and sum(r["score"] for r in got) == worth[20]


def test_lsh_pairs_are_true_pairs(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(1)
    texts = [" ".join(rng.sample(words, 7)) for _ in range(30)]
    texts += [t + " x" for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    like = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    got = {(r["id"], r["other"]) for r in dedup.lsh_pairs(df, 0.75).collect()}
    assert all(like(a, b) >= 0.75 for a, b in got)
    assert {(i, 30 + i) for i in range(10)} <= got


def test_lsh_pairs_have_every_copy(spark):
    texts = ["alpha beta gamma delta epsilon"] * 4 + ["zeta eta theta iota kappa lambda"] * 3 + ["alpha beta gamma delta epsilon x", None, None, "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["id"], r["other"], r["copy"]) for r in dedup.lsh_pairs(df, 0.75).collect()}
    assert got == {(0, 1, True), (0, 2, True), (0, 3, True), (4, 5, True), (4, 6, True), (0, 7, False)}


def test_merged_takes_the_surest_value(spark):
    df = spark.createDataFrame([(1, 1, "a", None, 0.5), (1, 2, "b", "x", 0.9), (1, 3, "c", "y", 0.9)], "c long, id long, name string, vendor string, confidence double")
    r = dedup.merged(df, "c", ["name", "vendor"], "confidence").first()
    assert (r["n"], r["confidence"], r["name"], r["vendor"]) == (3, 0.9, "b", "x")


def test_chunks_cover_the_text():
    text = ("word " * 50 + ". ") * 30
    spans = search.cut(text, 1024, 128, 100)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] <= a[1] for a, b in itertools.pairwise(spans)) and all(e - s <= 1024 + 100 for s, e in spans)
    assert search.cut("", 1024, 128, 100) == [] and search.cut("ab", 1024, 128, 100) == [(0, 2)]


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "see the quick brown fox run"), (2, "quick brown"), (3, None), (4, "a fox")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "the quick brown fox"), (2, "fox"), (3, ""), (4, None)], "item_id long, passage string")
    assert sorted(map(tuple, graph.mentions(docs, passages).collect())) == [(1, 1), (1, 2), (4, 2)]


def test_cooldown(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([(1, at(m), i) for i, m in enumerate((0, 10, 61, 70, 121))] + [(2, at(5), 9)], "key long, ts timestamp, event_id long")
    assert sorted(r["event_id"] for r in learning.cooldown(rows, "1 hour").collect()) == [0, 2, 4, 9]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, block string, words array<string>")
    assert likeness.jaccard_join(none, 0.75).count() == 0
    assert dedup.lsh_pairs(spark.createDataFrame([], "id long, text string"), 0.75).count() == 0
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.nearest(vecs, vecs, 3, 5).count() == 0


@pytest.mark.parametrize(("kind", "threshold"), [("edit", 0.8), ("jaro_winkler", 0.9), ("cosine", 0.7)])
def test_name_pairs_miss_nothing(spark, kind, threshold):
    import random

    from pyspark.sql import functions as F

    from quartzfolio.functions import similarity, strings

    rng = random.Random(4)
    base = ["".join(rng.choice("abcab ") for _ in range(rng.randrange(1, 14))).strip() or "a" for _ in range(60)]
    names = sorted({*base, *(n[:-1] + "x" for n in base), *(n + n for n in base), *(n + "a" for n in base), *(n[1:] + n[:1] for n in base)})
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    of = {"edit": strings.edit_similarity(F.col("name"), F.col("other_name")), "jaro_winkler": similarity.jaro_winkler("name", "other_name"), "cosine": strings.bigram_cosine(F.col("name"), F.col("other_name"))}[kind]
    other = df.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    every = df.join(other, F.col("id") < F.col("other")).where(of >= threshold).select("id", "other")
    some = likeness.name_pairs(df, kind, threshold).where(of >= threshold).select("id", "other")
    want = sorted(map(tuple, every.collect()))
    assert sorted(map(tuple, some.collect())) == want
    assert len(want) > 20


def test_fold_streams_in_order(spark):
    from quartzfolio.operators import windows

    rows = [(k, 10 - i, float(i)) for k in (1, None, 3) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, t long, v double").repartition(3)
    got = {r["k"]: r["state"] for r in windows.fold(df, ["k"], ["t"], "v", 0.0, lambda s, v: 2 * s + v).collect()}
    want = 0.0
    for i in reversed(range(10)):
        want = 2 * want + i
    assert got == {1: want, None: want, 3: want}
    assert windows.fold(df.limit(0), ["k"], ["t"], "v", 0.0, lambda s, v: s).count() == 0


def test_running_sum_by_steps(spark):
    from pyspark.sql import functions as F

    from quartzfolio.operators import windows

    df = spark.createDataFrame([(i % 2, i, (i * 37) % 100, i) for i in range(200)], "g long, id long, score long, v long")
    got = {r["id"]: r["s"] for r in windows.running_sum(df, ["g"], F.floor(-F.col("score") / 10), [F.desc("score"), "id"], "v", "s").collect()}
    for g in (0, 1):
        total = 0
        for i in sorted(range(g, 200, 2), key=lambda i: (-((i * 37) % 100), i)):
            total += i
            assert got[i] == total


def test_greedy_selection_by_hand(spark):
    from quartzfolio.operators import budget

    rows = [(i % 3, i, float((i * 31) % 50 + 1), float((i * 17) % 40 + 1)) for i in range(90)]
    got = {(r["g"], r["id"]) for r in budget.greedy(spark.createDataFrame(rows, "g long, id long, score double, cost double"), "g", 100.0).collect()}
    want = set()
    for g in range(3):
        left = 100.0
        for _, i, _, cost in sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] / r[3]), r[1])):
            if cost <= left:
                want.add((g, i))
                left -= cost
    assert got == want


def test_chunks_by_hand(spark):
    text = "\n\n".join(f"Paragraph {i}. " + "some words here. " * (i % 7 + 1) for i in range(40))
    rows = search.chunks(spark.createDataFrame([(1, text), (2, None), (3, "short")], "doc_id long, text string")).collect()
    one = sorted((r for r in rows if r["doc_id"] == 1), key=lambda r: r["chunk"])
    assert [r["text"] for r in one] == [text[r["start"] : r["start"] + r["length"]] for r in one]
    assert one[0]["start"] == 0
    assert one[-1]["start"] + one[-1]["length"] == len(text)
    assert all(r["length"] <= 1024 for r in one[:-1])
    assert all(b["start"] == a["start"] + a["length"] - 128 for a, b in zip(one[:-2], one[1:-1], strict=True))
    assert [(r["start"], r["length"]) for r in rows if r["doc_id"] == 3] == [(0, 5)]


@pytest.mark.parametrize("start", [0.5, None])
def test_folds_by_composition(spark, start):
    """Clamped lines against plain loops: one key with most rows, which many tasks
    share, and a null key."""
    from pyspark.sql import functions as F

    from quartzfolio.operators import windows

    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 1, None, 2]), t, rng.choice([0.0, 0.5, 1.0]) if start is not None else 0.5, rng.uniform(-0.4, 0.5)) for t in range(3000)]
    df = spark.createDataFrame(rows, "k long, t long, a double, b double").repartition(7)
    line = (F.col("a"), F.col("b"), F.lit(-0.3 if start is not None else float("-inf")), F.lit(0.8 if start is not None else float("inf")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["k"]: r["state"] for r in windows.fold_maps(df, ["k"], ["t"], line, start).collect()}
        cut = df.repartitionByRange("k", "t").where("k = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(cut) > 1 and max(r["count"] for r in cut) < 0.7 * sum(r["count"] for r in cut)  # the hot key is not one task's
    want = {}
    for k, _, a, b in rows:
        s = want.get(k, start if start is not None else b / (1 - a))
        want[k] = min(0.8, max(-0.3, a * s + b)) if start is not None else a * s + b
    assert got == pytest.approx(want)
    assert windows.fold_maps(df.limit(0), ["k"], ["t"], line, start).count() == 0


def test_null_keys_are_one_key(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([(None, at(m), m) for m in range(4)] + [(1, None, 9)], "key long, ts timestamp, event_id long")
    assert [r["event_id"] for r in learning.cooldown(rows, "1 hour").collect()] == [0]
    items = spark.createDataFrame([(None, i, 9.0, 60.0) for i in range(3)] + [(1, 5, 1.0, None)], "g long, id long, score double, cost double")
    assert [r["id"] for r in budget.greedy(items, "g", 100.0).collect()] == [0]


def test_rows_without_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0])]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query"], r["vec_id"]) for r in search.nearest(vecs, vecs, 5, 5).collect()}
    assert got == {(a, b) for a in (0, 1, 4) for b in (0, 1, 4) if a != b}


def test_copies_without_id(spark):
    rows = spark.createDataFrame([(1, "same text"), (None, "same text"), (2, "other")], "id long, text string")
    assert [(r["id"], r["other"], r["copy"]) for r in dedup.lsh_pairs(rows, 0.75).collect()] == [(1, None, True)]


def test_copies_of_a_hot_text(spark):
    """A text that two thirds of all rows have is no one task's work."""
    rows = [(i, "hot") for i in range(6000)] + [(i, f"text {i // 2}") for i in range(10_000, 13_000)] + [(None, "hot"), (20_000, None), (20_001, "")]
    out = dedup.by_content(spark.createDataFrame(rows, "id long, text string").repartition(8), "text", "id")
    got = {r["id"]: (r["class_id"], r["copies"]) for r in out.collect()}
    want = {i: (0, 6001) for i in [*range(6000), None]} | {i: (i - i % 2, 2) for i in range(10_000, 13_000)} | {20_001: (20_001, 1)}
    assert got == want
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_bands_that_very_many_texts_share(spark, monkeypatch):
    from quartzfolio.operators import likeness

    rows = spark.createDataFrame([(i, f"a rather long common passage that all of these share, item {i % 90}") for i in range(180)], "id long, text string")
    whole = sorted(map(tuple, dedup.lsh_pairs(rows, 0.75).collect()))
    monkeypatch.setattr(likeness.meet, "__defaults__", (11,))
    assert sorted(map(tuple, dedup.lsh_pairs(rows, 0.75).collect())) == whole
    assert len(whole) > 90
