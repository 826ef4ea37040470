"""What the third round of findings asked for."""

import random
from functools import reduce

import duckdb
import psutil
from pyspark.sql import functions as F

from quartzfolio.operators import containment, graph, tables
from quartzfolio.operators import likeness as lk
from quartzfolio.operators import references
from quartzfolio.operators import taxonomy as tx
from quartzfolio.plans import ingestion, learning, portfolio, similarity, validation


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast_unasked(spark):
    items = spark.range(200).select((F.col("id") % 3).alias("tenant"), F.concat(F.lit("name "), F.col("id") % 40).alias("name"))
    asked = []
    for most in ("-1", "10m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        asked.append(plan(containment.overlaps(items)).count("BroadcastHashJoin"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert asked[0] == asked[1]
    rows = tables.materialize(spark.range(4000).select((F.col("id") % 3000).alias("k")), "rows")
    of = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = plan(tables.join_by_weight(rows, of, ["k"], "n", 4000))
    assert joined.count("SortMergeJoin") == 1, joined


DETECTORS = (("category", ("category", "owner")), ("vendor", ("category", "vendor")))


def test_agreeing_pairs_and_degrees(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i if rng.random() < 0.9 else rng.choice([7, 8, None]), *(rng.choice(["a", "b", None]) for _ in range(3))) for i in range(120)]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] is not None and b[0] is not None and a[0] < b[0]:
                for rank, (kind, (x, y)) in enumerate((("category", (1, 2)), ("vendor", (1, 3)))):
                    if None not in (a[x], a[y]) and (a[x], a[y]) == (b[x], b[y]):
                        want[a[0], b[0]] = min(want.get((a[0], b[0]), (9,)), (rank, kind))
    df = spark.createDataFrame(rows, "id long, category string, owner string, vendor string")
    got = [tuple(r) for r in graph.agreeing_pairs(df, DETECTORS).collect()]
    assert sorted(got) == sorted((*k, v[1]) for k, v in want.items())
    degree = {i: sum(i in k for k in want) for i, *_ in rows}
    told = [tuple(r) for r in graph.agreement_degrees(df, DETECTORS).collect()]
    assert sorted(told, key=str) == sorted(((i, degree[i]) for i, *_ in rows), key=str)


def test_leaders_are_first_heads(spark, sf_dir):
    prof = tables.materialize(lk.profiles(similarity.compared(spark, sf_dir).where("id < 90")), "profiles")
    links = tables.materialize(lk.item_links(prof, 0.7), "links")
    want = {r["id"]: r["head"] for r in lk.first_heads(prof, links).collect()}
    got = lk.leaders(prof, 0.7, 20).collect()
    assert {r["id"]: r["head"] for r in got} == want
    like = {(r["id"], r["other"]): r["likeness"] for r in links.collect()}
    assert all(r["likeness"] == like.get((r["head"], r["id"])) for r in got)
    assert 1 < len(set(want.values())) < len(want)


def test_means_at_the_limit_are_exact(spark):
    rng, found = random.Random(5), None
    while found is None:
        some = [rng.randrange(1000) for _ in range(20)]
        some.append(500 * 21 - sum(some))
        if 0 <= some[-1] < 1000 and reduce(lambda s, x: s + x / 1000, some, 0.0) / 21 < 0.5 and sum(x < 600 for x in some) > 3:
            found = some
    rows = spark.createDataFrame([(1, x / 1000) for x in found], "item long, confidence double").coalesce(1)
    assert [r["weak_item"] for r in learning.STATS["low_confidence_alerts"][1](rows).collect()] == [False]


def test_codes_that_no_item_tells_apart_are_one(spark):
    codes = spark.createDataFrame([("b.1", "red bolt", None), ("a.1", "bolt red", None), ("a.2", "red bolt", True), ("c", "red bolt", None)], "code string, description string, service boolean")
    assert sorted({r["code"] for r in tx.index(codes).collect()}) == ["a.1", "a.2", "c"]


def test_links_are_counted_without_their_pairs(spark, sf_dir, monkeypatch):
    for name, n in (("LEFT", 3), ("RIGHT", 7), ("AT_ONCE", 40)):
        monkeypatch.setattr(lk, name, n)
    some = similarity.compared(spark, sf_dir).where("id < 120")
    odd = some.selectExpr("id + 1000 AS id", "CASE WHEN id % 9 = 0 THEN concat(name, 's') ELSE name END AS name", "CASE WHEN id % 4 = 0 THEN NULL ELSE vendor END AS vendor", "CASE WHEN id % 3 = 0 THEN NULL ELSE category END AS category",
        "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE price END AS price", "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(sku, '0') WHEN 2 THEN concat('f', substr(sku, 2)) ELSE sku END AS sku", "description")
    prof = tables.materialize(lk.profiles(some.unionByName(odd).unionByName(odd.where("id < 1020").withColumn("id", F.col("id") + 1000))), "profiles")
    copies = {r["id"]: r["copies"] for r in prof.collect()}
    want = {}
    for r in lk.item_links(prof, 0.9).collect():
        for i, j in ((r["id"], r["other"]), (r["other"], r["id"])):
            n, best = want.get(i, (0, (0, 0)))
            want[i] = n + copies[j], max(best, (r["likeness"], -j))
    got = {r["id"]: (r["n_links"], (r["likeness"], -r["best"])) for r in lk.link_counts(prof, 0.9).collect()}
    assert got == want and len(want) > 100


def test_arrays_of_capabilities_are_made_once_on_all_cores(spark, sf_dir):
    told = plan(portfolio.capabilities(spark, sf_dir))
    assert "size(" not in told and "RoundRobinPartitioning" in told, told


def test_guardian_rows_are_dealt_and_issues_made_once(spark, sf_dir):
    for q in (validation.guardian_verdict, validation.field_scores):
        told = plan(q(spark, sf_dir))
        assert "RoundRobinPartitioning" in told
        assert told.count("networking") <= 3, told  # the list of categories stands once in issues, twice in corrections
    assert "size(" not in told


def test_automata_of_an_executor_fit(spark):
    words = [f"{i % 977:x} report {i:07d} of {i * 7919 % 100003:x}" for i in range(30_000)]
    before = psutil.Process().memory_info().rss
    references.automaton("test", words)
    each = (psutil.Process().memory_info().rss - before) / sum(map(len, words))
    references.BUILT.clear()
    assert 4 * max(each, 40) * references.MOST_BYTES < 2e9  # four workers


def stored_parts(spark, path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def joined_rows(df):
    """Rows that the joins of an executed plan have put out, the most of one."""
    seen, most = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            seen.append(node.plan())
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        seen += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_existing_duplicates_are_those_of_the_sql(spark, tmp_path):
    rng = random.Random(23)
    names = ["large ring", "Large ring", "large rings", "large rung", "old plate", "a very long name of a ring", "a very long name of a rung", None]
    pick = lambda *x: rng.choice(x)
    rows = [(pick(i, i, i, 7, 9, None), rng.choice(names), pick("LARGE", "SMALL", "PROMO", None), pick("B1", "B2", "B3", None), pick(1, 2, 3, 4, 5, None)) for i in range(700)]
    sf = stored_parts(spark, tmp_path, rows)
    got = sorted(tuple(r) for r in ingestion.existing_duplicates(spark, sf).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS FROM '{sf}/part.parquet/*.parquet'")
        assert got == sorted(con.execute(ingestion.R.sql["existing_duplicates"]).fetchall())
    assert len(got) > 40


def test_kinds_of_other_vendors_are_not_compared_one_by_one(spark, tmp_path):
    kinds = [(v, z) for v in range(60) for z in (1, 2, 3)]
    rows = [(6 * i + d, "large ring", "LARGE", f"Brand#{v}", z) for i, (v, z) in enumerate(kinds) for d in (0, 1)]
    df = ingestion.existing_duplicates(spark, stored_parts(spark, tmp_path, rows))
    got = df.collect()
    assert len(got) == 180 and {r["n_links"] for r in got} == {180} and all(r["existing"] == r["id"] + 1 and r["score"] == 1 for r in got)
    assert joined_rows(df) <= 3 * 180  # of 180 * 180 pairs
