"""Relations between items: edges, degrees, cycles, mentions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.operators.references import holding
from quartzfolio.operators.tables import join_by_weight, materialize, shuffled

#: Rows of a group that stand in one array and are met by others one after another.
BLOCK = 2000


def equal_pairs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges (src, dst) between rows (id) that agree in all keys, src < dst. What
    comes out is the answer itself, so choose keys with small groups."""
    other = rows.select(F.col("id").alias("dst"), *keys)
    return rows.select(F.col("id").alias("src"), *keys).join(other, list(keys)).where("src < dst").select("src", "dst")


def first_detected(detectors: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Edges of several detectors; of a pair found more than once the first in
    order stays."""
    out = None
    for i, (kind, e) in enumerate(detectors):
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind")).alias("k"))
        out = e if out is None else out.unionByName(e)
    return out.groupBy("src", "dst").agg(F.min("k").alias("k")).select("src", "dst", "k.kind")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose id no other row has, and the others; null ids are in neither."""
    n = rows.groupBy("id").agg(F.count("*").alias("_n")).where("id IS NOT NULL")
    return (rows.join(n.where(w).select("id"), "id") for w in ("_n = 1", "_n > 1"))


def agree(keys: Sequence[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{other}{k}")) & F.col(k).isNotNull() for k in keys))


def repeats(single: DataFrame, several: DataFrame, detectors: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """``src, dst, kind`` once each, of pairs of which an id is in several rows."""
    found = []
    for kind, keys in detectors:
        other = single.unionByName(several).select(F.col("id").alias("dst"), *keys)
        found.append((kind, several.select(F.col("id").alias("src"), *keys).join(other, list(keys)).where("src <> dst")))
    return first_detected(found)


def block_pairs(rows: DataFrame, keys: Sequence[str], before: Sequence[Sequence[str]], total: int) -> DataFrame:
    """``src, dst`` (src < dst) of rows (id: distinct, ...), ``total`` at most, with equal
    ``keys``, none null, that do not agree in all of one of the sets of keys ``before``.
    A group is cut into blocks by a hash of the id; a block is one array, which each row
    of it and of the blocks before it walks through, so that each two rows meet once.
    Work goes by pairs, not by bytes, so tasks are many and not gathered."""
    others = [[k for k in earlier if k not in keys] for earlier in before]
    if not all(others):
        return rows.select(F.col("id").alias("src"), F.col("id").alias("dst")).where(F.lit(False))  # all these agree before
    more = list(dict.fromkeys(k for of in others for k in of))
    marks = [F.xxhash64(*of).alias(f"_h{i}") for i, of in enumerate(others)]  # cheaper to compare than texts
    own = rows.dropna(subset=list(keys))
    cut = join_by_weight(own, own.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), keys, "_n", total).select("id", *keys, *more, *marks, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_m"))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"))
    held = ["id", *more, *(f"_h{i}" for i in range(len(others)))]
    where, tasks = [*keys, "_j"], 16 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = cut.groupBy(*keys, F.col("_b").alias("_j")).agg(F.collect_list(F.struct(*held)).alias("_block")).repartition(tasks, *where)
    walks = cut.withColumn("_j", F.explode(F.sequence(F.col("_b"), F.col("_m") - 1))).repartition(tasks, *where)
    met = walks.join(shuffled(blocks), where).select("_b", "_j", *held, F.explode("_block").alias("x")).where((F.col("_b") != F.col("_j")) | (F.col("id") < F.col("x.id")))
    for i, of in enumerate(others):
        met = met.where((F.col(f"_h{i}") != F.col(f"x._h{i}")) | ~agree(of, "x."))
    return met.select(F.least("id", "x.id").alias("src"), F.greatest("id", "x.id").alias("dst"))


def agreeing_pairs(rows: DataFrame, detectors: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """``src, dst, kind``, once each (src < dst): rows (id, ...) that agree in all keys
    of a detector (kind, keys); of a pair that several detect the first in order
    stays. A pair is left out where an earlier detector has it, so pairs are not
    shuffled; groups meet in blocks. There are as many as the answer has, which grows
    with the square of a group."""
    single, several = (materialize(part, "rows") for part in told_apart(rows))
    out, before, total = repeats(single, several, detectors), [], single.count()
    for kind, keys in detectors:
        out = out.unionByName(block_pairs(single, keys, before, total).withColumn("kind", F.lit(kind)))
        before.append(keys)
    return out


def agreement_degrees(rows: DataFrame, detectors: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """``id, degree`` of each row: how many ends of ``agreeing_pairs`` it is, without
    the pairs. Who agrees in one set of keys or in another is counted by sizes of
    groups, those that agree in both taken off again."""
    single, several = told_apart(rows)
    ends, n = [], single.count()
    for k in range(1, len(detectors) + 1):
        for some in combinations(detectors, k):
            keys = list(dict.fromkeys(c for _, own in some for c in own))
            of = single.select("id", *keys).dropna(subset=keys)
            sizes = of.groupBy(*keys).agg(F.count("*").alias("n"))
            ends.append(join_by_weight(of, sizes, keys, "n", n).select("id", ((F.col("n") - 1) * (-1) ** (k + 1)).alias("n")))
    ends.append(repeats(single, several, detectors).select(F.explode(F.array("src", "dst")).alias("id"), F.lit(1).cast("long").alias("n")))
    total = reduce(DataFrame.unionByName, ends).groupBy("id").agg(F.sum("n").alias("degree"))
    return rows.select("id").join(total, "id", "left").fillna(0, ["degree"])


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """Simple cycles of at most ``longest`` edges (src, dst), each written from
    its least node. Paths grow by one join a step and never pass below their
    start, so every cycle is found once."""
    step = edges.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    paths = edges.where("src <= dst").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    done = paths.where("start = last")
    for _ in range(longest - 1):
        grown = paths.where("start <> last").join(step, "last").where("next >= start AND (next = start OR NOT array_contains(path, next))")
        paths = grown.select("start", F.col("next").alias("last"), F.array_append("path", F.col("next")).alias("path"))
        done = done.unionByName(paths.where("start = last"))
    return done.select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges (src, dst), once each, between nodes that lie on a cycle or on a way from
    one cycle to another: nodes without an edge in or out go, until none is left. There
    are as many rounds as the longest chain outside that core has edges, each of two
    semi-joins on what the round before has kept."""
    kept = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    n = kept.count()
    while n:
        on = kept.join(kept.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        on = materialize(on.join(kept.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "edges")
        kept, before, n = on, n, on.count()
        if n == before:
            break
    return kept


def doubled(steps: DataFrame) -> DataFrame:
    """Steps (src, dst), one for each source, taken twice; a node that very many
    lead to is broadcast."""
    into = steps.groupBy("dst").agg(F.count("*").alias("n"))
    further = steps.select(F.col("src").alias("dst"), F.col("dst").alias("next")).join(into, "dst")
    return join_by_weight(steps, further, ["dst"], "n", steps.count()).select("src", F.col("next").alias("dst"))


def found_cycles(edges: DataFrame) -> DataFrame:
    """``start, length, place, node``: cycles of a graph of any size, a row for each
    node of a cycle, numbered from its least node on.

    In the core of a graph every node has a successor. If each goes to its least one,
    all ways end in cycles, at least one for each component that has one, and none of
    them shares a node. What lies on them is found by doubling steps: 2 ** k steps
    from all nodes end in ever fewer, until the number stays. Least nodes and places
    are found by doubling too, so rounds grow with the logarithm of the longest way.
    Nulls are no nodes; repeated edges count once; a node that leads to itself, and
    has no lesser successor, is a cycle of one.
    """
    steps = materialize(cyclic_core(edges).groupBy("src").agg(F.min("dst").alias("dst")), "steps")
    far, n = steps, -1
    while True:
        ends = materialize(far.select(F.col("dst").alias("src")).distinct(), "ends")
        k = ends.count()
        if k == n or not k:
            break
        n = k
        far = materialize(doubled(far.join(ends, "src", "left_semi")), "far")
    on = materialize(steps.join(ends, "src", "left_semi"), "ring")
    low = on.select("src", "dst", F.least("src", "dst").alias("low"))  # the least of the nodes from src to dst
    moved = k
    while moved:
        low = materialize(low, "low")
        other = low.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("low").alias("b_low"))
        met = low.join(other, "dst")
        moved = met.where("b_low < low").count()
        low = met.select("src", F.col("next").alias("dst"), F.least("low", "b_low").alias("low"))
    # from each node to the one that leads to the least: its distance there, from the end
    ways = on.join(low.select("src", "low"), "src").select("src", "low", F.when(F.col("dst") != F.col("low"), F.col("dst")).alias("dst"), F.when(F.col("dst") != F.col("low"), 1).otherwise(0).cast("long").alias("left"))
    going = k
    while going:
        ways = materialize(ways, "ways")
        other = ways.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("left").alias("b_left"))
        going = ways.where("dst IS NOT NULL").count()
        ways = ways.join(other, "dst", "left").select("src", "low", F.col("next").alias("dst"), (F.col("left") + F.coalesce("b_left", F.lit(0))).alias("left"))
    sizes = ways.where(F.col("src") == F.col("low")).select("low", (F.col("left") + 1).alias("length"))
    return ways.join(sizes, "low").select(F.col("low").alias("start"), "length", (F.col("length") - 1 - F.col("left")).alias("place"), F.col("src").alias("node"))


def mentions(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a text of ``docs`` holds a passage whole.

    Of each passage's inner words the one in the fewest documents is its key;
    documents send a row only for the keys, and a meeting is verified on the
    texts. Passages of fewer than three words have no inner word; an automaton over
    all of them finds these in one pass.
    """
    parts = lambda c: F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    inner = passages.where("passage <> ''").withColumn("w", parts(F.col("passage"))).withColumn("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))
    words = inner.select("item_id", "passage", F.explode(F.array_distinct("w")).alias("word"))
    own = docs.select("doc_id", F.explode(F.array_distinct(parts(F.col("text")))).alias("word"))
    wanted = words.select("word").distinct()
    counts = own.join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rare = words.join(counts, "word").groupBy("item_id", "passage").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    hits = own.join(rare.select("item_id", "word"), "word").select("doc_id", "item_id")
    long = hits.join(docs, "doc_id").join(passages, "item_id").where(F.contains("text", F.col("passage"))).select("doc_id", "item_id")
    short = inner.where(F.size("w") == 0).select("item_id", "passage")
    found = holding(docs, short.select(F.col("item_id").alias("pattern_id"), F.col("passage").alias("pattern")))
    return long.unionByName(found.withColumnRenamed("pattern_id", "item_id"))
