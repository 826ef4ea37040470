"""The trie of conversation prefixes, by preorder intervals.

A turn is a digest of sixteen bytes and its size; a conversation is the array of
its turns. Equal conversations are one sequence with a count. Distinct sequences
are sorted by ranges of that array, which ranks them so that a prefix comes
before what extends it; each sequence then yields its prefixes, named by a
running digest. A node is a distinct prefix: the first and the last sequence
that have it bound its subtree, and in the order of first sequence and depth the
nodes stand in preorder. A subtree is the interval from a node to the last node
of its last sequence. Numbers in that order, leaves and savings are summed up
block by block, with the blocks' totals before; a subtree's leaves and savings
are differences of two such sums.

Defined results. A null role or text is empty. Turns are ordered by turn (nulls
first), then role, then text; repeated rows are turns of their own. A conversation
without turns is a member of the root. Very long texts are digested whole. Rows
without ``conv_id`` belong to no conversation and are left out; of an empty
table there is no node, not even a root. A conversation's digests, 16 bytes a
turn, must fit in a row; its texts aren't gathered. Further columns are not read.

Hot groups. Equal conversations meet as counts, but for their ids: these are cut
into runs by ranges of id, joined to short texts, before the runs of a node meet
in order, so that SHA-256, which takes them one after another, holds one run.
Nodes meet their parents by weight, as ``join_by_weight``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.llm.common import join_by_weight, materialize

FAMILY, MOST_SHARED = 5, 9
#: Ids joined to one text before they meet those of other tasks.
RUN = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, k, turn`` of each row: its place from 0, and digest and bytes of
    its text; a role's size goes before it, so that no two turns read alike."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, 16).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), role.alias("role"), F.sha2(text.cast("binary"), 256).alias("by_text"), text.alias("text"), turn.alias("turn"))
    return rows.selectExpr("conv_id", "row_number() OVER (PARTITION BY conv_id ORDER BY at NULLS FIRST, role, text) - 1 AS k", "turn")


def n_shared(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the first turns of the family's first conversation, then
    its own after as many."""
    ids = turns.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id")
    wants = ids.select("conv_id", n_shared(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    given = turns.where(F.col("k") < MOST_SHARED - 1).withColumnRenamed("conv_id", "base").join(wants, "base").where("k < h").select("conv_id", "k", "turn")
    own = turns.where(F.col("k") >= n_shared(F.col("conv_id")))
    none = ids.select("conv_id", F.lit(None).cast("int").alias("k"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"))
    parts = given.unionByName(own).unionByName(none).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "turn")))).alias("parts"))
    return parts.select("conv_id", F.col("parts.turn").alias("turns"))


def ends_of(members: DataFrame) -> DataFrame:
    """``sequence, ends_sha256``: the digest of a sequence's ids, ascending, with
    commas between. Ids are joined to runs by ranges first."""
    cut = members.select("sequence", "conv_id").repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    runs = pa.schema([("sequence", pa.binary()), ("least", pa.int64()), ("ids", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for b in batches:
            done = []
            for s, c in zip(b.column("sequence").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if ids and (s != now or len(ids) == RUN):
                    done.append((now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = s
                ids.append(c)
            yield pa.RecordBatch.from_pylist([dict(zip(runs.names, d, strict=True)) for d in done], schema=runs)
        if ids:
            yield pa.RecordBatch.from_pylist([{"sequence": now, "least": ids[0], "ids": ",".join(map(str, ids))}], schema=runs)

    out = pa.schema([("sequence", pa.binary()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for s, ids in zip(b.column("sequence").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if s != now:
                    if state is not None:
                        done.append({"sequence": now, "ends_sha256": state.hexdigest()})
                    now, state = s, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(done, schema=out)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"sequence": now, "ends_sha256": state.hexdigest()}], schema=out)

    joined = cut.mapInArrow(join, "sequence binary, least long, ids string")
    return joined.repartition("sequence").sortWithinPartitions("sequence", "least").mapInArrow(digest, "sequence binary, ends_sha256 string")


def prefixes(sequences: DataFrame) -> DataFrame:
    """Every prefix of every sequence, the empty one included: ``node`` and
    ``parent`` are running digests, ``last`` the whole sequence's."""
    schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("rank", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), ("conv_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for rank, turns, n, conv_id in zip(*(b.column(c).to_pylist() for c in ("rank", "turns", "n", "conv_id")), strict=True):
                state, node = hashlib.blake2b(digest_size=16), ROOT
                rows.append((ROOT, None, 0, 0, rank, not turns, n, conv_id))
                for depth, t in enumerate(turns, 1):
                    state.update(t["digest"])
                    parent, node = node, state.digest()
                    rows.append((node, parent, depth, t["bytes"], rank, depth == len(turns), n, conv_id))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return sequences.select("rank", "turns", "n", "conv_id").mapInArrow(run, "node binary, parent binary, depth long, bytes long, rank long, last boolean, n long, conv_id long")


def summed(nodes: DataFrame, values: dict[str, str]) -> DataFrame:
    """Running sums of expressions over nodes in preorder: within blocks, which are
    ranges of that order, and the totals of the blocks before."""
    spark = nodes.sparkSession
    cut = materialize(nodes.repartitionByRange("first", "depth").withColumn("block", F.spark_partition_id()), "blocks")
    totals = cut.groupBy("block").agg(*(F.expr(f"sum({e})").cast("long").alias(c) for c, e in values.items())).orderBy("block").collect()  # a row a block
    before, offsets = dict.fromkeys(values, 0), []
    for r in totals:
        offsets.append((r["block"], *before.values()))
        before = {c: before[c] + r[c] for c in values}
    ddl = "block int, " + ", ".join(f"before_{c} long" for c in values)
    window = "OVER (PARTITION BY block ORDER BY first, depth ROWS UNBOUNDED PRECEDING)"
    rows = cut.join(F.broadcast(spark.createDataFrame(offsets, ddl)), "block")
    return rows.selectExpr(*nodes.columns, *(f"before_{c} + sum({e}) {window} AS {c}" for c, e in values.items()))


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node; ``position`` and ``end`` bound its subtree."""
    whole = F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "").cast("binary"), 256)
    members = materialize(rebuilt(turns_of(conversations)).withColumn("sequence", F.substring(F.unhex(whole), 1, 16)), "members")
    distinct = members.groupBy("sequence").agg(F.any_value("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    ranked = distinct.repartitionByRange("turns").sortWithinPartitions("turns").withColumn("rank", F.monotonically_increasing_id())
    sequences = materialize(ranked, "sequences")
    of = prefixes(sequences).groupBy("node").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.any_value("bytes").alias("bytes"), F.min("rank").alias("first"), F.max("rank").alias("final"),
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.bool_or("last").alias("ends"),
    )
    nodes = materialize(of, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    counted = materialize(nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").fillna(0, ["n_children"]), "counted")
    up = counted.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = join_by_weight(counted.where("parent IS NOT NULL"), up, ["parent"], "n", counted.count())
    linked = below.unionByName(counted.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    values = {"position": "1", "leaves": "CAST(n_children = 0 AS LONG)", "saved": "(n_convs - 1) * bytes"}
    run = materialize(summed(linked, values), "preorder")
    # the last node that a sequence brings is its whole self: where subtrees end
    last = run.where("ends").select(F.col("first").alias("final"), F.col("position").alias("end"), F.col("leaves").alias("end_leaves"), F.col("saved").alias("end_saved"))
    full = run.join(last, "final").selectExpr(
        "first", "ends", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "position", "end",
        f"end_leaves - leaves + {values['leaves']} AS n_leaves", f"end_saved - saved + {values['saved']} AS saved_tokens",
    )
    ended = sequences.select("sequence", F.col("rank").alias("first")).join(ends_of(members), "sequence").select("first", F.lit(True).alias("ends"), "ends_sha256")
    return full.join(ended, ["first", "ends"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "position", "end"
    )
