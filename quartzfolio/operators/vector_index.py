"""An inverted file of vectors: cells around learned centroids, probed by nearness.

Centroids come from a bounded sample; every vector is in the index, in the cell of
its nearest centroid. A search looks into the few nearest cells of each query, where
queries and vectors meet as matrix products in blocks, so that a cell with very many
vectors, or one that very many queries look into, is many tasks. Cosines are exact;
what may be missed is a neighbour in a cell that isn't looked into. ``search`` with
all cells, and ``operators.search.nearest``, are the exact ways.

Rows without a vector or with a null in it are not in the index and ask nothing; a
vector of zeros is in the first cell and has a cosine of zero with all.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfolio.operators.windows import top_per_group

#: Vectors that centroids are learned from, at most; how many centroids, at most;
#: and rounds of learning.
SAMPLE, CELLS, ROUNDS = 20_000, 4096, 12
#: Vectors of the sample that ask how many cells it takes, and the recall asked for.
ASKING, RECALL = 500, 0.95
#: Vectors and queries of a cell that meet in a task.
VECTORS, QUERIES = 8192, 512
WHOLE = "embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)"


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def matrix(column: pa.ListArray) -> np.ndarray:
    return np.array(column.values.to_numpy(zero_copy_only=False), np.float64)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """How many cells to look into, so that ``recall`` of the ``k`` nearest in the
    sample are there: by the place, in each asking vector's order of cells, of the
    cells that hold its nearest."""
    asks = x[:ASKING]
    order = np.argsort(-(asks @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    cell = (x @ centroids.T).argmax(axis=1)
    score = asks @ x.T
    score[np.arange(len(asks)), np.arange(len(asks))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    places = np.take_along_axis(place, cell[near], axis=1).ravel()
    return int(np.quantile(places, recall, method="higher")) + 1 if len(places) else len(centroids)


def learn(vecs: DataFrame, cells: int | None = None, sample: int = SAMPLE, k: int = 10, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """Centroids by spherical k-means over the ``sample`` vectors with the least hash
    of their ids, as many as the root of the number of vectors, ``CELLS`` at most;
    and how many cells to look into for the ``k`` nearest. Vectors in clusters need a
    few cells, those without any structure most of them."""
    whole = vecs.where(WHOLE)
    n = whole.count()
    rows = whole.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).collect()  # bounded
    if not rows:
        return np.zeros((0, 0)), 0
    x = unit(np.array([r["embedding"] for r in rows], np.float64))
    many = min(len(x), cells or max(1, min(CELLS, round(n**0.5))))
    at = x[np.random.default_rng(5).choice(len(x), many, replace=False)]
    for _ in range(ROUNDS):
        cell = (x @ at.T).argmax(axis=1)
        total = np.zeros_like(at)
        np.add.at(total, cell, x)
        at = np.where((np.bincount(cell, minlength=many) > 0)[:, None], unit(total), at)
    return at, probes_for(x, at, k, recall)


def cells_of(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``rows`` with ``cell``, a row for each of the ``probes`` nearest centroids."""
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)  # CELLS vectors at most

    @F.arrow_udf("array<int>")
    def nearest_cells(column: pa.Array) -> pa.Array:
        score = unit(matrix(column)) @ shipped.value.T
        top = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1]), pa.int32()), pa.array(top.ravel()))

    return rows.where(WHOLE).withColumn("cell", F.explode(nearest_cells("embedding")))


def build(vecs: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Write every vector (vec_id, embedding and further columns) with its cell, in
    the order of cells, so that a search skips the groups of rows it doesn't need."""
    placed = cells_of(vecs, centroids, 1)
    placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.parquet(path)


def search(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, places: int = 5, least: float = -1.0) -> DataFrame:
    """``query, vec_id, cosine, place`` of the ``k`` nearest vectors in the ``probes``
    cells nearest to each query (vec_id, embedding), itself left out, with a cosine
    of ``least`` at least; scores are rounded before, and the lesser id wins ties."""
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("parts"))  # a row a cell
    asked = cells_of(queries.select("vec_id", "embedding"), centroids, min(probes, len(centroids)))
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    cut = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shape = F.broadcast(sizes.join(blocks, "cell"))  # CELLS rows at most
    left = asked.join(shape, "cell").select("cell", cut("blocks", 1).alias("block"), every("parts").alias("part"), "vec_id", "embedding", F.lit(True).alias("asks"))
    right = index.join(shape, "cell").select("cell", every("blocks").alias("block"), cut("parts", 2).alias("part"), "vec_id", "embedding", F.lit(False).alias("asks"))
    out = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])

    def best(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sides = [group.filter(pa.compute.equal(group.column("asks"), flag)) for flag in (True, False)]
        if not sides[0].num_rows or not sides[1].num_rows:
            return out.empty_table()
        ids = [s.column("vec_id").to_numpy() for s in sides]
        vectors = [unit(matrix(s.column("embedding").combine_chunks())) for s in sides]
        order = np.argsort(ids[1], kind="stable")
        found = ids[1][order]
        score = np.floor(vectors[0] @ vectors[1][order].T * 10.0**places + 0.5) / 10.0**places
        score[(ids[0][:, None] == found[None, :]) | (score < least)] = -np.inf
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        got = np.take_along_axis(score, top, axis=1).ravel()
        kept = np.isfinite(got)
        return pa.table([np.repeat(ids[0], top.shape[1])[kept], found[top].ravel()[kept], got[kept]], schema=out)

    some = left.unionByName(right).groupBy("cell", "block", "part").applyInArrow(best, "query long, vec_id long, cosine double")
    return top_per_group(some, ["query"], [F.desc("cosine"), "vec_id"], k, salt="vec_id")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query, vec_id) that were found."""
    hit = exact.select("query", "vec_id").join(found.select("query", "vec_id"), ["query", "vec_id"], "left_semi").count()
    return hit / max(1, exact.count())
