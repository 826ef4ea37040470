"""N-gram Jaccard self-join of documents by MinHash banding.

Texts with the same set of word n-grams are one class of copies, kept as one
representative with a count. Bands of minimal hashes, their number and rows
chosen for the wanted recall, put representatives into buckets. Buckets that
hold one text fall away, as do buckets with the members of another one. What is
left is verified on full n-gram sets inside tasks: a bucket beyond the size of a
block is split, and each pair of its blocks is a task of its own. A pair is
counted in the first bucket that its two texts share. Tasks return a row for
each linked text, its number of links and the least text of its linked group
there, never the pairs. Work in a bucket is the square of its number of
different texts, as every one of its links is counted; copies cost nothing.

Hot keys. Texts with very many copies, buckets with very many texts and groups
with very many members are joined by ``join_by_weight``: the few keys that hold
a two-thousandth of the rows or more are broadcast, their number being bounded.

Defined results. Words are what lies between ASCII blanks; n-grams are of
``n`` words, and a shorter text with a word is one n-gram. Null texts and texts
without a word are linked to nothing, each a class of its own. Repeated rows are
copies. ``class_id`` is the least id of all documents joined by links, directly
or over others; a null id counts as the least, and is returned as null. Further
columns are ignored or passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzfolio.llm.common import join_by_weight, materialize, mix64, odd_multipliers, orderable

N, SIMILARITY, RECALL = 5, 0.8, 0.9999
MOST_HASHES = 128
#: A block of a bucket has about so many texts, or bytes of them, at most.
BLOCK_TEXTS, BLOCK_BYTES = 200, 4_000_000
LOWEST_ID = -(2**63)
PLACES = odd_multipliers(64, 101)
SALT = np.uint64(0x5851F42D4C957F2D)


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most rows a band can have if a pair just as similar as ``similarity``
    is to share a bucket with probability ``recall``, for at most ``most`` hashes."""
    for rows in range(16, 0, -1):
        same = similarity**rows
        bands = 1 if same >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - same))
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"{most} hashes can't find pairs of similarity {similarity} with probability {recall}")


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text."""
    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        out += w[j : len(w) - k + 1 + j] * PLACES[j]
    return np.unique(mix64(out + np.uint64(k)))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    a = odd_multipliers(bands * rows, 29)
    least = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048, None] * a[None, :]).min(axis=0), out=least)
    least = mix64(least).reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        h = mix64(h * SALT + least[:, r])
    return h


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Id, hash and size of every text with a word, the 128-bit fingerprint of
    its set of n-grams, and its band hashes."""
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("size", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, bands_ = [], [], []
            for t in b.column("text").to_pylist():
                g = ngrams(t, n)
                for to, v in ((a_, mix64(g)), (b_, mix64(g ^ SALT))):
                    to.append(int((v.sum(dtype=np.uint64) + np.uint64(len(g))).astype(np.int64)))
                bands_.append(band_hashes(g, bands, rows).astype(np.int64))
            cols = [b.column("id"), b.column("text_hash"), b.column("size"), pa.array(a_, pa.int64()), pa.array(b_, pa.int64()), pa.array(bands_, pa.list_(pa.int64()))]
            yield pa.record_batch(cols, schema=schema)

    return docs.where(has_word()).select(*keys(), F.octet_length("text").cast("long").alias("size"), "text").mapInArrow(run, "id long, text_hash long, size long, set_a long, set_b long, bands array<long>")


def has_word() -> F.Column:
    return F.coalesce(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))


def keys() -> list[F.Column]:
    """``id`` (null as the least) and ``text_hash`` of a document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST_ID)).alias("id"), F.xxhash64("text").alias("text_hash")]


def linked(sizes: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs that are similar enough (and the diagonal)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    column = np.full(len(counts), -1)
    column[shared] = np.arange(len(shared))
    at = column[at]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((n, n), np.float32)
    step = 4096
    cuts = np.searchsorted(at, np.arange(0, len(shared) + step, step))
    for i in range(len(cuts) - 1):
        part = slice(cuts[i], cuts[i + 1])
        m = np.zeros((n, min(step, len(shared) - i * step)), np.float32)
        m[owner[part], at[part] - i * step] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    out = common >= similarity * union - 1e-6
    np.fill_diagonal(out, True)
    return out


def verify(texts: list[str], buckets: np.ndarray, kept: np.ndarray, band: int, block: np.ndarray, crossing: bool, n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts of one task: the matrix of links to count here, and for each
    text the place of the first one in its linked group. In a ``crossing`` task,
    one of two blocks, pairs inside a block are left to that block's own task."""
    sets = [ngrams(t, n) for t in texts]
    links = linked(np.array(list(map(len, sets))), sets, similarity)
    group = np.arange(len(texts))
    while True:
        new = np.where(links, group[None, :], len(texts)).min(axis=1)
        if (new == group).all():
            break
        group = new
    count = links & ~np.eye(len(texts), dtype=bool)
    if crossing:
        count &= block[:, None] != block[None, :]
    for k in range(band):  # a pair is counted in the first bucket it shares
        count &= ~((buckets[:, k, None] == buckets[None, :, k]) & kept[:, k, None] & kept[None, :, k])
    return count, group


def verifier(n: int, similarity: float):
    out = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("documents", pa.int64())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        node = np.array(group.column("node").to_pylist(), np.int64)
        _, first = np.unique(node, return_index=True)
        if len(first) < 2:
            return out.empty_table()
        g = group.take(pa.array(first))
        node = node[first]
        block = np.array(g.column("block").to_pylist())
        crossing = key[2].as_py() != key[3].as_py()
        if crossing and len(np.unique(block)) < 2:  # the other block is empty
            return out.empty_table()
        copies = np.array(g.column("copies").to_pylist(), np.int64)
        raw = g.column("kept").to_pylist()
        kept = np.array([[x is not None for x in r] for r in raw])
        buckets = np.array([[x or 0 for x in r] for r in raw], np.int64)
        count, roots = verify(g.column("text").to_pylist(), buckets, kept, key[0].as_py(), block, crossing, n, similarity)
        grouped = np.flatnonzero(np.bincount(roots, minlength=len(node))[roots] > 1)
        cols = [node[grouped], node[roots[grouped]], count.sum(1)[grouped], (count @ copies)[grouped]]
        return pa.table([pa.array(c, pa.int64()) for c in cols], schema=out)

    return run


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (node, root): root is the least
    node that can be reached. Alternates between linking all neighbours and the
    lesser ones to the least; a table in the shared folder ends each round."""
    now, seen = materialize(edges.where("node <> root").distinct(), label), None
    most = 2 * now.count()  # no round has more; one number in all rounds, so that Spark compiles them once
    while True:
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("least"), F.count("*").alias("n"))
        large = join_by_weight(both, least, ["node"], "n", most).where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).where("node <> root").distinct()
        down = large.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct()
        low = down.groupBy("node").agg(F.min("root").alias("least"))
        small = down.join(low, "node")
        small = small.select(F.col("root").alias("node"), F.col("least").alias("root")).unionByName(small.select("node", F.col("least").alias("root")))
        now = materialize(small.where("node <> root").distinct(), label)
        said = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())
        if said == seen:
            return now
        seen = said


def bucket_table(banded: DataFrame) -> DataFrame:
    """Band, hash, number of texts and of blocks of the buckets of ``banded`` (node,
    size, band, hash) that hold more than one text; of those with the same texts,
    told by two hashes of 64 bits, the first."""
    who = [F.bit_xor(F.xxhash64("node", F.lit(seed))) for seed in (3, 7)]  # can't overflow, however large a bucket
    buckets = banded.groupBy("band", "hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), who[0].alias("who"), who[1].alias("who_too")).where("n > 1")
    fresh = buckets.groupBy("n", "who", "who_too").agg(F.min(F.struct("band", "hash", "bytes")).alias("b")).select("b.*", "n")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    return fresh.select("band", "hash", "n", blocks.alias("blocks"))


def classes(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Tables of signatures (a row for each document with a word) and of classes
    of copies, with their representative, links and group."""
    bands, rows = bands_and_rows(similarity, recall)
    signed = materialize(signatures(docs, n, bands, rows), "signatures")
    alike = materialize(
        signed.groupBy("set_a", "set_b")
        .agg(F.min("id").alias("id"), F.min_by("text_hash", "id").alias("text_hash"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    banded = alike.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    fresh = materialize(bucket_table(banded), "buckets")
    kept = join_by_weight(banded.drop("size"), fresh, ["band", "hash"], "n", alike.count() * bands)
    members = kept.groupBy("node").agg(F.collect_list(F.struct("band", "hash", "blocks")).alias("in"))  # one for each band at most
    members = members.join(alike.select("node", "id", "text_hash", "copies"), "node")
    texts = docs.where(has_word()).select(*keys(), "text").join(members, ["id", "text_hash"])
    hash_of = F.map_from_entries(F.transform("in", lambda x: F.struct(x["band"], x["hash"])))
    texts = texts.withColumn("kept", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.element_at(hash_of, k)))
    block = F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")
    placed = texts.select("node", "copies", "text", "kept", F.inline("in")).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    found = placed.groupBy("band", "hash", "low", "high").applyInArrow(verifier(n, similarity), "node long, root long, links long, documents long")
    found = materialize(found, "links")
    grouped = components(found.select("node", "root"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    alike = alike.drop("bands").join(grouped, "node", "left").join(counts, "node", "left")
    alike = materialize(alike.withColumns({"root": F.coalesce("root", "node"), "links": F.coalesce("links", F.lit(0)), "documents": F.coalesce("documents", F.lit(0))}), "grouped")
    best = alike.groupBy("root").agg(F.min("id").alias("class_id"), F.min_by("text_hash", "id").alias("class_hash"), F.count("*").alias("n"))
    return signed, materialize(join_by_weight(alike, best, ["root"], "n", alike.count()), "members")


def join(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row for every document: its class, the least id of those with the same
    n-grams, how many these are (itself too), and its links to other documents."""
    signed, alike = classes(docs, n, similarity, recall)
    shown = lambda c: F.when(F.col(c) != LOWEST_ID, F.col(c))
    said = alike.select("set_a", "set_b", "class_id", F.col("id").alias("copy_of"), "copies", (F.col("documents") + F.col("copies") - 1).alias("n_links"), F.col("links").alias("n_linked_texts"), F.col("copies").alias("n"))
    with_word = join_by_weight(signed.select("id", "set_a", "set_b"), said, ["set_a", "set_b"], "n", signed.count()).select(shown("id").alias("doc_id"), shown("class_id").alias("class_id"), shown("copy_of").alias("copy_of"), "copies", "n_links", "n_linked_texts")
    zero = F.lit(0).cast("long")
    own = F.col("doc_id").cast("long")
    alone = docs.where(~has_word()).select(own.alias("doc_id"), own.alias("class_id"), own.alias("copy_of"), F.lit(1).cast("long").alias("copies"), zero.alias("n_links"), zero.alias("n_linked_texts"))
    return with_word.unionByName(alone)


def one_of_each(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` with one document of each class, that of the least id, and all
    documents without a word. Of rows with the same id and text one stays, the
    first by those of its other columns that can be ordered."""
    _, alike = classes(docs, n, similarity, recall)
    best = alike.select(F.col("class_id").alias("id"), F.col("class_hash").alias("text_hash")).distinct()
    rows = docs.where(has_word()).select(F.struct("*").alias("row"), *keys()).join(best, ["id", "text_hash"], "left_semi")
    order = [F.col(f"row.`{f.name}`") for f in docs.schema if f.name != "text" and orderable(f.dataType)]
    one = rows.groupBy("id", "text_hash").agg(F.min_by("row", F.struct(F.lit(0), *order)).alias("row"))
    return one.select("row.*").unionByName(docs.where(~has_word()))
