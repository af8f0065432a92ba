"""Near-duplicates by word shingles: SimHash's inverted index and MinHash bands propose, the exact similarity of shingle sets decides.

    sets(docs)            -> doc_id, text_hash, node (hash of the shingle set), size, fp (SimHash), keys (one for each band)
    indexed(docs, rows)   -> a, b: verified pairs of nodes from SimHash's inverted index
    linked(docs, rows)    -> a, b: verified pairs of nodes that hold every class together
    near_duplicates(docs) -> doc_id, text_hash, node, root
    first_of_each(docs)   -> one document of each class

A document is the set of its five-word shingles; two documents are linked where the Jaccard
similarity of their sets is at least 0.8. False links are not made: every link is verified on the two texts (shingles by 64-bit hash).

The operator's method comes first (see simhash): inverted index of positional bytes of the sets' fingerprints, count filter, verified bits, star
contraction. It can't find all links, as a pair of similarity 0.8 differs in about ten of 64 bits, so the classes that it makes are
then compared through MinHash bands. Sets agree in a band's ROWS minima with
probability similarity ** ROWS, so a pair of similarity 0.8 shares none of the bands with probability
(1 - 0.8 ** 5) ** 24 = 0.00007, a more similar one with less.

Documents of equal sets are one node. Members of a bucket are first compared with one
member of it, then with a second, so that a large class costs no square. What is still in different classes then is compared
all with all, and nothing is left out: as pairs in buckets of up to SMALL members, which gives less than SMALL / 2 rows for each
member; in blocks of members that are dealt over tasks in larger ones. A task gets two blocks, counts all their
common shingles as a product of matrices and returns a spanning forest of the links, so that no row is made for a pair that isn't linked.

Edge cases: null or wordless texts are one class; fewer words than a shingle: the
whole sequence is the shingle; equal rows share a class; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common, simhash

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 24, 5, 42
#: Rounds that compare a bucket with one of its members, before the rest of its pairs.
STARS = 2
#: Sets that a verifying task remembers.
REMEMBERED = 256
#: Members of a bucket whose pairs become rows; larger ones are compared in blocks.
SMALL = 32
#: Shingles of a block, a set counted as LIGHT at least: no more than about ROOM / LIGHT sets meet in a matrix.
ROOM, LIGHT = 1 << 18, 128
#: Shingles that are columns of a matrix at once.
COLUMNS = 2048


def shingles(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted distinct XXH64 of a text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    return np.unique(np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n))


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    if not len(left) and not len(right):
        return 1.0
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both / (len(left) + len(right) - both)


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of the sets that are similar enough, from the exact numbers of common elements of all pairs."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    elements, column, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *left, *right]), return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]  # an element of one set is common to none
    sides = []
    for n, at in zip(sizes, (place[: sizes[0].sum()], place[sizes[0].sum() :])):
        row = np.repeat(np.arange(len(n)), n)[at >= 0]
        order = np.argsort(at[at >= 0], kind="stable")
        sides.append((row[order], at[at >= 0][order]))
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(place.max(initial=-1)) + 1, COLUMNS):
        held = []
        for n, (row, at) in zip(sizes, sides):
            part = slice(*np.searchsorted(at, [first, first + COLUMNS]))
            matrix = np.zeros((len(n), COLUMNS), np.float32)
            matrix[row[part], at[part] - first] = 1
            held.append(matrix)
        both += held[0] @ held[1].T
    either = sizes[0][:, None] + sizes[1][None, :] - both.astype(np.int64)
    return np.nonzero(np.where(either, both / np.maximum(either, 1), 1.0) >= least)


def band_keys(hashes: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One 64-bit key for each band of MinHash values."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    added = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):  # long texts: a bounded number of values at once
        least = np.minimum(least, (hashes[None, at : at + 4096] * factors[:, None] + added[:, None]).min(1))
    each = least.reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(each[k].tobytes(), k) for k in range(bands)], np.uint64)


def sets(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shingles(x.as_py(), shingle, seed) for x in batch.column("text").cast(pa.binary())]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in each], np.uint64).view(np.int64)
            keys = np.concatenate([np.zeros(0, np.uint64), *[band_keys(s, bands, rows, seed) for s in each]]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * bands), pa.array(keys))
            fps = np.array([simhash.majority(s) for s in each], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes), pa.array([len(s) for s in each], pa.int32()), pa.array(fps), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "size", "fp", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, node long, size int, fp long, keys array<long>")


def texts_of(nodes: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, text: one text of each of the nodes."""
    hashes = rows.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    return docs.select("text", F.xxhash64("text").alias("text_hash")).join(hashes, "text_hash").dropDuplicates(["node"]).select("node", "text")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The pairs a, b whose shingle sets are similar enough. Only texts of nodes in pairs move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            found = known.pop(node, None)
            if found is None:
                found = shingles(text.as_py(), shingle, seed)
                if len(known) >= REMEMBERED:
                    del known[next(iter(known))]
            known[node] = found
            return found

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts = [batch.column(c).cast(pa.binary()) for c in ("left", "right")]
            near = [similarity(of(x, s), of(y, t)) >= least for x, y, s, t in zip(a, b, *texts)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    texts = common.stored(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, rows), "neardup")
    left, right = texts.withColumnsRenamed({"node": "a", "text": "left"}), texts.withColumnsRenamed({"node": "b", "text": "right"})
    return common.stored(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long"), "neardup")


def indexed(docs: DataFrame, rows: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """a, b: the links of SimHash's inverted index whose sets are similar enough, each fingerprint's nodes held by the smallest of them."""
    fps = common.stored(rows.select("fp", "node").distinct(), "neardup")
    heads = common.stored(fps.groupBy("fp").agg(F.min("node").alias("head")), "neardup")
    near = common.stored(simhash.links(heads), "neardup")
    of = lambda c: heads.withColumnsRenamed({"fp": c, "head": f"_{c}"})
    far = near.join(of("a"), "a").join(of("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    same = fps.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return verified(common.stored(far.unionByName(same).distinct(), "neardup"), docs, rows, least, shingle, seed)


def in_blocks(members: DataFrame, docs: DataFrame, rows: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED, room: int = ROOM) -> DataFrame:
    """a, b: a spanning forest of the links between members (key, node, size, root) of one bucket and different roots, for each two blocks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, node = table.column("block").to_numpy(), table.column("node").to_numpy()
        root = np.unique(table.column("root").to_numpy(), return_inverse=True)[1]
        texts = table.column("text").cast(pa.binary())
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        each = {k: shingles(texts[k].as_py(), shingle, seed) for k in {*left.tolist(), *right.tolist()}}
        i, j = near_pairs([each[k] for k in left.tolist()], [each[k] for k in right.tolist()], least)
        i, j = left[i], right[j]
        i, j = simhash._forest(*[x[root[i] != root[j]] for x in (i, j)])
        return pa.table({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    weights = members.groupBy("key").agg(F.ceil(F.sum(F.greatest("size", F.lit(LIGHT))) / room).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(seed)), "blocks").cast("int")
    pairs = F.expr("transform(sequence(0, blocks - 1), other -> struct(least(block, other) as l, greatest(block, other) as r))")
    cut = members.join(weights, "key").select("key", "node", "root", block.alias("block"), "blocks")
    dealt = cut.select("key", "node", "root", "block", F.explode(pairs).alias("p")).select("key", "p.l", "p.r", "node", "root", "block")
    texts = common.stored(texts_of(members, docs, rows), "neardup")
    return common.stored(dealt.join(texts, "node").groupBy("key", "l", "r").applyInArrow(run, "a long, b long").distinct(), "neardup")


def linked(docs: DataFrame, rows: DataFrame, least: float = SIMILARITY, stars: int = STARS, shingle: int = SHINGLE, seed: int = SEED, small: int = SMALL) -> DataFrame:
    """a, b: verified pairs of nodes, no fewer than hold each class together."""
    postings = rows.select("node", "size", F.explode("keys").alias("key"))
    company = postings.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key")
    shared = common.stored(postings.join(company, "key", "left_semi").distinct(), "neardup")
    links, tried = indexed(docs, rows, least, shingle, seed), docs.sparkSession.createDataFrame([], "a long, b long")
    # sets of such different sizes can't be similar enough
    sized = F.expr(f"least(l.size, r.size) >= {least} * greatest(l.size, r.size) - 1e-6")
    for step in range(stars + 1):
        roots = simhash.components(links).withColumnRenamed("node", "_node")
        now = shared.join(roots, shared.node == roots._node, "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
        mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("key", "n")
        now = common.stored(now.join(mixed, "key"), "neardup")
        if now.isEmpty():
            break
        if step < stars:
            left, right = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(step)).alias("h"), "node", "size", "root")).alias("c")).select("key", "c.node", "c.size", "c.root"), now
        else:
            left = right = now.filter(F.col("n") <= small)
            if not (large := now.filter(F.col("n") > small)).isEmpty():
                links = links.unionByName(in_blocks(large, docs, rows, least, shingle, seed))
        joined = left.alias("l").join(right.alias("r"), F.expr("l.key = r.key and l.root <> r.root" + (" and l.node < r.node" if step == stars else ""))).filter(sized)
        pairs = joined.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
        pairs = common.stored(pairs.join(tried, ["a", "b"], "left_anti"), "neardup")
        tried, links = tried.unionByName(pairs), links.unionByName(verified(pairs, docs, rows, least, shingle, seed))
    return links


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Every document with its node and its class's root."""
    rows = common.stored(sets(docs, shingle, seed=seed), "neardup")
    classes = simhash.components(linked(docs, rows, least, shingle=shingle, seed=seed))
    return rows.select("doc_id", "text_hash", "node").join(classes, "node", "left").select("doc_id", "text_hash", "node", F.coalesce("root", "node").alias("root"))


def first_of_each(docs: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One document of each class: that of the smallest doc_id (nulls last), with the columns it came with."""
    return simhash.first_of(docs, near_duplicates(docs, least, shingle, seed))
