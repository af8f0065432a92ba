"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

    fingerprints(docs)  -> doc_id, text_hash, fp (64 bits, signed)
    links(fps)          -> a, b: pairs of distinct fingerprints that hold every class together
    components(edges)   -> node, root (the smallest fingerprint of its class)
    near_duplicates(docs) -> doc_id, text_hash, fp, component_id, root

Two 64-bit fingerprints that differ in at most d bits differ in at most d of
their 8 bytes, so at least 8 - d positional bytes match: the guaranteed minimum
of the count filter. Postings of one positional byte hold 1/256 of all
fingerprints, and their pairs grow with the square of the corpus; so a posting is kept for several positional
bytes together. Of the matching bytes all but one, at least, stand in the first seven positions, so a posting for each
choice of (minimum - 1) of these seven (for d = 4: 35 choices of three bytes) loses no pair. For every pair of a posting
the positional bytes that match are tallied, pairs below the minimum go, and those that
reach it are verified bit by bit. A pair is taken up only in the first of the postings that it shares.

Postings stream through sorted partitions and are compared in blocks. A posting
returns a spanning forest of its links (no more rows than members), never its
pairs. Postings of more than BLOCK members are written out in blocks as they stream and dealt over tasks, one for each pair
of blocks, so that no task holds or compares a long posting alone.

Classes come from alternating large-star and small-star steps on the links, each
stored in the shared folder, so no link or class ever reaches the driver.

Edge cases: null or wordless text has fingerprint 0 and links like any other;
fewer words than a shingle: the whole sequence is the shingle; equal rows share
a class; null doc_id is a row of its class but never its id while another row has one (component_id is
null only if all are); an empty table gives no rows; texts are read whole, with the bits of 65,536 shingles at once;
extra columns are ignored. Of rows alike in id and text one is kept, the same on each run (by the hash of all its columns).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Links that one task can join: with no more in all, no hub needs spreading.
ROOM = 1_000_000
#: Members of a posting that one task compares; longer postings go to one task for each pair of blocks.
BLOCK = 4096


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):  # long texts: a bounded number of bits at once
        ones += np.unpackbits(hashes[at : at + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half the shingles' XXH64."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n)
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def choices(distance: int = DISTANCE) -> list[tuple[int, ...]]:
    """The byte positions that each kind of posting holds."""
    least = 8 - distance
    return list(combinations(range(7), least - 1) if least > 1 else combinations(range(8), least))


def postings(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """choice, key, fp for every choice of byte positions; the choice's number and its bytes make the key."""
    masks = [sum(0xFF << 8 * p for p in at) for at in choices(distance)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                keys = np.concatenate([part & np.uint64(m) for m in masks])
                choice = np.repeat(np.arange(len(masks), dtype=np.int16), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(choice), pa.array(keys.view(np.int64)), pa.array(np.tile(part, len(masks)).view(np.int64))], names=["choice", "key", "fp"])

    return fps.select("fp").mapInArrow(run, "choice short, key long, fp long")


def tally(differ: np.ndarray) -> np.ndarray:
    """How many of the 8 positional bytes match, from the bits in which two fingerprints differ."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    some = ((differ & low) + low | differ) & ~low  # the high bit of each byte that isn't zero
    return 8 - np.bitwise_count(some).astype(np.int8)


def near(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then the bits of the pairs that pass it."""
    differ = left ^ right
    found = tally(differ) >= 8 - distance
    found[found] = np.bitwise_count(differ[found]) <= distance
    return found


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between places a and b, enough to hold the same places together."""
    root: dict[int, int] = {}
    keep = []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        if (i := find(i)) != (j := find(j)):
            root[max(i, j)] = min(i, j)
            keep.append(k)
    return a[keep], b[keep]


def _linked(left: np.ndarray, right: np.ndarray, choice: int, distance: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of a posting: tally of matching positional bytes, verified bits, first shared posting."""
    mine, found = np.isin(np.arange(8), choices(distance)[choice]), []
    step = max(1, (1 << 20) // len(right))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        i, j = np.nonzero(near(part[:, None], right[None, :], distance))
        if same:
            i, j = i[i + at < j], j[i + at < j]
        if len(i):
            match = (part[i] ^ right[j])[:, None].view(np.uint8).reshape(-1, 8) == 0
            # those of this choice are the first that match
            first = (match & (np.cumsum(match, 1) <= mine.sum()) == mine).all(1)
            i, j = _forest(i[first] + at, j[first] + (0 if same else len(left)))
            found.append((i, j))
    if not found:
        return left[:0], right[:0]
    i, j = _forest(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))
    both = left if same else np.concatenate([left, right])
    return both[i], both[j]


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints, no fewer than hold each class together."""
    edge = "a long, b long, choice short, key long, block int"

    def out(a, b, choice=None, key=None, blocks=None) -> pa.RecordBatch:
        n = len(a)
        rest = [pa.nulls(n, t) for t in (pa.int16(), pa.int64(), pa.int32())] if choice is None else [pa.array(np.full(n, choice, np.int16)), pa.array(np.full(n, key, np.int64)), pa.array(blocks.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *rest], names=["a", "b", "choice", "key", "block"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings arrive one after another; the last of a batch waits for the next batch, in blocks if it is long."""
        held, open_, written = [np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.uint64)], None, 0

        def in_blocks(choice, key, fp, first: int) -> pa.RecordBatch:
            return out(fp, fp, choice[0], key[0], first + np.arange(len(fp)) // block)

        def done(choice, key, fp) -> Iterator[pa.RecordBatch]:
            cut = np.concatenate(([0], np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1, [len(fp)]))
            n = np.diff(cut)
            pairs = cut[:-1][n == 2]
            # most postings with company have two members: all of them at once
            close = near(fp[pairs], fp[pairs + 1], distance)
            made = [(fp[pairs][close], fp[pairs + 1][close])]
            for at in np.flatnonzero(n > 2):
                rows = slice(cut[at], cut[at + 1])
                if n[at] > block:
                    yield in_blocks(choice[rows], key[rows], fp[rows], 0)
                else:
                    members = np.sort(fp[rows])
                    made.append(_linked(members, members, choice[cut[at]], distance, True))
            yield out(np.concatenate([x for x, _ in made]), np.concatenate([x for _, x in made]))

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "key", "fp")]
            held = [np.concatenate([h, x.view(h.dtype)]) for h, x in zip(held, now)]
            if not len(held[0]):
                continue
            if open_ is not None:  # a long posting goes on
                other = np.flatnonzero((held[0] != open_[0]) | (held[1] != open_[1]))
                upto = int(other[0]) if len(other) else len(held[0]) // block * block
                if upto:
                    yield in_blocks(*[x[:upto] for x in held], written)
                    written += upto // block
                    held = [x[upto:] for x in held]
                if not len(other):
                    continue
                open_ = None
            ends = int(np.flatnonzero((held[0] == held[0][-1]) & (held[1] == held[1][-1]))[0])
            if ends:
                yield from done(*[x[:ends] for x in held])
                held = [x[ends:] for x in held]
            if len(held[0]) > block:
                open_, written = (held[0][0], held[1][0]), len(held[0]) // block
                yield in_blocks(*[x[: written * block] for x in held], 0)
                held = [x[written * block :] for x in held]
        if len(held[0]):
            yield from done(*held) if open_ is None else [in_blocks(*held, written)]

    def long(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        left, right, choice = key[2].as_py(), key[3].as_py(), key[0].as_py()
        fp, of = table.column("fp").to_numpy().view(np.uint64), table.column("block").to_numpy()
        a, b = _linked(np.sort(fp[of == left]), np.sort(fp[of == right]), choice, distance, left == right)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sorted_ = postings(fps, distance).repartition("choice", "key").sortWithinPartitions("choice", "key")
    found = common.stored(sorted_.mapInArrow(short, edge), "simhash")
    more = found.filter("key is not null").select("choice", "key", "block", F.col("a").alias("fp"))
    blocks = more.groupBy("choice", "key").agg(F.max("block").alias("last"))
    pairs = F.expr("transform(sequence(0, last), other -> struct(least(block, other) as l, greatest(block, other) as r))")
    dealt = more.join(blocks, ["choice", "key"]).select("choice", "key", "block", "fp", F.explode(pairs).alias("p")).select("choice", "key", "p.l", "p.r", "block", "fp")
    far = dealt.groupBy("choice", "key", "l", "r").applyInArrow(long, "a long, b long")
    return found.filter("key is null").select("a", "b").unionByName(far).distinct()


def components(edges: DataFrame, room: int = ROOM) -> DataFrame:
    """node, root: the smallest node that can be reached, for every node of an edge."""
    spark = edges.sparkSession
    at = common.new_path(spark, "components")
    edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").filter("u <> v").distinct().write.parquet(f"{at}/0")
    step, seen = 0, None
    while True:
        now = spark.read.schema("u long, v long").parquet(f"{at}/{step}")
        # large star: every larger neighbour goes to the smallest of its neighbourhood
        both, edges = now.unionByName(now.selectExpr("v as u", "u as v")), now.count()
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        joined = lambda rows: common.by_key(rows, least, ["u"], 2 * edges) if edges > room else rows.join(least.drop("n"), "u")  # noqa: E731, B023
        large = joined(both.filter("v > u")).selectExpr("v as u", "m as v").distinct()
        # small star: a node's smaller neighbours, and it, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = joined(large).selectExpr("if(v = m, u, v) as u", "m as v").filter("u <> v").distinct()
        step += 1
        small.write.parquet(f"{at}/{step}")
        common.remove(spark, f"{at}/{step - 1}")
        after = spark.read.schema("u long, v long").parquet(f"{at}/{step}")
        state = after.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("coalesce(sum(cast(hash(u, v) as bigint)), 0)")).first()
        if state == seen:
            return after.selectExpr("u as node", "v as root").unionByName(after.selectExpr("v as node", "v as root").distinct())
        seen = state


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """Every document with its fingerprint, the smallest doc_id that it reaches and its class's root."""
    rows = common.stored(fingerprints(docs, shingle, seed), "simhash")
    fps = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash")
    classes = components(links(fps, distance))
    named = common.stored(fps.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n"), "simhash")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = common.stored(common.by_key(named.select("fp", "root", F.col("n").alias("rows")), ids, ["root"], named.count()).withColumnRenamed("rows", "n"), "simhash")
    return common.by_key(rows, named, ["fp"], rows.count())


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """One document of each class: that of the smallest doc_id (nulls last), with the columns it came with."""
    return first_of(docs, near_duplicates(docs, shingle, distance, seed))


def first_of(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """The same for classes found elsewhere: doc_id, text_hash, root of every document."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    chosen = classed.groupBy("root").agg(F.min(order).alias("o")).select("o.doc_id", "o.text_hash")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.select("row", F.col("row.doc_id").alias("_id"), F.xxhash64("row.text").alias("_text"))
    held = rows.join(chosen, rows._id.eqNullSafe(chosen.doc_id) & (rows._text == chosen.text_hash), "left_semi")
    alike = F.xxhash64(*[F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind])
    return held.groupBy("_id", "_text").agg(F.min_by("row", alike).alias("row")).select("row.*")
