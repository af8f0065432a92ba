"""Benchmark passages in documents by edit distance: CGK embeddings, bit-sampling LSH, exact verification.

Texts become words (letters, digits and underscores, lower case). An item of L words is
contained in a document if some stretch of the document is within
floor((1 - similarity) * L) word edits of it.

The CGK random walk reads a string through a pointer that each step's random
function of the symbol under it moves on or leaves, so that two strings of small
edit distance give sequences of small Hamming distance. A table samples SAMPLE
steps of one walk; items and windows whose samples are equal are candidates.
For each item length walks are added until, of TRIALS copies of its items with as many random
edits as allowed, the target recall is found (``Index.recalls``); after each WALKS walks samples become one step
shorter, down to one, so that the target is reached for long items too. Every window of an item's length takes part, but for those that
start with a word that no item of that length has, or hold too few of those words to be within the distance,
which loses nothing.
Candidates are verified by exact semi-global edit distance.

Items are sent to executors in blocks of at most BLOCK_WORDS words; a larger
benchmark makes more passes over the documents. Documents never move or meet.

Edge cases: null or wordless texts and items contain and match nothing; an item
under five words allows no edits; equal items and equal rows each give
their own rows; texts are scanned whole, in pieces of bounded memory only by batch; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORDS = re.compile(r"\w+")
SIMILARITY, RECALL, SAMPLE, TABLES, WALKS, TRIALS = 0.8, 0.97, 3, 4, 16, 100
BLOCK_WORDS, BATCH_WORDS, SEED = 2_000_000, 1 << 22, 17


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


class Index:
    """The items' words, walks and tables."""

    def __init__(self, items: list[tuple[int, str | None]], similarity: float = SIMILARITY, recall: float = RECALL, seed: int = SEED):
        split = [(i, w) for i, t in items if (w := words(t))]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in split for w in ws), 1)}
        self.items = [(i, np.array([self.vocabulary[w] for w in ws], np.int64)) for i, ws in split]
        self.similarity = similarity
        self.lengths = sorted({len(w) for _, w in self.items})
        self.longest = max(self.lengths, default=0)
        self.seed, self.walks = seed, []
        self.recalls: dict[int, float] = {}
        #: Of each length the tables of its walks: sorted keys and items.
        self.tables: dict[int, list[list[tuple[np.ndarray, np.ndarray]]]] = {}
        self.known: dict[int, np.ndarray] = {}
        for n in self.lengths:
            mine = np.array([k for k, (_, w) in enumerate(self.items) if len(w) == n])
            joined = np.concatenate([*[self.items[k][1] for k in mine], np.zeros(2 * n, np.int64)])
            self.known[n] = np.isin(np.arange(len(self.vocabulary) + 1), joined[: -2 * n])
            self.known[n][0] = False
            self._add_tables(n, mine, joined, recall)
        self.recall = min(self.recalls.values(), default=1.0)

    def _walk(self, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        while k >= len(self.walks):
            rng = np.random.default_rng((self.seed, at := len(self.walks)))
            factors = rng.integers(1, 1 << 62, 2 * self.longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self.walks.append((factors, [np.sort(rng.random(max(1, SAMPLE - at // WALKS))) for _ in range(TABLES)]))
        return self.walks[k]

    def _add_tables(self, n: int, mine: np.ndarray, joined: np.ndarray, recall: float) -> None:
        rng, edits = np.random.default_rng((self.seed, n)), self.edits(n)
        trial = np.resize(rng.permutation(len(mine)), TRIALS)
        copies = np.concatenate([self._edited(self.items[mine[k]][1], edits, rng) for k in trial] + [np.zeros(2 * n, np.int64)])
        # a copy can be found from its first words, as in a document
        at = (np.arange(TRIALS) * 2 * n)[:, None] + np.arange(edits + 1)
        of, place = np.nonzero(self.known[n][copies[at]])
        starts, found, made = at[of, place], np.zeros(TRIALS, bool), []
        while not made or found.mean() < recall:
            self._walk(walk := len(made))
            keys = self.keys(joined, np.arange(len(mine)) * n, n, range(walk, walk + 1))[0]
            orders = np.argsort(keys, axis=1, kind="stable")
            made.append([(keys[table][order], mine[order]) for table, order in enumerate(orders)])
            hit = (self.keys(copies, starts, n, range(walk, walk + 1))[0] == keys[:, trial[of]]).any(0)
            found[of[hit]] = True
        self.tables[n], self.recalls[n] = made, float(found.mean())

    def edits(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)

    @staticmethod
    def _edited(w: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
        out = w.tolist()
        for _ in range(edits):
            at, kind = int(rng.integers(0, max(1, len(out)))), rng.integers(0, 3)
            out[at : at + (kind != 2)] = [] if kind == 0 else [0]
        return np.array((out + [0] * 2 * len(w))[: 2 * len(w)], np.int64)

    def keys(self, ids: np.ndarray, starts: np.ndarray, n: int, walks: range) -> np.ndarray:
        """Key by walk, table and start of the n words from each start. ids go on for 2 n words behind the last start."""
        steps = {}
        for row, walk in enumerate(walks):
            for table, sample in enumerate(self.walks[walk][1]):
                for step in np.unique((sample * 1.6 * n).astype(int)).tolist():
                    steps.setdefault(step, []).append((row, table))
        factors = np.stack([self.walks[walk][0] for walk in walks])
        out = np.full((len(walks), TABLES, len(starts)), n, np.uint64)
        at, ends = np.repeat(starts[None, :], len(walks), 0), starts + n
        for step in range(max(steps) + 1):
            symbol = (ids[at] * (at < ends)).view(np.uint64)
            for row, table in steps.get(step, ()):
                out[row, table] = (out[row, table] ^ symbol[row]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)
            at += ((symbol + np.uint64(1)) * factors[:, step, None] >> np.uint64(40) & np.uint64(1)).view(np.int64)
        return out

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the window starts and items that share a table's key."""
        for n in self.lengths:
            known = self.known[n][ids]
            upto = np.zeros(len(ids) + n, np.int32)
            np.cumsum(known, out=upto[n:])
            # a match has at least n - edits words of items of this length among the n from its first such word
            held = np.concatenate((upto[2 * n - 1 :], np.full(min(n - 1, len(ids)), upto[-1])))[: len(ids)] - upto[n - 1 : -1]
            starts = np.flatnonzero((held >= n - self.edits(n)) & known)
            pairs = []
            keys = self.keys(ids, starts, n, range(len(self.tables[n]))) if len(starts) else ()
            for walk in range(len(keys)):
                for table in range(TABLES):
                    have, item = self.tables[n][walk][table]
                    left, right = np.searchsorted(have, keys[walk, table]), np.searchsorted(have, keys[walk, table], "right")
                    hit = np.flatnonzero(left < right)
                    many = (right - left)[hit]
                    if len(hit):
                        places = np.repeat(left[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        pairs.append(np.stack([np.repeat(starts[hit], many), item[places]], 1))
            if pairs:
                start, item = np.unique(np.concatenate(pairs), axis=0).T
                yield n, start, item

    def distances(self, ids: np.ndarray, n: int, starts: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Fewest word edits between each item and any stretch of the words around its window."""
        edits = self.edits(n)
        segments = ids[starts[:, None] + np.arange(-edits, n + edits)]
        symbols = np.stack([self.items[k][1] for k in items])
        steps = np.arange(segments.shape[1] + 1, dtype=np.int32)
        above = np.zeros((len(starts), len(steps)), np.int32)
        for k in range(n):
            now = np.full_like(above, k + 1)
            now[:, 1:] = np.minimum(above[:, 1:] + 1, above[:, :-1] + (segments != symbols[:, k, None]))
            above = np.minimum.accumulate(now - steps, axis=1) + steps
        return above.min(1)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text's place, item id, first word's place, edits), the best of each text and item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        get, pad = self.vocabulary.get, np.zeros(self.longest + self.edits(self.longest) + 1, np.int64)
        pieces, starts, total = [pad], [], len(pad)

        def scan() -> None:
            ids, first = np.concatenate([*pieces, np.zeros(2 * self.longest, np.int64)]), np.array([s for _, s in starts])
            for n, at, items in self.candidates(ids):
                for low in range(0, len(at), 4096):
                    some, which = at[low : low + 4096], items[low : low + 4096]
                    d = self.distances(ids, n, some, which)
                    for k in np.flatnonzero(d <= self.edits(n)).tolist():
                        row = int(np.searchsorted(first, some[k], "right")) - 1
                        key, now = (starts[row][0], int(which[k])), (int(d[k]), int(some[k] - first[row]))
                        best[key] = min(best.get(key, now), now)

        for place, text in enumerate(texts):
            if ws := words(text):
                starts.append((place, total))
                pieces += [np.array([get(w, 0) for w in ws], np.int64), pad]
                total += len(ws) + len(pad)
            if total > BATCH_WORDS:
                scan()
                pieces, starts, total = [pad], [], len(pad)
        if starts:
            scan()
        return [(place, self.items[k][0], at, d) for (place, k), (d, at) in best.items()]


def blocks(benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """Indexes of at most block_words words of items each (more only for one item alone)."""
    held, size = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        n = len(words(text))
        if held and size + n > block_words:
            yield Index(held, similarity, recall)
            held, size = [], 0
        if n:
            held.append((item_id, text))
            size += n
    if held:
        yield Index(held, similarity, recall)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, word_at, edits: one row for each document row and item that it contains."""
    spark, name = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {name}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, word_at long, edits long"
    out = None
    for index in blocks(benchmark, **options):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = sent.value.find(batch.column("text").to_pylist())
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)]], names=["doc_id", "item_id", "word_at", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with the columns they came with; one pass for each block of items, no shuffle."""
    for index in blocks(benchmark, **options):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fine = np.ones(batch.num_rows, bool)
                fine[[f[0] for f in sent.value.find(batch.column(batch.schema.names.index("text")).to_pylist())]] = False
                yield batch.filter(pa.array(fine))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
