"""Token files: whole texts as token ids in Simple-8b words, in ascending doc_id order.

    write(docs, path, tokenizer) -> token files and a manifest table (part, file_no, file, n_docs, n_tokens)
    read(spark, path)            -> doc_id, start, ids (unsigned 32-bit, little-endian), n_tokens

A file holds whole documents:

    magic "VLS8B001", then n_docs, n_ids, n_blocks, n_words as unsigned 64-bit numbers
    doc ids (int64), a null mask (uint8, padded to 8), ids per document (uint64)
    n_blocks + 1 offsets: the first word of each block of BLOCK ids
    the words of all blocks

Simple-8b packs as many ids as fit into the low 60 bits of a word; the high 4 bits
select how many and how wide (COUNTS, WIDTHS). Selector 15 stands for 240 zeros.
Selector 0 is an escape: the low bits count the raw 64-bit words that follow, for values of
60 bits and over. A block's last word may hold fewer values than its selector says.
Offsets let a reader decode blocks on their own, and all words of one selector
decode in one vector operation.

Rows are dealt to ranges of doc_id, sorted and tokenized there, so that files follow
each other; a partition writes files of at most FILE_IDS ids (or one document). A
task's files have names of their own and count only through the manifest: the table of the
rows that the writing tasks return, so repeated or lost tasks leave no trace. Where a file's ids start
comes from running sums within a part and over the parts. Files are written and read through pyarrow's file systems.

Edge cases: a null text is an empty text and holds the end id only; null doc_ids come
first; rows of equal doc_id follow each other in the order of their text; a special
token's string in a text is what the tokenizer's encode makes of it: that token; an empty table gives an empty
manifest and no rows; extra columns are ignored. One document's ids must fit into a task's memory.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

MAGIC = b"VLS8B001"
#: Values to a word, and bits to a value, of selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ZEROS, PAYLOAD = 240, 60
BLOCK, FILE_IDS, END_ID = 4096, 4_000_000, 2
TOKENIZER = "byte_bpe_50k.json"
MANIFEST = "part int, file_no int, file string, n_docs long, n_tokens long"


def classes(values: np.ndarray) -> np.ndarray:
    """Of each value the first of 0 and WIDTHS that holds it, as a place; 15 if none does."""
    edges = np.array([1 << w for w in (0, *WIDTHS)], np.uint64)
    small = np.searchsorted(edges, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.int8)
    out = small[np.minimum(values, np.uint64((1 << 16) - 1))]
    if (large := np.flatnonzero(values >> np.uint64(16))).size:
        out[large] = np.searchsorted(edges, values[large], "right")
    return out


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and each block's first word and the end."""
    values = np.asarray(values, np.uint64)
    n, rows = len(values), -(-len(values) // block)
    padded = np.zeros(rows * block + ZEROS, np.uint64)
    padded[:n] = values
    # past a block's end all fits
    bits = np.zeros((rows, block + ZEROS), np.int8)
    bits[:, :block] = classes(padded[: rows * block]).reshape(rows, block)
    # where many narrow values fit, fewer and wider ones do: the number of selectors that fit tells the best
    fitting = np.zeros((rows, block), np.int8)
    for k in range(len(COUNTS), -1, -1):
        # the places from which count values in a row fit, by doubling
        count, fits, size = COUNTS[k - 1] if k else ZEROS, bits <= k, 1
        while size < count:
            step = min(size, count - size)
            fits, size = fits[:, :-step] & fits[:, step:], size + step
        fitting += fits[:, :block]
        if count < block and not fits[:, : block - count].any():
            break  # nor do more and narrower values fit
    many = np.array([1, *COUNTS[::-1], ZEROS])
    starts, sizes = [], []
    for row, step in enumerate(many[fitting]):
        at, last, step, had = 0, min(block, n - row * block), step.tolist(), len(starts)
        while at < last:
            starts.append(row * block + at)
            at += step[at]
        sizes.append(len(starts) - had)
    starts = np.array(starts, np.int64)
    chosen = np.array([0, *range(len(COUNTS), 0, -1), 15])[fitting.ravel()[starts]]
    words = chosen.astype(np.uint64) << np.uint64(PAYLOAD)
    # a block's last word may reach past its end: what lies there isn't the block's
    ends = (starts // block + 1) * block
    for k in range(1, len(COUNTS) + 1):
        if len(mine := np.flatnonzero(chosen == k)):
            place, end, made = starts[mine], ends[mine], words[mine]
            beyond = bool((place + COUNTS[k - 1] > end).any())
            for j in range(COUNTS[k - 1]):
                value = padded[place + j] << np.uint64(j * WIDTHS[k - 1])
                made |= np.where(place + j < end, value, np.uint64(0)) if beyond else value
            words[mine] = made
    sizes = np.array(sizes, np.int64)
    if (raw := np.flatnonzero(chosen == 0)).size:
        out = np.insert(words, raw + 1, values[starts[raw]])
        out[raw + np.arange(len(raw))] = 1  # escape, one raw word follows
        sizes += np.bincount(starts[raw] // block, minlength=rows)
        words = out
    return words, np.concatenate(([0], np.cumsum(sizes)))


def unpack(words: np.ndarray, offsets: np.ndarray, total: int, block: int = BLOCK) -> np.ndarray:
    """The values of all blocks; offsets: each block's first word, and the end."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(PAYLOAD)).astype(np.int64)
    counts = np.array([0, *COUNTS, ZEROS])[selector]
    # a last word may hold more places than values
    out = np.zeros(total + ZEROS, np.uint64)
    if (escapes := np.flatnonzero(selector == 0)).size:
        raw, at = np.zeros(len(words), bool), -1
        for e in escapes.tolist():  # rare: values of 60 bits and over
            if e > at:
                at = e + int(words[e])
                raw[e + 1 : at + 1] = True
        counts[raw] = 1
        counts[(selector == 0) & ~raw] = 0
        selector = np.where(raw, -1, selector)
    upto = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    first = of * block + upto - upto[np.minimum(offsets[:-1], max(len(words) - 1, 0))][of] if len(words) else upto
    last = np.minimum((of + 1) * block, total)
    for k in range(1, len(COUNTS) + 1):
        if len(mine := np.flatnonzero(selector == k)):
            place, end, word = first[mine], last[mine], words[mine]
            beyond = bool((place + COUNTS[k - 1] > end).any())
            for j in range(COUNTS[k - 1]):
                value = word >> np.uint64(j * WIDTHS[k - 1]) & np.uint64((1 << WIDTHS[k - 1]) - 1)
                if beyond:
                    inside = place + j < end
                    out[place[inside] + j] = value[inside]
                else:
                    out[place + j] = value
    mine = selector == -1
    out[first[mine]] = words[mine]
    return out[:total]


def file_bytes(doc_ids: list[int | None], lengths: list[int], values: np.ndarray) -> bytes:
    # many blocks at a time, so that the work arrays stay small
    some = [pack(values[at : at + 64 * BLOCK]) for at in range(0, len(values), 64 * BLOCK)]
    offsets = np.concatenate(([0], np.cumsum([n for _, o in some for n in np.diff(o)]))).astype(np.uint64)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    parts = [
        MAGIC,
        np.array([len(doc_ids), len(values), len(offsets) - 1, int(offsets[-1])], "<u8"),
        np.array([d or 0 for d in doc_ids], "<i8"),
        nulls,
        bytes(-len(nulls) % 8),
        np.array(lengths, "<u8"),
        offsets.astype("<u8"),
        *[w.astype("<u8") for w, _ in some],
    ]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def parse(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, ids per document, all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, ids, blocks, words = np.frombuffer(data, "<u8", 4, 8).tolist()
    at = 40
    names = np.frombuffer(data, "<i8", docs, at).tolist()
    nulls = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(data, "<u8", docs, at := at + docs + -docs % 8).astype(np.int64)
    offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * docs).astype(np.int64)
    values = unpack(np.frombuffer(data, "<u8", words, at + 8 * (blocks + 1)), offsets, ids)
    return [None if z else d for d, z in zip(names, nulls.tolist())], lengths, values


class Memory:
    """Ids by 64-bit key: sorted keys, and where each key's ids stand among all ids."""

    def __init__(self):
        self.keys, self.starts, self.counts, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def of(self, places: np.ndarray) -> list[bytes]:
        return [self.ids[a : a + n].tobytes() for a, n in zip(self.starts[places].tolist(), self.counts[places].tolist())]

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """New keys, in ascending order."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = np.searchsorted(self.keys, keys)
        self.starts = np.insert(self.starts, at, len(self.ids) + np.cumsum(counts) - counts)
        self.counts, self.keys = np.insert(self.counts, at, counts), np.insert(self.keys, at, keys)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])


class Encoder:
    """Whole texts to ids, as the tokenizer's own encode gives them.

    Byte-level BPE never merges across the pieces that its pattern cuts, and the pattern always cuts before the last
    character of a run of white space that other characters follow. So a text is the sequence of its parts, cut before each
    single space or line end, and equal parts have equal ids: each is encoded once and remembered by a 64-bit
    hash of its bytes (about ``memory`` parts). The tokenizer's model takes parts of letters, which are one piece each,
    the whole tokenizer all others. A full stop or comma behind letters is a piece of its own, and so is a line end.
    Texts for tokenizers of other kinds are encoded whole.
    """

    LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ſ]+")
    #: Byte-level alphabet: printable bytes are their own characters, the others follow behind Latin-1's.
    PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
    ALPHABET = dict(zip(PLAIN, map(chr, PLAIN))) | {x: chr(256 + k) for k, x in enumerate(sorted({*range(256)}.difference(PLAIN)))}
    #: Bytes of white space, and those that may begin white space beyond ASCII.
    SPACES, LEADS = [*range(9, 14), *range(28, 33)], [0xC2, 0xE1, 0xE2, 0xE3]
    #: Bytes of text that are cut at once (more only for one text alone).
    PIECE = 1 << 21

    def __init__(self, tokenizer: str, memory: int = 2_000_000):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_file(tokenizer)
        cut, model, added = self.whole.pre_tokenizer, self.whole.model, self.whole.get_added_tokens_decoder().values()
        self.cuts = isinstance(cut, pre_tokenizers.ByteLevel) and not cut.add_prefix_space and cut.use_regex and self.whole.normalizer is None
        self.cuts = self.cuts and isinstance(model, models.BPE) and not model.dropout and not (model.continuing_subword_prefix or model.end_of_word_suffix)
        self.cuts = self.cuts and not any(t.lstrip or t.rstrip or t.single_word or any(map(str.isspace, t.content)) for t in added)
        self.added, self.model, self.limit, self.memory = [t.content for t in added], model, memory, Memory()
        self.dot, self.comma, self.line = self._whole([".", ",", "\n"])
        spaces, leads = np.isin(np.arange(256), self.SPACES), np.isin(np.arange(256), self.LEADS)
        self.before, self.after = ~spaces, ~(spaces | leads)
        rng = np.random.default_rng(1)
        self.codes, self.powers = rng.integers(0, 1 << 64, 256, np.uint64), np.ones(1, np.uint64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, x: str) -> bool:
        return x.isalpha() and (x.isascii() or self.LATIN.fullmatch(x) is not None)

    def _learn(self, keys: np.ndarray, parts: list[str], stems: np.ndarray) -> None:
        """Remember new parts. stems: the keys of the parts without their last byte."""
        letters, tokenize, known, pieces, ended, rest = self._letters, self.model.tokenize, {}, {}, [], {}
        have = self.memory.find(stems)
        for k, part in enumerate(parts):
            if letters(word := part[1:]) and part[0] in " \n":
                pieces[part if part[0] == " " else word] = None
            elif part[-1] in ".," and letters(word := part[1:-1]) and part[0] in " \n":
                if have[k] < 0:
                    pieces[part[:-1] if part[0] == " " else word] = None
                ended.append(k)
            else:
                rest[part] = None
        if pieces:
            for x, y in zip(pieces, "\x00".join(pieces).encode().decode("latin-1").translate(self.ALPHABET).split(self.ALPHABET[0])):
                known[x] = array("I", [t.id for t in tokenize(y)]).tobytes()
        rest = dict(zip(rest, self._whole(list(rest))))
        stem = dict(zip(found := [k for k in ended if have[k] >= 0], self.memory.of(have[found])))
        ids = []
        for k, part in enumerate(parts):
            if (x := rest.get(part)) is None:
                end = self.dot if part[-1] == "." else self.comma if part[-1] == "," else b""
                if (x := stem.get(k)) is None:
                    word = part[:-1] if end else part
                    x = known[word] if word[0] == " " else self.line + known[word[1:]]
                x += end
            ids.append(x)
        self.memory.add(keys, ids)

    def _piece(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number by text, of texts that end at places of data; none is empty."""
        cut = np.zeros(len(data), bool)
        cut[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & self.before[data[:-2]] & self.after[data[2:]]
        cut[ends - 1] = False
        cut[0] = cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(starts, append=len(data))
        if len(self.powers) < sizes.max():
            self.powers = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        terms = self.codes[data] * self.powers[np.arange(len(data)) - np.repeat(starts, sizes)]
        keys, first, of = np.unique(np.add.reduceat(terms, starts), return_index=True, return_inverse=True)
        places = self.memory.find(keys)
        if (new := np.flatnonzero(places < 0)).size:
            if len(self.memory.keys) + len(new) > self.limit:
                self.memory, new = Memory(), np.arange(len(keys))
            at = starts[first[new]]
            to = at + sizes[first[new]]
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(at.tolist(), to.tolist())], keys[new] - terms[to - 1])
            places = self.memory.find(keys)
        at, counts = self.memory.starts[places][of], self.memory.counts[places][of]
        upto = np.cumsum(counts)
        ids = self.memory.ids[np.repeat(at - upto + counts, counts) + np.arange(upto[-1])]
        last = upto[np.searchsorted(starts, ends) - 1]
        return ids, np.diff(last, prepend=0)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """32-bit ids of all texts (null: empty), and their number by text."""
        if not self.cuts:
            each = self._whole([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data, full = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.flatnonzero(np.diff(offsets))
        lengths, out, low = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)], 0
        while low < len(full):
            begin = offsets[full[low]]
            high = max(low + 1, int(np.searchsorted(offsets[full + 1], begin + self.PIECE, "right")))
            ends = offsets[full[low:high] + 1]
            ids, lengths[full[low:high]] = self._piece(data[begin : ends[-1]], ends - begin)
            out.append(ids)
            low = high
        return np.concatenate(out), lengths

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """32-bit little-endian ids of each text."""
        ids, lengths = self.encoded(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids.astype("<u4"), np.cumsum(lengths)[:-1])] if texts else []


@lru_cache(1)
def encoder(tokenizer: str) -> Encoder:
    """One for all tasks of a Python worker: reading the vocabulary takes over a second."""
    return Encoder(tokenizer)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Token files and their manifest under path, a URI that every executor can write to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        part, attempt, made = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        names, lengths, values, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            name = f"part-{part:06d}-{made:04d}-{attempt}.s8b"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(file_bytes(names, lengths, np.concatenate(values)))
            made += 1
            return pa.RecordBatch.from_pydict({"part": [part], "file_no": [made], "file": [name], "n_docs": [len(names)], "n_tokens": [held]}, pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        store.create_dir(root, recursive=True)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pieces = (batch.slice(low, 4000) for batch in batches for low in range(0, batch.num_rows, 4000))
        for batch in pieces:
            ids, many = encoder(tokenizer).encoded(batch.column("text"))
            ends = np.cumsum(many)
            ids, many = np.insert(ids, ends, end_id), many + 1
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), many.tolist()):
                if names and held + n > file_ids:
                    yield flush()
                    names, lengths, values, held = [], [], [], 0
                names.append(doc_id)
                lengths.append(n)
                values.append(ids[at : at + n])
                held += n
                at += n
        if names:
            yield flush()

    # texts are dealt before they become ids: the sampling of ranges then reads doc_ids alone
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST)
    # one row for each file: the tasks that count are those whose rows arrive in the table
    files.write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, file_no, file, n_docs, n_tokens, start: one row for each file."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = "rows between unbounded preceding and 1 preceding"
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("held")).selectExpr("part", f"coalesce(sum(held) over (order by part {before}), 0) as ahead")
    inside = files.selectExpr("*", f"coalesce(sum(n_tokens) over (partition by part order by file_no {before}), 0) as inside")
    return inside.join(parts, "part").selectExpr("part", "file_no", "file", "n_docs", "n_tokens", "cast(ahead + inside as bigint) as start")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every document in the files that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(f"{root}/{name}") as f:
                    docs, lengths, values = parse(f.read())
                ends = np.cumsum(lengths)
                raw = pa.py_buffer(values.astype("<u4"))
                offsets = pa.array(np.concatenate(([0], ends)) * 4, pa.int64())
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(docs), [None, offsets.buffers()[1], raw]).cast(pa.binary())
                made = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - lengths + first, pa.int64()), pa.array(lengths), ids], names=["doc_id", "start", "n_tokens", "ids"])
                yield from (made.slice(low, 1000) for low in range(0, made.num_rows, 1000))

    files = manifest(spark, path).select("file", "start")
    # a file or, of very many, a few to a task
    dealt = files.repartition(max(1, min(files.count(), 20_000)))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
