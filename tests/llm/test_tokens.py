import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from vaultlens.llm import common, tokens

P = pytest.importorskip("public_tokenizers")


@given(st.lists(st.one_of(st.just(0), st.integers(0, 9), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
@settings(max_examples=60, deadline=None)
def test_round_trip(values):
    values = np.array(values, np.uint64)
    words, offsets = tokens.pack(values, 64)
    assert (tokens.unpack(words, offsets, len(values), 64) == values).all()


def test_words_hold_what_selectors_say():
    words, _ = tokens.pack(np.ones(120, np.uint64))
    assert [int(w) >> 60 for w in words] == [1, 1]
    words, _ = tokens.pack(np.zeros(500, np.uint64))
    assert [int(w) >> 60 for w in words][:2] == [15, 15]
    words, offsets = tokens.pack(np.array([1 << 63], np.uint64))
    assert [int(w) for w in words] == [1, 1 << 63] and offsets.tolist() == [0, 2]


def test_blocks_decode_alone():
    values = np.random.default_rng(1).integers(0, 50_000, 10_000).astype(np.uint64)
    words, offsets = tokens.pack(values)
    part = words[offsets[1] : offsets[2]]
    assert (tokens.unpack(part, np.array([0, len(part)]), 4096) == values[4096:8192]).all()


def plain(name, texts):
    """The ids that an untouched tokenizer gives."""
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(P.path(name))
    return [np.array(untouched.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


PIECES = [*"ab. ,\n\t'1é日 \x1cN", "<|endoftext|>", "  ", " word", "word, "]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoder_is_the_tokenizer(texts):
    assert tokens.encoder(P.path(tokens.TOKENIZER)).encode(texts) == plain(tokens.TOKENIZER, texts)


def test_special_tokens_are_the_librarys():
    texts = ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b c", "x <|endoftext |> y"]
    assert tokens.Encoder(P.path(tokens.TOKENIZER)).encode(texts) == plain(tokens.TOKENIZER, texts)


def test_forgetting_changes_nothing():
    encoder = tokens.Encoder(P.path(tokens.TOKENIZER), memory=20)
    texts = [f"word{k} some, other words.\nAnd {k} more" for k in range(40)]
    assert [x for t in texts for x in encoder.encode([t])] == plain(tokens.TOKENIZER, texts)


def test_other_tokenizers_encode_whole():
    encoder = tokens.Encoder(P.path("word_bpe_49k.json"))
    assert not encoder.cuts and encoder.encode(["Hello there, you"]) == plain("word_bpe_49k.json", ["Hello there, you"])


def test_files_hold_every_document(spark, crowded):
    path = common.new_path(spark, "tokens")
    tokens.write(crowded, path, P.path(tokens.TOKENIZER), file_ids=3000)
    rows = sorted(tokens.read(spark, path).collect(), key=lambda r: (r.start, r.n_tokens))
    encoder = tokens.Encoder(P.path(tokens.TOKENIZER)).whole
    wanted = sorted(crowded.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
    at = 0
    for row, want in zip(rows, wanted, strict=True):
        ids = np.array([*encoder.encode(want.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (row.doc_id, row.start, row.n_tokens) == (want.doc_id, at, len(ids))
        assert zlib.crc32(row.ids) == zlib.crc32(ids.tobytes())
        at += len(ids)


def test_empty(spark, nothing):
    path = common.new_path(spark, "tokens")
    tokens.write(nothing, path, P.path(tokens.TOKENIZER))
    assert tokens.read(spark, path).count() == 0
