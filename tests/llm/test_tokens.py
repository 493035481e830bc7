"""Token counts, token-id files, byte-level BPE: held against the libraries, and exact round trips."""

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import AWKWARD, awkward, clashing, empty, got

from tidebar.llm import byte_bpe, simple8b, token_counts
from tidebar.llm.common import new_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def unigram(vocabulary, byte_fallback=True):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_library(spark):
    t = unigram(token_counts.vocabulary(PIECES))
    want = sorted(((d, len(t.encode(x or "").ids)) for d, x in AWKWARD), key=lambda r: (r[0] is not None, r))
    assert got(token_counts.count_tokens(awkward(spark), PIECES), "doc_id", "n_tokens") == want
    assert got(token_counts.count_tokens(clashing(spark), PIECES), "doc_id", "n_tokens") == want
    assert token_counts.count_tokens(empty(spark), PIECES).count() == 0


TIED = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("aba", -3.0), ("c", -9.0)] + [(f"<0x{i:02X}>", -20.0) for i in range(256)]


@settings(max_examples=200, deadline=None)
@given(st.text("ab cdé", max_size=14))
def test_ties_go_as_in_the_library(text):
    for fallback in (True, False):
        assert token_counts.CountOnlyViterbi(TIED, fallback).count(text) == len(unigram(TIED, fallback).encode(text).ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 150))
def test_simple8b_round_trip(values, times):
    v = np.repeat(np.array(values, np.uint64), times if len(values) < 5 else 1)
    assert (simple8b.unpack(simple8b.pack(v)) == v).all()


def test_simple8b_is_dense():
    assert len(simple8b.pack(np.ones(60, np.uint64))) == 1
    assert len(simple8b.pack(np.full(100_000, 7, np.uint64))) == 1
    assert len(simple8b.pack(np.full(6, 1023, np.uint64))) == 1
    assert len(simple8b.pack(np.array([2**60], np.uint64))) == 2


@pytest.mark.parametrize("block_ids", [1, 1 << 18])
def test_token_id_files(spark, block_ids):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(WORD_BPE), 0, []
    ids = [(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for d, x in AWKWARD]
    path = new_path(spark, "ids")
    simple8b.write_token_ids(awkward(spark).repartition(3), path, WORD_BPE, block_ids=block_ids)
    found = sorted((tuple(r) for r in simple8b.token_id_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, *sorted(d for d, _ in AWKWARD if d is not None)]
    for d, s, n, _ in found:
        assert s == start
        start += n
    want = sorted((str(d), len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    assert sorted((str(r[0]), r[2], r[3]) for r in found) == want
    simple8b.write_token_ids(empty(spark), path + "-none", WORD_BPE)
    assert simple8b.token_id_digests(spark, path + "-none").count() == 0


def test_token_ids_with_thousands_of_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        path = new_path(spark, "ids")
        simple8b.write_token_ids(spark.createDataFrame([(i, f"word {i}") for i in range(300)], "doc_id long, text string"), path, WORD_BPE)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        found = sorted((tuple(r) for r in simple8b.token_id_digests(spark, path).collect()), key=lambda r: r[1])
        assert [r[0] for r in found] == list(range(300))
        assert simple8b.read_token_ids(spark, path).select("shard").distinct().count() > 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_token_ids_of_every_letter_before_marks():
    from tokenizers import Tokenizer

    t, enc = Tokenizer.from_file(WORD_BPE), simple8b.WordEncoder(WORD_BPE)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    letters = [c for c in letters if ord(c) < 0x3400 or ord(c) % 97 == 0 or 0xA000 <= ord(c) < 0xAC00 or 0xF900 <= ord(c) < 0x11000]
    texts = [form.format(c) for c in letters for form in ("{0}.", "a{0}, b", "{0}b{0}'s", "x{0}\u0301!?")]
    for i in range(0, len(texts), 20_000):
        some = texts[i : i + 20_000]
        got_ids, want = enc.encode(pa.array(some)), t.encode_batch_fast(some, add_special_tokens=False)
        assert [x for x, g, w in zip(some, got_ids, want, strict=True) if g.tolist() != w.ids] == []


WORD_ENCODER = simple8b.WordEncoder(WORD_BPE, limit=200)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(max_size=30) | st.text("aİक़é.,'s\n 1İ़\u0307", max_size=30), max_size=6))
def test_token_ids_of_any_text(texts):
    from tokenizers import Tokenizer

    t = WORD_ENCODER.tokenizer
    assert isinstance(t, Tokenizer)
    found = WORD_ENCODER.encode(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert [x.tolist() for x in found] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(BYTE_BPE), special_tokens={})


def test_byte_bpe_equals_the_library(spark):
    e, want = encoding(), []
    for d, x in AWKWARD:
        ids = np.array(e.encode_ordinary(x or ""), "<u4").tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    want.sort(key=lambda r: (r[0] is not None, r))
    for docs in (awkward(spark), clashing(spark)):
        assert got(byte_bpe.bpe_digests(docs, BYTE_BPE, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert byte_bpe.bpe_digests(empty(spark), BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(awkward(spark), BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())


BPE = byte_bpe.TextBpe(BYTE_BPE, public_tokenizers.PATTERN)
LIBRARY = encoding()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab c\n'", max_size=60))
def test_byte_bpe_any_text(text):
    assert np.frombuffer(BPE.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)).decode() == text


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.binary(max_size=10), st.integers(0, 40), st.integers(0, 5))
def test_prefix_states_append_and_edit(piece, more, at, drop):
    bpe = BPE.bpe
    last = bpe.extend(piece, [-1])
    joined, state = bpe.append(piece, last, more)
    assert state == bpe.extend(joined, [-1])
    changed, state = bpe.edit(piece, last, min(at, len(piece)), more, drop)
    assert state == bpe.extend(changed, [-1]) and len(last) == len(piece) + 1


def test_an_edit_costs_its_neighbourhood():
    import time

    bpe = BPE.bpe
    piece = ("ein langes wort ohne ende and some other words " * 4000).replace(" ", "").encode()
    last = bpe.extend(piece, [-1])
    assert len(piece) > 150_000
    for at, new, drop in ((5, b"xyz", 2), (90_000, b"", 7), (len(piece) - 3, b"zz", 1), (len(piece), b"tail", 4)):
        whole = bpe.extend(piece[:at] + new + piece[at + drop :], [-1])
        took = []
        for _ in range(5):
            began = time.perf_counter()
            _, state = bpe.edit(piece, last, at, new, drop)
            took.append(time.perf_counter() - began)
        assert state == whole and min(took) < 0.03, took  # a whole encoding takes ten times as long
