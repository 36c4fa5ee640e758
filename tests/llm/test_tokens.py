"""Token files: round trips and codes. Token counts: the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlake.llm.encode import Encoder
from flowlake.llm.queries import op4_token_files, op8_token_counts
from flowlake.llm.token_counts import token_counts
from flowlake.llm.token_ids import EVERY, canonical, code_lengths, decode_table, pack, token_files, unpack
from helpers_llm import brute_counts, huffman_cost, clashing, given, table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@cases(st.lists(st.text(alphabet=st.sampled_from(" \n\t\x1c\x85\xa0　ab'sI.,1é👍<|endoftext|>"), max_size=60), min_size=1, max_size=4))
def test_pieces_give_the_ids_of_the_whole(tokenizer, encoder, texts):
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)]
    assert got == [ids_of(tokenizer, t) for t in texts]


def test_other_vocabularies():
    texts = ["", "A b  c", " x <|endoftext|> y", "ÉÈ é\n\n z", "a " * 500]
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Encoder(path)
    t = Tokenizer.from_file(path)
    assert [np.frombuffer(x, other.dtype).tolist() for x in other.encode(texts)] == [ids_of(t, x) for x in texts]


def expected(tokenizer, rows):
    out, at = [], 0
    for d, text in rows:
        ids = ids_of(tokenizer, text) + [0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_round_trip(spark, sf_dir, tokenizer):
    rows = sorted((d, r[1]) for d, r in given(sf_dir).items())
    got = sorted(tuple(r) for r in op4_token_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(tokenizer, rows)


def test_token_files_odd_rows(spark, tokenizer):
    long = "word " * 60_000
    rows = [(7, "b c"), (3, None), (None, "null id"), (5, ""), (4, long), (-2, " <|endoftext|>"), (7, "b c"), (7, "a")]
    got = token_files(clashing(table(spark, rows)), PATH).collect()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, -2, 3, 4, 5, 7, 7, 7]
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    want = {(d, n, c) for d, _, n, c in expected(tokenizer, rows)}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    assert token_files(table(spark, []), PATH).collect() == []


def test_codes():
    rng = random.Random(2)
    for n in (1, 2, 3, 10, 300):
        counts = {i * 3: rng.choice([1, 2, 5, 1000, 10**6]) for i in range(n)}
        lengths = code_lengths(counts, 12)
        assert max(lengths.values()) <= 12
        assert sum(2.0 ** -b for b in lengths.values()) <= 1
        assert code_lengths(counts, 40) and (n == 1 or sum(counts[i] * b for i, b in code_lengths(counts, 40).items()) == huffman_cost(counts))
        code, bits = canonical(lengths)
        ids = np.array(rng.choices(list(counts), k=5000), np.int64)
        sizes = np.array([1, 700, 3, 4000, 296])
        data, first, at = pack(ids, sizes, code, bits)
        starts, counts_ = [], []
        for e, s in zip(np.cumsum(sizes), sizes):
            for a in range(e - s, e, EVERY):
                starts.append(at[a])
                counts_.append(min(EVERY, e - a))
        got = unpack(np.frombuffer(data, np.uint8), np.array(starts), np.array(counts_), decode_table(lengths))
        assert got.tolist() == ids.tolist()
        assert (at[np.cumsum(sizes) - sizes] % 8 == 0).all() and len(data) == first[-1]
    assert code_lengths({}) == {}


def test_length_limit_is_optimal():
    """Against all sets of lengths that are no longer than the limit, for a few ids."""
    from itertools import product

    for counts in ([1, 1, 2, 3, 5], [1, 2, 4, 8, 16], [5, 5, 5, 5, 100]):
        best = min(sum(c * b for c, b in zip(counts, bits)) for bits in product(range(1, 4), repeat=5) if sum(2.0 ** -b for b in bits) <= 1)
        lengths = code_lengths(dict(enumerate(counts)), 3)
        assert sum(counts[i] * b for i, b in lengths.items()) == best


def test_counts_query(spark, sf_dir):
    docs = given(sf_dir)
    ids = sorted(docs)
    want = brute_counts([docs[d][1] for d in ids], PATH).tolist()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op8_token_counts(spark, sf_dir).collect()}
    assert got == {d: (len((docs[d][1] or "").encode()), n, n > 1024) for d, n in zip(ids, want)}


def test_counts_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|>"), (None, "x y"), (4, "x y"), (4, "x y"), (5, "a" * 100_000), (6, "b c " * 50_000), (7, "é  　 ü")]
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts(clashing(table(spark, rows)), PATH, batch_bytes=1000).collect())
    want = sorted((str(d), int(n)) for (d, _), n in zip(rows, brute_counts([t for _, t in rows], PATH)))
    assert got == want
    assert token_counts(table(spark, []), PATH).collect() == []


def test_counts_by_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a b", "", "Ünï 👍 code", " x " * 30]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts(table(spark, list(enumerate(texts))), path).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_known_pieces_cost_no_python_call_each(encoder):
    """Pieces met before are looked up, joined and counted by whole arrays."""
    import cProfile
    import pstats

    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(20)]
    first = encoder.encode(texts)
    profile = cProfile.Profile()
    profile.enable()
    again = encoder.encode(texts)
    profile.disable()
    assert again == first and pstats.Stats(profile).total_calls < 2000


def test_bare_pieces():
    import pyarrow as pa
    from flowlake.llm.encode import _bare

    ends = ["", "a", "é", "👍", "\n", "\x1c", "\x85", "\xa0", "　", "\x7f", "\x00"]
    words = pa.array([a + m + b for a in ends for m in ("", "b\nc") for b in ends], pa.string())
    for some in (words, words[3:50], words[:1], words[:0]):
        texts = some.to_pylist()
        bare, empty = _bare(some, np.array(texts, object))
        assert bare.tolist() == [t == t.strip() for t in texts] and empty.tolist() == [not t for t in texts]


def test_packed_bits():
    """Against a string of bits: codes of up to 33 bits at every offset, documents begun at a byte."""
    rng = random.Random(4)
    bits = np.array([rng.randint(1, 33) for _ in range(200)], np.int64)
    code = np.array([rng.getrandbits(int(b)) for b in bits], np.uint64)
    for sizes in ([], [1], [3, 1, 500, 0, 9, 2000]):
        ids = np.array(rng.choices(range(200), k=sum(sizes)), np.int64)
        data, first, at = pack(ids, np.array(sizes, np.int64), code, bits)
        want, places = "", []
        for e, s in zip(np.cumsum(sizes), sizes):
            for i in ids[e - s:e].tolist():
                places.append(len(want))
                want += f"{int(code[i]):0{int(bits[i])}b}"
            want += "0" * (-len(want) % 8)
        assert "".join(f"{b:08b}" for b in data) == want and at.tolist() == places and first[-1] * 8 == len(want)


def test_the_driver_keeps_no_vocabulary(spark):
    from flowlake.llm.encode import encoder as held

    assert token_files(table(spark, [(1, "a b")]), PATH).count() == 1
    assert held.cache_info().currsize == 0
