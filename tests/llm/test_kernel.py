import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import kernel, lm, pieces

TEXTS = st.lists(st.lists(st.sampled_from(list("aB é\t\n.,'1ß  ") + ["\u00a0", "\u2003", "中", "<|endoftext|>"]), max_size=40).map("".join), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_runs_between_ascii_white_space(texts):
    buf, offsets = kernel.strings(pa.array(texts, pa.string()))
    starts, ends, first = kernel.word_bounds(buf, offsets)
    raw = buf.tobytes()
    got = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]


def test_equal_spans_have_equal_hashes_across_blocks():
    words = ["x" * (k % 7 + 1) + str(k % 50) for k in range(5000)]
    buf, offsets = kernel.strings(pa.array([" ".join(words)]))
    starts, ends, _ = kernel.word_bounds(buf, offsets)
    whole = kernel.span_hashes(buf, starts, ends)
    small = np.concatenate([kernel.span_hashes(buf, starts[i : i + 99], ends[i : i + 99]) for i in range(0, 5000, 99)])
    assert (whole == small).all()
    assert len(set(whole.tolist())) == len(set(words))


def thue_morse(n, a="a", b="b"):
    """A word of 2**n letters and its complement: polynomial hashes modulo 2**64 take them for one."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomial_hashes_confuse():
    for n in (3, 4, 6, 7, 8, 10, 12):
        pair = list(thue_morse(n))
        buf, offsets = kernel.strings(pa.array([" ".join(pair * 2)]))
        starts, ends, _ = kernel.word_bounds(buf, offsets)
        for f in (kernel.span_hashes, kernel.span_checks):
            got = f(buf, starts, ends).tolist()
            assert got[:2] == got[2:] and (n == 3 or got[0] != got[1] or f is kernel.span_checks and n <= 3)
        for name, keep in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
            ids = pieces.Encoder(name, keep).encode(*kernel.strings(pa.array(pair)))[0].tolist()
            assert ids == [i for x in pair for i in pieces.tokenizer(name).encode(x, add_special_tokens=False).ids]
        tokens, _ = lm.tokens_of(*kernel.strings(pa.array(pair)))
        assert len(set(tokens.tolist())) == 3


def test_equal_hashes_of_different_pieces_are_told_apart(monkeypatch):
    """With a hash that keeps four bits most pieces collide; checks send them to the library."""
    real = kernel.span_hashes
    monkeypatch.setattr(kernel, "span_hashes", lambda *a: real(*a) & np.uint64(15))
    texts = ["one two three four five", "six seven eight nine ten internationalization one", "ten nine"]
    e = pieces.Encoder("byte_bpe_50k.json", True)
    for _ in range(2):
        for t in texts:
            assert e.encode(*kernel.strings(pa.array([t])))[0].tolist() == pieces.tokenizer("byte_bpe_50k.json").encode(t).ids


def test_a_very_long_word_costs_its_own_size():
    import tracemalloc

    buf = np.full(64 << 20, ord("x"), np.uint8)
    at = np.array([0]), np.array([len(buf)])
    tracemalloc.start()
    kernel.span_hashes(buf, *at)
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_pieces_encode_as_the_library_does(texts):
    buf, offsets = kernel.strings(pa.array(texts, pa.string()))
    for name, keep in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        ids, counts = pieces.Encoder(name, keep).encode(buf, offsets)
        want = [e.ids for e in pieces.tokenizer(name).encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def test_a_full_piece_table_still_encodes():
    e = pieces.Encoder("byte_bpe_50k.json", True, most=3)
    for text in ("one two three four", "five six one seven eight nine ten"):
        buf, offsets = kernel.strings(pa.array([text]))
        assert e.encode(buf, offsets)[0].tolist() == pieces.tokenizer("byte_bpe_50k.json").encode(text).ids


def test_packed_keys_come_back():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    back = lm.unpack_keys(lm.pack_keys(keys, np.arange(len(keys))))
    assert (back[0] == keys).all() and (back[1] == np.arange(len(keys))).all()


def test_sums_by_keys_of_two_columns():
    rng = np.random.default_rng(3)
    a, b, n = (rng.integers(0, 9, 500).astype(np.uint64) for _ in range(3))
    sums = lm.Sums(key=2)
    for i in range(0, 500, 50):
        sums.add(a[i : i + 50], b[i : i + 50], n[i : i + 50])
    sums.settle()
    want = {}
    for x, y, z in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        want[x, y] = want.get((x, y), 0) + z
    assert dict(zip(zip(*[k.tolist() for k in sums.keys], strict=True), sums.sums[0].tolist(), strict=True)) == want


def test_null_and_empty_columns():
    buf, offsets = kernel.strings(pa.array([None, "", "a"], pa.string()))
    assert offsets.tolist() == [0, 0, 0, 1]
    assert len(kernel.strings(pa.array([], pa.string()))[0]) == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**63 - 2), st.lists(st.tuples(st.integers(0, 2**63), st.integers(0, 2**63)), min_size=1, max_size=50))
def test_pairs_of_ids_have_keys_of_their_own(most, pairs):
    p = lm.Pairing(most)
    a, b = (np.array([x[i] % (most + 1) for x in pairs], np.int64) for i in (0, 1))
    key = p.key(a, b)
    back = p.ids(key)
    assert (back[0] == a).all() and (back[1] == b).all()
    assert len(key) == (2 if most.bit_length() > 32 else 1)
    shard = p.shard(key, 7)
    assert shard.min() >= 0 and shard.max() < 7


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.lists(st.integers(0, 2**64 - 1), max_size=300), st.booleans())
def test_packed_keys_are_found(bits, values, wide):
    every = sorted({v >> (64 - bits) for v in values})
    held, lost = np.array(every[::2], np.uint64), np.array(every[1::2], np.uint64)
    other = lambda h: [h ^ np.uint64(77)] if wide else []
    keys = lm.Keys(np.frombuffer(lm.Keys.pack([held, *other(held)]), np.uint8))
    assert all((x == y).all() for x, y in zip(keys.all(), [held, *other(held)], strict=True))
    assert keys.find([held, *other(held)]).tolist() == list(range(len(held)))
    assert (keys.find([lost, *other(lost)]) == -1).all()
    if wide:
        assert (keys.find([held, held]) == -1).all()


def test_coded_rows_come_back():
    rng = np.random.default_rng(3)
    columns = [rng.geometric(0.4, 5000), rng.integers(0, 90, 5000)]
    codes = lm.Codes(np.frombuffer(lm.Codes.pack(columns), np.uint8))
    at = rng.permutation(5000)
    assert (codes.rows(at) == np.column_stack(columns)[at]).all()
