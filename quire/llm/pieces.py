"""Encoding by distinct pieces: a text is cut where the tokenizer always cuts, each distinct piece is
encoded once, and ids are put back by position.

Both vocabularies cut at ASCII white space. The byte-level one keeps it: of a run of white space before
a word, all but the last character are one piece; the last is a piece of its own, or, if it is a space,
begins the word's piece. A run at the end of a text is one piece. Texts in which this could differ (other
white space, special tokens) are cut by the byte-level vocabulary's own pattern, and encoded whole with the other one.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from . import kernel

_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf|<\|(?:start|end)oftext\|>")


def cut(buf: np.ndarray, offsets: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces in order, and each text's first piece."""
    starts, ends, first = kernel.word_bounds(buf, offsets)
    if not keep_space:
        return starts, ends, first
    n_docs = len(offsets) - 1
    # Gaps of white space before each word, and after each text's last word.
    per = np.diff(first)
    doc = np.repeat(np.arange(n_docs), per)
    before = np.empty(len(starts), np.int64)
    before[1:] = ends[:-1]
    heads = first[:-1][per > 0]
    before[heads] = offsets[:-1][per > 0]
    gap = starts - before
    tail = offsets[:-1].copy()
    tail[per > 0] = ends[first[1:][per > 0] - 1]
    has = np.flatnonzero(gap > 0)
    last = starts[has] - 1
    blank = buf[last] == 0x20
    word_start = starts.copy()
    word_start[has[blank]] -= 1
    runs = has[gap[has] > 1]
    odd = has[~blank]
    ends_of_text = np.flatnonzero(offsets[1:] > tail)
    s = np.concatenate([word_start, before[runs], starts[odd] - 1, tail[ends_of_text]])
    e = np.concatenate([ends, starts[runs] - 1, starts[odd], offsets[1:][ends_of_text]])
    d = np.concatenate([doc, doc[runs], doc[odd], ends_of_text])
    order = np.argsort(s, kind="stable")
    return s[order], e[order], np.searchsorted(d[order], np.arange(n_docs + 1), "left")


class Pieces:
    """Ids of pieces, kept in arrays sorted by hash; ``checks`` confirms a hash."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, lens: np.ndarray):
        self.hashes, self.checks, self.ids, self.lens = hashes, checks, ids, lens
        self.at = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in these rows, one after another, and each piece's number of ids."""
        return gather(self.ids, self.at, rows)


def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in these rows, one after another, and each piece's number of ids."""
        return gather(self.ids, self.at, rows)


def gather(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = at[rows + 1] - at[rows]
    stop = np.cumsum(lens)
    total = int(stop[-1]) if len(stop) else 0
    index = np.ones(total, np.int64)
    full = lens > 0
    begin, where = at[rows[full]], (stop - lens)[full]
    if total:
        index[where] = begin
        index[where[1:]] -= begin[:-1] + lens[full][:-1] - 1
        index = np.cumsum(index)
    return values[index], lens


_loaded: dict[str, Tokenizer] = {}


def tokenizer(name: str) -> Tokenizer:
    """The library's tokenizer for a vocabulary file, once a process; truncation and padding are off."""
    if name not in _loaded:
        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.no_truncation()
        t.no_padding()
        _loaded[name] = t
    return _loaded[name]


_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
"""Words of these letters alone are one word to a vocabulary with word ends, in any case."""


def _by_library(name: str, texts: list[str]) -> list[list[int]]:
    t, out = tokenizer(name), []
    for i in range(0, len(texts), 4000):
        out += [e.ids for e in t.encode_batch_fast(texts[i : i + 4000], add_special_tokens=False)]
    return out


def _by_ranks(name: str, texts: list[str]) -> list[list[int]]:
    """Byte-level pieces below U+0800 by the same vocabulary's ranks, which is quicker for single pieces."""
    if name not in _ranked:
        at = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(at, "rb"))}
        _ranked[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one, special = _ranked[name]._core_bpe.encode_ordinary, specials(name)
    out = [one(x) if (x.isascii() or max(x) < "\u0800") and not (special and "<|" in x and special.search(x)) else None for x in texts]
    rest = [k for k, x in enumerate(out) if x is None]
    for k, ids in zip(rest, _by_library(name, [texts[k] for k in rest]), strict=True):
        out[k] = ids
    return out


def _by_words(name: str, texts: list[str]) -> list[list[int]]:
    """Plain words are encoded many at a time; each ends with an id that has the vocabulary's word end."""
    t = tokenizer(name)
    if name not in _ending:
        _ending[name] = np.array([(t.id_to_token(k) or "").endswith("</w>") for k in range(t.get_vocab_size())])
    plain = [k for k, x in enumerate(texts) if _PLAIN.fullmatch(x)]
    out: list = [None] * len(texts)
    for i in range(0, len(plain), 500):
        some = plain[i : i + 500]
        ids = np.array(t.encode_batch_fast([" ".join([texts[k] for k in some])], add_special_tokens=False)[0].ids)
        stops = (np.flatnonzero(_ending[name][ids]) + 1).tolist()
        if len(stops) == len(some):
            every = ids.tolist()
            for k, a, b in zip(some, [0, *stops[:-1]], stops, strict=True):
                out[k] = every[a:b]
    rest = [k for k, x in enumerate(out) if x is None]
    for k, ids in zip(rest, _by_library(name, [texts[k] for k in rest]), strict=True):
        out[k] = ids
    return out


_ranked: dict[str, tiktoken.Encoding] = {}
_ending: dict[str, np.ndarray] = {}


def encode_pieces(name: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces, one after another, and each one's number."""
    out = {"byte_bpe_50k.json": _by_ranks, "word_bpe_49k.json": _by_words}.get(name, _by_library)(name, texts)
    return np.fromiter(itertools.chain.from_iterable(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))


_FLAG = np.zeros(256, bool)
_FLAG[[*range(0x1C, 0x20), ord("<"), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def odd_texts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts with white space beyond ASCII or special tokens."""
    maybe = np.unique(np.searchsorted(offsets, np.flatnonzero(_FLAG[buf]), "right") - 1)
    return np.array([d for d in maybe.tolist() if _ODD.search(buf[offsets[d] : offsets[d + 1]].tobytes())], np.int64)


_PATTERN = regex.compile(public_tokenizers.PATTERN)
_special: dict[str, regex.Pattern | None] = {}


def specials(name: str) -> regex.Pattern | None:
    """Matches the special tokens of a vocabulary."""
    if name not in _special:
        held = sorted((x.content for x in tokenizer(name).get_added_tokens_decoder().values()), key=len, reverse=True)
        _special[name] = regex.compile("|".join(map(regex.escape, held))) if held else None
    return _special[name]


def _own_bounds(name: str, text: str) -> Iterator[tuple[int, int]]:
    """Pieces of a text by the byte-level vocabulary's own pattern, in bytes: special tokens are pieces."""
    at, done, special = 0, 0, specials(name)
    for m in [*(special.finditer(text) if special else ()), None]:
        for piece in _PATTERN.findall(text[done : m.start() if m else None]):
            n = len(piece.encode())
            yield at, at + n
            at += n
        if m:
            n = len(m.group().encode())
            yield at, at + n
            at, done = at + n, m.end()


def bounds(name: str, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As cut() with spaces kept, but texts with other white space or special tokens are cut by the vocabulary's own pattern."""
    starts, ends, first = cut(buf, offsets, True)
    odd = odd_texts(buf, offsets)
    if not len(odd):
        return starts, ends, first
    s, e, counts, done = [], [], np.diff(first), 0
    for d in odd.tolist():
        own = np.array(list(_own_bounds(name, buf[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8"))), np.int64).reshape(-1, 2) + offsets[d]
        s += [starts[first[done] : first[d]], own[:, 0]]
        e += [ends[first[done] : first[d]], own[:, 1]]
        counts[d], done = len(own), d + 1
    s.append(starts[first[done] :])
    e.append(ends[first[done] :])
    return np.concatenate(s), np.concatenate(e), np.concatenate([[0], np.cumsum(counts)])


def _no_pieces() -> Pieces:
    return Pieces(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64))


def _merge(a: Pieces, b: Pieces) -> Pieces:
    hashes = np.concatenate([a.hashes, b.hashes])
    order = np.argsort(hashes, kind="stable")
    lens = np.concatenate([a.lens, b.lens])
    at = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    return Pieces(hashes[order], np.concatenate([a.checks, b.checks])[order], gather(np.concatenate([a.ids, b.ids]), at, order)[0], lens[order])


def rows_in(held: np.ndarray, checks: np.ndarray, hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where hashes stand in a sorted array, whether they do with the wanted check, and whether they do with another."""
    if not len(held):
        none = np.zeros(len(hashes), bool)
        return np.zeros(len(hashes), np.int64), none, none
    row = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
    there, same = held[row] == hashes, checks[row] == wanted
    return row, there & same, there & ~same


class Batch:
    """The distinct pieces of some texts. ``strays`` are texts with a piece whose hash another piece of the batch has."""

    def __init__(self, name: str, buf: np.ndarray, offsets: np.ndarray, keep_space: bool):
        self.buf = buf
        self.starts, self.ends, self.first = bounds(name, buf, offsets) if keep_space else cut(buf, offsets, False)
        hashes, checks = kernel.span_hashes(buf, self.starts, self.ends), kernel.span_checks(buf, self.starts, self.ends)
        self.hashes, self.where, self.back = np.unique(hashes, return_index=True, return_inverse=True)
        self.checks = checks[self.where]
        other = np.flatnonzero(checks != self.checks[self.back])
        self.strays = np.unique(np.searchsorted(self.first, other, "right") - 1)

    def texts(self, rows: np.ndarray) -> list[str]:
        """The distinct pieces in these rows."""
        at = self.where[rows]
        if len(at) > len(self.buf) // 64:
            raw = self.buf.tobytes()
            return [raw[a:b].decode("utf-8") for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]
        return [self.buf[a:b].tobytes().decode("utf-8") for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]

    def joined(self, found: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts by the places of their pieces, and each text's number of ids."""
        ids, lens = found.gather(self.back)
        total = np.concatenate([[0], np.cumsum(lens)])
        return ids, total[self.first[1:]] - total[self.first[:-1]]


class Encoder:
    """Encodes batches of texts; remembers the first ``most`` distinct pieces that this process meets. New pieces
    go to a small table first, which is merged into the large one when it has a quarter of its size."""

    def __init__(self, name: str, keep_space: bool, most: int = 1_000_000):
        self.name, self.keep_space, self.most = name, keep_space, most
        self.known, self.recent = _no_pieces(), _no_pieces()

    def lookup(self, batch: Batch) -> Pieces:
        """The ids of the batch's distinct pieces."""
        row, old, odd = rows_in(self.known.hashes, self.known.checks, batch.hashes, batch.checks)
        late, fresh, odd2 = rows_in(self.recent.hashes, self.recent.checks, batch.hashes, batch.checks)
        new = np.flatnonzero(~(old | fresh))
        added = _no_pieces()
        if len(new):
            added = Pieces(batch.hashes[new], batch.checks[new], *encode_pieces(self.name, batch.texts(new)))
        # The three sources' ids one after another, then in the order of the hashes.
        parts = [self.known.gather(row[old]), self.recent.gather(late[fresh]), (added.ids, added.lens)]
        where = np.concatenate([np.flatnonzero(old), np.flatnonzero(fresh), new])
        lens = np.concatenate([n for _, n in parts])
        back = np.empty(len(where), np.int64)
        back[where] = np.arange(len(where))
        ids, lens = gather(np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]), back)
        # A piece whose hash a remembered one has is not remembered.
        if len(new) and not (odd | odd2).any() and len(self.known.hashes) + len(self.recent.hashes) + len(new) <= self.most:
            self.recent = _merge(self.recent, added)
            if 4 * len(self.recent.hashes) > len(self.known.hashes):
                self.known, self.recent = _merge(self.known, self.recent), _no_pieces()
        return Pieces(batch.hashes, batch.checks, ids, lens)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's number of ids."""
        batch = Batch(self.name, buf, offsets, self.keep_space)
        ids, counts = batch.joined(self.lookup(batch))
        whole = batch.strays if self.keep_space else np.union1d(batch.strays, odd_texts(buf, offsets))
        return encode_whole(self.name, buf, offsets, ids, counts, whole)


_encoders: dict[str, Encoder] = {}


def encoder(name: str, keep_space: bool) -> Encoder:
    """One encoder a process and vocabulary."""
    if name not in _encoders:
        _encoders[name] = Encoder(name, keep_space)
    return _encoders[name]


def encode_whole(name: str, buf: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace the ids of some texts by those of the library for the whole text."""
    if not len(some):
        return ids, counts
    at = np.concatenate([[0], np.cumsum(counts)])
    parts, done, t = [], 0, tokenizer(name)
    counts = counts.copy()
    for d in some.tolist():
        whole = np.array(t.encode(buf[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids, np.uint32)
        parts += [ids[at[done] : at[d]], whole]
        counts[d] = len(whole)
        done = d + 1
    parts.append(ids[at[done] :])
    return np.concatenate(parts), counts
