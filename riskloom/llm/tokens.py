"""Exact, vectorised encoding with a public tokenizer file.

A batch of texts becomes one array of code points; numpy finds the piece
boundaries of the tokenizer's own splitting, and only *distinct* pieces are
merged, by the tokenizers library.  Pieces are told apart by a 64-bit hash of
their code points and their length.  The cache of merged pieces is bounded and
starts anew when full, which changes the cost and never the ids.
"""

from __future__ import annotations

import functools
from itertools import chain

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE, MARKUP = 0, 1, 2, 3, 4
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
CACHE_PIECES = 1_200_000
BATCH_CHARS = 2_000_000


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other, as the
    tokenizers library itself takes them (its Unicode tables are not Python's).
    Planes 4 to 13 hold no characters and the last two are for private use."""
    from tokenizers import Regex, pre_tokenizers

    out = np.zeros(0x110000, np.uint8)
    kinds = [(kind, pre_tokenizers.Split(Regex(pat), "removed")) for kind, pat in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"))]
    # a few at a time: the library keeps many bytes for each character that it looks at
    for at in [*range(0, 0x40000, 0x1000), *range(0xE0000, 0xF0000, 0x1000)]:
        points = np.arange(at, at + 0x1000)
        points = points[(points < 0xD800) | (points >= 0xE000)]
        every = "".join(map(chr, points.tolist()))
        for kind, split in kinds:
            other = np.zeros(len(points), bool)
            for _, (a, b) in split.pre_tokenize_str(every) if every else ():
                other[a:b] = True
            out[points[~other]] = kind
    return out


@functools.cache
def word_classes() -> np.ndarray:
    """``classes`` with only those letters that stay letters when composed and lower-cased."""
    import unicodedata

    out = classes().copy()
    for c in np.flatnonzero(out == LETTER).tolist():
        x = unicodedata.normalize("NFC", chr(c)).lower()
        if len(x) != 1 or out[ord(x)] != LETTER:
            out[c] = OTHER
    return out


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(int(_B), -1, 1 << 64)
    up, down = np.full(n, _B, np.uint64), np.full(n, np.uint64(inv), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def byte_level_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level pattern start; ``first`` marks the
    first code point of each text."""
    n = len(cp)
    cls = classes()[cp]
    space = cls == SPACE
    prev_cls, prev_cp = np.empty_like(cls), np.empty_like(cp)
    prev_cls[0], prev_cls[1:], prev_cp[0], prev_cp[1:] = OTHER, cls[:-1], 0, cp[:-1]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    prev_space = prev_cls == SPACE
    # the last white space before a word starts a piece of its own (or with the word)
    next_word = np.zeros(n, bool)
    next_word[:-1] = ~space[1:]
    start = np.where(space, ~prev_space | (next_word & ~last), np.where(prev_space, prev_cp != 32, cls != prev_cls))
    start |= first
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        ends = np.searchsorted(np.flatnonzero(last), quote)
        end = np.flatnonzero(last)[ends] + 1
        at = lambda k: np.where(quote + k < end, cp[np.minimum(quote + k, n - 1)], 0)
        a, b = at(1), at(2)
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for hit, k in ((one, 2), (two & ~one, 3)):
            q, e = quote[hit], end[hit]
            for j in range(1, k):
                start[q + j] = False
            on = q + k < e
            start[q[on] + k] = True
    return start


def word_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where text may be cut without changing the ids of the lower-casing word
    tokenizer: at white space, and between letters (or ASCII digits) and ASCII
    punctuation other than the apostrophe."""
    cls = word_classes()[cp]
    cls[(cls == NUMBER) & (cp >= 128)] = OTHER
    cls[(cls == OTHER) & (cp < 128) & (cp != 39)] = MARKUP
    prev = np.empty_like(cls)
    prev[0], prev[1:] = SPACE, cls[:-1]
    solid, prev_solid = (cls == LETTER) | (cls == NUMBER), (prev == LETTER) | (prev == NUMBER)
    return first | ((cls == SPACE) != (prev == SPACE)) | (solid & (prev == MARKUP)) | ((cls == MARKUP) & prev_solid)


class Encoder:
    """Encodes texts to ids like ``Tokenizer.encode(text, add_special_tokens=False)``.

    ``lexicon`` (optional) maps distinct pieces to ids before the cache does;
    the cache starts anew beyond ``cache`` pieces.
    """

    def __init__(self, path: str, lexicon=None, cache: int = CACHE_PIECES):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        self.starts = byte_level_starts if spec["normalizer"] is None else word_starts
        self.drop_space = self.starts is word_starts
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.lexicon, self.cache = lexicon, cache
        self.reset()

    def reset(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.off, self.len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, hashes: list[int], pieces: list[str]) -> None:
        known = self.lexicon.lookup(pieces) if self.lexicon is not None else [None] * len(pieces)
        rest = [i for i, k in enumerate(known) if k is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)):
            known[i] = e.ids
        lens = np.fromiter(map(len, known), np.int64, len(known))
        total, n = int(lens.sum()), len(self.slots)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(known) > len(self.off):
            self.off, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.off, self.len))
        if total:
            self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(known), np.uint32, total)
        self.off[n:n + len(known)] = self.used + np.cumsum(lens) - lens
        self.len[n:n + len(known)] = lens
        self.used += total
        self.slots.update(zip(hashes, range(n, n + len(known))))

    def pieces(self, texts: list[str]):
        """(distinct hashes, distinct pieces, piece numbers in order, first piece of each text)."""
        whole = "".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(cp):
            return [], (lambda i: ""), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        first = np.zeros(len(cp), bool)
        first[(ends - lens)[lens > 0]] = True
        s = np.flatnonzero(self.starts(cp, first))
        bounds = np.searchsorted(s, np.concatenate([[0], ends]))
        e = np.concatenate([s[1:], [len(cp)]])
        if self.drop_space:
            solid = classes()[cp[s]] != SPACE
            bounds = np.concatenate([[0], np.cumsum(solid)])[bounds]
            s, e = s[solid], e[solid]
        up, down = _powers(1 << max(16, int(len(cp)).bit_length()))
        total = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(0x51ED27)) * up[:len(cp)], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h ^= h >> np.uint64(31)
        h = h * np.uint64(0xD6E8FEB86659FD93) + (e - s).astype(np.uint64)
        codes, distinct = pd.factorize(h)
        at = np.empty(len(distinct), np.int64)
        at[codes[::-1]] = np.arange(len(codes))[::-1]
        return distinct.tolist(), (lambda i: whole[s[at[i]]:e[at[i]]]), codes, bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of the texts in them)."""
        if any(x in t for t in texts for x in self.special):
            parts = [self._direct(t) if any(x in t for x in self.special) else self.encode([t])[0] for t in texts]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        distinct, piece, codes, bounds = self.pieces(texts)
        if len(self.slots) > self.cache:
            self.reset()
        new = [i for i, x in enumerate(distinct) if x not in self.slots]
        if new:
            self._add([distinct[i] for i in new], [piece(i) for i in new])
        slot = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        lens, offs = self.len[slot][codes], self.off[slot][codes]
        cum = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(offs - cum[:-1], lens) + np.arange(cum[-1])]
        return ids, cum[bounds]

    def _direct(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode_table(self) -> list[bytes]:
        """Bytes of every id of a byte-level vocabulary."""
        back = {c: b for b, c in enumerate(byte_chars())}
        out = [b""] * (max(self.tok.get_vocab().values()) + 1)
        for token, i in self.tok.get_vocab().items():
            out[i] = token.encode() if any(c not in back for c in token) else bytes(back[c] for c in token)
        return out


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(more)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file in a Python worker."""
    return Encoder(path)


def text_chunks(batches, column: str = "text", limit: int = BATCH_CHARS):
    """Of Arrow batches: (slice of the batch, its texts) of about ``limit`` characters each."""
    for b in batches:
        texts = [t or "" for t in b.column(b.schema.get_field_index(column)).to_pylist()]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            yield b.slice(at, end - at), texts[at:end]
            at = end
