"""Whole-text tokenisation inside tasks: the tokenizers library encodes each different pre-token once, numpy finds and joins them.

Both public vocabularies split a text into pre-tokens before any merge, so the ids of a text are the ids
of its pre-tokens one after another. A worker keeps a bounded table pre-token -> ids; only pre-tokens
that it does not hold go to the library. Pre-tokens of up to 16 bytes are looked up by their bytes and length, longer ones are kept in
no table at all: nothing is taken for another by a hash. Documents with characters outside Latin (from U+0250 on), with
one of the few special-cased characters, or with a special token's string are encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .common import BASE, INVERSE, KEEP, eights, slices, spread

LATIN = 0x250
SLOTS_LOG2 = 20
#: Ids kept for pre-tokens before the table is emptied.
POOL_IDS = 1 << 23
#: Longer pre-tokens, in bytes, go to the library each time, once a slice.
EXACT = 16
#: Bytes of text worked on at once: numpy needs some 60 times as much for a while.
SLICE = 1 << 19

L, N, O, S = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(LATIN, O, np.uint8)
    for c in range(LATIN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = L if kind == "L" else N if kind == "N" else O
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = S
    return out


CLASS = _classes()
#: Lower case of one character each; U+0130 has two and is left to the library.
LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < LATIN else c for c in range(LATIN)], np.uint32)
#: Characters whose lower case leaves Latin-below-U+0250 or has more characters.
ODD = np.array([len(chr(c).lower()) != 1 or ord(chr(c).lower()) >= LATIN for c in range(LATIN)])
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _contractions(cp: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the contraction ('s, 't, 're, 've, 'm, 'll, 'd) that starts at each apostrophe in ``at``, or 0."""
    n = len(cp)
    a = np.where(at + 1 < limit, cp[np.minimum(at + 1, n - 1)], 0)
    b = np.where(at + 2 < limit, cp[np.minimum(at + 2, n - 1)], 0)
    out = np.zeros(len(at), np.int64)
    for tail in CONTRACTIONS:
        hit = a == ord(tail[0])
        if len(tail) == 2:
            hit &= b == ord(tail[1])
        out[hit & (out == 0)] = 1 + len(tail)
    return out


class Encoder:
    """Ids of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = self.library.normalizer is not None  # the lower-casing vocabulary, which drops white space
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.head, self.tail = (np.zeros(1 << SLOTS_LOG2, np.uint64) for _ in range(2))
        #: Place in the pool, number of ids and length of the pre-token in bytes: 40, 16 and 8 bits; 0 where a slot is free.
        self.entry = np.zeros(1 << SLOTS_LOG2, np.uint64)
        self.pool = np.zeros(POOL_IDS, np.uint32)
        self.used = 0

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another (uint32), and the n+1 offsets, for UTF-8 bytes and their offsets."""
        parts, counts = [], []
        for i, j in slices(at, SLICE):
            ids, n = self._slice(data[at[i] : at[j]], at[i : j + 1] - at[i])
            parts.append(ids)
            counts.append(n)
        out = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        sizes = np.concatenate(counts) if counts else np.empty(0, np.int64)
        return out, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _slice(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        plain = self._plain(raw, data, at)
        if not plain.all():
            ids, n = [], np.zeros(len(at) - 1, np.int64)
            edges = np.flatnonzero(np.diff(np.concatenate([[-1], plain.astype(np.int8), [-1]])))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if plain[i]:
                    part, n[i:j] = self._fast(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                    ids.append(part)
                else:
                    for k in range(i, j):
                        part = np.array(self.library.encode(raw[at[k] : at[k + 1]].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
                        n[k] = len(part)
                        ids.append(part)
            return np.concatenate(ids), n
        return self._fast(raw, at)

    def _plain(self, raw: bytes, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which documents hold only characters below U+0250 (lead bytes below 0xC9 0x90) and nothing special-cased."""
        odd = data >= 0xC9
        if self.words:
            odd[1:] |= (data[:-1] == 0xC4) & (data[1:] == 0xB0)  # U+0130
            for c in np.flatnonzero(ODD):
                code = chr(c).encode()
                odd[1:] |= (data[:-1] == code[0]) & (data[1:] == code[1]) if len(code) == 2 else False
        plain = np.ones(len(at) - 1, bool)
        plain[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = False
        for token in self.special:
            code, k = token.encode(), 0
            while (k := raw.find(code[:2] if len(code) > 2 and code[:2] == b"<|" else code, k)) >= 0:
                plain[np.searchsorted(at, k, "right") - 1] = False
                k += 1
        return plain

    def _fast(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = len(at) - 1
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(cp) == len(raw):
            edges = at
        else:
            starts = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=starts[1:])
            edges = starts[at]
        if not len(cp):
            return np.empty(0, np.uint32), np.zeros(docs, np.int64)
        if self.words:
            cp = LOWER[cp]
        start, end = self._pretokens(cp, edges)
        text = raw if not self.words else raw.lower() if len(cp) == len(raw) else cp.tobytes().decode("utf-32-le").encode()
        first, last = start, end
        if len(cp) != len(raw):
            place = np.zeros(len(cp) + 1, np.int64)
            np.cumsum(1 + (cp >= 0x80), out=place[1:])
            first, last = place[start], place[end]
        place, count = self._look_up(text, first, last)
        ids = self.pool[spread(count, place)]
        return ids, self._per_doc(start, edges, count)

    def _look_up(self, text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of the ids of each pre-token text[start:end]."""
        size, word = end - start, eights(np.frombuffer(text, np.uint8))
        head, tail = word[start] & KEEP[np.minimum(size, 8)], np.zeros(len(start), np.uint64)
        long = np.flatnonzero(size > 8)
        tail[long] = word[start[long] + 8] & KEEP[np.minimum(size[long] - 8, 8)]
        slot = ((head * BASE) ^ (tail * INVERSE)) + size.astype(np.uint64)
        slot = ((slot ^ (slot >> np.uint64(32))) * BASE >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        entry = self.entry[slot]
        miss = np.flatnonzero((self.head[slot] != head) | (self.tail[slot] != tail) | (entry & np.uint64(255) != size.astype(np.uint64)))
        if len(miss):
            pieces = [text[s:e] for s, e in zip(start[miss].tolist(), end[miss].tolist(), strict=True)]
            new = {x: None for x in pieces}
            found = [x.ids for x in self.library.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)]
            counts = np.array([len(x) for x in found], np.int64)
            if self.used + counts.sum() > len(self.pool):
                if self.used:  # what this slice has looked up lies in the old pool; it is looked up again for the new one
                    self.clear()
                    return self._look_up(text, start, end)
                self.pool = np.zeros(int(counts.sum()), np.uint32)  # one slice with more different ids than the pool has room for
            flat = np.array([i for x in found for i in x], np.uint32)
            places = self.used + np.cumsum(counts) - counts
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            number = dict(zip(new, range(len(new)), strict=True))
            which = np.array([number[x] for x in pieces])
            entry = entry.copy()
            entry[miss] = (places[which].astype(np.uint64) << np.uint64(24)) | (np.minimum(counts[which], 65535).astype(np.uint64) << np.uint64(8)) | np.minimum(size[miss], 255).astype(np.uint64)
            keep = miss[(size[miss] <= EXACT)]
            self.head[slot[keep]], self.tail[slot[keep]], self.entry[slot[keep]] = head[keep], tail[keep], entry[keep]  # of several in one slot the last is kept, in all three
            place, count = (entry >> np.uint64(24)).astype(np.int64), ((entry >> np.uint64(8)) & np.uint64(65535)).astype(np.int64)
            count[miss] = counts[which]
            return place, count
        return (entry >> np.uint64(24)).astype(np.int64), ((entry >> np.uint64(8)) & np.uint64(65535)).astype(np.int64)

    @staticmethod
    def _per_doc(start, edges, count) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(count)])
        return np.diff(total[np.searchsorted(start, edges)])

    def _pretokens(self, cp: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = CLASS[cp]
        n = len(cp)
        border = np.zeros(n + 1, bool)
        border[edges] = True  # a document starts here
        turn = np.ones(n + 1, bool)
        turn[1:n] = kind[1:] != kind[:-1]
        turn |= border
        limit = None
        # contractions begin at a one-character run "'" that stands first in its pre-token
        quote = np.flatnonzero((cp == 39) & turn[:n])
        cut = np.empty(0, np.int64)
        if len(quote):
            if not self.words:  # a space before it belongs to the same pre-token
                quote = quote[border[quote] | (cp[np.maximum(quote - 1, 0)] != 32)]
            limit = edges[np.searchsorted(edges, quote, "right")]
            size = _contractions(cp, quote, limit)
            quote, size = quote[size > 0], size[size > 0]
            cut = quote + size
        if self.words:
            first = turn[:n] & (kind != S)
            first |= kind == N  # digits stand alone
            if len(cut):
                for k in (1, 2):  # the letters of a contraction belong to it
                    inside = quote + k
                    inside = inside[inside < cut]
                    first[inside] = False
                inner = cut[cut < n]
                inner = inner[kind[inner] != S]
                first[inner] = True
            start = np.flatnonzero(first)
            # a pre-token ends where the next starts or white space begins
            stop = np.concatenate([start, [n]])
            spaces = np.concatenate([np.flatnonzero(turn[:n] & (kind == S)), [n]])
            end = np.minimum(stop[1:], spaces[np.searchsorted(spaces, start, "right")])
            return start, end
        first = turn[:n].copy()
        if len(cut):
            for k in (1, 2):
                inside = quote + k
                inside = inside[inside < cut]
                first[inside] = False
            inner = cut[cut < n]
            first[inner] = True
        # the last character of a white-space run that other characters follow in the same document
        last = np.zeros(n, bool)
        last[:-1] = (kind[:-1] == S) & (kind[1:] != S) & ~border[1:n]
        tail = np.flatnonzero(last)
        first[tail] = True
        joined = tail[cp[tail] == 32] + 1  # a blank belongs to the run after it
        first[joined] = False
        start = np.flatnonzero(first)
        return start, np.concatenate([start[1:], [n]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Decoder:
    """Bytes of ids of a byte-level vocabulary, looked up in one table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        # The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards (fixed by the format).
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        special = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
        vocab = library.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            pieces[i] = special[i].encode() if i in special else bytes(back[c] for c in token)
        self.size = np.array([len(x) for x in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and how many each id has."""
        size = self.size[ids]
        return self.data[spread(size, self.start[ids])], size


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


__all__ = ["Encoder", "encoder", "Decoder", "decoder"]
