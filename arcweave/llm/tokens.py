"""Vectorised encoding with a word-level BPE vocabulary (ids equal the tokenizer library's).

Words are split and looked up with array operations over a chunk of texts, and each distinct word of the chunk is merged
once, all words at a time: a round finds each word's lowest-ranked pair and merges it. Texts that the arrays do
not cover (letters beyond Latin, characters whose lower case is longer, unnormalised text, special tokens' strings) go
through the library.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import xxhash

_LIMIT = 0x250  # code points that the class table covers
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 21  # characters


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(extra)) for b in range(256)]


def _code_point_tables() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(_LIMIT, _OTHER, np.uint8), np.arange(_LIMIT, dtype=np.uint32)
    for cp in range(_LIMIT):
        ch, cat = chr(cp), unicodedata.category(chr(cp))
        low = ch.lower()
        if len(low) != 1 or ord(low) >= _LIMIT:
            kind[cp] = _HARD
            continue
        lower[cp] = ord(low)
        if cp in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
            kind[cp] = _SPACE
        elif cat[0] == "L":
            kind[cp] = _LETTER
        elif cat[0] == "N":
            kind[cp] = _DIGIT
    return kind, lower


class _PairTable:
    """(left id, right id) -> merge rank, by three hash tables in turn; -1 where there is no merge."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.levels = []
        for bits, factor in ((18, 0x9E3779B97F4A7C15), (15, 0xC2B2AE3D27D4EB4F), (14, 0x165667B19E3779F9), (13, 0xD6E8FEB86659FD93)):
            slot = (keys * np.uint64(factor)) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            where, value = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << bits, -1, np.int32)
            where[slot[first]], value[slot[first]] = keys[first], ranks[first]
            self.levels.append((np.uint64(factor), np.uint64(64 - bits), where, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
        if len(keys):
            raise ValueError("merge table did not fit")

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(key), -1, np.int32)
        for factor, shift, where, value in self.levels:
            slot = (key * factor) >> shift
            out = np.where(where[slot] == key, value[slot], out)
        return out


def _keys(data: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word: eight bytes at a time, mixed at every step; words over 64 bytes by xxh3."""
    eight = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))
    mask = np.array([(1 << 8 * r) - 1 for r in range(9)], np.uint64)
    key, open_ = n.astype(np.uint64) * _ODD, np.arange(len(n))
    for at in range(0, 64, 8):
        open_ = open_[n[open_] > at]
        if not len(open_):
            break
        x = key[open_] ^ (eight[lo[open_] + at] & mask[np.minimum(n[open_] - at, 8)])
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * _ODD
        key[open_] = x ^ (x >> np.uint64(30))
    for i in np.flatnonzero(n > 64):
        key[i] = xxhash.xxh3_64_intdigest(data[lo[i] : lo[i] + n[i]].tobytes())
    return key


class WordBpe:
    """Encoder for the vocabulary file at ``path`` (lower case, word ends, white space dropped)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        symbols = _byte_symbols()
        self.plain = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.uint64)
        keys, first = np.unique(keys, return_index=True)
        self.ranks = _PairTable(keys, first.astype(np.int32))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.kind, self.lower = _code_point_tables()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids (uint32) of each text."""
        out: list = [None] * len(texts)
        batch, size = [], 0
        for i, t in enumerate(texts):
            if "<|" in t or (not t.isascii() and (max(t) >= chr(_LIMIT) or not unicodedata.is_normalized("NFC", t))):
                out[i] = self._library(t)
                continue
            batch.append(i)
            size += len(t)
            if size >= _CHUNK:
                self._chunk(texts, batch, out)
                batch, size = [], 0
        if batch:
            self._chunk(texts, batch, out)
        return out

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _chunk(self, texts: list[str], batch: list[int], out: list) -> None:
        cps = np.frombuffer("\n".join([texts[i] for i in batch] + [""]).encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(texts[i]) + 1 for i in batch])
        kind, low = self.kind[cps], self.lower[cps]
        hard = np.flatnonzero(kind == _HARD)
        if len(hard):  # rare: give those texts to the library and blank them here
            for k in np.unique(np.searchsorted(stops, hard, "right")):
                out[batch[k]] = self._library(texts[batch[k]])
                kind = kind.copy() if not kind.flags.writeable else kind
                kind[stops[k] - len(texts[batch[k]]) - 1 : stops[k]] = _SPACE
        start = np.empty(len(kind), bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        start |= kind == _DIGIT
        self._contractions(kind, low, start)
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(kind))
        word = kind[at] != _SPACE
        at, end = at[word], end[word]
        wide = (low >= 0x80).astype(np.int64)
        offset = np.arange(len(low)) + np.cumsum(wide) - wide  # byte offset of each code point
        data = np.empty(len(low) + int(wide.sum()), np.uint8)
        data[offset] = np.where(wide == 1, 0xC0 | (low >> 6), low)
        data[offset[wide == 1] + 1] = 0x80 | (low[wide == 1] & 0x3F)
        offset = np.append(offset, len(data))
        lo, n = offset[at], offset[end] - offset[at]
        text_of = np.searchsorted(stops, at, "right")
        if len(at):
            ids, counts = self._words(data, lo, n)
            per_text = np.bincount(text_of, weights=counts, minlength=len(batch)).astype(np.int64)
        else:
            ids, per_text = np.zeros(0, np.uint32), np.zeros(len(batch), np.int64)
        cuts = np.append(0, np.cumsum(per_text))
        for k, i in enumerate(batch):
            if out[i] is None:
                out[i] = ids[cuts[k] : cuts[k + 1]]

    @staticmethod
    def _contractions(kind: np.ndarray, low: np.ndarray, start: np.ndarray) -> None:
        """'s 't 're 've 'm 'll 'd are words where the apostrophe begins one."""
        pad = np.append(low, [0, 0, 0])
        for p in np.flatnonzero((low == 39) & start):
            a, b = chr(pad[p + 1]), chr(pad[p + 2])
            n = 2 if a in "st" else 3 if a + b in ("re", "ve", "ll") else 2 if a in "md" else 0
            if n:
                start[p + 1] = False
                if p + n < len(start) and kind[p + n] == _LETTER:
                    start[p + n] = True

    def _words(self, data: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and how many each has."""
        key = _keys(data, lo, n)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        ids, counts = self._merge(data, lo[first], n[first])
        offs = np.append(0, np.cumsum(counts))
        take = counts[which]
        ends = np.cumsum(take)
        flat = np.arange(int(ends[-1])) - np.repeat(ends - take, take) + np.repeat(offs[which], take)
        return ids[flat], take

    def _merge(self, data: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of distinct words, all at once."""
        words = len(n)
        begin = np.cumsum(n) - n
        flat = np.arange(int(n.sum())) - np.repeat(begin - lo, n)
        symbol = self.plain[data[flat]]
        last = begin + n - 1
        symbol[last] = self.final[data[flat[last]]]
        owner = np.repeat(np.arange(words), n)
        done_ids, done_owner = [], []
        none = np.iinfo(np.int32).max

        def ranks(p: np.ndarray) -> np.ndarray:
            """Rank of the pair that starts at each of the positions ``p``."""
            p1 = np.minimum(p + 1, len(symbol) - 1)
            r = self.ranks(symbol[p], symbol[p1])
            return np.where((owner[p] == owner[p1]) & (p1 > p) & (r >= 0), r, none)

        rank = ranks(np.arange(len(symbol)))
        while len(symbol):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lens = np.diff(np.append(heads, len(symbol)))
            best = np.minimum.reduceat(rank, heads)
            live = np.repeat(best < none, lens)
            if not live.all():
                done_ids.append(symbol[~live])
                done_owner.append(owner[~live])
                symbol, owner, rank = symbol[live], owner[live], rank[live]
                if not len(symbol):
                    break
                lens, best = lens[best < none], best[best < none]
            hit = np.flatnonzero(rank == np.repeat(best, lens))
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]  # the leftmost in each word
            symbol[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            hit = hit - np.arange(len(hit))
            rank[hit] = ranks(hit)
            before = hit[hit > 0] - 1
            rank[before] = ranks(before)
        ids = np.concatenate(done_ids) if done_ids else symbol
        who = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(who, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(who, minlength=words).astype(np.int64)
