"""Token ids of texts by the tokenizers library, each distinct word encoded once.

A lower-casing word tokenizer gives a word the same ids wherever it stands. So
texts of common characters are split into words with numpy, all texts of a batch
at once; words of up to sixteen bytes are their own exact keys, two 64-bit
numbers, in an open hash table that the worker keeps; those that aren't in it,
and longer ones, go to the library, many in one call. Other texts, and all texts
under another tokenizer, go to the library whole. The ids are those of the
library in either case.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from quartzfolio.llm.common import GOLDEN, mix64

#: Splits that a lower-casing word tokenizer makes, and the characters on which
#: the split over Latin-1 bytes below agrees with it.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
COMMON = bytes([9, 10, 13, *range(32, 127), *range(0xC0, 0x100)])
LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
BLANK, LETTER, DIGIT, OTHER = range(4)
KIND = np.array([BLANK if c in (9, 10, 13, 32) else LETTER if 97 <= c <= 122 or c >= 0xDF and c != 0xF7 else DIGIT if 48 <= c <= 57 else OTHER for c in range(256)], np.uint8)
#: Bytes of the longest word that is kept, and the mask of the first so many bytes of eight.
LONGEST = 16
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes that are split at once, and words in one call of the library.
SEGMENT, TOGETHER = 1 << 20, 200


def split(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of lower-cased common text that begins with
    one blank and ends with at least ``LONGEST`` of them."""
    b = np.frombuffer(raw, np.uint8)
    kind = KIND[b]
    edge = np.zeros(len(b), bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == DIGIT
    quote = np.flatnonzero((b == 0x27) & edge)
    if len(quote):  # short forms after an apostrophe are words of their own
        a, c = b[quote + 1], b[quote + 2]
        one = (a == 0x73) | (a == 0x74) | (a == 0x6D) | (a == 0x64)
        two = ((a == 0x72) | (a == 0x76)) & (c == 0x65) | (a == 0x6C) & (c == 0x6C)
        edge[quote[one | two] + 1] = False
        edge[quote[one] + 2] = True
        edge[quote[two] + 3] = True
    at = np.flatnonzero(edge)
    sizes = np.diff(at, append=len(b))
    word = kind[at] != BLANK
    return at[word], sizes[word]


class WordTable:
    """Ids of words by key: open addressing over arrays, linear probing. It starts
    anew when more than ``most`` words would be in it."""

    def __init__(self, bits: int = 20, most: int = 600_000) -> None:
        self.bits, self.most = bits, most
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.begin, self.size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        self.clear()

    def clear(self) -> None:
        self.low[:] = 0  # no word is all zeros
        self.ids, self.used, self.words = np.zeros(1 << 20, np.uint32), 0, 0

    def append(self, ids: np.ndarray) -> int:
        """Put ids behind those in use; returns where they begin."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        return self.used

    def home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix64(low + mix64(high * GOLDEN + np.uint64(1)))

    def find(self, low: np.ndarray, high: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Slots, -1 where a word isn't there."""
        slot = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.low[slot]
        same = (there == low) & (self.high[slot] == high)
        out = np.where(same, slot, -1)
        todo = np.flatnonzero(~same & (there != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there = self.low[slot]
            same = (there == low[todo]) & (self.high[slot] == high[todo])
            out[todo[same]] = slot[same]
            on = ~same & (there != 0)
            todo, slot = todo[on], slot[on]
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, hashed: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct words that aren't there, with all their ids one after another."""
        begin = self.append(ids) + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.words += len(low)
        slot, todo = (hashed >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(low))
        while len(todo):
            free = self.low[slot] == 0
            got, first = np.unique(slot[free], return_index=True)
            i = todo[free][first]
            self.low[got], self.high[got], self.begin[got], self.size[got] = low[i], high[i], begin[i], sizes[i]
            on = np.ones(len(todo), bool)
            on[np.flatnonzero(free)[first]] = False
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)


def ended(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts, one after another, with the end id behind each text's."""
    ends = np.cumsum(sizes + 1) - 1
    out, own = np.full(len(ids) + len(sizes), end_id, np.uint32), np.ones(len(ids) + len(sizes), bool)
    own[ends] = False
    out[own] = ids
    return out, sizes + 1


class TokenIds:
    """Ids of texts as the tokenizers library gives them, without special tokens."""

    def __init__(self, spec: str, table: WordTable | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # threads of the library only wait for each other in a task's one core
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        parts = json.loads(spec)
        kinds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        pattern = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        suffix = parts["model"].get("end_of_word_suffix")
        self.by_word = kinds == NORMALIZERS and pattern == SPLIT and parts["post_processor"] is None and bool(suffix)
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.largest = max(chain(parts["model"]["vocab"].values(), (t["id"] for t in parts["added_tokens"])))
        self.ends = np.zeros(self.largest + 1, bool)
        if self.by_word:
            self.ends[[i for piece, i in parts["model"]["vocab"].items() if piece.endswith(suffix)]] = True
            self.known = table or WordTable()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has: many words go in
        one text, in which the last id of a word tells that it ends."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            got = self.whole([b" ".join(part).decode("latin-1")])[0]
            last = np.flatnonzero(self.ends[got])
            if len(last) != len(part) or len(got) != last[-1] + 1:
                each = self.whole([w.decode("latin-1") for w in part])
                got, last = np.concatenate(each), np.cumsum([len(x) for x in each]) - 1
            ids.append(got)
            sizes.append(np.diff(last, prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def segment(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of common text as ``split`` takes it, where its words start, and how
        many ids each has."""
        starts, lengths = split(raw)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        low = eight[starts] & FIRST[np.minimum(lengths, 8)]
        high = np.zeros(len(starts), np.uint64)
        over = np.flatnonzero(lengths > 8)
        high[over] = eight[starts[over] + 8] & FIRST[np.minimum(lengths[over] - 8, 8)]
        hashed = self.known.home(low, high)
        slots = self.known.find(low, high, hashed)
        long = np.flatnonzero(lengths > LONGEST)
        slots[long] = 0
        while len(missing := np.flatnonzero(slots < 0)):
            _, first = np.unique(hashed[missing], return_index=True)
            if self.known.words + len(first) > self.known.most and self.known.words:
                self.known.clear()
                slots[:] = -1
                slots[long] = 0
                continue
            new = missing[first]
            ids, sizes = self.of_words([raw[s : s + n] for s, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)])
            self.known.insert(low[new], high[new], hashed[new], ids, sizes)
            slots[missing] = self.known.find(low[missing], high[missing], hashed[missing])
        begins, sizes = self.known.begin[slots], self.known.size[slots]
        if len(long):
            words = [raw[s : s + n] for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)]
            at = {w: i for i, w in enumerate(dict.fromkeys(words))}
            ids, n = self.of_words(list(at))
            which = np.array([at[w] for w in words])
            begins[long], sizes[long] = (self.known.append(ids) + np.cumsum(n) - n)[which], n[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.known.ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(total)], starts, sizes

    def common(self, texts: list[str]) -> list[bytes | None]:
        """Lower-cased Latin-1 bytes of texts of common characters, else None."""
        if not self.by_word:
            return [None] * len(texts)
        try:
            together = "\n".join(texts)
            if len(texts) > 1 and not together.encode("latin-1").translate(None, COMMON) and not any(s in together for s in self.special):
                return [t.encode("latin-1").translate(LOWER) for t in texts]
            raw = [t.encode("latin-1") for t in texts]
            return [None if r.translate(None, COMMON) or any(s in t for s in self.special) else r.translate(LOWER) for r, t in zip(raw, texts, strict=True)]
        except UnicodeEncodeError:
            return [None] if len(texts) == 1 else [x for t in texts for x in self.common([t])]

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        texts = [t or "" for t in texts]
        raw = self.common(texts)
        sizes, parts = np.zeros(len(texts), np.int64), []
        easy = [i for i, r in enumerate(raw) if r is not None]
        if easy:
            joined = b"\n".join([raw[i] for i in easy])
            ends = np.cumsum([len(raw[i]) + 1 for i in easy])
            at = 0
            while at < len(joined):
                to = min(len(joined), at + SEGMENT)
                while to < len(joined) and KIND[joined[to]] != BLANK:  # words aren't cut
                    to += 1
                ids, starts, n = self.segment(b" " + joined[at:to] + b" " * LONGEST)
                upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts - 1 + at, ends)]
                sizes[easy] += np.diff(upto, prepend=0)
                parts.append(ids)
                at = to
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        hard = [i for i, r in enumerate(raw) if r is None]
        if not hard:
            return ids, sizes
        each: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, x in zip(easy, np.split(ids, np.cumsum(sizes[easy])[:-1]) if easy else (), strict=True):
            each[i] = x
        for i, x in zip(hard, self.whole([texts[i] for i in hard]), strict=True):
            each[i], sizes[i] = x, len(x)
        return np.concatenate(each), sizes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        ids, sizes = self.flat(texts)
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes) * 4
        return [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
