"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text becomes words: runs of the blank sign with what follows them, which letters
and other signs share only if a piece has both. Where they don't, words of Latin-1
texts are found by numpy, many texts at once, and those of up to sixteen signs are
their own keys in a hash table that the worker keeps; other texts are split by a
regular expression. Distinct words of equal length form a matrix and advance
together, one code point at a time. Hashes of all substrings that end there probe the sorted keys of the
pieces, and a vectorised maximum stores the backpointer.

In a unigram model the maximum is of summed scores. In a byte-pair model the
path must be the one that merging would give. That holds exactly if any two
neighbours on the path, merged on their own, come out as those two pieces, so a
table of such neighbours (of fixed size, filled by undoing the merges at the seam
of batches of pairs) admits or forbids every step, and a single path is left. Ids are those of the
sentencepiece library for both kinds of model.

Defined results. Null text: null ids (and null again when decoded). Empty text:
no ids. A code point that no piece has becomes its UTF-8 bytes where the model
has byte pieces, else the unknown piece. A text decodes to itself, but for the
blank sign U+2581, which decodes to a space, and unknown pieces. Of unigram paths
with the same score (ties) the one whose last pieces are shorter is taken.
Repeated rows have the same ids; very long texts are encoded whole, a long word
without blanks one code point at a time. Ids are little-endian unsigned 32-bit
integers in a binary column. Only the column that is named is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzfolio.llm.common import Remembered, kept_by_worker, mix64
from quartzfolio.llm.tokens import FIRST, LONGEST, WordTable

BLANK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C55)
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
FILTER_BITS, SLOT_BITS = 20, 20
NEVER = np.int64(2**62)
#: Words that a worker remembers, twice; longer words aren't kept.
REMEMBERED, LONGEST_KEPT = 300_000, 40
#: Rows of a matrix, and the size beyond which it is split.
MOST_ROWS, MOST_CELLS = 20_000, 2_000_000
#: Kinds of signs; bytes of texts, and words, that are looked up at once.
SPACE, LINE, LETTER, SIGN = range(4)
TOGETHER, MOST_WORDS = 2_000_000, 1 << 18


def rolling(c: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row: column i is that of the first i code points."""
    out = np.zeros((c.shape[0], c.shape[1] + 1), np.uint64)
    for i in range(c.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + c[:, i] + np.uint64(1)
    return out


def text_hash(s: str) -> int:
    h = 0
    for ch in s:
        h = (h * int(BASE) + ord(ch) + 1) % 2**64
    return h


@dataclass
class Model:
    """A vocabulary as arrays. Symbols are its pieces and then those code points
    that only occur inside pieces."""

    kind: int
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    keys: np.ndarray = field(init=False)
    key_ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.digest = hashlib.sha256(repr((self.kind, self.pieces, self.scores.tolist())).encode()).hexdigest()
        self.usable = [i for i, t in enumerate(self.types.tolist()) if t in (NORMAL, USER)]
        symbols = {self.pieces[i]: i for i in self.usable}
        inner = sorted({ch for p in symbols for ch in p} - symbols.keys())
        self.n_pieces = len(self.pieces)
        self.symbols = symbols | {ch: self.n_pieces + i for i, ch in enumerate(inner)}
        self.longest = max(map(len, symbols), default=1)
        hashes = mix64(np.array([text_hash(p) for p in self.symbols], np.uint64))
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(list(self.symbols.values()), np.int64)[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.sizes = np.array([*map(len, self.pieces), *[1] * len(inner)], np.int64)
        self.weight = np.concatenate([self.scores, np.full(len(inner), -np.inf)])
        least = float(self.scores[self.usable].min()) if self.usable else 0.0
        self.unknown_score = least - 10
        self.unknown = next((i for i, t in enumerate(self.types.tolist()) if t == UNKNOWN), 0)
        of_byte = {int(self.pieces[i][3:5], 16): i for i, t in enumerate(self.types.tolist()) if t == BYTE}
        self.bytes = [of_byte[b] for b in range(256)] if len(of_byte) == 256 else None
        self.line_alone = not any("\n" in p for p in symbols)
        line = "\n" if self.line_alone else ""
        digits = re.escape("".join(sorted({ch for p in symbols for ch in p if ch.isalnum() and not ch.isalpha()})))  # no letters, though words hold them
        letter, sign = rf"[^\W\d_{digits}]", rf"[\W\d_{digits}]"
        crossing = re.compile(f"{letter}(?!{BLANK}){sign}|(?!{BLANK}){sign}{letter}")
        self.signs_alone = self.bytes is not None and not any(crossing.search(p) for p in symbols)
        self.by_kind = self.signs_alone and self.line_alone
        self.kinds = np.array([{" ": SPACE, "\n": LINE}.get(chr(c), LETTER if re.match(letter, chr(c)) else SIGN) for c in range(256)], np.uint8)
        runs = [f"{letter}+", f"(?:(?![{BLANK}{line}]){sign})+"] if self.signs_alone else [f"[^{BLANK}{line}]+"]
        self.words = re.compile("|".join([f"{BLANK}*{r}" for r in runs] + [f"{BLANK}+", *line]))
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in symbols):
            raise ValueError("a piece goes on over a blank; words can't be told apart")
        self.plain = [p.replace(BLANK, " ").encode() if t in (NORMAL, USER) else bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else b"" for p, t in zip(self.pieces, self.types.tolist(), strict=True)]
        rank = {s: r for r, s in enumerate(sorted(set(self.scores.tolist()), reverse=True))}
        merges = {}
        if self.kind == BPE:
            for i in self.usable:
                p = self.pieces[i]
                for k in range(1, len(p)):
                    a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                    if a is not None and b is not None:
                        merges[a << 32 | b] = (rank[float(self.scores[i])], i)
        pairs = sorted(merges)
        self.pair_keys = np.array(pairs or [-1], np.int64)
        self.pair_ranks = np.array([merges[k][0] for k in pairs] or [NEVER], np.int64)
        self.pair_ids = np.array([merges[k][1] for k in pairs] or [-1], np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each substring hash, else -1."""
        h = mix64(hashes)
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        out[maybe[hit]] = self.key_ids[at[hit]]
        return out

    def merged(self, symbols: np.ndarray, halves: np.ndarray | None = None) -> np.ndarray:
        """Rows of symbols (padded with -1) after all merges, best first and
        leftmost among equals. ``halves`` is given the two symbols before the last
        merge of rows that come down to two."""
        out = symbols.copy()
        live, s = np.arange(len(symbols)), symbols.copy()
        while len(live) and s.shape[1] > 1:
            if s.shape[1] == 2 and halves is not None:
                halves[live] = s
            key = np.where((s[:, 1:] >= 0) & (s[:, :-1] >= 0), s[:, :-1] << 32 | s[:, 1:], -2)
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            m = rank.argmin(axis=1)
            r = np.arange(len(s))
            on = rank[r, m] < NEVER
            out[live[~on], : s.shape[1]] = s[~on]
            live, s, at, m = live[on], s[on], at[on], m[on]
            s[np.arange(len(s)), m] = self.pair_ids[at[np.arange(len(s)), m]]
            cols = np.arange(s.shape[1] - 1)
            s = np.take_along_axis(s, cols + (cols > m[:, None]), axis=1)
            out[live, s.shape[1]] = -1
        if len(live):
            out[live, : s.shape[1]] = s
        return out


class Encoder:
    """Encodes batches of texts; keeps what it learned of words and neighbours."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.known: Remembered = Remembered(REMEMBERED)
        self.short = WordTable(most=2 * REMEMBERED)
        self.slot_keys, self.slot_ok = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)
        names = {i: s for s, i in model.symbols.items()}
        self.chars_of = {i: [model.symbols[ch] for ch in s] for i, s in names.items()}
        if model.kind == BPE:
            self.grow_trees()

    def grow_trees(self) -> None:
        """Of each symbol whether merging makes it (``stable``), from which two
        (``halves``; -1: a code point), at which rank (-1 then), and whether ranks
        only grow on the way (``sorted``)."""
        m = self.m
        n = len(m.weight)
        self.stable, self.halves = np.ones(n, bool), np.full((n, 2), -1, np.int64)
        by_size: dict[int, list[int]] = {}
        for i in m.usable:
            by_size.setdefault(len(self.chars_of[i]), []).append(i)
        for size, ids in by_size.items():
            halves = np.full((len(ids), 2), -1, np.int64)
            got = m.merged(np.array([self.chars_of[i] for i in ids], np.int64), halves)
            self.stable[ids] = (got[:, 0] == ids) & ((got[:, 1] == -1) if size > 1 else True)
            self.halves[ids] = halves
        self.halves[~self.stable] = -1
        self.made = np.full(n, -1, np.int64)
        whole = np.flatnonzero(self.halves[:, 0] >= 0)
        self.made[whole] = self.rank_of(self.halves[whole, 0], self.halves[whole, 1])
        self.sorted = self.stable.copy()
        for i in whole[np.argsort(m.sizes[whole], kind="stable")].tolist():  # halves are shorter
            a, b = self.halves[i].tolist()
            self.sorted[i] = self.sorted[a] and self.sorted[b] and self.made[i] > max(self.made[a], self.made[b])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two symbols, ``NEVER`` if there is none."""
        m, key = self.m, left << 32 | right
        at = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
        return np.where(m.pair_keys[at] == key, m.pair_ranks[at], NEVER)

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two symbols, merged on their own, stay these two. Where ranks only
        grow, merges go by rank, so only those at the seam count, which are undone
        from the last one: two symbols that meet there merge if that comes before the
        next merge that takes one of them; of equal ranks the left one comes first."""
        ok = np.ones(len(left), bool)
        plain = self.sorted[left] & self.sorted[right]
        live, a, b = np.flatnonzero(plain), left[plain], right[plain]
        limit = np.full(len(live), NEVER)
        while len(live):
            apart = self.rank_of(a, b) >= limit
            ok[live[~apart]] = False
            go = apart & ((self.made[a] >= 0) | (self.made[b] >= 0))
            live, a, b = live[go], a[go], b[go]
            first = self.made[a] > self.made[b]
            limit = np.where(first, self.made[a], self.made[b] + 1)
            a, b = np.where(first, self.halves[a, 1], a), np.where(first, b, self.halves[b, 0])
        rest = np.flatnonzero(~plain)
        by_size: dict[int, list[int]] = {}
        chars = {i: [*self.chars_of[int(left[i])], *self.chars_of[int(right[i])]] for i in rest.tolist()}
        for i, x in chars.items():
            by_size.setdefault(len(x), []).append(i)
        for n, rows in by_size.items():
            got = self.m.merged(np.array([chars[i] for i in rows], np.int64))
            ok[rows] = (got[:, 0] == left[rows]) & (got[:, 1] == right[rows]) & ((got[:, 2] == -1) if n > 2 else True)
        return ok

    def neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two symbols, merged on their own, stay these two."""
        key = left << 32 | right
        slot = (mix64(key.astype(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = self.slot_keys[slot] == key
        out = self.slot_ok[slot]
        if hit.all():
            return out
        rest = np.flatnonzero(~hit)
        new, which = np.unique(key[rest], return_inverse=True)
        out[rest] = self.stay_apart(new >> 32, new & 0xFFFFFFFF)[which]
        self.slot_keys[slot[rest]] = key[rest]
        kept = self.slot_keys[slot[rest]] == key[rest]  # of two keys in one slot the last
        self.slot_ok[slot[rest[kept]]] = out[rest[kept]]
        return out

    def paths(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length."""
        m, n, size = self.m, len(words), len(words[0])
        c = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, size).astype(np.uint64)
        prefix = rolling(c)
        power = np.multiply.accumulate(np.array([1, *[BASE] * m.longest], np.uint64))
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        last = np.full((n, size + 1), -1, np.int64)  # symbol that ends here
        back = np.zeros((n, size + 1), np.int32)
        for i in range(1, size + 1):
            deep = min(i, m.longest)
            ends = prefix[:, i, None] - prefix[:, i - deep : i][:, ::-1] * power[1 : deep + 1]  # column k - 1: the last k code points
            symbol = m.find(ends.ravel()).reshape(n, deep)
            unknown = symbol[:, 0] < 0
            rows, less = np.nonzero((symbol >= 0) & (best[:, i - deep : i][:, ::-1] > -np.inf))
            t, k = symbol[rows, less], less + 1
            if (m.sizes[t] != k).any():  # a hash of another length
                rows, t, k = (x[m.sizes[t] == k] for x in (rows, t, k))
            if m.kind == BPE:  # one way at most is admitted
                ok = self.stable[t]
                before = last[rows, i - k]
                check = np.flatnonzero(ok & (before >= 0))
                ok[check] = self.neighbours(before[check], t[check])
                r, t, k = rows[ok], t[ok], k[ok]
                best[r, i], last[r, i], back[r, i] = 0.0, t, k
            else:
                value = np.where(t < m.n_pieces, best[rows, i - k] + m.weight[t], -np.inf)
                order = np.lexsort((-k, value, rows))  # of each row the greatest value, then the shortest piece, comes last
                rows, t, k, value = rows[order], t[order], k[order], value[order]
                top = np.flatnonzero(np.append(rows[1:] != rows[:-1], True) & (value > -np.inf)) if len(rows) else order
                r = rows[top]
                best[r, i], last[r, i], back[r, i] = value[top], t[top], k[top]
            lone = unknown if m.kind == BPE else (best[:, i] == -np.inf) | unknown
            value = best[:, i - 1] + (0.0 if m.kind == BPE else m.unknown_score)
            r = np.flatnonzero(lone & (value > best[:, i]))
            best[r, i], last[r, i], back[r, i] = value[r], -1, 1
        at, live = np.full(n, size), np.arange(n)
        rows_, symbols_ = [], []
        while len(live):
            rows_.append(live)
            symbols_.append(last[live, at[live]])
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        row, symbol = np.concatenate(rows_)[::-1], np.concatenate(symbols_)[::-1]
        order = np.argsort(row, kind="stable")
        row, symbol = row[order], symbol[order]
        ends = np.cumsum(np.bincount(row, minlength=n))
        flat = symbol.astype("<u4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for i in np.unique(row[(symbol < 0) | (symbol >= m.n_pieces)]).tolist():
            out[i] = np.array(self.ids(words[i], symbol[ends[i - 1] if i else 0 : ends[i]].tolist()), "<u4").tobytes()
        return out

    def ids(self, word: str, path: list[int]) -> list[int]:
        """Ids of a path; where it has no piece (-1 stands for an unknown code
        point), bytes or the unknown piece."""
        m, out, at = self.m, [], 0
        for t in path:
            size = len(m.pieces[t]) if 0 <= t < m.n_pieces else 1
            if 0 <= t < m.n_pieces:
                out.append(t)
            elif m.bytes is not None:
                out += [m.bytes[b] for b in word[at : at + size].encode()]
            elif not (out and out[-1] == m.unknown):  # unknown neighbours are one
                out.append(m.unknown)
            at += size
        return out

    def matrices(self, words: Iterable[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """Words with their ids, in parts of one length."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, group in sorted(by_size.items()):
            step = max(1, min(MOST_ROWS, MOST_CELLS // size))
            for a in range(0, len(group), step):
                yield group[a : a + step], self.paths(group[a : a + step])

    def of_words(self, split: list[list[str]]) -> list[bytes]:
        """Ids of texts that are lists of words."""
        missing = self.known.missing(set().union(*split))
        for words, ids in self.matrices(missing):
            self.known.update(zip(words, ids, strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for w in [w for w in missing if len(w) > LONGEST_KEPT]:
            del self.known[w]
        return out

    def of_keys(self, raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin-1 text, one after another, and how many each has."""
        known, blanks = self.short, raw.decode("latin-1").replace(" ", BLANK)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        low = eight[starts] & FIRST[np.minimum(lengths, 8)]
        high = np.zeros(len(starts), np.uint64)
        over = np.flatnonzero(lengths > 8)
        high[over] = eight[starts[over] + 8] & FIRST[np.minimum(lengths[over] - 8, 8)]
        hashed = known.home(low, high)
        slots = known.find(low, high, hashed)
        long = np.flatnonzero(lengths > LONGEST)
        slots[long] = 0
        while len(missing := np.flatnonzero(slots < 0)):
            new = missing[np.unique(hashed[missing], return_index=True)[1]]
            if known.words + len(new) > known.most and known.words:
                known.clear()
                slots[:] = -1
                slots[long] = 0
                continue
            at = {blanks[s : s + n]: i for i, s, n in zip(new.tolist(), starts[new].tolist(), lengths[new].tolist(), strict=True)}
            for words, ids in self.matrices(at):
                i = np.array([at[w] for w in words])
                known.insert(low[i], high[i], hashed[i], np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids]))
            slots[missing] = known.find(low[missing], high[missing], hashed[missing])
        begins, sizes = known.begin[slots], known.size[slots]
        if len(long):
            ids = self.of_words([[blanks[s : s + n]] for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)])
            n = np.array([len(x) // 4 for x in ids])
            begins[long], sizes[long] = known.append(np.frombuffer(b"".join(ids), "<u4")) + np.cumsum(n) - n, n
        ends = np.cumsum(sizes)
        return known.ids[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])], sizes

    def latin(self, texts: list[bytes]) -> list[bytes]:
        """Ids of Latin-1 texts that aren't empty and have no null sign."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw = b" " + b" ".join(texts)
        kind = self.m.kinds[np.frombuffer(raw, np.uint8)]
        edge, here, before = np.ones(len(raw), bool), kind[1:], kind[:-1]
        edge[1:] = (here == LINE) | (before == LINE) | (before != SPACE) & (here != before)
        edge[ends[:-1]] = True  # the blank before each text
        starts = np.flatnonzero(edge)
        lengths = np.diff(starts, append=len(raw))
        parts, sizes = [], []
        for a in range(0, len(starts), MOST_WORDS):
            s, n = starts[a : a + MOST_WORDS], lengths[a : a + MOST_WORDS]
            ids, k = self.of_keys(raw[s[0] : s[-1] + n[-1]] + b" " * LONGEST, s - s[0], n)
            parts.append(ids.astype("<u4").tobytes())
            sizes.append(k)
        upto = 4 * np.cumsum(np.concatenate(sizes))[np.searchsorted(starts, ends) - 1]
        flat = b"".join(parts)
        return [flat[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        out: list[bytes | None] = [None if t is None else b"" for t in texts]
        rest, batch, size = [], {}, 0
        for i, t in enumerate(texts):
            if not t:
                continue
            try:
                raw = t.encode("latin-1") if self.m.by_kind and "\0" not in t else None
            except UnicodeEncodeError:
                raw = None
            if raw is None:
                rest.append(i)
                continue
            batch[i] = raw
            size += len(raw)
            if size > TOGETHER:
                for k, ids in zip(batch, self.latin(list(batch.values())), strict=True):
                    out[k] = ids
                batch, size = {}, 0
        for k, ids in zip(batch, self.latin(list(batch.values())) if batch else (), strict=True):
            out[k] = ids
        split = [self.m.words.findall(BLANK + texts[i].replace(" ", BLANK)) for i in rest]
        for i, ids in zip(rest, self.of_words(split), strict=True):
            out[i] = ids
        return out


def load(path: str) -> Model:
    """Read a model file. Only the identity normaliser is supported, with the
    leading blank that sentencepiece adds."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("only models with the identity normaliser and a leading blank are supported")
    if proto.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and byte-pair models are supported")
    return Model(proto.trainer_spec.model_type, [p.piece for p in proto.pieces], np.array([p.score for p in proto.pieces], np.float64), np.array([p.type for p in proto.pieces], np.int64))


def decode(model: Model, ids: bytes | None) -> str | None:
    if ids is None:
        return None
    plain = model.plain
    s = b"".join([plain[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")
    return s[1:] if s.startswith(" ") else s


def encoded(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Ids of the texts of a column of ``docs``, in a binary column."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary, of fixed size
    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        model_encoder = kept_by_worker("pieces", shipped.value.digest, lambda: Encoder(shipped.value))
        out: list[bytes | None] = []
        for at in range(0, len(column), 2000):
            out += model_encoder.encode(column.slice(at, 2000).to_pylist())
        return pa.array(out, pa.binary())

    return run(F.col(text))


def decoded(docs: DataFrame, model: Model, ids: str = "ids") -> Column:
    """Texts of the ids in a binary column of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([decode(shipped.value, b) for b in column.to_pylist()], pa.string())

    return run(F.col(ids))
