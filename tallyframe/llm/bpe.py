"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string exactly one token can end its encoding: the vocabulary token that is
a suffix of the prefix and stays unmerged next to the last token of what stands before it. Storing
that token for each prefix gives appends without re-encoding, and edits that redo only what follows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUES, buffers, powers, released, steps

#: Distinct pieces and their ids that a worker remembers before it begins anew, pairs of tokens, slots for pairs.
CACHE_PIECES = 250_000
CACHE_IDS = 4_000_000
CACHE_PAIRS = 500_000
PAIR_SLOTS = 1 << 20
#: Tokens that are joined at once.
JOINED = 1 << 16
#: Bytes of pieces in one table of the prefix programme; a longer piece has a table of its own.
TABLE_BYTES = 1 << 18
#: The pattern whose matches follow from the classes of neighbouring characters.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class PrefixEncoder:
    """Encodes single pieces; a piece that is itself a token is that token."""

    def __init__(self, ranks: dict[bytes, int], unmade: frozenset[int] | None = None):
        """unmade: the tokens that merging doesn't build; found here if not given."""
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Every end of a token, with the token that it is itself, or -1.
        self.ends: dict[bytes, int] = {}
        for token in ranks:
            for i in range(1, len(token)):
                self.ends.setdefault(token[i:], -1)
        self.ends.update(ranks)
        self._fits: dict[int, bool] = {}
        self.unmade = unmade
        self._spines: dict[int, tuple[list, list] | None] = {}
        if unmade is None:
            self.unmade = frozenset(x for x in self.tokens if self.spines(x) is None)

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Plain lowest-rank merging down to ``stop`` parts; it takes vocabulary tokens apart."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def spines(self, token: int) -> tuple[list, list] | None:
        """The parts that stood at the left and at the right edge while merging built the token, with
        their ranks; None if merging doesn't build it."""
        if token not in self._spines:
            text, out = self.tokens[token], None
            if len(text) == 1:
                out = ([(text, token)], [(text, token)])
            elif len(parts := self.merge(text, 2)) == 2:
                left, right = (self.spines(self.ranks[x]) for x in parts)
                if left and right:
                    out = ([*left[0], (text, token)], [*right[1], (text, token)])
            self._spines[token] = out
        return self._spines[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when they stand together.

        Both grow towards the seam by rank; a merge across the seam comes first if its rank is below
        that of the left part's next growth and not above that of the right one's.
        """
        key = left << 20 | right
        if (known := self._fits.get(key)) is not None:
            return known
        a, b, i, j, ok, never = self.spines(left)[1], self.spines(right)[0], 0, 0, True, 1 << 60
        while True:
            across = self.ranks.get(a[i][0] + b[j][0], never)
            next_a = a[i + 1][1] if i + 1 < len(a) else never
            next_b = b[j + 1][1] if j + 1 < len(b) else never
            if across < next_a and across <= next_b:
                ok = False
                break
            if next_a == next_b == never:
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self._fits) > CACHE_PAIRS:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def extend(self, text: bytes, last: list[int], start: int) -> None:
        """Fill last[start:], the tokens that end the prefixes text[:start + 1] and longer."""
        ends, pairs, fits, unmade = self.ends, self._fits, self.fits, self.unmade
        del last[start:]
        for end in range(start + 1, len(text) + 1):
            begin = end - 1
            while True:
                token = ends.get(text[begin:end])
                if token is None or begin < 0:
                    raise ValueError(f"no token ends the prefix of {end} bytes")
                if token >= 0 and token not in unmade:
                    if not begin:
                        break
                    left = last[begin - 1]
                    ok = pairs.get(left << 20 | token)
                    if ok or ok is None and fits(left, token):
                        break
                begin -= 1
            last.append(token)

    def read(self, last: list[int]) -> list[int]:
        """The encoding, read from its end."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        return next(iter(self.encode_pieces([piece]).values()))

    def encode_pieces(self, pieces) -> dict[bytes, tuple[int, ...]]:
        """Of many pieces in sorted order, so that each starts from the prefix that it shares."""
        out, before, last = {}, b"", []
        for piece in sorted(pieces):
            if (token := self.ranks.get(piece)) is not None:
                out[piece] = (token,)
                continue
            shared, most = 0, min(len(before), len(piece))
            while shared < most and before[shared] == piece[shared]:
                shared += 1
            self.extend(piece, last, shared)
            out[piece], before = tuple(self.read(last)), piece
        return out


class HashTable:
    """64-bit keys to non-negative ints in levels of plain slots; what collides goes to the next level."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(8, int(len(keys) * 6).bit_length())
            slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            held, value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            held[slot[first]], value[slot[first]] = keys[first], values[first]
            self.levels.append((np.uint64(64 - bits), held, value))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values = keys[left], values[left]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        out, at = np.full(len(keys), -1, np.int32), None
        for shift, held, value in self.levels:
            slot = (keys >> shift).astype(np.int64)
            hit, found = held[slot] == keys, value[slot]
            if at is None:
                np.copyto(out, found, where=hit)
                at = np.flatnonzero(~hit & (found >= 0))
            else:
                out[at[hit]] = found[hit]
                at = at[~hit & (found >= 0)]
            if not len(at):
                break
            keys = keys[~hit & (found >= 0)]
        return out


class BatchEncoder:
    """The same prefix programme for many pieces at once: one column of last tokens after another."""

    def __init__(self, encoder: PrefixEncoder):
        self.ranks = encoder.ranks
        size = max(encoder.tokens) + 1
        depth = max(max(map(len, x)) for t in encoder.tokens if (x := encoder.spines(t)))
        never = 1 << 30
        #: Token at each step of the growth of a token's left and right edge; at -1 it grows no more.
        self.left, self.right = (np.full((size, depth + 1), -1, np.int32) for _ in range(2))
        self.size, self.hash = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        for t, text in encoder.tokens.items():
            self.size[t] = len(text)
            if grown := encoder.spines(t):
                self.left[t, :len(grown[0])] = [x for _, x in grown[0]]
                self.right[t, :len(grown[1])] = [x for _, x in grown[1]]
        self.never = never
        texts = list(encoder.ends)
        self.power = powers(BASE, max(map(len, texts)) + 1)
        hashes = self.hashes(texts)
        of = dict(zip(texts, hashes.tolist()))
        for t, text in encoder.tokens.items():
            self.hash[t] = of[text]
        values = np.array([0 if t < 0 or t in encoder.unmade else t + 1 for t in encoder.ends.values()], np.int32)
        self.ends = HashTable(hashes, values)
        whole = np.array([t + 1 if t >= 0 else 0 for t in encoder.ends.values()], np.int32)
        self.whole = HashTable(hashes[whole > 0], whole[whole > 0] - 1)
        #: Pairs of tokens, doubled, and one if they fit; made in the worker.
        self.pairs: np.ndarray | None = None

    def hashes(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: its byte values times powers that count from the end."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        place = np.repeat(stops, sizes) - 1 - np.arange(len(data))
        return np.add.reduceat(BYTE_VALUES[data] * self.power[place], stops - sizes) if len(texts) else np.zeros(0, np.uint64)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As PrefixEncoder.fits, for pairs; a pair's answer stays in its slot until another takes it."""
        if self.pairs is None:
            self.pairs = np.full(PAIR_SLOTS, -1, np.int64)
        key = left.astype(np.int64) << 31 | right
        slot = ((key * 0x9E3779B97F4A7C1) >> 24) & (PAIR_SLOTS - 1)
        held = self.pairs[slot]
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            some, first, of = np.unique(key[new], return_index=True, return_inverse=True)
            ok = self.stay(left[new[first]], right[new[first]])
            held[new] = (some << 1 | ok)[of]
            self.pairs[slot[new]] = held[new]
        return (held & 1).astype(bool)

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What ``fits`` remembers."""
        ok, at = np.ones(len(left), bool), np.arange(len(left))
        i = j = np.zeros(len(left), np.int64)
        while len(at):
            a, b = self.right[left[at], i], self.left[right[at], j]
            across = self.whole.get(self.hash[a] * self.power[self.size[b]] + self.hash[b])
            across = np.where(across < 0, self.never, across)
            next_a, next_b = self.right[left[at], i + 1], self.left[right[at], j + 1]
            next_a, next_b = (np.where(x < 0, self.never, x) for x in (next_a, next_b))
            breaks = (across < next_a) & (across <= next_b)
            ok[at[breaks]] = False
            more = ~breaks & ((next_a < self.never) | (next_b < self.never))
            grow = next_a <= next_b
            at, i, j = at[more], (i + grow)[more], (j + ~grow)[more]
        return ok

    def encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of ids) of pieces of ``data`` that are not tokens themselves."""
        order = np.argsort(size, kind="stable")
        sizes, counts, parts, i = size[order], np.zeros(len(size), np.int64), [], 0
        while i < len(order):  # pieces of like length share a table, so that a long one doesn't widen it for all
            most = 2 * int(sizes[i])
            j = max(i + 1, min(i + TABLE_BYTES // most, int(np.searchsorted(sizes, most, "right"))))
            rows = order[i:j][::-1]
            ids, counts[rows] = self.table(data, start[rows], size[rows])
            parts.append((rows, ids))
            i = j
        first = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for rows, ids in parts:
            flat[runs(first[rows], counts[rows])] = ids
        return flat, counts

    def table(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for pieces from the longest to the shortest; a row an end, a column a piece."""
        width, n = int(size[0]), len(size)
        values = BYTE_VALUES[data[np.minimum(start + np.arange(width)[:, None], len(data) - 1)]]
        last = np.full((width, n), -1, np.int32)
        reach = np.searchsorted(-size, -np.arange(1, width + 1), "right").tolist()
        for end in range(1, width + 1):
            at, hashed = None, values[end - 1, :reach[end - 1]]
            for begin in range(end - 1, -1, -1):
                if at is not None:
                    shift = end - 1 - begin
                    hashed = hashed + values[begin][at] * self.power[shift] if shift < len(self.power) else hashed
                found = self.ends.get(hashed)
                if at is None:
                    at = np.arange(len(hashed))
                good = np.flatnonzero(found > 0)
                token = found[good] - 1
                if begin and len(good):
                    fit = self.fits(last[begin - 1][at[good]], token)
                    good, token = good[fit], token[fit]
                last[end - 1, at[good]] = token
                more = found >= 0
                more[good] = False
                at, hashed = at[more], hashed[more]
                if not len(at):
                    break
        if (last[size - 1, np.arange(n)] < 0).any():
            raise ValueError("no token ends a prefix")
        places, tokens, left, at = [], [], size.copy(), np.arange(n)
        while len(at):  # each piece is read from its end; all that is read at once is as far from there
            token = last[left[at] - 1, at]
            places.append(at)
            tokens.append(token)
            left[at] -= self.size[token]
            at = at[left[at] > 0]
        counts = np.bincount(np.concatenate(places), minlength=n)
        ends, ids = np.cumsum(counts), np.zeros(int(counts.sum()), np.int32)
        for back, (at, token) in enumerate(zip(places, tokens), 1):
            ids[ends[at] - back] = token
        return ids, counts


class EditableEncoding:
    """The encoding of one piece of bytes under appends and edits."""

    def __init__(self, encoder: PrefixEncoder, text: bytes = b""):
        self.encoder, self.text, self.last = encoder, text, []
        encoder.extend(text, self.last, 0)

    def append(self, more: bytes) -> None:
        start = len(self.text)
        self.text += more
        self.encoder.extend(self.text, self.last, start)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Only prefixes that reach past ``start`` are computed anew."""
        self.text = self.text[:start] + new + self.text[stop:]
        self.encoder.extend(self.text, self.last, start)

    def ids(self) -> list[int]:
        return self.encoder.read(self.last)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@functools.cache
def classes() -> np.ndarray:
    """Of every code point: letter, number, white space or other, as the pattern's engine reads them."""
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0
    every = points.tobytes().decode("utf-32-le")
    out = np.full(len(every), OTHER, np.uint8)
    for kind, some in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for match in regex.finditer(some, every):
            out[match.start():match.end()] = kind
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character in valid UTF-8."""
    out = classes()[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int32) & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
        kind = classes()[point]
        for k in (0, 1, 2, 3):
            out[lead[size > k] + k] = kind[size > k]
    return out


def common_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where matches of COMMON_PATTERN begin in texts of valid UTF-8; they leave nothing out.

    A match begins where the class changes. Of a run of white space, the last character is parted from
    the rest where text follows, and a blank goes with that text. An apostrophe that begins a match is
    one with the letters of a contraction.
    """
    kind = byte_classes(data)
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    texts = offsets[:-1][offsets[:-1] < offsets[1:]]
    after = begins.copy()
    begins[texts] = True
    after[texts] = False
    after = np.flatnonzero(after & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    blank = data[after - 1] == 32
    begins[after[blank]] = False
    last = after - 1
    while (inside := (data[last] & 0xC0) == 0x80).any():
        last = last - inside
    begins[last] = True
    quote = np.flatnonzero((data == 39) & begins)
    if len(quote):
        room = offsets[np.searchsorted(offsets, quote, "right")] - quote
        one, two = (np.where(room > k, data[np.minimum(quote + k, len(data) - 1)], 0) for k in (1, 2))
        short = np.isin(one, list(b"stmd"))
        size = np.where(short, 2, 3 * np.isin(one.astype(np.int32) << 8 | two, [0x7265, 0x7665, 0x6C6C]))
        quote, size, room = (x[size > 0] for x in (quote, size, room))
        begins[quote + 1] = False
        begins[(quote + size)[size < room]] = True
    return np.flatnonzero(begins)


class Tokenizer:
    """Splits by a pattern, encodes every match by itself and decodes ids."""

    def __init__(self, batch: BatchEncoder, pattern: str):
        self.batch, self.pattern, self.common = batch, regex.compile(pattern), pattern == COMMON_PATTERN
        self.tokens = {rank: token for token, rank in batch.ranks.items()}
        #: The bytes of every token by its id, and the digits of every id with a comma.
        self.bytes, self.digits = (Strings([f(x) for x in range(max(self.tokens) + 1)]) for f in (lambda x: self.tokens.get(x, b""), b"%d,".__mod__))
        self.forget()

    def forget(self) -> None:
        #: Number of each piece that is known; where its ids begin among all, and how many they are.
        self.number: dict[bytes, int] = {}
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def split(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches in texts, as (their bytes, where each begins and the last ends, how many begin before
        each text and in all). Bytes that are not UTF-8 are replaced, text by text."""
        if not self.common:
            found = [[x.encode() for x in self.pattern.findall(t) if x] for t in strings(offsets, data)]
            pieces = [x for some in found for x in some]
            return np.frombuffer(b"".join(pieces), np.uint8), sums(map(len, pieces)), sums(map(len, found))
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        try:
            data.tobytes().decode()
            valid = not ((data[starts] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            valid = False
        if not valid:
            texts = [x.encode() for x in strings(offsets, data)]
            offsets, data = sums(map(len, texts)), np.frombuffer(b"".join(texts), np.uint8)
        begins = common_starts(data, offsets)
        return data, np.append(begins, len(data)), np.searchsorted(begins, offsets)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]):
        """The ids of each text; what is new in any of them is encoded together."""
        raw = [x.encode() for x in texts]
        ids, bounds = self.encode_bytes(sums(map(len, raw)), np.frombuffer(b"".join(raw), np.uint8))
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[i:j].tolist()

    def encode_bytes(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last ones end)."""
        data, edges, texts = self.split(offsets, data)
        if len(edges) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        of = pieces.indices.to_numpy()
        known = self.numbers(*buffers(pieces.dictionary))
        first, count = self.first[known], self.count[known]
        counts = count[of]
        return self.ids[runs(first[of], counts)], np.append(0, np.cumsum(counts))[texts]

    def numbers(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The numbers of distinct pieces; what is new is encoded."""
        if len(self.number) > CACHE_PIECES or len(self.ids) > CACHE_IDS:
            self.forget()
        raw, at = data.tobytes(), offsets.tolist()
        pieces = [raw[i:j] for i, j in zip(at, at[1:])]
        out = np.array([self.number.get(x, -1) for x in pieces], np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            whole = np.array([self.batch.ranks.get(pieces[i], -1) for i in new.tolist()], np.int64)
            token, cut = whole[whole >= 0], new[whole < 0]
            ids, counts = self.batch.encode(data, offsets[cut], offsets[cut + 1] - offsets[cut])
            names = np.concatenate([new[whole >= 0], cut])
            count = np.concatenate([np.ones(len(token), np.int64), counts])
            out[names] = len(self.number) + np.arange(len(names))
            self.number.update(zip([pieces[i] for i in names.tolist()], out[names].tolist()))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, token.astype(np.int32), ids])
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Strings:
    """Byte strings by number, to be joined many at a time."""

    def __init__(self, strings: list[bytes]):
        self.bounds, self.data = sums(map(len, strings)), np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.diff(self.bounds)

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes, where each string begins and the last ends)."""
        size = self.size[numbers]
        return self.data[runs(self.bounds[numbers], size)], np.append(0, np.cumsum(size))

    def hashes(self, numbers: np.ndarray, bounds: np.ndarray, cut: int = 0) -> list[str]:
        """SHA-256 in hex of what each range of numbers joins to, without its last ``cut`` bytes; of a
        long range, a part at a time."""
        out = []
        for i, j in steps(bounds, JOINED):
            if bounds[j] - bounds[i] <= JOINED:
                joined, ends = self.join(numbers[bounds[i]:bounds[j]])
                at = ends[bounds[i:j + 1] - bounds[i]].tolist()
                out += [hashlib.sha256(joined[a:max(a, b - cut)]).hexdigest() for a, b in zip(at, at[1:])]
                continue
            whole = hashlib.sha256()
            for k in range(bounds[i], bounds[j], JOINED):
                joined, _ = self.join(numbers[k:min(k + JOINED, bounds[j])])
                whole.update(joined[:len(joined) - cut * (k + JOINED >= bounds[j])])
            out.append(whole.hexdigest())
        return out


def sums(sizes) -> np.ndarray:
    """0 and the running sums."""
    return np.append(0, np.cumsum(np.fromiter(sizes, np.int64)))


def strings(offsets: np.ndarray, data: np.ndarray) -> list[str]:
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:])]


_ready: dict[str, Tokenizer] = {}


def tokenizer(key: str, table, pattern: str) -> Tokenizer:
    """The worker's tokenizer of a broadcast encoder; made once in each Python worker."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = Tokenizer(table.value, pattern)
    return _ready[key]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, token_ids.

    A null or empty text has no tokens. Every text is encoded whole; the rank table (a vocabulary
    file, of fixed size) is read on the driver and broadcast. New columns replace like-named ones.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(BatchEncoder(PrefixEncoder(read_ranks(ranks_path))))
    key = uuid.uuid4().hex
    new = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"token_ids": pa.list_(pa.int32())} if ids else {})
    keep = [c for c in docs.columns if c not in new]

    def encoded(tok, part):
        """A few texts at a time, so that neither pieces nor ids of a whole batch are held."""
        offsets, data = buffers(part.column(text_col))
        flat, bounds = tok.encode_bytes(offsets - offsets[0], data[offsets[0]:offsets[-1]])
        out = {"n_tokens": pa.array(np.diff(bounds), pa.int64())}
        out["ids_sha256"] = pa.array(tok.digits.hashes(flat, bounds, 1), pa.string())
        out["decoded_sha256"] = pa.array(tok.bytes.hashes(flat, bounds), pa.string())
        if ids:
            out["token_ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [out[c] for c in new], [*keep, *new])

    def run(batches):
        tok = tokenizer(key, table, pattern)
        for batch in batches:
            for i, j in steps(buffers(batch.column(text_col))[0]):
                yield encoded(tok, batch.slice(i, j - i))
        _ready.clear()

    schema = ", ".join([f"`{c}` {dict(docs.dtypes)[c]}" for c in keep] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["token_ids array<int>"] * ids)
    return docs.select(*keep).mapInArrow(released(run), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
