"""Token ids of many texts at once: chunks are found, looked up and joined as arrays.

The texts of an Arrow piece are cut where no token of the tokenizer can reach across. A chunk of up
to 15 bytes, with its length, is two 64-bit numbers; an open-addressing table maps them, exactly, to
the ids that the tokenizers library gave for the chunk when it was first met. Longer chunks go
through a small dict, those over 64 bytes straight to the library. The table holds at most
`ENTRIES` chunks (about 60 MB); when it is full, those met first stay.

A text that holds one of the tokenizer's special strings goes to the library as a whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from shelfcast.llm.tokens import Chunks, SpaceChunks, library_encoder, load_library

SHORT = 15
ENTRIES, KEPT = 700_000, 300_000
SLOT_BITS = 21
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Kinds of bytes: ASCII letters, signs that no token of either tokenizer binds to a letter, white
#: space (also that of other readings), other ASCII, and parts of longer characters.
LETTER, SIGN, SPACE, PLAIN, WIDE = 1, 2, 4, 8, 16
#: ASCII signs that are no part of a special token and never start a contraction.
SIGNS = b".,;:!?#$%&*"
KIND = np.full(256, PLAIN, dtype=np.uint8)
KIND[128:] = WIDE
KIND[[b for b in range(128) if chr(b).isalpha()]] = LETTER
KIND[list(SIGNS)] = SIGN
KIND[[*range(9, 14), *range(28, 33)]] = SPACE


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and the place where each row ends.
    Sixteen zero bytes follow."""
    rows = column.cast(pa.large_binary())
    _, places, data = rows.buffers()
    places = np.frombuffer(places, np.int64)[rows.offset : rows.offset + len(rows) + 1]
    body = np.zeros(int(places[-1] - places[0]) + 16, dtype=np.uint8)
    if data is not None:
        body[:-16] = np.frombuffer(data, np.uint8)[places[0] : places[-1]]
    return body, places[1:] - places[0]


def overlapping_words(body: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as numbers, without a copy."""
    return np.ndarray(len(body) - 7, dtype="<u8", buffer=body, strides=(1,))


class ChunkTable:
    """Exact map from (two 64-bit numbers) to runs of ids."""

    def __init__(self, entries: int = ENTRIES, kept: int = KEPT, slot_bits: int = SLOT_BITS):
        self.limit, self.kept, self.bits = entries, kept, slot_bits
        self.low, self.high = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.start, self.count = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.pool, self.pooled, self.size = np.zeros(4096, np.uint32), 0, 0
        self.slots = np.full(1 << slot_bits, -1, dtype=np.int32)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * FACTORS[1])) * FACTORS[0]
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * FACTORS[2]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        found = np.full(len(low), -1, dtype=np.int32)
        slot, left = self._home(low, high), np.arange(len(low))
        while len(left):
            entry = self.slots[slot]
            same = (entry >= 0) & (self.low[entry] == low[left]) & (self.high[entry] == high[left])
            found[left[same]] = entry[same]
            on = (entry >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return found

    def add(self, low: np.ndarray, high: np.ndarray, values: list[list[int]]) -> None:
        """Keys that are new and distinct."""
        n, flat = len(low), [i for v in values for i in v]
        for name, need in (("low", self.size + n), ("high", self.size + n), ("start", self.size + n), ("count", self.size + n), ("pool", self.pooled + len(flat))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
        own = slice(self.size, self.size + n)
        sizes = np.fromiter(map(len, values), np.int32, n)
        self.low[own], self.high[own], self.count[own] = low, high, sizes
        self.start[own] = self.pooled + np.cumsum(sizes) - sizes
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        self._place(np.arange(self.size, self.size + n, dtype=np.int32))
        self.size, self.pooled = self.size + n, self.pooled + len(flat)

    def _place(self, entries: np.ndarray) -> None:
        slot = self._home(self.low[entries], self.high[entries])
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]  # of entries for one slot, the last stays
            on = self.slots[slot] != entries
            entries, slot = entries[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def trim(self) -> None:
        """Back to the entries met first."""
        self.size = min(self.size, self.kept)
        self.pooled = int(self.start[self.size - 1] + self.count[self.size - 1]) if self.size else 0
        for name, used in (("low", self.size), ("high", self.size), ("start", self.size), ("count", self.size), ("pool", self.pooled)):
            setattr(self, name, getattr(self, name)[: max(used, 1024)].copy())
        self.slots[:] = -1
        self._place(np.arange(self.size, dtype=np.int32))


class PieceEncoder:
    """Encodes the texts of an Arrow column; one for each tokenizer file and worker process."""

    def __init__(self, chunks: Chunks, specials: list[bytes], table: ChunkTable | None = None):
        self.chunks, self.table = chunks, table or ChunkTable()
        self.specials, self.keeps_space = specials, isinstance(chunks, SpaceChunks)

    def _starts(self, body: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which bytes start a chunk, for tokenizers that bind a space to the word after it."""
        kind = KIND[body[: ends[-1]]]
        before, own = kind[:-1], kind[1:]
        cut = np.zeros(len(kind), dtype=bool)
        apart = ((before == LETTER) & (own == SIGN)) | ((before == SIGN) & (own == LETTER))
        gap = (body[1 : ends[-1]] == 32) | (body[1 : ends[-1]] == 10)
        cut[1:] = apart | (gap & (before < SPACE)) | (gap & (before == PLAIN))
        # a line's first letter, where the line feed stands alone
        cut[2:] |= (body[1 : ends[-1] - 1] == 10) & (own[1:] == LETTER) & (kind[:-2] != SPACE) & (kind[:-2] != WIDE)
        # a space after a longer character, unless that is white space itself
        at = np.flatnonzero((body[1 : ends[-1]] == 32) & (before == WIDE)) + 1
        if len(at):
            one, two, three = body[at - 1], body[at - 2], np.where(at > 2, body[at - 3], 0)
            blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
            blank |= (three == 0xE2) & ((two == 0x80) | ((two == 0x81) & (one == 0x9F)))
            blank |= ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
            cut[at[~blank]] = True
        return cut

    def _words(self, body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, which bytes belong to chunks), for tokenizers that drop white space."""
        kind = KIND[body[: ends[-1]]]
        blank = body[: ends[-1]] == 32
        blank |= (body[: ends[-1]] >= 9) & (body[: ends[-1]] <= 13)
        cut = ~blank
        before, own = kind[:-1], kind[1:]
        apart = ((before == LETTER) & (own == SIGN)) | ((before == SIGN) & (own == LETTER))
        cut[1:] &= blank[:-1] | apart
        return cut, blank

    def bounds(self, body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of all chunks; none crosses a text's end."""
        if not ends[-1]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        firsts = np.concatenate([[0], ends[:-1]])
        firsts = firsts[firsts < ends]
        if self.keeps_space:
            cut = self._starts(body, ends)
            cut[firsts] = True
            at = np.flatnonzero(cut)
            return at, np.diff(at, append=ends[-1])
        cut, blank = self._words(body, ends)
        cut[firsts] = ~blank[firsts]
        stop = cut | blank
        stop[firsts] = True
        edges = np.append(np.flatnonzero(stop), ends[-1])
        at = np.flatnonzero(cut)
        return at, edges[np.searchsorted(edges, at) + 1] - at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in a row, and the place where each text's ids end."""
        body, ends = text_buffer(column)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        at, size = self.bounds(body, ends)
        data = body.tobytes()
        special = self._special_texts(data, ends)
        if len(special):
            spans = [(int(ends[i - 1]) if i else 0, int(ends[i])) for i in special]
            inside = np.zeros(len(at), dtype=bool)
            for lo, hi in spans:
                i, j = np.searchsorted(at, [lo, hi])
                inside[i:j] = True
            at, size = at[~inside], size[~inside]
            at, size = np.concatenate([at, [a for a, _ in spans]]), np.concatenate([size, [b - a for a, b in spans]])
            order = np.argsort(at, kind="stable")
            at, size = at[order], size[order]
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        start, count, extra = self._look_up(body, data, at, size)
        stop = np.cumsum(count, dtype=np.int64)
        place = np.arange(stop[-1]) + np.repeat(start - (stop - count), count)
        ids = self.table.pool[place]
        for i, own in extra:
            ids[stop[i] - len(own) : stop[i]] = own
        known = np.searchsorted(at, ends)  # chunks before each text's end
        return ids, np.where(known > 0, stop[known - 1], 0)

    def _special_texts(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        low, hits = data.lower() if b"<|" in data else b"", []
        for s in self.specials if low else ():
            i = low.find(s)
            while i >= 0:
                hits.append(i)
                i = low.find(s, i + 1)
        return np.unique(np.searchsorted(ends, hits, side="right")) if hits else np.zeros(0, np.int64)

    def _look_up(self, body, data, at, size):
        table, words = self.table, overlapping_words(body)
        short = np.flatnonzero(size <= SHORT)
        here, n = at[short], size[short]
        low = words[here] & MASKS[np.minimum(n, 8)]
        high = words[np.minimum(here + 8, len(words) - 1)] & MASKS[np.maximum(n - 8, 0)]
        high |= n.astype(np.uint64) << np.uint64(56)
        entry = table.find(low, high)
        new = np.flatnonzero(entry < 0)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
            once = order[first]
            if table.size + len(once) > table.limit:
                table.trim()
                return self._look_up(body, data, at, size) if len(once) <= table.limit - table.size else self._plainly(data, at, size)
            value = self.chunks.value
            begin = table.size
            table.add(low[once], high[once], [value(data[a : a + k]) for a, k in zip(here[once].tolist(), n[once].tolist())])
            entry[order] = begin + np.cumsum(first) - 1
        start, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        start[short], count[short] = table.start[entry], table.count[entry]
        extra = []
        for i in np.flatnonzero(size > SHORT).tolist():
            own = np.frombuffer(self.chunks[data[at[i] : at[i] + size[i]]], np.uint32)
            extra.append((i, own))
            count[i] = len(own)
        return start, count, extra

    def _plainly(self, data, at, size):
        """A piece with more new chunks than the table takes."""
        extra = [(i, np.frombuffer(self.chunks[data[a : a + k]], np.uint32)) for i, (a, k) in enumerate(zip(at.tolist(), size.tolist()))]
        return np.zeros(len(at), np.int64), np.fromiter((len(x) for _, x in extra), np.int64, len(extra)), extra

    def trim(self) -> None:
        self.chunks.trim()


@cache
def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer file."""
    added = load_library(path).get_added_tokens_decoder().values()
    return PieceEncoder(library_encoder(path), [t.content.lower().encode() for t in added])
