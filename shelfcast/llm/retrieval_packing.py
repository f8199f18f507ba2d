"""Packing of related documents into sequences by lexical retrieval.

Documents are dealt to shards of about `SHARD_BYTES` of text by a lexical mark, the smallest hash of
their terms: two documents share it with the probability that their vocabularies overlap, so related
documents mostly meet. Marks fold into `BUCKETS` buckets whose sizes (one number a bucket) are summed
first; small buckets next to each other share a shard, a large one is spread over as many shards as
it needs, by the rows' places. A shard is packed in one task.

A shard's inverted index holds the BM25 impacts of its terms, hashed to 32 bits. A seed document
asks it, by its `QUERY_TERMS` heaviest terms, for documents not used yet, and these fill the window
in order of their scores. A document that crosses the window's end is cut there; its rest opens the
next window and becomes its seed. If nothing related is left, the next unused document in order of
the shard is taken. What remains at a shard's end is cut at powers of two, so no sequence needs
padding.

Rows: null text counts as empty and has the end id alone. A row is a document of its own, keys may
repeat, a null key stays null. Documents without a term that others share are packed in order. Extra
columns are ignored, an empty table gives no rows. `docs` is read twice: rows must come in the same
order both times, as those of a written table do.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import batch, binary, pieces, raw_text
from shelfcast.llm.piece_ids import piece_encoder
from shelfcast.llm.terms import coordinate, terms_of
from shelfcast.llm.tokens import ID

SEQUENCE = 1024
SHARD_BYTES = 6 << 20
BUCKETS = 1 << 16
QUERY_TERMS = 24
#: Neighbours of one answer.
ANSWER = 32
K1, B = 1.2, 0.75
#: What a row counts beside its text.
ROW_BYTES = 64


def lexical_bucket(text: bytes) -> int:
    """The document's mark, folded; 0 without terms."""
    found = set(terms_of(text))
    return (min(map(coordinate, found)) * 0x9E3779B1 >> 12) % BUCKETS if found else 0


class Shards:
    """Which shards take the rows of each bucket."""

    def __init__(self, sizes: np.ndarray, shard_bytes: int):
        self.first, self.ways = np.zeros(BUCKETS, np.int64), np.ones(BUCKETS, np.int64)
        shard, filled = 0, 0
        for bucket in np.flatnonzero(sizes).tolist():
            size = int(sizes[bucket])
            if filled and filled + size > shard_bytes:
                shard, filled = shard + 1, 0
            self.first[bucket] = shard
            if size > shard_bytes:
                self.ways[bucket] = -(-size // shard_bytes)
                shard, filled = shard + int(self.ways[bucket]), 0
            else:
                filled += size

    def of(self, buckets: np.ndarray, places: np.ndarray) -> np.ndarray:
        mixed = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return self.first[buckets] + (mixed >> np.uint64(33)).astype(np.int64) % self.ways[buckets]


def bucket_sizes(docs: DataFrame, text: str) -> np.ndarray:
    """Bytes of each bucket; one number a bucket comes to the driver."""
    schema = pa.schema([("bucket", pa.int32()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in pieces(batches, 0):
            for x in binary(b.column(0)):
                total[lexical_bucket(x)] += len(x) + ROW_BYTES
        some = np.flatnonzero(total)
        yield batch(schema, some.astype(np.int32), total[some])

    sums = docs.select(raw_text(F.col(text)).alias("text")).mapInArrow(run, "bucket int, bytes long")
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).collect():
        out[r["bucket"]] = r["bytes"]
    return out


class LexicalIndex:
    """BM25 postings of a shard's documents, for queries by one of them."""

    def __init__(self, tallies: Iterator[Counter], query_terms: int = QUERY_TERMS):
        terms, counts, sizes, lengths = [], [], [], []
        for tally in tallies:
            n = len(tally)
            terms.append(np.fromiter(map(coordinate, tally), np.uint32, n))
            counts.append(np.fromiter(tally.values(), np.int32, n))
            sizes.append(n)
            lengths.append(int(counts[-1].sum()))
        self.n, self.query_terms = len(sizes), query_terms
        term = np.concatenate(terms) if terms else np.zeros(0, np.uint32)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        term, count, doc = term[order], count[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        holding = np.diff(first, append=len(term))
        shared = np.repeat(holding > 1, holding)  # a term of one document finds none
        count, doc, holding = count[shared], doc[shared], holding[holding > 1]
        self.first = np.concatenate([[0], np.cumsum(holding)])
        number = np.repeat(np.arange(len(holding)), holding)
        length = np.array(lengths, dtype=np.float64)
        mean = max(length.mean(), 1.0) if self.n else 1.0
        rarity = np.log1p((self.n - holding + 0.5) / (holding + 0.5))
        impact = count * (K1 + 1) / (count + K1 * (1 - B + B * length[doc] / mean))
        self.doc, self.impact = doc, (rarity[number] * impact).astype(np.float32)
        # each document's terms, heaviest first
        own = np.lexsort((number, -self.impact, doc))
        self.terms = number[own].astype(np.int32)
        self.begin = np.searchsorted(doc[own], np.arange(self.n + 1))

    def scores(self, doc: int) -> np.ndarray:
        """The score of every document for a query of the document's heaviest terms."""
        asked = self.terms[self.begin[doc] : self.begin[doc + 1]][: self.query_terms]
        lo = self.first[asked]
        size = self.first[asked + 1] - lo
        place = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        return np.bincount(self.doc[place], self.impact[place], self.n)

    def unused(self, doc: int, free: np.ndarray, k: int = ANSWER) -> list[int]:
        """The k best of the documents still free, best first, ties in order; none that shares no term."""
        value = self.scores(doc)
        value[~free] = 0.0
        found = np.flatnonzero(value)
        if len(found) > 4 * k:
            found = found[value[found] >= np.partition(value[found], -k)[-k]]
        return found[np.argsort(-value[found], kind="stable")][:k].tolist()


def fill_windows(sizes: list[int], index: LexicalIndex, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of all pieces; only the last window may be short."""
    free, out = np.ones(len(sizes), dtype=bool), []
    window, filled, following = 0, 0, 0

    def take(doc: int) -> None:
        """All of the document, over as many windows as it crosses."""
        nonlocal window, filled
        free[doc], start = False, 0
        while start < sizes[doc]:
            length = min(sizes[doc] - start, sequence - filled)
            out.append((doc, start, length, window, filled))
            start, filled = start + length, filled + length
            if filled == sequence:
                window, filled = window + 1, 0

    seed, waiting = None, []
    while True:
        if not waiting and seed is not None and filled:
            waiting = index.unused(seed, free)[::-1]
        if waiting:
            doc = waiting.pop()
        else:
            while following < len(sizes) and not free[following]:
                following += 1
            if following == len(sizes):
                return out
            doc = following
        before = window
        take(doc)
        if window != before or seed is None or not waiting:
            seed, waiting = doc, []  # its rest opens the window, or its neighbours go on filling it


def cut_end(placed: list[tuple[int, int, int, int, int]], sequence: int) -> list[tuple[int, int, int, int, int]]:
    """The last window, if short, cut into windows whose lengths are powers of two."""
    last = placed[-1][3] if placed else 0
    total = sum(p[2] for p in placed if p[3] == last)
    if total == sequence:
        return placed
    out, tail = [p for p in placed if p[3] != last], [p for p in placed if p[3] == last]
    room = 1 << (total.bit_length() - 1) if total else 0
    window, filled = last, 0
    for doc, start, length, _, _ in tail:
        while length:
            n = min(length, room - filled)
            out.append((doc, start, n, window, filled))
            start, length, filled, total = start + n, length - n, filled + n, total - n
            if filled == room:
                window, filled = window + 1, 0
                room = 1 << (total.bit_length() - 1) if total else 0
    return out


PIECES = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
]
PIECES_DDL = ", ".join(f"{name} long" for name, _ in PIECES)


def pack_by_retrieval(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    sequence: int = SEQUENCE,
    key: str = "doc_id",
    text: str = "text",
    shard_bytes: int = SHARD_BYTES,
    query_terms: int = QUERY_TERMS,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece; on request with its ids as little-endian bytes."""
    shards = Shards(bucket_sizes(docs, text), shard_bytes)
    schema = pa.schema([*PIECES, *([("ids", pa.binary())] if with_ids else [])])

    @F.arrow_udf("long")
    def shard_of(texts: pa.Array, places: pa.Array) -> pa.Array:
        buckets = np.fromiter(map(lexical_bucket, binary(texts)), np.int64, len(texts))
        return pa.array(shards.of(buckets, places.to_numpy(zero_copy_only=False)))

    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("place"), raw_text(F.col(text)).alias("text")
    )
    rows = rows.withColumn("shard", shard_of("text", "place"))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks()
        shard = rows["shard"][0].as_py()
        keys, texts = rows["key"].combine_chunks(), rows["text"].combine_chunks()
        encoder, ids, ends = piece_encoder(tokenizer), [], []
        for b in pieces(iter([pa.record_batch([texts], ["text"])]), 0):
            found, stop = encoder.encode(b.column(0))
            ids.append(np.insert(found, stop, end_id))
            ends.append(np.diff(stop, prepend=0) + 1)
        encoder.trim()
        ids, sizes = np.concatenate(ids).astype(ID, copy=False), np.concatenate(ends)
        index = LexicalIndex((Counter(terms_of(x)) for x in binary(texts)), query_terms)
        placed = np.array(cut_end(fill_windows(sizes.tolist(), index, sequence), sequence), dtype=np.int64)
        doc, start, length, window, offset = placed.T
        lo = (np.cumsum(sizes) - sizes)[doc] + start
        data = memoryview(ids).cast("B")
        own = [data[ID.itemsize * a : ID.itemsize * b] for a, b in zip(lo.tolist(), (lo + length).tolist())]
        columns = [keys.take(pa.array(doc)), start, length, list(map(zlib.crc32, own)), sizes[doc], (shard << 32) + window, offset]
        return pa.Table.from_batches([batch(schema, *columns, *([[bytes(x) for x in own]] if with_ids else []))])

    return rows.groupBy("shard").applyInArrow(packed, PIECES_DDL + ", ids binary" * with_ids)
