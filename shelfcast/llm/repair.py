"""Token-id shards under a Re-Pair grammar, written as Parquet and decoded at random positions.

A shard holds about `shard_ids` ids of consecutive documents. Frequent pairs of neighbouring symbols
are replaced by nonterminals, round after round, until no pair occurs `min_count` times; a round takes
all frequent pairs at once, and of overlapping ones the more frequent. A shard
stores its rules, their expansion lengths, the remaining sequence and the documents' lengths.
Sums of expansion lengths tell where any position lies, so a range decodes only the symbols that
cover it.

Shards are Parquet rows, written by Spark's committer to any file system; a lost task repeats
without leaving half a shard.

Rows: null text counts as empty and has the end id alone. Rows go in ascending key order, null keys
first; rows of equal key are dealt over as many partitions as they fill, in order of their ids within
each. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import KeyRanges, batch, long_or_null, pieces, raw_text
from shelfcast.llm.piece_ids import piece_encoder
from shelfcast.llm.tokens import ID
from shelfcast.session import scratch_folder

SHARD_IDS = 1 << 20
MIN_COUNT = 16
#: Hash of a pair to a bucket; a bucket met less than `min_count` times holds no frequent pair.
MIX, BUCKET_BITS = np.uint64(0x9E3779B97F4A7C15), 18
#: Symbols below are token ids; nonterminals count from here.
FIRST_RULE = 1 << 16


def smallest(values: np.ndarray) -> np.ndarray:
    """Unsigned, in as few bytes as the largest value takes."""
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def _places(sequence: np.ndarray, at: np.ndarray, symbols: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, places): of the pairs at the given places, those that occur `min_count` times
    and, pair by pair, where. Of a run of one symbol every second place counts."""
    bits = int(symbols).bit_length()
    left, right = sequence[at].astype(np.uint64), sequence[at + 1].astype(np.uint64)
    key = (left << np.uint64(bits)) | right
    bucket = ((key * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    often = np.bincount(bucket, minlength=1 << BUCKET_BITS) >= min_count  # other pairs can't be frequent
    use = often[bucket]
    runs = np.flatnonzero(left == right)
    if len(runs):  # all places of a run are among those given, or none
        first = np.concatenate([[True], np.diff(at[runs]) > 1])
        start = np.maximum.accumulate(np.where(first, at[runs], 0))
        use[runs[(at[runs] - start) % 2 == 1]] = False
    key, at = key[use], at[use]
    width = int(len(sequence)).bit_length()
    if 2 * bits + width <= 64:
        packed = np.sort((key << np.uint64(width)) | at.astype(np.uint64))
        key, at = packed >> np.uint64(width), (packed & np.uint64((1 << width) - 1)).astype(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(edge, append=len(key))
    kept = np.repeat(count >= min_count, count)
    return key[edge[count >= min_count]], count[count >= min_count], at[kept]


def build_grammar(ids: np.ndarray, first: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rule k has the symbol first + k and replaces the pair rules[k].

    A round counts every pair of neighbours and ranks those that occur `min_count` times, the most
    frequent first. A place is replaced where its pair ranks before those that overlap it; a pair
    that keeps `min_count` places becomes a rule. The first in rank keeps all its places, so each
    round makes a rule, until no pair occurs `min_count` times."""
    sequence, rules, following = ids.astype(np.int32), [], first
    open_places = np.arange(len(sequence) - 1)
    while len(open_places):
        keys, counts, places = _places(sequence, open_places, following, min_count)
        if not len(keys):
            break
        rank = np.empty(len(keys), dtype=np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys), dtype=np.int32)
        pair = np.full(len(sequence) + 1, len(keys), dtype=np.int32)
        pair[places + 1] = np.repeat(rank, counts)
        at = np.flatnonzero((pair[1:-1] < pair[:-2]) & (pair[1:-1] < pair[2:]))
        own = pair[at + 1]
        good = np.bincount(own, minlength=len(keys)) >= min_count
        symbol = (following - 1 + np.cumsum(good)).astype(np.int32)
        at, own = at[good[own]], own[good[own]]
        # only pairs with a new symbol, or frequent and not replaced, can be frequent from now on
        may = pair[1:] < len(keys)
        may[at] = False
        may[:-1] |= sequence[1:] == sequence[:-1]
        sequence[at] = symbol[own]
        may[at] = may[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(sequence), dtype=bool)
        keep[at + 1] = False
        may[at + 1] = False
        sequence, may = sequence[keep], may[keep]
        open_places = np.flatnonzero(may[:-1])
        ranked = np.empty(len(keys), dtype=np.uint64)
        ranked[rank] = keys
        bits = np.uint64(int(following).bit_length())
        chosen = ranked[good]
        rules.append(np.stack([chosen >> bits, chosen & np.uint64((1 << int(bits)) - 1)], axis=1).astype(np.int64))
        following += len(chosen)
    return sequence, np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    sizes = np.ones(first + len(rules), dtype=np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        sizes[first + k] = sizes[a] + sizes[b]
    return sizes[first:]


class Shard:
    """Decodes any range of a stored shard."""

    def __init__(self, first: int, rules: bytes, lengths: bytes, sequence: bytes, rule_size: int, symbol_size: int):
        self.first = first
        self.rules = np.frombuffer(rules, f"<u{rule_size}").reshape(-1, 2).astype(np.int64)
        self.sequence = np.frombuffer(sequence, f"<u{symbol_size}").astype(np.int32)
        own = np.frombuffer(lengths, "<u4")
        flat: list[np.ndarray] = []
        for a, b in self.rules.tolist():
            flat.append(np.concatenate([flat[x - first] if x >= first else np.array([x]) for x in (a, b)]))
        # expansion of each symbol: its place in `flat` and its length; an id expands to itself
        self.flat = np.concatenate([np.arange(first, dtype=ID), *(x.astype(ID) for x in flat)])
        self.sizes = np.concatenate([np.ones(first, dtype=np.int32), own.astype(np.int32)])
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.ends = np.cumsum(self.sizes[self.sequence])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids at positions start to stop - 1."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, dtype=ID)
        lo, hi = np.searchsorted(self.ends, [start, stop - 1], side="right")
        some = self.sequence[lo : hi + 1]
        sizes = self.sizes[some]
        begin = int(self.ends[lo]) - int(sizes[0])
        shift = self.starts[some] - (np.cumsum(sizes, dtype=np.int32) - sizes)
        places = np.arange(int(sizes.sum()), dtype=np.int32) + np.repeat(shift, sizes)
        return self.flat[places][start - begin : stop - begin]


SHARDS = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("start_in_part", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_lengths", pa.list_(pa.int64())),
        ("first_rule", pa.int32()),
        ("rules", pa.binary()),
        ("rule_size", pa.int32()),
        ("lengths", pa.binary()),
        ("sequence", pa.binary()),
        ("symbol_size", pa.int32()),
    ]
)
SHARD_DDL = (
    "part int, shard int, start_in_part long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
    "first_rule int, rules binary, rule_size int, lengths binary, sequence binary, symbol_size int"
)


def encoded(docs: DataFrame, ranges: KeyRanges, tokenizer: str, end_id: int, key: str, text: str) -> DataFrame:
    """(part, key, ids): token ids of each row with the end id, as little-endian bytes."""
    rows = docs.select(F.col(key).cast("long").alias("key"), raw_text(F.col(text)).alias("text"))
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer)
        place = TaskContext.get().partitionId() << 40  # which a repeated task numbers alike
        for b in pieces(batches, 1):
            part = ranges.spread(*long_or_null(b.column(0)), np.arange(place, place + b.num_rows))
            place += b.num_rows
            ids, ends = encoder.encode(b.column(1))
            ids = np.insert(ids, ends, end_id)
            ends = (ends + np.arange(1, len(ends) + 1)).tolist()
            yield batch(schema, pa.array(part), b.column(0), [smallest_ids(ids[i:j]) for i, j in zip([0, *ends], ends)])
        encoder.trim()

    return rows.mapInArrow(run, "part int, key long, ids binary")


def smallest_ids(values: np.ndarray) -> bytes:
    """Two bytes an id where all fit, marked by the first byte."""
    if values.max() < 1 << 16:
        return b"\x02" + values.astype("<u2").tobytes()
    return b"\x04" + values.astype(ID).tobytes()


def wide_ids(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, f"<u{stored[0]}", offset=1)


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    shard_ids: int = SHARD_IDS,
) -> str:
    """Encode all rows in key order and write the shards; returns their folder."""
    path = path or f"{scratch_folder(docs.sparkSession)}/token-shards"
    ranges = KeyRanges(docs, key)
    rows = encoded(docs, ranges, tokenizer, end_id, key, text)
    rows = rows.repartitionById(ranges.parts, F.col("part")).sortWithinPartitions("part", "key", "ids")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_held, part, number, start = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs_held, number, start
            ids = np.concatenate(held)
            first = max(FIRST_RULE, int(ids.max()) + 1)
            sequence, rules = build_grammar(ids, first)
            packed = smallest_symbols(sequence, rules, first)
            row = batch(
                SHARDS, [part], [number], [start], [len(ids)], [docs_held], [list(map(len, held))], [packed[0]],
                [packed[2].tobytes()], [packed[2].itemsize], [rule_lengths(rules, first).astype("<u4").tobytes()],
                [packed[1].tobytes()], [packed[1].itemsize],
            )
            start += len(ids)
            number += 1
            held, docs_held = [], []
            return row

        size = 0
        for b in batches:
            for p, k, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                part = p
                held.append(wide_ids(stored))
                docs_held.append(k)
                size += len(held[-1])
                if size >= shard_ids:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows.mapInArrow(shards, SHARD_DDL).write.mode("error").parquet(path)
    return path


def smallest_symbols(sequence: np.ndarray, rules: np.ndarray, first: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Nonterminals moved down to follow the largest id in use, so that symbols take fewer bytes."""
    ids = np.concatenate([sequence[sequence < first], rules[rules < first]])
    low = int(ids.max()) + 1 if len(ids) else 0
    move = lambda x: smallest(np.where(x >= first, x - first + low, x))
    return low, move(sequence), move(rules)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written shards alone.

    One number for each partition, its ids, comes to the driver to place the partitions.
    """
    stored = spark.read.schema(SHARD_DDL).parquet(path)
    totals = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    begin, at = {}, 0
    for part in sorted(totals):
        begin[part] = at
        at += totals[part]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shard = Shard(r["first_rule"], r["rules"], r["lengths"], r["sequence"], r["rule_size"], r["symbol_size"])
                data, sizes = shard.ids().tobytes(), np.array(r["doc_lengths"], dtype=np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                starts = ends - sizes + begin[r["part"]] + r["start_in_part"]
                yield batch(schema, r["doc_ids"], pa.array(starts), pa.array(sizes), crc)

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
