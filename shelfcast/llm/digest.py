"""Quartile bucket digests of documents and their bounded difference.

Byte triplets from a sliding window of five bytes are hashed into 256 buckets. The digest holds the
text's length on a logarithmic scale, the ratios of the bucket counts' quartiles, and for each
bucket the quartile its count falls into (two bits): "L", "Q", then buckets, in hexadecimal. The
difference adds up bounded parts: length, ratios, and the distance of quartiles bucket by bucket;
`likeness` is 1 minus its share of the largest difference. Equal texts have equal digests and
likeness 1.

`neighbour_digests` compares every document with an edited form of itself and with its successor in
key order. Rows go through one shuffle into ranges of the key; the first row of each range also goes
to the range before, so no range needs another one's rows.

Rows: null text counts as empty; texts below the window have all counts 0. A null key sorts first.
Rows of equal key are ordered by their text. A table of one row is its own successor. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import KeyRanges, batch, binary, long_or_null, raw_text

BUCKETS = 256
#: Offsets of the second and third byte of a triplet from its first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
#: A fixed odd multiplier for each byte's place.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
LENGTH_STEP = math.log(1.25)
MAX_LENGTH, MAX_RATIO = 12, 6
RATIO_STEPS = 16


def place_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash contributions of a byte in each place of a triplet."""
    values = np.arange(256, dtype=np.uint64)
    mixed = [((values + 1 + 257 * i) * np.uint64(m)) & np.uint64(0xFFFFFFFF) for i, m in enumerate(MIX)]
    return tuple(((x ^ (x >> np.uint64(15))) >> np.uint64(3)).astype(np.uint8) for x in mixed)


PLACES = place_tables()


def bucket_counts(text: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(text) - 4), 1 << 20):
        data = np.frombuffer(text[at : at + (1 << 20) + 4], np.uint8)
        first, second, third = (p[data] for p in PLACES)
        n = len(data) - 4
        for salt, (b, c) in enumerate(TRIPLETS):
            mixed = first[:n] + second[b : n + b] * np.uint8(2 * salt + 3) + (third[c : n + c] ^ np.uint8(37 * salt))
            counts += np.bincount(mixed, minlength=BUCKETS)
    return counts


class Digest:
    __slots__ = ("length", "ratios", "levels")

    def __init__(self, length: int, ratios: tuple[int, int], levels: np.ndarray):
        self.length, self.ratios, self.levels = length, ratios, levels

    @classmethod
    def of(cls, text: bytes) -> Digest:
        counts = bucket_counts(text)
        q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
        levels = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
        length = min(255, round(math.log(len(text) + 1) / LENGTH_STEP))
        ratios = tuple(int((RATIO_STEPS - 1) * q // q3) if q3 else 0 for q in (q1, q2))
        return cls(length, ratios, levels)

    def __str__(self) -> str:
        packed = np.packbits(np.unpackbits(self.levels[:, None], axis=1)[:, 6:].ravel())
        return f"{self.length:02x}{self.ratios[0]:x}{self.ratios[1]:x}{packed.tobytes().hex()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(text[4:]), np.uint8)).reshape(-1, 2)
        return cls(int(text[:2], 16), (int(text[2], 16), int(text[3], 16)), (bits[:, 0] * 2 + bits[:, 1]).astype(np.uint8))


#: A pair of quartiles one apart costs 1, two apart 3, three apart 6.
STEP_COST = np.array([0, 1, 3, 6])
MAX_DIFFERENCE = MAX_LENGTH + 2 * MAX_RATIO + 6 * BUCKETS


def difference(a: Digest, b: Digest) -> int:
    """0 for equal digests, MAX_DIFFERENCE at most."""
    length = min(MAX_LENGTH, abs(a.length - b.length))
    ratios = sum(min(MAX_RATIO, abs(x - y)) for x, y in zip(a.ratios, b.ratios))
    steps = STEP_COST[np.abs(a.levels.astype(np.int8) - b.levels.astype(np.int8))].sum()
    return int(length + ratios + steps)


def likeness(a: Digest, b: Digest) -> float:
    return 1.0 - difference(a, b) / MAX_DIFFERENCE


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row, in place."""
    rows = docs.select(F.col(key).cast("long").alias("key"), raw_text(F.col(text)).alias("text"))
    schema = pa.schema([("key", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, b.column(0), [str(Digest.of(x)) for x in binary(b.column(1))])

    return rows.mapInArrow(run, "key long, fingerprint string")


def code_point_offset(text: bytes, count: int) -> int:
    """Bytes taken by the first `count` code points."""
    if text.isascii():
        return min(count, len(text))
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return int(starts[count]) if count < len(starts) else len(text)


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def spliced(text: bytes, following: bytes) -> bytes:
    """The last quarter of the code points gives way to as many first ones of the following text."""
    n = code_points(text)
    tail = n // 4
    return text[: code_point_offset(text, n - tail)] + following[: code_point_offset(following, tail)]


OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def in_key_ranges(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(part, guest, key, text) by key range; guest rows have the key that follows the range's last
    (in the last range, the very first). One key for each range comes to the driver."""
    ranges = KeyRanges(docs, key)
    rows = docs.select(F.col(key).cast("long").alias("key"), raw_text(F.col(text)).alias("text"))
    number, null = F.coalesce("key", F.lit(0)), F.col("key").isNull()

    @F.pandas_udf("int")
    def part(k: pd.Series, none: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(k.to_numpy(np.int64), none.to_numpy(bool)))

    keys = rows.select("key").withColumn("part", part(number, null))
    least = F.min(F.struct((~null).alias("known"), number.alias("key")))
    heads = {r["part"]: tuple(r["head"]) for r in keys.groupBy("part").agg(least.alias("head")).collect()}
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series, none: pd.Series) -> pd.Series:
        home = ranges.of(k.to_numpy(np.int64), none.to_numpy(bool)).tolist()
        found = zip(home, k.tolist(), none.tolist())
        return pd.Series([[p, before[p]] if heads[p] == (not n, x) and before[p] != p else [p] for p, x, n in found])

    placed = rows.select("key", "text", F.posexplode(places(number, null)).alias("guest", "part"))
    return placed.select("part", F.col("guest") == 1, "key", "text").toDF("part", "guest", "key", "text"), ranges.parts


def neighbour_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of OUT for each row of `docs`."""
    placed, parts = in_key_ranges(docs, key, text)
    rows = placed.repartitionById(parts, F.col("part"))
    rows = rows.sortWithinPartitions("part", "guest", F.asc_nulls_first("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None  # rows (key, text, digest); `held` waits for its successor
        closed = False
        for b in batches:
            out = []
            for guest, k, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if closed:
                    continue  # further rows of the guest's key
                row = (k, body, Digest.of(body))
                first = first or row
                if held:
                    out.append(compared(held, row))
                held, closed = (None, True) if guest else (row, False)
            if out:
                yield batch(OUT, *zip(*out))
        if held:  # the only range: its first row follows the last
            yield batch(OUT, *zip(*[compared(held, first)]))

    return rows.mapInArrow(run, DDL)


def compared(row: tuple, following: tuple) -> tuple:
    key, text, own = row
    edited = spliced(text, following[1])
    changed = Digest.of(edited)
    return (
        key, code_points(text), hashlib.sha256(edited).hexdigest(), str(own), str(changed),
        likeness(own, changed), likeness(own, following[2]),
    )


DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
