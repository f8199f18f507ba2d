"""SimHash near-duplicates: fingerprints meet at the words of a covering code.

The first 46 bits of a fingerprint form two blocks of the perfect binary Golay code (covering radius
3 each, 6 together). Every fingerprint lives at its nearest anchor and visits every anchor within
covering radius plus threshold. If x and y differ in at most `threshold` bits, y lies within
6 + threshold of the anchor where x lives, so the two meet there, with no exception. Bits beyond the
blocks take part in the comparison only. `blocks=3` adds a Hamming block over 15 more bits (2**35
anchors) for collections in which 2**24 anchors are too crowded.

Rows: null or empty text (or text without words) has fingerprint zero. Repeated rows and equal
texts share a fingerprint. A null key takes part in groups but can't name one; a group of null keys
only has a null component. Columns besides key and text are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import batch, binary, pieces, raw_text, saved
from shelfcast.llm.components import connected_components

SEED = 42
#: Length, generator polynomial and covering radius of the blocks: Golay, Golay, Hamming.
BLOCKS = ((23, 0b110001110101, 3), (23, 0b110001110101, 3), (15, 0b10011, 1))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of all shingles of lower-case words, repeats included; a text of fewer words is one shingle."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype="<u8")
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        joined = b" ".join(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        spans = zip((ends - sizes)[: 1 - words or None].tolist(), ends[words - 1 :].tolist())
        hashes = [digest(joined[a:b], SEED) for a, b in spans]
    return np.array(hashes, dtype="<u8")


def fingerprint(text: bytes, words: int = 3) -> int:
    """Bit i is set if it is set in over half the hashes of all shingles, repeats included."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    values = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 1 << 16):
        counts += np.unpackbits(values[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, digest, fp): one row for each row of `docs`; fp holds the 64 bits in a long."""
    rows = docs.select(F.col(key).cast("long").alias("key"), text_digest(text).alias("digest"), raw_text(F.col(text)).alias("text"))
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            fps = [fingerprint(x, words) for x in binary(b.column(2))]
            yield batch(schema, b.column(0), b.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)))

    return rows.mapInArrow(run, "key long, digest long, fp long")


class Block:
    """Code words near any value of a cyclic perfect code, by the value's syndrome."""

    def __init__(self, length: int, polynomial: int, radius: int, reach: int):
        self.length, self.radius = length, radius
        self.check = polynomial.bit_length() - 1
        rest, value = [], 1
        for _ in range(length):  # x**i modulo the polynomial
            rest.append(value)
            value <<= 1
            if value >> self.check:
                value ^= polynomial
        self.rest = np.array(rest, dtype=np.int64)
        # error patterns of each weight with their syndromes: those one lighter, plus a higher bit
        pattern, syndrome, top = (np.zeros(1, dtype=np.int64) for _ in range(3))
        by: list[list[np.ndarray]] = [[] for _ in range(1 << self.check)]
        for _ in range(reach + 1):
            order = np.argsort(syndrome, kind="stable")
            edges = np.searchsorted(syndrome[order], np.arange((1 << self.check) + 1))
            for s, own in enumerate(by):
                own.append(pattern[order[edges[s] : edges[s + 1]]])
            grown = [(top <= i, i) for i in range(length)]
            pattern, syndrome, top = (
                np.concatenate(x)
                for x in zip(
                    *(
                        (pattern[m] | (1 << i), syndrome[m] ^ rest[i], np.full(m.sum(), i + 1, dtype=np.int64))
                        for m, i in grown
                    )
                )
            )
        self.patterns = [np.concatenate(w) for w in by]  # lightest first
        self.ends = [np.cumsum([0, *map(len, w)]).tolist() for w in by]

    def exact(self, syndrome: int, weight: int) -> np.ndarray:
        ends = self.ends[syndrome]
        return self.patterns[syndrome][ends[weight] : ends[weight + 1]]

    def within(self, syndrome: int, weight: int) -> np.ndarray:
        return self.patterns[syndrome][: self.ends[syndrome][weight + 1]]

    def syndromes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.int64)
        for i in range(self.length):
            out ^= np.where((values >> i) & 1, self.rest[i], 0)
        return out


class AnchorCode:
    """The product of the blocks: an anchor is one code word of each block, side by side."""

    def __init__(self, blocks: int, threshold: int):
        self.radius = sum(b[2] for b in BLOCKS[:blocks])
        self.reach = self.radius + threshold
        made = {b: Block(*b, self.reach) for b in set(BLOCKS[:blocks])}
        self.blocks = [made[b] for b in BLOCKS[:blocks]]

    def parts(self, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for b in self.blocks:
            values = (fps >> at) & ((1 << b.length) - 1)
            out.append((values, b.syndromes(values)))
            at += b.length
        return out

    def homes(self, fps: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(fps), dtype=np.int64), 0
        for b, (values, syndromes) in zip(self.blocks, self.parts(fps)):
            nearest = np.array([w[0] for w in b.patterns], dtype=np.int64)
            out |= (values ^ nearest[syndromes]) << at
            at += b.length
        return out

    def near(self, fps: np.ndarray) -> Iterator[np.ndarray]:
        """For each fingerprint, every anchor within covering radius plus threshold."""
        columns = [(v.tolist(), s.tolist()) for v, s in self.parts(fps)]
        for i in range(len(fps)):
            found = [(np.zeros(1, dtype=np.int64), 0)]  # anchors so far, by the distance spent
            at = 0
            for k, (b, (values, syndromes)) in enumerate(zip(self.blocks, columns)):
                v, s, step = values[i], syndromes[i], []
                for have, spent in found:
                    if k == len(self.blocks) - 1:
                        tail = b.within(s, self.reach - spent)
                        step.append(((have[:, None] | ((v ^ tail) << at)).ravel(), self.reach))
                        continue
                    for weight in range(self.reach - spent + 1):
                        if len(e := b.exact(s, weight)):
                            step.append(((have[:, None] | ((v ^ e) << at)).ravel(), spent + weight))
                found = step
                at += b.length
            yield np.concatenate([x for x, _ in found])


@cache
def anchor_code(blocks: int, threshold: int) -> AnchorCode:
    return AnchorCode(blocks, threshold)


def links(distinct: DataFrame, threshold: int = 2, blocks: int = 2) -> DataFrame:
    """(a, b): all pairs of different fingerprints in column fp that differ in `threshold` bits at
    most. A fingerprint has a bounded number of such neighbours (2,080 at two bits), however large
    its group is, so the rows grow in proportion to the input."""
    if not 0 <= threshold <= 4:
        raise ValueError("threshold: 0 to 4 bits")

    def homes(batches):
        schema = pa.schema([("anchor", pa.int64()), ("a", pa.int64())])
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            yield batch(schema, pa.array(anchor_code(blocks, threshold).homes(fps)), b.column(0))

    def visits(batches):
        schema = pa.schema([("anchor", pa.int64()), ("b", pa.int64())])
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 2048):
                some = fps[i : i + 2048]
                anchors = list(anchor_code(blocks, threshold).near(some))
                copies = np.repeat(some, np.fromiter(map(len, anchors), np.int64, len(anchors)))
                yield batch(schema, pa.array(np.concatenate(anchors)), pa.array(copies))

    fps = distinct.select("fp")
    home = fps.mapInArrow(homes, "anchor long, a long")
    visit = fps.mapInArrow(visits, "anchor long, b long")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    # Spark sizes the visits as the homes, though there are 77.5 times as many at two bits: hashed are
    # the homes of a partition, nothing is broadcast
    met = home.alias("h").hint("shuffle_hash").join(visit.alias("v"), (F.col("h.anchor") == F.col("v.anchor")) & (F.col("a") < F.col("b")) & near)
    return met.select("a", "b")


def _groups(marked: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """(fp, root, component) of every fingerprint: root is a fingerprint that names its group."""
    groups = saved(marked.groupBy("fp").agg(F.min("key").alias("first")), "groups")
    roots = connected_components(links(groups, threshold, blocks), "a", "b")
    linked = groups.join(roots, F.col("fp") == F.col("node")).select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(least, "root").select("fp", "root", "least")
    named = groups.join(moved, "fp", "left")
    return named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 3,
    threshold: int = 2,
    blocks: int = 2,
) -> DataFrame:
    """(key, fp, component): component is the smallest key reachable over links, itself included."""
    marked = saved(fingerprints(docs, key, text, words), "fingerprints")
    named = _groups(marked, threshold, blocks).select("fp", "component")
    return marked.join(named, "fp").select("key", "fp", "component")


def one_of_each_group(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 3,
    threshold: int = 2,
    blocks: int = 2,
) -> DataFrame:
    """The rows of `docs` with the smallest key of their group (null keys last), one row for each
    group: of repeated rows, that with the smallest text."""
    marked = saved(fingerprints(docs, key, text, words), "fingerprints")
    named = _groups(marked, threshold, blocks).select("fp", "root")
    return first_rows(docs, marked.join(named, "fp"), key, text)


def text_digest(text: str) -> Column:
    return F.xxhash64(raw_text(F.col(text)))


def first_rows(docs: DataFrame, rooted: DataFrame, key: str, text: str) -> DataFrame:
    """One row of `docs` for each root of `rooted` (key, digest, root): that with the smallest key,
    then the smallest digest of its text; null before empty text."""
    row = F.struct(F.col("key").isNull().alias("n"), F.coalesce("key", F.lit(0)).alias("k"), "digest")
    first = rooted.groupBy("root").agg(F.min(row).alias("first")).select("first.*")
    first = saved(first.toDF("shelfcast_n", "shelfcast_k", "shelfcast_digest"), "first")
    number = F.col(key).cast("long")
    rows = docs.withColumns(
        {
            "shelfcast_n": number.isNull(),
            "shelfcast_k": F.coalesce(number, F.lit(0)),
            "shelfcast_digest": text_digest(text),
        }
    )
    kept = rows.join(first, first.columns, "left_semi")
    order = Window.partitionBy(*first.columns).orderBy(F.asc_nulls_first(text))
    kept = kept.withColumn("shelfcast_row", F.row_number().over(order)).filter("shelfcast_row = 1")
    return kept.select(*docs.columns)
