"""Ranked lexical search over hashed max-sketches.

An index row sketches one document: its terms are hashed to `COORDINATES` coordinates, and each
coordinate keeps the largest term frequency of the terms that fold into it (one byte, 255 for any
more), next to the document's length. Within a document a term's impact grows with its frequency
alone, so the impact at a coordinate's frequency is at least that of every term that folds there.
Looked-up impacts times the query's term weights add up to an upper bound of the document's score,
reached where no strange term shares a coordinate.

A search reads the index, never the texts, in batches against all queries of a block. Each query's
`k` documents of the highest bounds are scored exactly; its k-th score is a threshold. Then the
documents whose bounds (ties: keys) still reach the threshold are scored, in rounds of descending
bounds that raise the threshold, until no bound reaches it. Every document is scored or bounded
away, so the ranking is exact.

Weights take the number of documents that hold each query term, counted over all texts. What the
driver and the tasks hold grows with a block of `QUERY_BLOCK` queries, not with the documents.

Rows: null and empty texts have no terms and are never found. A row is a document of its own; rows
of one key and text tie and are all ranked. A null key is ranked after others of its score. Items of
null or termless text find nothing; of several rows of an item id the smallest text counts; a null
item id is an item like any other. Extra columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import batch, binary, pieces, raw_text, saved
from shelfcast.llm.terms import coordinate, terms_of

COORDINATES = 1 << 16
MOST = 255
#: Queries searched together; index rows, and bytes of their coordinates, bounded at once.
QUERY_BLOCK, ROW_BLOCK, PLACE_BYTES = 512, 1024, 1 << 17
#: Documents of a query in the first round; each later round takes so many times more.
WIDEN = 50
#: Ways in which candidates of one query are thinned before they meet.
WAYS = 32
#: The impact of a term that fills its document: no impact is larger.
FULL = 1_000_000

INDEX_DDL = "key long, digest long, size long, places binary, peaks binary"
INDEX = pa.schema(
    [("key", pa.int64()), ("digest", pa.int64()), ("size", pa.int64()), ("places", pa.binary()), ("peaks", pa.binary())]
)
FOUND = pa.schema([("query", pa.int32()), ("key", pa.int64()), ("digest", pa.int64()), ("value", pa.int64())])
FOUND_DDL = "query int, key long, digest long, value long"


def sketch(tally: dict[bytes, int], coordinates: int = COORDINATES) -> tuple[bytes, bytes]:
    """(coordinates, largest frequencies), in order of the coordinates (a power of two, at most 2**16)."""
    places = np.fromiter(map(coordinate, tally), np.uint32, len(tally)) & np.uint32(coordinates - 1)
    counts = np.minimum(np.fromiter(tally.values(), np.int64, len(tally)), MOST)
    order = np.lexsort((-counts, places))
    places, counts = places[order], counts[order]
    first = np.ones(len(places), dtype=bool)
    first[1:] = places[1:] != places[:-1]
    return places[first].astype("<u2").tobytes(), counts[first].astype("u1").tobytes()


def norms(sizes: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """A document's m."""
    return 75 + (25 * sizes * documents) // max(1, terms)


def impacts(counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * norm)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _sketches(coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2):
            found = [terms_of(x) for x in binary(b.column(2))]
            kept = [i for i, x in enumerate(found) if x]
            made = [sketch(Counter(found[i]), coordinates) for i in kept]
            at = pa.array(kept, pa.int64())
            places, peaks = zip(*made) if made else ((), ())
            yield batch(INDEX, b.column(0).take(at), b.column(1).take(at), [len(found[i]) for i in kept], list(places), list(peaks))

    return run


class SketchIndex:
    """The written sketches of a collection, and the texts they stand for."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", coordinates: int = COORDINATES):
        body, self.coordinates = raw_text(F.col(text)), coordinates
        self.texts = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(body).alias("digest"), body.alias("text"))
        self.rows = saved(self.texts.mapInArrow(_sketches(coordinates), INDEX_DDL), "sketches")
        found = self.rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("terms")).first()
        self.documents, self.terms = found["n"], found["terms"] or 0

    def holders(self, wanted: set[bytes]) -> dict[bytes, int]:
        """How many documents hold each of the wanted terms; one row a term comes to the driver."""
        schema = pa.schema([("term", pa.binary()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tally: Counter = Counter()
            for b in pieces(batches, 0):
                for x in binary(b.column(0)):
                    tally.update(wanted.intersection(terms_of(x)))
            yield batch(schema, list(tally), list(tally.values()))

        found = self.texts.select("text").mapInArrow(run, "term binary, n long")
        rows = found.groupBy("term").agg(F.sum("n").alias("n")).collect()
        return {bytes(r["term"]): r["n"] for r in rows}

    def search(self, queries: list[list[bytes]], k: int = 20) -> DataFrame:
        """(query, rank, key, score): the k best documents of each query of a block, by its number."""
        holding = self.holders({t for q in queries for t in q})
        block = QueryBlock(queries, holding, self.documents, self.terms, self.coordinates)
        best = self.rows.sparkSession.createDataFrame([], f"{FOUND_DDL}, place int")
        floor: dict[int, tuple[int, int]] = {}
        done: dict[int, tuple[int, int, int]] = {}
        wide = k
        while True:
            bounds = self._bounds(block, floor, done)
            some = saved(self._most(bounds, wide), "candidates")
            lasts = self._lasts(some)
            if not lasts:
                break
            best = saved(self._most(best.drop("place").unionByName(self._scored(some, block)), k), "best")
            if all(n < wide for n, *_ in lasts.values()):
                break
            full = best.filter(F.col("place") == k).select("query", "value", "key").collect()  # one row a query
            floor = {r["query"]: (r["value"], _rank(r["key"])) for r in full}
            done.update({q: last for q, (n, *last) in lasts.items()})
            wide *= WIDEN
        return best.select("query", F.col("place").alias("rank"), "key", F.col("value").alias("score"))

    @staticmethod
    def _lasts(some: DataFrame) -> dict[int, tuple]:
        """Where each query's candidates end: (how many, bound, key, digest); one row a query."""
        last = F.max_by(F.struct("value", "key", "digest"), "place")
        rows = some.groupBy("query").agg(F.count(F.lit(1)).alias("n"), last.alias("x")).collect()
        return {r["query"]: (r["n"], r["x"]["value"], _rank(r["x"]["key"]), r["x"]["digest"]) for r in rows}

    @staticmethod
    def _most(rows: DataFrame, k: int) -> DataFrame:
        """The k rows of highest value of each query, with their place; thinned in parts before."""
        order = [F.desc("value"), F.asc_nulls_last("key"), F.asc("digest")]
        ways = F.pmod(F.xxhash64("key", "digest"), F.lit(WAYS)).alias("way")
        first = Window.partitionBy("query", "way").orderBy(*order)
        thin = rows.select("*", ways).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
        whole = Window.partitionBy("query").orderBy(*order)
        return thin.drop("way").withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= k)

    def _bounds(self, block: QueryBlock, floor: dict, done: dict) -> DataFrame:
        """(query, key, digest, value): bounds above zero that reach the floor and come after those
        done."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 3, PLACE_BYTES):
                for i in range(0, b.num_rows, ROW_BLOCK):
                    yield block.bounds(b.slice(i, ROW_BLOCK), floor, done)

        return self.rows.mapInArrow(run, FOUND_DDL)

    def _scored(self, some: DataFrame, block: QueryBlock) -> DataFrame:
        """(query, key, digest, value): exact scores of the candidates, from their texts."""
        wanted = some.groupBy("key", "digest").agg(F.collect_set("query").alias("queries"))
        # written, so that the join's choice rests on its real size
        wanted = saved(wanted.withColumnsRenamed({"key": "own_key", "digest": "own_digest"}), "wanted")
        same = F.col("digest") == F.col("own_digest")
        met = self.texts.join(wanted, same & F.col("key").eqNullSafe(F.col("own_key"))).select("key", "digest", "queries", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 3):
                out = [
                    (q, k, d, value)
                    for k, d, qs, x in zip(*(b.column(i).to_pylist() for i in range(3)), binary(b.column(3)))
                    for q, value in block.scores(terms_of(x), qs)
                    if value > 0
                ]
                yield batch(FOUND, *(zip(*out) if out else ((),) * 4))

        return met.mapInArrow(run, FOUND_DDL)


def _rank(key: int | None) -> int:
    """Null keys come last."""
    return (1 << 63) - 1 if key is None else key


class QueryBlock:
    """Queries with their term weights, as exact lists and as postings over coordinates."""

    def __init__(self, queries: list[list[bytes]], holding: dict[bytes, int], documents: int, terms: int, coordinates: int):
        self.documents, self.terms, self.n = documents, terms, len(queries)
        self.weights = [
            {t: times * weight(documents, holding.get(t, 0)) for t, times in Counter(q).items() if t in holding} for q in queries
        ]
        found: dict[tuple[int, int], int] = {}
        for q, own in enumerate(self.weights):
            for t, w in own.items():
                at = (coordinate(t) & (coordinates - 1), q)
                found[at] = found.get(at, 0) + max(0, w)
        self.posting_query = np.array([q for _, q in sorted(found)], dtype=np.int64)
        self.posting_weight = np.array([found[x] for x in sorted(found)], dtype=np.int64)
        self.first = np.searchsorted(np.array([c for c, _ in sorted(found)]), np.arange(coordinates + 1))

    def bounds(self, rows: pa.RecordBatch, floor: dict, done: dict) -> pa.RecordBatch:
        n = rows.num_rows
        sizes = np.array([len(x) for x in rows.column(4).to_pylist()], dtype=np.int64)
        places = np.frombuffer(b"".join(rows.column(3).to_pylist()), "<u2").astype(np.int64)
        peaks = np.frombuffer(b"".join(rows.column(4).to_pylist()), "u1").astype(np.int64)
        doc = np.repeat(np.arange(n), sizes)
        asked = self.first[places + 1] > self.first[places]
        doc, places, peaks = doc[asked], places[asked], peaks[asked]
        norm = norms(rows.column(2).to_numpy(zero_copy_only=False), self.documents, self.terms)
        value = np.where(peaks == MOST, FULL, impacts(peaks, norm[doc]))
        reach = self.first[places + 1] - self.first[places]
        posting = np.arange(reach.sum()) + np.repeat(self.first[places] - (np.cumsum(reach) - reach), reach)
        cell = np.repeat(doc, reach) * self.n + self.posting_query[posting]
        # sums of whole numbers far below 2**53 are exact in doubles
        total = np.bincount(cell, np.repeat(value, reach) * self.posting_weight[posting], n * self.n)
        total = total.reshape(n, self.n).astype(np.int64)
        keys = np.array([_rank(k) for k in rows.column(0).to_pylist()], dtype=np.int64)
        digests = rows.column(1).to_numpy(zero_copy_only=False)
        least = np.array([floor.get(q, (1, 0))[0] for q in range(self.n)], dtype=np.int64)
        row, query = np.nonzero(total >= np.maximum(least, 1))
        value = total[row, query]
        if floor:
            rival = np.array([floor.get(q, (0, (1 << 63) - 1))[1] for q in range(self.n)], dtype=np.int64)
            kept = (value > least[query]) | (keys[row] <= rival[query])
            row, query, value = row[kept], query[kept], value[kept]
        if done:
            last = np.array([done.get(q, ((1 << 62), -1, 0)) for q in range(self.n)], dtype=np.int64).reshape(self.n, 3)
            v, k, d = last[query].T
            after = (value < v) | ((value == v) & ((keys[row] > k) | ((keys[row] == k) & (digests[row] > d))))
            row, query, value = row[after], query[after], value[after]
        at = pa.array(row)
        return batch(FOUND, query.astype(np.int32), rows.column(0).take(at), rows.column(1).take(at), value)

    def scores(self, terms: list[bytes], queries: list[int]) -> list[tuple[int, int]]:
        tally = Counter(terms)
        norm = int(norms(np.int64(len(terms)), self.documents, self.terms))
        out = []
        for q in queries:
            own = self.weights[q]
            value = 0
            for t in own.keys() & tally.keys():
                value += own[t] * ((1_000_000_000 * tally[t]) // (1000 * tally[t] + 12 * norm))
            out.append((q, value))
        return out


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block: int = QUERY_BLOCK,
    coordinates: int = COORDINATES,
) -> DataFrame:
    """(item, rank, key, score) of the k best documents of each item, searched block by block."""
    spark: SparkSession = docs.sparkSession
    index = SketchIndex(docs, key, text, coordinates)
    own = items.select(F.col(item).cast("long").alias("item"), raw_text(F.col(item_text)).alias("text"))
    own = own.groupBy("item").agg(F.min("text").alias("text")).orderBy("item")
    parts, held = [], []

    def flush() -> None:
        found = index.search([terms_of(x) for _, x in held], k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], "query int, item long")
        parts.append(found.join(F.broadcast(names), "query").select("item", "rank", "key", "score"))  # a block's
        held.clear()

    for r in own.toLocalIterator():
        held.append((r["item"], bytes(r["text"])))
        if len(held) == block:
            flush()
    if held or not parts:
        flush()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
