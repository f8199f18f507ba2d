"""Interaction of document filters, from one relation of failing ids for each filter.

Every document is numbered once (`rid`). A filter's id table holds the numbers of the documents that
fail it. What a set of filters leaves of the failing documents is the set less one filter, left-anti
that filter's table; what the next filter removes is left-semi its table; what it would have removed
but for the filters before it is its table left-anti the survivors; label losses are the removed
left-semi the ids of labelled documents. An order's steps are looked up by the set of filters before
them, 32 sets for five filters in place of 120 orders. Sets are bit masks, one tag among the join
keys, so one join serves all sets of a size.

Documents that fail nothing are only counted. Relations hold numbers and parts, never texts; all
join keys are spread by the document's number. Equal texts are found by their digests: a partial
aggregate gives each digest's smallest key, and only digests of several rows are joined.

Rows: null text counts as empty, null part as an empty string. A row is a document of its own, keys
may repeat. A row of null key is equal to no smaller key and no key is greater than it. Labels are
matched by key, any row of a key counts, null keys match none. Extra columns are ignored, an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import saved
from shelfcast.session import scratch_folder

SPACES = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letter of the filter that compares texts with those of smaller keys.
REPEATED = "E"


def text_filters(body: Column) -> dict[str, Column]:
    """True where a text fails: short, repetitive, capitals, signs."""
    bare = F.btrim(body, F.lit(SPACES))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(body) - F.length(F.translate(body, CAPITALS, ""))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * capitals > 3 * F.length(body),
        "D": body.rlike("[#$%&*|]"),
    }


class FilterAudit:
    """The relations of one audit, written below the shared folder."""

    def __init__(self, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"):
        self.spark = docs.sparkSession
        body = F.coalesce(F.col(text), F.lit(""))
        rows = docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(key).cast("long").alias("key"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
            *[fails.alias(f"fails_{name}") for name, fails in text_filters(body).items()],
        )
        self.filters = [*text_filters(body), REPEATED]
        self.rows = saved(rows, "audit-documents")
        self.tables = self._id_tables()
        self.failing = self.tables.select("rid", "part").distinct()
        self.survivors = self._survivors()
        self.removed = self._removed()
        self.labels = labels.select(F.col(key).cast("long").alias("key"), "quality", "toxic")

    def bit(self, name: str) -> int:
        return 1 << self.filters.index(name)

    def _id_tables(self) -> DataFrame:
        """(filter, rid, part), a folder for each filter."""
        own = [F.when(F.col(f"fails_{f}"), self.bit(f)) for f in self.filters if f != REPEATED]
        by_text = self.rows.select("rid", "part", F.explode(F.array_compact(F.array(*own))).alias("filter"))
        first = self.rows.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
        again = self.rows.join(first.filter("n > 1"), "digest").filter("key > first")
        by_key = again.select("rid", "part", F.lit(self.bit(REPEATED)).alias("filter"))
        path = f"{scratch_folder(self.spark)}/audit-ids"
        by_text.unionByName(by_key).write.partitionBy("filter").parquet(path)
        return self.spark.read.schema("rid long, part string, filter int").parquet(path)

    def _choices(self, mask: Column, above: bool = False) -> Column:
        """Bits of the filters that aren't in the mask; on request only those above its highest."""
        bits = [self.bit(f) for f in self.filters]
        free = [(mask < b) if above else (mask.bitwiseAND(F.lit(b)) == 0) for b in bits]
        return F.explode(F.array_compact(F.array(*[F.when(ok, b) for ok, b in zip(free, bits)])))

    def _survivors(self) -> DataFrame:
        """(mask, rid, part): the failing documents that pass every filter of the mask."""
        level = saved(self.failing.select(F.lit(0).alias("mask"), "rid", "part"), "audit-survivors")
        levels = [level]
        for _ in self.filters:
            tried = level.select("mask", "rid", "part", self._choices(F.col("mask"), above=True).alias("filter"))
            left = tried.join(self.tables.select("filter", "rid"), ["filter", "rid"], "left_anti")
            level = saved(left.select((F.col("mask") + F.col("filter")).alias("mask"), "rid", "part"), "audit-survivors")
            levels.append(level)
        out = levels[0]
        for x in levels[1:]:
            out = out.unionByName(x)
        return out

    def _removed(self) -> DataFrame:
        """(mask, filter, rid, part): what the filter removes after those of the mask."""
        tried = self.survivors.select("mask", "rid", "part", self._choices(F.col("mask")).alias("filter"))
        return saved(tried.join(self.tables.select("filter", "rid"), ["filter", "rid"], "left_semi"), "audit-removed")

    def _count(self, rows: DataFrame, name: str, *by: str) -> DataFrame:
        return rows.groupBy("part", *by).agg(F.count(F.lit(1)).alias(name))

    def counts(self) -> DataFrame:
        """(part, mask, filter, removed, redundant, good_lost, toxic_lost, left), of sets and filters
        that any document concerns."""
        keys = ("mask", "filter")
        after = self.tables.select("filter", "rid", "part", self._sets_without(F.col("filter")).alias("mask"))
        redundant = after.join(self.survivors.select("mask", "rid"), ["mask", "rid"], "left_anti")
        found = [(self.removed, "removed"), (redundant, "redundant")]
        for column, name in (("quality", "good_lost"), ("toxic", "toxic_lost")):
            marked = self.labels.filter(F.col(column) == 1).select("key")
            ids = self.rows.join(marked, "key", "left_semi").select("rid")
            found.append((self.removed.join(ids, "rid", "left_semi"), name))
        names = [name for _, name in found]
        tall = None
        for rows, name in found:
            own = self._count(rows, "n", *keys).select("part", *keys, F.lit(name).alias("what"), "n")
            tall = own if tall is None else tall.unionByName(own)
        wide = [F.sum(F.when(F.col("what") == name, F.col("n")).otherwise(0)).alias(name) for name in names]
        return tall.groupBy("part", *keys).agg(*wide)

    def _sets_without(self, bit: Column) -> Column:
        every = F.sequence(F.lit(0), F.lit((1 << len(self.filters)) - 1))
        return F.explode(F.filter(every, lambda m: m.bitwiseAND(bit) == 0))

    def report(self) -> DataFrame:
        """One row for each part, order and step, zeros included."""
        counts, whole = saved(self.counts(), "audit-counts"), (1 << len(self.filters)) - 1
        parts = self._count(self.rows, "documents").join(self._count(self.failing, "faulty"), "part", "left")
        parts = parts.select("part", (F.col("documents") - F.coalesce("faulty", F.lit(0))).alias("sound"))
        orders = ["".join(p) for p in permutations(self.filters)]
        at = F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))
        grid = parts.select("part", "sound", at.alias("number"))
        grid = grid.withColumn("filter_order", F.element_at(F.array(*map(F.lit, orders)), F.col("number") + 1))
        grid = grid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(self.filters)))))
        bits = F.create_map(*[x for f in self.filters for x in (F.lit(f), F.lit(self.bit(f)))])

        def letter(place: Column) -> Column:
            return F.element_at(bits, F.substring("filter_order", place, F.lit(1)))

        before = sum((F.when(F.col("step") > i, letter(F.lit(i))).otherwise(0) for i in range(1, len(self.filters))), F.lit(0))
        grid = grid.select("part", "sound", "filter_order", "step", before.alias("mask"), letter(F.col("step")).alias("filter"))
        size = F.bit_count("mask")
        n = len(self.filters)
        weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
        alone = F.sum(F.when(F.col("mask") + F.col("filter") == whole, F.col("removed")).otherwise(0))
        shared = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"), alone.alias("unique_fails"))
        left = self._count(self.survivors, "left", "mask").withColumnRenamed("mask", "after")
        grid = grid.withColumn("after", F.col("mask") + F.col("filter"))
        made = grid.join(counts, ["part", "mask", "filter"], "left").join(shared, ["part", "filter"], "left")
        made = made.join(left, ["part", "after"], "left")
        own = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
        kept = (F.col("sound") + F.coalesce("left", F.lit(0))).cast("long").alias("kept")
        return made.select("part", "filter_order", F.col("step").cast("int").alias("step"), kept, *own)
