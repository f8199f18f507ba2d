"""Vector best-fit packing of token pieces into sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths).
Pieces go in descending length into the open bin that fits under every capacity and scores best:
"norm" takes the smallest weighted norm of what would remain, "dot" the largest weighted dot product
of need and residual. Capacities and residuals are shares of the whole. The defaults for documents
and cost (2,048 and 2,048 squared) never bind beside 2,048 tokens; lower them to bound a sequence's
documents or its attention work.

Documents longer than a sequence are cut into full pieces; the first may be shorter. Pieces are dealt
evenly, by their place in the input, to groups of about `group_rows` pieces or `group_tokens` tokens,
each packed in one task, so a key shared by many rows makes no large group. Underfilled sequences of
all groups are packed again together. Whole pieces fill a sequence alone.

Rows: null text counts as empty and has the end id alone. Repeated rows are packed once each. A null
key stays null. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import batch, pieces, raw_text, saved
from shelfcast.llm.piece_ids import piece_encoder
from shelfcast.llm.tokens import ID

SEQUENCE = 2048
#: Bounds of a group, which one task packs.
GROUP_ROWS, GROUP_TOKENS = 1 << 15, 1 << 23
#: Sequences filled to a smaller share are packed again with those of other groups.
UNDERFILLED = 0.98
#: Weights of tokens, documents and attention cost in the score.
WEIGHTS = (1.0, 0.05, 0.01)


def best_fit(
    lengths: np.ndarray,
    tokens: int = SEQUENCE,
    documents: int = SEQUENCE,
    cost: float = float(SEQUENCE) ** 2,
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    if score not in ("norm", "dot"):
        raise ValueError("score: norm or dot")
    need = np.stack([lengths / tokens, np.full(len(lengths), 1 / documents), lengths.astype(float) ** 2 / cost], axis=1)
    if len(need) and need.max() > 1 + 1e-12:
        raise ValueError("a piece exceeds a capacity by itself")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    weight = np.array(weights)
    left = np.empty((max(1, len(lengths)), 3))  # residuals of open bins, in the first n_open rows
    bin_of = np.empty(max(1, len(lengths)), np.int64)
    filled = np.zeros(max(1, len(lengths)), np.int64)
    n_open = made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        want, at = need[i], -1
        if n_open:
            rest = left[:n_open] - want
            fits = np.flatnonzero(rest.min(axis=1) >= -1e-12)
            if len(fits):
                if score == "norm":
                    value = (rest[fits] ** 2) @ weight
                    at = int(fits[value.argmin()])
                else:
                    value = left[fits] @ (weight * want)
                    at = int(fits[value.argmax()])
        if at < 0:
            at = n_open
            left[at], bin_of[at] = 1.0, made
            n_open, made = n_open + 1, made + 1
        b = bin_of[at]
        where[i], offset[i] = b, filled[b]
        filled[b] += lengths[i]
        left[at] -= want
        if filled[b] >= tokens or left[at].min() < 1e-12:  # nothing fits any more
            n_open -= 1
            left[at], bin_of[at] = left[n_open], bin_of[n_open]
    return where, offset


def cut(sizes: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, start, length) of the pieces of documents of such sizes (one id or more)."""
    count = -(-sizes // sequence)
    doc = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = sizes - (count - 1) * sequence
    start = np.where(number > 0, first[doc] + (number - 1) * sequence, 0)
    return doc, number, start, np.where(number > 0, sequence, first[doc])


PIECES = [
    ("doc_id", pa.int64()),
    ("piece", pa.int32()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("slot", pa.int64()),
]
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, slot long"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    sequence: int = SEQUENCE,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents, on request with their ids as little-endian bytes. `slot` numbers
    pieces by task and place, which a repeated task numbers alike."""
    rows = docs.select(F.col(key).cast("long").alias("key"), raw_text(F.col(text)).alias("text"))
    schema = pa.schema([*PIECES, *([("ids", pa.binary())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer)
        slot = TaskContext.get().partitionId() << 40
        for b in pieces(batches, 1):
            ids, ends = encoder.encode(b.column(1))
            ids = np.insert(ids, ends, end_id).astype(ID, copy=False)
            ends = ends + np.arange(1, len(ends) + 1)
            sizes = np.diff(ends, prepend=0)
            doc, number, start, length = cut(sizes, sequence)
            begin = (ends - sizes)[doc] + start
            data = memoryview(ids).cast("B")
            own = [data[ID.itemsize * lo : ID.itemsize * hi] for lo, hi in zip(begin.tolist(), (begin + length).tolist())]
            columns = [b.column(0).take(pa.array(doc)), number.astype(np.int32), start, length, list(map(zlib.crc32, own))]
            slots = slot + np.arange(len(doc))
            slot += len(doc)
            yield batch(schema, *columns, slots, *([[bytes(x) for x in own]] if with_ids else []))
        encoder.trim()

    return rows.mapInArrow(run, PIECES_DDL + ", ids binary" * with_ids)


def pack(
    cut_pieces: DataFrame,
    group_rows: int = GROUP_ROWS,
    group_tokens: int = GROUP_TOKENS,
    tokens: int = SEQUENCE,
    documents: int = SEQUENCE,
    cost: float = float(SEQUENCE) ** 2,
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
) -> DataFrame:
    """The pieces with sequence_id and offset. Reads `cut_pieces` several times: pass a written table.

    Where there are several groups, the sequences that a group leaves underfilled are dissolved and
    their pieces dealt to fewer groups, round after round, until one group is left or fewer groups
    can't be had."""
    names = cut_pieces.columns
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema)

    def groups_of(rows: DataFrame) -> int:
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t")).first()
        return max(1, math.ceil(found["n"] / group_rows), math.ceil((found["t"] or 0) / group_tokens))

    def packed(rows: DataFrame, groups: int, turn: int) -> DataFrame:
        def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("slot", ignore_index=True)
            where, offset = best_fit(group["length"].to_numpy(np.int64), tokens, documents, cost, weights, score)
            group["sequence_id"] = (turn << 56) + (keys[0] << 28) + where
            group["offset"] = offset
            group["filled"] = np.bincount(where, group["length"])[where].astype(np.int64)
            return group.drop(columns="pack_group")

        dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("slot", F.lit(turn)), F.lit(groups)))
        return dealt.groupBy("pack_group").applyInPandas(run, f"{ddl}, sequence_id long, offset long, filled long")

    groups, turn, done = groups_of(cut_pieces), 0, []
    while groups > 1:
        made = saved(packed(cut_pieces, groups, turn), "packed")
        loose = made.filter(F.col("filled") < UNDERFILLED * tokens).select(*names)
        fewer = groups_of(loose)
        if fewer >= groups:
            return _all([*done, made], names)
        done.append(made.filter(F.col("filled") >= UNDERFILLED * tokens))
        cut_pieces, groups, turn = loose, fewer, turn + 1
    return _all([*done, packed(cut_pieces, 1, turn)], names)


def _all(parts: list[DataFrame], names: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*names, "sequence_id", "offset") for p in parts])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, with_ids: bool = False, **limits) -> DataFrame:
    """Cut and pack; one row for each piece."""
    return pack(saved(token_pieces(docs, tokenizer, end_id, with_ids=with_ids), "pieces"), **limits)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids of each sequence, for pieces that carry their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))
