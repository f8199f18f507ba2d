"""Token counts that follow edits: a segment tree over the pre-split chunks of each document.

A document is pre-split where no token reaches across (before a space that follows anything but
white space). Leaves hold a few dozen chunks with their byte lengths and token counts, inner nodes
the sums of both. An edit walks down by byte sums, re-encodes the chunks it touches and those on
either side whose border it may have moved, and updates the sums above the changed leaves.

Edits are (pos, drop, insert): at code point `pos`, `drop` code points give way to `insert`; several
edits of a document apply in order. Positions beyond the end count as the end.

Rows: null text counts as empty, a null list of edits as none, null parts of an edit as 0, 0 and "".
Rows with the same key are separate documents in `counts_after_edits`; `apply_edits` applies the
edits of a key to each of them. Extra columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import batch, pieces, raw_text
from shelfcast.llm.digest import code_point_offset
from shelfcast.llm.tokens import SpaceChunks, library_encoder

LEAF_CHUNKS = 64
EDITS = "array<struct<pos: long, drop: long, insert: string>>"


class CountTree:
    """Chunks of one document in leaves, sums of bytes and tokens in a binary heap above them."""

    def __init__(self, text: bytes, sizes: list[int], counts: list[int]):
        self.text, self.reencoded = text, 0
        self._plant(sizes, counts)

    @classmethod
    def of(cls, text: bytes, encoder: SpaceChunks) -> CountTree:
        return cls(text, *measured(text, encoder))

    def _plant(self, sizes: list[int], counts: list[int]) -> None:
        step = LEAF_CHUNKS
        self.leaves = [(sizes[i : i + step], counts[i : i + step]) for i in range(0, len(sizes), step)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.bytes, self.tokens = ([0] * (2 * self.width) for _ in range(2))
        for i, (s, c) in enumerate(self.leaves):
            self.bytes[self.width + i], self.tokens[self.width + i] = sum(s), sum(c)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, node: int) -> None:
        self.bytes[node] = self.bytes[2 * node] + self.bytes[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(leaf, chunk in it, where the chunk starts) of the byte `at`."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.bytes[node]:
                start += self.bytes[node]
                node += 1
        leaf = node - self.width
        sizes = self.leaves[leaf][0]
        ends = list(accumulate(sizes))
        chunk = bisect_right(ends, at - start)
        return leaf, chunk, start + (ends[chunk - 1] if chunk else 0)

    def edit(self, pos: int, drop: int, insert: str, encoder: SpaceChunks) -> None:
        total = len(self.text)
        begin = code_point_offset(self.text, pos)
        end = begin + code_point_offset(self.text[begin:], drop)
        new = insert.encode()
        if not total:
            self.text = new
            self._plant(*measured(new, encoder))
            self.reencoded += len(new)
            return
        # the chunk before the edit and the one after it belong to the region: its borders may move
        leaf, chunk, start = self._find(max(begin - 1, 0))
        last_leaf, last_chunk, last_start = self._find(min(end, total - 1))
        stop = last_start + self.leaves[last_leaf][0][last_chunk]
        region = self.text[start:begin] + new + self.text[end:stop]
        self.text = self.text[:begin] + new + self.text[end:]
        self.reencoded += len(region)
        sizes, counts = measured(region, encoder)
        head, tail = self.leaves[leaf], self.leaves[last_leaf]
        rest = [x[last_chunk + 1 :] for x in tail]
        for i in range(leaf + 1, last_leaf):
            self.leaves[i] = ([], [])
        if last_leaf > leaf:
            self.leaves[leaf] = (head[0][:chunk] + sizes, head[1][:chunk] + counts)
            self.leaves[last_leaf] = (rest[0], rest[1])
        else:
            self.leaves[leaf] = (head[0][:chunk] + sizes + rest[0], head[1][:chunk] + counts + rest[1])
        if len(self.leaves[leaf][0]) > 4 * LEAF_CHUNKS:
            self._plant(*self.flat())
            return
        changed = set()
        for i in range(leaf, last_leaf + 1):
            node = self.width + i
            self.bytes[node], self.tokens[node] = sum(self.leaves[i][0]), sum(self.leaves[i][1])
            changed.add(node // 2)
        while changed and max(changed):
            for node in changed:
                self._sum(node)
            changed = {node // 2 for node in changed if node > 1}

    def flat(self) -> tuple[list[int], list[int]]:
        return [x for s, _ in self.leaves for x in s], [x for _, c in self.leaves for x in c]


def measured(text: bytes, encoder: SpaceChunks) -> tuple[list[int], list[int]]:
    """Byte length and token count of each chunk."""
    chunks = encoder.chunk_list(text) if text else []
    return list(map(len, chunks)), [len(encoder[c]) // 4 for c in chunks]


def _byte_level(tokenizer: str) -> SpaceChunks:
    encoder = library_encoder(tokenizer)
    if not isinstance(encoder, SpaceChunks):
        raise ValueError("edit-aware counts need a byte-level tokenizer")
    return encoder


def _apply(tree: CountTree, edits: list | None, encoder: SpaceChunks) -> None:
    for e in edits or []:
        if e is not None:
            tree.edit(max(0, e["pos"] or 0), max(0, e["drop"] or 0), e["insert"] or "", encoder)


def counts_after_edits(docs: DataFrame, edits: Column, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens_before, tokens_after, bytes_after, reencoded_bytes) where edits stand beside the text."""
    rows = docs.select(F.col(key).alias("key"), raw_text(F.col(text)).alias("text"), edits.cast(EDITS).alias("edits"))
    kind = rows.schema["key"].dataType.simpleString()
    ddl = f"key {kind}, tokens_before long, tokens_after long, bytes_after long, reencoded_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _byte_level(tokenizer)
        for b in pieces(batches, 1):
            out = []
            for body, changes in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                tree = CountTree.of(body, encoder)
                before = tree.n_tokens
                _apply(tree, changes, encoder)
                out.append((before, tree.n_tokens, len(tree.text), tree.reencoded))
            columns = [pa.array(x, pa.int64()) for x in zip(*out)]
            names = ["key", "tokens_before", "tokens_after", "bytes_after", "reencoded_bytes"]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)
        encoder.trim()

    return rows.mapInArrow(run, ddl)


STATE = "text binary, sizes binary, counts binary, n_tokens long, reencoded_bytes long"


def _state(tree: CountTree) -> tuple:
    sizes, counts = (np.array(x, dtype="<u4").tobytes() for x in tree.flat())
    return tree.text, sizes, counts, tree.n_tokens, tree.reencoded


def build_trees(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, state): the trees of all documents, for `apply_edits` to keep up to date."""
    rows = docs.select(F.col(key).alias("key"), raw_text(F.col(text)).alias("text"))
    return _stateful(rows, tokenizer, lambda r, encoder: CountTree.of(r["text"], encoder))


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizer: str, order: str = "seq") -> DataFrame:
    """The trees after the edits (key, order, pos, drop, insert); a key's edits apply in that order."""
    change = F.struct(F.col(order).alias("o"), "pos", "drop", "insert")
    by_key = edits.groupBy("key").agg(F.sort_array(F.collect_list(change)).alias("edits"))

    def edited(r: dict, encoder: SpaceChunks) -> CountTree:
        tree = CountTree(r["text"], *(np.frombuffer(r[c], "<u4").tolist() for c in ("sizes", "counts")))
        _apply(tree, r["edits"], encoder)
        return tree

    return _stateful(trees.join(by_key, "key", "left"), tokenizer, edited)


def _stateful(rows: DataFrame, tokenizer: str, make) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()
    names = ["text", "sizes", "counts", "n_tokens", "reencoded_bytes"]
    types = [pa.binary()] * 3 + [pa.int64()] * 2
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _byte_level(tokenizer)
        for b in pieces(batches, at):
            found = [_state(make(r, encoder)) for r in b.to_pylist()]
            columns = [pa.array(x, t) for x, t in zip(zip(*found), types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["key", *names])
        encoder.trim()

    return rows.mapInArrow(run, f"key {kind}, {STATE}")
