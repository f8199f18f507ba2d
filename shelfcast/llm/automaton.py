"""BPE by a tokenization automaton over token labels.

The automaton starts as one state with a loop for each base symbol. Each merge (u, v) -> w then adds
its gadget: the arcs labelled u lead to a state of their own, which loses its arc labelled v; every
state with an arc labelled u gains one labelled w, which leads to where v led. After all merges the
accepted label sequences are exactly the tokenizations, and each text has one.

States copied by a gadget differ from their original by single arcs, so the automaton is stored by
gadgets: for each state its original and when it was copied, for each label its gadget and target,
and the arcs taken away. Whether a state has an arc follows from these; arcs once looked at stay in a
table. A word is encoded by the arcs whose labels spell it, longest first, going back where a path
ends; decoding emits the labels of the arcs.

Rows: null text counts as empty: no ids, empty decoded text. Repeated rows give equal results, extra
columns are ignored, whole texts are read, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import batch, binary, pieces, raw_text
from shelfcast.llm.tokens import ID, WordChunks, byte_letters

#: Symbols are bytes; the last byte of a word counts from here.
LAST = 256
ARC_ENTRIES = 1_000_000


class Automaton:
    """Built by successive gadgets from the base symbols and the merges in order."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        self.origin, self.born = [-1], [0]
        self.target = dict.fromkeys(base, 0)
        self.made: dict[int, tuple[int, int, int]] = {}
        self.gone: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        leading = [len(base) + 1]  # labels that lead to each state; the start counts as one
        for time, (u, v, w) in enumerate(merges, start=1):
            state = self.target[u]
            after = state if u == v else self.target[v]
            if leading[state] > 1 or u == v:
                leading[state] -= 1
                self.origin.append(state)
                self.born.append(time)
                leading.append(1)
                state = self.target[u] = len(self.origin) - 1
            self.gone[state, v] = time
            self.made[w] = (u, v, time)
            self.target[w] = after
            leading[after] += 1

    def has(self, state: int, label: int, time: int) -> bool:
        """Whether the state had an arc with the label once `time` gadgets were added."""
        while True:
            taken = self.gone.get((state, label))
            if taken is not None and taken <= time:
                return False
            gadget = self.made.get(label)
            since = 0
            if gadget:
                since = gadget[2]
                if time < since:
                    return False
            if self.born[state] > since or (not gadget and state):
                state, time = self.origin[state], self.born[state] - 1
            elif gadget:
                label, time = gadget[0], since
            else:
                return True

    def arc(self, state: int, label: int) -> bool:
        if len(self.arcs) >= ARC_ENTRIES:
            self.arcs.clear()
        found = self.arcs[state << 32 | label] = self.has(state, label, len(self.made))
        return found


class AutomatonEncoder(WordChunks):
    """Encodes and decodes as the tokenizers library does with a file of lower-cased words."""

    def __init__(self, path: str):
        super().__init__(self._chunk_ids, self.word_ids, folds_case=True)
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made = {m[2] for m in merges}
        self.automaton = Automaton([i for i in vocab.values() if i not in made], merges)
        self.step: dict[int, int] = {}  # node << 9 | symbol -> node of the trie over all labels
        self.label_at = [-1]
        letter = {c: b for b, c in enumerate(byte_letters())}
        for name, label in vocab.items():
            ends = name.endswith(suffix)
            symbols = [letter[c] for c in (name[: -len(suffix)] if ends else name)]
            symbols[-1] += LAST * ends
            node = 0
            for x in symbols:
                following = self.step.setdefault(node << 9 | x, len(self.label_at))
                if following == len(self.label_at):
                    self.label_at.append(-1)
                node = following
            self.label_at[node] = label
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        names = {**{i: s for s, i in vocab.items()}, **{i: s for s, i in special.items()}}
        self.emitted = [names[i].encode() for i in range(len(names))]

    def _chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for part in self.special_pattern.split(chunk) if "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
                continue
            text = unicodedata.normalize("NFC", part)
            text = "".join(c.lower() for c in text)
            # letters newer than the library's tables are signs there
            shape = text if text.isascii() else "".join("!" if unicodedata.category(c) == "Cn" else c for c in text)
            for word in self.words.finditer(shape):
                out += self.word_ids(text[word.start() : word.end()])
        return out

    def word_ids(self, word: str) -> list[int]:
        """The labels along the one path that spells the word."""
        step, label_at, target = self.step.get, self.label_at, self.automaton.target
        known, look = self.automaton.arcs.get, self.automaton.arc
        symbols = list(word.encode())
        symbols[-1] += LAST
        size = len(symbols)
        path: list[int] = []
        turns: list[tuple[int, int, list]] = []  # position, state and arcs not yet tried, on the path
        dead: set[tuple[int, int]] = set()
        at = state = 0
        ends = None
        while True:
            if ends is None:  # all labels that the text goes on with
                ends, node = [], 0
                for k in range(at, size):
                    node = step(node << 9 | symbols[k])
                    if node is None:
                        break
                    if label_at[node] >= 0:
                        ends.append((k + 1, label_at[node]))
            while ends:
                end, label = ends.pop()
                arc = known(state << 32 | label)
                if arc is None:
                    arc = look(state, label)
                if arc and not (dead and (end, target[label]) in dead):
                    break
            else:
                dead.add((at, state))
                at, state, ends = turns.pop()
                path.pop()
                continue
            path.append(label)
            if end == size:
                return path
            turns.append((at, state, ends))
            at, state, ends = end, target[label], None

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs, joined as the library joins them without a decoder."""
        return b" ".join(map(self.emitted.__getitem__, np.frombuffer(ids, ID).tolist()))


_ENCODERS: dict[str, AutomatonEncoder] = {}


def automaton_encoder(path: str) -> AutomatonEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = AutomatonEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): ids as little-endian unsigned 32-bit bytes, decoded text."""
    return _run(docs, tokenizer, key, text, digest=False)


def encode_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the digests of `encode`, taken where it runs."""
    return _run(docs, tokenizer, key, text, digest=True)


def _run(docs: DataFrame, tokenizer: str, key: str, text: str, digest: bool) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("key"), raw_text(F.col(text)).alias("text"))
    fields = [("ids", pa.binary()), ("decoded", pa.string())]
    ddl = "key long, ids binary, decoded string"
    if digest:
        fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        ddl = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema = pa.schema([("key", pa.int64()), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = automaton_encoder(tokenizer)
        for b in pieces(batches, 1):
            out = []
            for body in binary(b.column(1)):
                ids = coder.text_ids(body)
                text_again = coder.decode(ids)
                if digest:
                    out.append((len(ids) // ID.itemsize, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text_again).hexdigest()))
                else:
                    out.append((ids, text_again.decode()))
            yield batch(schema, b.column(0), *zip(*out))
        coder.trim()

    return rows.mapInArrow(run, ddl)
