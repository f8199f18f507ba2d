"""Token shards, BPE, packing and edited counts next to the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfcast.llm import automaton, catalog, edit_counts, packing, repair
from shelfcast.llm.common import KeyRanges
from shelfcast.llm.piece_ids import ChunkTable, PieceEncoder, piece_encoder
from shelfcast.llm.tokens import library_encoder, tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
PIECES = {p: piece_encoder(p) for p in (WORD, BYTE)}
TEXTS = st.text(
    alphabet=st.one_of(
        st.sampled_from("aabbthenréÉİΣς '’s.,!?#*\n\t   \x1c\x85-12½日😀é|<>"), st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"])
    ),
    max_size=60,
)


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def ids_of(library, path, text):
    return library[path].encode(text, add_special_tokens=False).ids


def stored(ids):
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_chunks_give_the_ids_of_the_whole_text(library, text):
    for path in (WORD, BYTE):
        assert library_encoder(path).text_ids(text.encode()) == stored(ids_of(library, path, text))


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.one_of(TEXTS, st.sampled_from(["<|endoftext|>", "a <|ENDOFTEXT|> b", "it's,.!x  y\n\n z\nq\u00a0 r"])), max_size=8))
def test_pieces_give_the_ids_of_each_text(library, texts):
    for path in (WORD, BYTE):
        ids, ends = PIECES[path].encode(pa.array(texts, pa.string()))
        own = [ids[i:j].tolist() for i, j in zip([0, *ends.tolist()], ends.tolist())]
        assert own == [ids_of(library, path, t) for t in texts]


def test_full_tables_keep_giving_ids(library):
    small = PieceEncoder(library_encoder(BYTE), [], ChunkTable(entries=40, kept=10, slot_bits=6))
    for turn in range(30):
        texts = [f"w{turn * k} and x{k} " * (k % 5) + "longer than fifteen bytes is " + "z" * k for k in range(1 + turn)]
        ids, ends = small.encode(pa.array(texts, pa.large_string()))
        assert ids.tolist() == [i for t in texts for i in ids_of(library, BYTE, t)] and len(ends) == len(texts)
    assert small.table.size <= 40


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_automaton_spells_the_library_path(library, text):
    coder, ids = automaton.automaton_encoder(WORD), ids_of(library, WORD, text)
    assert coder.text_ids(text.encode()) == stored(ids)
    assert coder.decode(stored(ids)).decode() == library[WORD].decode(ids, skip_special_tokens=False)


def test_gadgets_resolve_runs_and_overlaps():
    """Ids a=0 b=1; aa=2, ab=3, aab=4 (aa+b), aaaa=5: against merging rule after rule."""
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (2, 2, 5)]
    made = automaton.Automaton([0, 1], merges)
    spelled = {0: "a", 1: "b", 2: "aa", 3: "ab", 4: "aab", 5: "aaaa"}
    for size in range(1, 9):
        for bits in range(1 << size):
            ids = [bits >> i & 1 for i in range(size)]
            text = "".join("ab"[i] for i in ids)
            for u, v, w in merges:
                out = []
                for x in ids:
                    if out and (out[-1], x) == (u, v):
                        out[-1] = w
                    else:
                        out.append(x)
                ids = out
            paths = []

            def walk(at, state, path):
                if at == len(text):
                    paths.append(path)
                for label, s in spelled.items():
                    if text.startswith(s, at) and made.has(state, label, len(merges)):
                        walk(at + len(s), made.target[label], [*path, label])

            walk(0, 0, [])
            assert paths == [ids]


def test_op3_and_op10_whole_tables(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    shards = {r.doc_id: r for r in catalog.op3_token_shards(spark, folder).collect()}
    coded = {r.doc_id: r for r in catalog.op10_bpe(spark, folder).collect()}
    assert len(shards) == len(coded) == len(docs)
    at = 0
    for r in docs:
        ids = ids_of(library, WORD, r.text or "")
        row, code = shards[r.doc_id], coded[r.doc_id]
        want = stored([*ids, 1])
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids) + 1, zlib.crc32(want))
        at += len(ids) + 1
        decoded = library[WORD].decode(ids, skip_special_tokens=False)
        assert code.n_tokens == len(ids)
        assert code.ids_sha256 == hashlib.sha256(stored(ids)).hexdigest()
        assert code.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows_are_encoded(odd, library, spark):
    path = repair.write_shards(odd, WORD, shard_ids=50)
    rows = repair.read_shards(spark, path).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0].doc_id is None
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()[:-1]]
    assert {r.doc_id: r.n_tokens for r in rows}[2] == 1
    empty = repair.write_shards(odd.limit(0), WORD)
    assert repair.read_shards(spark, empty).count() == 0
    coded = automaton.encode(odd, WORD)
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id}
    for r in coded.collect():
        if r.key:
            assert bytes(r.ids) == stored(ids_of(library, WORD, texts[r.key]))
    assert coded.count() == odd.count()


def test_a_hot_key_is_dealt_over_its_share_of_the_parts(spark, library):
    rows = [(7 if i % 3 else i, f"text number {i % 40}") for i in range(600)] + [(None, "x")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranges = KeyRanges(frame, "doc_id", parts=20)
    keys = np.array([k or 0 for k, _ in rows])
    null = np.array([k is None for k, _ in rows])
    parts = ranges.spread(keys, null, np.arange(len(rows)))
    assert len(set(parts[keys == 7].tolist())) >= 8 and len(set(parts[null].tolist())) >= 6
    at = {}
    for k, p in zip(np.where(null, -1, keys).tolist(), parts.tolist()):
        lo, hi = at.get(k, (p, p))
        at[k] = min(lo, p), max(hi, p)
    spans = [at[k] for k in sorted(at)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and max(parts) < 20
    found = repair.read_shards(spark, repair.write_shards(frame, WORD)).orderBy("start").collect()
    assert [r.doc_id or -1 for r in found] == sorted([-1 if k is None else k or -1 for k, _ in rows])
    want = sorted(zlib.crc32(stored([*ids_of(library, WORD, t), 1])) for _, t in rows)
    assert sorted(r.ids_crc32 for r in found) == want


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.integers(0, 5), min_size=1, max_size=400), low=st.integers(0, 50), span=st.integers(0, 60))
def test_grammar_gives_back_any_range(ids, low, span):
    values = np.array(ids * 20, dtype=np.int64)
    sequence, rules = repair.build_grammar(values, 1 << 16, min_count=2)
    first, sequence, rules = repair.smallest_symbols(sequence, rules, 1 << 16)
    lengths = repair.rule_lengths(rules.astype(np.int64), first).astype("<u4")
    shard = repair.Shard(first, rules.tobytes(), lengths.tobytes(), sequence.tobytes(), rules.itemsize, sequence.itemsize)
    assert (shard.ids() == values).all()
    assert (shard.ids(low, low + span) == values[low : low + span]).all()
    assert len(sequence) < len(values)


def pair_counts(sequence):
    """Places of each pair, none overlapping another of its kind."""
    found, last = {}, {}
    for p, pair in enumerate(zip(sequence, sequence[1:])):
        if last.get(pair, -2) < p - 1:
            found[pair], last[pair] = found.get(pair, 0) + 1, p
    return found


@settings(max_examples=150, deadline=None)
@given(ids=st.lists(st.integers(0, 4), min_size=1, max_size=300), times=st.integers(1, 9), least=st.integers(2, 6))
def test_no_frequent_pair_is_left(ids, times, least):
    sequence, rules = repair.build_grammar(np.array(ids * times), 1 << 16, min_count=least)
    assert max(pair_counts(sequence.tolist()).values(), default=0) < least
    assert (rules < (1 << 16) + np.arange(len(rules))[:, None]).all()


def test_a_repeated_passage_becomes_one_symbol():
    rng = np.random.default_rng(3)
    passage = rng.permutation(60_000)[:200]
    text = np.concatenate([np.concatenate([passage, rng.integers(0, 60_000, 3)]) for _ in range(500)])
    sequence, rules = repair.build_grammar(text, 1 << 16)
    assert repair.rule_lengths(rules, 1 << 16).max() == 200 and len(sequence) == 500 * 4


def test_op9_whole_table(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = catalog.op9_packing(spark, folder).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    total = 0
    for d in docs:
        ids = [*ids_of(library, BYTE, d.text or ""), 0]
        own = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        total += len(ids)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids) and all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(stored(ids[r.start : r.start + r.length]))
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(bins) <= 1.02 * total / 2048 + 2


def test_every_capacity_binds():
    lengths = np.array([10, 9, 8, 7, 6, 5, 4, 3, 2, 1] * 5)
    for score in ("norm", "dot"):
        for limits in ({"tokens": 20, "documents": 3, "cost": 150.0}, {"tokens": 20, "documents": 50, "cost": 110.0}):
            where, offset = packing.best_fit(lengths, **limits, weights=(1.0, 0.5, 0.5), score=score)
            for b in set(where.tolist()):
                own = lengths[where == b]
                assert own.sum() <= limits["tokens"] and len(own) <= limits["documents"]
                assert (own**2).sum() <= limits["cost"]
                assert sorted(offset[where == b].tolist())[0] == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([21]), tokens=20)


def test_groups_share_underfilled_sequences(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "id % 40 + 1 as length", "0L as ids_crc32", "id as slot")
    packed = packing.pack(rows, group_rows=64, tokens=100, documents=50, cost=1e4).collect()
    total, bins = sum(r.length for r in packed), {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append(r)
    assert len(packed) == 3000 and len(bins) <= total / 100 * 1.03 + 1
    for own in bins.values():
        ends = np.cumsum([r.length for r in sorted(own, key=lambda r: r.offset)]).tolist()
        assert ends[-1] <= 100 and [0, *ends[:-1]] == sorted(r.offset for r in own)


def test_packed_sequences_hold_the_ids(odd, library):
    packed = packing.pack_documents(odd, BYTE, with_ids=True)
    held = packing.sequences(packed).collect()
    texts = [r.text or "" for r in odd.collect()]
    want = sorted(i for t in texts for i in [*ids_of(library, BYTE, t), 0])
    assert sorted(np.frombuffer(b"".join(bytes(r.ids) for r in held), "<u4").tolist()) == want
    assert packing.pack_documents(odd.limit(0), BYTE).count() == 0


def test_op6_whole_table(spark, folder, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = catalog.op6_edited_counts(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]
        edited = text[: len(text) // 2] + text[:60] + text[len(text) // 2 + 40 :]
        edited = edited[10:]
        edited = edited[: len(text) + 60] + " and so on." + edited[len(text) + 60 :]
        assert r.tokens_before == len(ids_of(library, BYTE, text))
        assert r.tokens_after == len(ids_of(library, BYTE, edited))
        assert r.bytes_after == len(edited.encode())
    assert sum(r.reencoded_bytes for r in rows) < 0.2 * sum(r.bytes_after for r in rows)


@settings(max_examples=200, deadline=None)
@given(text=TEXTS, edits=st.lists(st.tuples(st.integers(0, 70), st.integers(0, 20), TEXTS), max_size=6))
def test_trees_follow_any_edits(library, text, edits):
    encoder = library_encoder(BYTE)
    tree = edit_counts.CountTree.of(text.encode(), encoder)
    for pos, drop, insert in edits:
        tree.edit(pos, drop, insert, encoder)
        text = text[:pos] + insert + text[pos + drop :]
        assert tree.text.decode() == text
        assert tree.n_tokens == len(ids_of(library, BYTE, text))


def test_stored_trees_take_later_edits(spark, odd, library):
    trees = edit_counts.build_trees(odd, BYTE)
    edits = spark.createDataFrame(
        [(4, 1, 100, 5, "new words"), (4, 2, 0, 3, ""), (3, 1, 7, 0, " big"), (99, 1, 0, 0, "x"), (2, 1, 5, 1, "hi")],
        "key long, seq int, pos long, drop long, insert string",
    )
    after = {r.key: r for r in edit_counts.apply_edits(trees, edits, BYTE).collect()}
    assert bytes(after[3].text).decode().startswith("the cat big sat")
    for r in after.values():
        assert r.n_tokens == len(ids_of(library, BYTE, bytes(r.text).decode()))
    assert after[4].reencoded_bytes < 1000 < len(after[4].text) and bytes(after[2].text) == b"hi"
    none = edit_counts.counts_after_edits(odd, F.lit(None), BYTE).collect()
    assert len(none) == odd.count() and all(r.tokens_before == r.tokens_after for r in none)
