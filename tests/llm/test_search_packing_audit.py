"""Ranked search, packing by retrieval and the filter audit next to brute force."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfcast.llm import catalog, filter_audit, max_sketch, retrieval_packing
from shelfcast.llm.terms import terms_of
from shelfcast.llm.tokens import tokenizer_path

BYTE = tokenizer_path("byte_bpe_50k.json")


# ---- ranked search ------------------------------------------------------------------------------


def plain_terms(text):
    out, word = [], ""
    for c in text or "":
        if ord(c) >= 128 or c.isascii() and c.isalnum():
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def brute_ranking(docs, items, k):
    """docs: (key, text) rows; items: id to text. The k best as (rank, key, score)."""
    tallies = [(key, Counter(plain_terms(text))) for key, text in docs]
    tallies = [(key, t) for key, t in tallies if t]
    n, total = len(tallies), sum(t.total() for _, t in tallies)
    df = Counter(w for _, t in tallies for w in t)
    out = {}
    for item, text in items.items():
        found = []
        for key, t in tallies:
            m = 75 + 25 * t.total() * n // total
            score = 0
            for w in plain_terms(text):
                if t[w]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t[w] // (1000 * t[w] + 12 * m))
            if score > 0:
                found.append((-score, key is None, key or 0))
        out[item] = [(rank, None if none else key, -s) for rank, (s, none, key) in enumerate(sorted(found)[:k], start=1)]
    return out


def ranking(found):
    out = {}
    for r in found.orderBy("item", "rank").collect():
        out.setdefault(r["item"], []).append((r["rank"], r["key"], r["score"]))
    return out


@pytest.mark.parametrize("text", ["Aa1-b_c É日本 x\x00y\x7f½²", "", "--", "  a"])
def test_terms_are_the_maximal_runs(text):
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


def test_search_of_crowded_collections_is_exact(spark, monkeypatch):
    """Few coordinates, so that most bounds are loose; copies, ties, repeated keys and odd rows."""
    monkeypatch.setattr(max_sketch, "WIDEN", 2)
    draw = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choice(words, size=draw.integers(1, 60))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(1000 + i, "w1 w2 w3 w3 w250") for i in range(60)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2 w3"), (None, None), (2000, ""), (2001, "..")]
    items = {i: " ".join(draw.choice(words, size=12)) for i in range(12)} | {50: "w1 w2 w3", 51: "nothing here", 52: "", 53: None}
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as size", "'x' as digest", "2 as key", "3 as value", "4 as place")
    asked = spark.createDataFrame(list(items.items()), "item_id long, text string").selectExpr("*", "0 as query", "'y' as item")
    want = {i: x for i, x in brute_ranking(docs, items, 20).items() if x}
    for coordinates in (1 << 16, 64):
        assert ranking(max_sketch.ranked(frame.repartition(3), asked, k=20, block=9, coordinates=coordinates)) == want


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert max_sketch.ranked(docs.limit(0), items).count() == 0
    assert max_sketch.ranked(docs, items.limit(0)).count() == 0
    assert ranking(max_sketch.ranked(docs, items)).keys() == {1}


def test_sketches_bound_every_term():
    draw = np.random.default_rng(3)
    tally = Counter({f"t{i}".encode(): int(n) for i, n in enumerate(draw.zipf(1.5, size=5000))})
    places, peaks = (np.frombuffer(x, t) for x, t in zip(max_sketch.sketch(tally), ("<u2", "u1")))
    held = dict(zip(places.tolist(), peaks.tolist()))
    assert (np.diff(places.astype(int)) > 0).all()
    for term, n in tally.items():
        assert held[max_sketch.coordinate(term) & (max_sketch.COORDINATES - 1)] >= min(n, max_sketch.MOST)


def test_op11_whole_table(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = {}
    for r in catalog.op11_max_sketches(spark, folder).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    assert got == {i: x for i, x in brute_ranking(docs, items, 20).items() if x}


# ---- packing by retrieval -----------------------------------------------------------------------


def check_packing(rows, docs, sequence, library):
    """Every id once, offsets gapless, no sequence needs padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == sequence or at < sequence and at & (at - 1) == 0
    found = sorted(x for own in by_doc.values() for x in pieces_of(own))
    want = []
    for key, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((key is not None, key or 0, len(ids), zlib.crc32(ids.tobytes())))
    assert [x[:3] for x in found] == sorted(x[:3] for x in want)
    return by_doc


def pieces_of(own):
    """(known, key, tokens) of each document among the pieces of one key."""
    starts = sorted((r.start, r.length, r.doc_tokens) for r in own)
    assert sum(length for _, length, _ in starts) == sum(n for at, _, n in starts if at == 0)
    key = own[0].doc_id
    return [(key is not None, key or 0, n) for at, _, n in starts if at == 0]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def test_op12_whole_table(spark, folder, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    by_doc = check_packing(catalog.op12_retrieval_packing(spark, folder).collect(), docs, 1024, library)
    for key, text in docs:
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4"), 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids) == r.doc_tokens


def test_packing_of_odd_rows_and_many_shards(spark, odd, library, tmp_path):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    odd.write.parquet(str(tmp_path / "odd"))
    rows = spark.read.parquet(str(tmp_path / "odd"))
    check_packing(retrieval_packing.pack_by_retrieval(rows, BYTE, sequence=64).collect(), docs, 64, library)
    made = retrieval_packing.pack_by_retrieval(rows, BYTE, sequence=64, shard_bytes=200, with_ids=True).collect()
    check_packing(made, docs, 64, library)
    assert sum(len(r.ids) // 4 for r in made) == sum(r.length for r in made)
    assert len({r.sequence_id >> 32 for r in made}) > 2
    assert retrieval_packing.pack_by_retrieval(rows.limit(0), BYTE).count() == 0


def test_a_bucket_of_copies_is_spread():
    sizes = np.zeros(retrieval_packing.BUCKETS, np.int64)
    sizes[[5, 9, 700]] = [100, 10_000, 50]
    shards = retrieval_packing.Shards(sizes, 1000)
    hot = shards.of(np.full(5000, 9), np.arange(5000))
    counts = np.bincount(hot)[1:]
    assert set(hot.tolist()) == set(range(1, 11)) and counts.max() < 1.5 * counts.mean()
    assert not {int(shards.of(np.array([b]), np.array([3]))[0]) for b in (5, 700)} & set(hot.tolist())


def test_answers_follow_bm25():
    draw = np.random.default_rng(11)
    words = [f"w{i}".encode() for i in range(80)]
    tallies = [Counter(draw.choice(words, size=draw.integers(2, 40)).tolist()) for _ in range(60)]
    index = retrieval_packing.LexicalIndex(iter(tallies), query_terms=1000)
    df, mean = Counter(w for t in tallies for w in t), np.mean([t.total() for t in tallies])
    for seed in range(60):
        for doc, tally in enumerate(tallies):
            want = sum(
                math.log1p((60 - df[w] + 0.5) / (df[w] + 0.5)) * tally[w] * 2.2 / (tally[w] + 1.2 * (0.25 + 0.75 * tally.total() / mean))
                for w in tallies[seed]
                if w in tally and df[w] > 1
            )
            assert index.scores(seed)[doc] == pytest.approx(want, rel=1e-5, abs=1e-9)
        free = draw.uniform(size=60) < 0.5
        value = np.where(free, index.scores(seed), 0)
        assert index.unused(seed, free, 5) == [i for i in np.argsort(-value, kind="stable")[:5] if value[i] > 0]


def test_windows_hold_the_seeds_neighbours():
    """Two topics dealt alternately: windows stay within a topic as long as it lasts."""
    draw = np.random.default_rng(2)
    topics = [[f"{t}{i}".encode() for i in range(12)] for t in "ab"]
    tallies = [Counter(draw.choice(topics[i % 2], size=10).tolist()) for i in range(40)]
    index = retrieval_packing.LexicalIndex(iter(tallies))
    placed = retrieval_packing.fill_windows([10] * 40, index, sequence=100)
    windows = {}
    for doc, _, _, window, _ in placed:
        windows.setdefault(window, set()).add(doc % 2)
    assert sum(len(x) for x in windows.values()) == len(windows)


@settings(max_examples=150, deadline=None)
@given(sizes=st.lists(st.integers(1, 300), min_size=1, max_size=30), sequence=st.sampled_from([16, 64, 100]))
def test_windows_are_full_and_ends_are_powers_of_two(sizes, sequence):
    index = retrieval_packing.LexicalIndex(Counter({b"t%d" % (i % 4): 1}) for i in range(len(sizes)))
    placed = retrieval_packing.cut_end(retrieval_packing.fill_windows(sizes, index, sequence), sequence)
    filled, starts = Counter(), {}
    for doc, start, length, window, offset in placed:
        assert offset == filled[window] and length > 0
        filled[window] += length
        starts.setdefault(doc, []).append((start, length))
    assert all(n == sequence or n & (n - 1) == 0 for n in filled.values())
    assert all(n <= sequence for n in filled.values())
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(starts[doc]):
            assert start == at
            at += length
        assert at == size


# ---- filter audit -------------------------------------------------------------------------------


def brute_audit(docs, labels):
    """docs: (key, text, part). The report's rows as a set of tuples."""
    spaces = " \t\n\x0b\x0c\r"
    first, rows = {}, []
    for key, text, _ in docs:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    for key, text, part in docs:
        body, words, word = text or "", [], ""
        for c in body:
            if c in spaces:
                words += [word] if word else []
                word = ""
            else:
                word += c
        words += [word] if word else []
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in body) > 3 * len(body),
            "D": any(c in "#$%&*|" for c in body),
            "E": key is not None and first[body] < key,
        }
        marks = [any(k == key and key is not None and row[i] == 1 for k, *row in labels) for i in (0, 1)]
        rows.append((part or "", {f for f, x in fails.items() if x}, *marks))
    out = set()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed, orders = Counter(), {}
        for order in itertools.permutations("ABCDE"):
            left, steps = own, []
            for f in order:
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                steps.append((f, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[2] for r in gone), sum(r[3] for r in gone)))
                removed[f] += len(gone)
            orders["".join(order)] = steps
        for name, steps in orders.items():
            for step, (f, kept, gone, again, good, toxic) in enumerate(steps, start=1):
                alone = sum(r[1] == {f} for r in own)
                out.add((part, name, step, kept, gone, again, alone, good, toxic, removed[f]))
    return out


NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_brute_force(spark, odd):
    long = " ".join(f"word{i}" for i in range(250))
    docs = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    docs += [(20 + i, long, "en") for i in range(4)] + [(30, long.upper(), "en"), (31, "same " * 300, None), (32, "same " * 300, None)]
    docs += [(33, long + " $", "de"), (33, long + " $", "de"), (34, long + "#", "de"), (None, long, "en"), (40, " ".join("ab" * 210), "en")]
    labels = [(20, 1, 0), (21, 1, 1), (21, 1, 1), (30, 0, 1), (33, None, 1), (None, 1, 1), (3, 1, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    frame = frame.selectExpr("*", "1 as rid", "'x' as key", "2 as filter", "3 as mask", "4 as digest")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' as key")
    got = filter_audit.FilterAudit(frame.repartition(3), marks).report().collect()
    assert {tuple(r[n] for n in NAMES) for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * len({d[2] for d in docs})


def test_audit_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert filter_audit.FilterAudit(docs.limit(0), labels).report().count() == 0
    bare = filter_audit.FilterAudit(docs, labels.limit(0)).report()
    assert bare.filter("good_lost > 0 or toxic_lost > 0").count() == 0 and bare.count() > 0


def test_op13_whole_table(spark, folder):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {tuple(r[n] for n in NAMES) for r in catalog.op13_filter_audit(spark, folder).collect()}
    assert got == brute_audit(docs, labels)
