"""Near-duplicates, language, digests and quality next to plain loops."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfcast.llm import catalog, components, digest, langid, quality, simhash
from shelfcast.llm.common import held_out


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, reach=2):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= reach:
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return [find(i) for i in range(len(fps))]


def test_op1_equals_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in catalog.op1_simhash(spark, folder).collect()}
    fps = [plain_fingerprint(r.text) for r in docs]
    groups = plain_groups(fps)
    assert len(found) == len(docs)
    for r, fp, g in zip(docs, fps, groups):
        assert found[r.doc_id].fingerprint == f"{fp:016x}"
        assert found[r.doc_id].component_id == docs[g].doc_id


def test_links_lose_nothing_for_either_code(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(8):
            bits = draw.choice(64, int(draw.integers(1, 4)), replace=False)
            values.add(b ^ sum(1 << int(x) for x in bits))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    want = {
        tuple(sorted(p))
        for p in itertools.combinations(signed, 2)
        if ((p[0] ^ p[1]) & ((1 << 64) - 1)).bit_count() <= 2
    }
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for blocks in (2, 3):
        got = {(r.a, r.b) for r in simhash.links(frame, 2, blocks).collect()}
        assert got == want


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 400)]
    links = spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")
    roots = {r.node: r.root for r in components.connected_components(links, "a", "b").collect()}
    assert all(roots[i] == 100 for i in range(100, 141))
    assert all(roots[i] == 7 for i in [7, *range(200, 400)])
    assert 5 not in roots


def test_near_duplicates_of_odd_rows(odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    zero = [r for r in found if r.fp == 0]
    assert {r.key for r in zero} == {1, 2, 7, None} and {r.component for r in zero} == {1}
    assert [r.component for r in found if r.key == 3] == [3, 3]
    kept = simhash.one_of_each_group(odd)
    assert kept.columns == odd.columns
    keys = [r.doc_id for r in kept.collect()]
    assert sorted(k or 0 for k in keys) == [0, 1, 3, 4, 6, 8]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_op2_whole_table(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = catalog.op2_language(spark, folder).collect()
    assert len(found) == len(docs)
    held = [r for r in found if r.held_out]
    assert 0 < len(held) < len(found)
    assert all(0.0 <= r.score <= 1.0 for r in found)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.95 * len(held)


def plain_language(learned, texts):
    """(language, share) of each text by loops over words and n-grams, learned from (language, text)."""

    def split(text):
        out, word = [], ""
        for c in text.lower():
            if c.isalpha():
                word += c
            elif word:
                out.append(word)
                word = ""
        return [*out, word] if word else out

    def cut(word, n):
        padded = f"<{word}>"
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    langs = sorted({lang for lang, _ in learned})
    orders = (0, 5, 4, 3, 2, 1)
    counts = {n: {lang: Counter() for lang in langs} for n in orders}
    for lang, text in learned:
        for word in split(text):
            counts[0][lang][word] += 1
            for n in orders[1:]:
                counts[n][lang].update(cut(word, n))
    logs = {}
    for n in orders:
        kept = [x for x in set().union(*counts[n].values()) if sum(counts[n][lang][x] for lang in langs) >= 2]
        totals = {lang: counts[n][lang].total() for lang in langs}
        for x in kept:
            row = [math.log((counts[n][lang][x] + 0.5) / (totals[lang] + 0.5 * (len(kept) + 1))) for lang in langs]
            logs[n, x] = [v - sum(row) / len(row) for v in row]
    out = []
    for text in texts:
        words, score = split(text or ""), [0.0] * len(langs)
        for word in words:
            rows = [logs[0, word]] if (0, word) in logs else []
            for n in orders[1:]:
                rows = rows or [logs[n, g] for g in cut(word, n) if (n, g) in logs]
            for row in rows:
                score = [s + v / len(rows) for s, v in zip(score, row)]
        if not words:
            out.append(("und", 0.0))
            continue
        shares = [math.exp(s - max(score)) for s in score]
        best = score.index(max(score))
        out.append((langs[best], shares[best] / sum(shares)))
    return out


def test_op2_equals_a_plain_model(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    taught = [(r.lang, r.text) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None]
    want = plain_language(taught, [r.text for r in docs])
    found = {r.doc_id: r for r in catalog.op2_language(spark, folder).collect()}
    for r, (lang, share) in zip(docs, want):
        assert found[r.doc_id].lang_pred == lang
        assert found[r.doc_id].score == pytest.approx(share, abs=2e-3)  # rows of the model are single precision


def test_signs_are_no_letters():
    assert langid.words_of("½ ² Ⅷ ①") == [] and langid.words_of("x² aⅧb É½e") == ["x", "a", "b", "é", "e"]
    model = langid.LanguageModel(["a", "b"], [{}] * 6, [np.array([1, 1])] * 6)
    assert model.predict("½ ² Ⅷ ①") == ("und", 0.0)


def test_unlearned_languages_and_gibberish_are_not_recognised(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.learn(docs)
    letters = "bcdfghjklmnpqrstvwxz"
    draw = np.random.default_rng(4)
    gibberish = " ".join("".join(draw.choice(list(letters), 9)) for _ in range(300))
    strange = "това е съвсем друг език който никой не е показал на модела и затова не бива да мине " * 20
    vowels = "aaeeiioouu yyyyuu ooaaee uuiioo " * 40
    planted = spark.createDataFrame([(1, gibberish), (2, strange), (3, vowels), (4, None), (5, "12")], "doc_id long, text string")
    assert langid.recognised(planted, model).count() == 0
    clean = docs.filter("lang is not null").filter(F.length("text") > 200)
    assert langid.recognised(clean, model).count() >= 0.98 * clean.count()


def test_limits_keep_the_most_frequent_items(spark):
    rows = [(0, f"w{i:03}", 2 + i % 7) for i in range(200)] + [(1, f"g{i}", 3) for i in range(50)] + [(2, "x", 2)]
    counted = spark.createDataFrame(rows, "kind int, item string, all long")
    got = {tuple(r) for r in langid._most_frequent(counted, 60, 20).collect()}
    want = set()
    for kind, limit in ((0, 60), (1, 20), (2, 20)):
        want |= set(sorted((r for r in rows if r[0] == kind), key=lambda r: (-r[2], r[1]))[:limit])
    assert got == want
    assert langid._most_frequent(counted, None, None).count() == len(rows)
    assert langid._most_frequent(counted, None, 20).count() == 221


def test_one_row_of_a_repeated_key_teaches(spark):
    docs = spark.createDataFrame([(1, "same words here", "en")] * 50 + [(2, "autres mots", "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality._sample(docs, labels, "doc_id", "text", "quality", 100).count() == 2
    assert langid.learn(docs, least_seen=1).langs == ["en", "fr"]


def test_language_of_odd_rows(odd):
    model = langid.learn(odd)
    found = {r.doc_id: r for r in langid.identify(odd, model, "text", F.col("doc_id")).collect()}
    assert [found[k].lang_pred for k in (1, 2, 7, 8)] == ["und"] * 4
    assert found[8].score == 0.0
    assert found[3].lang_pred in ("en", "fr")
    nothing = langid.learn(odd.limit(0))
    assert langid.identify(odd, nothing, "text", F.col("doc_id")).filter("lang_pred != 'und'").count() == 0


def test_words_come_before_shorter_and_shorter_grams():
    model = langid.LanguageModel(
        ["a", "b"],
        [{"known": np.array([9, 0])}, {}, {}, {"xyz": np.array([0, 9])}, {}, {"q": np.array([5, 0])}],
        [np.array([9, 9])] * 6,
    )
    assert model.predict("known")[0] == "a"
    assert model.predict("mxyzm")[0] == "b"
    assert model.predict("q")[0] == "a"
    assert model.predict("wwww") == ("a", 0.5)


def test_op5_equals_a_plain_loop(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in catalog.op5_digests(spark, folder).collect()}
    own = [digest.Digest.of((r.text or "").encode()) for r in docs]
    assert len(found) == len(docs)
    for i, r in enumerate(docs):
        text, following = r.text or "", docs[(i + 1) % len(docs)].text or ""
        tail = len(text) // 4
        edited = (text[: len(text) - tail] + following[:tail]).encode()
        row = found[r.doc_id]
        changed = digest.Digest.of(edited)
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (str(own[i]), str(changed))
        assert row.near_edited == digest.likeness(own[i], changed)
        assert row.near_next == digest.likeness(own[i], own[(i + 1) % len(docs)])
        assert 0.0 <= row.near_next <= 1.0
    closer = sum(r.near_edited > r.near_next for r in found.values())
    assert closer >= 0.9 * len(found)


def test_bucket_counts_equal_a_plain_loop():
    text = bytes(range(256)) * 3 + b"abc"
    counts = np.zeros(digest.BUCKETS, dtype=np.int64)
    first, second, third = digest.PLACES
    for i in range(len(text) - 4):
        for salt, (b, c) in enumerate(digest.TRIPLETS):
            value = int(first[text[i]]) + int(second[text[i + b]]) * (2 * salt + 3)
            counts[(value + (int(third[text[i + c]]) ^ (37 * salt))) % 256] += 1
    assert (digest.bucket_counts(text) == counts).all()
    assert digest.bucket_counts(b"abcd").sum() == 0
    d = digest.Digest.of(text)
    assert str(digest.Digest.parse(str(d))) == str(d) and digest.likeness(d, d) == 1.0


def test_digests_of_odd_rows(spark, odd):
    rows = digest.neighbour_digests(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_chars == 0 and by[1][0].near_edited == 1.0
    assert [r.near_next == 1.0 for r in by[3]].count(True) >= 1
    assert digest.neighbour_digests(odd.limit(0)).count() == 0
    single = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    only = digest.neighbour_digests(single).first()
    assert only.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and only.near_next == 1.0


def test_op8_whole_table(spark, folder):
    found = catalog.op8_quality(spark, folder).collect()
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0.0 <= r.score <= 1.0 and r.predicted == (r.score >= 0.3) for r in found)


def plain_statistics(text):
    """The 25 statistics by loops over bytes, words and lines."""
    out = [0.0] * 25
    if not text:
        return out
    n = len(text)
    kinds = [
        lambda b: chr(b).islower() and b < 128, lambda b: chr(b).isupper() and b < 128, lambda b: 48 <= b <= 57, lambda b: b == 32,
        lambda b: b in (9, 10, 11, 12, 13), lambda b: b < 128 and chr(b) in ".,;:?'\"-()", lambda b: b == 33,
        lambda b: b < 128 and chr(b) in "#$%&*|@/\\<>=+_{}[]^~`", lambda b: b >= 128,
    ]
    for i, kind in enumerate(kinds):
        out[i] = sum(kind(b) for b in text) / n
    out[9] = -sum(k / n * math.log2(k / n) for k in Counter(text).values())
    out[10] = math.log1p(n)
    words = text.split()
    if words:
        sizes, tally = [len(w) for w in words], Counter(words)
        mean = sum(sizes) / len(sizes)
        out[11:14] = math.log1p(len(words)), mean, math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes))
        out[14:17] = len(tally) / len(words), max(tally.values()) / len(words), len(tally) / math.sqrt(len(words))
        out[17:20] = (sum(f(w) for w in tally) / len(tally) for f in (lambda w: w[-1:].isalnum(), bytes.isupper, bytes.isdigit))
        out[20] = len({(a, b) for a, b in zip(words, words[1:])}) / max(1, len(words) - 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    if lines:
        tally = Counter(lines)
        out[21:25] = math.log1p(len(lines)), len(tally) / len(lines), sum(len(x) * (k - 1) for x, k in tally.items()) / n, math.log1p(n / len(lines))
    return out


def plain_isotonic(raw, label, bins):
    """Means of label over bins of ascending raw score; neighbours that don't ascend are merged."""
    order = sorted(range(len(raw)), key=lambda i: raw[i])
    size, extra = divmod(len(order), bins)
    blocks, at = [], 0
    for i in range(bins):
        own = order[at : at + size + (i < extra)]
        at += len(own)
        blocks.append(own)
    while any(np.mean(label[a]) >= np.mean(label[b]) for a, b in zip(blocks, blocks[1:])):
        i = next(i for i, (a, b) in enumerate(zip(blocks, blocks[1:])) if np.mean(label[a]) >= np.mean(label[b]))
        blocks[i : i + 2] = [blocks[i] + blocks[i + 1]]
    return [np.mean(raw[b]) for b in blocks], [float(np.mean(label[b])) for b in blocks]


def test_op8_equals_a_plain_model(spark, folder):
    """Statistics by loops, least squares on all rows at once, isotonic by repeated merging."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs}
    stats = {k: plain_statistics(t) for k, t in texts.items()}
    hashes = {r.doc_id: r.h for r in spark.createDataFrame([(k,) for k in texts], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    taught = [k for k in texts if zlib.crc32(str(k).encode()) % 5 and labels.get(k) is not None]
    fit, rest = [k for k in taught if hashes[k] % 4], [k for k in taught if hashes[k] % 4 == 0]
    x = np.array([stats[k] for k in fit])
    model = quality.QualityModel.fitted(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), quality.COMPONENTS, quality.GAMMA, quality.SEED)
    z, y = model.features(x), np.array([float(labels[k]) for k in fit])
    width = z.shape[1]
    penalty = np.full(width, quality.RIDGE * len(fit) / width + 1e-9)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y)
    held = rest if len(rest) >= 20 and len({labels[k] for k in rest}) > 1 else taught
    raw = model.raw(np.array([stats[k] for k in held]))
    steps, values = plain_isotonic(raw, np.array([float(labels[k]) for k in held]), min(quality.BINS, len(held)))
    found = {r.doc_id: r for r in catalog.op8_quality(spark, folder).collect()}
    for k in texts:
        want = float(np.interp(model.raw(np.array([stats[k]]))[0], steps, values))
        assert found[k].score == pytest.approx(want, abs=1e-3), k


def test_op8_finds_held_out_labels(spark):
    """Accuracy where it counts: on rows that took no part in learning."""
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in catalog.op8_quality(spark, folder).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert len(found) > 30
    assert sum(r.predicted == labels[r.doc_id] for r in found) >= 0.85 * len(found)


def test_a_fitted_model_scores_odd_rows(spark, folder, odd):
    model = quality.learn(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")))
    assert model.constant is None
    rows = quality.scores(odd, model).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    assert len(rows) == odd.count()
    want = sorted((k is not None, k or 0, float(model.score(np.array([plain_statistics(t)]))[0])) for k, own in texts.items() for t in own)
    got = sorted((r.key is not None, r.key or 0, r.score) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)
    assert quality.accepted(odd.limit(0), model).count() == 0


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (4, None), (6, 1), (None, 0)], "doc_id long, quality int")
    model = quality.learn(odd, labels)
    scores = quality.scores(odd, model).collect()
    assert len(scores) == odd.count() and all(r.score == scores[0].score for r in scores)
    assert quality.learn(odd, labels.limit(0)).constant == 0.5
    assert quality.statistics(b"").sum() == 0.0


def test_isotonic_never_falls():
    draw = np.random.default_rng(0)
    raw = draw.normal(size=2000)
    steps, values = quality.isotonic(raw, (draw.uniform(size=2000) < 1 / (1 + np.exp(-raw))).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(steps) > 0).all()


def test_held_out_is_the_crc_rule(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
