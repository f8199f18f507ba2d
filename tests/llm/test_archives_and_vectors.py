"""Archives, nearest neighbours and the pipeline."""

import glob
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm import catalog, langid, quality, vptree, warc


def test_op7_whole_table(spark, folder):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = catalog.op7_warc(spark, folder).collect()
    assert len(rows) == len(pages)
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    for r in rows:
        body = pages[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        repeat = len(body) >= 100 and first[pages[r.page_id]] != r.page_id
        assert r.record_type == ("revisit" if repeat else "response")
        assert r.refers_to == (first[pages[r.page_id]] if repeat else None)


@pytest.fixture(scope="module")
def archived(spark):
    long = "x\r\n\r\nWARC/1.1\r\n" * 40
    rows = [
        (5, "http://a/\r\nX: y", long),
        (2, None, long),
        (None, "http://n/", long),
        (7, "http://b/", None),
        (8, "http://c/", "short"),
        (9, "http://d/", "short"),
        (10, "http://é/", "\x00é😀" * 50),
        (11, "http://big/", "".join(map(chr, range(32, 1000))) * 3000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'x' as digest", "1 as key", "2 as n_bytes")
    archives, index = warc.archive_pages(pages)
    return archives, index, rows


def test_archives_of_odd_pages(spark, archived):
    archives, _, rows = archived
    found = {r.page_id: r for r in warc.read_archives(spark, archives).collect()}
    assert len(found) == len(rows)
    assert found[2].record_type == "response"
    assert (found[5].record_type, found[5].refers_to) == ("revisit", 2)
    assert (found[None].record_type, found[None].refers_to) == ("revisit", 2)
    assert found[7].payload_bytes == 0
    assert {found[8].record_type, found[9].record_type} == {"response"}
    for k, _, html in rows:
        assert found[k].payload_digest == hashlib.sha256((html or "").encode()).hexdigest()


def test_index_finds_each_member(spark, archived):
    archives, index, rows = archived
    table = spark.read.parquet(index)
    assert table.count() == len(rows)
    whole = {tuple(r) for r in warc.read_archives(spark, archives).collect()}
    assert {tuple(r) for r in warc.read_by_index(spark, archives, table).collect()} == whole
    one = table.filter("record_id = '<urn:x-page:10>'")
    assert [r.page_id for r in warc.read_by_index(spark, archives, one).collect()] == [10]


def test_archives_hold_a_bounded_number_of_records(spark, archived):
    pages = spark.createDataFrame([(i, "u", f"{i % 30} " + "y" * 200) for i in range(100)], "page_id long, url string, html string")
    archives, index = warc.archive_pages(pages.coalesce(1), per_archive=7)
    table = spark.read.parquet(index)
    assert table.groupBy("archive").count().agg(F.max("count")).first()[0] == 7 and table.count() == 100
    found = {r.page_id: r.refers_to for r in warc.read_by_index(spark, archives, table).collect()}
    assert found == {i: i % 30 if i >= 30 else None for i in range(100)}


def test_archives_are_plain_gzip(archived):
    text = b"".join(gzip.open(p).read() for p in glob.glob(f"{archived[0]}/part-*"))
    assert text.count(b"WARC-Record-ID: ") == len(archived[2])


def test_empty_table_gives_no_records(spark):
    archives, index = warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(spark, archives).count() == spark.read.parquet(index).count() == 0


def brute(rows, asked, k):
    """rows: (id, vector) each; the answers of each query row, as sorted lists."""
    out = []
    for place in asked:
        own, v = rows[place]
        others = [
            (float(np.sqrt(np.cumsum((w - v) ** 2)[-1])), i) for at, (i, w) in enumerate(rows) if at != place and len(w) == len(v)
        ]
        out.append((own, sorted(others)[:k]))
    return sorted(out)


def answers(found):
    """The same, from (query_id, rank, vec_id, score); queries of one id are told apart by their order."""
    out, seen = {}, {}
    for r in found.orderBy("query_id", "rank", "score").collect():
        turn = seen[r.query_id, r.rank] = seen.get((r.query_id, r.rank), 0) + 1
        out.setdefault((r.query_id, turn), []).append((r.score, r.vec_id))
    return sorted((q, found) for (q, _), found in out.items())


def test_exact_search_equals_brute_force(spark):
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(3000, 8)).astype(np.float32)
    vectors[10] = vectors[900] = vectors[901]
    data = [(i, v.tolist()) for i, v in enumerate(vectors)]
    data += [(3001, None), (3002, [0.0] * 8), (3003, [1.0, None] + [1.0] * 6), (3004, [float("nan")] * 8), (None, [1.0] * 8)]
    data += [(10, vectors[10].tolist()), (3100, [1.0, 2.0]), (3200, [2.0, 2.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as dim", "3 as shard", "4 as copies")
    index = vptree.build_index(frame, "vec_id", "embedding", shard_rows=700)
    asked = frame.filter(F.col("vec_id") % 100 == 0)
    found = vptree.search(index, asked, "vec_id", "embedding", block=16)
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in data if i is not None and (i < 3000 or i in (3100, 3200))]
    assert answers(found) == brute(rows, [at for at, (i, _) in enumerate(rows) if i % 100 == 0], 10)
    loose = vptree.search(index, asked, "vec_id", "embedding", relax=1.6)
    share = vptree.recall(loose, found)
    assert 0.5 < share <= 1.0
    assert vptree.recall(found, found) == 1.0


def test_every_row_of_a_repeated_id_is_a_candidate_and_a_query(spark):
    data = [(0, [0.0, 0.1]), (1, [9.0, 9.0]), (1, [1.0, 0.1]), (2, [2.0, 2.0]), (2, [2.0, 2.0]), (100, [3.0, 1.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = vptree.nearest(frame, F.col("vec_id") % 100 == 0, k=5)
    rows = [(i, np.array(v)) for i, v in data]
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = {}
    for own, near in brute(rows, [0, 5, 6, 7], 5):
        want.setdefault(own, []).extend((rank, d, i) for rank, (d, i) in enumerate(near, start=1))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_op4_whole_table(spark, folder):
    rows = [
        (r.vec_id, np.array(r.embedding, dtype=np.float64))
        for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()
        if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)
    ]
    asked = [at for at, (i, _) in enumerate(rows) if i % 100 == 0]
    assert answers(catalog.op4_nearest(spark, folder)) == brute(rows, asked, 10)


def test_no_vectors_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(empty, F.col("vec_id") % 100 == 0).count() == 0


def test_stages_keep_what_their_operator_accepts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    good = corpus_pipeline.classify_quality(spark, docs, folder)
    model = quality.learn(docs, labels)
    scores = model.score(np.stack([quality.statistics((t or "").encode()) for t in rows.values()]))
    assert {r.doc_id for r in good.collect()} == {k for k, s in zip(rows, scores) if s >= 0.3}

    spoken = corpus_pipeline.identify_language(spark, docs, folder)
    model = langid.learn(docs)
    want = {k for k, t in rows.items() if model.predict(t)[0] != "und" and model.predict(t)[1] > 0.5 and model.known_share(t) >= 0.5}
    assert {r.doc_id for r in spoken.collect()} == want
    assert len(want) > 0.95 * len(rows)

    single = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    groups = brute_groups({k: t or "" for k, t in rows.items()})
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(g) for g in groups)
    assert good.columns == spoken.columns == single.columns == docs.columns


def brute_groups(texts):
    """Groups of keys linked by a five-word similarity of 0.8, over all pairs."""
    sets = {}
    for k, t in texts.items():
        words = t.encode().lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if (not either or both >= 0.8 * either) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for k in keys:
        out.setdefault(find(k), []).append(k)
    return list(out.values())


def test_stages_on_odd_rows_keep_defined_rows(spark, folder, odd):
    """Nulls, empty and repeated rows, ties: which rows of the odd table each stage keeps."""
    kept = lambda frame: sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in frame.collect())
    every = kept(odd)
    # no labels of these documents but by chance: one constant score or a fitted one, the rule is the same
    model = quality.learn(odd, spark.read.parquet(f"{folder}/labels.parquet"))
    score = {x: model.score(quality.statistics(x.encode())[None])[0] for _, _, x in every}
    assert kept(corpus_pipeline.classify_quality(spark, odd, folder)) == [x for x in every if score[x[2]] >= 0.3]
    model = langid.learn(odd)
    spoken = [x for x in every if model.predict(x[2])[1] > 0.5 and model.known_share(x[2]) >= 0.5]
    assert kept(corpus_pipeline.identify_language(spark, odd, folder)) == spoken
    assert all(any(c.isalpha() for c in x[2]) for x in spoken)
    # one of the empty texts (the smallest key), one of the repeated rows
    single = kept(corpus_pipeline.drop_near_duplicates(spark, odd, folder))
    assert [x[1] for x in single] == [0, 1, 3, 4, 6, 8] and single[0][2].startswith("le chat")
    packed = corpus_pipeline.pack_sequences(spark, odd, folder).collect()
    assert len({(r.doc_id, r.ids_crc32, r.sequence_id, r.offset) for r in packed if r.piece == 0}) == odd.count()


def test_pipeline_packs_what_is_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_stages_take_empty_and_odd_tables(spark, folder, odd):
    for rows in (odd.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, folder).columns == odd.columns
            stage(spark, rows, folder).collect()
        corpus_pipeline.pack_sequences(spark, rows, folder).collect()
