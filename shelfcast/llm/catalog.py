"""Queries over the training-data operators, with SQL where it can express their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import (
    automaton,
    digest,
    edit_counts,
    filter_audit,
    langid,
    max_sketch,
    packing,
    quality,
    repair,
    retrieval_packing,
    simhash,
    vptree,
    warc,
)
from shelfcast.llm.common import held_out, table
from shelfcast.llm.tokens import tokenizer_path


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at two bits or fewer."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=3, threshold=2)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("key").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.learn(docs)
    return langid.identify(docs, model, "text", F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"))


def op3_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = repair.write_shards(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return repair.read_shards(spark, path)


def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return vptree.nearest(rows, F.col("vec_id") % 100 == 0, k=10, relax=1.0)


OP4_SQL = """
with v as (
  select vec_id, row_number() over () as rid, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x : x <> 0)) > 0),
d as (
  select q.vec_id as query_id, q.rid, c.vec_id as vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e),
         lambda x : (x[2] - x[1]) * (x[2] - x[1])), lambda a, b : a + b)) as score
  from v q join v c on q.vec_id % 100 = 0 and q.rid <> c.rid and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by rid order by score, vec_id) as rank from d)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""


def op5_digests(spark: SparkSession, folder: str) -> DataFrame:
    return digest.neighbour_digests(table(spark, folder, "documents"))


def op6_edited_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after three edits: 40 code points in the middle give
    way to the document's first 60, its first 10 are dropped, and a clause is added at its end."""
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    length = F.length(text).cast("long")

    def edit(pos, drop, insert):
        return F.struct(pos.alias("pos"), F.lit(drop).cast("long").alias("drop"), insert.alias("insert"))

    middle = edit(F.floor(length / 2), 40, F.substring(text, 1, 60))
    edits = F.array(
        middle,
        edit(F.lit(0).cast("long"), 10, F.lit("")),
        edit(length + 60, 0, F.lit(" and so on.")),
    )
    found = edit_counts.counts_after_edits(docs, edits, tokenizer_path("byte_bpe_50k.json"))
    return found.withColumnRenamed("key", "doc_id")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page, read back through the offsets of the sidecar index."""
    archives, index = warc.archive_pages(table(spark, folder, "pages"))
    return warc.read_by_index(spark, archives, spark.read.schema(warc.INDEX_DDL).parquet(index))


OP7_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, octet_length(encode(body)) as n, sha256(body) as h from p),
f as (select h, min(page_id) as first from d where n >= 100 group by h)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.h as payload_digest,
       case when f.first <> d.page_id then 'revisit' else 'response' end as record_type,
       case when f.first <> d.page_id then f.first end as refers_to
from d left join f on d.h = f.h and d.n >= 100
"""


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.learn(docs, table(spark, folder, "labels"))
    return quality.scores(docs, model).select(
        F.col("key").alias("doc_id"),
        held_out(F.col("key")).alias("held_out"),
        "score",
        (F.col("score") >= quality.ACCEPTED).cast("int").alias("predicted"),
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0).drop("slot")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = automaton.encode_digests(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.withColumnRenamed("key", "doc_id")


def op11_max_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    found = max_sketch.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


OP11_SQL = r"""
with t as (
  select doc_id, row_number() over () as rid,
         list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                        lambda x : translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as terms
  from documents),
d as (select doc_id, rid, terms, len(terms) as n from t where len(terms) > 0),
c as (select count(*) as docs, cast(sum(n) as hugeint) as total from d),
f as (select rid, term, count(*) as tf from (select rid, unnest(terms) as term from d) group by all),
h as (select term, count(*) as df from f group by term),
q as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
           lambda x : translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) as term from benchmark)
  group by all),
s as (
  select q.item_id, d.rid, d.doc_id,
         sum(q.times * cast(floor(1000 * ln((2.0 * c.docs + 2) / (2.0 * h.df + 1))) as bigint)
             * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * d.n * c.docs) // c.total)))) as score
  from q join h using (term) join f using (term) join d using (rid) cross join c group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from r where rank <= 20
"""


def op12_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return retrieval_packing.pack_by_retrieval(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every order of five filters by language."""
    audit = filter_audit.FilterAudit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return audit.report()


OP13_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as body, coalesce(lang, '') as part, row_number() over () as rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
d as (
  select rid, part,
         len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
         100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * len(body) as c,
         regexp_matches(body, '[#$%&*|]') as d,
         coalesce(doc_id > min(doc_id) over (partition by body), false) as e,
         doc_id in (select doc_id from labels where quality = 1) as good,
         doc_id in (select doc_id from labels where toxic = 1) as toxic
  from w),
m as (
  select part, good, toxic, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as fails, count(*) as n from d group by all),
l(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select l1.letter || l2.letter || l3.letter || l4.letter || l5.letter as filter_order,
         [l1.bit, l2.bit, l3.bit, l4.bit, l5.bit] as bits
  from l l1, l l2, l l3, l l4, l l5 where l1.bit + l2.bit + l3.bit + l4.bit + l5.bit = 31
    and l1.bit | l2.bit | l3.bit | l4.bit | l5.bit = 31),
s as (
  select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from o, (select unnest(range(1, 6)) as step)),
x as (
  select p.part, s.filter_order, s.step, s.own,
         sum(case when m.fails & (s.before + s.own) = 0 then n else 0 end) as kept,
         sum(case when m.fails & s.own > 0 and m.fails & s.before = 0 then n else 0 end) as removed,
         sum(case when m.fails & s.own > 0 and m.fails & s.before > 0 then n else 0 end) as redundant,
         sum(case when m.fails = s.own then n else 0 end) as unique_fails,
         sum(case when m.fails & s.own > 0 and m.fails & s.before = 0 and good then n else 0 end) as good_lost,
         sum(case when m.fails & s.own > 0 and m.fails & s.before = 0 and toxic then n else 0 end) as toxic_lost
  from s cross join (select distinct part from m) p join m on m.part = p.part group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, own) as bigint) as shapley
from x
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_language,
        op3_token_shards,
        op4_nearest,
        op5_digests,
        op6_edited_counts,
        op7_warc,
        op8_quality,
        op9_packing,
        op10_bpe,
        op11_max_sketches,
        op12_retrieval_packing,
        op13_filter_audit,
    )
}

#: The other operators' rows hang on hashes, learned models or tokenizer files; tests compare them
#: with brute force.
ORACLE = {"op4_nearest": OP4_SQL, "op7_warc": OP7_SQL, "op11_max_sketches": OP11_SQL, "op13_filter_audit": OP13_SQL}
