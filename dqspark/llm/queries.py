"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, chunks, cross_polytope, decontaminate, fixity, html_text, language, multi_index, near_duplicates, packing, pieces, private, quality
from .work import table, written


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archives, and a replica in which a byte of each 97th page is another one, each 101st page is missing and
    each fifth archive has a record more: the audit finds these records and no others."""
    page, record = F.col("page_id"), F.col("record")
    middle = F.floor(F.octet_length(record) / 2).cast("int")
    flipped = F.concat(F.substring(record, F.lit(1), middle), F.unhex(F.lit("00")), F.substring(record, middle + 2, F.octet_length(record)))
    held = F.when(page % 101 == 5, None).when(page % 97 == 3, flipped).otherwise(record)
    manifest = written(fixity.archive_records(table(spark, sf_dir, "pages"), held=held), "archive")
    places = ["archive", "ordinal", "offset", "length"]
    replica = manifest.where("held_digest is not null").select(*places, F.col("held_digest").alias("digest"))
    last = manifest.groupBy("archive").agg((F.max("ordinal") + 1).alias("ordinal"), F.max(F.col("offset") + F.col("length")).alias("offset")).where("archive % 5 = 0")
    extra = last.select("archive", "ordinal", "offset", F.lit(4).cast("long").alias("length"), F.sha2(F.lit("more"), 256).alias("digest"))
    return fixity.audit(manifest, replica.unionByName(extra))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.personal_data(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.hard_negatives(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_neighbours, op3_language, op4_repeated_passages, op5_near_duplicates, op6_packing, op7_quality, op8_fixity, op9_personal_data, op10_main_text, op11_lexical_search, op12_pieces, op13_hard_negatives, pipeline)}

#: DuckDB SQL for the queries that SQL can express. The audit's result is known from the rule that damaged the replica.
ORACLE = {
    "op8_fixity": r"""
with records as (
  select page_id, page_id // 256 as archive, count(*) as copies,
         octet_length(encode(coalesce(html, ''))) as body,
         octet_length(encode(coalesce(url, ''))) + length(cast(page_id as varchar)) as named, url, html
  from pages group by page_id, url, html
), sized as (
  select page_id, archive, html,
         body + named + length(cast(body as varchar))
         + length('WARC/1.0WARC-Type: resourceWARC-Target-URI: WARC-Record-ID: <urn:page:>Content-Type: text/htmlContent-Length: ') + 2 * 9 as length
  from records
), placed as (
  select *, row_number() over w - 1 as ordinal, coalesce(sum(length) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0) as "offset"
  from sized window w as (partition by archive order by page_id)
), ends as (
  select archive, max(ordinal) + 1 as ordinal, max("offset" + length) as "offset" from placed group by archive
)
select cast(archive as bigint) as archive, cast(ordinal as bigint) as ordinal, cast("offset" as bigint) as "offset", cast(length as bigint) as length, page_id,
       case when page_id % 101 = 5 then 'missing' else 'changed' end as status
from placed where page_id % 101 = 5 or page_id % 97 = 3
union all
select cast(archive as bigint), cast(ordinal as bigint), cast("offset" as bigint), 4, null, 'extra' from ends where archive % 5 = 0
""",
    "op11_lexical_search": r"""
with listed as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), totals as (
  select count(*) as n_docs, sum(len(terms)) as n_terms from listed where len(terms) > 0
), counted as (
  select row, term, count(*) as tf from (select row, unnest(terms) as term from listed) group by row, term
), frequencies as (
  select term, count(*) as df from counted group by term
), weights as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from frequencies, totals
), lengths as (
  select row, doc_id, 100 - 25 + (25 * len(terms) * n_docs) // n_terms as m from listed, totals where len(terms) > 0
), wanted as (
  select item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select distinct item_id, text from benchmark)
), repeated as (
  select item_id, text, term, count(*) as times from wanted group by item_id, text, term
), scored as (
  select item_id, text, row, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from repeated join weights using (term) join counted using (term) join lengths using (row)
  group by item_id, text, row, doc_id
), ranked as (
  select *, row_number() over (partition by item_id, text order by score desc, doc_id asc nulls last) as rank from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 20
""",
    "op13_hard_negatives": r"""
with rows as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as vector
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, r.vec_id as row_id, a.label = r.label as same, cast(list_dot_product(a.vector, r.vector) as bigint) as score
  from rows a join rows r on a.vec_id <> r.vec_id and len(a.vector) = len(r.vector) where a.vec_id % 100 = 0
), positives as (
  select anchor_id, row_id as positive_id, score as positive_score
  from scored where same qualify row_number() over (partition by anchor_id order by score desc, row_id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, row_id as negative_id, positive_score, score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, row_id)
qualify row_number() over w <= 5
""",
}
