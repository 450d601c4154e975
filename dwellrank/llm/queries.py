"""Registered queries of the operators, each over its whole table, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellrank.llm import bpe, classifier, language_model, mixing, runs, token_files, transducer, warc, wrappers
from dwellrank.llm.blocks import exact_groups
from dwellrank.llm.common import shared_path
from dwellrank.llm.impact_search import top_documents
from dwellrank.llm.jaccard import jaccard_components
from dwellrank.llm.neardup_vectors import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _remainder(divisor: int):
    """crc32 of the doc_id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor))


@query("op1_quality_nbsvm")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = classifier.fit(docs, _table(spark, sf, "labels").where(_remainder(3) != 1))
    return classifier.score(docs, model).select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


@query("op2_bpe_codec")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query(
    "op5_block_naming",
    """
with t as (select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as body from documents)
select doc_id, first_value(doc_id) over (partition by body order by length(raw) desc, doc_id) as keep_id,
       count(*) over (partition by body) as group_size,
       doc_id = first_value(doc_id) over (partition by body order by length(raw) desc, doc_id) as kept,
       sha256(body) as text_sha256
from t
""",
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return exact_groups(_table(spark, sf, "documents"))


@query(
    "op6_jaccard_join",
    """
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
s as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) as shingle
  from d),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 80 * (a.n + b.n - o)),
r as (select doc_id, doc_id as reached from documents union select r.doc_id, l.y from r join l on l.x = r.reached)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reached) as component_id
from r left join n on n.doc_id = r.doc_id group by r.doc_id
""",
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(_table(spark, sf, "documents"))


@query("op7_pfair_mixing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_order(_table(spark, sf, "documents"))


@query("op10_token_transducer")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return transducer.token_counts(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op3_warc_dictionary",
    """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest,
         min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first < page_id then first end as refers_to
from p
""",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(_table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path).drop("url")


@query(
    "op8_vector_dedup",
    """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id, vec_id as reached from embeddings union select r.vec_id, l.y from r join l on l.x = r.reached),
n as (select x, count(*) as n from l group by x)
select r.vec_id, coalesce(any_value(n.n), 0) as n_links, min(reached) as component_id, min(reached) = r.vec_id as kept
from r left join n on n.x = r.vec_id group by r.vec_id
""",
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_table(spark, sf, "embeddings"))


@query("op4_wrapper_text")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf, "pages"))


@query("op9_context_mixing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf, "documents"), _remainder(10) == 0)


@query("op11_token_files")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read_token_files(spark, path)


@query("op13_lyndon_runs")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf, "documents"), tails=True)


@query(
    "op12_impact_search",
    """
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t from documents),
s as (select count(*) as big_n, sum(len(t))::bigint as big_l from d where len(t) > 0),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
p as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(t) as n, unnest(t) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, s group by term),
f as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::bigint as score
  from q join p using (term) join w using (term), s group by item_id, r, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from f where score > 0
qualify rank <= 10
""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return top_documents(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
