"""Registered queries over vectors: cosine, rankings, hybrid, rerank, pooling, overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellrank.functions import vectors as V
from dwellrank.functions.arrays import total
from dwellrank.operators import coverage as C, evaluate as E, retrieve as R
from dwellrank.plans import workload as D
from dwellrank.plans.corpora import big, r6
from dwellrank.plans.registry import query

# scores that agree to 12 digits rank by id on both sides
DIGITS = 12

SCORED = """
q as (select label, arg_min(embedding, vec_id)::double[] qv from embeddings group by label),
v as (select label, vec_id, null::varchar as reader_id, 'text' as condition, embedding::double[] vec from embeddings
      union all select label, vec_id, 'r' || j, 'actual_gaze', list_concat(embedding[j * 7 + 1:], embedding[:j * 7])::double[] from embeddings, (select unnest([1, 2, 3]) j)),
s as (select label::varchar as example_id, reader_id, condition, 'c' || vec_id as chunk_id,
             label || '::' || condition || '::' || coalesce(reader_id, 'none') || '::c' || vec_id as embedding_id, vec_id,
             round(list_dot_product(vec, qv) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(qv, qv))), 12) as score
      from v join q using (label)),
pairs as (select g.example_id, g.reader_id, g.chunk_id, t.score ts, g.score gs from s g join s t on t.example_id = g.example_id and t.chunk_id = g.chunk_id
          where g.condition = 'actual_gaze' and t.condition = 'text'),
"""
TOP3 = SCORED + """
r as (select *, row_number() over (partition by condition, example_id, reader_id order by score desc, embedding_id) rk from s),
top3 as (select * from r where rk <= 3),
"""


def scored(spark, sf):
    return R.score_chunks(D.chunk_vectors(spark, sf), D.label_queries(spark, sf))


def _out(ranked, *extra):
    return ranked.select("example_id", "reader_id", "condition", big(F.col("rank")).alias("rank"), "chunk_id", r6(F.col("score")).alias("score"), *extra)


@query("L5_topk_cosine", "with" + TOP3 + """z as (select 1)
select example_id, reader_id, condition, rk as rank, chunk_id, round(score, 6) as score from top3""")
def topk_cosine(spark, sf):
    return _out(R.retrieve_base(scored(spark, sf), 3, digits=DIGITS))


@query("P17_evidence", "with" + TOP3 + """z as (select 1)
select example_id, reader_id, condition, rk as rank, chunk_id, 'chunk ' || vec_id as text, (vec_id * 10)::bigint as char_start, (vec_id * 10 + 15)::bigint as char_end,
       null::double as alpha from top3""")
def evidence(spark, sf):
    e = R.to_evidence(R.retrieve_base(scored(spark, sf), 3, digits=DIGITS))
    return e.select("example_id", "reader_id", "condition", big(F.col("rank")).alias("rank"), "chunk_id", "text",
                    big(F.col("char_start")).alias("char_start"), big(F.col("char_end")).alias("char_end"), "alpha")


@query("L2_single_view_topk", "with" + SCORED + """
r as (select *, row_number() over (partition by example_id order by score desc, chunk_id) rk from s where condition = 'text')
select example_id, rk as rank, chunk_id, round(score, 6) as score from r where rk <= 10""")
def single_view(spark, sf):
    v = D.chunk_vectors(spark, sf).where(F.col("condition") == "text")
    ranked = R.retrieve_base(R.score_chunks(v, D.label_queries(spark, sf)), 10, tie="chunk_id", digits=DIGITS)
    return ranked.select("example_id", big(F.col("rank")).alias("rank"), "chunk_id", r6(F.col("score")).alias("score"))


@query("L1_unit_vectors", """
with e as (select vec_id, embedding::double[] v from embeddings), n as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) u from e)
select vec_id, unnest(range(len(u)))::bigint as d, round(unnest(u), 6) as x from n""")
def unit_vectors(spark, sf):
    e = D.table(spark, sf, "embeddings").select("vec_id", V.normalize(V.as_double(F.col("embedding"))).alias("u"))
    return e.select("vec_id", F.posexplode("u").alias("d", "x")).withColumns({"d": big(F.col("d")), "x": r6(F.col("x"))})


@query("V2_cosine", """
with q as (select label, arg_min(embedding, vec_id)::double[] qv from embeddings group by label)
select vec_id, round(list_dot_product(embedding::double[], qv) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(qv, qv))), 6) as cosine
from embeddings join q using (label)""")
def cosine(spark, sf):
    e = D.table(spark, sf, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.join(q, "label").select("vec_id", r6(V.cosine(V.as_double(F.col("embedding")), V.as_double(F.col("q")))).alias("cosine"))


@query("V7_scaled_rows", """
select vec_id, round(list_sum(embedding::double[]) * (label + 1), 5) as total from embeddings""")
def scaled_rows(spark, sf):
    e = D.table(spark, sf, "embeddings")
    rows = V.scale_rows(F.array(V.as_double(F.col("embedding"))), F.array((F.col("label") + 1).cast("double")))
    return e.select("vec_id", F.round(total(rows[0]), 5).alias("total"))


@query("A15_mean_pool", """
with d as (select label, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) i from embeddings),
m as (select label, i, avg(x) a from d group by 1, 2), n as (select label, sqrt(sum(a * a)) l from m group by 1)
select label::bigint as label, (i - 1)::bigint as d, round(a / l, 6) as x from m join n using (label)""")
def mean_pool(spark, sf):
    # element-wise means are combined on the map side; only one vector per label is then an array
    e = D.table(spark, sf, "embeddings").select("label", F.posexplode(V.as_double(F.col("embedding"))).alias("d", "x"))
    m = e.groupBy("label", "d").agg(F.avg("x").alias("x"))
    n = m.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return m.join(n, "label").select(big(F.col("label")).alias("label"), big(F.col("d")).alias("d"), r6(F.col("x") / F.col("l")).alias("x"))


@query("P16_embedding_ids", "with" + SCORED + "z as (select 1) select embedding_id, chunk_id from s")
def embedding_ids(spark, sf):
    v = D.chunk_vectors(spark, sf)
    return v.select(R.embedding_id(*[F.col(c) for c in ("example_id", "condition", "reader_id", "chunk_id")]).alias("embedding_id"), "chunk_id")


@query("J8_view_pairs", "with" + SCORED + "z as (select 1) select example_id, reader_id, chunk_id, round(ts, 6) as text_score, round(gs, 6) as gaze_score from pairs")
def view_pairs(spark, sf):
    s = scored(spark, sf)
    p = R.pair_views(s.where(F.col("condition") == "text"), s.where(F.col("condition") == "actual_gaze"))
    return p.select("example_id", "reader_id", "chunk_id", r6(F.col("text_score")).alias("text_score"), r6(F.col("gaze_score")).alias("gaze_score"))


def _pairs(spark, sf):
    s = scored(spark, sf)
    s = s.withColumn("score", F.round("score", DIGITS))
    return R.pair_views(s.where(F.col("condition") == "text"), s.where(F.col("condition") == "actual_gaze"))


@query("L6_hybrid", "with" + SCORED + """
h as (select *, 0.75::double * ts + 0.25::double * gs as score from pairs),
r as (select *, row_number() over (partition by example_id, reader_id order by round(score, 12) desc, chunk_id) rk from h)
select example_id, reader_id, 'hybrid_gaze_alpha_0p75' as condition, rk as rank, chunk_id, round(score, 6) as score,
       round(ts, 6) as text_score, round(gs, 6) as gaze_score, 0.75::double as alpha from r where rk <= 3""")
def hybrid(spark, sf):
    return _out(R.retrieve_hybrid(_pairs(spark, sf), 0.75, 3, DIGITS), r6(F.col("text_score")).alias("text_score"), r6(F.col("gaze_score")).alias("gaze_score"), "alpha")


@query("L7_rerank", "with" + SCORED + """
c as (select *, row_number() over (partition by example_id, reader_id order by ts desc, chunk_id) cr from pairs),
r as (select *, row_number() over (partition by example_id, reader_id order by gs desc, ts desc, chunk_id) rk from c where cr <= 10)
select example_id, reader_id, 'text_top10_gaze_rerank' as condition, rk as rank, chunk_id, round(gs, 6) as score, cr as text_candidate_rank, 10::bigint as candidate_top_n
from r where rk <= 3""")
def rerank(spark, sf):
    return _out(R.retrieve_rerank(_pairs(spark, sf), 10, 3, DIGITS), big(F.col("text_candidate_rank")).alias("text_candidate_rank"), big(F.col("candidate_top_n")).alias("candidate_top_n"))


@query("L8_pool_maxsim", "with" + SCORED + """
r as (select *, row_number() over (partition by example_id order by score desc, reader_id, chunk_id) rk from s where condition = 'actual_gaze')
select example_id, null::varchar as reader_id, 'actual_gaze_pool_maxsim' as condition, rk as rank, chunk_id, round(score, 6) as score, reader_id as selected_reader_id from r where rk <= 5""")
def pool_maxsim(spark, sf):
    s = scored(spark, sf)
    return _out(R.retrieve_pool(s.where(F.col("condition") == "actual_gaze"), 5, DIGITS), "selected_reader_id")


ALL_RESULTS = TOP3 + """
h as (select *, row_number() over (partition by example_id, reader_id order by round(0.75::double * ts + 0.25::double * gs, 12) desc, chunk_id) rk from pairs),
pool as (select *, row_number() over (partition by example_id order by score desc, reader_id, chunk_id) rk from s where condition = 'actual_gaze'),
allr as (select example_id, reader_id, condition, rk, chunk_id, vec_id from top3
   union all select example_id, reader_id, 'hybrid_gaze_alpha_0p75', rk, chunk_id, substring(chunk_id, 2)::bigint from h where rk <= 3
   union all select example_id, null, 'actual_gaze_pool_maxsim', rk, chunk_id, vec_id from pool where rk <= 3),
sets as (select condition, example_id, reader_id, list(distinct chunk_id) as cs, arg_min(chunk_id, rk) as top_chunk from allr group by 1, 2, 3),
ov as (select a.example_id, a.reader_id, a.condition, a.top_chunk, len(list_intersect(a.cs, t.cs)) / len(list_distinct(list_concat(a.cs, t.cs))) as j
       from sets a left join sets t on t.example_id = a.example_id and t.condition = 'text' where a.condition <> 'text'),
"""
CONDITIONS = ["text", "actual_gaze", "hybrid_gaze_alpha_0p75", "actual_gaze_pool_maxsim"]


def results(spark, sf):
    s = scored(spark, sf).withColumn("score", F.round("score", DIGITS))
    return R.retrieve(s, CONDITIONS, 3, DIGITS)


@query("O4_all_conditions", "with" + ALL_RESULTS + "z as (select 1) select example_id, reader_id, condition, rk as rank, chunk_id from allr")
def all_conditions(spark, sf):
    return results(spark, sf).select("example_id", "reader_id", "condition", big(F.col("rank")).alias("rank"), "chunk_id")


@query("S15_nested_results", "with" + ALL_RESULTS + """z as (select 1)
select example_id, reader_id, condition, string_agg(chunk_id, ',' order by rk) as ranked, count(*)::bigint as evidence from allr group by 1, 2, 3""")
def nested_results(spark, sf):
    n = R.nest_results(results(spark, sf))
    return n.select("example_id", "reader_id", "condition", F.array_join(F.transform("ranked_chunks", lambda c: c["chunk_id"]), ",").alias("ranked"),
                    big(F.size("metadata.evidence")).alias("evidence"))


@query("J12_retrieval_overlap", "with" + ALL_RESULTS + "z as (select 1) select example_id, reader_id, condition, top_chunk, round(j, 6) as jaccard_vs_text from ov")
def retrieval_overlap(spark, sf):
    o = E.retrieval_overlap(E.chunk_sets(results(spark, sf)))
    return o.select("example_id", "reader_id", "condition", "top_chunk", r6(F.col("jaccard_vs_text")).alias("jaccard_vs_text"))


@query("A6_overlap_by_condition", "with" + ALL_RESULTS + """z as (select 1)
select condition, count(j)::bigint as count, round(avg(j), 6) as mean, round(min(j), 6) as min, round(max(j), 6) as max from ov group by 1""")
def overlap_by_condition(spark, sf):
    o = E.overlap_by_condition(E.retrieval_overlap(E.chunk_sets(results(spark, sf))))
    return o.select("condition", big(F.col("count")).alias("count"), *[r6(F.col(c)).alias(c) for c in ("mean", "min", "max")])


@query("A7_results_per_condition", "with" + ALL_RESULTS + "z as (select 1) select condition, count(*)::bigint as records from sets group by 1")
def results_per_condition(spark, sf):
    return E.results_per_condition(E.chunk_sets(results(spark, sf)))


@query("J19_subset_embeddings", """
select 'c' || vec_id as chunk_id, label::varchar as example_id, 64::bigint as dim from embeddings""")
def subset_embeddings(spark, sf):
    v = D.chunk_vectors(spark, sf).where(F.col("condition") == "text")
    listed = D.table(spark, sf, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("chunk_id"))
    return R.subset_embeddings(listed, v).select("chunk_id", "example_id", big(F.size("vec")).alias("dim"))


@query("W9_last_wins", """
with z as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rk from events)
select user_id, event_type, value, event_id from z where rk = 1""")
def last_wins(spark, sf):
    e = D.table(spark, sf, "events").select("user_id", "event_type", "value", "event_id", F.struct("ts", "event_id").alias("o"))
    return E.last_wins(e, ["user_id", "event_type"], "o").select("user_id", "event_type", "value", "event_id")


GOLD = """
gold as (select label::varchar as example_id, min(vec_id) * 10 as a0, min(vec_id) * 10 + 5 as a1, max(vec_id) * 10 + 5 as d0, max(vec_id) * 10 + 20 as d1 from embeddings group by 1),
iv as (select r.*, vec_id * 10 as s0, vec_id * 10 + 15 as e0 from allr r),
cut as (select iv.*, k, count(*) over (partition by condition, example_id, reader_id, k) as n_all from iv, (select unnest([1, 3]) k)),
det as (select condition, example_id, reader_id, k, any_value(n_all) as avail,
   max((rk <= k and e0 > a0 and a1 > s0)::int) a_any_overlap, max((rk <= k and s0 <= a0 and e0 >= a1)::int) a_any_full,
   max((rk <= k and e0 > d0 and d1 > s0)::int) d_any_overlap, max((rk <= k and s0 <= d0 and e0 >= d1)::int) d_any_full
   from cut join gold using (example_id) group by 1, 2, 3, 4),
"""


def _gold(spark, sf):
    e = D.table(spark, sf, "embeddings").groupBy(D.text(F.col("label")).alias("example_id")).agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"))
    span = lambda a, b: F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
    lo, hi = F.col("lo") * 10, F.col("hi") * 10
    return e.select("example_id", F.lit("Adv").alias("level"), span(lo, lo + 5).alias("a_spans"), span(hi + 5, hi + 20).alias("d_spans"))


def _intervals(spark, sf):
    # every other chunk comes without offsets and is looked up among the embedding records
    e = results(spark, sf)
    hidden = F.substr("chunk_id", F.lit(2)).cast("bigint") % 2 == 0
    e = e.withColumns({c: F.when(~hidden, F.col(c)) for c in ("char_start", "char_end")})
    # pooled results have no reader: their offsets stay, as only the text record could name them
    records = D.chunk_vectors(spark, sf).drop("vec")
    # every key is there twice; the later record counts
    twice = F.explode(F.array(F.struct(F.lit(0).alias("src_ordinal"), F.lit(-5).alias("shift")), F.struct(F.lit(1).alias("src_ordinal"), F.lit(0).alias("shift"))))
    records = records.select("*", twice.alias("_o")).withColumns({"src_ordinal": F.col("_o.src_ordinal"), **{c: F.col(c) + F.col("_o.shift") for c in ("char_start", "char_end")}})
    return C.resolve_intervals(e, records.drop("_o"))


@query("J14_chunk_intervals", "with" + ALL_RESULTS + """z as (select 1)
select example_id, reader_id, condition, chunk_id, (vec_id * 10)::bigint as interval_start, (vec_id * 10 + 15)::bigint as interval_end from allr""")
def chunk_intervals(spark, sf):
    i = _intervals(spark, sf)
    return i.select("example_id", "reader_id", "condition", "chunk_id", big(F.col("interval.start")).alias("interval_start"), big(F.col("interval.end")).alias("interval_end"))


COVER = ["a_any_overlap", "a_any_full", "a_all_full", "d_any_overlap", "d_any_full", "d_all_full"]


@query("J15_span_coverage", "with" + ALL_RESULTS + GOLD + """z as (select 1)
select example_id, reader_id, condition, k::bigint as top_k, avail as available_ranked_chunks, a_any_overlap::bigint a_any_overlap, a_any_full::bigint a_any_full, a_any_full::bigint a_all_full,
  d_any_overlap::bigint d_any_overlap, d_any_full::bigint d_any_full, d_any_full::bigint d_all_full from det""")
def span_coverage(spark, sf):
    d = C.span_coverage(_intervals(spark, sf), _gold(spark, sf), [1, 3])
    return d.select("example_id", "reader_id", "condition", *[big(F.col(c)).alias(c) for c in ("top_k", "available_ranked_chunks", *COVER)])


@query("A10_coverage_summary", "with" + ALL_RESULTS + GOLD + """z as (select 1)
select condition, k::bigint as top_k, count(*)::bigint as count, round(avg(a_any_overlap), 6) a_any_overlap, round(avg(a_any_full), 6) a_any_full, round(avg(a_any_full), 6) a_all_full,
  round(avg(d_any_overlap), 6) d_any_overlap, round(avg(d_any_full), 6) d_any_full, round(avg(d_any_full), 6) d_all_full from det group by 1, 2""")
def coverage_summary(spark, sf):
    s = C.coverage_summary(C.span_coverage(_intervals(spark, sf), _gold(spark, sf), [1, 3]))
    return s.select("condition", big(F.col("top_k")).alias("top_k"), "count", *[r6(F.col(c)).alias(c) for c in COVER])
