"""Registered queries over predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellrank.operators import answer as N, evaluate as E
from dwellrank.operators.ordering import position_in_group
from dwellrank.plans import workload as D
from dwellrank.plans.corpora import big, r6
from dwellrank.plans.registry import query

PREDICTIONS = """
p as (select (o_orderkey // 8)::varchar as example_id, case when o_orderkey % 8 between 1 and 5 then 'r' || (o_orderkey % 8) end as reader_id,
   ['text','actual_gaze','actual_gaze','actual_gaze','shuffled_gaze','shuffled_gaze','mean_gaze','bare_model'][o_orderkey % 8 + 1] as condition,
   case when not o_orderpriority like '5%' then o_custkey % 4 end as predicted_index,
   case when (o_orderkey // 8) % 17 <> 0 then (o_orderkey // 8) % 4 end as gold_index, o_orderkey as src_ordinal from orders),
sc as (select *, (predicted_index = gold_index)::int as correct from p where predicted_index is not null and gold_index is not null),
base as (select * from sc where condition = 'text'),
pr as (select t.condition, t.example_id, t.reader_id, t.correct as ct, coalesce(e.correct, f.correct) as cb
   from sc t left join base e on e.example_id = t.example_id and e.reader_id is not distinct from t.reader_id
   left join base f on f.example_id = t.example_id and f.reader_id is null
   where t.condition <> 'text' and coalesce(e.correct, f.correct) is not null),
"""


@query("P9_correctness", "with" + PREDICTIONS + """z as (select 1)
select condition, (predicted_index = gold_index) as correct, count(*)::bigint as n from p group by 1, 2""")
def correctness(spark, sf):
    return D.predictions(spark, sf).groupBy("condition", E.correctness().alias("correct")).agg(F.count("*").alias("n"))


@query("P8_scored_rows", "with" + PREDICTIONS + "z as (select 1) select condition, count(*)::bigint as n from sc group by 1")
def scored_rows(spark, sf):
    return E.scored_only(D.predictions(spark, sf)).groupBy("condition").agg(F.count("*").alias("n"))


@query("A1_grouped_accuracy", "with" + PREDICTIONS + """z as (select 1)
select condition, reader_id, round(avg((predicted_index = gold_index)::int), 6) as accuracy, count(*)::bigint as count, count(predicted_index)::bigint as scored_count,
       round(1 - avg((predicted_index is not null)::int), 6) as missing_parse_rate from p where gold_index is not null group by 1, 2""")
def grouped_accuracy(spark, sf):
    a = E.accuracy_by_group(D.predictions(spark, sf))
    return a.select("condition", "reader_id", r6(F.col("accuracy")).alias("accuracy"), "count", "scored_count", r6(F.col("missing_parse_rate")).alias("missing_parse_rate"))


@query("A2_accuracy", "with" + PREDICTIONS + "z as (select 1) select round(avg(correct), 6) as accuracy from sc")
def accuracy(spark, sf):
    return E.accuracy(D.predictions(spark, sf)).select(r6(F.col("accuracy")).alias("accuracy"))


@query("J11_paired_rows", "with" + PREDICTIONS + """z as (select 1)
select condition, example_id, reader_id, ct::double as correct_treatment, cb::double as correct_baseline, (ct - cb)::double as delta from pr""")
def paired_rows(spark, sf):
    return E.paired_rows(D.predictions(spark, sf), "text")


@query("A4_paired_deltas", "with" + PREDICTIONS + """
s as (select condition, count(*) n, avg(ct - cb) m, case when count(*) = 1 then 0 else stddev_samp(ct - cb) / sqrt(count(*)) end se from pr group by 1)
select 'text' as baseline, condition as treatment, n::bigint as n, round(m, 6) as mean_delta, round(se, 6) as standard_error, round(m - 1.96 * se, 6) as ci95_low, round(m + 1.96 * se, 6) as ci95_high from s""")
def paired_deltas(spark, sf):
    d = E.paired_deltas(D.predictions(spark, sf), "text")
    return d.select("baseline", "treatment", "n", *[r6(F.col(c)).alias(c) for c in ("mean_delta", "standard_error", "ci95_low", "ci95_high")])


@query("A3_one_comparison", "with" + PREDICTIONS + """
s as (select count(*) n, avg(ct - cb) m, stddev_samp(ct - cb) / sqrt(count(*)) se from pr where condition = 'actual_gaze')
select 'text' as baseline, 'actual_gaze' as treatment, n::bigint as n, round(m, 6) as mean_delta, round(se, 6) as standard_error from s""")
def one_comparison(spark, sf):
    d = E.compare_conditions(D.predictions(spark, sf), "text", "actual_gaze")
    return d.select("baseline", "treatment", "n", r6(F.col("mean_delta")).alias("mean_delta"), r6(F.col("standard_error")).alias("standard_error"))


@query("J13_gain_rows", "with" + PREDICTIONS + """
g as (select * from sc where condition in ('actual_gaze', 'mean_gaze', 'shuffled_gaze')),
res as (select condition, example_id, reader_id, ['c' || (src_ordinal % 5), 'c' || (src_ordinal % 3 + 5)] as cs from p)
select g.example_id, g.reader_id, g.condition, (g.correct - t.correct)::bigint as delta_vs_text, g.correct::bigint as treatment_correct, t.correct::bigint as text_correct,
   round(len(list_intersect(o.cs, x.cs)) / len(list_distinct(list_concat(o.cs, x.cs))), 6) as retrieval_jaccard_vs_text, st.concentration
from g join base t on t.example_id = g.example_id and t.reader_id is null
left join res o on o.condition = g.condition and o.example_id = g.example_id and o.reader_id is not distinct from g.reader_id
left join res x on x.condition = 'text' and x.example_id = g.example_id
left join (select example_id, reader_id, round((src_ordinal % 100) / 100.0::double, 6) as concentration from p where reader_id is not null) st
  on st.example_id = g.example_id and st.reader_id is not distinct from g.reader_id""")
def gain_rows(spark, sf):
    p = D.predictions(spark, sf)
    k = F.col("src_ordinal")
    results = p.select("condition", "example_id", "reader_id", F.array(F.concat(F.lit("c"), D.text(k % 5)), F.concat(F.lit("c"), D.text(k % 3 + 5))).alias("chunks"))
    stats = p.where(F.col("reader_id").isNotNull()).select("example_id", "reader_id", F.round((k % 100) / 100.0, 6).alias("concentration"))
    g = E.gain_rows(p, results, stats)
    return g.select("example_id", "reader_id", "condition", *[big(F.col(c)).alias(c) for c in ("delta_vs_text", "treatment_correct", "text_correct")],
                    r6(F.col("retrieval_jaccard_vs_text")).alias("retrieval_jaccard_vs_text"), "concentration")


@query("A5_jaccard", """
select o_orderkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as jaccard
from (select o_orderkey, [o_orderkey % 3, o_orderkey % 5 + 1] a, [o_custkey % 3, o_custkey % 4 + 2] b from orders)""")
def jaccard(spark, sf):
    from dwellrank.functions.scores import jaccard as overlap

    o = D.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select("o_orderkey", r6(overlap(F.array(k % 3, k % 5 + 1), F.array(c % 3, c % 4 + 2))).alias("jaccard"))


@query("J16_pending", "with" + PREDICTIONS + """d as (select condition, example_id, reader_id from p where src_ordinal % 3 = 0)
select p.condition, p.example_id, p.reader_id from p where not exists (select 1 from d where d.condition = p.condition and d.example_id = p.example_id and d.reader_id is not distinct from p.reader_id)""")
def pending(spark, sf):
    p = D.predictions(spark, sf)
    done = p.where(F.col("src_ordinal") % 3 == 0)
    return N.pending(p, done).select("condition", "example_id", "reader_id")


@query("P15_prediction_keys", "with" + PREDICTIONS + """z as (select 1)
select '["' || condition || '","' || example_id || '",' || coalesce('"' || reader_id || '"', 'null') || ']' as key from p""")
def prediction_keys(spark, sf):
    return D.predictions(spark, sf).select(N.prediction_key().alias("key"))


@query("P7_condition_filter", "with" + PREDICTIONS + "z as (select 1) select condition, count(*)::bigint as n from p where condition in ('text', 'mean_gaze') group by 1")
def condition_filter(spark, sf):
    p = D.predictions(spark, sf).where(F.col("condition").isin("text", "mean_gaze"))
    return p.groupBy("condition").agg(F.count("*").alias("n"))


@query("O5_distinct_conditions", "with" + PREDICTIONS + "z as (select 1) select distinct condition from p")
def distinct_conditions(spark, sf):
    return D.predictions(spark, sf).select("condition").distinct()


@query("L12_report_order", "with" + PREDICTIONS + """
a as (select condition, reader_id, count(*) n from p where gold_index is not null group by 1, 2)
select condition, reader_id, (row_number() over (order by condition, reader_id nulls first))::bigint as position from a""")
def report_order(spark, sf):
    a = E.accuracy_by_group(D.predictions(spark, sf)).select("condition", "reader_id")
    bucket = F.struct("condition", F.substring(F.coalesce("reader_id", F.lit("")), 1, 2))
    placed = position_in_group(a, [], bucket, ["condition", F.col("reader_id").asc_nulls_first()], "position")
    return placed.select("condition", "reader_id", (F.col("position") + 1).alias("position"))
