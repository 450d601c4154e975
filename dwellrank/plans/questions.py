"""Registered queries over sources: questions, gaze records, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellrank.operators import align as A, choices as C, gaze_table as G
from dwellrank.operators.ordering import position_in_group
from dwellrank.plans import workload as D
from dwellrank.plans.corpora import WORDS, big, r6
from dwellrank.plans.registry import query
from dwellrank.session import shared_dir
from dwellrank.sources import gaze as GS, questions as Q, writers as OUT

AREAS = """
ia as (select event_id, user_id::varchar participant_id, (event_id % 3 + 1)::varchar article_batch,
         case when event_id % 11 <> 0 then (event_id % 10)::varchar end article_id, (event_id % 6)::varchar para,
         ['Adv','Int','Ele'][event_id % 3 + 1] as lvl, (event_id % 2)::varchar question, (event_id % 97)::int ia_id, event_type word,
         case when event_id % 13 = 0 then null else value end as dwell, case when event_id % 7 = 0 then null else event_id % 4 end as fix,
         (event_id % 2)::double as skip,
         case when event_id % 19 <> 0 then event_id % 5 = 0 end as practice, event_id % 4 = 0 as repeated from events),
"""


@query("S2_pruned_scan", """
select event_type as word, count(*)::bigint as n, round(sum(value), 4) as trt from events where value >= 5 and event_id % 13 <> 0 group by event_type""")
def pruned_scan(spark, sf):
    path = shared_dir(spark, "scan")
    OUT.write_table_csv(D.interest_areas(spark, sf).drop("event_id"), path)
    e = GS.read_interest_areas(spark, path, ["IA_LABEL", "IA_DWELL_TIME"]).withColumn("trt", F.col("IA_DWELL_TIME").try_cast("double")).where("trt >= 5")
    return e.groupBy(F.col("IA_LABEL").alias("word")).agg(F.count("*").alias("n"), F.round(F.sum("trt"), 4).alias("trt"))


@query("S3_schema_inspection", """
select count(*)::bigint as row_count, 14::bigint as column_count, 'participant_id' as first_column from events""")
def schema_inspection(spark, sf):
    report = GS.inspect_interest_areas(D.interest_areas(spark, sf))
    return report.select("row_count", big(F.col("column_count")).alias("column_count"), F.col("columns")[0].alias("first_column"))


@query("S4_question_inspection", """
with f as (select * from documents order by doc_id limit 1)
select (select count(*) from documents)::bigint as example_count, 'q' || doc_id as first_example_id,
       substring(text, 1, 240) as first_paragraph_text_prefix, 0::bigint as first_answer_index, 2::bigint as n_choices, 9::bigint as n_metadata_keys from f""")
def question_inspection(spark, sf):
    report = Q.inspect_questions(D.alignment_questions(spark, sf), "example_ordinal")
    return report.select(
        "example_count", "first_example_id", "first_paragraph_text_prefix", big(F.col("first_answer_index")).alias("first_answer_index"),
        big(F.size("first_choices")).alias("n_choices"), big(F.size("metadata_keys")).alias("n_metadata_keys"),
    )


@query("S5_nested_questions", """
with lv as (select 'Adv' as lvl union all select 'Ele'), qs as (select 0 as q union all select 1)
select 'local:' || (doc_id % 4) || '_' || doc_id || ':' || (doc_id % 5 + 1) || ':' || lvl || ':' || q as example_id,
       'batch=' || (doc_id % 4) || '|article=' || doc_id || '|paragraph=' || (doc_id % 5 + 1) || '|level=' || lvl || '|question=' || q as paragraph_id,
       md5(d.text) as text_md5, 'Q' || q || ': ' || b.text as question, lang || '|' || source || '|neither|both' as choices,
       0::bigint as answer_index, source as article_title
from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark), lv, qs where not (lvl = 'Ele' and doc_id % 7 = 0) and length(d.text) > 0""")
def nested_questions(spark, sf):
    qa = Q.qa_from_articles(D.articles(spark, sf))
    return qa.select("example_id", "paragraph_id", F.md5("paragraph_text").alias("text_md5"), "question",
                     F.array_join("choices", "|").alias("choices"), big(F.col("answer_index")).alias("answer_index"),
                     F.col("metadata.article_title").alias("article_title"))


@query("S5_source_order", """
with lv as (select 0 as l, 'Adv' as lvl union all select 1, 'Ele'), qs as (select 0 as q union all select 1)
select 'local:' || (doc_id % 4) || '_' || doc_id || ':' || (doc_id % 5 + 1) || ':' || lvl || ':' || q as example_id,
       (row_number() over (order by doc_id, l, q) - 1)::bigint as example_ordinal
from documents, lv, qs where not (lvl = 'Ele' and doc_id % 7 = 0) and length(text) > 0""")
def source_order(spark, sf):
    return Q.with_ordinals(Q.qa_from_articles(D.articles(spark, sf))).select("example_id", big(F.col("example_ordinal")).alias("example_ordinal"))


@query("S6_flat_questions", """
select 'ex' || doc_id as example_id, doc_id::varchar as paragraph_id, md5(text) as text_md5,
       case doc_id % 3 when 0 then lang || '~' || source when 1 then lang || '~' || source || '~x' else '[' || lang || '~y' end as choices,
       (case doc_id % 6 when 0 then 1 when 1 then 1 when 4 then 7 when 5 then 25 end)::bigint as answer_index from documents""")
def flat_questions(spark, sf):
    qa = C.qa_from_table(D.flat_questions(spark, sf), "table")
    return qa.select("example_id", "paragraph_id", F.md5("paragraph_text").alias("text_md5"),
                     F.array_join("choices", "~").alias("choices"), big(F.col("answer_index")).alias("answer_index"))


@query("P11_choice_lists", """
select case doc_id % 3 when 0 then 2 when 1 then 3 else 2 end::bigint as n_choices, count(*)::bigint as n from documents group by 1""")
def choice_lists(spark, sf):
    d = D.flat_questions(spark, sf)
    choices = C.coerce_choices(F.col("choices"), d.schema["choices"].dataType)
    return d.groupBy(big(F.size(choices)).alias("n_choices")).agg(F.count("*").alias("n"))


@query("P12_answer_index", """
select doc_id, (case doc_id % 6 when 0 then 1 when 1 then 1 when 4 then 7 when 5 then 25 end)::bigint as answer_index,
       coalesce((case doc_id % 6 when 0 then 1 when 1 then 1 when 4 then 7 when 5 then 25 end), 0)::bigint as gold_first from documents""")
def answer_index(spark, sf):
    d = D.flat_questions(spark, sf)
    answer = C.coerce_answer(F.col("label"), d.schema["label"].dataType)
    named = C.qa_from_table(d, C.GOLD_FIRST_DATASET).select(F.substr("example_id", F.lit(3)).cast("bigint").alias("doc_id"), big(F.col("answer_index")).alias("gold_first"))
    return d.select(F.col("example_ordinal").alias("doc_id"), big(answer).alias("answer_index")).join(named, "doc_id")


@query("P1_canonical_gaze", "with" + AREAS + """z as (select 1)
select participant_id as reader_id, 'batch=' || article_batch || '|article=' || coalesce(article_id, 'nan') || '|paragraph=' || para || '|level=' || lvl || '|question=' || question as paragraph_id,
       ia_id::bigint as word_index, word, coalesce(dwell, 0.0)::double as trt, fix::double as fixation_count, skip, event_id as src_ordinal from ia""")
def canonical_gaze(spark, sf):
    g = G.normalize_gaze(D.interest_areas(spark, sf), "event_id")
    return g.select("reader_id", "paragraph_id", big(F.col("word_index")).alias("word_index"), "word", "trt", "fixation_count", "skip", "src_ordinal")


@query("P3_paragraph_keys", "with" + AREAS + """z as (select 1)
select 'batch=' || article_batch || '|article=' || coalesce(article_id, 'nan') || '|paragraph=' || para || '|level=' || lvl || '|question=' || question as paragraph_id,
       count(*)::bigint as n from ia group by 1""")
def paragraph_keys(spark, sf):
    g = G.normalize_gaze(D.interest_areas(spark, sf), "event_id")
    return g.groupBy("paragraph_id").agg(F.count("*").alias("n"))


@query("P4_practice_filter", "with" + AREAS + """z as (select 1)
select participant_id as reader_id, count(*)::bigint as n from ia where practice = false group by 1""")
def practice_filter(spark, sf):
    return G.drop_practice(D.interest_areas(spark, sf)).groupBy(F.col("participant_id").alias("reader_id")).agg(F.count("*").alias("n"))


@query("P5_repeated_filter", "with" + AREAS + """z as (select 1)
select participant_id as reader_id, count(*)::bigint as n from ia where practice = false and repeated = false group by 1""")
def repeated_filter(spark, sf):
    kept = G.drop_repeated(G.drop_practice(D.interest_areas(spark, sf)), True)
    return kept.groupBy(F.col("participant_id").alias("reader_id")).agg(F.count("*").alias("n"))


ALIGN = r"""
qa as (select 'q' || doc_id as example_id, 'p' || doc_id as pid, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as t,
              lower('What does ' || lang || ' text ' || (doc_id % 50) || ' say?') as q, lower(source) as title, ['adv','int','ele'][doc_id % 3 + 1] as lvl, doc_id from documents),
ev as (select *, (props::json->>'k')::bigint as k from events),
gaze as (select 'u' || user_id as reader_id, case when k % 5 = 0 then 'p' || k else 'g' || k end as pid, event_id, event_type as word, value as trt,
                case when k % 5 in (1, 3) then d.t else 'other ' || k end as t, case when k % 5 in (1, 2) then d.q else 'none' end as q,
                case when k % 5 = 2 then d.title end as title, case when k % 5 = 2 then d.lvl else 'x' end as lvl
         from ev join qa d on d.doc_id = ev.k),
hits as (select example_id, 1 as tier, g.event_id from qa join gaze g on g.pid = qa.pid
   union all select example_id, 2, g.event_id from qa join gaze g on g.t = qa.t and g.q = qa.q
   union all select example_id, 3, g.event_id from qa join gaze g on g.title = qa.title and g.lvl = qa.lvl and g.q = qa.q
   union all select example_id, 4, g.event_id from qa join gaze g on g.t = qa.t),
best as (select example_id, min(tier) as tier from hits group by example_id),
aligned as (select h.example_id, h.tier, g.* from hits h join best b on b.example_id = h.example_id and b.tier = h.tier join gaze g using (event_id)),
"""


@query("J1_semi_filter", "with" + ALIGN + """z as (select 1)
select reader_id, count(*)::bigint as n, round(sum(trt), 4) as trt from gaze g
where g.pid in (select pid from qa) or g.t in (select t from qa) or (g.title, g.lvl, g.q) in (select (title, lvl, q) from qa) group by reader_id""")
def semi_filter(spark, sf):
    qa, gaze, texts = D.alignment(spark, sf)
    kept = A.filter_matching(gaze, qa, texts)
    return kept.groupBy("reader_id").agg(F.count("*").alias("n"), F.round(F.sum("trt"), 4).alias("trt"))


@query("J2_tier_join", "with" + ALIGN + """z as (select 1)
select example_id, tier::bigint as match_tier, reader_id, event_id::bigint as word_index, word, trt from aligned""")
def tier_join(spark, sf):
    a = A.align(*D.alignment(spark, sf))
    return a.select("example_id", big(F.col("match_tier")).alias("match_tier"), "reader_id", big(F.col("word_index")).alias("word_index"), "word", "trt")


@query("J4_match_keys", "with" + ALIGN + """z as (select 1)
select tier::bigint as match_tier, count(distinct example_id)::bigint as examples from aligned group by tier""")
def match_keys(spark, sf):
    qa, _, texts = D.alignment(spark, sf)
    m = A.match_groups(qa, texts)
    return m.select("match_tier", "example_id").distinct().groupBy(big(F.col("match_tier")).alias("match_tier")).agg(F.count("*").alias("examples"))


@query("W7_first_readers", "with" + ALIGN + """r as (select distinct example_id, reader_id from aligned),
k as (select *, row_number() over (partition by example_id order by reader_id) n from r)
select a.example_id, a.reader_id, count(*)::bigint as records from aligned a join k on k.example_id = a.example_id and k.reader_id = a.reader_id
where n <= 3 group by all""")
def first_readers(spark, sf):
    a = A.align(*D.alignment(spark, sf), max_readers=3)
    return a.groupBy("example_id", "reader_id").agg(F.count("*").alias("records"))


@query("A9_alignment_report", "with" + ALIGN + """
per as (select example_id, count(distinct reader_id) readers, count(*) records from aligned group by 1),
fr as (select example_id, reader_id, arg_min(pid, event_id) fp from aligned group by 1, 2),
ex as (select f.example_id, bool_or(f.fp = q.pid) e from fr f join qa q using (example_id) group by 1)
select (select count(*) from qa)::bigint as qa_examples, (select count(*) from gaze)::bigint as gaze_records,
  (select count(*) from per)::bigint as aligned_examples, (select count(*) from qa)::bigint - (select count(*) from per)::bigint as unmatched_qa_examples,
  (select count(distinct pid) from gaze)::bigint as gaze_paragraphs, (select count(distinct pid) from aligned)::bigint as matched_gaze_paragraphs,
  (select count(distinct reader_id) from gaze)::bigint as total_readers, (select count(distinct reader_id) from aligned)::bigint as matched_readers,
  round((select count(*) from per) / (select count(*) from qa), 6) as qa_matched_fraction,
  min(readers)::bigint as readers_min, max(readers)::bigint as readers_max, round(avg(readers), 6) as readers_mean,
  max(records)::bigint as records_max, round(avg(records), 6) as records_mean,
  (select count(*) from ex where e)::bigint as method_exact_id, (select count(*) from ex where not e)::bigint as method_text_or_metadata from per""")
def alignment_report(spark, sf):
    qa, gaze, texts = D.alignment(spark, sf)
    report = A.alignment_report(qa, gaze, texts=texts)
    counts = ["qa_examples", "gaze_records", "aligned_examples", "unmatched_qa_examples", "gaze_paragraphs", "matched_gaze_paragraphs",
              "total_readers", "matched_readers", "readers_min", "readers_max", "records_max", "method_exact_id", "method_text_or_metadata"]
    return report.select(*[big(F.col(c)).alias(c) for c in counts], *[r6(F.col(c)).alias(c) for c in ("qa_matched_fraction", "readers_mean", "records_mean")])


@query("O3_unmatched", "with" + ALIGN + """z as (select 1)
select 'question' as kind, example_id as id from qa where example_id not in (select example_id from aligned)
union all select 'paragraph', pid from gaze where pid not in (select pid from aligned) group by pid""")
def unmatched(spark, sf):
    qa, _, texts = D.alignment(spark, sf)
    # which combinations are matched tells it all: no word row is repeated for each question
    matches = A.match_groups(qa, texts)
    a = texts.join(matches, "gaze_group")
    left = A.unmatched_questions(qa, matches).select(F.lit("question").alias("kind"), F.col("example_id").alias("id"))
    return left.unionByName(A.unmatched_paragraphs(texts, a).select(F.lit("paragraph").alias("kind"), F.col("paragraph_id").alias("id")))


@query("K9_nested_export", "with" + ALIGN + """per as (select example_id, reader_id, count(*) n, string_agg(event_id::varchar, ',' order by event_id) ids from aligned group by 1, 2)
select example_id, count(*)::bigint as readers, sum(n)::bigint as records, md5(string_agg(reader_id || ':' || ids, ';' order by reader_id)) as order_md5 from per group by 1""")
def nested_export(spark, sf):
    qa, gaze, texts = D.alignment(spark, sf)
    n = A.nest_aligned(qa, A.align(qa, gaze, texts))
    entries = F.map_entries("reader_gaze")
    line = lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda r: r["word_index"].cast("string")), ","))
    size = F.aggregate(F.transform(entries, lambda e: big(F.size(e["value"]))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return n.select(F.col("qa.example_id").alias("example_id"), big(F.size(entries)).alias("readers"), size.alias("records"),
                    F.md5(F.array_join(F.transform(entries, line), ";")).alias("order_md5"))


@query("L9_first_examples", "select 'q' || doc_id as example_id from documents order by doc_id limit 100")
def first_examples(spark, sf):
    return A.limit_examples(D.alignment_questions(spark, sf), 100).select("example_id")


@query("K3_json_values", """
select vec_id, d::bigint as d, case when (vec_id + d) % 3 <> 0 then round(x, 6) end as x, case when vec_id % 5 = 0 then 'Infinity' else 'none' end as far
from (select vec_id, unnest(range(len(embedding))) as d, unnest(embedding::double[]) as x from embeddings)""")
def json_values(spark, sf):
    """Every entry of every vector with NaN in a third of the places, within nested values; infinities stay."""
    e = D.table(spark, sf, "embeddings")
    marked = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((F.col("vec_id") + i) % 3 == 0, F.lit(float("nan"))).otherwise(x))
    far = F.when(F.col("vec_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    rows = OUT.jsonable(e.select("vec_id", F.struct(F.struct(marked.alias("entries")).alias("inner"), far.alias("far")).alias("item")))
    back = F.from_json(F.to_json("item"), "inner struct<entries:array<double>>, far double")
    entries = rows.select("vec_id", back.alias("b")).select("vec_id", "b.far", F.posexplode("b.inner.entries").alias("d", "x"))
    return entries.select("vec_id", big(F.col("d")).alias("d"), F.round("x", 6).alias("x"), F.coalesce(F.col("far").cast("string"), F.lit("none")).alias("far"))


@query("S13_gold_spans", "with" + WORDS + r"""
sized as (select doc_id, count(*) n, list("end" - length(word) order by word_pos) s, list("end" order by word_pos) e from words group by doc_id),
lv as (select 'Adv' as lvl union all select 'Ele'),
pos as (select doc_id, s, e, unnest([[0, 0, least(n - 1, 4)], [1, n - 1, n - 1], [1, 0, 0]]) p, 'a' as side from sized
        union all select doc_id, s, e, [1, (n - 1) // 2, n - 1], 'd' from sized)
select 'local:' || (x.doc_id % 4) || '_' || x.doc_id || ':' || (x.doc_id % 5 + 1) || ':' || lvl || ':' || x.p[1] as example_id, side,
       sum(s[p[2] + 1])::bigint as start_sum, sum(e[p[3] + 1])::bigint as end_sum, count(*)::bigint as spans
from pos x, lv where not (lvl = 'Ele' and x.doc_id % 7 = 0) group by all""")
def gold_spans(spark, sf):
    from dwellrank.operators import coverage

    # a level without text has no words to point at
    rows = Q.gold_span_rows(D.articles(spark, sf)).where(F.length("paragraph_text") > 0)
    g = coverage.gold_spans(rows)
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_spans").alias("s")), F.struct(F.lit("d").alias("side"), F.col("d_spans").alias("s"))))
    out = g.select("example_id", sides.alias("x")).select("example_id", F.col("x.side").alias("side"), F.explode("x.s").alias("s"))
    return out.groupBy("example_id", "side").agg(
        big(F.sum("s.start")).alias("start_sum"), big(F.sum("s.end")).alias("end_sum"), F.count("*").alias("spans"))


@query("V16_choice_shuffle")
def choice_shuffle(spark, sf):
    qa = Q.qa_from_articles(D.articles(spark, sf), seed=13, shuffle=True)
    return qa.select("example_id", F.array_join("choices", "|").alias("choices"), "answer_index",
                     F.array_join(F.col("metadata.choice_shuffle.order"), ",").alias("order"))


@query("V16_shuffled_choices", """
with d as (select doc_id, lang, list_sort([lang, source, 'neither', 'both']) as choices from documents),
q as (select (doc_id % 4) || '_' || doc_id as article, (doc_id % 5 + 1) as para, lang, choices, level, i from d, (values ('Adv'), ('Ele')) l(level), (values (0), (1)) n(i) where not (level = 'Ele' and doc_id % 7 = 0))
select 'local:' || article || ':' || para || ':' || level || ':' || i as example_id, array_to_string(choices, '|') as choices, lang as gold, '0,1,2,3' as places, true as kept from q""")
def shuffled_choices(spark, sf):
    """What holds of the seeded order, whatever it is: a permutation, all choices there, the gold index on the first answer, the original kept."""
    qa = Q.qa_from_articles(D.articles(spark, sf), seed=13, shuffle=True)
    note = F.col("metadata.choice_shuffle")
    return qa.select(
        "example_id", F.array_join(F.array_sort("choices"), "|").alias("choices"), F.get("choices", F.col("answer_index")).alias("gold"),
        F.array_join(F.array_sort(note["order"]), ",").alias("places"),
        ((note["original_answer_index"] == 0) & (F.transform(note["order"], lambda i: F.get(note["original_choices"], i)) == F.col("choices"))).alias("kept"))


@query("V16_gold_remap", """
select doc_id, case doc_id % 3 when 0 then 'c|a|b' when 1 then 'b|c|a' else 'a|b|c' end as choices,
       (case doc_id % 3 when 0 then (doc_id % 2 + 1) when 1 then case doc_id % 2 when 0 then 2 else 0 end else doc_id % 2 end)::bigint as answer_index
from documents""")
def gold_remap(spark, sf):
    # a given order instead of the seeded one, so that SQL can state the result
    k = F.col("doc_id")
    order = F.when(k % 3 == 0, F.array(F.lit(2), F.lit(0), F.lit(1))).when(k % 3 == 1, F.array(F.lit(1), F.lit(2), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    d = D.table(spark, sf, "documents").select(
        "doc_id", k.cast("string").alias("example_id"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("choices"), (k % 2).cast("int").alias("answer_index"), order.alias("_order"))
    out = C.apply_order(d, "_order", 13)
    return out.select("doc_id", F.array_join("choices", "|").alias("choices"), big(F.col("answer_index")).alias("answer_index"))


@query("W6_positions", """
with z as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events)
select user_id, count(*)::bigint as n, max(pos)::bigint as last_pos, sum(pos * (event_id % 7))::bigint as weighted from z group by user_id""")
def positions(spark, sf):
    e = D.table(spark, sf, "events").select("user_id", "event_id", "ts")
    e = position_in_group(e, ["user_id"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "pos")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), big(F.max("pos")).alias("last_pos"), big(F.sum(F.col("pos") * (F.col("event_id") % 7))).alias("weighted"))
