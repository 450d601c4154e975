"""Registered queries over prompts, answers and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellrank.functions import models as M, prompts as P, scores as S
from dwellrank.operators import answer as N
from dwellrank.plans import workload as D
from dwellrank.plans.corpora import big, r6
from dwellrank.plans.registry import query
from dwellrank.session import shared_dir
from dwellrank.sources import artifacts as IN, writers as OUT

CHOICES = "lang || ' text', source, 'neither', 'both'"


def _choices():
    return F.array(F.concat("lang", F.lit(" text")), F.col("source"), F.lit("neither"), F.lit("both"))


def _asked(spark, sf):
    """Every document with a question and four choices."""
    return D.with_questions(D.table(spark, sf, "documents"), spark, sf).withColumn("choices", _choices())


ASKED = """
a as (select d.*, trim(b.text) as question, 'A. ' || lang || ' text' || chr(10) || 'B. ' || source || chr(10) || 'C. neither' || chr(10) || 'D. both' as block,
      regexp_replace(regexp_replace(d.text, '\\s+$', ''), '^\\s+', '') as body from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark)),
pm as (select *, 'Answer the multiple-choice question using only the retrieved evidence.' || chr(10) || 'Return exactly one choice label.' || chr(10) || chr(10) || 'Question:' || chr(10) || question
  || chr(10) || chr(10) || 'Choices:' || chr(10) || block || chr(10) || chr(10) || 'Retrieved evidence:' || chr(10)
  || case when doc_id % 4 = 0 then 'No retrieved evidence.' else '[Evidence 1]' || chr(10) || body || chr(10) || chr(10) || '[Evidence 2]' || chr(10) || source end
  || chr(10) || chr(10) || 'Answer:' as prompt from a),
"""


def _evidence():
    none = F.array().cast("array<string>")
    return F.when(F.col("doc_id") % 4 == 0, none).otherwise(F.array("text", "source"))


def _prompted(spark, sf):
    return _asked(spark, sf).withColumn("prompt", P.mcqa_prompt(F.col("question"), F.col("choices"), _evidence()))


@query("T11_choice_blocks", f"select doc_id, 'A. ' || lang || ' text' || chr(10) || 'B. ' || source || chr(10) || 'C. neither' || chr(10) || 'D. both' as block from documents")
def choice_blocks(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", P.choice_block(_choices()).alias("block"))


@query("T12_evidence_prompts", "with" + ASKED + "z as (select 1) select doc_id, md5(prompt) as prompt_md5, length(prompt)::bigint as n_chars from pm")
def evidence_prompts(spark, sf):
    return _prompted(spark, sf).select("doc_id", F.md5("prompt").alias("prompt_md5"), big(F.length("prompt")).alias("n_chars"))


@query("T13_bare_prompts", "with" + ASKED + """z as (select 1)
select doc_id, md5('Answer the multiple-choice question.' || chr(10) || 'Return exactly one choice label.' || chr(10) || chr(10) || 'Question:' || chr(10) || question
  || chr(10) || chr(10) || 'Choices:' || chr(10) || block || chr(10) || chr(10) || 'Answer:') as prompt_md5 from a""")
def bare_prompts(spark, sf):
    return _asked(spark, sf).select("doc_id", F.md5(P.bare_prompt(F.col("question"), F.col("choices"))).alias("prompt_md5"))


@query("T15_parsed_answers", r"""
with raw as (select conv_id, turn, case (conv_id + turn) % 7 when 0 then text when 1 then '(' || chr((65 + conv_id % 6)::int) || ') because ' || text
    when 2 then 'the ANSWER is ' || chr((97 + conv_id % 5)::int) || '. ' || text when 3 then '1: option [' || chr((65 + turn % 4)::int) || '] ' || text
    when 4 then chr((65 + conv_id % 4)::int) || ' or ' || chr((65 + turn % 4)::int) when 5 then '  ' else '42 Choice ' || chr((65 + conv_id % 5)::int) end as raw from conversations),
w as (select *, list_filter(list_transform(regexp_extract_all(regexp_replace(' ' || raw || ' ', '([^\p{L}\p{N}_])', '\1\1', 'g'), '[^\p{L}\p{N}_]([A-Za-z])[^\p{L}\p{N}_]', 1), lambda x: ascii(upper(x)) - 65), lambda x: x < 4) as st,
   regexp_extract(raw, '^\s*[(\[]?([A-Za-z])', 1) as l1,
   regexp_extract(' ' || raw, '(?i)[^\p{L}\p{N}_]answer\s*(?:is|:)?\s*[(\[]?([A-Za-z])', 1) as l2, regexp_extract(' ' || raw, '(?i)[^\p{L}\p{N}_]choice\s*[(\[]?([A-Za-z])', 1) as l3,
   regexp_extract(' ' || raw, '(?i)[^\p{L}\p{N}_]option\s*[(\[]?([A-Za-z])', 1) as l4 from raw),
ix as (select *, case when l1 <> '' and ascii(upper(l1)) - 65 < 4 then ascii(upper(l1)) - 65 end i1, case when l2 <> '' and ascii(upper(l2)) - 65 < 4 then ascii(upper(l2)) - 65 end i2,
   case when l3 <> '' and ascii(upper(l3)) - 65 < 4 then ascii(upper(l3)) - 65 end i3, case when l4 <> '' and ascii(upper(l4)) - 65 < 4 then ascii(upper(l4)) - 65 end i4 from w)
select conv_id, turn, (case when len(list_distinct(st)) > 1 then null else coalesce(i1, i2, i3, i4, case when len(st) = 1 then st[1] end) end)::bigint as choice from ix""")
def parsed_answers(spark, sf):
    c = D.table(spark, sf, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    letter = lambda base, n: F.char((base + n).cast("int"))
    slot = (k + t) % 7
    raw = (
        F.when(slot == 0, F.col("text"))
        .when(slot == 1, F.concat(F.lit("("), letter(F.lit(65), k % 6), F.lit(") because "), "text"))
        .when(slot == 2, F.concat(F.lit("the ANSWER is "), letter(F.lit(97), k % 5), F.lit(". "), "text"))
        .when(slot == 3, F.concat(F.lit("1: option ["), letter(F.lit(65), t % 4), F.lit("] "), "text"))
        .when(slot == 4, F.concat(letter(F.lit(65), k % 4), F.lit(" or "), letter(F.lit(65), t % 4)))
        .when(slot == 5, F.lit("  ")).otherwise(F.concat(F.lit("42 Choice "), letter(F.lit(65), k % 5)))
    )
    return c.select("conv_id", "turn", big(P.parse_choice(raw, F.lit(4))).alias("choice"))


@query("A19_argmax_choice", """
with d as (select vec_id, unnest(embedding) x, generate_subscripts(embedding, 1) - 1 as i from embeddings)
select vec_id, arg_max(i, (x, -i))::bigint as best from d group by 1""")
def argmax_choice(spark, sf):
    e = D.table(spark, sf, "embeddings")
    return e.select("vec_id", big(S.first_argmax(F.col("embedding"))).alias("best"))


LOGLIK = ASKED + """
k as (select doc_id, sha256(prompt || ' ') as pkey, [""" + CHOICES + """] as cs from pm),
o as (select doc_id, pkey, unnest(cs) c, generate_subscripts(cs, 1) - 1 as ci from k),
t as (select doc_id, ci, pkey, unnest(regexp_extract_all(c, '\\S+')) w, generate_subscripts(regexp_extract_all(c, '\\S+'), 1) - 1 as i from o),
sc as (select doc_id, ci, sum(('0x' || substring(sha256(pkey || ':' || i || ':' || w), 1, 8))::bigint / 4294967296.0::double * -8) as s from t group by 1, 2),
"""


@query("M3_option_likelihoods", "with" + LOGLIK + "z as (select 1) select doc_id, ci::bigint as choice, round(s, 6) as score from sc")
def option_likelihoods(spark, sf):
    scored = _prompted(spark, sf).select("doc_id", M.option_scores(F.col("prompt"), F.col("choices")).alias("s"))
    return scored.select("doc_id", F.posexplode("s").alias("choice", "score")).select("doc_id", big(F.col("choice")).alias("choice"), r6(F.col("score")).alias("score"))


@query("M6_likelihood_answers", "with" + LOGLIK + "z as (select 1) select doc_id, arg_max(ci, (s, -ci))::bigint as predicted_index from sc group by 1")
def likelihood_answers(spark, sf):
    p = _prompted(spark, sf)
    return p.select("doc_id", big(M.predict_answer(F.col("prompt"), F.col("choices"), "loglik")["predicted_index"]).alias("predicted_index"))


@query("M5_generated_answers", "with" + ASKED + """
g as (select doc_id, (('0x' || substring(sha256(prompt), 1, 8))::bigint % 4)::int as i from pm)
select doc_id, '(' || chr(65 + i) || ')' as raw_output, i::bigint as predicted_index from g""")
def generated_answers(spark, sf):
    p = _prompted(spark, sf).withColumn("a", M.predict_answer(F.col("prompt"), F.col("choices"), "generate"))
    return p.select("doc_id", F.col("a.raw_output").alias("raw_output"), big(F.col("a.predicted_index")).alias("predicted_index"))


@query("J9_question_join", "with" + ASKED + "z as (select 1) select doc_id::varchar as example_id, md5(question) as question_md5, 4::bigint as n_choices from a")
def question_join(spark, sf):
    q = _asked(spark, sf).select(D.text(F.col("doc_id")).alias("example_id"), "question", "choices")
    results = D.table(spark, sf, "documents").select(D.text(F.col("doc_id")).alias("example_id"))
    j = N.join_questions(results, q)
    from dwellrank.functions.text import strip

    return j.select("example_id", F.md5(strip(F.col("question"))).alias("question_md5"), big(F.size("choices")).alias("n_choices"))


@query("P18_evidence_texts", """
select doc_id, case when doc_id % 4 = 0 then 'c' || doc_id else lang || '|' || source end as texts from documents""")
def evidence_texts(spark, sf):
    d = D.table(spark, sf, "documents")
    item = lambda c: F.struct(c.alias("text"))
    evidence = F.when(F.col("doc_id") % 4 != 0, F.array(item(F.col("lang")), item(F.col("source"))))
    ranked = F.array(F.struct(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.lit(1.0).alias("score")))
    return d.select("doc_id", F.array_join(N.evidence_texts(ranked, evidence), "|").alias("texts"))


@query("S16_prediction_defaults", """
select conv_id, turn, case when turn % 2 = 0 then md5(text) else md5('') end as prompt_md5 from conversations""")
def prediction_defaults(spark, sf):
    c = D.table(spark, sf, "conversations")
    path = shared_dir(spark, "predictions")
    OUT.write_jsonl(c.select(
        D.text(F.col("conv_id")).alias("example_id"), D.text(F.col("turn")).alias("reader_id"), F.lit("text").alias("condition"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).alias("prompt")), path)
    back = IN.read_predictions(spark, path)
    return back.select(F.col("example_id").cast("bigint").alias("conv_id"), F.col("reader_id").cast("bigint").alias("turn"), F.md5("prompt").alias("prompt_md5"))


@query("T16_json_round_trip", "select conv_id, turn, role, md5(text) as text_md5 from conversations")
def json_round_trip(spark, sf):
    c = D.table(spark, sf, "conversations")
    back = F.from_json(F.to_json(F.struct(*c.columns)), "conv_id bigint, turn bigint, role string, text string")
    return c.select(back.alias("r")).select("r.conv_id", "r.turn", "r.role", F.md5("r.text").alias("text_md5"))
