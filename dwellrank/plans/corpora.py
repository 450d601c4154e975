"""Registered queries over texts: spans, chunks, normalisation, hash vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellrank.functions import reading, text as T, vectors as V
from dwellrank.functions.arrays import explode_rows, total
from dwellrank.operators import chunking as K
from dwellrank.plans import workload as D
from dwellrank.plans.registry import query

HAS_WORDS = r"text rlike r'\S'"  # tested on the text: a test on the parsed words would parse them twice
big = lambda c: c.cast("bigint")
r6 = lambda c: F.round(c, 6)

WORDS = r"""
tiles as (select doc_id, unnest(t) tile, generate_subscripts(t, 1) i
          from (select doc_id, regexp_extract_all(text, '\s*\S+') t from documents)),
words as (select doc_id, i - 1 as word_pos, regexp_replace(tile, '^\s+', '') word,
                 sum(length(tile)) over (partition by doc_id order by i)::bigint as "end"
          from tiles),
"""
CANONICAL = r"""lower(regexp_replace(regexp_replace(translate(word, '“”‘’–—', '""''''--'), '^[!-/:-@\[-`{-~]+', ''), '[!-/:-@\[-`{-~]+$', ''))"""
SENTENCES = r"""
st as (select doc_id, unnest(t) tile, generate_subscripts(t, 1) i
       from (select doc_id, regexp_extract_all(text, '(?s).*?[.!?]+["'')\]]*(?:\s+|$)|(?s).+$') t from documents)),
sp as (select doc_id, i, tile, coalesce(sum(length(tile)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s0
       from st),
sents as (select doc_id, s0 + case when i = 1 then 0 else length(tile) - length(regexp_replace(tile, '^\s+', '')) end as "start",
                 s0 + case when regexp_matches(regexp_replace(tile, '\s+$', ''), '[.!?]["'')\]]*$') then length(regexp_replace(tile, '\s+$', '')) else length(tile) end as "end",
                 regexp_replace(regexp_replace(tile, '\s+$', ''), '^\s+', '') body
          from sp where regexp_matches(tile, '\S')),
"""


@query("T1_normalize_text", r"""
select doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as norm_md5,
       length(trim(regexp_replace(text, '\s+', ' ', 'g')))::bigint as norm_length from documents""")
def normalize_text(spark, sf):
    d = D.documents(spark, sf)
    norm = T.normalize_text(F.col("text"))
    return d.select("doc_id", F.md5(norm).alias("norm_md5"), big(F.length(norm)).alias("norm_length"))


@query("T2_normalize_level", r"""
with v as (select doc_id, case doc_id % 8 when 0 then '0' when 1 then ' 1' when 2 then '2 ' when 3 then 'Advanced' when 4 then 'INTERMEDIATE'
                  when 5 then 'ele-' || lang when 6 then source else null end as level from documents)
select doc_id, case when level is null then '' when trim(level) = '0' or lower(trim(level)) like 'adv%' then 'adv'
  when trim(level) = '1' or lower(trim(level)) like 'int%' then 'int' when trim(level) = '2' or lower(trim(level)) like 'ele%' then 'ele'
  else lower(trim(level)) end as level from v""")
def normalize_level(spark, sf):
    d = D.documents(spark, sf)
    k = F.col("doc_id") % 8
    raw = (
        F.when(k == 0, F.lit("0")).when(k == 1, F.lit(" 1")).when(k == 2, F.lit("2 ")).when(k == 3, F.lit("Advanced"))
        .when(k == 4, F.lit("INTERMEDIATE")).when(k == 5, F.concat(F.lit("ele-"), "lang")).when(k == 6, F.col("source"))
    )
    return d.select("doc_id", T.normalize_level(raw).alias("level"))


@query("T3_word_spans", "with" + WORDS + r"""
z as (select doc_id, word_pos, "end", "end" - length(word) as "start", word from words)
select doc_id, count(*)::bigint n, sum("start")::bigint start_sum, sum("end")::bigint end_sum,
       sum((word_pos + 1) * "start")::bigint weighted, md5(string_agg(word, '|' order by word_pos)) words_md5
from z group by doc_id""")
def word_spans(spark, sf):
    d = D.documents(spark, sf).where(HAS_WORDS).select("doc_id", T.word_spans(F.col("text")).alias("s"))
    add = lambda f: F.aggregate(F.transform("s", f), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select(
        "doc_id", big(F.size("s")).alias("n"),
        add(lambda s: big(s["start"])).alias("start_sum"), add(lambda s: big(s["end"])).alias("end_sum"),
        add(lambda s, i: big(s["start"]) * (i + 1)).alias("weighted"),
        F.md5(F.array_join(F.transform("s", lambda s: s["text"]), "|")).alias("words_md5"),
    )


@query("T4_sentence_spans", "with" + SENTENCES + """z as (select 1)
select doc_id, "start"::bigint as char_start, "end"::bigint as char_end, md5(body) as body_md5 from sents""")
def sentence_spans(spark, sf):
    d = explode_rows(D.documents(spark, sf), ["doc_id"], T.sentence_spans(F.col("text")), "i", "s")
    return d.select(
        "doc_id", big(F.col("s.start")).alias("char_start"), big(F.col("s.end")).alias("char_end"),
        F.md5(T.strip(F.col("s.text"))).alias("body_md5"),
    )


@query("T5_word_windows", "with" + WORDS + r"""
sized as (select doc_id, count(*) n from words group by doc_id),
firsts as (select doc_id, n, unnest(range(0, n, 17)) f from sized),
kept as (select doc_id, f, least(f + 20, n) - 1 as l from firsts where f = 0 or f - 17 + 20 < n)
select k.doc_id, (k.f // 17)::bigint as chunk_index, (a."end" - length(a.word))::bigint as char_start, b."end"::bigint as char_end,
       md5(substring(d.text, (a."end" - length(a.word) + 1)::bigint, (b."end" - a."end" + length(a.word))::bigint)) as body_md5
from kept k join words a on a.doc_id = k.doc_id and a.word_pos = k.f join words b on b.doc_id = k.doc_id and b.word_pos = k.l
join documents d on d.doc_id = k.doc_id""")
def word_windows(spark, sf):
    d = explode_rows(D.documents(spark, sf), ["doc_id"], T.word_windows(F.col("text"), 20, 3), "i", "s")
    return d.select(
        "doc_id", big(F.col("i")).alias("chunk_index"), big(F.col("s.start")).alias("char_start"),
        big(F.col("s.end")).alias("char_end"), F.md5(F.col("s.text")).alias("body_md5"),
    )


@query("T6_sentence_chunks", "with" + SENTENCES + r"""
sw as (select doc_id, "start", "end", body, unnest(regexp_extract_all(body, '\s*\S+')) tile,
              generate_subscripts(regexp_extract_all(body, '\s*\S+'), 1) i, len(regexp_extract_all(body, '\S+')) n from sents),
off as (select *, sum(length(tile)) over (partition by doc_id, "start" order by i) as upto from sw),
cut as (select doc_id, "start", n, (i - 1) // 12 as g, min(upto - length(regexp_replace(tile, '^\s+', ''))) a, max(upto) b, body
        from off where n > 12 group by all),
lead0 as (select s.*, length(d.text[s."start" + 1 : s."end"]) - length(regexp_replace(d.text[s."start" + 1 : s."end"], '^\s+', '')) as pad
          from sents s join documents d using (doc_id)),
allc as (select doc_id, "start" as cs, "end" as ce, body from sents where len(regexp_extract_all(body, '\S+')) <= 12
         union all
         select c.doc_id, c."start" + l.pad + c.a, c."start" + l.pad + c.b, substring(c.body, (c.a + 1)::bigint, (c.b - c.a)::bigint)
         from cut c join lead0 l on l.doc_id = c.doc_id and l."start" = c."start")
select 'p' || doc_id || ':chunk=' || (row_number() over (partition by doc_id order by cs) - 1) as chunk_id,
       cs::bigint as char_start, ce::bigint as char_end, md5(body) as body_md5 from allc""")
def sentence_chunks(spark, sf):
    chunks = K.chunk_paragraphs(D.paragraphs(spark, sf), "sentence", 12, 0)
    return chunks.select("chunk_id", big(F.col("char_start")).alias("char_start"), big(F.col("char_end")).alias("char_end"),
                         F.md5("text").alias("body_md5"))


@query("T6_whole_paragraph", r"""
select 'p' || doc_id || ':chunk=0' as chunk_id, (length(text) - length(regexp_replace(text, '^\s+', '')))::bigint as char_start,
       length(regexp_replace(text, '\s+$', ''))::bigint as char_end,
       md5(regexp_replace(regexp_replace(text, '\s+$', ''), '^\s+', '')) as body_md5
from documents where regexp_matches(text, '\S')""")
def whole_paragraph(spark, sf):
    chunks = K.chunk_paragraphs(D.paragraphs(spark, sf), "whole_paragraph", 1)
    return chunks.select("chunk_id", big(F.col("char_start")).alias("char_start"), big(F.col("char_end")).alias("char_end"),
                         F.md5("text").alias("body_md5"))


CONTEXT_PIECES = r"""
ctx as (select doc_id, regexp_replace(regexp_replace(text, '\s+$', ''), '^\s+', '') body from documents),
ct as (select doc_id, unnest(t) tile, generate_subscripts(t, 1) i
       from (select doc_id, regexp_extract_all(body, '[^\n.!?]+(?:[.!?]+|$)|[^\n.!?]+\n|(?s:.)') t from ctx)),
co as (select doc_id, tile, sum(length(tile)) over (partition by doc_id order by i) - length(tile) as s0 from ct),
pieces as (select doc_id, s0 + length(tile) - length(regexp_replace(tile, '^\s+', '')) as "start",
                  regexp_replace(regexp_replace(tile, '\s+$', ''), '^\s+', '') piece
           from co where regexp_matches(tile, '^[^\n.!?]') and tile not like '%' || chr(10) and regexp_matches(tile, '\S')),
"""


@query("T7_context_chunks", "with" + CONTEXT_PIECES + r"""
pw as (select doc_id, "start", piece, unnest(regexp_extract_all(piece, '\s*\S+')) tile, generate_subscripts(regexp_extract_all(piece, '\s*\S+'), 1) i from pieces),
off as (select *, sum(length(tile)) over (partition by doc_id, "start" order by i) as upto from pw),
cut as (select doc_id, "start", (i - 1) // 15 as g, min(upto - length(regexp_replace(tile, '^\s+', ''))) a, max(upto) b, piece from off group by all),
allc as (select doc_id, "start" + a as cs, "start" + b as ce, substring(piece, (a + 1)::bigint, (b - a)::bigint) body from cut
         union all
         select doc_id, 0, length(body), body from ctx where doc_id not in (select doc_id from pieces) and length(body) > 0)
select doc_id, 'context:chunk=' || (row_number() over (partition by doc_id order by cs) - 1) as chunk_id,
       cs::bigint as char_start, ce::bigint as char_end, md5(body) as body_md5 from allc""")
def context_chunks(spark, sf):
    d = D.documents(spark, sf).select("doc_id", T.strip(F.col("text")).alias("context"))
    chunks = K.split_contexts(d.where(F.length("context") > 0), 15, keep=["doc_id"])
    return chunks.select("doc_id", "chunk_id", big(F.col("char_start")).alias("char_start"),
                         big(F.col("char_end")).alias("char_end"), F.md5("text").alias("body_md5"))


@query("T9_canonical_words", "with" + WORDS + r"""
z as (select """ + CANONICAL + """ as canonical from words)
select canonical, count(*)::bigint as n from z group by canonical""")
def canonical_words(spark, sf):
    w = D.documents(spark, sf).select(F.explode(T.words(F.col("text"))).alias("word"))
    return w.groupBy(T.canonical_word(F.col("word")).alias("canonical")).agg(F.count("*").alias("n"))


@query("T10_adjust_offsets", "with" + WORDS + r"""
z as (select doc_id, word_pos, "end" - length(word) as s, "end" as e from words),
m as (select doc_id, word_pos, case when e <= 9 or greatest(0, s - 9) >= e - 9 then -1 else greatest(0, s - 9) end s2,
             case when e <= 9 or greatest(0, s - 9) >= e - 9 then -1 else e - 9 end e2 from z)
select doc_id, sum(s2)::bigint as start_sum, sum(e2)::bigint as end_sum, sum((word_pos + 1) * s2)::bigint as weighted from m group by doc_id""")
def adjusted_offsets(spark, sf):
    # the document text plays the prefixed text: its first nine characters are the prefix
    d = D.documents(spark, sf).where(HAS_WORDS).select("doc_id", "text", T.word_spans(F.col("text")).alias("s"))
    d = d.withColumn("m", T.adjust_offsets(F.col("s"), 9, F.length("text") - 9))
    add = lambda f: F.aggregate(F.transform("m", f), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select("doc_id", add(lambda s: big(s["start"])).alias("start_sum"), add(lambda s: big(s["end"])).alias("end_sum"),
                    add(lambda s, i: big(s["start"]) * (i + 1)).alias("weighted"))


@query("T17_word_counts", r"""
select doc_id, len(regexp_extract_all(text, '\S+'))::bigint as n_words from documents""")
def word_counts(spark, sf):
    return D.documents(spark, sf).select("doc_id", big(T.word_count(F.col("text"))).alias("n_words"))


@query("T18_seeded_digest", r"""
select doc_id, substring(sha256('13:' || 'q' || doc_id), 1, 16) as digest from documents""")
def seeded_digest(spark, sf):
    ident = F.concat(F.lit("13:q"), "doc_id")
    return D.documents(spark, sf).select("doc_id", F.substr(F.sha2(ident, 256), F.lit(1), F.lit(16)).alias("digest"))


HASHED = r"""
tok as (select distinct lower(w) w from (select unnest(regexp_extract_all(text, '\S+')) w from {table})),
raw as (select w, list_transform(range(32), lambda i: ('0x' || substring(sha256('{kind}::' || w), 2 * i + 1, 2))::int / 255.0::double * 2 - 1) v from tok),
hv as (select w, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v from raw),
"""


@query("V3_hash_vectors", "with" + HASHED.format(table="benchmark", kind="query") + r"""
z as (select w, unnest(range(48)) d, v from hv), n as (select w, d, v[d % 32 + 1] x from z),
s as (select w, sqrt(sum(x * x)) l from n group by w)
select n.w as token, n.d::bigint as d, round(x / l, 6) as x from n join s using (w)""")
def hash_vectors(spark, sf):
    w = D.table(spark, sf, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w"))
    w = w.select(F.lower("w").alias("token")).distinct()
    v = V.hash_vector(F.concat(F.lit("query::"), "token"), 48)
    return w.select("token", F.posexplode(v).alias("d", "x")).select("token", big(F.col("d")).alias("d"), r6(F.col("x")).alias("x"))


@query("V4_passage_tokens", "with" + HASHED.format(table="documents", kind="passage") + """z as (select 1)
select w as token, array_to_string(list_transform(v, lambda x: round(x * 1000000)::bigint), ',') as entries from hv""")
def passage_tokens(spark, sf):
    w = D.documents(spark, sf).select(F.explode(T.words(F.col("text"))).alias("w"))
    v = w.select(F.lower("w").alias("token")).distinct().withColumn("v", V.hash_passage(F.col("token"), 32))
    return v.select("token", F.array_join(F.transform("v", lambda x: F.round(x * 1000000).cast("bigint")), ",").alias("entries"))


@query("V5_hash_queries", "with" + HASHED.format(table="benchmark", kind="query") + r"""
bw as (select item_id, unnest(regexp_extract_all(text, '\S+')) w from benchmark),
dims as (select item_id, v, unnest(range(32)) d from bw join hv on hv.w = lower(bw.w)),
su as (select item_id, d, sum(v[d + 1]) s from dims group by item_id, d),
nn as (select item_id, sqrt(sum(s * s)) l from su group by item_id)
select item_id, (d + 32 * j)::bigint as d, round(s / l / 2, 6) as x from su join nn using (item_id), range(4) as r(j)""")
def hash_queries(spark, sf):
    b = D.table(spark, sf, "benchmark").select("item_id", V.hash_query(F.col("text"), 128).alias("v"))
    rows = b.select("item_id", F.posexplode("v").alias("d", "x"))
    return rows.select("item_id", big(F.col("d")).alias("d"), r6(F.col("x")).alias("x"))


@query("V14_heuristic_trt", "with" + WORDS + r"""
z as (select doc_id, length(regexp_replace(regexp_replace(word, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '')) / 10.0::double as t from words)
select doc_id, round(sum(t), 6) as trt_sum, round(max(t), 6) as trt_max, round(sum(least(1, t)), 6) as fix_prop_sum,
       round(sum(1 + t), 6) as n_fix_sum from z group by doc_id""")
def heuristic_trt(spark, sf):
    d = D.documents(spark, sf).where(HAS_WORDS).select("doc_id", reading.heuristic_words(F.col("text")).alias("w"))
    f = lambda name: F.transform("w", lambda x: x["features"][name])
    return d.select(
        "doc_id", r6(total(F.transform("w", lambda x: x["trt"]))).alias("trt_sum"), r6(F.array_max(f("TRT"))).alias("trt_max"),
        r6(total(f("fixProp"))).alias("fix_prop_sum"), r6(total(f("nFix"))).alias("n_fix_sum"),
    )


