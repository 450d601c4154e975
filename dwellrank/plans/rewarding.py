"""Registered queries over reward pairs and context compression."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellrank.functions import scores as S, text as T
from dwellrank.functions.arrays import explode_rows
from dwellrank.functions.models import budgeted_log_probs, standin_log_probs
from dwellrank.functions.prompts import reward_prompt
from dwellrank.functions.reading import heuristic_scores
from dwellrank.operators import rewards as W
from dwellrank.plans import workload as D
from dwellrank.plans.corpora import CONTEXT_PIECES, big, r6
from dwellrank.plans.registry import query

BUDGET = 64

# all pieces of at most 80 words (longer ones are cut) with their words
CHUNKS = CONTEXT_PIECES + r"""
pw as (select doc_id, "start", piece, unnest(regexp_extract_all(piece, '\s*\S+')) tile, generate_subscripts(regexp_extract_all(piece, '\s*\S+'), 1) i from pieces),
off as (select *, sum(length(tile)) over (partition by doc_id, "start" order by i) as upto from pw),
cut as (select doc_id, "start", (i - 1) // 80 as g, min(upto - length(regexp_replace(tile, '^\s+', ''))) a, max(upto) b, piece from off group by all),
allc as (select doc_id, "start" + a as cs, substring(piece, (a + 1)::bigint, (b - a)::bigint) body from cut
         union all
         select doc_id, 0, body from ctx where doc_id not in (select doc_id from pieces) and length(body) > 0),
ch as (select doc_id, (row_number() over (partition by doc_id order by cs) - 1)::int as idx, body, len(regexp_extract_all(body, '\S+')) as cost from allc),
cw as (select doc_id, idx, unnest(regexp_extract_all(body, '\S+')) w from ch),
trt as (select doc_id, idx, avg(ln(1 + length(regexp_replace(regexp_replace(w, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '')) / 10.0::double)) as t from cw group by 1, 2),
"""
TRT_SOFTMAX = CHUNKS + """
ex as (select doc_id, idx, exp(t / 0.1::double - max(t / 0.1::double) over (partition by doc_id)) as e from (select doc_id, idx, round(t, 9) as t from trt)),
w as (select doc_id, idx, e / sum(e) over (partition by doc_id) as p from ex),
"""
# the greedy fold as a recursion over the ranked chunks of every text
GREEDY = """
ranked as (select w.doc_id, w.idx, greatest(1, c.cost) as cost, c.body, row_number() over (partition by w.doc_id order by round(w.p, 9) desc, w.idx) as k
           from w join ch c on c.doc_id = w.doc_id and c.idx = w.idx),
g as (select doc_id, k, idx, body, cost as total, true as taken, 1 as n from ranked where k = 1
      union all
      select r.doc_id, r.k, r.idx, r.body, case when g.total + r.cost <= {budget} then g.total + r.cost else g.total end, g.total + r.cost <= {budget}, g.n + 1
      from g join ranked r on r.doc_id = g.doc_id and r.k = g.k + 1),
sel as (select * from g where taken),
"""


def contexts(spark, sf):
    """Reward rows with a context that has text."""
    return D.reward_rows(spark, sf).where(F.length(T.strip(F.col("prompt"))) > 0)


def _chunk_scores(spark, sf):
    """Per context: chunks, costs and rounded reading-time scores."""
    c = contexts(spark, sf).withColumn("c", T.context_chunks(T.strip(F.col("prompt")), 80))
    c = c.select("row_index", "c", heuristic_scores(F.col("c.text")).alias("s"))
    return c.select("row_index", "c", F.col("s.score").alias("raw"), F.transform("s.score", lambda x: F.round(x, 9)).alias("t"), F.col("s.words").alias("k"))


@query("A17_chunk_trt_scores", "with" + CHUNKS + "z as (select 1) select doc_id, idx::bigint as chunk_index, round(t, 6) as score from trt")
def chunk_trt_scores(spark, sf):
    c = _chunk_scores(spark, sf)
    rows = explode_rows(c, [F.col("row_index").alias("doc_id")], F.col("raw"), "chunk_index", "score")
    return rows.select("doc_id", big(F.col("chunk_index")).alias("chunk_index"), r6(F.col("score")).alias("score"))


@query("V17_trt_distribution", "with" + TRT_SOFTMAX + "z as (select 1) select doc_id, idx::bigint as chunk_index, round(p, 6) as p from w")
def trt_distribution(spark, sf):
    c = _chunk_scores(spark, sf)
    p = S.combine_scores(S.TRT_ONLY, None, F.col("t"))
    rows = explode_rows(c, [F.col("row_index").alias("doc_id")], p, "chunk_index", "p")
    return rows.select("doc_id", big(F.col("chunk_index")).alias("chunk_index"), r6(F.col("p")).alias("p"))


QUERY_SCORES = CHUNKS + r"""
qtok as (select distinct lower(w) w from (select unnest(regexp_extract_all(text, '\S+')) w from benchmark)),
qraw as (select w, list_transform(range(32), lambda i: ('0x' || substring(sha256('query::' || w), 2 * i + 1, 2))::int / 255.0::double * 2 - 1) v from qtok),
qhv as (select w, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v from qraw),
qd as (select item_id, v, unnest(range(32)) d from (select item_id, unnest(regexp_extract_all(text, '\S+')) w from benchmark) b join qhv on qhv.w = lower(b.w)),
qs as (select item_id, d, sum(v[d + 1]) x from qd group by 1, 2),
qv as (select item_id, list(x order by d) v from qs group by 1),
ptok as (select distinct lower(w) w from cw),
praw as (select w, list_transform(range(32), lambda i: ('0x' || substring(sha256('passage::' || w), 2 * i + 1, 2))::int / 255.0::double * 2 - 1) v from ptok),
phv as (select w, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v from praw),
cd as (select doc_id, idx, v, unnest(range(32)) d from cw join phv on phv.w = lower(cw.w)),
cs2 as (select doc_id, idx, d, sum(v[d + 1]) x from cd group by 1, 2, 3),
cv as (select doc_id, idx, list(x order by d) v from cs2 group by 1, 2),
qsc as (select doc_id, idx, list_dot_product(cv.v, qv.v) / sqrt(list_dot_product(cv.v, cv.v)) / sqrt(list_dot_product(qv.v, qv.v)) as s from cv join qv on qv.item_id = doc_id % (select count(*) from benchmark)),
"""


@query("V18_query_chunk_scores", "with" + QUERY_SCORES + "z as (select 1) select doc_id, idx::bigint as chunk_index, round(s, 6) as score from qsc")
def query_chunk_scores(spark, sf):
    scored = W.context_scores(contexts(spark, sf), 80, 128)
    both = scored.select(F.col("row_index").alias("doc_id"), F.arrays_zip("_costs", "_query_scores").alias("z"))
    rows = explode_rows(both, ["doc_id"], F.col("z"), "chunk_index", "s")
    return rows.select("doc_id", big(F.col("chunk_index")).alias("chunk_index"), r6(F.col("s._query_scores")).alias("score"))


@query("V17_product_of_experts", "with" + QUERY_SCORES + """
eq as (select doc_id, idx, exp(s / 0.05::double - max(s / 0.05::double) over (partition by doc_id)) as e from qsc),
et as (select doc_id, idx, exp(t / 0.1::double - max(t / 0.1::double) over (partition by doc_id)) as e from trt),
pq as (select doc_id, idx, e / sum(e) over (partition by doc_id) as p from eq), pt as (select doc_id, idx, e / sum(e) over (partition by doc_id) as p from et),
c as (select doc_id, idx, (pq.p + 1e-12) * power(pt.p + 1e-12, 0.25) as x from pq join pt using (doc_id, idx))
select doc_id, idx::bigint as chunk_index, round(x / sum(x) over (partition by doc_id), 5) as p from c""")
def product_of_experts(spark, sf):
    scored = W.context_scores(contexts(spark, sf), 80, 128)
    p = S.combine_scores(S.QUERY_X_TRT, F.col("_query_scores"), F.col("_trt_scores"))
    rows = explode_rows(scored, [F.col("row_index").alias("doc_id")], p, "chunk_index", "p")
    return rows.select("doc_id", big(F.col("chunk_index")).alias("chunk_index"), F.round("p", 5).alias("p"))


@query("L13_budget_selection", "with recursive" + TRT_SOFTMAX + GREEDY.format(budget=BUDGET) + """z as (select 1)
select doc_id, count(*)::bigint as selected, string_agg(idx::varchar, ',' order by idx) as chunks,
       md5(string_agg(body, chr(10) || chr(10) order by idx)) as text_md5 from sel group by 1""")
def budget_selection(spark, sf):
    c = _chunk_scores(spark, sf)
    p = F.transform(S.combine_scores(S.TRT_ONLY, None, F.col("t")), lambda x: F.round(x, 9))
    taken = W.greedy_select(F.col("c"), p, F.col("k"), F.lit(BUDGET))
    c = c.select(F.col("row_index").alias("doc_id"), taken.alias("s"))
    return c.select("doc_id", big(F.size("s")).alias("selected"), F.array_join(F.transform("s", lambda x: x["index"].cast("string")), ",").alias("chunks"),
                    F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "\n\n")).alias("text_md5"))


@query("V20_compression_ratio", r"""
select doc_id, case when n_chars = 0 then 1.0 else round(len(regexp_extract_all(text, '\S+')) / n_chars, 6) end::double as ratio from documents""")
def compression_ratio(spark, sf):
    return D.documents(spark, sf).select("doc_id", r6(S.compression_ratio(T.word_count(F.col("text")), F.col("n_chars"))).alias("ratio"))


@query("V21_context_metadata", r"""
with c as (select doc_id, len(regexp_extract_all(text, '\S+'))::bigint n from documents where regexp_matches(text, '\S'))
select doc_id, 'full_context' as condition, n as original_context_tokens, n as compressed_context_tokens, 1.0::double as compression_ratio, null::bigint as selected_chunk_count from c""")
def context_metadata(spark, sf):
    b = W.build_contexts(contexts(spark, sf), [(S.FULL_CONTEXT, None)])
    return b.select(F.col("row_index").alias("doc_id"), "condition", big(F.col("original_context_tokens")).alias("original_context_tokens"),
                    big(F.col("compressed_context_tokens")).alias("compressed_context_tokens"), "compression_ratio",
                    big(F.col("selected_chunk_count")).alias("selected_chunk_count"))


@query("V22_context_variants")
def context_variants(spark, sf):
    pairs = W.condition_budget_pairs(list(W.SUPPORTED), [64, 256])
    b = W.build_contexts(contexts(spark, sf), pairs)
    return b.select("row_index", "condition", "context_budget_tokens", "original_context_tokens", "compressed_context_tokens",
                    "selected_chunk_count", F.md5("compressed_context").alias("context_md5"))


@query("J17_condition_budgets", r"""
select doc_id, c as condition, b::bigint as context_budget_tokens from documents, (values ('full_context', null), ('query_only_compression', 64), ('query_only_compression', 256)) t(c, b)
where regexp_matches(text, '\S')""")
def condition_budgets(spark, sf):
    pairs = W.condition_budget_pairs([S.FULL_CONTEXT, S.QUERY_ONLY], [64, 256])
    b = W.build_contexts(contexts(spark, sf), pairs)
    return b.select(F.col("row_index").alias("doc_id"), "condition", big(F.col("context_budget_tokens")).alias("context_budget_tokens"))


@query("P14_row_ids", """
with r as (select doc_id, case doc_id % 3 when 1 then 'row' || doc_id else doc_id::varchar end as row_id, case when doc_id % 2 = 0 then 512 end as budget from documents where regexp_matches(text, '\\S'))
select row_id, row_id || '::full_context::budget=' || coalesce(budget::varchar, 'full') as id from r""")
def row_ids(spark, sf):
    r = contexts(spark, sf).select(W.row_id(F.col("id"), F.col("row_index")).alias("row_id"), F.when(F.col("row_index") % 2 == 0, F.lit(512)).alias("b"))
    return r.select("row_id", W.prediction_id(F.col("row_id"), F.lit(S.FULL_CONTEXT), F.col("b")).alias("id"))


@query("S14_subset_rows", """
select doc_id as row_index, lang as subset from documents where lang in ('en', 'fr') order by doc_id limit 50""")
def subset_rows(spark, sf):
    rows = D.reward_rows(spark, sf)
    return W.select_rows(rows, ["en", "fr"], 50).select("row_index", "subset")


@query("T14_reward_prompts", """
select d.doc_id, md5('You are answering a retrieval-augmented question using only the provided references.' || chr(10) || chr(10) || regexp_replace(regexp_replace(d.text, '\\s+$', ''), '^\\s+', '')
  || chr(10) || chr(10) || 'Question:' || chr(10) || trim(b.text) || chr(10) || chr(10) || 'Answer:' || chr(10)) as prompt_md5
from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark)""")
def reward_prompts(spark, sf):
    r = D.reward_rows(spark, sf)
    return r.select(F.col("row_index").alias("doc_id"), F.md5(reward_prompt(F.col("prompt"), F.col("question"))).alias("prompt_md5"))


@query("V19_ties", """
with z as (select o_orderkey, o_totalprice as a, o_totalprice * (1 + (o_orderkey % 5 - 2) * 0.000004::double) as b from orders)
select o_orderkey, abs(a - b) <= 1e-8::double + 1e-5::double * abs(b) as tie, a > b as correct from z""")
def ties(spark, sf):
    a = F.col("o_totalprice")
    b = a * (1 + (F.col("o_orderkey") % 5 - 2) * 0.000004)
    return D.table(spark, sf, "orders").select("o_orderkey", S.is_close(a, b).alias("tie"), (a > b).alias("correct"))


SUMMARY = """
f as (select case when n % 2 = 0 then 'query_only_compression' else 'full_context' end as condition, case when n % 2 = 0 then (n % 3 + 1) * 256 end as budget, lang as subset,
        (quality = 1)::int as correct, (toxic = 1)::int as tie, (doc_id * 7919 % 2003 - 1000) / 64.0::double as delta, 1.0::double / (n + 1) as ratio, n_chars
      from (select l.*, d.lang, d.n_chars, regexp_extract(d.source, '(\\d+)$', 1)::int as n from labels l join documents d using (doc_id))),
"""


@query("A11_reward_summary", "with" + SUMMARY + """
g as (select case when grouping(condition) = 1 then 'overall' when grouping(subset) = 1 then 'condition' else 'subset' end as scope, condition, budget, subset,
   count(*) n, avg(correct) a, avg(tie) t, avg(delta) m, median(delta) md, avg(ratio) r, avg(n_chars) k from f group by grouping sets ((), (condition, budget), (condition, budget, subset)))
select scope, condition, budget::bigint as context_budget_tokens, subset, n::bigint as count, round(a, 6) as accuracy, round(t, 6) as tie_rate, round(m, 6) as mean_score_delta,
  round(md, 6) as median_score_delta, round(r, 6) as mean_compression_ratio, round(k, 4) as mean_compressed_context_tokens from g""")
def reward_summary(spark, sf):
    s = W.summarize(D.labelled_scores(spark, sf))
    return s.select("scope", "condition", big(F.col("context_budget_tokens")).alias("context_budget_tokens"), "subset", "count",
                    *[r6(F.col(c)).alias(c) for c in ("accuracy", "tie_rate", "mean_score_delta", "median_score_delta", "mean_compression_ratio")],
                    F.round("mean_compressed_context_tokens", 4).alias("mean_compressed_context_tokens"))


@query("A11_exact_median", "select l_returnflag, round(median(l_extendedprice), 4) as median_price from lineitem group by 1")
def exact_median(spark, sf):
    m = W.exact_median(D.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return m.select("l_returnflag", F.round("median", 4).alias("median_price"))


# the stand-in scorer: digest of prompt, position and word
LOGPROBS = r"""
pr as (select d.doc_id, case d.doc_id % 3 when 1 then 'row' || d.doc_id else d.doc_id::varchar end as row_id, lang, source,
   sha256('You are answering a retrieval-augmented question using only the provided references.' || chr(10) || chr(10) || regexp_replace(regexp_replace(d.text, '\s+$', ''), '^\s+', '')
   || chr(10) || chr(10) || 'Question:' || chr(10) || trim(b.text) || chr(10) || chr(10) || 'Answer:' || chr(10)) as pkey from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark) where regexp_matches(d.text, '\S')),
op as (select doc_id, row_id, pkey, 'chosen' as which, regexp_extract_all('It is ' || lang || ' from ' || source, '\S+') ws from pr
   union all select doc_id, row_id, pkey, 'reject', regexp_extract_all('No ' || source || ' here', '\S+') from pr),
tk as (select doc_id, row_id, which, pkey, unnest(ws) w, generate_subscripts(ws, 1) - 1 as i from op),
lp as (select doc_id, row_id, which, ('0x' || substring(sha256(pkey || ':' || i || ':' || w), 1, 8))::bigint / 4294967296.0::double * -8 as x from tk),
"""


@query("A18_option_scores", "with" + LOGPROBS + "z as (select 1) select doc_id, which, round(sum(x), 6) as total, round(avg(x), 6) as mean, count(*)::bigint as tokens from lp group by 1, 2")
def option_scores(spark, sf):
    r = contexts(spark, sf).withColumn("p", reward_prompt(F.col("prompt"), F.col("question")))
    options = F.array(*[F.struct(F.lit(c).alias("which"), standin_log_probs(F.col("p"), F.col(c)).alias("lp")) for c in ("chosen", "reject")])
    rows = explode_rows(r, [F.col("row_index").alias("doc_id")], options, "i", "o")
    total = F.aggregate("o.lp", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.col("o.which").alias("which"), r6(total).alias("total"), r6(total / F.size("o.lp")).alias("mean"), big(F.size("o.lp")).alias("tokens"))


@query("M7_scored_pairs", "with" + LOGPROBS + """
s as (select doc_id, row_id, avg(x) filter (which = 'chosen') a, avg(x) filter (which = 'reject') b from lp group by 1, 2)
select row_id || '::full_context::budget=full' as id, doc_id as row_index, round(a, 6) as chosen_score, round(b, 6) as reject_score, round(a - b, 6) as score_delta, a > b as correct,
   abs(a - b) <= 1e-8 + 1e-5 * abs(b) as tie from s""")
def scored_pairs(spark, sf):
    c = W.build_contexts(contexts(spark, sf), [(S.FULL_CONTEXT, None)])
    s = W.score_pairs(c, standin_log_probs)
    return s.select("id", "row_index", *[r6(F.col(x)).alias(x) for x in ("chosen_score", "reject_score", "score_delta")], "correct", "tie")




PROMPT_TOKENS = 48  # tokens of prompt and response together, fewer than most prompts have


class PieceScorer:
    """Stands in for a model with sub-word tokens: pieces of at most four characters; a token's value is a digest of the prefix, its place and itself."""

    def token_ids(self, text, special):
        import re

        return ["<s>"] * special + [w[i : i + 4] for w in re.findall(r"\S+", text) for i in range(0, len(w), 4)]

    def id_log_probs(self, prefix, choices):
        import hashlib

        key = hashlib.sha256("|".join(prefix).encode()).hexdigest()
        value = lambda k, t: int(hashlib.sha256(f"{key}:{k}:{t}".encode()).hexdigest()[:8], 16) / 2**32 * -8.0
        return [[value(k, t) for k, t in enumerate(c)] for c in choices]


_PIECES = "flatten(list_transform(regexp_extract_all({0}, '\\S+'), lambda w: list_transform(range((length(w) + 3) // 4), lambda i: substring(w, 4 * i + 1, 4))))"


@query("M4_budgeted_likelihoods", rf"""
with pr as (select d.doc_id, 'You are answering a retrieval-augmented question using only the provided references.' || chr(10) || chr(10) || regexp_replace(regexp_replace(d.text, '\s+$', ''), '^\s+', '')
   || chr(10) || chr(10) || 'Question:' || chr(10) || trim(b.text) || chr(10) || chr(10) || 'Answer:' || chr(10) as prompt,
   'It is ' || lang || ' from ' || source as chosen, 'No ' || source || ' here' as reject from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark) where regexp_matches(d.text, '\S')),
tk as (select doc_id, list_concat(['<s>'], {_PIECES.format('prompt')}) as p, {_PIECES.format('chosen')} as a, {_PIECES.format('reject')} as b from pr),
ky as (select *, sha256(array_to_string(list_slice(p, -least(len(p), {PROMPT_TOKENS} - greatest(len(a), len(b))), len(p)), '|')) as pkey from tk),
op as (select doc_id, 'chosen' as which, pkey, a as ts from ky union all select doc_id, 'reject', pkey, b from ky),
el as (select doc_id, which, pkey, unnest(ts) as t, generate_subscripts(ts, 1) - 1 as i from op)
select doc_id, which, count(*)::bigint as tokens, round(sum(('0x' || substring(sha256(pkey || ':' || i || ':' || t), 1, 8))::bigint / 4294967296.0::double * -8), 6) as total from el group by 1, 2""")
def budgeted_likelihoods(spark, sf):
    """Both responses behind the same last tokens of the prompt, by a model with tokens of its own."""
    c = W.build_contexts(contexts(spark, sf), [(S.FULL_CONTEXT, None)])
    p = reward_prompt(F.col("compressed_context"), F.col("question"))
    both = c.select(F.col("row_index").alias("doc_id"), budgeted_log_probs(PieceScorer, p, F.array("chosen", "reject"), PROMPT_TOKENS).alias("s"))
    named = F.array(*[F.struct(F.lit(n).alias("which"), F.col("s")[k].alias("lp")) for k, n in enumerate(("chosen", "reject"))])
    rows = explode_rows(both, ["doc_id"], named, "i", "o")
    return rows.select("doc_id", F.col("o.which").alias("which"), big(F.size("o.lp")).alias("tokens"), r6(F.aggregate("o.lp", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("M4_budgeted_pairs", rf"""
with pr as (select d.doc_id, regexp_extract_all('You are answering a retrieval-augmented question using only the provided references.' || chr(10) || chr(10) || d.text
   || chr(10) || chr(10) || 'Question:' || chr(10) || b.text || chr(10) || chr(10) || 'Answer:' || chr(10), '\S+') as p,
   regexp_extract_all('It is ' || lang || ' from ' || source, '\S+') as a, regexp_extract_all('No ' || source || ' here', '\S+') as b from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark) where regexp_matches(d.text, '\S')),
ky as (select *, sha256(array_to_string(list_slice(p, -least(len(p), 32 - greatest(len(a), len(b))), len(p)), ' ')) as pkey from pr),
op as (select doc_id, 'chosen' as which, pkey, a as ts from ky union all select doc_id, 'reject', pkey, b from ky),
el as (select doc_id, which, pkey, unnest(ts) as t, generate_subscripts(ts, 1) - 1 as i from op),
lp as (select doc_id, which, avg(('0x' || substring(sha256(pkey || ':' || i || ':' || t), 1, 8))::bigint / 4294967296.0::double * -8) as x from el group by 1, 2)
select doc_id as row_index, round(max(x) filter (which = 'chosen'), 6) as chosen_score, round(max(x) filter (which = 'reject'), 6) as reject_score from lp group by 1""")
def budgeted_pairs(spark, sf):
    """The stage's scorer with a limit of 32 words: the longer response sets the room of both."""
    c = W.build_contexts(contexts(spark, sf), [(S.FULL_CONTEXT, None)])
    longest = F.greatest(T.word_count(F.col("chosen")), T.word_count(F.col("reject")))
    s = W.score_pairs(c, lambda p, r: standin_log_probs(p, r, 32, longest))
    return s.select("row_index", r6(F.col("chosen_score")).alias("chosen_score"), r6(F.col("reject_score")).alias("reject_score"))
