import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellrank.functions import models as M, prompts as P, scores as S, vectors as V
from dwellrank.operators import rewards as W


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def softmax(values, tau):
    x = np.asarray(values) / tau
    e = np.exp(x - x.max())
    return e / e.sum()


def test_softmax(one):
    assert np.allclose(one(S.softmax(doubles([1, 2, 3]), 0.5)), softmax([1, 2, 3], 0.5))
    got = one(S.softmax(doubles([1, math.nan, 2, math.inf]), 1.0))
    assert got[1] == got[3] == 0 and np.allclose([got[0], got[2]], softmax([1, 2], 1.0))
    assert one(S.softmax(doubles([math.nan, -math.inf]), 1.0)) == [0.5, 0.5]
    with pytest.raises(ValueError):
        S.softmax(F.col("x"), 0)


def test_gaze_distribution(one):
    g = one(S.gaze_distribution(doubles([0, 10, 30])))
    assert abs(sum(g) - 1) < 1e-12 and all(x > 0 for x in g)
    assert one(S.gaze_distribution(doubles([0, 0, 0, 0]))) == [0.25] * 4
    g = one(S.gaze_distribution(doubles([1, math.nan, -5, math.inf]), "identity"))
    assert g[1] == g[2] == g[3] and g[0] > 0.99
    for bad in (dict(transform="sqrt"), dict(eps=0)):
        with pytest.raises(ValueError):
            S.gaze_distribution(F.col("x"), **bad)


def test_concentration(one):
    assert abs(one(S.gaze_concentration(doubles([0.1, 0.2, 0.7]), 1 / 3)) - 0.7) < 1e-12
    assert one(S.gaze_concentration(doubles([math.nan, 2, 1]), 0.1)) == 2
    with pytest.raises(ValueError):
        S.gaze_concentration(F.col("x"), 0)


def test_combined_scores(one):
    q, t = doubles([1, 0.1]), doubles([0.1, 1])
    p = one(S.combine_scores(S.QUERY_X_TRT, q, t, beta=0.1, tau_q=0.1, tau_g=0.1))
    assert abs(sum(p) - 1) < 1e-12 and p[0] > p[1]
    assert np.allclose(one(S.combine_scores(S.QUERY_ONLY, q)), softmax([1, 0.1], 0.05))
    assert np.allclose(one(S.combine_scores(S.TRT_ONLY, None, t)), softmax([0.1, 1], 0.1))
    for condition, args in ((S.QUERY_ONLY, (None, t)), (S.TRT_ONLY, (q, None)), (S.QUERY_X_TRT, (q, None)), ("other", (q, t))):
        with pytest.raises(ValueError):
            S.combine_scores(condition, *args)


def test_small_functions(one):
    strings = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(S.jaccard(strings("c1", "c2"), strings("c2", "c3"))) == pytest.approx(1 / 3)
    empty = F.array().cast("array<string>")
    assert one(S.jaccard(empty, empty)) == 1 and one(S.jaccard(empty, F.lit(None).cast("array<string>"))) is None
    assert one(S.first_argmax(doubles([1, 3, 3]))) == 1
    assert one(S.is_close(F.lit(1.0), F.lit(1.000001))) is True and one(S.is_close(F.lit(1.0), F.lit(1.1))) is False
    assert one(S.compression_ratio(F.lit(2), F.lit(4))) == 0.5 and one(S.compression_ratio(F.lit(2), F.lit(0))) == 1
    assert one(S.log1p_mean(doubles([-1, math.e - 1]))) == pytest.approx(0.5) and one(S.log1p_mean(doubles([]))) == 0


def test_vectors(one):
    assert one(V.normalize(doubles([3, 4]))) == [0.6, 0.8]
    assert one(V.normalize(doubles([0, 0]))) == [0, 0] and one(V.normalize(doubles([math.inf, 1]))) == [0, 0]
    assert one(V.cosine(doubles([1, 0]), doubles([2, 0]))) == 1 and one(V.cosine(doubles([0, 0]), doubles([1, 0]))) == 0


@pytest.mark.parametrize("dim", [5, 32, 48, 128])
def test_hash_encoder(one, dim):
    import hashlib

    def vector(text):
        raw = np.array([hashlib.sha256(text.encode()).digest()[i % 32] for i in range(dim)]) / 255 * 2 - 1
        return raw / np.linalg.norm(raw)

    assert np.allclose(one(V.hash_passage(F.lit("Été"), dim)), vector("passage::été"), atol=1e-12)
    pooled = np.mean([vector(f"query::{w}") for w in ("what", "is", "what")], axis=0)
    assert np.allclose(one(V.hash_query(F.lit("What is what"), dim)), pooled / np.linalg.norm(pooled), atol=1e-12)
    from dwellrank.operators.attention import hash_rows

    assert np.allclose(hash_rows(["été"], dim)[0], vector("passage::été"), atol=1e-12)


def test_choice_block_and_prompts(one):
    choices = F.array(F.lit("alpha"), F.lit("beta"))
    assert one(P.choice_block(choices)) == "A. alpha\nB. beta"
    prompt = one(P.mcqa_prompt(F.lit(" Q? "), choices, F.array(F.lit(" Evidence text "))))
    assert "[Evidence 1]\nEvidence text\n\nAnswer:" in prompt and "Question:\nQ?\n" in prompt and prompt.endswith("Answer:")
    assert "No retrieved evidence." in one(P.mcqa_prompt(F.lit("Q"), choices, F.array().cast("array<string>")))
    assert "evidence" not in one(P.bare_prompt(F.lit("Q"), choices))
    assert one(P.reward_prompt(F.lit(" ctx "), F.lit(" q "))).endswith("ctx\n\nQuestion:\nq\n\nAnswer:\n")
    for bad in (P.bare_prompt(F.lit(" "), choices), P.choice_block(F.array().cast("array<string>"))):
        with pytest.raises(Exception, match="question|choices"):
            one(bad)


PARSED = {
    "A": 0, "(B) because": 1, "The answer is C.": 2, "option D": 3, "A or B": None, "No clear answer": None, "": None,
    "Because it fits": 1, "Definitely B": 3, "1. b": 1, "42 b or b": None, "answer: [c]": 0, "x answer: [c]": 2, "é": None,
    "the choice (D)": 3, "7 a": 0, "l'a": 0, "9 à b": 1,
}


@pytest.mark.parametrize("raw", list(PARSED))
def test_parser(one, raw):
    # "answer: [c]" begins with the letter a, which counts as a leading label
    assert one(P.parse_choice(F.lit(raw), F.lit(4))) == PARSED[raw]


def test_stand_in_models(one):
    prompt, choices = F.lit("p"), F.array(F.lit("one two"), F.lit("three"))
    scores = one(M.option_scores(prompt, choices))
    answer = one(M.predict_answer(prompt, choices, "loglik"))
    assert answer["predicted_index"] == int(np.argmax(scores)) and all(s <= 0 for s in scores)
    generated = one(M.predict_answer(prompt, choices, "generate"))
    assert generated["raw_output"] == f"({'AB'[generated['predicted_index']]})"
    full = one(M.standin_log_probs(F.lit("a b c d"), F.lit("x y")))
    cut = one(M.standin_log_probs(F.lit("z z a b c d"), F.lit("x y"), 6))
    assert full == cut
    with pytest.raises(Exception, match="longer"):
        one(M.standin_log_probs(F.lit("a"), F.lit("x y"), 2))
    with pytest.raises(ValueError):
        M.predict_answer(prompt, choices, "vote")


def test_plugged_in_models(spark):
    class Encoder:
        def encode_passage(self, text, max_length):
            return {"tokens": text.split(), "offsets": [(0, 1)], "hidden": np.ones((1, 2))}

        def encode_query(self, text, max_length):
            return np.array([3.0, 4.0]) if text.startswith("query: ") else np.zeros(2)

    class Generator:
        def generate(self, prompt, max_new_tokens, temperature):
            return "B"

        def token_log_probs(self, prefix, choice, max_length):
            return [-1.0] * len(choice)

    df = spark.createDataFrame([("q",), ("r",)], "t string")
    got = df.select(M.query_encoding(Encoder, F.col("t")).alias("q"), M.passage_encoding(Encoder, F.col("t")).alias("p"),
                    M.generated_text(Generator, F.col("t")).alias("g"), M.option_log_probs(Generator, F.col("t"), F.lit("ab")).alias("l")).first()
    assert np.allclose(got["q"], [0.6, 0.8]) and got["p"]["tokens"] == ["passage:", "q"] and got["g"] == "B" and got["l"] == [-1, -1]


def test_masked_means():
    rng = np.random.default_rng(3)
    hidden = [rng.normal(size=(n, 4)) for n in (3, 0, 1, 7)]
    masks = [[1, 0, 1], [], [0], [1] * 7]
    got = M.masked_means(hidden, masks)
    assert np.allclose(got[0], hidden[0][[0, 2]].mean(axis=0)) and np.allclose(got[3], hidden[3].mean(axis=0))
    assert not got[1].any() and not got[2].any()
    assert [len(v) for v in M.masked_means([np.zeros((0, 2))], [[]])] == [2]


def test_budget_is_shared_by_the_options(spark):
    """The longest option sets how much of the prefix both see; the leading token goes first."""

    class BudgetModel:
        """Words as tokens; an option's value tells the prefix it was given."""

        def token_ids(self, text, special):
            return [0] * special + [len(w) for w in text.split()]

        def id_log_probs(self, prefix, choices):
            return [[-float(sum(prefix) + len(prefix) / 100)] * len(c) for c in choices]

    df = spark.createDataFrame([("a bb ccc dddd", ["x", "x y"])], "p string, c array<string>")
    score = lambda n: df.select(M.budgeted_log_probs(BudgetModel, F.col("p"), F.col("c"), n)).first()[0]
    assert score(100) == [[-10.05], [-10.05] * 2]
    assert score(6) == [[-10.04], [-10.04] * 2]
    assert score(4) == [[-7.02], [-7.02] * 2]
    with pytest.raises(Exception, match="longer than the maximum"):
        score(2)
    both = df.select(*[M.standin_log_probs(F.col("p"), F.lit("x"), 4, F.lit(n))[0].alias(f"n{n}") for n in (1, 2)]).first()
    assert both["n1"] == df.select(M.standin_log_probs(F.lit("bb ccc dddd"), F.lit("x"))[0].alias("v")).first()["v"]
    assert both["n2"] == df.select(M.standin_log_probs(F.lit("ccc dddd"), F.lit("x"))[0].alias("v")).first()["v"]


def test_row_ids(one):
    assert [one(W.row_id(F.lit(v).cast("string"), F.lit(3))) for v in ("abc", "", None)] == ["abc", "3", "3"]
    assert one(W.prediction_id(F.lit("r"), F.lit("c"), F.lit(None).cast("int"))) == "r::c::budget=full"


def test_hash_scores_agree(spark):
    from dwellrank.operators.attention import hash_chunk_scores

    df = spark.createDataFrame([("What is Alpha", ["Alpha is beta", "zeta \x1c", ""]), ("q", ["q"])], "q string, t array<string>")
    exact = F.transform("t", lambda t: F.aggregate(F.zip_with(V.hash_pool(F.col("q"), 64, "query"), V.hash_pool(t, 64, "passage"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    for row in df.select(hash_chunk_scores(F.col("q"), F.col("t"), 64).alias("a"), exact.alias("b")).collect():
        assert np.allclose(row["a"], row["b"], atol=1e-12)
