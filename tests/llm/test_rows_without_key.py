"""Null ids and ids on several rows."""

from collections import Counter

from pyspark.sql import functions as F

from dwellrank.llm import blocks, language_model

from .conftest import sha

LONG = "s" * 4096  # the first block of several texts
ROWS = [
    (None, "no id", None), (None, "nor this", None), (None, "n o id", None), (1, LONG + "a", None), (1, LONG + "b", None), (2, LONG + "a", None),
    (2, LONG + "b", None), (3, "one", None), (3, "one", None), (3, "other", None), (4, "no\tid", None), (5, None, None), (None, " ", None),
]


def test_exact_groups_of_rows(documents):
    bodies = ["".join((t or "").split()) for _, t, _ in ROWS]
    sizes, best = Counter(bodies), {}
    for (i, t, _), body in zip(ROWS, bodies):
        best[body] = min(best.get(body, (1, True, 0)), (-len(t or ""), i is None, i))
    expected = Counter((i, best[b][2], sizes[b], None if i is None or best[b][2] is None else i == best[b][2], sha(b)) for (i, _, _), b in zip(ROWS, bodies))
    got = blocks.exact_groups(documents(ROWS))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()) == expected
    docs = documents(ROWS)
    kept = blocks.kept_documents(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert Counter("".join((r["text"] or "").split()) for r in kept) == Counter(set(bodies))
    for r in kept:
        assert (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]) == best["".join((r["text"] or "").split())]


def test_near_duplicates_keep_documents_without_id(spark, documents):
    import corpus_pipeline

    near = [(1, "a b c d e f g", None), (2, "a b c d e f g", None), (None, "h i j k l m", None), (None, "n o p q r s", None)]
    assert sorted(r["text"][0] for r in corpus_pipeline.near_dedup(spark, documents(near), "").collect()) == ["a", "h", "n"]


def test_language_model_scores_documents_without_id(documents):
    got = language_model.score_texts(documents(ROWS), F.col("doc_id") == 1).collect()
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((i, i == 1) for i, _, _ in ROWS)
    words = sum(len((t or "").split()) + 1 for i, t, _ in ROWS if i != 1)
    assert {r["train_tokens"] for r in got} == {words}


def test_held_out_texts_teach_nothing(documents):
    """Other held-out texts of the same length change no score of a training document."""
    import random

    from pyspark.sql import functions as F

    from dwellrank.llm import language_model

    draw = random.Random(6)
    words = [f"w{k:03d}" for k in range(300)]
    rows = [(k, " ".join(draw.choice(words) for _ in range(40)), "s") for k in range(80)]
    other = [(k, " ".join(f"x{draw.randrange(1000):03d}" for _ in range(40)) if k % 5 == 0 else t, s) for k, t, s in rows]
    held = F.col("doc_id") % 5 == 0
    first, second = ({r["doc_id"]: r["score"] for r in language_model.score_texts(documents(x), held).collect()} for x in (rows, other))
    assert all(abs(first[k] - second[k]) < 1e-9 for k in first if k % 5)
    assert any(abs(first[k] - second[k]) > 1 for k in first if k % 5 == 0)
