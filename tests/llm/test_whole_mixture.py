"""The mixture of all documents."""

from collections import Counter

from dwellrank.llm import mixing


def test_every_document_is_mixed(documents):
    """A large source, a source of three documents, null ids and an id on two rows: the short source ends neither the others nor any row."""
    rows = [(k, f"text {k}", "large") for k in range(400)] + [(1000 + k, f"other {k}", "other") for k in range(100)]
    rows += [(2000, "x", "tiny"), (2001, "y", None), (None, "no id", "other"), (None, "nor here", "other"), (7, "a second row of 7", "large")]
    docs = documents(rows)
    got = mixing.mixture(docs, every=True)
    assert got.schema == docs.schema
    found = [(r["doc_id"], r["text"], r["source"]) for r in got.collect()]
    assert Counter(found) == Counter(rows)
    assert len(mixing.mixture(docs).collect()) < len(rows)  # what the shortest source allows
    first = [s for _, _, s in found if s in ("large", "other")][:150]
    assert abs(first.count("large") - 2 * first.count("other")) <= 3 * mixing.BLOCK_ROWS  # square roots of 401 and 102
    assert mixing.mixture(docs.where("false"), every=True).collect() == []


def test_stage_keeps_every_document(spark, documents):
    import corpus_pipeline

    docs = documents([(k, f"text {k}", "large" if k else "tiny") for k in range(600)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.mix(spark, docs, "").collect()) == list(range(600))
