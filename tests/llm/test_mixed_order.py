"""What the mixture's order does to the tokens that follow it."""

import corpus_pipeline


def test_tokens_begin_in_the_order_of_the_mixture(spark, documents, tmp_path):
    docs = documents([(k, f"text number {k} " * (k % 5), "large" if k % 7 else "small") for k in range(300)] + [(None, "no id", "small"), (3, "again 3", "large")])
    starts = []
    for name, mixed in (("mixed", corpus_pipeline.mix(spark, docs, "")), ("as it came", docs.coalesce(1).sortWithinPartitions("doc_id"))):
        mixed.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        rows = corpus_pipeline.tokenize(spark, kept, "").collect()
        assert len(rows) == 302
        spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        starts.append({r["doc_id"]: r["start"] for r in rows if r["doc_id"] not in (None, 3)})
    assert starts[0] != starts[1]
    order = [r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/as it came").collect() if r["doc_id"] in starts[1]]
    assert [starts[1][k] for k in order] == sorted(starts[1].values())
