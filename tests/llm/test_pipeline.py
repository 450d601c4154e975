"""The pipeline against its stages by hand, and the queries' contracts."""

import random
from collections import Counter

import pytest

import corpus_pipeline
import public_tokenizers
from dwellrank.llm import mixing

from .test_dedup import components_by_hand, exact_by_hand


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: good texts with exact and near copies, junk, three sources of unequal size."""
    draw = random.Random(11)
    rows = []
    for k in range(120):
        if k % 6 == 0:
            text = " ".join([draw.choice(["BUY!!", "NOW!!", "CHEAP!!"]) for _ in range(40)])
        else:
            text = " ".join(draw.choice(["time", "flies", "like", "an", "arrow,", "fruit", "Over", "there."]) + str(draw.randrange(60)) for _ in range(60))
        rows.append(text)
    good = [t for k, t in enumerate(rows) if k % 6]
    rows += [good[0], good[1] + "\n", " ".join(good[2].split()[:-1] + ["other"]), " ".join(good[3].split()[:-1] + ["words"]), good[0]]
    sources = ["a"] * 80 + ["b"] * 25 + [None] * 20
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(k, t, "en", s, len(t)) for k, (t, s) in enumerate(zip(rows, sources))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 > 0), 0) for k in range(0, 100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    path, docs = folder
    kept = {d[0]: d for d in docs if not d[1].startswith(("BUY", "NOW", "CHEAP"))}
    stays = exact_by_hand([(k, d[1]) for k, d in kept.items()])
    kept = {k: d for k, d in kept.items() if stays[k][2]}
    near = components_by_hand([(k, d[1]) for k, d in kept.items()], 5, 80)
    kept = {k: d for k, d in kept.items() if near[k][1] == k}
    rows = corpus_pipeline.run(spark, path).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(kept)  # the mixture drops nobody
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r["n_tokens"] == len(library.encode(kept[r["doc_id"]][1], add_special_tokens=False).ids) for r in rows)


def test_mixture_of_the_stage(spark, folder):
    """Up to the first source without a full block, each source has had its share of the blocks to within less than one."""
    path, docs = folder
    size = mixing.BLOCK_ROWS
    mixed = [r["source"] for r in corpus_pipeline.mix(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()]
    assert Counter(mixed) == Counter(d[3] for d in docs)
    named = [f"+{s}" if s else "-" for s in mixed]
    weights = mixing.rounded_weights({s: n**0.5 for s, n in Counter(named).items()})
    full = {s: n // size for s, n in Counter(named).items()}
    seen, slots = Counter(), 0
    while all(seen[s] < full[s] for s in full):
        block = named[slots * size : slots * size + size]
        assert len(set(block)) == 1
        seen[block[0]] += 1
        slots += 1
        assert all(abs(seen[s] - weights[s] * slots) < 1 for s in weights)
    assert slots > 3


def test_stages_keep_the_columns(spark, folder, tmp_path):
    path, docs = folder
    df = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "tokenize"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, path)
        assert out.columns == df.columns
        assert {tuple(r) for r in out.collect()} <= set(docs)
