"""Zipped CSV and NPZ files as data sources."""

import csv
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellrank import schemas
from dwellrank.sources import gaze as GS, npz, stores, zipped


def archive(path, **files):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, rows in files.items():
            text = io.StringIO()
            csv.writer(text).writerows(rows)
            out.writestr(f"{name}.csv", text.getvalue())
        out.writestr("__MACOSX/x.csv", "junk")


HEADER = ["participant_id", "IA_LABEL", "note"]


def rows_of(df):
    return sorted((r["src_ordinal"]["file"].rsplit("/", 2)[-2:], r["src_ordinal"]["row"], r["participant_id"], r["IA_LABEL"]) for r in df.collect())


def test_members_of_archives(spark, tmp_path, monkeypatch):
    """Each member is a partition, rows are numbered within it, blocks of few bytes change nothing; quotes, line ends, empty and "n/a" values stay apart."""
    odd = [["p1", 'a "quoted", word', "x"], ["p2", "two\nlines", ""], ["", "n/a", "z"]]
    archive(tmp_path / "a.zip", one=[HEADER, *odd], two=[HEADER, *[[f"q{k}", f"w{k}", "n"] for k in range(3000)]])
    archive(tmp_path / "b.zip", three=[HEADER])
    monkeypatch.setattr(zipped, "BLOCK_BYTES", 2000)
    df = GS.read_interest_areas(spark, f"{tmp_path}/*.zip", ["participant_id", "IA_LABEL"])
    assert df.columns == ["participant_id", "IA_LABEL", "src_ordinal"]
    got = rows_of(df)
    assert [(p, w) for f, _, p, w in got if f == ["a.zip", "one.csv"]] == [("p1", 'a "quoted", word'), ("p2", "two\nlines"), (None, "n/a")]
    assert [(n, w) for f, n, _, w in got if f == ["a.zip", "two.csv"]] == [(k, f"w{k}") for k in range(3000)]
    assert len(got) == 3003
    assert df.rdd.getNumPartitions() == 3


def test_archives_with_other_columns(spark, tmp_path):
    archive(tmp_path / "a.zip", one=[HEADER, ["p", "w", "n"]])
    archive(tmp_path / "b.zip", one=[HEADER[::-1], ["n", "w", "p"]])
    with pytest.raises(Exception, match="other columns"):
        GS.read_interest_areas(spark, f"{tmp_path}/*.zip").collect()
    with pytest.raises(FileNotFoundError):
        GS.read_interest_areas(spark, f"{tmp_path}/none.zip")
    with pytest.raises(ValueError, match="not in the file"):
        GS.read_interest_areas(spark, f"{tmp_path}/a.zip", ["absent"])


def test_zip_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"p{k}", f'w "{k}"\n', k if k % 3 else None) for k in range(500)], "participant_id string, IA_LABEL string, n int").repartition(3)
    GS.write_zipped_csv(df, str(tmp_path / "out"))
    back = GS.read_interest_areas(spark, f"{tmp_path}/out/*.zip")
    assert sorted((r["participant_id"], r["IA_LABEL"], r["n"] or "") for r in back.collect()) == sorted((r["participant_id"], r["IA_LABEL"], str(r["n"] or "")) for r in df.collect())
    GS.write_zipped_csv(df.limit(1), str(tmp_path / "out"))
    assert GS.read_interest_areas(spark, f"{tmp_path}/out/*.zip").count() == 1
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()]


def embeddings(spark, n):
    rows = [(f"e::text::none::c{i}", "e", None, "text", f"c{i}", "p", f'té"xt {i}', 0, 1, [0, i], [float(i), 0.5]) for i in range(n)]
    return spark.createDataFrame(rows, schemas.EMBEDDING_DDL)


def test_failed_task_leaves_no_file(spark, tmp_path):
    df = embeddings(spark, 40).repartition(4).withColumn("vec", F.when(F.col("chunk_id") == "c7", F.raise_error(F.lit("lost")).cast("array<float>")).otherwise(F.col("vec")))
    with pytest.raises(Exception, match="lost"):
        npz.write_npz(df, str(tmp_path / "out"), "embedding_id", "vec", "ids", "embeddings")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    with pytest.raises(ValueError, match="no vectors"):
        npz.write_npz(embeddings(spark, 3).where("false"), str(tmp_path / "none"), "embedding_id", "vec", "ids", "embeddings")


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_row_ranges(spark, tmp_path, monkeypatch, save):
    """A stored matrix is read in ranges of rows, a compressed one in one; slices of few rows change nothing."""
    monkeypatch.setattr(npz, "RANGE_BYTES", 160)
    monkeypatch.setattr(npz, "SLICE_BYTES", 40)
    n = 77
    records = [{"example_id": "e", "chunk_id": f"c{i}", "text": "ü" * i, "token_indices": [i], "char_start": i, "note": None} for i in range(n)]
    save(tmp_path / "a.npz", ids=np.array([f"i{i}" for i in range(n)]), embeddings=np.arange(2.0 * n).reshape(n, 2), records_json=np.array(json.dumps(records, ensure_ascii=False)))
    df = npz.read_embedding_npz(spark, str(tmp_path / "a.npz"))
    got = sorted((r["char_start"], r["embedding_id"], r["chunk_id"], r["text"], tuple(r["vec"]), r["token_indices"]) for r in df.collect())
    assert got == [(i, f"i{i}", f"c{i}", "ü" * i, (2.0 * i, 2.0 * i + 1), [i]) for i in range(n)]
    assert df.rdd.getNumPartitions() == (-(-n // 10) if save is np.savez else 1)


def test_refused_files(spark, tmp_path):
    ok = np.array('[{"chunk_id": "c"}]')
    np.savez(tmp_path / "objects.npz", ids=np.array(["a"], object), embeddings=np.zeros((1, 2)), records_json=ok)
    np.savez(tmp_path / "many.npz", ids=np.array(["a"]), embeddings=np.zeros((1, 2)), records_json=np.array("[{}, {}]"))
    np.savez(tmp_path / "few.npz", ids=np.array(["a", "b"]), embeddings=np.zeros((2, 2)), records_json=ok)
    for name, why in (("objects", "pickled"), ("many", "inconsistent lengths"), ("few", "inconsistent lengths")):
        with pytest.raises(Exception, match=why):
            npz.read_embedding_npz(spark, str(tmp_path / f"{name}.npz")).collect()


def test_pieces_of_a_list():
    text = json.dumps([{"a": "x, ]} \\\" é", "b": [1, {"c": None}]}, {}, {"d": 1.5}], ensure_ascii=False)
    for step in (1, 2, 5, 1000):
        assert list(npz.objects(text[k : k + step] for k in range(0, len(text), step))) == json.loads(text)
    assert list(npz.objects(iter(["[", "]"]))) == []
    for bad in ("", "{}", "[{}", '[{"a": }]'):
        with pytest.raises(ValueError, match="JSON list"):
            list(npz.objects(iter([bad])))


def test_paths():
    assert stores.opened("/a/b")[1] == "/a/b" and stores.opened("file:/a/b")[1] == "/a/b" and stores.opened("file:///a/b")[1] == "/a/b"


# --- nested lines


def records(n_questions, readers, words):
    for q in range(n_questions):
        yield (f"q{q}", None, json.dumps({"example_id": f"q{q}", "question": "What?\n\"é\"", "choices": ["a", "b"], "answer_index": q}, ensure_ascii=False))
        for r in range(readers):
            for w in range(words):
                yield (f"q{q}", f'r "{r:05d}"', json.dumps({"reader_id": f"r{r}", "paragraph_id": "p", "word_index": w, "word": f"wörd{w}", "trt": w / 4, "fixation_count": None, "skip": 1.0}, ensure_ascii=False))


def batches(rows, size):
    import itertools

    import pyarrow as pa

    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part)], ["example_id", "reader_id", "json"])


def written_lines(tmp_path, rows, size=1000):
    from dwellrank.sources.nested import AlignedWriter

    file = tmp_path / "a.json"
    n = AlignedWriter(str(tmp_path), True).files(batches(rows, size), lambda: open(file, "wb"))
    return file, n


def test_lines_are_json(tmp_path):
    rows = [("q9", None, "{}"), *records(3, 2, 3), ("lost", "r", '{"word": "no question"}'), ("q3", None, "{}")]
    file, n = written_lines(tmp_path, rows, 2)
    lines = [json.loads(line) for line in file.read_text().splitlines()]
    assert n == 3 and [line["qa"]["example_id"] for line in lines] == ["q0", "q1", "q2"]
    assert all(list(line["reader_gaze"]) == ['r "00000"', 'r "00001"'] and [[r["word_index"] for r in v] for v in line["reader_gaze"].values()] == [[0, 1, 2]] * 2 for line in lines)


@pytest.mark.parametrize(("split", "piece"), [(1 << 26, 1 << 18), (97, 7), (1000, 1), (3, 50)])
def test_splits_of_nested_lines(spark, tmp_path, monkeypatch, split, piece):
    """Every line is read once, wherever splits and pieces cut it."""
    from dwellrank.sources import nested

    file, _ = written_lines(tmp_path, records(12, 2, 3))
    monkeypatch.setattr(nested, "SPLIT_BYTES", split)
    monkeypatch.setattr(nested, "PIECE_BYTES", piece)
    for part, ddl, wanted in (("questions", schemas.QA_DDL, 12), ("words", nested.WORDS_DDL, 72)):
        from pyspark.sql.types import StructType, _parse_datatype_string

        reader = nested.AlignedReader(str(tmp_path), part, StructType.fromDDL(ddl) if hasattr(StructType, "fromDDL") else _parse_datatype_string(ddl))
        got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert len(got) == wanted
        assert sorted({r["example_id"] for r in got}) == sorted(f"q{k}" for k in range(12))


def test_a_question_with_a_million_records(tmp_path):
    """Written and read in streams: the memory does not grow with the question."""
    import resource

    from pyspark.sql.types import StructType

    from dwellrank.sources import nested

    peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
    written_lines(tmp_path, records(1, 2, 500))
    before = peak()
    file, n = written_lines(tmp_path, records(1, 1000, 1000), 10_000)
    assert n == 1 and file.stat().st_size > 100 << 20
    reader = nested.AlignedReader(str(tmp_path), "words", StructType.fromDDL(nested.WORDS_DDL))
    count, last = 0, None
    for p in reader.partitions():
        for b in reader.read(p):
            count, last = count + b.num_rows, b
    assert count == 1_000_000 and last.to_pylist()[-1]["word_index"] == 999
    assert peak() - before < 100


def test_nested_round_trip(spark, tmp_path):
    from dwellrank.operators import align
    from dwellrank.plans import workload as D
    from dwellrank.sources.nested import read_aligned_lines, write_aligned

    qa = D.alignment_questions(spark, "/root/testdata/sf0.001").limit(20)
    words = spark.createDataFrame([(f"q{k % 25}", f"r{k % 3}", "p", k % 7, f"w{k}", float("nan") if k == 5 else k / 8, None, 0.0, k) for k in range(300)],
                                  "example_id string, reader_id string, paragraph_id string, word_index int, word string, trt double, fixation_count double, skip double, src_ordinal bigint")
    write_aligned(qa, words, str(tmp_path / "out"))
    questions, back = read_aligned_lines(spark, str(tmp_path / "out"))
    nested = {r["qa"]["example_id"]: r for r in align.nest_aligned(qa, words).collect()}
    assert {r["example_id"]: r["metadata"] for r in questions.collect()} == {k: r["qa"]["metadata"] for k, r in nested.items()}
    expected = sorted((k, reader, n, r["word"], None if r["trt"] != r["trt"] else r["trt"]) for k, row in nested.items() for reader, rs in row["reader_gaze"].items() for n, r in enumerate(rs))
    assert sorted((r["example_id"], r["reader_id"], r["src_ordinal"], r["word"], r["trt"]) for r in back.collect()) == expected


# --- rows with columns of their own


def test_header_is_the_union_of_keys(spark, tmp_path):
    from dwellrank.sources import writers as OUT

    rows = [(1, {"b": "x,\"y\"", "a": None}), (2, {}), (3, None), (4, {"z z": "line\nend", "N": ""})]
    df = spark.createDataFrame(rows, "m_id int, m map<string,string>").repartition(2)
    names = OUT.write_mapping_csv(df, str(tmp_path / "out"), "m", ("m_id",))
    assert names == ["N", "a", "b", "m_id", "z z"]
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    got = [r for p in files for r in csv.DictReader(io.StringIO(p.read_text()))]
    assert all(list(r) == names for r in got)
    assert sorted((r["m_id"], r["b"], r["z z"]) for r in got) == [("1", 'x,"y"', ""), ("2", "", ""), ("3", "", ""), ("4", "", "line\nend")]
    assert OUT.write_mapping_csv(df.where("false"), str(tmp_path / "none"), "m", ("m_id",)) == ["m_id"]
    with pytest.raises(ValueError, match="but for case"):
        OUT.write_mapping_csv(df, str(tmp_path / "clash"), "m", ("m_id", "B"))
