"""Text operators against plain Python on awkward and generated texts."""

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from dwellrank.functions import text as T
from dwellrank.functions.arrays import running_totals

AWKWARD = [
    '  lead "Hi." Then!? x', "a\u00a0b\x1cc. d\u3000e", "Head line\nPi is 3.14. ok\n", "", "   ", "No punct at all\n",
    "a?!x. b.\n\n", "One sentence. Second sentence!", "(Really?) 'Yes.' [No!]", "...", "x" * 300, "\u2003tab\tnew\nline ",
    "Mr. A! " * 40, "\U0001f600 emoji. \U0001f600\U0001f600 two",
]


def in_order(text, spans):
    """Spans are slices of their text, in order and apart."""
    assert all(text[a:b] == t for a, b, t in spans)
    edges = [x for a, b, _ in spans for x in (a, b)]
    assert edges == sorted(edges) and all(a < b for a, b, _ in spans)


def are_words(text, spans):
    in_order(text, spans)
    assert [t for _, _, t in spans] == text.split()


def are_sentences(text, spans):
    """Nothing but blanks lies between; each ends where closing marks meet a blank or the end, and at no earlier such place."""
    in_order(text, spans)
    assert "".join("".join(t.split()) for _, _, t in spans) == "".join(text.split())
    for k, (a, b, t) in enumerate(spans):
        closed = re.search(r"[.!?][.!?\"')\]]*\Z", t) and (b == len(text) or text[b].isspace())
        assert closed or (k == len(spans) - 1 and b == len(text))
        assert not re.search(r"[.!?][\"')\]]*\s", t)
        assert a == 0 or not t[0].isspace()


def windows_of(words, size, step):
    """Each window of words begins ``step`` after the one before; the first that reaches the last word is the last one."""
    count = 0 if not words else 1 + max(0, -(-(len(words) - size) // step))
    return [words[k * step : k * step + size] for k in range(count)]


def are_windows(size, stride):
    def check(text, spans):
        assert all(text[a:b] == t and t == t.strip() for a, b, t in spans)
        assert [t.split() for _, _, t in spans] == windows_of(text.split(), size, size - stride)

    return check


def context_pieces(text):
    """Words of what counts in a context: line parts that end in marks, and the last line's end; a final line end is no line."""
    lines, out = text.removesuffix("\n").split("\n"), []
    for n, line in enumerate(lines):
        parts = re.split(r"([.!?]+)", line)
        for body, mark in zip(parts[::2], [*parts[1::2], ""]):
            if body and (mark or n == len(lines) - 1):
                out.append((body + mark).split())
    return [p for p in out if p]


def are_context_chunks(size):
    def check(text, spans):
        in_order(text, spans)
        assert all(t == t.strip() for _, _, t in spans)
        expected = [p for piece in context_pieces(text) for p in windows_of(piece, size, size)]
        assert [t.split() for _, _, t in spans] == (expected or ([text.split()] if text.strip() else []))

    return check


def run(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", expression.alias("r"))
    return {r["i"]: [(x["start"], x["end"], x["text"]) for x in r["r"]] for r in rows.collect()}


CASES = [
    (lambda: T.word_spans(F.col("text")), are_words),
    (lambda: T.sentence_spans(F.col("text")), are_sentences),
    (lambda: T.word_windows(F.col("text"), 3, 1), are_windows(3, 1)),
    (lambda: T.word_windows(F.col("text"), 4), are_windows(4, 0)),
    (lambda: T.context_chunks(F.col("text"), 3), are_context_chunks(3)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_spans_of_awkward_texts(spark, case):
    expression, check = CASES[case]
    found = run(spark, AWKWARD, expression())
    for i, t in enumerate(AWKWARD):
        check(t, found[i])


def check_sentence_chunks(texts, chunks, sentences):
    """A sentence of at most two words is a chunk without outer blanks; a longer one is its windows of two words that share one."""
    for i, t in enumerate(texts):
        assert all(t[a:b].strip() == c for a, b, c in chunks[i])
        expected = [w for _, _, s in sentences[i] for w in ([s.split()] if len(s.split()) <= 2 else windows_of(s.split(), 2, 1))]
        assert [c.split() for _, _, c in chunks[i]] == expected


def test_sentence_chunks(spark):
    check_sentence_chunks(AWKWARD, run(spark, AWKWARD, T.paragraph_chunks(F.col("text"), "sentence", 2, 1)), run(spark, AWKWARD, T.sentence_spans(F.col("text"))))


EXPECTED = {
    '  lead "Hi." Then!? x': ['  lead "Hi."', "Then!?", "x"],
    "(Really?) 'Yes.' [No!]": ["(Really?)", "'Yes.'", "[No!]"],
    "Head line\nPi is 3.14. ok\n": ["Head line\nPi is 3.14.", "ok\n"],
    "...": ["..."], "   ": [], "": [], "a?!x. b.\n\n": ["a?!x.", "b."],
}


def test_expected_sentences(spark):
    found = run(spark, list(EXPECTED), T.sentence_spans(F.col("text")))
    assert [[t for _, _, t in found[i]] for i in range(len(EXPECTED))] == list(EXPECTED.values())


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .!?\n\t\"')\u00a0\u2009\x1f", max_size=40), min_size=30, max_size=60))
def test_generated_texts(spark, texts):
    for expression, check in (CASES[1], CASES[4]):
        found = run(spark, texts, expression())
        for i, t in enumerate(texts):
            check(t, found[i])
    check_sentence_chunks(texts, run(spark, texts, T.paragraph_chunks(F.col("text"), "sentence", 2, 1)), run(spark, texts, T.sentence_spans(F.col("text"))))


def test_whole_paragraph(spark):
    found = run(spark, ["  a b \n", " "], T.paragraph_chunks(F.col("text"), "whole_paragraph", 1))
    assert found == {0: [(2, 5, "a b")], 1: []}


def test_chunk_fixtures(spark):
    found = run(spark, ["One sentence. Second sentence!"], T.paragraph_chunks(F.col("text"), "sentence", 8))
    assert len(found[0]) == 2 and found[0][0][0] == 0
    found = run(spark, ["one two three four five"], T.paragraph_chunks(F.col("text"), "fixed_words", 3, 1))
    assert [c[2] for c in found[0]] == ["one two three", "three four five"]
    found = run(spark, ["one two three four five."], T.context_chunks(F.col("text"), 2))
    assert [c[2] for c in found[0]] == ["one two", "three four", "five."]
    found = run(spark, ["A header\nA sentence."], T.context_chunks(F.col("text")))
    assert [c[2] for c in found[0]] == ["A sentence."]


@pytest.mark.parametrize("arguments", [(0, 0), (3, 3), (3, -1)])
def test_window_arguments(spark, arguments):
    with pytest.raises(ValueError):
        T.word_windows(F.col("text"), *arguments)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        T.paragraph_chunks(F.col("text"), "lines", 3)


def test_running_totals(spark):
    for n in (0, 1, 15, 16, 17, 300):
        row = spark.range(1).select(running_totals(F.array(*[F.lit(i) for i in range(n)]) if n else F.array().cast("array<int>")).alias("r"))
        expected, total = [], 0
        for i in range(n):
            total += i
            expected.append(total)
        assert row.first()["r"] == expected


def test_normalisation(one):
    assert one(T.normalize_text(F.col("t")), t=" A\u00a0 b\n\x1cC ") == "a b c"
    levels = {"0": "adv", "1": "int", " 2 ": "ele", "Advanced": "adv", "INT": "int", "ele-x": "ele", "7": "7", "Other": "other", "00": "adv"}
    assert {k: one(T.normalize_level(F.col("t")), t=k) for k in levels} == levels
    assert one(T.normalize_level(F.lit(None).cast("string"))) == ""
    assert one(T.normalize_level(F.lit(True), "boolean")) == "1"
    assert one(T.normalize_level(F.lit(2))) == "ele"


def test_canonical_word(one):
    assert one(T.canonical_word(F.col("t")), t="“Hello,”") == "hello"
    assert one(T.canonical_word(F.col("t")), t="e–Bike!") == "e-bike"


def test_adjust_offsets(one):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(0, 0), (0, 7), (7, 12), (9, 14), (13, 40)]])
    got = one(T.adjust_offsets(spans, 9, F.lit(10)))
    assert [(o["start"], o["end"]) for o in got] == [(-1, -1), (-1, -1), (0, 3), (0, 5), (4, 10)]


def test_span_words(spark, one):
    spans = T.word_spans(F.lit("one two three"))
    got = one(T.span_words_to_chars(spans, F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(2))))
    assert [(s["start"], s["end"]) for s in got] == [(0, 7), (8, 13)]
    assert one(T.span_words_to_chars(spans, F.array().cast("array<int>"))) == []
    for bad in ([0], [0, 3], [2, 1]):
        with pytest.raises(Exception, match="span"):
            one(T.span_words_to_chars(spans, F.array(*[F.lit(i) for i in bad])))


def test_overlapping_tokens(spark):
    text = "Unlike mopeds, e-bicycles"
    tokens = [(0, 6), (7, 13), (13, 14), (15, 16), (16, 17), (17, 25)]
    array = lambda k: F.array(*[F.lit(t[k]) for t in tokens])
    spans = [(0, 6), (7, 14), (15, 25), (6, 7), (0, 25), (13, 40), (40, 50)]
    column = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans])
    got = spark.range(1).select(T.overlapping_tokens(column, array(0), array(1)).alias("r")).first()["r"]
    assert got == [[i for i, (a, b) in enumerate(tokens) if b > x and a < y] for x, y in spans] and len(text) == 25
