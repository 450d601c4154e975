"""Tokenizers, classifier, mixing, archives, page text and language model against other means."""

import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import public_tokenizers
from dwellrank.llm import bpe, classifier, language_model, mixing, transducer, warc, wrappers

from .conftest import ODD_TEXTS, sha, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def table():
    with open(PATH, "rb") as f:
        return bpe.vocabulary(f.read())


@pytest.fixture(scope="module")
def many_texts():
    draw = random.Random(8)
    letters = [*map(chr, range(32, 127)), "\n", "\t", "  ", "\x85", "\xa0", "'s", "'ll", " '", "'re", "é", "ß", "日", "\U0001f600", "‍", "²", "<|endoftext|>", "\x1c", "th", "er", "ing", " the"]
    return [t or "" for t in ODD_TEXTS] + ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(1500)]


def test_encoding_is_the_librarys(spark, documents, library, many_texts):
    docs = documents([(k, t, None) for k, t in enumerate(many_texts)])
    for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect():
        ids = library.encode(many_texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False) and r["decoded_sha256"] == sha(r["decoded"])


def test_verification_finds_exactly_the_wrong_proposals(table, many_texts):
    encoder = bpe.Encoder(table, public_tokenizers.PATTERN)
    found = {w.encode() for t in many_texts for w in encoder.pieces(t) if w not in table.special}
    wrong = 0
    for w in found:
        proposal, exact = np.array(table.proposed(w)), table.merged(w)
        good = bool(table.compatible(proposal[:-1], proposal[1:]).all())
        assert good == (proposal.tolist() == exact)
        wrong += not good
    assert 0 < wrong < len(found)


def test_known_words_are_not_encoded_again(table, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    encoder = bpe.Encoder(table, public_tokenizers.PATTERN)
    first = encoder.encode(["one two three four", ""])
    assert encoder.encode(["one two three four", ""]) == first and encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_long_words_merge_alike(table):
    for w in (b"ab" * 90, b"aaaaabc" * 25, b"the there then" * 12):
        parts = [table.ids[w[i : i + 1]] for i in range(len(w))]
        assert table._merged_long(parts) == table.merged(w)


def test_token_counts_are_the_librarys(documents, library, many_texts):
    docs = documents([(k, t, None) for k, t in enumerate(many_texts)])
    got = {r["doc_id"]: tuple(r)[1:] for r in transducer.token_counts(docs, PATH, limit=20).collect()}
    for k, t in enumerate(many_texts):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got[k] == (len(t.encode()), n, n > 20), t


def test_state_maps_compose(many_texts):
    points = np.frombuffer("".join(many_texts).encode("utf-32-le"), np.uint32)
    firsts = np.unique(np.cumsum([0, *(len(t) for t in many_texts if t)])[:-1])
    symbol = transducer.symbols(points, firsts)
    state, start = transducer.word_machine()
    now, expected = transducer.FREE, []
    for k, s in enumerate(symbol.tolist()):
        if start[s, now]:
            expected.append(k)
        now = state[s, now]
    assert transducer.word_starts(symbol).tolist() == expected


def test_machine_starts_anew(table, library, many_texts, monkeypatch):
    monkeypatch.setattr(transducer, "MOST_STATES", 30)
    machine = transducer.TokenMachine(table)
    for at in range(0, 600, 100):
        part = many_texts[at : at + 100]
        assert transducer.count_tokens(machine, pa.array(part))[1].tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in part]


def test_empty_tables(documents):
    none = documents([])
    assert bpe.encode(none, PATH, public_tokenizers.PATTERN).collect() == []
    assert transducer.token_counts(none, PATH).collect() == []
    assert mixing.mixed_order(none).collect() == []
    assert language_model.score_texts(none, F.lit(False)).collect() == []


def labelled(n):
    draw = random.Random(1)
    rows = []
    for k in range(n):
        good = k % 3 > 0
        text = " ".join(draw.choice(["Time", "flies", "like", "an", "arrow,", "fruit"]) if good else draw.choice(["BUY!!", "NOW!!", "CHEAP$$", "like"]) for _ in range(draw.randrange(3, 60)))
        rows.append((k, text, int(good)))
    return rows


def test_classifier(spark, documents):
    rows = labelled(300)
    docs = documents([(k, t, None) for k, t, _ in rows] + [(900 + k, t, None) for k, t in enumerate(ODD_TEXTS)])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < 200] + [(1, None), (2, 7), (10**6, 1), (5, 1)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, sample_rows=120)
    got = {r["doc_id"]: r for r in classifier.score(docs, model).collect()}
    assert len(got) == 300 + len(ODD_TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert np.mean([got[k]["predicted"] == y for k, _, y in rows if k >= 200]) > 0.97
    kept = docs.mapInArrow(classifier.accepting(spark, model, docs.columns.index("text")), docs.schema).collect()
    assert {r["doc_id"] for r in kept} == {k for k, r in got.items() if r["predicted"]}


def test_classifier_without_two_classes(spark, documents):
    docs = documents([(1, "a", None), (2, None, None)])
    for labels, score in (([], 0.5), ([(1, 1)], 1), ([(1, 0)], 0)):
        model = classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert all(abs(r["score"] - score) < 1e-5 for r in classifier.score(docs, model).collect())


def test_dual_descent_reaches_the_primal_optimum():
    draw = np.random.default_rng(0)
    rows = [np.sort(draw.choice(30, 6, replace=False)).astype(np.int32) for _ in range(80)]
    y = np.array([int(r[0] < 4) for r in rows])
    scale = draw.normal(0, 1, 30)
    w = classifier.hinge_by_dual_descent(rows, scale, y, cost=0.5, rounds=400)

    def loss(w):
        margins = np.array([classifier._unit(scale[r]) @ w[r] for r in rows]) + w[-1]
        return w @ w / 2 + 0.5 * np.maximum(0, 1 - np.where(y == 1, 1, -1) * margins).sum()

    best = loss(w)
    assert all(best <= loss(w + draw.normal(0, 0.01, 31)) + 1e-9 for _ in range(200))


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 0.02}, {str(k): 1 + k % 7 for k in range(40)}])
def test_schedule_deviates_by_less_than_a_block(weights):
    exact = mixing.rounded_weights(weights, 512)
    assert sum(exact.values()) == 1
    got = Counter()
    for t, (s, k, release, deadline) in enumerate(mixing.schedule(exact, 1024)):
        got[s] += 1
        assert got[s] == k and release <= t < deadline
        assert all(abs(got[x] - w * (t + 1)) < 1 for x, w in exact.items())
    assert all(got[s] == 2 * 512 * w for s, w in exact.items()) and exact[max(weights, key=weights.get)] >= Fraction(1, 512)


def test_mixed_order(documents):
    rows = [(k, "t", ["a", "b", None, "-", ""][min(k % 7, 4)]) for k in range(500)]
    docs = documents(rows)
    got = mixing.mixed_order(docs, {"a": 0.5, "b": 0.25}, block_rows=4, period=64).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(500)) and len({r["position"] for r in got}) == 500
    assert all(dict((k, s) for k, _, s in rows)[r["doc_id"]] == r["source"] for r in got)
    share = {f"+{s}" if s is not None else "-": {"a": 0.5, "b": 0.25}.get(s, n**0.5) for s, n in Counter(s for _, _, s in rows).items()}
    plan = mixing.schedule(mixing.rounded_weights(share, 64), 64 * 20)
    slots = {(s, k): t for t, (s, k, _, _) in enumerate(plan)}
    sizes = Counter(r["source"] for r in got)
    horizon = min(slots[f"+{s}" if s is not None else "-", -(-n // 4) + 1] for s, n in sizes.items())
    for r in got:
        assert r["slot"] == slots[f"+{r['source']}" if r["source"] is not None else "-", r["block"]] and r["in_mix"] == (r["slot"] < horizon)
    chosen = mixing.mixture(docs, {"a": 0.5, "b": 0.25})
    assert chosen.columns == docs.columns and chosen.count() == len({r["doc_id"] for r in mixing.mixed_order(docs, {"a": 0.5, "b": 0.25}).collect() if r["in_mix"]})


def test_weights_are_checked():
    with pytest.raises(ValueError):
        mixing.rounded_weights({"a": 0.0, "b": 1})
    with pytest.raises(ValueError):
        mixing.rounded_weights({str(k): 1 for k in range(9)}, 8)


def test_archives(spark, tmp_path):
    page = "<p>" + "same words " * 20 + "</p>"
    rows = [(7, "http://x/1", page), (3, "http://x/2", page), (9, None, page), (1, "http://x/\r\n é", "short"), (2, "http://x/3", "short"), (4, "u", None), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 40)]
    rows += [(100 + k, f"http://y/{k}", f"<html><body>{'text %d ' % k * 30}</body></html>") for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as size", "2 as first", "'x' as digest").repartition(2)
    path = str(tmp_path / "archives")
    warc.write_archives(df, path)
    got = {r["page_id"]: r for r in warc.read_archives(spark, path, with_payload=True).collect()}
    assert got.keys() == {r[0] for r in rows}
    for k, _, html in rows:
        html = html or ""
        again = html == page and k != 3
        r = got[k]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(html.encode()), sha(html), "revisit" if again else "response", 3 if again else None)
        assert r["html"] == (None if again else html)
    files = [f for f in (tmp_path / "archives").iterdir() if f.name.startswith("part-") and f.stat().st_size]
    assert files and all(int.from_bytes(f.read_bytes()[:4], "little") == warc.DICTIONARY_FRAME for f in files)
    raw = files[0].read_bytes()
    size = int.from_bytes(raw[4:8], "little")
    assert zstandard.decompress(raw[8 : 8 + size])[:4] == b"\x37\xa4\x30\xec"  # the magic number of a dictionary


def test_archives_of_nothing(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(ValueError):
        list(warc.records(b"no archive at all"))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></ul></nav>
<header>Site</header><div class="ad">buy</div><!-- c --><article><header><h1>Head {k} &amp; more</h1></header><p><b>One {k}<br>two<p>Three  <a href="q">link</a>
four &eacute;&#33;<ul><li>a<li>b</ul><form>mail <input></form><div class="post-comments"><p>nice!</p></div></article><aside>side</aside><footer>&copy; x</footer></body></html>"""
PLAIN = """<html><body class="has-sidebar"><div id="top"><a href=x>Home</a> <a href=y>News</a></div><div class="content"><h1>Title {k}</h1><p>One {k}<p>Two {k}</div>
<div class="text">Always the same line.</div><div class="cookie-notice">We use cookies</div><script>var a="</p><p>no"</script></body>"""


def test_page_text(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(k=k)) for k in range(5)] + [(10 + k, f"https://B.example:80/{k}", PLAIN.format(k=k)) for k in range(5)]
    odd = ["", None, "plain &lt;b&gt;", "<p", "<script>never closed", "<!-- never", "<div>" * 3000 + "deep", "<article></article>", "<p>x</p>" * 2000]
    rows += [(20 + k, None if k % 2 else "no url", t) for k, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'h' as host", "'r' as root").repartition(4)
    got = {r["page_id"]: r for r in wrappers.extract(df).collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) and r["url"] == dict((a, b) for a, b, _ in rows)[k] for k, r in got.items())
    for k in range(5):
        assert got[k]["text"] == f"Head {k} & more\nOne {k} two\nThree link four é!\na\nb"
        assert got[10 + k]["text"] == f"Title {k}\nOne {k}\nTwo {k}"
    assert [got[20 + k]["text"] for k in range(8)] == ["", "", "plain <b>", "<p", "", "", "deep", ""] and got[28]["text"].count("x") == 2000
    assert wrappers.extract(df.where("false")).collect() == []


def test_wrappers_merge_in_any_order():
    pages = [PAGE.format(k=k) for k in range(4)] + [PLAIN.format(k=k) for k in range(3)]

    def merged(order, cut):
        parts = []
        for chunk in (order[:cut], order[cut:]):
            w = wrappers.Wrapper()
            for k in chunk:
                w.align(pages[k])
            parts.append(w)
        parts[0].merge(wrappers.Wrapper.loads(parts[1].dumps()))
        return parts[0].dumps()

    assert len({merged(o, c) for o, c in (([0, 1, 2, 3, 4, 5, 6], 3), ([6, 2, 4, 0, 5, 1, 3], 1), ([3, 1, 5, 0, 4, 2, 6], 7))}) == 1
    w = wrappers.Wrapper()
    for p in pages[:4]:
        w.align(p)
    shown = w.expression()
    assert "(<li>#SAME)+" in shown or "(<li>#TEXT)+" in shown and "<h1>#TEXT" in shown


def test_language_model(documents, near_texts):
    rows = [(k, t, None) for k, t in enumerate([*ODD_TEXTS, *near_texts])]
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 0
    got = {r["doc_id"]: r for r in language_model.score_texts(documents(rows), held).collect()}
    tokens = {k: [*words(t), None] for k, t, _ in rows}
    counts = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 4 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    assert got.keys() == tokens.keys()
    for k, ws in tokens.items():
        r = got[k]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and -1e9 < r["score"] < 0 and r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 0)
        assert math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / max(1, len((rows[k][1] or "").encode())))
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_spelling_is_a_distribution():
    """Over all words of one and two bytes and what they may go on to, probabilities sum to one at most, and a trained word is likelier than noise."""
    seen = np.zeros((2, int(language_model.TABLES[-1])), np.uint32)
    letters, n = np.frombuffer(b"thethentheretthe", np.uint8), np.array([3, 4, 5, 1, 3])
    for _, _, symbols, contexts in language_model._portions(letters, n, np.arange(5)):
        for _, node, bit in language_model._bits(symbols):
            for slot in language_model._slots(contexts, node):
                for b in (0, 1):
                    np.add.at(seen[b], slot[bit == b], 1)
    weights = np.full((language_model.GATES, len(language_model.ORDERS)), 0.3)
    middle = np.tile(language_model._squash(np.arange(language_model.BUCKETS) / 2 - 8), (language_model.GATES, 1))
    model = (language_model._stretch(seen[0].astype(float), seen[1].astype(float)).astype(np.float32), seen.sum(0) > 0, weights, middle)
    spaces = [b for b in range(256) if b != 0x20]
    ones = np.array(spaces, np.uint8)
    short = np.exp2(language_model._spelled(ones, np.ones(255, np.int64), *model)).sum()
    twos = np.array([[97, b] for b in spaces], np.uint8).ravel()
    pairs = np.exp2(language_model._spelled(twos, np.full(255, 2), *model)).sum()
    assert 0 < short + pairs <= 1
    known, noise = language_model._spelled(np.frombuffer(b"thereqzxvj", np.uint8), np.array([5, 5]), *model)
    assert known > noise + 10


def test_model_without_training_documents(documents):
    got = language_model.score_texts(documents([(1, "a b", None), (2, None, None)]), F.lit(True)).collect()
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got) and len(got) == 2
