"""Model interfaces and the deterministic stand-ins that need no weights.

A real encoder, generator or reading-time model is plugged in as a loader that
every Python worker calls once; batches reach it through an Arrow iterator.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from dwellrank.functions.arrays import let
from dwellrank.functions.batches import PORTION, list_column, list_rows, listed, struct_column
from dwellrank.functions.prompts import parse_choice
from dwellrank.functions.reading import heuristic_words
from dwellrank.functions.scores import first_argmax
from dwellrank.functions.text import words
from dwellrank.functions.tiles import moved_offsets, overlap_rows

# Prefixes the passage/query encoder expects and default limits.
PASSAGE_PREFIX, QUERY_PREFIX = "passage: ", "query: "
PASSAGE_TOKENS, QUERY_TOKENS = 512, 128


class TokenEncoder(Protocol):
    """Loaded passage/query encoder."""

    def encode_passage(self, text: str, max_length: int) -> dict[str, Any]:
        """tokens, offsets of the prefixed text, hidden (tokens × dim)."""

    def encode_query(self, text: str, max_length: int) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """Token vectors (tokens × dim) with their mask, or the masked mean itself."""


class Generator(Protocol):
    """Loaded language model."""

    def generate(self, prompt: str, max_new_tokens: int, temperature: float) -> str: ...

    def token_log_probs(self, prefix: str, choice: str, max_length: int | None) -> list[float]: ...

    def token_ids(self, text: str, special: bool) -> list[int]:
        """Only for a budget: the tokens, with the model's own leading ones if ``special``."""

    def id_log_probs(self, prefix: list[int], choices: list[list[int]]) -> list[list[float]]:
        """Only for a budget: the log-probabilities of every choice's tokens after the prefix's."""


class ReadingTimeModel(Protocol):
    """Loaded word reading-time predictor: (words, rows of five features)."""

    def predict(self, text: str) -> tuple[list[str], np.ndarray]: ...


_loaded: dict[bytes, Any] = {}


def once_per_worker(loader: Callable[[], Any]) -> Any:
    """The loader's model, loaded at the first use in this Python worker."""
    key = hashlib.sha256(cloudpickle.dumps(loader)).digest()
    if key not in _loaded:
        _loaded[key] = loader()
    return _loaded[key]


def passage_encoding(loader: Callable[[], TokenEncoder], text: Column, max_length: int = PASSAGE_TOKENS) -> Column:
    """Token encoding of a passage by a plugged-in model (M1)."""

    @F.arrow_udf("struct<tokens:array<string>,offsets:array<struct<start:int,end:int>>,dim:int,hidden:array<float>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in encoded_portions(loader, ((texts,) for texts in batches), max_length):
            yield _encodings([encoding for _, encoding in rows])

    return encode(text)


def encoded_portions(loader: Callable[[], TokenEncoder], batches: Iterator[tuple[pa.Array, ...]], max_length: int) -> Iterator[list[tuple]]:
    """(text, encoding, what else its row has) of all texts, in portions of about PORTION items of vectors."""
    model = once_per_worker(loader)
    for texts, *lists in batches:
        rows, held = [], 0
        for t, *more in zip(texts, *map(list_rows, lists)):
            rows.append((t.as_py(), model.encode_passage(PASSAGE_PREFIX + t.as_py(), max_length), *more))
            held += rows[-1][1]["hidden"].size
            if held > PORTION:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows


TOKENS = "array<struct<start:int,end:int,text:string>>"


def passage_tokens(loader: Callable[[], TokenEncoder], text: Column, max_length: int = PASSAGE_TOKENS) -> Column:
    """The encoding's tokens as spans of the text without prefix."""

    @F.arrow_udf(TOKENS)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in encoded_portions(loader, ((texts,) for texts in batches), max_length):
            yield _tokens([(t, _inner(t, encoding)[0]) for t, encoding in rows])

    return tokens(text)


def passage_vectors(loader: Callable[[], TokenEncoder], text: Column, starts: Column, ends: Column, max_length: int = PASSAGE_TOKENS) -> Column:
    """The same tokens, the bytes of their float32 vectors, and for every span [start, end) the tokens that overlap it.

    All in one pass: vectors are far more than the text, and rows that wait for another function would hold them.
    """

    @F.arrow_udf(f"struct<tokens:{TOKENS},hidden:binary,covered:array<array<int>>>")
    def vectors(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for rows in encoded_portions(loader, batches, max_length):
            inner = [_inner(t, encoding) for t, encoding, *_ in rows]
            hidden = [np.asarray(r[1]["hidden"], np.float32)[:len(kept)][kept].tobytes() for r, (_, kept) in zip(rows, inner)]
            found = overlap_rows([(a, b, *spans.T) for (_, _, a, b), (spans, _) in zip(rows, inner)])
            yield pa.StructArray.from_arrays([_tokens([(r[0], spans) for r, (spans, _) in zip(rows, inner)]), pa.array(hidden, pa.binary()), found], ["tokens", "hidden", "covered"])

    return vectors(text, starts, ends)


def _inner(text: str, encoding: dict[str, Any]) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the encoding's tokens that lie in the text, and which these are."""
    moved = moved_offsets(np.asarray(encoding["offsets"], np.int64).reshape(-1, 2), len(PASSAGE_PREFIX), len(text))
    kept = moved[:, 0] >= 0
    return moved[kept], kept


def _tokens(rows: list[tuple[str, np.ndarray]]) -> pa.ListArray:
    spans = [s for _, s in rows]
    flat, words = np.concatenate(spans), []
    for t, s in rows:
        words += map(t.__getitem__, map(slice, *s.T.tolist()))
    items = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int32()), pa.array(flat[:, 1], pa.int32()), pa.array(words, pa.string())], ["start", "end", "text"])
    return listed(items, spans)


def _encodings(rows: list[dict[str, Any]]) -> pa.Array:
    return pa.StructArray.from_arrays(
        [
            pa.array([list(r["tokens"]) for r in rows], pa.list_(pa.string())),
            struct_column([np.asarray(r["offsets"], np.int64).reshape(-1, 2) for r in rows], ("start", "end"), pa.int32()),
            pa.array([int(r["hidden"].shape[1]) for r in rows], pa.int32()),
            list_column([np.asarray(r["hidden"], np.float32).ravel() for r in rows], pa.float32()),
        ],
        ["tokens", "offsets", "dim", "hidden"],
    )


def masked_means(hidden: list[np.ndarray], masks: list[np.ndarray]) -> list[np.ndarray]:
    """Mean of the token vectors that the mask keeps, for texts of any lengths (A16); zero where it keeps none.

    Rows of all texts are summed by text at once; nothing is padded.
    """
    sizes = np.array([len(h) for h in hidden])
    if not sizes.sum():
        return [np.zeros(h.shape[1]) for h in hidden]
    kept = np.concatenate([np.asarray(m, np.float64) for m in masks])
    rows = np.concatenate([np.asarray(h, np.float64) for h in hidden]) * kept[:, None]
    some = np.flatnonzero(sizes)
    begins = np.r_[0, np.cumsum(sizes)[:-1]][some]
    sums, counts = np.zeros((len(hidden), rows.shape[1])), np.zeros(len(hidden))
    sums[some], counts[some] = np.add.reduceat(rows, begins, axis=0), np.add.reduceat(kept, begins)
    return list(sums / np.maximum(counts, 1e-9)[:, None])


def query_encoding(loader: Callable[[], TokenEncoder], text: Column, max_length: int = QUERY_TOKENS) -> Column:
    """Unit question vector by a plugged-in model."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = once_per_worker(loader)
        for texts in batches:
            found, held = [], 0
            for t in texts:
                found.append(model.encode_query(QUERY_PREFIX + t.as_py(), max_length))
                held += np.size(found[-1][0] if isinstance(found[-1], tuple) else found[-1])
                if held > PORTION:
                    yield _unit_vectors(found)
                    found, held = [], 0
            if found:
                yield _unit_vectors(found)

    return encode(text)


def _unit_vectors(found: list) -> pa.Array:
    if isinstance(found[0], tuple):
        vectors = masked_means([h for h, _ in found], [m for _, m in found])
    else:
        vectors = [np.asarray(v, dtype=np.float64) for v in found]
    norms = [float(np.linalg.norm(v)) for v in vectors]
    return list_column([(v / n if n > 0 and np.isfinite(n) else np.zeros_like(v)).astype(np.float32) for v, n in zip(vectors, norms)], pa.float32())


def generated_text(loader: Callable[[], Generator], prompt: Column, max_new_tokens: int = 8, temperature: float = 0.0) -> Column:
    """Answer text by a plugged-in model (M5)."""

    @F.pandas_udf("string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once_per_worker(loader)
        for prompts in batches:
            yield prompts.map(lambda p: model.generate(p, max_new_tokens, temperature))

    return generate(prompt)


def option_log_probs(loader: Callable[[], Generator], prefix: Column, choice: Column, max_length: int | None = None) -> Column:
    """Token log-probabilities of an option by a plugged-in model (M3, M4)."""

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = once_per_worker(loader)
        for prefixes, choices in batches:
            yield pd.Series([model.token_log_probs(p, c, max_length) for p, c in zip(prefixes, choices)])

    return score(prefix, choice)


def budgeted_log_probs(loader: Callable[[], Generator], prefix: Column, choices: Column, max_length: int) -> Column:
    """Token log-probabilities of all options of a prompt within ``max_length`` tokens by a plugged-in model (M4).

    The prefix loses tokens on its left until the longest option fits behind
    it, and is the same for all options. An option that leaves no room for a
    token of the prefix is an error.
    """

    @F.pandas_udf("array<array<double>>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = once_per_worker(loader)
        for prefixes, options in batches:
            out = []
            for text, row in zip(prefixes, options):
                ids = [model.token_ids(o, False) for o in row]
                room = max_length - max(map(len, ids))
                if room <= 0:
                    raise ValueError("a response is longer than the maximum length")
                out.append(model.id_log_probs(model.token_ids(text, True)[-room:], ids))
            yield pd.Series(out)

    return score(prefix, choices)


def predicted_words(loader: Callable[[], ReadingTimeModel] | None, text: Column) -> Column:
    """Word reading times: a plugged-in model, or the length heuristic without one (M8, M9)."""
    if loader is None:
        return heuristic_words(text)

    @F.pandas_udf("array<struct<word:string,trt:double,features:struct<nFix:double,FFD:double,GPT:double,TRT:double,fixProp:double>>>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once_per_worker(loader)
        names = ("nFix", "FFD", "GPT", "TRT", "fixProp")
        for texts in batches:
            out = []
            for t in texts:
                found, features = model.predict(t)
                features = np.asarray(features, dtype=np.float64)
                if features.ndim != 2 or features.shape[1] < 5 or len(found) != len(features) or not len(found):
                    raise ValueError("the reading-time model gave an unexpected shape")
                out.append([
                    {"word": str(w), "trt": float(f[3]), "features": dict(zip(names, map(float, f)))}
                    for w, f in zip(found, features)
                ])
            yield pd.Series(out)

    return predict(text)


# --- stand-ins -------------------------------------------------------------------------------
# NOT a language model: digests of prompt and token make repeatable numbers of the right shape.


def last_words(text: Column, n: Column) -> Column:
    """The last ``n`` words of a text, in one pass over it."""
    return let(words(text), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), n), " "))


def standin_log_probs(prefix: Column, choice: Column, max_length: int | None = None, longest: Column | None = None) -> Column:
    """Stand-in token log-probabilities: one value in (-8, 0] per word of the choice.

    With ``max_length`` the prefix keeps its last words only (M4): as many as
    fit before the ``longest`` of the options that are compared, in words (this
    one's own number without it).
    """
    kept = prefix
    if max_length is not None:
        room = F.lit(max_length) - (F.size(words(choice)) if longest is None else longest)
        kept = F.when(room <= 0, F.raise_error(F.lit("a response is longer than the maximum length")).cast("string")).otherwise(last_words(prefix, room))
    return let(
        F.sha2(kept, 256),
        lambda key: F.transform(
            words(choice),
            lambda w, i: F.conv(F.substr(F.sha2(F.concat_ws(":", key, i.cast("string"), w), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
            / F.lit(4294967296.0) * -8.0,
        ),
    )


def standin_answer(prompt: Column, num_choices: Column) -> Column:
    """Stand-in generated text: "(X)" with the letter picked by the prompt's digest."""
    pick = F.conv(F.substr(F.sha2(prompt, 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % num_choices
    return F.concat(F.lit("("), F.char(pick.cast("int") + 65), F.lit(")"))


def option_scores(prompt: Column, choices: Column, log_probs: Callable[[Column, Column], Column] = standin_log_probs) -> Column:
    """Summed log-probability of every choice after the prompt and a blank."""
    return F.transform(
        choices,
        lambda c: F.aggregate(log_probs(F.concat(prompt, F.lit(" ")), c), F.lit(0.0), lambda acc, x: acc + x),
    )


def predict_answer(prompt: Column, choices: Column, mode: str = "generate", generate: Callable | None = None,
                   log_probs: Callable | None = None) -> Column:
    """struct(predicted_index, raw_output) by generation and parsing or by option likelihood (M6)."""
    if mode == "loglik":
        return let(
            option_scores(prompt, choices, log_probs or standin_log_probs),
            lambda s: let(
                first_argmax(s),
                lambda best: F.struct(
                    best.alias("predicted_index"),
                    F.to_json(F.struct(s.alias("scores"), best.alias("predicted_index"))).alias("raw_output"),
                ),
            ),
        )
    if mode != "generate":
        raise ValueError(f"unsupported scoring mode: {mode}")
    make = generate or standin_answer
    return let(
        make(prompt, F.size(choices)),
        lambda raw: F.struct(parse_choice(raw, F.size(choices)).alias("predicted_index"), raw.alias("raw_output")),
    )


