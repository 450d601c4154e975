"""Prompt formatting and answer parsing as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dwellrank.functions.arrays import let
from dwellrank.functions.text import NON_SPACE, SPACE, U, strip

# The prompt texts the scoring models are given.
MCQA_HEAD = "Answer the multiple-choice question using only the retrieved evidence.\nReturn exactly one choice label.\n\n"
BARE_HEAD = "Answer the multiple-choice question.\nReturn exactly one choice label.\n\n"
REWARD_HEAD = "You are answering a retrieval-augmented question using only the provided references.\n\n"
NO_EVIDENCE = "No retrieved evidence."
MAX_CHOICES = 26


def _checked(ok: Column, message: str, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def choice_block(choices: Column) -> Column:
    """Lettered choices, one per line."""
    lines = F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c))
    n = F.size(choices)
    return _checked((n >= 1) & (n <= MAX_CHOICES), "between 1 and 26 choices are supported", F.array_join(lines, "\n"))


def _question(question: Column) -> Column:
    return _checked(question.rlike(U + NON_SPACE), "question must not be empty", strip(question))


def mcqa_prompt(question: Column, choices: Column, evidence: Column) -> Column:
    """Multiple-choice prompt with numbered evidence blocks."""
    blocks = F.transform(
        evidence,
        lambda e, i: F.concat(F.lit("[Evidence "), (i + 1).cast("string"), F.lit("]\n"), strip(e)),
    )
    shown = F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, F.array_join(blocks, "\n\n")).otherwise(
        F.lit(NO_EVIDENCE)
    )
    return F.concat(
        F.lit(MCQA_HEAD),
        F.lit("Question:\n"), _question(question),
        F.lit("\n\nChoices:\n"), choice_block(choices),
        F.lit("\n\nRetrieved evidence:\n"), shown,
        F.lit("\n\nAnswer:"),
    )


def bare_prompt(question: Column, choices: Column) -> Column:
    """Multiple-choice prompt without evidence."""
    return F.concat(
        F.lit(BARE_HEAD),
        F.lit("Question:\n"), _question(question),
        F.lit("\n\nChoices:\n"), choice_block(choices),
        F.lit("\n\nAnswer:"),
    )


def reward_prompt(context: Column, question: Column) -> Column:
    """Prompt prefix for response scoring."""
    return F.concat(
        F.lit(REWARD_HEAD), strip(context), F.lit("\n\nQuestion:\n"), strip(question), F.lit("\n\nAnswer:\n")
    )


def parse_choice(raw: Column, num_choices: Column) -> Column:
    """Choice index named by a model's output, null when unclear.

    In order: two different stand-alone labels give null; a leading label
    (the first letter of any first word counts); "answer/choice/option X";
    exactly one stand-alone label. Text without a label gives null.
    """
    def index_of(letter: Column) -> Column:
        position = F.ascii(F.upper(letter)) - 65
        return F.when((F.length(letter) > 0) & (position < num_choices), position.cast("int"))

    def first_group(pattern: str) -> Column:
        return F.regexp_extract(raw, pattern, 1)

    label = r"[(\[]?([A-Za-z])[)\]]?"
    letter_or_digit = r"[\p{L}\p{N}_]"
    word_edge = f"(?<!{letter_or_digit})"
    standalone = F.filter(
        F.transform(F.regexp_extract_all(raw, F.lit(f"{word_edge}([A-Za-z])(?!{letter_or_digit})"), F.lit(1)), index_of),
        lambda x: x.isNotNull(),
    )
    leading = index_of(first_group(rf"{U}\A{SPACE}*[(\[]?([A-Za-z])"))
    named = F.coalesce(
        index_of(first_group(rf"(?iU){word_edge}answer{SPACE}*(?:is|:)?{SPACE}*{label}")),
        index_of(first_group(rf"(?iU){word_edge}choice{SPACE}*{label}")),
        index_of(first_group(rf"(?iU){word_edge}option{SPACE}*{label}")),
    )
    return let(
        standalone,
        lambda found: F.when(
            F.size(F.array_distinct(found)) <= 1,
            F.coalesce(leading, named, F.when(F.size(found) == 1, F.get(found, F.lit(0)))),
        ),
    )
