"""Line-first cleaning with quality counts, in DataFrame functions alone.

Each line of a text is judged by punctuation, navigation and boilerplate rules; failing lines go, and a document that
loses too much of its text is rejected. Beside that verdict stand counts over the whole text: words, characters in
words, symbols, repeated lines, and words within repeated windows of three.

Everything is computed within a row, so there is no shuffle and no group to become hot. Window repeats are found by
sorting the windows of one text, which is n log n in its words.

Defined results: a null text is the empty text (no words, all counts 0, not kept); repeated rows are judged each on
its own; columns other than the id and the text are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The characters that count as symbols, and phrases that mark a boilerplate line.
SYMBOLS = "[#*$%&|<>]"
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "terms of service",
    "terms of use",
    "use of cookies",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules. Shares are of a line's characters, or for ``max_lost`` of the text's."""

    max_symbols: float = 0.08
    max_shouts: float = 0.03
    max_capitals: float = 0.5
    min_separators: int = 2
    max_lost: float = 0.3
    min_words: int = 50
    max_repeat_percent: int = 50
    boilerplate: tuple[str, ...] = BOILERPLATE


def _without(line: Column, pattern: str) -> Column:
    """How many characters of ``line`` match ``pattern``."""
    return F.length(line) - F.length(F.regexp_replace(line, pattern, ""))


def line_passes(line: Column, rules: LineRules) -> Column:
    """Whether a line is neither mostly punctuation, nor navigation, nor boilerplate. Blank lines pass."""
    n = F.greatest(F.length(line), F.lit(1))
    punctuation = (
        (_without(line, SYMBOLS) <= rules.max_symbols * n)
        & (_without(line, "[!?]{2,}") <= rules.max_shouts * n)
        & (_without(line, r"\p{Lu}") <= rules.max_capitals * n)
    )
    navigation = _without(line, r"[|»›]") < rules.min_separators
    boilerplate = ~F.lower(line).rlike("|".join(rules.boilerplate)) if rules.boilerplate else F.lit(True)
    return punctuation & navigation & boilerplate


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long."""
    spaced = F.regexp_replace(text_of(text), r"[\x09-\x0D]", " ")
    df = docs.withColumn("_words", F.array_remove(F.split(spaced, " "), ""))
    df = df.withColumn(
        "_lines", F.filter(F.split(text_of(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    n = F.size("_words")
    following = lambda i, k: F.get(F.col("_words"), i + k)
    df = df.withColumn(
        "_windows",
        F.sort_array(
            F.transform(
                F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))),
                lambda w, i: F.struct(F.concat_ws(" ", w, following(i, 1), following(i, 2)).alias("w"), i.alias("i")),
            )
        ),
    )
    beside = lambda i, k: F.get(F.col("_windows"), i + k)["w"]
    df = df.withColumn(
        "_starts",
        F.sort_array(
            F.transform(
                F.filter(
                    "_windows",
                    lambda x, i: F.coalesce(x["w"] == beside(i, -1), F.lit(False))
                    | F.coalesce(x["w"] == beside(i, 1), F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.transform(
        "_starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_starts"), i + 1) - p, F.lit(3)))
    )
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _without(text_of(text), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
        }
    ).drop("_words", "_lines", "_windows", "_starts")


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` with the counts, clean_text (its passing lines), lost_chars, base_failed and kept."""
    df = with_counts(docs, text).withColumn(
        "clean_text", F.array_join(F.filter(F.split(text_of(text), "\n"), lambda x: line_passes(x, rules)), "\n")
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    lost = F.length(text_of(text)) - F.length("clean_text")
    return df.withColumns(
        {
            "lost_chars": lost.cast("long"),
            "base_failed": failed,
            "kept": ~failed & (lost <= rules.max_lost * F.length(text_of(text))),
        }
    )
