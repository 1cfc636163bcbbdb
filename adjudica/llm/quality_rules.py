"""Quality rules: a table of thresholds compiled into one projection without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.columns import SPACES, words

SYMBOLS = r"[#*$%&|<>]"
# Frequent words of the languages of the corpus, in lower case.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this from or an at "
    "de la le les et des en un une du que qui dans pour par sur au avec "
    "der die das und den von zu mit sich des ist im dem nicht ein eine als auch für auf "
    "el los las del se por con una su para es al lo como y a"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure and the closed range in which it must lie; None leaves a side open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The verdict of the method. A text fails if one measure is out of its range.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.3),
    Rule("capital_share", None, 0.3),
    Rule("dup_line_share", None, 0.5),
    Rule("n_stop_words", 2, None),
)
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_stop_words",
    "n_repeat_words",
)
#: The base checks: least words, and the largest percentage of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(word: Column) -> Column:
    """Words inside 3-word windows that the array ``word`` holds twice or more.

    Places are sorted by a hash of the three words that start there, which brings repeated windows
    side by side. Places with equal hashes are then sorted by the words themselves, so that hashes
    decide nothing.
    """
    n = F.size(word)
    starts = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(
        starts,
        lambda i: F.shiftleft(F.xxhash64(word[i], word[i + 1], word[i + 2]), 31).bitwiseOR(
            i.cast("long")
        ),
    )

    def same(ordered: Column, value: Callable[[Column], Column]) -> Column:
        return F.filter(
            ordered,
            lambda x, k: (value(x) == value(F.get(ordered, k + 1)))
            | (value(x) == value(F.get(ordered, k - 1))),
        )

    alike = _let(F.sort_array(hashes), lambda h: same(h, lambda x: F.shiftright(x, 31)))
    windows = F.transform(
        F.transform(alike, lambda x: x.bitwiseAND(2**31 - 1).cast("int")),
        lambda i: F.struct(
            F.concat_ws(" ", word[i], word[i + 1], word[i + 2]).alias("words"), i.alias("at")
        ),
    )
    repeated = _let(F.sort_array(windows), lambda w: same(w, lambda x: x["words"]))
    return F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["at"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(
            (i + 3).alias("end"),
            (s["n"] + i + 3 - F.greatest(i, s["end"])).cast("long").alias("n"),
        ),
        lambda s: s["n"],
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _counts(text: Column, word: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    counts = {
        "n_words": F.size(word),
        "word_chars": F.char_length(F.array_join(word, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_stop_words": F.size(F.array_intersect(word, stop)),
        "n_repeat_words": _repeated_words(word),
    }
    return F.struct(*[value.cast("long").alias(name) for name, value in counts.items()])


def _with_ratios(counts: Column) -> Column:
    return F.struct(
        *[counts[name].alias(name) for name in COUNTS],
        _share(counts["word_chars"], counts["n_words"]).alias("mean_word_chars"),
        _share(counts["n_symbols"], counts["n_words"]).alias("symbols_per_word"),
        _share(counts["n_capitals"], counts["word_chars"]).alias("capital_share"),
        _share(counts["n_dup_lines"], counts["n_lines"]).alias("dup_line_share"),
    )


def measures(text: Column) -> Column:
    """A struct of counts and ratios of one whole text; null counts as a text without words."""
    whole = F.coalesce(text, F.lit(""))
    counts = _let(whole, lambda t: _let(words(t, SPACES), lambda w: _counts(t, w)))
    return _let(counts, _with_ratios)


def compiled(rules: tuple[Rule, ...], measured: str = "quality") -> Column:
    """One boolean expression that holds if every rule does."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.col(f"{measured}.{rule.measure}")
        if rule.least is not None:
            verdict = verdict & (value >= rule.least)
        if rule.most is not None:
            verdict = verdict & (value <= rule.most)
    return verdict


def base_failed(measured: str = "quality") -> Column:
    n, repeated = F.col(f"{measured}.n_words"), F.col(f"{measured}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(row, quality, base_failed, kept) of every row; ``row`` holds all columns of ``docs``.

    An empty or null text has no words and fails the base checks. Repeated rows get equal verdicts, an
    empty table gives no row, and no column of ``docs`` can clash, since all are inside ``row``. Plan:
    one scan and one projection of built-in functions.
    """
    judged = docs.select(F.struct("*").alias("row"), measures(F.col(text)).alias("quality"))
    judged = judged.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & compiled(rules))
