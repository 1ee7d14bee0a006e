"""Line-first cleaning with DataFrame functions only.

Each line is judged by itself: it must end like a sentence, must not be navigation and must not be boilerplate.
Failing lines go, and a document that loses too much of its text that way is rejected, as is one that fails the base
rules on its whole text.  Everything is computed within the row, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD

# The rules' patterns, valid for Java and RE2 alike.
SYMBOLS = r"[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]*]*$"
NAVIGATION = r"(?i)^(home|menu|login|log in|sign in|sign up|register|next|previous|back to top|skip to content|read more|share this|contact us|about us|sitemap|site map|search)\b[^.!?]{0,40}$"
BREADCRUMB = r"^[^.!?]{1,40}( [|>»›/] [^.!?]{1,40}){2,}$"
BOILERPLATE = r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|use of cookies|accept (all )?cookies|enable javascript|lorem ipsum|subscribe to our newsletter|click here|powered by|copyright ©|©)"
#: A document is rejected when its removed lines hold more than this share (in hundredths) of its word characters.
MOST_LOST = 50
WINDOW = 5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of so many words that occur twice or more, first occurrences included."""

    def of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeats))

    def repeats(s: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
        at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(same(k, F.lit(-1)) | same(k, F.lit(1)), F.get(s, k)["i"]))
        return let(F.sort_array(F.filter(at, lambda i: i.isNotNull())), covered)

    def covered(p: Column) -> Column:
        step = lambda k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(window)))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda n, k: n + step(k))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(windows, of)).cast("long")


def line_passes(line: Column) -> Column:
    """Blank lines pass; others must end like a sentence and be neither navigation nor boilerplate."""
    t = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    good = t.rlike(SENTENCE_END) & ~t.rlike(NAVIGATION) & ~t.rlike(BREADCRUMB) & ~t.rlike(BOILERPLATE)
    return (t == "") | good


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, most_lost: int = MOST_LOST) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_lines_removed,
    kept_chars, kept[, clean_text]) for every row of ``docs``.

    ``kept`` is false if the base rules fail (under 10 words, or over a fifth of the words in repeated windows) or if
    over ``most_lost`` hundredths of the word characters lie in removed lines.  A null text has no words, lines or
    cleaned text and fails the base rules, as an empty one does.  Repeated rows are judged alike; extra columns are
    dropped.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(F.regexp_replace(x, SPACE, "")))

    def of_words(words: Column) -> Column:
        total = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.length(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), total.alias("word_chars"), repeated_words(words).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        passed = F.filter(lines, line_passes)
        return let(passed, lambda kept: F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            (F.size(lines) - F.size(kept)).cast("long").alias("n_lines_removed"),
            chars(kept).alias("kept_chars"),
            *([F.array_join(kept, "\n").alias("clean_text")] if keep_text else []),
        ))

    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        id_col,
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("_w"),
        let(with_word, of_lines).alias("_l"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n, again = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    failed = (n < 10) | (100 * again > 20 * n)
    lost = F.col("_w.word_chars") - F.col("_l.kept_chars")
    kept = ~failed & (100 * lost <= most_lost * F.col("_w.word_chars"))
    more = [F.col("_l.clean_text")] if keep_text else []
    return rows.select(
        id_col, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", failed.alias("base_failed"),
        "_l.n_lines", "_l.n_lines_removed", "_l.kept_chars", kept.alias("kept"), *more,
    )
