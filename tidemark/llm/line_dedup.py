"""Removal of repeated runs of lines by winnowing, with DataFrame functions only.

The documents' lines with a word are hashed.  A window is the shortest run of lines from a line on that holds
``min_words`` words.  Each window selects its minimal line hash, and a position selected by several windows is kept
once: its hash is a fingerprint, and the lines around it, as far as a window can reach, go with it.  Every repeated run
of ``min_words`` words holds a window, and so a fingerprint at the same line of each occurrence.

Fingerprints that occur once are dropped.  For the others the runs that begin with a window that selected them are joined
with the first place of the same run, never all positions with all, and each match of two positions is extended both ways by comparing
the lines before and after them.  The extended matches are the repeated runs, and every occurrence but the first goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, col, fresh, table
from .quality import let

MIN_WORDS = 50
_BLANK = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    """The lines with a word: index among all lines, two hashes of the trimmed line, number of words."""

    def describe(line: Column, k: Column) -> Column:
        t = F.btrim(line, F.lit(_BLANK))
        return F.struct(k.alias("k"), F.xxhash64(t).alias("h"), F.hash(t).alias("g"), F.when(t == "", 0).otherwise(F.regexp_count(t, F.lit(WORD))).alias("n"))

    return F.filter(F.transform(F.split(text, "\n"), describe), lambda x: x["n"] > 0)


def _reach(rows: Column, min_words: int) -> Column:
    """(n, size): how many words the first rows hold, up to the row that makes them ``min_words``, and how many rows."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"))
    longer = lambda a, x: F.when(a["n"] >= min_words, a).otherwise(F.struct((a["n"] + x["n"]).alias("n"), (a["size"] + 1).alias("size")))
    return F.aggregate(rows, start, longer)


def _least(rows: Column) -> Column:
    """The place among ``rows`` of the minimal hash, the first of equal ones."""
    return let(F.transform(rows, lambda x: x["h"]), lambda h: F.array_position(h, F.array_min(h))).cast("int")


def selected(lines: Column, min_words: int) -> Column:
    """Each position that a window selects, once: its fingerprint, the lines around it and its place among them."""

    def choose(i: Column) -> Column:
        window = lambda p, w: F.when(w["n"] >= min_words, i - 1 + _least(F.slice(p, F.lit(1), w["size"])))
        return let(F.slice(lines, i, F.lit(min_words)), lambda p: let(_reach(p, min_words), lambda w: window(p, w)))

    def describe(p: Column) -> Column:
        start = F.greatest(F.lit(1), p - min_words)
        before = _reach(F.reverse(F.slice(lines, start, p - start)), min_words)["size"]
        after = _reach(F.slice(lines, p + 1, F.lit(min_words)), min_words)["size"]
        around = lambda b: F.struct((b + 1).alias("at"), F.slice(lines, p - b, b + 1 + after).alias("lines"))
        return F.struct(F.get(lines, p - 1)["h"].alias("fingerprint"), let(before, around).alias("around"))

    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(lines)), choose))
    return F.transform(F.filter(places, lambda x: x.isNotNull()), describe)


def _matches(around: Column, min_words: int) -> Column:
    """The windows that selected the position ``around`` lies at, and what begins with such a window and is the shortest
    run of ``min_words`` words back from its own last line: first line and content, as two hashes of all lines."""
    lines, at = around["lines"], around["at"]

    def content(rows: Column) -> Column:
        return F.struct(F.get(rows, F.lit(0))["k"].alias("first"), F.xxhash64(F.transform(rows, lambda x: x["h"])).alias("content"), F.hash(F.transform(rows, lambda x: x["g"])).alias("check"))

    def runs(p: Column, size: Column) -> Column:
        rest = _reach(F.slice(p, F.lit(2), F.size(p)), min_words)
        longest = let(rest, lambda r: F.greatest(size, r["size"] + F.when(r["n"] >= min_words, 0).otherwise(1)))
        return F.transform(F.sequence(size, longest), lambda n: content(F.slice(p, F.lit(1), n)))

    def begin(i: Column) -> Column:
        chosen = lambda p, w: (w["n"] >= min_words) & (i - 1 + _least(F.slice(p, F.lit(1), w["size"])) == at)
        return let(F.slice(lines, i, F.size(lines)), lambda p: let(_reach(p, min_words), lambda w: F.when(chosen(p, w), runs(p, w["size"]))))

    return F.flatten(F.filter(F.transform(F.sequence(F.lit(1), at), begin), lambda x: x.isNotNull()))


def _extended(own: Column, other: Column) -> Column:
    """The first and last line of ``own``'s side of a match, extended both ways from the two positions as long as lines
    are equal."""

    def equal(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False)))
        return let(F.array_position(same, F.lit(False)), lambda n: F.when(n > 0, n - 1).otherwise(F.size(a))).cast("int")

    back = lambda x: F.reverse(F.slice(x["lines"], F.lit(1), x["at"]))
    on = lambda x: F.slice(x["lines"], x["at"], F.size(x["lines"]))
    line = lambda k: F.get(own["lines"], k)["k"]
    return F.struct(line(own["at"] - equal(back(own), back(other))).alias("first"), line(own["at"] - 2 + equal(on(own), on(other))).alias("last"))


def repeated_ranges(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, hash, gone): for each document (id and text hash) with repeated runs, the indexes of the lines in them."""
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("hash"), _lines(col(text_col)).alias("lines"))
    rows = rows.where(F.size("lines") > 0)
    places = table(rows.select("id", "hash", F.explode(selected(F.col("lines"), min_words)).alias("w")).select("id", "hash", "w.*"))
    often = places.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    windows = places.join(often, "fingerprint", "left_semi").withColumn("w", F.explode(_matches(F.col("around"), min_words)))
    windows = table(windows.select("id", "hash", "fingerprint", "around", "w.*"))
    key = ["fingerprint", "content", "check"]
    place = F.struct("id", "hash", "first")
    origins = windows.groupBy(*key).agg(F.min(F.struct(place.alias("place"), F.col("around"))).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(origins, key).where(place > F.col("origin.place"))
    ranges = later.groupBy("id", "hash").agg(F.collect_set(_extended(F.col("around"), F.col("origin.around"))).alias("ranges"))
    gone = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["last"]))))
    return ranges.select("id", "hash", gone.alias("gone"))


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, report: bool = True) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` less its repeated runs; with ``report`` the columns (lines_before,
    lines_after) follow; columns of ``docs`` so called are replaced by them.  Other names of columns are no matter.

    A line goes if it lies in a run of lines that holds at least ``min_words`` words and equals, line by line after
    trimming, a run starting at an earlier place, places being ordered by (id, text hash, line).  Blank lines don't
    count, but go if they lie inside such a run.  Rows equal in id and text are one document with the same result.
    Null ids come first; a null text stays null and has no lines.  No row is dropped; an empty table gives none.
    """
    [runs] = fresh(docs, "_runs")
    ranges = repeated_ranges(docs, id_col=id_col, text_col=text_col, min_words=min_words)
    ranges = ranges.select(F.struct(*ranges.columns).alias(runs))
    text, gone = col(text_col), F.col(runs)["gone"]
    joined = docs.join(ranges, col(id_col).eqNullSafe(F.col(runs)["id"]) & (F.xxhash64(text) == F.col(runs)["hash"]), "left")
    split = F.split(text, "\n")

    def less(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    cleaned = F.when(gone.isNull(), text).otherwise(let(split, less))
    before = F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long")
    counts = [before.alias("lines_before"), (before - F.coalesce(F.size(gone), F.lit(0))).alias("lines_after")] if report else []
    names = [c for c in docs.columns if not (report and c.lower() in ("lines_before", "lines_after"))]
    return joined.select(*[cleaned.alias(c) if c == text_col else col(c) for c in names], *counts)
