"""Line-first quality rules: lines are judged one by one, then documents by what is left. Functions of columns only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, free, let

# Phrases of notices, licences and page furniture; a line with one of them is dropped (fixed values).
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "privacy policy", "terms of use", "terms of service",
    "cookie", "enable javascript", "lorem ipsum", "subscribe to our", "click here", "sign up for", "powered by",
)
TERMINAL = r"[.!?:;…。！？][\"'»“”’)\]]{0,2}[\x20\x09-\x0D]*$"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeat_words(words: Column) -> Column:
    """How many words lie in a five-word window that the text has twice or more.

    Windows are compared by 64-bit hashes of word hashes. Only a text with a repeated window is sorted.
    """
    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                                                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def joined(a: Column, b: Column, skip: int) -> Column:
        """Hash of a[i] with b[i + skip], as far as b goes."""
        n = F.size(b) - skip
        return F.zip_with(F.slice(a, 1, n), F.slice(b, skip + 1, n), lambda x, y: F.xxhash64(x, y))

    def counted(h: Column) -> Column:
        fours = let(joined(h, h, 1), lambda twos: joined(twos, twos, 2))
        repeated = let(joined(fours, h, 4), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(F.lit(0)))
        return F.when(F.size(h) >= 5, repeated).otherwise(F.lit(0))

    return let(F.transform(words, lambda w: F.xxhash64(w)), counted).cast("long")


def line_fault(line: Column) -> Column:
    """Name of the first rule a line fails, else null."""
    gone = lambda pattern: F.length(line) - F.length(F.regexp_replace(line, pattern, ""))
    words = F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1
    phrase = lambda low: (
        F.when(reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE]), F.lit("boilerplate"))
        .when((low != line) & (F.upper(line) == line), F.lit("capitals")))
    by_counts = let(F.struct(words.alias("n"), gone(r"[|•»›]").alias("bars"), gone(r"[#*$%&<>]").alias("symbols")), lambda x: (
        F.when((x["bars"] >= 1) & (x["bars"] * 4 >= x["n"]), F.lit("navigation")).when(x["symbols"] * 5 > x["n"], F.lit("symbols"))))
    ends = F.when(~F.right(F.rtrim(line), F.lit(3)).rlike(TERMINAL), F.lit("punctuation"))
    return F.coalesce(let(F.lower(line), phrase), by_counts, ends)


def quality(docs: DataFrame, text: str = "text", least_left: float = 0.5) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``,
    ``clean_text``, ``kept_chars`` and ``kept``.

    A line fails as boilerplate (a phrase of ``BOILERPLATE``), without a small letter, as navigation (separators at a
    quarter of its words or more), by symbols (one in five words), or without final punctuation. ``clean_text`` has the other lines. A document goes if ``base_failed``,
    or if less than ``least_left`` of the characters in its lines with words is left; licence and notice lines count neither way. Null and empty texts have
    no words and fail. Columns of these names in ``docs`` are replaced; other columns and repeated rows stay.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    q, line, whole = free(docs, "_q", "_l", "_all")
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_fault(x).alias("fault")))
    counts = docs.withColumns({
        q: let(words_of(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeat_words(w).alias("r"))),
        line: judged,
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    })
    left = F.filter(line, lambda x: x["fault"].isNull())
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + F.length(y["line"]))
    out = counts.withColumns({
        "n_words": F.col(q)["n"], "word_chars": F.col(q)["c"], "n_repeat_words": F.col(q)["r"],
        "clean_text": F.array_join(F.transform(left, lambda x: x["line"]), "\n"), "kept_chars": total(left),
        whole: total(F.filter(line, lambda x: F.coalesce(x["fault"] != "boilerplate", F.lit(True)))),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("kept_chars") > 0) & (F.col("kept_chars") >= least_left * F.col(whole))).drop(q, line, whole)
