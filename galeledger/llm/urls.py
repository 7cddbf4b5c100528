"""URL filter: host rules, then naive Bayes over the words that a unigram Viterbi finds in host and path."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import ready, slices

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Words that label a page as unwanted for training (fixed values); the classifier learns the words that go with them.
SEEDS = ("spam", "pills", "casino", "viagra", "poker", "porn", "xxx", "adult", "betting", "warez", "torrent", "lottery", "escort")
# Letters of a word of the unigram model at most; a longer string is priced by its length, as unknown ones are.
WORD_LENGTH = 24
RUN = r"[^\W\d_]+|\d+"  # letters or digits
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased) and path after the first ``://``; both empty without one."""
    pattern = r"://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return {"host": F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), "path": F.regexp_extract(text, pattern, 2)}


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Splits a run of letters into the words of largest probability under a unigram model of ``total`` words."""

    def __init__(self, total: int):
        self.total = max(total, 1)

    def price(self, word: str, counts: dict[str, int]) -> float:
        """A known word by its frequency, an unknown one tenfold rarer with every letter."""
        n = counts.get(word)
        return log(self.total) - log(n) if n else log(self.total) + 2.302585092994046 * (len(word) - 1)

    def split(self, run: str, counts: dict[str, int]) -> list[str]:
        """``counts``: those of the words that stand anywhere in the run."""
        best, back = [0.0], [0]
        for stop in range(1, len(run) + 1):
            price, start = min((best[s] + self.price(run[s:stop], counts), s) for s in range(max(0, stop - WORD_LENGTH), stop))
            best.append(price)
            back.append(start)
        words, at = [], len(run)
        while at:
            words.append(run[back[at]:at])
            at = back[at]
        return words[::-1]


def unigrams(texts: DataFrame) -> DataFrame:
    """(w, n): counts of all words of letters a to z over all rows (column ``t``); a seed counts twice at least."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = re.compile(rb"[a-z]+").findall, Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], type=pa.string()), pa.array(list(seen.values()), type=pa.int64())], ["w", "n"])
        for batch in batches:
            for part in slices(batch, "t"):
                for text in part.column("t").to_pylist():
                    seen.update(find((text or b"").lower()))
                if len(seen) > 1 << 18:
                    yield out()
                    seen.clear()
        yield out()

    seeds = F.col("w").isin(*SEEDS)
    known = texts.sparkSession.createDataFrame([(w, 0) for w in SEEDS], "w string, n long")
    sums = texts.select(F.col("t").cast("binary").alias("t")).mapInArrow(counted, "w string, n long").unionByName(known).groupBy("w").agg(F.sum("n").alias("n"))
    return sums.withColumn("n", F.when(seeds, F.greatest("n", F.lit(2))).otherwise(F.col("n")))


def tokens(pages: DataFrame, model: DataFrame) -> DataFrame:
    """``pages`` (host, path) with ``host_words`` and ``path_words``: segmented words; a number counts as ``#``.

    Every distinct run of letters is split once. Its substrings meet the counts of all words in a join, so no task or driver
    holds the model; a run gets the counts of its own substrings, WORD_LENGTH a letter at most.
    """
    ready(pages.sparkSession)
    total = int(model.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    def runs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(RUN).findall
        for batch in batches:
            cut = [pa.array([["#" if run[0].isdigit() else run for run in find((t or "").lower())] for t in batch.column(c).to_pylist()], type=pa.list_(pa.string())) for c in ("host", "path")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), *cut], ["host", "path", "hr", "pr"])

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column("run").to_pylist():
                found = {run[s:e] for s in range(len(run)) for e in range(s + 1, min(len(run), s + WORD_LENGTH) + 1)}
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(found), type=pa.string()), pa.array(sorted(found), type=pa.string())], ["run", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Segmenter(total)
        for batch in batches:
            words = [own.split(run, {x["w"]: x["n"] for x in known or ()}) for run, known in zip(batch.column("run").to_pylist(), batch.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(words, type=pa.list_(pa.string()))], ["run", "words"])

    cut = settle(pages.select("host", "path").mapInArrow(runs_in, "host string, path string, hr array<string>, pr array<string>"), "url-runs")
    runs = settle(cut.select(F.explode(F.array_union("hr", "pr")).alias("run")).where("run <> '#'").distinct(), "runs")
    counted = runs.mapInArrow(substrings, "run string, w string").join(model, "w").groupBy("run").agg(F.collect_list(F.struct("w", "n")).alias("known"))
    words = runs.join(counted, "run", "left").select("run", "known").mapInArrow(split, "run string, words array<string>")
    words = words.unionByName(pages.sparkSession.createDataFrame([("#", ["#"])], "run string, words array<string>"))
    placed = cut.select("host", "path", F.posexplode(F.concat("hr", "pr")).alias("at", "run"), F.size("hr").alias("k")).join(settle(words, "run-words"), "run")
    side = lambda where: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("at", "words")))), lambda x: x["words"]))
    found = placed.groupBy("host", "path").agg(side(F.col("at") < F.col("k")).alias("hw"), side(F.col("at") >= F.col("k")).alias("pw"))
    none = F.array().cast("array<string>")
    return cut.select("host", "path").join(found, ["host", "path"], "left").select("host", "path", F.coalesce("hw", none).alias("host_words"), F.coalesce("pw", none).alias("path_words"))


def odds(cut: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(host, path, log_odds): naive Bayes odds that a page is unwanted.

    ``cut``: host, path, words and ``n`` pages. A page whose host has a seed word is an example of the unwanted class, every other
    of the wanted one; counts of words by class are sums over all pages, smoothed by one.
    """
    label = F.arrays_overlap("host_words", F.array(*[F.lit(s) for s in seeds])).cast("long")
    marked = cut.withColumn("y", label).withColumn("words", F.concat(F.transform("host_words", lambda w: F.concat(F.lit("h:"), w)), F.transform("path_words", lambda w: F.concat(F.lit("p:"), w))))
    bad, good = (F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)) for k in (1, 0))
    by_word = marked.select("y", "n", F.explode("words").alias("w")).groupBy("w").agg(bad.alias("bad"), good.alias("good"))
    sizes = by_word.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count(F.lit(1))).first()
    pages = marked.agg(F.coalesce(bad, F.lit(0)), F.coalesce(good, F.lit(0))).first()
    prior = log(pages[0] + 1) - log(pages[1] + 1)
    per = F.log((F.col("bad") + 1) / F.lit(float(sizes[0] + sizes[2] + 1))) - F.log((F.col("good") + 1) / F.lit(float(sizes[1] + sizes[2] + 1)))
    each = marked.select("host", "path", F.explode("words").alias("w")).join(by_word.select("w", per.alias("o")), "w")
    return marked.select("host", "path").join(each.groupBy("host", "path").agg(F.sum("o").alias("o")), ["host", "path"], "left").select(
        "host", "path", (F.coalesce("o", F.lit(0.0)) + F.lit(prior)).alias("log_odds"))


def judged(pages: DataFrame, texts: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, log_odds) of every page; ``texts`` (column ``t``) teaches the unigram model, with
    the words that hosts and paths set apart by hyphens.

    A rule decides where one fits, else the sign of the odds. Pages without host or path have no words and go by the prior.
    Copies of a (host, path) are judged once; repeated rows stay.
    """
    rows = pages.select(F.col(page_id), F.col(url), *[c.alias(k) for k, c in split_url(F.col(url)).items()])
    distinct = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    labels = F.filter(F.split(F.concat_ws("/", "host", "path"), "[./]"), lambda x: F.contains(x, F.lit("-")))
    model = settle(unigrams(texts.select("t").unionByName(distinct.select(F.array_join(labels, " ").alias("t")))), "unigrams")
    cut = settle(tokens(distinct, model).join(distinct, ["host", "path"]), "url-words")
    rule, verdict = ruled(F.col("host"), F.col("path"))
    scored = settle(odds(cut), "url-odds")
    return rows.join(scored, ["host", "path"]).select(
        page_id, url, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "log_odds")
