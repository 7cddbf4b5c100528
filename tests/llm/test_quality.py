import random
import re
from collections import Counter

from galeledger.llm.quality import quality
from galeledger.llm.stages import quality_rules


def counted(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_equal_brute_force(docs):
    for r in quality(docs).collect():
        assert tuple(r[c] for c in NAMES) == counted(r.text), r.text[:50]


def test_repeated_windows_on_small_alphabets(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = quality(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [tuple(r[c] for c in NAMES) for r in rows] == [counted(r.text) for r in rows]


def test_lines_fall_and_documents_with_them(spark):
    good = "This is a line of ordinary words that ends well.\nAnd here is another one with enough words in it."
    texts = {
        "good": good, "licence": good + "\nLicensed under the Example License.", "menu": "Home | About | Contact | Help | Login\n" * 3 + "One line of words is all there is.",
        "loud": "EVERY SINGLE WORD HERE IS LOUD.\n" * 1 + "AND LOUDER STILL IT GETS BY THE LINE.", "open": "no stop at the end of this line of words here\n" + "nor of this other one",
        "symbols": "some$$$ words### with&&& marks*** at%%% every&&& end*** of### each.***",
    }
    got = {r.k: r for r in quality(spark.createDataFrame(list(texts.items()), "k string, text string")).collect()}
    assert [k for k in texts if got[k].kept] == ["good", "licence"]
    assert got["licence"].clean_text == good
    assert not got["open"].base_failed and not got["open"].kept


def test_extra_and_clashing_columns(spark, no_docs):
    rows = [("one two three four five six seven eight nine ten eleven.", 7, "mine")] * 2
    out = quality(spark.createDataFrame(rows, "text string, n_words long, other string")).collect()
    assert [(r.n_words, r.other, r.kept) for r in out] == [(11, "mine", True)] * 2
    assert quality(no_docs).count() == 0
    assert quality_rules(spark, no_docs, "").columns == no_docs.columns
