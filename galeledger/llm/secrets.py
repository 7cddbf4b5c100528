"""Secret scan: fixed patterns, and candidate strings judged by sliding-window entropy. Functions of columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Character classes: pattern of the whole candidate, alphabet, least entropy (bits) of some window of 20.
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("alnum", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.7),
    ("small", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 3.7),
    ("large", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.7),
    # Without a digit it may be a long word or a joined name, whose letters repeat more.
    ("letters", r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.9),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
)
# Strings that look random and are no secrets: samples, UUIDs, paths of plain words, names joined by capitals, one repeated character (fixed values).
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^/?([A-Za-z]{1,15}[/_-]){2,}[A-Za-z0-9]{0,15}$", r"^[A-Z]?[a-z]{2,}([A-Z][a-z]+)+$", r"^(.)\1+$",
    r"(?i)abcdefghijklmnop|0123456789",
)
SPAN = "array<struct<s:int,e:int,k:int,m:string>>"


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Start, end (code points), kind and the group of every leftmost match.

    What lies between the matches and the matches themselves add up to the places.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.transform(whole, lambda x: x)
    found = F.arrays_zip(between.alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("len"), value.alias("m"))
    # arrays_zip pads the shorter side: the piece after the last match has no match
    real = F.filter(found, lambda x: x["len"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))
    step = lambda a, x: F.struct(
        (a["at"] + x["gap"] + x["len"]).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + x["len"]).alias("e"), F.lit(kind).alias("k"), x["m"].alias("m")))).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(real, start, step, lambda a: a["out"])).otherwise(F.expr(f"cast(array() as {SPAN})"))


def entropy(word: Column, alphabet: str) -> Column:
    """Largest Shannon entropy (bits) of any ``WINDOW`` consecutive characters of ``word``; 0 for a shorter word.

    A fold over the characters keeps one count per character of the alphabet (others share a count) and the
    sum of c log2 c; each step changes them by the character that enters and the one that leaves the window.
    """
    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("n"), F.lit(0.0).alias("t"), F.lit(1e9).alias("low"))

    def step(codes: Column, a: Column, k: Column) -> Column:
        new, old = F.get(codes, k), F.when(k >= WINDOW, F.get(codes, k - WINDOW)).otherwise(F.lit(-1))
        change = lambda c, i: c + F.when(i == new, F.lit(1)).otherwise(F.lit(0)) - F.when(i == old, F.lit(1)).otherwise(F.lit(0))
        up, down = F.get(a["n"], new), F.get(a["n"], old)
        total = a["t"] + F.when(new == old, F.lit(0.0)).otherwise(
            term(up + 1) - term(up) + F.when(old >= 0, term(down - 1) - term(down)).otherwise(F.lit(0.0)))
        return F.struct(F.transform(a["n"], change).alias("n"), total.alias("t"),
                        F.when(k + 1 >= WINDOW, F.least(a["low"], total)).otherwise(a["low"]).alias("low"))

    def fold(codes: Column) -> Column:
        best = lambda a: F.log2(F.lit(float(WINDOW))) - a["low"] / WINDOW
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, lambda a, k: step(codes, a, k), best)

    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(alphabet), c))
    return F.when(F.length(word) >= WINDOW, let(codes, fold)).otherwise(F.lit(0.0))


def suspicious(word: Column) -> Column:
    """Whether a candidate string is random enough for its character class and on no allow list."""
    high, taken = F.lit(False), F.lit(False)
    for _, shape, alphabet, least in CLASSES:
        fits = word.rlike(shape) & ~taken
        high = high | F.when(fits, entropy(word, alphabet) >= least).otherwise(F.lit(False))
        taken = taken | word.rlike(shape)
    for shape in ALLOWED:
        high = high & ~word.rlike(shape)
    return high


def shown(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(x) for x in ("assign", "access", "hex", "entropy")])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``secret_spans``: arrays of (s start, e end, k kind, m the value), by start, then kind.

    Kinds: 0 assign, 1 access, 2 hex (fixed patterns), 3 entropy. Places count code points, end exclusive.
    ``secret_spans`` has the fixed ones and, of the strings of 20 or more key characters, those with a window of high
    entropy for their class that no allow list names and no fixed span overlaps. A null text has no spans. Columns of these two names are replaced, all others stay.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    none = F.expr(f"cast(array() as {SPAN})")
    # A text without any of the words cannot match; two fast byte searches save the pattern.
    assign = F.when(named, F.filter(spans(body, ASSIGN, 0, 2), lambda x: F.length(x["m"]) >= 6)).otherwise(none)
    access = F.when(F.contains(body, F.lit("AKIA")), spans(body, ACCESS, 1)).otherwise(none)
    base = F.concat(assign, access, spans(body, HEX, 2))
    found = docs.withColumn("base_spans", F.sort_array(base))
    ordered = lambda a: F.transform(F.sort_array(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["m"].alias("m")))),
                                    lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["m"].alias("m")))
    free = lambda x: ~F.exists("base_spans", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    added = F.filter(spans(body, CANDIDATE, 3), lambda x: free(x) & suspicious(x["m"]))
    return found.withColumn("base_spans", ordered(F.col("base_spans"))).withColumn("secret_spans", ordered(F.concat("base_spans", added)))


def masked(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (ascending; overlapping ones merge) replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    step = lambda a, x: F.struct(
        F.greatest(a["at"], x["e"]).alias("at"),
        F.when(x["s"] >= a["at"], F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mark)))).otherwise(a["out"]).alias("out"))
    whole = F.aggregate(found, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)
