import math
import random
import re
from itertools import combinations

from galeledger.llm.urls import RULES, Segmenter, judged, odds, split_url, ruled, tokens, unigrams
from pyspark.sql import functions as F

URLS = [
    "http://Sub.Example.NET/en/1?x=1", "https://net/a", "http://planet/a", "http://x.net", "http://x.net/#top", "http://example.com/de/", "http://example.com/dex/", "ftp://a.b.org/fr/q#r",
    "http://example.org/fr", None, "", "no scheme/fr/", "x://y://z.net/", "http://ÄÖ.NET/p", "http://example.net/en", "http:///only/path", "http://notexample.net/en/",
]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[:min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, say in RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[0])):
            best = rule, say
    return host, path, *(best or (None, None))


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", *[c.alias(k) for k, c in split_url(F.col("url")).items()])
    rule, verdict = ruled(F.col("host"), F.col("path"))
    for r in df.select("url", "host", "path", rule.alias("rule"), verdict.alias("verdict")).collect():
        assert (r.host, r.path, r.rule, r.verdict) == expected(r.url), r.url


def test_segments_are_the_most_probable():
    counts = {"cheap": 50, "pills": 40, "online": 70, "on": 300, "line": 80, "p": 5, "ills": 2, "the": 500, "rapist": 3, "therapist": 9}
    own = Segmenter(sum(counts.values()))
    cost = lambda words: sum(own.price(w, counts) for w in words)
    for run in ("cheappillsonline", "therapist", "onlinex", "zq", "thepills"):
        cuts = [[run[a:b] for a, b in zip((0, *c), (*c, len(run)))] for k in range(min(len(run), 6)) for c in combinations(range(1, len(run)), k)]
        assert math.isclose(cost(own.split(run, counts)), min(map(cost, cuts)))
    assert own.split("cheappillsonline", counts) == ["cheap", "pills", "online"]


def test_words_that_go_with_seeds_are_learned(spark):
    rng = random.Random(4)
    good = [f"http://www.{rng.choice(['garden', 'school', 'museum', 'library'])}{rng.choice(['news', 'club'])}.example.edu/{rng.choice(['about', 'events', 'visit'])}/{i}" for i in range(300)]
    bad = [f"http://{rng.choice(['best', 'cheap', 'free'])}{rng.choice(['casino', 'pills', 'poker'])}bonus.example.edu/{rng.choice(['jackpot', 'deal'])}/{i}" for i in range(60)]
    unseen = ["http://freebonusjackpot.example.edu/jackpot/1", "http://cheapbonus.example.edu/deal/2"]
    clean = ["http://gardenclub.example.edu/events/9", "http://museumschool.example.edu/visit/8"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(good + bad + unseen + clean)], "page_id long, url string, host string")
    words = "garden school museum library news club about events visit best cheap free casino pills poker bonus jackpot deal "
    texts = spark.createDataFrame([(words * 20,), (None,)], "t string")
    got = {r.url: r.verdict for r in judged(pages, texts).collect()}
    assert [got[u] for u in unseen + clean] == ["block", "block", "allow", "allow"]
    assert sum(got[u] == "allow" for u in good) / len(good) > 0.98 and sum(got[u] == "block" for u in bad) / len(bad) > 0.98


def test_odd_rows(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, None), (0, URLS[0])], "page_id long, url string")
    texts = spark.createDataFrame([], "t string")
    got = judged(pages, texts).collect()
    assert len(got) == len(URLS) + 2
    assert all(r.verdict == (expected(r.url)[3] or r.verdict) and r.verdict in ("allow", "block") for r in got)
    assert judged(pages.limit(0), texts).count() == 0


def test_segments_use_the_counts_of_all_words(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(3000)})
    texts = spark.createDataFrame([(" ".join(rng.choices(words, k=40)).upper(),) for _ in range(400)], "t string").repartition(5)
    rows = [("".join(rng.choices(words, k=3)) + ".7x.", "/" + rng.choice(words) + "/" + "".join(rng.choices(words, k=2)) + "12é") for _ in range(60)] + [("", ""), ("..", "/9")]
    model = unigrams(texts)
    counts = {r.w: r.n for r in model.collect()}
    assert len(counts) > 2000 and counts["casino"] == 2
    own, find = Segmenter(sum(counts.values())), re.compile(r"[^\W\d_]+|\d+").findall
    cut = lambda t: [w for run in find(t) for w in (["#"] if run[0].isdigit() else own.split(run, counts))]
    got = {(r.host, r.path): (r.host_words, r.path_words) for r in tokens(spark.createDataFrame(rows, "host string, path string").distinct(), model).collect()}
    assert got == {(h, p): (cut(h), cut(p)) for h, p in rows}


def test_odds_equal_a_naive_bayes_by_hand(spark):
    rows = [("a", "/x", ["casino", "win"], ["deal"], 3), ("b", "/y", ["garden"], ["visit", "deal"], 5), ("c", "/z", [], [], 2), ("d", "/w", ["win"], ["#"], 1)]
    cut = spark.createDataFrame(rows, "host string, path string, host_words array<string>, path_words array<string>, n long")
    by = {0: {}, 1: {}}
    pages = [0, 0]
    for _, _, h, p, n in rows:
        y = int("casino" in h)
        pages[y] += n
        for w in [f"h:{x}" for x in h] + [f"p:{x}" for x in p]:
            by[y][w] = by[y].get(w, 0) + n
    v = len(set(by[0]) | set(by[1]))
    say = lambda y, w: math.log((by[y].get(w, 0) + 1) / (sum(by[y].values()) + v + 1))
    for r in odds(cut).collect():
        _, _, h, p, _ = next(x for x in rows if x[0] == r.host)
        want = math.log(pages[1] + 1) - math.log(pages[0] + 1) + sum(say(1, w) - say(0, w) for w in [f"h:{x}" for x in h] + [f"p:{x}" for x in p])
        assert math.isclose(r.log_odds, want)
