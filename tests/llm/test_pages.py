from galeledger.llm.pages import aligned, below, blocks, content_root, extract, matched, parsed, skeleton, tree


def text_of(page):
    return [b for _, void, _, b in blocks(parsed(page)) if not void]


def test_blocks_and_roles():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="ad">Buy</div><div id='cookie-notice'>OK?</div>
    <article class="post"><h1>Title &amp; more</h1><p>One <b>two</b><br>three&nbsp;four<p>five &lt;six&gt; <span class="ads">Ad</span> seven
    <ul><li>a<li>b</ul><!-- <p>gone</p> --><form><p>form</p><input value="x"></form><pre>x
      y</pre><div hidden>h</div><div style="display: none">n</div><aside>side</aside></article>
    <div class="comments"><p>Nice!</p></div><footer>&copy; F</footer></body></html>"""
    assert text_of(page) == ["Title & more", "One two three four", "five <six>", "seven", "a", "b", "x y"]


def test_broken_markup():
    assert text_of("<p>a<p>b</div>c") == ["a", "bc"] or text_of("<p>a<p>b</div>c") == ["a", "b", "c"]
    assert text_of("no markup at all") == ["no markup at all"]
    assert text_of("") == [] and text_of("<") == ["<"] and text_of("a < b and <b>c") == ["a < b and c"]
    assert text_of("<article><p>x</article><script>never closed") == ["x"]
    assert text_of("<div>" * 3000 + "deep") == ["deep"]


def test_matching_keeps_order_and_parents():
    a, b = tree("html(body(nav()article(h1()p())footer()))"), tree("html(body(div()article(p()p2())footer()))")
    names = {a[x][0]: b[y][0] for x, y in matched(a, b).items()}
    assert names == {"": "", "html": "html", "body": "body", "article": "article", "p": "p", "footer": "footer"}
    assert matched(tree("a()b()"), tree("b()a()")).keys() != {0, 1, 2}
    shape = "html(body(div.x(p())))"
    path = [0]
    for label in ("html", "body", "div.x", "p"):
        path.append(below(path[-1], label))
    assert aligned(shape, shape) == {p: i for i, p in enumerate(path)}


def test_root_is_the_container_of_the_text():
    shape = "html(body(div.top(p())div.mid(h2()p())div.low(p())))"
    nodes = [label for label, _ in tree(shape)]
    assert nodes[content_root(shape, {nodes.index("p"): 10.0, 7: 900.0, 6: 50.0})] == "div.mid"
    assert content_root("html(body(p()))", {}) == 0


def test_constant_nodes_of_a_host_are_template(spark):
    page = lambda i: f"<html><body><div class='top'>Welcome to our site</div><div class='main'><h2>Title {i}</h2><p>Body of page {i}, a text of its own.</p><p>Shared.</p><div class='end'>Thank you for reading</div></div></body></html>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(40)] + [(99, "http://b.org/", "<p>only one &amp; alone</p>"), (100, None, None), (100, "http://a.org/x", ""), (None, "bad", "<b>x</b>")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): r for r in extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        r = got[i, f"http://a.org/{i}"]
        assert r.text == f"Title {i}\n\nBody of page {i}, a text of its own.\n\nShared." and r.n_chars == len(r.text)
    assert got[99, "http://b.org/"].text == "only one & alone"
    assert got[100, None].text == "" and got[100, "http://a.org/x"].text == "" and got[None, "bad"].text == "x"
    assert extract(df.limit(0)).count() == 0


def test_driver_pages(spark):
    import html
    import re
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in df.collect()}
    for r in extract(df).collect():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.DOTALL)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x)


def test_deep_and_broken_pages_end(spark):
    import time

    deep = "<html><body>" + "<div>" * 5000 + "<p>deep text here</p>" + "</div>" * 5000 + "</body></html>"
    marks = "<p>" + "<b>" * 5000 + "bold text" + "</b>" * 5000 + "</p>"
    broken = ["<a " * 350_000, "<p>seen</p>" + '<a "' * 250_000 + ">", "<" * 500_000, "<!--" * 250_000, "<p title='x>one</p><p>two</p>", "<p>three</p><!-- open"]
    rows = [(k, f"http://h{k}.org/", t) for k, t in enumerate([deep, marks, *broken])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    start = time.time()
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert time.time() - start < 60
    assert got[0] == "deep text here" and got[1] == "bold text" and got[3].startswith("seen") and got[7] == "three"
    assert "two" in got[6]


def test_template_of_small_hosts(spark):
    page = lambda k, i: (f"<html><body><div class='top'>Welcome to host {k}</div><div class='main'><h2>Title {i}</h2><p>Body of page {i}, a text of its own.</p>"
                         "<div class='end'>Thank you for reading</div></div></body></html>")
    article = "<html><body><div class='main'><h2>One title</h2><p>One and the same long text of an article that stands on two pages.</p><p>{}</p></div></body></html>"
    rows = [(f"http://h{k}.org/{i}", page(k, i)) for k in (2, 5, 15, 40) for i in range(k)]
    rows += [(f"http://copies.org/{i}", page(7, 1)) for i in range(100)] + [("http://copies.org/other", page(7, 2))]
    rows += [("http://twins.org/a", article.format("Monday")), ("http://twins.org/b", article.format("Tuesday")), ("http://alone.org/", page(1, 3)), ("http://same.org/1", page(1, 4)), ("http://same.org/2", page(1, 4))]
    got = {r.url: r.text for r in extract(spark.createDataFrame([(j, *r) for j, r in enumerate(rows)], "page_id long, url string, html string").repartition(6)).collect()}
    for k in (2, 5, 15, 40):
        assert all(got[f"http://h{k}.org/{i}"] == f"Title {i}\n\nBody of page {i}, a text of its own." for i in range(k)), k
    assert got["http://copies.org/5"] == "Title 1\n\nBody of page 1, a text of its own." and got["http://copies.org/other"] == "Title 2\n\nBody of page 2, a text of its own."
    assert "One and the same long text" in got["http://twins.org/a"] and "Tuesday" in got["http://twins.org/b"]
    assert "Body of page 3" in got["http://alone.org/"] and "Body of page 4" in got["http://same.org/1"]
