from collections import Counter

from descra.llm import html_template as ht

EMPTY = ht.Template(None, None, 0)


def test_main_text_of_single_pages():
    page = (
        '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav>'
        '<header>site</header><div class="cookie-notice">we use</div><!-- <p>c</p> --><div class="ad">buy</div><article><header><h1>Head &amp; line</h1></header><p><b>One<br>two <i>th</i>ree<p>Four&nbsp;&#233;\n five</p>'
        '<div class="share-box">share</div><form>f<input></form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>a < b &am<section id="comments"><p>reader</section></article>'
        '<aside>side</aside><section class="comments"><article>reader</article></section><footer>&copy; foot</footer></body></html>'
    )
    assert ht.main_text(page, EMPTY) == "Head & line\nOne two three\nFour é five\na\nb\nc\nd\na < b &am"
    assert ht.main_text("", EMPTY) == ""
    assert ht.main_text("plain &lt;text&gt;", EMPTY) == "plain <text>"
    assert ht.main_text("<article><p>cut &amp", EMPTY) == "cut &"
    assert ht.main_text("<div><p>a<div class='ad'>x</div>b</div><footer>f", EMPTY) == "a\nb"
    assert ht.main_text("<article>" + "<p>x</p>" * 20000, EMPTY).count("x") == 20000


def test_template_decides_the_article(spark):
    page = lambda i: f'<html><body><div class="top">Always here</div><div class="body"><p>text {i}</p></div><div class="end">Always there</div></body></html>'
    rows = [(i, "http://h.example/" + str(i), page(i), "x") for i in range(20)]
    rows += [(100, None, None, "x"), (101, "http://lone.example/", "<article>only</article>", "x"), (101, "http://lone.example/", "<article>only</article>", "x"), (None, "bad url", "<p>q</p>", "x")]
    rows += [(200 + i, "http://same.example/", "<article><p>copy</p></article><footer>f</footer>", "x") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in ht.extract(df).collect())
    want = Counter((i, u, t, len(t)) for i, u, t in [*((i, "http://h.example/" + str(i), f"text {i}") for i in range(20)), (100, None, ""), (101, "http://lone.example/", "only"), (101, "http://lone.example/", "only"), (None, "bad url", "q"), *((200 + i, "http://same.example/", "copy") for i in range(12))])
    assert got == want
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in ht.extract(df, broadcast_bytes=0).collect()) == want
    assert ht.extract(df.limit(0)).count() == 0


def test_classes_share_occurrence_vectors(spark):
    html = ["<ul><li>a</li><li>b</li></ul><i>x</i>", "<ul><li>c</li></ul>", "<ul></ul><i>y</i>"]
    df = spark.createDataFrame([("h", i, x) for i, x in enumerate(html)], "host string, page long, html string")
    got = {}
    for r in ht.classes(df, support=0).collect():
        got.setdefault(r["class"], set()).add(r.token)
    vector = {}
    for x in {t for p in html for t in ht.page_tokens(p)}:
        vector.setdefault(tuple(ht.page_tokens(p)[x] for p in html), set()).add(ht.token_hash(x))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for k, v in vector.items() if sum(n > 0 for n in k) >= 2)


def test_classes_decide_inside_the_article(spark):
    page = lambda i: f'<article><h1>Head {i}</h1><div class="zq"><p>Read us daily</p></div><p>text {i}</p><p>Written by staff</p></article>'
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in ht.extract(df).collect()} == {i: f"Head {i}\ntext {i}" for i in range(12)}
    # An empty template keeps what the host's template takes.
    assert ht.main_text(page(1), EMPTY) == "Head 1\nRead us daily\ntext 1\nWritten by staff"


def test_names_inside_an_article_need_the_template(spark):
    kept = (
        '<div class="article-header"><h1>Head</h1></div><h2 id="related-work">Related</h2><section id="search-methods"><p>search</p></section>'
        '<section id="social-history">social</section><div id="form-and-function">form</div><div class="section-header">part</div>'
        '<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be<p><object data="f"><param name="a">shown</object><svg/><p>a<canvas><p>b<svg><p>end</article>'
    )
    want = "Head\nRelated\nsearch\nsocial\nform\npart\nLet x=2 be\nshown\na\nb\nend"
    assert ht.main_text("<article>" + kept, EMPTY) == want
    assert ht.main_text('<h2 id="related-work">a</h2><div class="entry-header">b</div><div class="site-header">c</div>', EMPTY) == "a\nb"
    page = lambda i: f'<article><p>text {i}</p><div class="share-box">share {i}</div>' + (f'<div class="search-history">own {i}</div>' if i == 3 else "") + "</article>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in ht.extract(df).collect()} == {i: f"text {i}" + ("\nown 3" if i == 3 else "") for i in range(6)}


def test_an_article_of_its_own_id_is_kept(spark):
    page = lambda i: f'<html><body class="postid-{i}"><article class="teaser"><p>teaser</p></article><article id="post-{i}" class="post-{i} about-{"abc"[i % 3]}"><div class="zq">Read us</div><p>text {i}</p></article></body></html>'
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in ht.extract(df).collect()} == {i: f"text {i}" for i in range(12)}
    # An article that only one page has stands beside the one that the template holds.
    other = lambda i: f'<main><p>main {i}</p></main>' + ("<article><p>real</p></article>" if i == 3 else "")
    df = spark.createDataFrame([(i, f"http://h.example/{i}", other(i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in ht.extract(df).collect()} == {i: f"main {i}" + ("\nreal" if i == 3 else "") for i in range(12)}


def test_one_support_at_every_size_of_host(spark):
    page = lambda i: f'<div class="top">Always here</div><div class="body"><p>text {i}</p></div>'
    rows, want = [], {}
    for size in (1, 2, 3, 5, 7, 8, 20):
        for i in range(size):
            rows.append((size * 100 + i, f"http://h{size}.example/{i}", page(i)))
            want[size * 100 + i] = f"text {i}" if size > 1 else f"Always here\ntext {i}"
    # Pages that have no tokens do not count, and one that has other tokens does not undo a template.
    rows += [(2050, "http://h20.example/null", None), (2051, "http://h20.example/empty", " "), (2052, "http://h20.example/error", "<p>error")]
    rows += [(250 + i, "http://h2.example/empty", "<!-- -->") for i in range(9)]
    want |= {2050: "", 2051: "", 2052: "error"} | {250 + i: "" for i in range(9)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in ht.extract(df).collect()} == want
    assert {r.page_id: r.text for r in ht.extract(df, broadcast_bytes=0).collect()} == want


def test_classes_of_repeated_pages_by_brute_force(spark):
    # Tokens of different pages, each page present twice, are not one class.
    html = {1: "<div><p>a</p><p>b</p><p>same</p></div>", 2: "<div><p>c</p><p>d</p><p>same</p></div>", 3: "<div><p>a</p><p>c</p><p>same</p></div>"}
    rows = [(k, f"http://h/{k}", html[k]) for k in (1, 1, 2, 2, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("'h' AS host", "xxhash64(page_id, url) AS page", "html")
    got = {}
    for r in ht.classes(pages, support=0.0).collect():
        got.setdefault(r["class"], set()).add(r.token)
    vectors = {}
    for n, (k, _, text) in enumerate(rows):
        for t, c in ht.page_tokens(text).items():
            vectors.setdefault(t, {})[n] = c
    want = {}
    for t, v in vectors.items():
        if len(v) > 1:
            want.setdefault(tuple(sorted(v.items())), set()).add(ht.token_hash(t))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_headlines_in_headers_of_articles_stay(spark):
    empty = ht.Template(None, None, 0)
    for name in ("article-header", "header", "entry-header", "post-header"):
        assert ht.main_text(f'<article><header class="{name}"><h1>Title</h1></header><p>body</p></article>', empty) == "Title\nbody"
