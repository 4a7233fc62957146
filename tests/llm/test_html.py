import random

from reconlink.llm import html_extract as H


def test_parts_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
    <body class="has-sidebar"><header class="site-header"><h1>Site</h1><nav><ul><li><a href="/a">Home</a></li></ul></nav></header>
    <div id="cookie-notice"><p>We use cookies, and you should accept all of them right now.</p></div><!-- <p>hidden</p> -->
    <main><article><h1>Title &amp; more</h1><p>First\n  <b>bold</b> and a&nbsp;<a href="q">link</a>.<br>Next line.<p>Second, unclosed
    <div class="ad">Buy our things today, they are very good things.</div><ul><li>one</li><li>two</li></ul>
    <form><p>Your mail address please, to get the newsletter.</p><input></form></article>
    <section id="comments"><article><p>Great article, thank you so much for writing it.</p></article></section></main>
    <aside><p>Popular posts that everybody reads all of the time.</p></aside><footer>&copy; 2020 Site</footer></body></html>"""
    assert H.main_text(page) == "Title & more\n\nFirst bold and a link. Next line.\n\nSecond, unclosed\n\none\n\ntwo"


def test_odd_pages():
    assert H.main_text("") == "" and H.main_text("plain words") == "plain words" and H.main_text("<p></p> <script>x") == ""
    assert H.main_text("<article><p>cut off in a <a href='x") == "cut off in a"
    assert H.main_text("</div></p><p>stray <i>ends</b></p>") == "stray ends"
    long = H.main_text("<article>" + "<p>some words here.</p>" * 5000 + "</article>")
    assert long.count("\n\n") == 4999
    assert H.main_text("<div>" * 3000 + "deep text.") == "deep text."


def brute_cut(own, edges):
    """Least cost over all labellings."""
    best = None
    for mask in range(1 << len(own)):
        label = [bool(mask >> i & 1) for i in range(len(own))]
        cost = sum(H.soft(-s) if x else H.soft(s) for s, x in zip(own, label)) + sum(w for (i, j), w in edges.items() if label[i] != label[j])
        best = min(best, cost) if best is not None else cost
    return best


def test_cut_has_the_least_cost():
    rnd = random.Random(6)
    for _ in range(150):
        n = rnd.randint(1, 9)
        own = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): rnd.uniform(0.1, 2.5) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5}
        label = H.cut(own, edges)
        cost = sum(H.soft(-s) if x else H.soft(s) for s, x in zip(own, label)) + sum(w for (i, j), w in edges.items() if label[i] != label[j])
        assert cost <= brute_cut(own, edges) + 1e-6


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>a text.</p>", "x"), (1, "u", "<p>a text.</p>", "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id long, url string, html string, text string")
    rows = H.extract(df).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, "u", "a text.", 7)] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert H.extract(df.where("page_id = 9")).collect() == []
