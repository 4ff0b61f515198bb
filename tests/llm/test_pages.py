import html
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import html_text, url_cascade
from gneiss.llm.queries import URL_RULES

URLS = [None, "", "nothing", "http://", "https://Www.Example.com/en/x?y#z", "http://a.example.com/en/", "http://example.com/en", "http://example.net/es/1", "http://net/fr/?q=/es/", "ftp://x.COM", "http://x.com/", "http://xnet/es/", "a://b://c.com/d", "http://com#f/", "http://www.example.com/en/a://", "http://example.com:80/en/", "http://..net/es/", "http://é.net/es/é"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_verdicts_against_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, key string, one string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judged(df, URL_RULES).collect()}
    assert got == {i: brute(u) for i, u, *_ in rows}
    assert url_cascade.judged(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_cascade.judged(df, []).collect()} == {"allow"}


@pytest.mark.parametrize("every", [2, 7, 1000, 5000])
def test_cascade_is_exact_over_its_universe(spark, every):
    df = spark.range(5000).select(F.xxhash64("id").alias("one"), F.xxhash64("id", F.lit(1)).alias("two"), "id")
    levels = url_cascade.cascade(df.where(f"id % {every} = 0").select("one", "two"), df.select("one", "two"), 5000)
    rows = df.toPandas()
    assert (url_cascade.member(levels, *(rows[c].to_numpy().view(np.uint64) for c in ("one", "two"))) == (rows["id"] % every == 0)).all()
    # All levels together stay within the bits that the list's length gives.
    assert sum(f.bits for f in levels) <= 5000 / every * (1.45 * np.log2(2 * every) + 3 * url_cascade.BITS_PER_KEY) + 64 * 8


HEAD = "<!DOCTYPE html><html><head><title>T t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
NAV = '<nav><ul><li><a href="/x">Menu</a></li><li><a href="/y">Other</a></li></ul></nav>'
BODY = "<h1>Big&nbsp;title</h1><p>One &amp; <b>t</b>wo<br>three  words</p><p>Four <a href='/l'>linked</a> five"
WANT = "Big title One & two three words Four linked five"
CASES = [
    (f"{HEAD}{NAV}<div class=\"ad\">Buy now</div><article>{BODY}</article><footer>&copy; foot</footer></body></html>", WANT),
    (f"{HEAD}<header>Site name</header>{NAV}<main>{BODY}</main><aside>More of it</aside></body>", WANT),
    (f"{HEAD}<article>{BODY}<form><input>Sign up</form><div id=comments><p>first!</p></div></article></body>", WANT),
    (f"{HEAD}<div class='cookie-notice'>We use cookies</div><div>{BODY}</div><div class=sidebar><p>side</p></div>", WANT),
    (f"{HEAD}<article>{BODY}<!-- hidden > words --><p hidden>no</p></article>", WANT),
    ("plain words only", "plain words only"),
    ("<p>a &lt; b &#233; &bogus;", "a < b é &bogus;"),
    ("<nav>only menu</nav>", ""),
    ("<p>open <b attr='>'>quoted", "open quoted"),
    ("a < b and c", "a < b and c"),
    ("", ""),
    (None, ""),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "u", h, "t") for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extracted(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(CASES)}
    assert html_text.extracted(df.limit(0)).count() == 0


WRAPPED = [
    (f'<body><div class="site has-sidebar">{BODY}</div>', WANT),
    (f'<body><div class="side-by-side">{BODY}</div>', WANT),
    (f'<body><article><div class="comments-open">{BODY}</div></article>', WANT),
    (f'<body class="menu-open"><div class="menu-open">{BODY}</div>', WANT),
    (f'<body><article>{BODY}<section id="recommended-settings"><p>six seven</p></section></article>', WANT + " six seven"),
    (f'<body><article><header class="entry-header"><h1>Head line</h1></header>{BODY}</article>', "Head line " + WANT),
    (f'<article>{BODY}<p class="legal-text">six seven</p></article>', WANT + " six seven"),
    (f'<body><form id="whole">{NAV}<div>{BODY}</div></form>', WANT),
    (f'<body><div class="page has-sidebar"><div class=sidebar><p>not this one</p></div><div id="content" class="no-comments">{BODY}</div></div>', WANT),
    (f'<div class="comments"><article>{BODY}</article></div>', WANT),
    ('<p><a href="/hidden-gems" data-hidden="false">Gems</a> are here</p>', "Gems are here"),
]


def pages_weights():
    import duckdb

    pages = [h for (h,) in duckdb.sql("SELECT html FROM read_parquet('/root/testdata/sf0.01/pages.parquet') ORDER BY page_id").fetchall()]
    counts = Counter()
    for h in pages[:100]:
        html_text.count(h, counts)
    return html_text.fitted(counts), pages[100:]


def test_wrappers_keep_their_text():
    for weights in (html_text.fitted({}), pages_weights()[0]):
        assert [html_text.Page(h).main(weights) for h, _ in WRAPPED] == [w for _, w in WRAPPED]


def test_articles_without_their_names():
    """Pages that the weights have not seen, with all telling tags and names replaced: the scan alone finds the article."""
    weights, pages = pages_weights()
    names = {"<article>": '<div class="k1">', "</article>": "</div>", 'class="ad"': 'class="z9"', "<footer>": "<div>", "</footer>": "</div>", "<nav>": '<div id="n7">', "</nav>": "</div>"}
    for h in pages:
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", h, re.S)[1])
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert html_text.Page(h).main(weights) == want
        for a, b in names.items():
            h = h.replace(a, b)
        assert html_text.Page(h).main(weights) == want


def test_best_run_against_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        parts = [(f"<{t}>" + f"w{i} " * rnd.integers(0, 4) + f"</{t}>") for i, t in enumerate(rnd.choice(["p", "div", "td", "span"], 7))]
        page = html_text.Page("".join(parts))
        weights = html_text.fitted({}) | {"in div": -0.7, "in td": float(rnd.uniform(-1, 1)), "in p": 0.8, "tag p": -1.0, "tag div": float(-rnd.random())}
        got = page.main(weights)
        scores = [weights.get("tag " + name, weights["tag"]) if name is not None else page._score(x, weights) for name, x in page.tokens]
        runs = [(sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        top = max(runs, default=(0,))
        if top[0] <= 1e-9:
            assert got == ""
            continue
        begin, end = next((-i, -j) for t, i, j in sorted(runs, reverse=True) if t > top[0] - 1e-9)
        words = [w for name, x in page.tokens[begin:end] if name is None for t, *_ in x[1] for w in t.split()]
        assert got.split() == words


@pytest.mark.parametrize("source", ["<b>" * 10_000 + "</i>" * 10_000 + "x", "<p><div>" + "<b>" * 20_000 + "<p>x" * 20_000, '<a ">x' * 40_000, "<a " * 40_000, '<div class="ad x">' * 40_000 + "x"])
def test_stray_tags_take_linear_time(source):
    weights = html_text.fitted({})
    began = time.process_time()
    html_text.Page(source).main(weights)
    assert time.process_time() - began < 10


def test_long_page_and_best_run():
    weights = html_text.fitted({})
    long = "<article>" + "<p>word word word</p>" * 50_000 + "</article>"
    assert len(html_text.Page(long).main(weights).split()) == 150_000
    assert html_text.Page("<nav>" + "m " * 50 + "</nav><p>x</p><nav>" + "m " * 50 + "</nav><p>main text here</p>").main(weights) == "main text here"
