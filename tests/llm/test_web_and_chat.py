import random
from collections import Counter

from caseforge.llm import chat_format, html_extract, url_filter
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>First   <b>bold</b> words.</p><p>Short.</p><aside>side</aside><form>mail <input></form>
<p>Second&nbsp;paragraph that goes on for a while, as articles do.</p><div class="comments"><p>I disagree with all of it, at length and with passion.</p></div></article><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head & line\n\nFirst bold words.\n\nShort.\n\nSecond paragraph that goes on for a while, as articles do."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>only</nav>") == ""
    plain = "<body><header>site</header><div id='nav'>menu one</div><div>" + "".join(f"<p>Paragraph {i} has a good number of words in it, so it reads as content.</p>" for i in range(5)) + "<p>End.</p></div><div class='sidebar'>links</div></body>"
    assert html_extract.main_text(plain).split("\n\n")[-1] == "End." and html_extract.main_text(plain).count("Paragraph") == 5
    assert html_extract.main_text("<article><p><b>open<br><p>next &am").split("\n\n") == ["open", "next &am"]
    assert html_extract.main_text("<article>" + "<p>word " * 3000).count("word") == 3000


def test_nothing_of_the_content_is_dropped():
    long = "{} has a good number of words in it, so that it reads as content of the page."
    p = lambda k: f"<p>{long.format(k)}</p>"
    body = p("Lead") + "<ul><li>First item</li><li>Second item</li></ul><blockquote>" + p("Quote") + "</blockquote><pre>x = 1</pre><table><tr><td>cell a</td><td>cell b</td></tr></table><section><h2>Part one</h2>" + p("One") + "</section><section>" + p("Two") + "<div>" + p("Inner") + "</div></section>"
    want = [long.format("Lead"), "First item", "Second item", long.format("Quote"), "x = 1", "cell a", "cell b", "Part one", long.format("One"), long.format("Two"), long.format("Inner")]
    got = lambda html: html_extract.main_text(html).split("\n\n")
    menu = "<div id=nav><a href=/>menu</a></div><div><a href=/x>x</a> <a href=/y>y</a> <a href=/z>z</a></div>"
    assert got(f"<body>{menu}<div id=content>{body}</div><footer>me</footer></body>") == want
    assert got(f"<body>{menu}<div><div id=content><h1>Head</h1><div>{body}</div></div></div></body>") == ["Head", *want]
    assert got(f"<body>{menu}<main><h1>Head</h1>{p('Top')}<article>{body}</article><p>End.</p></main></body>") == ["Head", long.format("Top"), *want, "End."]
    assert got(f"<body>{menu}<article>{body}</article><article>{p('More')}</article></body>") == [*want, long.format("More")]
    assert got(f"<body>{menu}<article><a href=/t>Teaser</a></article><div>{body}</div></body>")[-len(want):] == want


def test_names_within_an_article_and_elements_never_closed():
    long = "{} has a good number of words in it, so that it reads as content of the page."
    p = lambda k: f"<p>{long.format(k)}</p>"
    got = lambda html: html_extract.main_text(html).split("\n\n")
    named = ['id="comments-on-the-act"', 'class="social history"', 'class="notice-period"', 'id="reply-of-the-king"', 'class="menu-engineering"']
    body = p("Lead") + "".join(f"<div {n}>{p(f'Part {k}')}</div>" for k, n in enumerate(named))
    want = [long.format("Lead"), *(long.format(f"Part {k}") for k in range(len(named)))]
    assert got(f"<body><article>{body}</article></body>") == want == got(f"<body><main>{body}</main></body>")
    gone = "".join(f'<div class="{c}">{p("Gone")}</div>' for c in ("comments", "comment-list", "ad slot", "ads", "newsletter", "sidebar", "alert"))
    linked = '<div class="social-work">' + "".join(f'<a href="/{k}">link number {k}</a> ' for k in range(9)) + "</div>"
    assert got(f"<body><article>{body}{gone}{linked}</article></body>") == want
    # Out elements that are never closed end where the article begins; closed ones don't.
    menu = '<ul><li><a href="/">menu</a></li></ul>'
    for opened in ("<nav>", '<div class="menu">', "<header><nav>", "<form>"):
        assert got(f"<body>{opened}{menu}<article>{body}</article><footer>me</footer></body>") == want
        assert got(f"<body>{opened}{menu}<main>{body}</main>") == want
    assert got(f"<body><article>{body}</article><aside><article>{p('Teaser')}</article></aside></body>") == want
    assert got(f"<body><nav>{menu}<nav>{menu}</nav><article>{body}</article></body>") == want


def test_deep_and_broken_pages_take_linear_time():
    import time

    for piece in ("<div>x", "<b>x", "<div class=ad>x</section>", "</div>x", "<p>x<i>", "<h1>x", "<nav><article>x", "<ul><li>x"):
        html_extract.main_text(piece * 500)
        took = []
        for n in (4000, 16000):
            began = time.process_time()
            html_extract.main_text(piece * n)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.5, piece


def made_page(r):
    """A page without ``article``, its content's blocks: lists, quotes, tables, code, sections and blocks with misleading names."""
    say = lambda n: " ".join(f"{r.choice(['water', 'stone', 'light', 'river', 'garden'])}{r.randrange(90)}" for _ in range(n)) + "."
    blocks, html = [], []

    def add(form, *texts):
        blocks.extend(texts)
        html.append(form.format(*texts))

    for _ in range(r.randrange(6, 14)):
        kind = r.randrange(8)
        if kind < 3:
            add("<p>{}</p>", say(r.randrange(30, 70)))
        elif kind == 3:
            add("<ul><li>{}</li><li>{}</li></ul>", say(r.randrange(6, 20)), say(r.randrange(6, 20)))
        elif kind == 4:
            add("<blockquote><p>{}</p></blockquote>", say(r.randrange(20, 40)))
        elif kind == 5:
            add("<table><tr><td>{}</td><td>{}</td></tr></table>", say(5), say(5))
        elif kind == 6:
            add("<section><h2>{}</h2><p>{}</p></section>", say(4), say(r.randrange(30, 60)))
        else:
            add('<div class="' + r.choice(["related-work", "side-effects", "search-methods"]) + '"><p>{}</p></div>', say(r.randrange(30, 60)))
    blocks.append(say(40))
    html.append(f"<p>{blocks[-1]}</p>")
    wrap = r.choice(["<div>{}</div>", '<div id="content"><div>{}</div></div>', "<main>{}</main>"])
    links = "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(r.randrange(4, 9)))
    rest = r.choice(['<div class="comments"><p>A reader says: ' + say(20) + "</p></div>", '<div class="ad">' + say(8) + "</div>", ""])
    page = f"<html><head><title>t</title></head><body><nav><ul>{links}</ul></nav>{wrap.format(''.join(html))}{rest}<div class=\"related\"><ul>{links}</ul></div><footer>(c) {say(6)}</footer></body></html>"
    return page, blocks


def test_all_content_of_made_pages_and_nothing_else():
    r = random.Random(12)
    for _ in range(150):
        page, blocks = made_page(r)
        assert html_extract.main_text(page).split("\n\n") == blocks


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    r = html_extract.extracted(pages.withColumn("text", F.lit(1))).collect()
    assert len(r) == pages.count() and all(x.n_chars == len(x.text) > 0 and "<" not in x.text.replace("&lt;", "") for x in r)
    bad = spark.createDataFrame([(1, None, None), (1, "u", "")], "page_id long, url string, html string")
    assert [x.text for x in html_extract.extracted(bad).collect()] == ["", ""]
    assert html_extract.extracted(pages.limit(0)).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
    fits = [r for _, r in url_filter.RULES if (h := r.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


URLS = [None, "", "no scheme.com/en/", "https://A.Example.COM/en/7x?y#z", "http://example.com/en/8", "http://xexample.com/en/", "ftp://q.net/de/81", "http://example.net/de/8", "http://example.org?es/", "http://b.org/es/#f", "http://com/en/", "x://y://com/en/", "http://h#/en/"]


def test_rules(spark):
    p = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    r = {x.page_id: x for x in url_filter.judged(p).collect()}
    said = {r: v for v, r in url_filter.RULES}
    for i, u in enumerate(URLS):
        host, path, rule = brute_rule(u)
        assert (r[i].host, r[i].path, r[i].rule) == (host, path, rule), u
        assert r[i].verdict == said.get(rule, r[i].verdict) and r[i].verdict in ("allow", "block")
    assert url_filter.judged(p.limit(0)).count() == 0


def test_listed_verdicts(spark):
    want = {"http://a.com/en/1": "block", "http://example.com/en/71": "allow", "http://q.net/de/81": "allow", "http://example.net/de/7": "allow", "http://www.example.net/de/8": "block", "http://b.org/es/": "block"}
    p = spark.createDataFrame(list(want.items()), "url string, want string")
    assert {x.page_id: x.verdict for x in url_filter.judged(p, page_id="url").collect()} == want


def test_trees_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    labelled = pages.select("url", url_filter.seed_label(url_filter.host_of(F.col("url"))).alias("label"), (F.pmod(F.xxhash64("url"), F.lit(2)) == 0).alias("train"))
    model = url_filter.UrlModel(labelled.filter("train"))
    r = model.block_probability(url_filter.lexical(labelled.filter("not train"), "url")).selectExpr("avg(cast((p_block >= 0.5) = (label = 1) as int)) as right", "avg(case when label = 1 then cast(p_block >= 0.5 as int) end) as caught").first()
    assert r.right > 0.98 and r.caught > 0.8


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye <|im_end|>"),
    (3, 5, "user", "hi"), (3, 9, "assistant", "hello"), (3, 11, "user", "bye <|im_end|>"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
    (5, 0, "user", None), (6, 0, None, ""), (7, None, "user", "q"), (7, 1, "user", "p"), (8, 0, "user", "hi"),
]


def brute_chats(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    said = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in by.items()}
    prefixes = {s[:k] for s in said.values() for k in range(1, len(s))}
    same = Counter(said.values())
    first = {s: min(c for c in said if said[c] == s) for s in said.values()}
    return sorted((c, len(s), same[s]) for s, c in first.items() if s not in prefixes)


def test_chats(spark):
    d = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(4)
    r = chat_format.rendered(d).collect()
    assert sorted((x.conv_id, x.n_turns, x.n_same) for x in r) == brute_chats(CHATS)
    two = next(x.chat for x in r if x.conv_id == 2)
    assert two == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye < |im_end|><|im_end|>\n"
    assert chat_format.rendered(d.limit(0)).count() == 0
    more = d.withColumn("a", F.lit(1)).withColumn("b", F.lit(2)).withColumn("place", F.lit(3))
    assert chat_format.rendered(more).count() == len(r)
