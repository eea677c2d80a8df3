"""Wrapper inference and extraction on written pages."""

import random
import sys

from verisieve.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body>
<header class="site"><div>Site name</div></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="ad banner">Buy this</div><div id="cookie-notice">We use cookies</div>
<div id="wrap"><div class="sidebar">Side</div><div class="content"><h1>{title}</h1>{paras}<div class="comments"><p>First!</p></div></div></div>
<form><p>Your mail</p><input name=q></form><footer>&copy; me</footer></body></html>"""


def page(title, *paras):
    return PAGE.format(title=title, paras="".join(paras))


def test_article_without_boilerplate():
    text = w.extract(page("A &amp; B", "<p>One <b>bold</b>\n  word&nbsp;here<p>Two<br>lines &lt;x&gt;", "<ul><li>a<li>b</ul>"), None)
    assert text == "A & B\nOne bold word here\nTwo lines <x>\na\nb"


def test_semantic_article_and_cut_markup():
    html = "<body><main><article><header><h1>Head</h1></header><p>Text &amp copy</p><aside>note</aside><section id='comments-1'>bad</section></article></main><p>x</p>"
    assert w.extract(html, None) == "Head\nText & copy"
    assert w.extract("<article><p>open <b>never closed <div>deeper", None) == "open never closed\ndeeper"
    assert w.extract("just text", None) == "just text" and w.extract("", None) == "" and w.extract(None, None) == ""
    assert w.extract("<p>a < b and <a title='x>y'>c</a> <3</p>", None) == "a < b and c <3"
    assert w.extract("<article><p>x</p></article><script>never closed <p>no</p>", None) == "x"


def test_headers_of_pages_and_of_articles():
    html = '<div class="site-header"><p>Site</p></div><div class="post"><div class="entry-header"><h1>Title</h1></div><p>Body of some length here</p></div>'
    assert w.extract(html, None) == "Title\nBody of some length here"
    assert w.extract('<article><div class="header"><h1>T</h1></div><p>x</p><div class="ad-box">buy</div><div role="navigation">n</div></article>', None) == "T\nx"
    assert w.extract('<article><p>headers and addresses, advert for words</p><div class="adventure">kept</div></article>', None) == "headers and addresses, advert for words\nkept"


def test_alignment_yields_optional_and_repeated_groups():
    a, b = (w.folded(w.parse(p)) for p in ("<body><h1>A</h1><h2>x</h2><p>1</p><h2>y</h2><p>2</p>", "<body><h1>A</h1><blockquote>q</blockquote><h2>x</h2><p>3</p><h2>z</h2><p>4</p>"))
    assert w.expression(w.merged(a, b)) == "<><body><h1>=</> <blockquote>=</>? (<h2>#</> <p>#</>)+</></>"


def of_host(pages):
    sys.setrecursionlimit(1_000_000)  # as tasks do
    known = None
    for p in pages:
        x = w.folded(w.parse(p))
        known = x if known is None else w.merged(known, x)
    assert w.restored(w.packed(known)) == known
    return w.Wrapper(known)


def test_pages_are_matched_against_the_expression_and_keep_constant_blocks():
    pages = [page(f"Title {i}", f"<p>Body {i} with some words of its own</p>", '<p class="byline">Written for you</p>') for i in range(8)]
    assert w.extract(pages[3], of_host(pages)) == "Title 3\nBody 3 with some words of its own\nWritten for you"
    article = "<nav>x</nav><article><h1>{}</h1><h3>Introduction</h3><blockquote>A saying</blockquote><p>Words {}</p></article><div>All rights " + "reserved " * 30 + "</div>"
    pages = [article.format(f"T{i}", i) for i in range(6)]
    assert w.extract(pages[2], of_host(pages)) == "T2\nIntroduction\nA saying\nWords 2"


def test_text_does_not_depend_on_how_often_a_page_occurs():
    one = "<nav>n</nav><div id=m><article><h3>Head</h3><div><p>Solo text.</p></div><pre>code</pre></article></div><footer>f</footer>"
    want = "Head\nSolo text.\ncode"
    assert w.extract(one, None) == want
    for n in (1, 2, 5, 40):
        assert w.extract(one, of_host([one] * n)) == want
    # the heavier constant block is the template's, whichever page is common
    pages = [f"<div class=legal>{'terms and conditions ' * 20}</div><div class=body><p>text {i} {'more' * 20}</p></div>" for i in range(3)]
    assert all(w.extract(pages[0], of_host(pages[:1] * n + pages[1:])) == "text 0 " + "more" * 20 for n in (2, 5, 30))


def test_words_within_articles_are_not_roles():
    inner = "<h2 id='search'>Search methods</h2><section class='related-work'><p>Related work</p></section><table class='comment'><tr><td>cell</td></tr></table><p id='notice'>A notice</p><div id='social-history'>History</div>"
    assert w.extract(f"<article><h1>T</h1>{inner}</article>", None) == "T\nSearch methods\nRelated work\ncell\nA notice\nHistory"
    assert w.extract(f"<article><p>x</p><div class='comments'>c</div><div class='related-posts'>r</div><ul class='share-buttons'><li>s</ul><section id='comments-12'>d</section></article>", None) == "x"
    assert w.extract("<div><h2 id='search'>Search methods</h2><p>text of the page</p><p class='cookie-notice'>We</p></div>", None) == "Search methods\ntext of the page"


def test_many_siblings_depth_and_classes():
    for n in (255, 256, 257, 3000):
        html = "".join(f"<div class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>s{i}</div>" for i in range(n)) + "<article><h1>T</h1><p>x of the article, long enough to weigh more than a quarter " + "word " * n * 3 + "</p></article>"
        assert w.extract(html, None).startswith("T\nx of the article")
        assert w.extract(html, of_host([html, html.replace("s1<", "s2<")])).startswith("T\nx of the article")
    for depth in (39, 45, 60, 300):
        html = "<div class='a'>side</div>" + "<div><section>" * depth + "<article><p>deep</p></article><div class='note'>glued</div>" + "</section></div>" * depth
        assert w.extract(html, None) == "deep" and w.extract(html, of_host([html, html.replace("deep", "other")])) == "deep"
    a = '<div class="a b c x">left</div><div class="a b c y"><p>the right text is the longer one of both here</p></div>'
    assert w.extract(a, None) == "the right text is the longer one of both here"


def test_title_before_the_main_part():
    html = "<body><div class=top><h1>Title</h1></div><div class=content><p>first words of it</p><p>second words of it</p></div><div class=sidebar>side</div></body>"
    assert w.extract(html, None) == "Title\nfirst words of it\nsecond words of it"


def generated(rng, k):
    """A host's template and pages of it, with the text of each."""
    depth, word = rng.randrange(0, 12), lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    opened = [rng.choice(["div", "section"]) for _ in range(depth)]
    menu = "".join(f"<li><a href=/{i}>{word(1)}</a>" for i in range(rng.randrange(2, 40)))
    side = "".join(f"<div class='box{chr(97 + i)}'>{word(3)}</div>" for i in range(rng.randrange(0, 12)))
    main = rng.choice(["article", "article", "main", "div class='post-body'"])
    head = f"<html><head><title>t</title><script>if (a < b) x('</p>')</script></head><body class='p{k}'><nav><ul>{menu}</ul></nav><div class='ad'>{word(9)}</div>" + "".join(f"<{t}>" for t in opened)
    foot = f"<div class='sidebar'>{side}</div>" + "".join(f"</{t}>" for t in reversed(opened)) + f"<form><p>{word(4)}</p></form><div class='cookie-banner'>{word(20)}</div><footer>{word(30)}</footer></body></html>"
    pages = []
    for i in range(rng.choice([1, 2, 6, 9])):
        parts = [("h1", word(5))]
        for _ in range(rng.choice([2, 3, 8, 30, 300])):
            parts.append((rng.choice(["p", "p", "p", "h2", "blockquote", "pre", "h3"]), rng.choice([word(rng.randrange(5, 60)), "A constant line", "Fish &amp; chips"])))
        if rng.random() < 0.3:
            parts[len(parts) // 2 : len(parts) // 2] = [("h2 id='search'", "About search"), ("p id='notice'", word(12))]
        inserted = rng.choice(["", "<div class='ad'>buy</div>", "<aside>see also</aside>", "<div class='share'><p>share</p></div>"])
        body = [f"<{t}>{x}</{t.split()[0]}>" for t, x in parts]
        body.insert(len(body) // 2, inserted)
        pages.append((head + f"<{main}>" + "".join(body) + f"<div class='comments'><p>{word(8)}</p></div></{main.split()[0]}>" + foot, "\n".join(x.replace("&amp;", "&") for _, x in parts)))
    return pages


def test_generated_hosts():
    rng = random.Random(21)
    for k in range(60):
        pages = generated(rng, k)
        known = of_host([p for p, _ in pages] + [pages[0][0]] * rng.choice([0, 1, 7]))
        for html, text in pages:
            assert w.extract(html, known) == text


def test_long_and_deep_pages():
    rng = random.Random(1)
    tags = ["p", "ul", "div", "blockquote", "pre", "table", "h2", "h3"]
    many = "<article>" + "".join(f"<{t}>x{i}</{t}>" for i, t in enumerate(rng.choice(tags) for _ in range(5000))) + "</article>"
    x = w.folded(w.parse(many))
    assert len(w.expression(w.merged(x, w.folded(w.parse(many))))) < 20_000
    assert w.extract(many, None).count("\n") == 4999 and w.extract(many, of_host([many, many.replace("x17<", "y<")])).count("\n") == 4999
    deep = "<div>" * 30_000 + "core" + "</span>" * 10 + "</div>" * 30_000
    assert w.extract(deep, None) == "core"
    assert w.extract("<div><section>" * 20_000 + "core", None) == "core"
    assert w.extract("<" * 100_000, None) == "<" * 100_000
    assert w.extract('<a "' * 50_000, None) is not None


SCHEMA = "page_id long, url string, html string, text string, n_chars int, host string"


def test_operator(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.net/{i}", page(f"T {i}", f"<p>Own words number {i} here</p>")) for i in range(30)]
    rows += [(100, None, page("N", "<p>null url</p>")), (101, "http://h0.net/x", None), (102, "nohost", ""), (103, "http://h1.net/o", "<p>other layout</p>"), (5, rows[5][1], rows[5][2])]
    pages = spark.createDataFrame([(*r, "t", 1, "h") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in w.extract_main_text(pages).collect()), key=str)
    by = {g[0]: g[2] for g in got}
    assert len(got) == 35 and all(g[3] == len(g[2]) for g in got)
    assert all(by[i] == f"T {i}\nOwn words number {i} here" for i in range(30))
    assert by[100] == "N\nnull url" and by[101] == "" and by[102] == "" and by[103] == "other layout"
    monkeypatch.setattr(w, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(w, "FAN", 2)
    assert sorted((tuple(r) for r in w.extract_main_text(pages).collect()), key=str) == got
    assert sorted((tuple(r) for r in w.extract_main_text(pages.repartition(50)).collect()), key=str) == got
    assert w.extract_main_text(pages.limit(0)).count() == 0
