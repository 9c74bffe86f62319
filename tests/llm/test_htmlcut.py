import itertools
import re

import numpy as np
from conftest import DATA

from tracewise.llm import htmlcut as H


def text(page):
    return H.main_text(page, H.DEFAULT)


def test_cut_is_the_cheapest_labelling():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        cost = rng.normal(0, 1, n)
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        price = lambda s: sum(-c if x else c for c, x in zip(cost, s, strict=True)) / 2 + sum(w for i, j, w in edges if s[i] != s[j])  # noqa: E731,B023
        best = min(itertools.product((False, True), repeat=n), key=price)
        assert abs(price(H.cut(cost, edges).tolist()) - price(best)) < 1e-6
        assert abs(price(H.flow_side(cost.tolist(), edges)) - price(best)) < 1e-6


BODY = "The long first paragraph of the story says what happened, and who was there at that time."


def test_parts_of_a_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site, as the law asks us to say so to all.</p></div>
    <main><article><h1>A  title</h1><p><b>{BODY}<br><p>Short &amp; sweet.</p><div class="ad">Buy it now, it is very cheap today.</div>
    <p>x<i>y</i>z &lt;b&gt;</p><form><p>Write your name here, please, and press the button.</p></form></article></main>
    <section id="comments"><p>I liked this story a lot, thank you for writing it down.</p></section>
    <aside class="sidebar"><p>Other stories that you could like, if you liked this one too.</p></aside>
    <footer>&copy; 2024 Site</footer></body></html>"""
    assert text(page) == f"A title {BODY} Short & sweet. xyz <b>"


def test_without_names():
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><div>{BODY}</div><div>{BODY} {BODY}</div></div><div><a href=3>Imprint</a></div>"
    assert text(page) == f"{BODY} {BODY} {BODY}"


def test_broken_pages():
    assert text("") == "" and text("<") == "" and text("<<<>>>") in ("", "<<<>>>", "<<>>>")
    assert text(f"<article><p>{BODY}</p><p>{BODY} and mo") == f"{BODY} {BODY} and mo"
    assert text(f"<article><p>{BODY}</p><scr") == BODY
    assert text(f"<article><p>{BODY}</p><a href='x") == BODY
    assert text(f"<article><p>{BODY} a &am") == f"{BODY} a &am"
    assert text(f"<article><p>{BODY}<script>if (a < b) x('</p>")  == BODY
    assert len(text("<div>" * 3000 + f"<article><p>{BODY}" + "</div>" * 3000)) == len(BODY)


def test_tags_that_may_be_left_out_or_were_forgotten():
    """A head that is never closed, and elements without a closing tag: their pages keep their text."""
    story = f"<article><p>{BODY}</p><p>{BODY} Two.</p></article>"
    want = f"{BODY} {BODY} Two."
    for start in ("<html><head><title>T</title>", "<head><meta charset=utf-8><title>T</title><style>p{}</style>", "<html><head><body>", "<head></head>"):
        assert text(start + story) == want, start
    for tag in ("select", "button", "svg", "object", "math", "iframe", "canvas", "template", "noscript", "title", "textarea"):
        assert text(f"<body><article><p>{BODY}</p><{tag} id=x><p>{BODY} Two.</p></article>") == want, tag
        gone = f"<{tag}>no such words</{tag}>"
        assert text(f"<body><article><p>{BODY}</p>{gone}<p>{BODY} Two.</p></article>") == want, tag
    for tag in ("select", "button", "template"):  # the first is forgotten, the second isn't
        assert text(f"<body><article><p>{BODY}</p><{tag}><p>{BODY} Two.</p><{tag}>no such words</{tag}></article>") == want, tag


STORY = f"<p>{BODY}</p><p>{BODY}</p><p>{BODY}</p>"
THRICE = f"{BODY} {BODY} {BODY}"


def test_names_of_states_are_not_names_of_parts():
    for names in ("content-area has-sidebar", "post no-comments", "entry with-sidebar", "content is-sponsored", "story without-header"):
        assert text(f'<body><div class="{names}">{STORY}</div></body>') == THRICE, names
    for names in ("cookie-notice", "site-sidebar", "post-comments", "nav has-content"):
        assert text(f'<body><article>{STORY}<div class="{names}"><p>{BODY}</p></div></article>') == THRICE, names


def test_what_is_hidden():
    shown = 'style="overflow:hidden"', 'class="hidden-print"', 'data-x="hidden"', 'aria-hidden="false"', "title='not hidden here'", 'style="float:none"'
    hidden = "hidden", 'hidden=""', 'style="display: none"', "style='color:red;display:none'", 'aria-hidden="true"', 'class="a hidden"', 'style="visibility:hidden"'
    for attrs in shown:
        assert text(f"<article><div {attrs}>{STORY}</div></article>") == THRICE, attrs
        assert text(f"<article><p>One <span {attrs}>two</span> three. {BODY}</p></article>") == f"One two three. {BODY}", attrs
    for attrs in hidden:
        assert text(f"<article>{STORY}<div {attrs}><p>{BODY}</p></div></article>") == THRICE, attrs
        assert text(f"<article><p>One <span {attrs}>two <span>x</span> y</span>three. {BODY}</p></article>") == f"One three. {BODY}", attrs
        # an element that is never closed hides nothing, one that a block cuts short hides up to the block
        assert text(f"<article><p>One <i {attrs}>two. {BODY}</p></article>") == f"One two. {BODY}", attrs
        assert text(f"<article><p>{BODY} <b {attrs}>two</p><p>{BODY}</b></p></article>") == f"{BODY} {BODY}", attrs


def test_a_form_around_the_page():
    for inner in (f"<article>{STORY}</article>", f'<div class="content">{STORY}</div>', STORY):
        for end in ("</form>", ""):
            assert text(f"<body><form id=aspnetForm method=post><nav><a href=/>Home</a></nav>{inner}{end}</body>") == THRICE, (inner, end)
    small = "<form><p>Write your name here, please.</p></form>"
    assert text(f"<body><article>{STORY}{small}</article></body>") == THRICE
    assert len(text("<form>" * 20_000 + STORY)) == len(THRICE)


def test_markup_in_scripts_is_text():
    minified = "for(i=0;i<n;i++)f()", "if(a<b)x='", "<!-- a", "s='</p></article><article><p>no'", "a<b&&c>d", "if(a<b){s=\"it's\"}"
    for code in minified:
        assert text(f"<body><article><p>{BODY}</p><script>{code}</script><p>{BODY}</p></article>") == f"{BODY} {BODY}", code
        assert text(f"<article><p>{BODY}</p><SCRIPT src=a>{code}</Script ><style>{code}</style><p>{BODY}</p></article>") == f"{BODY} {BODY}", code
        assert text(f"<head><script>{code}</script></head><body><article><p>{BODY}</p></article>") == BODY, code
        assert text(f"<article><p>{BODY}</p><noscript><style>{code}</style></noscript><textarea>{code}</textarea><p>{BODY}</p></article>") == f"{BODY} {BODY}"
        assert text(f"<title>{code}</title><article><p>{BODY}</p></article>") == BODY
    assert text(f"<head><script>s='<body>'</script><meta name=a></head><body><article><p>{BODY}</p></article>") == BODY
    assert text(f"<article><p>{BODY}</p><script>i<n;'</scripts>'</script><p>{BODY}</p></article>") == f"{BODY} {BODY}"
    assert text(f"<article><p>{BODY}</p>" + "<noscript><style><title>" * 20_000) == BODY


def test_whole_table_against_tags(spark):
    """On these pages the article tag holds all of the main text, and the block tags in it are few."""
    import html
    for r in H.main_texts(spark.read.parquet(f"{DATA}/pages.parquet")).join(spark.read.parquet(f"{DATA}/pages.parquet"), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


def test_odd_rows(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (2, None, "", 1), (None, "u", f"<article><p>{BODY}", 1),
            (3, "u", "<article>" + f"<p>{BODY}</p>" * 5000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((repr(r.page_id), r.url, r.n_chars) for r in H.main_texts(pages).collect() if r.url)
    assert got == [("1", "u", 0), ("3", "u", 5000 * (len(BODY) + 1) - 1), ("None", "u", len(BODY))]
    assert H.main_texts(pages.limit(0)).collect() == []
