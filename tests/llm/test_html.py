import html as h
import re

import pytest

from tessera.llm import html

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) "</p>"</script></head><body class="home">
<header><h1>Site</h1></header><nav class=menu><ul><li><a href="/a>b">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id=page-12><article class="post-12"><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld,&nbsp;two&#33;<br>three<p>Four &lt;x&gt;, &am &amp
<script>var x = '</article>';</script><div class="ad">Buy</div><aside>Side</aside><form>Name <input></form><blockquote>Quote</blockquote></article>
<div class="comments"><p>Great, really, a very long comment, with commas, and more, and more, and yet more text.</p></div></div>
<div class="sidebar"><p>Other</p></div><footer>&copy; x</footer></body></html>"""


def test_article_alone():
    assert html.main_text(FULL, []) == "Head & line One bold, two! three Four <x>, &am & Quote"


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<div>a<!-- x -- y > z -->b</div>", "ab"), ("<p>cut <b", "cut"), ("<p>a &lt b", "a < b"),
    ("<article><p>x</article><article class=comment><p>reply</article>", "x"), ("<div><a href='x'>link</a></div><main><p>Body, text.</p></main>", "Body, text."), ("<p title='>'>q</p>", "q"), ("<p title='>q</p>", "q"),
    ("<script>x", ""), ("<ul><li>a<li>b</ul>", "a b"), ("<p>" + "w " * 50_000, ("w " * 50_000).strip()), ("<td>a</td><td>b</td>", "a b"), ("<![CDATA[x]]>", "x"),
])
def test_small_pages(page, text):
    assert html.main_text(page, []) == text


def test_host_path_wins(spark):
    usual = "<div class='story-{i}'><p>{t}, and a text, with commas, that is long enough to win here.</p></div><div class='extra'><p>{x}</p></div>"
    rows = [(i, "http://h.org/a", usual.format(i=i, t=f"story {i}", x="note")) for i in range(9)]
    rows.append((99, "http://h.org/b", usual.format(i=5, t="short", x="A box, with more, and more, and more, text, than, the, story, has, itself, in, it, today, and, always")))
    rows.append((100, "http://other.org/", "<section><p>alone</p></section>"))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[99].startswith("short, and a text") and "box" not in got[99] and got[100] == "alone" and got[3].startswith("story 3")


def test_whole_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = r["html"].partition("<article>")[2].partition("</article>")[0]
        text = " ".join(h.unescape(re.sub(r"<[^>]*>?", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))).split())
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text) and got[r["page_id"]]["url"] == r["url"]


def test_edges(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (2, "http://a.b/", ""), (None, "x", "<p>t</p>"), (4, None, "<p>u</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 host", "2 paths", "3 text")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(pages).collect())
    assert got == [(0, "t", 1), (1, "", 0), (2, "", 0), (2, "", 0), (4, "u", 1)]
    assert html.extract(pages.limit(0)).count() == 0


STORY = "Good text, and more of it, that runs on for a while. " * 8


@pytest.mark.parametrize("page", [
    f'<body><div style="overflow: hidden"><p>{STORY}</div>', f'<body><div title="a hidden gem"><p>{STORY}</div>', f'<body><p data-x="see hidden">{STORY}</p>', f"<body><div class='layout has-sidebar'><p>{STORY}</div>",
    f"<body><div class=no-sidebar><p>{STORY}</div>", f"<body><div class=social-science><p>{STORY}</div>", f"<body><div class=sidebar><p>{STORY}</div>", f"<body class=menu-open><main id=search><p>{STORY}</main>",
    f"<body><nav><ul><li><a href=x>menu</a></ul><article><p>{STORY}</article>", f"<body><nav><ul><li><a href=x>menu</a></ul><div id=c><p>{STORY}</div>", f"<body><header><ul><li><a href=x>menu</a></ul><div id=c><p>{STORY}</div>",
    f"<body><div class='has-sidebar'><div class=content><p>{STORY}</div><div class=sidebar>Other things, and more.</div></div><div hidden>not shown</div><div style='display: none'>nor this</div>",
    f"<body><article><section class='related-work'><p>{STORY}</section><section class='related-posts'><p>Another story</section></article>",
])
def test_articles_are_not_lost_to_words(page):
    assert html.main_text(page, []) == STORY.strip()


def test_comments_are_less_than_the_article():
    reply = "Great, really, a comment, with commas, and more. " * 12
    page = f"<body><div class=story><h1>Head</h1><p>{STORY}</div><div class=comments><div class=item><p>{reply}</div><div class=item><p>{reply}</div></div>"
    assert html.main_text(page, []) == f"Head {STORY.strip()}"


def test_host_vote_decides_without_articles(spark):
    def page(i, story, thread):
        return f"<body><div class='post-{i}'><h1>Head {i}</h1><p>{story}</p></div><div class='thread-{i}'><p>{thread}</p></div></body>"

    long_thread = "Words, and words, in a long thread, of readers. " * 40
    rows = [(i, "http://h.org/a", page(i, STORY, "one reply" if i % 4 else long_thread)) for i in range(20)]
    alone = {i: html.main_text(p, []) for i, _, p in rows}
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i} {STORY.strip()}" for i in got} and len(got) == 20
    assert {i for i in got if got[i] != alone[i]} == {0, 4, 8, 12, 16}


@pytest.mark.parametrize("page", ["<b>" * 20_000, "<div>" * 20_000, "<div>" * 20_000 + "</p></i>" * 20_000, "<b><i>x</b>" * 20_000, "<div><b>" * 10_000 + "<p>x" * 10_000, "<td>" * 20_000, "<li><ul>" * 10_000 + "</li>" * 10_000, '<a "' * 20_000, "<a '>" * 20_000])
def test_deep_and_unclosed_pages_take_linear_time(page):
    import time

    took = []
    for p in (page, page * 4):
        began = time.process_time()
        html.main_text(p + "end", [">body>div"])
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.05)
