"""Main text: pages of known articles, odd markup, and the whole query against a reading of its article elements."""

import html
import re
import time

from foliospark.llm import QUERIES
from foliospark.llm.text_density import extract, main_text

NAV = "<nav><ul>" + "".join(f"<li><a href=/x{i}>item {i}</a>" for i in range(8)) + "</ul></nav>"


def prose(n, word="word"):
    return " ".join(f"{word}{i}" for i in range(n)) + "."


def test_query_against_article_elements(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op13_html_extraction"](spark, folder).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        source = pages[row["page_id"]]["html"]
        article = source[source.index("<article>") + 9 : source.index("</article>")]
        article = re.sub(r"[\t\n\x0b\x0c\r]", " ", article)
        blocks = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1)>", "\n", article)).split("\n")
        lines = [re.sub(" +", " ", html.unescape(b)).strip(" ") for b in blocks]
        assert row["text"] == "\n".join(x for x in lines if x)
        assert row["n_chars"] == len(row["text"]) and row["url"] == pages[row["page_id"]]["url"]


def test_articles_keep_headings_and_short_paragraphs():
    page = f"<body><header>Site</header>{NAV}<article><header><h1>Head</h1><p>by me</p></header><p>{prose(40)}<p>Ok.<aside>{prose(90, 'as')}</aside></article><footer>f</footer>"
    assert main_text(page) == f"Head\n{prose(40)}\nOk."


def test_comments_and_notices_go():
    comments = f'<section id="comments"><article class="comment"><p>{prose(300, "c")}</p></article></section>'
    page = f'<div class="cookie-notice">{prose(90, "n")}</div><div class="adBox">{prose(50, "a")}</div><main><article><h2>T</h2><p>{prose(20)}</p>{comments}</article></main>'
    assert main_text(page) == f"T\n{prose(20)}"
    hidden = f'<div style="display: none">{prose(50, "h")}</div><div hidden>x</div><p aria-hidden="true">y</p><div role="dialog">z</div>'
    assert main_text(f"<article><p>{prose(9)}</p>{hidden}</article>") == prose(9)


def test_pages_without_article_go_by_density():
    body = f'<h1>Title</h1><p>{prose(60)}<p>{prose(40, "b")}</p><p>short one.</p>'
    side = f'<div class=sidebar><p>{prose(50, "s")}</p></div><div class=comments><p>{prose(300, "c")}</p></div>'
    assert main_text(f"<body><div id=top>{NAV}</div><div class=wrap><div class=content>{body}</div>{side}</div>") == f"Title\n{prose(60)}\n{prose(40, 'b')}\nshort one."
    links = "<div>" + "".join(f"<a href={i}>a link to page {i}</a> " for i in range(30)) + "</div>"
    parts = f"<div><h2>T</h2><div><p>{prose(60)}</p><p>{prose(30)}</p></div><div><p>{prose(50, 'b')}</p></div></div>"
    assert main_text(f"<body>{links}{parts}{links}<div>Copyright</div>") == f"T\n{prose(60)}\n{prose(30)}\n{prose(50, 'b')}"


def test_layout_classes_do_not_remove_the_page():
    page = f'<body class="has-sidebar"><div class="layout sidebar-right"><div class="post"><p>{prose(40)}</p><div class="share-buttons">share</div><p>{prose(5)}</p></div></div>'
    assert main_text(page) == f"{prose(40)}\n{prose(5)}"


def test_markup_is_read_as_browsers_do():
    assert main_text("<article>a&amp;b &lt;p&gt; &#233;&eacute; &am x&nbsp;y</article>") == "a&b <p> éé &am x\xa0y"
    assert main_text("<ARTICLE><P TITLE='a>b'>one<!-- <p>no -->two<BR/>three\n\t four</P>five</article>") == "onetwo three four\nfive"
    assert main_text("<article><ul><li>a<li>b</ul><dl><dt>c<dd>d</dl><table><tr><td>e<td>f<tr><th>g</table></article>") == "a\nb\nc\nd\ne\nf\ng"
    assert main_text('<article><script>var t="</p><p>x</p>";</script><style>p{}</style><p>ok</p><textarea><p>no</textarea></article>') == "ok"
    assert main_text("<article><p>a<b>c</p></b>d</i></div><p>e") == "ac\nd\ne"
    assert main_text("plain text &amp; more\n\n here") == "plain text & more here"


def test_hostile_pages():
    start = time.perf_counter()
    assert main_text("<script>never closed <p>x</p>") == "" and main_text("<!-- open") == ""
    assert main_text("<" * 100_000) == "<" * 100_000
    assert main_text("<div>" * 100_000 + "x") == "x"
    assert main_text("<p>a" * 100_000).count("\n") == 99_999
    assert main_text("<a b='x" * 50_000) == ""
    assert len(main_text("<article><p>" + "word " * 1_000_000 + "</article>")) == 4_999_999
    assert time.perf_counter() - start < 60


def test_odd_rows(table):
    rows = [(1, None, None, "x"), (2, "", "u", None), (3, f"<p>{prose(9)}", None, "x"), (3, f"<p>{prose(9)}", None, "x"), (None, "<nav>a</nav>", "u", "x")]
    got = extract(table(rows, "page_id long, html string, url string, Text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "", 0), (2, "", 0), (3, prose(9), len(prose(9))), (3, prose(9), len(prose(9)))]
    assert set(got[0].asDict()) == {"page_id", "url", "text", "n_chars"}
    assert extract(table([], "page_id long, html string, url string")).collect() == []
