import html.parser
import os
import time

import pytest

from quillspark.llm import html_text as ht

SF = "/root/testdata/sf0.001"
PROSE = "Some words about what others have tried before, and why it did not work. "


class Articles(html.parser.HTMLParser):
    """A plain twin for well-kept pages: the text of the article, a line for each block."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.lines, self.now = 0, [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        line = " ".join("".join(self.now).split())
        if line:
            self.lines.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in ht._BLOCK:
            self.flush()
        if tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ht._BLOCK:
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.now.append(data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_equals_the_articles_of_whole_pages(spark):
    rows = ht.op7_html(spark, SF).collect()
    page = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(page)
    assert all(r.text == "\n".join(Articles(page[r.page_id]).lines) and r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("page", ['<article><p class="related-work">{}</p></article>', '<article><div id="social-history"><p>{}</p></div></article>', "<article><p>{} <math><mi>x</mi></math></p></article>", "<article><noscript><p>{}</p></noscript></article>", '<article><section id="replication"><h2>Notes</h2><p>{}</p></section></article>'])
def test_article_text_is_kept_whatever_its_names(page):
    assert PROSE.strip() in ht.main_text("<nav><a href=a>Home</a></nav>" + page.format(PROSE) + "<footer>end</footer>")


def test_what_is_not_the_article_goes():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies on this site for many things.</p></div><article><header><h1>Headline here</h1><p class='byline'>By A. Writer</p></header>"
        f"<p>{PROSE}&amp; more&nbsp;text</p><div class='ad'>Buy now and save a lot of money today</div><p>{PROSE}<br>after</p><form><p>Your name please</p><input></form>"
        f"<select><option>one<option>two</select><svg><text>chart</text></svg><aside>{PROSE}</aside><ul class='share-buttons'><li><a href=x>Share</a></li></ul></article>"
        f"<section class='comments'><article><p>{PROSE}</p></article></section><footer>&copy; all</footer><script>var a='<p>x</p>'</script></body></html>"
    )
    assert ht.main_text(page) == f"Headline here\n{PROSE}& more text\n{PROSE}after"


def test_pages_without_an_article_are_judged_by_their_blocks():
    page = f"<div class=menu><ul><li><a href=a>One two</a></li><li><a href=b>Three four</a></li></ul></div><div><h1>A heading</h1><p>{PROSE * 3}</p><p>{PROSE * 2}</p></div><ul><li><a href=c>More like this</a></li></ul>"
    assert ht.main_text(page) == f"A heading\n{(PROSE * 3).strip()}\n{(PROSE * 2).strip()}"


@pytest.mark.parametrize("bad", ['<a "' * 250_000, "<a " * 300_000, "<div>" * 200_000, "<b>" * 150_000 + "</i>" * 150_000, "<ul>" + "<b>" * 100_000 + "<li></li>" * 60_000, "<" * 1_000_000, "<!--" * 250_000, "<a '\"" * 200_000 + ">", "<script>" * 120_000, "<p class=" * 110_000])
def test_malformed_pages_take_time_in_proportion(bad):
    began = time.perf_counter()
    ht.main_text(bad)
    assert time.perf_counter() - began < 8


def test_the_tree_uses_neighbours_and_names(spark):
    used = set()

    def walk(t):
        if not isinstance(t, int):
            used.add(ht.NAMES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(ht.TREE)
    assert used >= {"links", "hint", "part", "place"} and used & {"words_before", "links_before", "words_after", "links_after"}


def test_rows_with_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a &lt; b</p></article>", 3), (1, "u", "<article><p>a &lt; b</p></article>", 3), (2, None, None, 1), (None, "v", "", 1), (3, "w", "<nav>x</nav>", None)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or 0), r.url, r.text, r.n_chars) for r in ht.extract_text(df).fillna("", "url").collect())
    assert got == [(0, "v", "", 0), (1, "u", "a < b", 5), (1, "u", "a < b", 5), (2, "", "", 0), (3, "w", "", 0)]
    assert ht.extract_text(df.limit(0)).count() == 0
