"""HTML extraction golden rows (FIXTURES §4.9)."""

from factlens.operators.html import article_text, extract_article_text, wiki_text


def test_article_rules():
    assert article_text("<html><body><nav><div>menu<p>x</p></div></nav><p>Hello <b>there</b></p></body>")[0] == \
        "Hello there"
    assert article_text("<body><p>one<p>two</body>")[0] == "onetwo"
    assert article_text("<main>M</main><body>B</body>")[0] == "M"
    assert article_text("<body>B &amp; C &lt;3 <!-- hidden --></body>")[0] == "B & C <3"
    assert article_text('<body><script>var t="</p>";</script>text</body>')[0] == "text"
    assert article_text("<article>first</article><article>second</article>")[0] == "first"
    assert article_text("plain <b>text</b> only")[:3] == ("plain text only", 3, True)
    assert article_text(None)[2] is False


def test_wiki_rules():
    assert wiki_text("<p>Line one<sup>[1]</sup></p>\n\n<table><tr><td>x</td></tr></table><p>two</p>") == "Line one two"
    assert wiki_text("") == ""


def test_distributed_extraction(spark):
    pages = spark.createDataFrame([(1, "<article>a b</article>"), (2, None)], "page_id long, html string")
    got = {r["page_id"]: (r["content"], r["word_count"], r["success"]) for r in extract_article_text(pages).collect()}
    assert got == {1: ("a b", 2, True), 2: (None, 0, False)}
