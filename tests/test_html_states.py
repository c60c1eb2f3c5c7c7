import html
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsearch_spark.sources.html import html_text_by_states, html_to_text, scan_text


def words(page):
    return " ".join(html.unescape(scan_text(page)).split())


@pytest.mark.parametrize("page, text", [
    ("a<b title='x > y'>c</b>d", "a c d"),
    ('<img alt="1 > 0" src=a/b>x', "x"),
    ("<a href=x>y</a >z", "y z"),
    ("one <script>if (a<b) { '</p>' }</script >two", "one two"),
    ("one <SCRIPT src='>'>never closed <p>two", "one"),
    ("one <style>p > a {}</styles> still</style/>two", "one two"),
    ("one <!-- never closed <p>two", "one"),
    ("a<!-->b<!--->c<!-- x > y -->d<!--e--!>f", "a b c d f"),
    ("<!doctype html><?xml x?></ bogus>t", "t"),
    ("2 < 3 and 3 <4 <", "2 < 3 and 3 <4 <"),
    ("cut <p class='open", "cut"),
    ("<title>a <b> & c</title>d", "a <b> & c d"),
    ("&lt;p&gt; &amp;lt; &#65;", "<p> &lt; A"),
    ("<p/>x<p a = 'v>' b=\"w>\" c= u>y", "x y"),
    ("", ""),
])
def test_states(page, text):
    assert words(page) == text


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out = []

    def handle_data(self, data):
        self.out.append(data)

    def handle_starttag(self, tag, attrs):
        self.out.append(" ")

    handle_endtag = handle_startendtag = lambda self, *a: self.out.append(" ")
    handle_comment = lambda self, data: self.out.append(" ")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "<p>", "</p>", "<a href='x > y' id=z>", "<br/>", '<i title="a\'>">',
                                 "<!-- a > b -->", "text"]), max_size=30))
def test_well_formed_pages_as_the_standard_parser(parts):
    page = "".join(parts)
    p = Plain()
    p.feed(page)
    p.close()
    assert scan_text(page).split() == "".join(p.out).split()


def test_time_is_linear():
    for piece in ("<", "<a b='", "<!--", "<script>", "</", "&", "<a \"'", "<textarea></textare"):
        scan_text(piece * 100_000)


def test_column(spark):
    pages = ["<p>Tom &amp; Jerry</p>", None, "plain  text", "a<b t='>'>c", "&lt;"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    got = [r.t for r in df.select("i", html_text_by_states("h").alias("t")).orderBy("i").collect()]
    assert got == ["Tom & Jerry", "", "plain text", "a c", "<"]
    well = df.filter("i <> 3")
    assert [r.a for r in well.select(html_text_by_states("h").alias("a")).collect()] == \
        [r.a for r in well.select(html_to_text("h").alias("a")).collect()]
