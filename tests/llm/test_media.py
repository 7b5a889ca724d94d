"""Against the standard library's parser, and by hand."""

import base64
import hashlib
import re
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import media as D
from tests.llm.helpers import SF, rows

SCHEMA = "page_id long, url string, html string"


class Slow(HTMLParser):
    """Text blocks and media of a page, tag by tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.silent = [], [], 0

    def flush(self):
        t = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if t:
            self.items.append(("text", t))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript", "template", "textarea", "svg"):
            self.silent += 1
        elif not self.silent and tag not in D._INLINE:
            self.flush()
            if tag in ("img", "video", "audio"):
                self.items.append((D._MEDIA[tag], dict(attrs).get("src")))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "noscript", "template", "textarea", "svg"):
            self.silent = max(0, self.silent - 1)
        elif not self.silent and tag not in D._INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def slow(page):
    p = Slow()
    p.feed(page)
    p.close()
    p.flush()
    return p.items


def fast(page):
    return [(i["kind"], i["text"] if i["kind"] == "text" else i.get("src")) for i in D.parse(page)[0]]


def test_pages_as_the_standard_parser_reads_them(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(pages) and all(fast(r.html) == slow(r.html) for r in pages)


PIECES = st.sampled_from(["<p>", "</p>", "<b>", "</b>", "a b", " ", "x&amp;y", "<img src=i.png>", "<br>", "<!-- c -->", "<div class='q'>", "</div>", "\n", "tail", "<video src=\"v\"></video>", "<script>var t=1</script>", "<li>", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_generated_pages(pieces):
    page = "".join(pieces)
    assert fast(page) == slow(page)
    assert [i["position"] for i in D.parse(page)[0]] == list(range(len(D.parse(page)[0])))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-\"'= abpimgscr&;", max_size=80))
def test_anything_parses(page):
    D.parse(page, "http://x/")


def test_captions_and_order(spark):
    page = "<p>before<figure><img src='/a.png' alt='A'><img src='b.png'><figcaption>two <i>cats</i></figcaption></figure><p>after<audio><source src=s.mp3></audio>"
    items = D.parse(page, "http://h.org/d/")[0]
    assert [(i["kind"], i.get("text"), i.get("src"), i.get("alt"), i.get("caption")) for i in items] == [
        ("text", "before", None, None, None), ("image", None, "http://h.org/a.png", "A", "two cats"), ("image", None, "http://h.org/d/b.png", None, "two cats"),
        ("text", "after", None, None, None), ("audio", None, "http://h.org/d/s.mp3", None, None),
    ]


def test_payloads_by_digest(spark):
    data, stored = b"\x89PNG..", b"jpeg bytes"
    uri, digest = "data:image/png;base64," + base64.b64encode(data).decode(), hashlib.sha256(data).hexdigest()
    by = hashlib.sha256(stored)
    pages = [
        (1, "http://a/", f"<p>one<img src='{uri}'>two<img src='{uri}'>"),
        (2, "http://b/", f"<img src='x.jpg' integrity='sha256-{base64.b64encode(by.digest()).decode()}'><img src='lost.jpg'><img src='data:broken'>"),
        (2, "http://b/", f"<img src='x.jpg' integrity='sha256-{base64.b64encode(by.digest()).decode()}'><img src='lost.jpg'><img src='data:broken'>"),
        (3, "http://c/", "plain"),
    ]
    store = spark.createDataFrame([(by.hexdigest(), "image/jpeg", bytearray(stored)), (by.hexdigest(), "image/jpeg", bytearray(stored))], "digest string, mime string, content binary")
    got = sorted(D.sequences(spark.createDataFrame(pages, SCHEMA), store).collect(), key=lambda r: r.page_id)
    one = got[0]["items"]
    assert [(i.position, i.kind, i.text, i.digest, i.mime, bytes(i.payload) if i.payload else None) for i in one] == [
        (0, "text", "one", None, None, None), (1, "image", None, digest, "image/png", data), (2, "text", "two", None, None, None), (3, "image", None, digest, "image/png", data),
    ]
    assert len(got) == 4 and got[1]["items"] == got[2]["items"]
    assert [(i.src, bytes(i.payload) if i.payload else None) for i in got[1]["items"]] == [("http://b/x.jpg", stored), ("http://b/lost.jpg", None), (None, None)]
    assert [i.text for i in got[3]["items"]] == ["plain"]


def test_odd_rows(spark):
    long = "<p>x " * 100_000 + "<img src=a>"
    data = [(1, None, None), (None, "u", ""), (2, None, "<p>hi"), (2, None, "<p>hi"), (3, "http://[bad", "<img src='//x'>"), (4, "u", long)]
    got = D.sequences(spark.createDataFrame(data, SCHEMA)).collect()
    sizes = sorted((r.page_id or 0, -1 if r["items"] is None else len(r["items"])) for r in got)
    assert sizes == [(0, 0), (1, -1), (2, 1), (2, 1), (3, 1), (4, 100_001)]
    assert rows(D.sequences(spark.createDataFrame([], SCHEMA))) == []
    clash = spark.createDataFrame([(1, "u", "<p>a<img src=b>", "x", "y")], SCHEMA + ", items string, payloads string")
    assert [len(r["items"]) for r in D.sequences(clash).collect()] == [2]


def test_silent_elements_end_where_they_end():
    both = [("text", "a"), ("image", "x")]
    for page in (
        "<svg class=\"i\"/><p>a</p><img src=x>", "<svg/><p>a</p><img src=x>", "<svg a='>' /><p>a</p><img src=x>", "<script src=/s/>no</script><p>a</p><img src=x>",
        "<style-guide><p>a</p></style-guide><img src=x>", "<title-bar>a</title-bar><img src=x>", "<svg><title>t</title>no</svg><p>a</p><img src=x>",
        "<SCRIPT>'</style>' no</Script ><p>a</p><img src=x>", "<p>a<noscript>no<p>no<img src=x></noscript>", "<noscript/><p>a<noscript><img src=x></noscript>",
    ):
        assert fast(page) == both, page
    assert fast("a <noscript><p>no</p></noscript>b") == [("text", "a b")]
