"""Known values of the text, URL, metadata and serialisation kernels."""

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.core import metadata as M
from textloom.core import text as T
from textloom.core import ubf as B
from textloom.core import url as U


@pytest.mark.parametrize(
    ("text", "want"),
    [("З Києва до Київ", "z kieyva do kyiv"), ("LWÓW i Charków", "lviv i charkow"), ("crème brûlée", "creme brulee"), ("Größe", "grosse"), ("שלום", "shlvם"), ("", ""), (None, "")],
)
def test_normalize(text, want):
    assert T.normalize(text) == want


@pytest.mark.parametrize(("text", "want"), [("ann@work", "ann_at_work"), ("北京", "_"), ("Smørrebrød!", "smorrebrod"), (" two  words ", "two_words"), ("", "_")])
def test_to_name(text, want):
    assert T.to_name(text) == want


@pytest.mark.parametrize(
    ("text", "n", "append", "want"),
    [
        ("tide and time", 6, "~", "tide~"),
        ("Ebb. Flow and more", 7, "~", "Ebb."),
        ("Ebb, flow and more", 8, "~", "Ebb"),
        ("salt&nbsp;sea air", 6, "~", "salt&nbsp;~"),
        ("low<hr>water mark", 6, "~", "low"),
        ("harbour", 3, "~", "har~"),
        ("harbour", 7, "~", "harbour"),
        ("harbour", 0, "~", ""),
        (None, 3, "~", None),
    ],
)
def test_truncate(text, n, append, want):
    assert T.truncate(text, n, append) == want


def test_bad_bytes():
    good = [b"\x7f", b"\xcf\x80", b"\xef\xbf\xbd", b"\xf4\x80\x80\x80"]
    bad = [b"\x80", b"\xe0\x80", b"\xc0\xc0", b"\xf8\x80\x80\x80", b"\xed\xa0\x80", b"\xef\xbf\xbe"]
    for data in good:
        assert T.sanitize_utf8(data).encode() == data
    for data in bad:
        assert T.sanitize_utf8(data) == ""
    draw = random.Random(7)
    for _ in range(300):
        data = bytes(draw.randrange(256) for _ in range(draw.randrange(40)))
        clean = T.sanitize_utf8(data)
        assert T.sanitize_utf8(clean) == clean
        assert "\x00" not in clean


@given(st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\x00￾￿")))
@settings(max_examples=200)
def test_valid_text_stays(text):
    assert T.sanitize_utf8(text.encode()) == text


@pytest.mark.parametrize(("x", "want"), [(10.0, "10.0"), (10.12345, "10.12345"), (0.001, "0.001"), (1000000.0, "1.0e+6"), (100000.0, "100000.0"), (5e-324, "5.0e-324"), (4503599627370496.0, "4.503599627370496e+15"), (0.00001, "0.00001"), (-0.5, "-0.5"), (None, None)])
def test_float_digits(x, want):
    assert T.float_digits(x) == want


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_digits_read_back(x):
    assert float(T.float_digits(x)) == x


def test_ical():
    assert T.escape_ical('a"b,c:d;e\\f\tg\r\nh') == 'a\\"b\\,c\\:d\\;e\\\\f g\\nh'
    folded = T.escape_ical("x" * 100)
    assert folded == "x" * 70 + "\r\n " + "x" * 30


@pytest.mark.parametrize(
    ("link", "base", "want"),
    [
        ("../../../", "http://example.com/folder/file.html", "http://example.com/"),
        ("//example.com/bar", "https://x.com/", "https://example.com/bar"),
        ("c.html", "http://example.com/a/b.html", "http://example.com/a/c.html"),
        ("./c.html", "http://example.com/a/b.html", "http://example.com/a/c.html"),
        ("../c.html", "http://example.com/a/b/d.html", "http://example.com/a/c.html"),
        ("/c", "http://example.com/a/b/d.html", "http://example.com/c"),
        ("mailto:a@b.c", "http://example.com/", "mailto:a@b.c"),
        (None, "http://example.com/", None),
    ],
)
def test_abs_link(link, base, want):
    assert U.abs_link(link, base) == want


def test_base_host():
    assert U.split_base_host("spdy://example.com:8000/bla/hello.html?a=b#c") == ("spdy://example.com:8000", "spdy://example.com:8000/bla/")
    assert U.split_base_host("no host") == ("", "no host")


def test_data_urls():
    assert U.decode_data_url("data:,Hello World") == {"ok": True, "mime": "text/plain", "charset": "US-ASCII", "data": b"Hello World"}
    assert U.decode_data_url("data:charset=utf-8;,Hello World")["charset"] == "utf-8"
    assert U.decode_data_url("data:image/png;base64,aGk")["data"] == b"hi"
    assert U.decode_data_url("data:x")["ok"] is False


def test_metadata():
    page = '<head><meta name="description" content="Example Content"><title>Foo &amp; Co</title>'
    assert M.html_meta(page)[0] == [("description", "Example Content"), ("title", "Foo & Co")]
    rich = """<html lang="en"><head><meta property="og:image" content="/i.png"><meta name="twitter:title" content="T">
    <meta name=keywords content="a, b,,c"><link rel=canonical href=" /c "><link rel=icon href=f.ico><link rel=icon mask href=m.svg>
    <link rel="apple-touch-icon" href=t.png></head><body><nav><h1>no</h1><img src=logo.png></nav><div class=ad><h1>ad</h1></div>
    <div id=header2><img src=top.png></div><h1> Yes </h1><h1>two</h1><img src=a.png width=16><img src=//x/1x1/y.gif><img src=b.png></body></html>"""
    got = M.metadata("http://example.com/d/index.html", None, rich)
    assert [(x["key"], x["value"]) for x in got["metadata"]] == [("language", "en"), ("og:image", "/i.png"), ("twitter:title", "T"), ("keywords", "a, b,,c"), ("canonical_url", "/c"), ("icon_fav", "f.ico"), ("icon_touch", "t.png"), ("image_nav", "logo.png"), ("image_nav", "top.png"), ("h1", "Yes"), ("image", "b.png")]
    assert {x["key"]: x["link"] for x in got["metadata"]}["canonical_url"] == "http://example.com/c"
    assert sorted(got["links"]) == ["apple-touch-icon", "canonical", "icon"]
    assert got["filename"] == "index.html"
    assert M.metadata("http://x.com/", None, None) is None


def test_link_headers():
    page = "<head><link rel=alternate href='/en' hreflang=en><link rel=alternate href='/fr' hreflang=fr></head>"
    one = [("content-type", "text/html"), ("Link", '<https://hub.example.com/>; rel="hub"'), ("Link", '<https://example.com/feed>; rel="self"')]
    two = [("content-type", "text/html"), ("Link", '<https://hub.example.com/>; rel="hub", <https://example.com/feed>; rel="self"')]
    want = {"alternate": [{"href": "/en", "hreflang": "en"}, {"href": "/fr", "hreflang": "fr"}], "hub": [{"href": "https://hub.example.com/"}], "self": [{"href": "https://example.com/feed"}]}
    for headers in (one, two):
        assert M.metadata("http://example.com", headers, page)["links"] == want


def test_headers_and_charsets():
    assert M.parse_header('attachment; filename="a\\"b.txt"; x') == ("attachment", [("filename", 'a"b.txt')])
    assert M.filename("http://x.com/a/b%20c.pdf", []) == "b c.pdf"
    assert M.filename("http://x.com/", [("content-disposition", "attachment; filename=z.pdf")]) == "z.pdf"
    assert M.filename("data:,x", []) is None
    assert M.metadata("http://x.com", [("Content-Type", "text/html")], "<title>é</title>".encode("latin-1"))["metadata"][0]["value"] == "é"
    assert M.metadata("http://x.com", [("Content-Type", "text/html")], "<meta charset=utf-8><title>é</title>".encode())["metadata"][1]["value"] == "é"
    assert M.content_length([("content-range", "bytes 0-9/123"), ("content-length", "10")]) == 123
    assert M.metadata("http://x.com/a.png", [("content-type", "image/png")], b"\x89")["metadata"] == []
    assert [M.is_index_page(u) for u in ("http://x.com", "http://x.com/?a", "http://x.com/index.php", "http://x.com/a")] == [True, False, True, False]


@pytest.mark.parametrize(
    ("term", "want"),
    [
        ("[1,2,3]", b"#3&2&1&$"),
        ("3.14159", b'"3.14159"`f`$'),
        ('{"$datetime":"2008-12-10T15:30:00"}', b"1228923000`dt`$"),
        ('{"$datetime":"9999-08-17T12:00:00"}', b"'undefined'$"),
        ('[{"$tuple":[{"$atom":"a"},1]},{"$tuple":[{"$atom":"b"},2]}]', b"#{'b',2}&{'a',1}&`plist`$"),
        ("not json", None),
    ],
)
def test_ubf(term, want):
    assert B.encode(term) == want


def test_ubf_keys_and_errors():
    packed = B.encode('{"$tuple":[{"$atom":"abc"},{"$atom":"abc"},12345,12345]}')
    assert b">" in packed
    assert B.decode(packed)["json"] == '{"$tuple": [{"$atom": "abc"}, {"$atom": "abc"}, 12345, 12345]}'
    for data in (b"", b"{'abc", b"5~abc", b"}", b"&", b"Z$", b"9~x~$", b'"x"`dt`$'):
        assert B.decode(data)["ok"] is False
    with pytest.raises(B.UbfError):
        B.loads(b"1" * 100, limit=10)


_TERMS = st.recursive(st.none() | st.booleans() | st.integers() | st.text(st.characters(exclude_categories=("Cs",))), lambda x: st.lists(x) | st.lists(x).map(tuple), max_leaves=30)


@given(_TERMS)
@settings(max_examples=200)
def test_ubf_round_trip(term):
    data = B.dumps(B.from_json(B.to_json(term)))
    assert B.to_json(B.loads(data)[0]) == B.to_json(term)


def _ical_by_bytes(text):
    out, used = bytearray(), 0
    for b in text.replace("\r\n", "\n").encode():
        piece, cost = {10: (b"\\n", 2), 9: (b" ", 1), 58: (b"\\:", 3)}.get(b, (b"\\" + bytes([b]), 2) if b in b'",;\\' else (bytes([b]), 1))
        if used >= 70:
            out += b"\r\n "
            used = 0
        out += piece
        used += cost
    return out.decode("utf-8", "replace")


@settings(max_examples=200)
@given(st.text(alphabet="ab\\:\n\t\",;\r\xe9€", max_size=400))
def test_ical_by_bytes(text):
    assert T.escape_ical(text) == _ical_by_bytes(text)


def test_ical_of_a_long_text():
    text, begun = "One: two, three; four\\five\n" * 100_000, time.process_time()
    T.escape_ical(text)
    assert time.process_time() - begun < 1
