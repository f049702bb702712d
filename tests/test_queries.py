"""Registered queries against their SQL, and the behaviour of columns, streams, sources and SQL names."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from textloom.functions import convert, dates, html, metadata, net, serial, strings, urls
from textloom.operators import pages as P
from textloom.plans import ORACLES, QUERIES
from textloom.register import register
from textloom.sources import fetch as X
from textloom.streaming import pages as S

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert same(QUERIES[name](spark, SF), ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).collect()


def one(spark, column, kind="string", value=None):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("x")).first()["x"]


TEXT_COLUMNS = {
    "trim": strings.trim, "line": strings.line, "normalize": strings.normalize, "to_name": strings.to_name, "truncate": lambda c: strings.truncate(c, 3), "truncatewords": lambda c: strings.truncatewords(c, 3),
    "ical": strings.escape_ical, "to_integer": convert.to_integer, "to_datetime": convert.to_datetime, "to_bool": convert.to_bool, "escape": html.escape, "strip": html.strip, "sanitize": html.sanitize, "tokens": html.html_tokens,
    "nodes": html.html_nodes, "map": html.html_to_map, "svg": html.svg_sanitize, "css": html.css_sanitize, "js": html.js_minify, "link": html.escape_link, "emails": net.extract_emails, "ip": net.ip_to_long, "local": net.is_local,
    "reverse": net.reverse_ip, "percent": urls.percent_encode, "base": urls.split_base_host, "data": urls.decode_data_url, "ubf": serial.ubf_encode, "meta": metadata.html_meta, "slug": strings.to_slug, "props": html.escape_props,
}


@pytest.mark.parametrize("name", sorted(TEXT_COLUMNS))
def test_odd_values(spark, name):
    """Null, empty, broken and very long texts give a result, never an error."""
    long = "Ein <b>Wort</b> &amp; noch 'eins'; " * 20_000
    rows = [(None,), ("",), ("\x00￾",), ("<![CDATA[",), ("😀" * 10,), ("{" * 50,), (long,)]
    df = spark.createDataFrame(rows, "c string").repartition(2).select(TEXT_COLUMNS[name]("c").alias("x"))
    assert len(df.collect()) == len(rows)


@pytest.mark.parametrize("name", sorted(TEXT_COLUMNS))
def test_empty_table(spark, name):
    assert spark.createDataFrame([], "c string").select(TEXT_COLUMNS[name]("c").alias("x")).collect() == []


def test_null_rules(spark):
    assert one(spark, strings.len_("c")) == 0
    assert one(spark, strings.to_lower("c")) == ""
    assert one(spark, strings.normalize("c")) == ""
    assert one(spark, html.strip("c")) == ""
    assert one(spark, convert.to_bool("c")) is False
    assert one(spark, html.sanitize("c")) is None


def test_dates(spark):
    at = F.lit("2024-02-09 00:05:07").cast("timestamp")
    for pattern, want in {"D, j M Y": "Fri, 9 Feb 2024", "P": "12:05 a.m.", "N jS": "Feb. 9th", "z W t L": "40 6 29 True", r"\a\t H": "at 00", "c": "2024-02-09T00:05:07+00:00", "x": "2024", "e": "", "y": "24"}.items():
        assert one(spark, dates.format_date(at, pattern)) == want
    assert one(spark, dates.format_date(F.lit("9999-08-17 12:00:00").cast("timestamp"), "Y")) is None
    feb = F.lit("2024-02-01").cast("timestamp")
    assert one(spark, dates.format_date(feb, "z")) == "32"
    assert one(spark, dates.format_date(feb, "z", compat=True)) == "30"
    assert one(spark, dates.format_date(at, "T O", "America/New_York")) == "EST -0500"
    parts = F.struct(F.lit(-500).alias("y"), F.lit(9).alias("m"), F.lit(2).alias("d"), F.lit(10).alias("h"), F.lit(11).alias("i"), F.lit(56).alias("s"))
    assert one(spark, convert.parts_to_isotime(parts)) == "-0500-09-02T10:11:56Z"
    assert set("aAbBcdDeEfFgGhHiIjlLmMnNOPrsStTUwWxyYzZ") == set(dates.TAGS)


def test_ip(spark):
    for ip, want in {"127.0.0.1": True, "::1": True, "192.168.1.10": True, "8.8.8.8": False, "100.64.3.255": True, "100.64.4.0": False, "fecf::1": True, "fed0::1": False, "fd12::": True, "x": False}.items():
        assert one(spark, net.is_local("c"), value=ip) is want, ip
    assert one(spark, net.ip_match("c", "10.0.0.0/8, fe80::/10"), value="10.1.2.3") is True
    assert one(spark, net.ip_match("c", "10.0.0.0/8"), value="::10.1.2.3") is False
    assert one(spark, net.reverse_ip("c"), value="127.0.0.1") == "1.0.0.127."
    assert one(spark, net.reverse_ip("c"), value="::1") == "1." + "0." * 31
    assert one(spark, net.is_email("c"), value="plop.blaat-hallo@ExAmple.COM") is True
    assert one(spark, net.is_email("c"), value="x@local") is False


def test_one_parse_for_all_fields(spark):
    df = P.page_metadata(spark.read.parquet(f"{SF}/pages.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_only_needed_columns_are_read(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 5").select("doc_id", strings.trim("lang").alias("x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_sql_names(spark):
    register(spark)
    row = spark.sql("select trim_space('\t a ') t, escape_html('<') e, is_email('a@b.cc') m, long_to_ip(2130706433) ip, normalize_text('Kiev') n, css_minify('a { b: c; }') c").first()
    assert tuple(row) == ("a", "&lt;", True, "127.0.0.1", "kyiv", "a{b: c}")
    rows = spark.sql("select seq, href, text from values ('<a href=\"x\">b<i>c</i></a><a name=z>d</a>') as v(h), lateral html_links(h)").collect()
    assert [tuple(r) for r in rows] == [(0, "x", "bc")]
    assert spark.sql("select count(*) n from values ('a { b: c }') as v(h), lateral css_tokens(h)").first()["n"] == 6


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.repartition(4).write.parquet(str(tmp_path / "in"))
    made = S.page_stream(spark, str(tmp_path / "in")).select("page_id", html.strip("html").alias("text"))
    S.to_folder(made, str(tmp_path / "out"), str(tmp_path / "state")).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = pages.select("page_id", html.strip("html").alias("text"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stream_windows(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").parquet(str(tmp_path / "in"))
    counts = S.text_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", types=F.approx_count_distinct("event_type"))
    query = counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 1000


class Answers:
    """A transport that answers from a table."""

    def __init__(self, table):
        self.table, self.asked = table, []

    def __call__(self, method, url, headers, body, timeout):
        self.asked.append((method, url, dict(headers).get("Range")))
        found = self.table[url]
        return found(dict(headers)) if callable(found) else found


def test_fetch():
    import gzip

    answers = Answers({
        "http://a.com/": (301, [("Location", "/b")], b""),
        "http://a.com/b": (303, [("location", "c")], b""),
        "http://a.com/c": (200, [("Content-Type", "text/html")], b"hello"),
        "http://z.com/": (200, [("content-encoding", "gzip")], gzip.compress(b"packed")),
        "http://r.com/": lambda h: (416, [], b"") if "Range" in h else (200, [], b"whole"),
        "http://l.com/": (302, [("location", "http://l.com/")], b""),
        "http://n.com/": (302, [], b""),
    })
    got = X.fetch_one("http://a.com/", answers, method="post", body=b"x")
    assert (got["ok"], got["final_url"], got["data"]) == (True, "http://a.com/c", b"hello")
    assert [m for m, _, _ in answers.asked] == ["post", "post", "get"]
    assert X.fetch_one("http://z.com/", answers)["data"] == b"packed"
    assert X.fetch_one("http://r.com/", answers)["data"] == b"whole"
    assert X.fetch_one("http://l.com/", answers)["error"] == "too many redirects"
    assert X.fetch_one("http://n.com/", answers)["error"] == "no location header"
    assert X.fetch_one("http://a.com/", method="get")["error"] == "no transport"
    assert X.fetch_one("nonsense")["ok"] is False
    parts = Answers({"http://p.com/": lambda h: (206, [("content-range", f"bytes {h['Range'][6:].split('-')[0]}-{int(h['Range'][6:].split('-')[0]) + 3}/8")], b"abcd")})
    assert X.fetch_one("http://p.com/", parts)["data"] == b"abcdabcd"
    assert X.location("http://a.com/", answers) == "http://a.com/b"


def test_fetch_tables(spark):
    urls_ = spark.createDataFrame([("data:,a%20b",), ("data:,a%20b",), ("data:text/html;base64,PGI+",), (None,), ("http://x.com/",)], "url string")
    got = {r["url"]: r for r in X.fetch(urls_).collect()}
    assert len(got) == 4
    assert bytes(got["data:,a%20b"]["data"]) == b"a b"
    assert got["http://x.com/"]["error"] == "no transport"
    assert got[None]["ok"] is None
    spark.dataSource.register(X.UrlSource)
    df = spark.read.format("urlfetch").option("urls", json.dumps(["data:,x", "data:,y"])).option("urlsPerPartition", "1").load()
    assert sorted(bytes(r["data"]) for r in df.collect()) == [b"x", b"y"]


def test_block_status(spark):
    ips = spark.createDataFrame([("1.1.1.1", 1), ("2.2.2.2", 2), ("3.3.3.3", 3), (None, 4)], "ip string, list int")
    answers = spark.createDataFrame([("1.1.1.1", "zen.spamhaus.org", "127.0.0.2"), ("2.2.2.2", "zen.spamhaus.org", "127.0.0.2"), ("2.2.2.2", "list.dnswl.org", "127.0.1.1"), ("3.3.3.3", "zen.spamhaus.org", "127.0.0.255")], "ip string, list string, answer string")
    got = {r["ip"]: (r["status"], r["lists"]) for r in net.block_status(ips, answers).collect()}
    assert got == {"1.1.1.1": ("blocked", ["zen.spamhaus.org"]), "2.2.2.2": ("allowed", None), "3.3.3.3": ("notlisted", None), None: ("notlisted", None)}


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).columns == ["site", "n_pages", "mean_text_chars", "same_heading"]
    assert set(E.oracle_sql()) <= set(E.queries())


ODD_TEXTS = ["", "plain", "Straße", "ÀÉÎ µ ß ŉ ſ İ ǰ", "ΣΊΣΥΦΟΣ", "é ü ñ", "éä", "Łódź", "a\x00b￾c￿", "\U0001f600 … €", "ΐΰᾷ", None]


def test_native_paths_equal_the_kernels(spark):
    import math

    from textloom.core import text as K

    rows = spark.createDataFrame([(x,) for x in ODD_TEXTS], "c string")
    got = rows.select("c", strings.to_lower("c").alias("low"), strings.unaccent("c").alias("bare"), strings.sanitize_utf8("c").alias("clean")).collect()
    assert [(r["low"], r["bare"], r["clean"]) for r in got] == [(K.casefold(r["c"]), K.unaccent(r["c"]), K.sanitize_utf8(r["c"])) for r in got]
    data = spark.createDataFrame([(bytearray(b"a\xffb\xe0\x80c"),), (bytearray("é".encode()),), (None,)], "c binary")
    assert [r["x"] for r in data.select(strings.sanitize_utf8("c").alias("x")).collect()] == ["abc", "é", None]
    numbers = [0.0, -0.0, 1.0, -1.0, 0.5, 3.7, 1e300, -1e-300, 5e-324, 1.7976931348623157e308, 2.0**52 - 0.5, 0.9999999999999999, 8.0, float("inf"), float("-inf"), None]
    found = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", strings.frexp("x").alias("f")).collect()
    assert [r["f"] and tuple(r["f"]) for r in found] == [None if r["x"] is None else math.frexp(r["x"]) for r in found]
