"""Pages by HTTP, through a transport that the caller gives; data: addresses need none.

A transport is called as transport(method, url, headers, body, timeout) and returns (status,
headers, bytes).  It runs inside tasks, so it has to be picklable.  Nothing is fetched by default:
the default transport refuses, and urllib_transport is there for machines with a network.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..core.url import abs_link, decode_data_url, parts
from ..functions.metadata import url_metadata

Headers = list[tuple[str, str]]
Transport = Callable[[str, str, Headers, bytes | None, float], tuple[int, Headers, bytes]]

#: Bytes fetched by default and at most, redirects, seconds, and what is sent along.
PARTIAL, LONGEST, REDIRECTS, TIMEOUT = 64 * 1024, 100 * 1024 * 1024, 10, 20.0
METADATA_LENGTH = 1024 * 1024
ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
AGENT, SIMPLE_AGENT = "textloom/1.0", "curl/8.0"
#: Hosts that answer with scripts unless the client looks like a simple one.
SHORTENERS = frozenset("bit.ly fb.me goo.gl gu.com j.mp lnkd.in nyti.ms ow.ly s.vk.nl t.co tinyurl.com wp.me".split())
METHODS = ("get", "post", "put", "delete", "patch", "head")
SCHEMA = "url string, ok boolean, status int, final_url string, headers array<struct<name: string, value: string>>, length bigint, data binary, error string"


def no_transport(method: str, url: str, headers: Headers, body: bytes | None, timeout: float) -> tuple[int, Headers, bytes]:
    raise ConnectionError("no transport")


def urllib_transport(method: str, url: str, headers: Headers, body: bytes | None, timeout: float) -> tuple[int, Headers, bytes]:
    """One request by the standard library; redirects are left to the caller."""
    import urllib.error
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args: object) -> None:
            return None

    opener = urllib.request.build_opener(Stay)
    try:
        with opener.open(urllib.request.Request(url, body, dict(headers), method=method.upper()), timeout=timeout) as r:
            return r.status, list(r.headers.items()), r.read(LONGEST)
    except urllib.error.HTTPError as e:
        return e.code, list(e.headers.items()), e.read(LONGEST)


def normalize(url: str) -> str:
    """Scheme (http if none), host, path and query; user and fragment go."""
    scheme, host, path, query = parts(url)
    if not host:
        raise ValueError("url")
    return f"{scheme or 'http'}://{host}{path}" + (f"?{query}" if query else "")


def _unzipped(data: bytes, limit: int) -> bytes:
    """As much of (perhaps cut off) gzip data as there is, up to limit; data itself if it is none."""
    try:
        return zlib.decompressobj(31).decompress(data, limit)
    except zlib.error:
        return data


def _header(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name), None)


def _complete(headers: Headers, limit: int | None) -> bool:
    m = re.fullmatch(r"bytes (\d+)-(\d+)/(\d+|\*)", _header(headers, "content-range") or "")
    if limit is None or not m:
        return True
    last = int(m[2])
    return last >= limit + 1 or m[3] != "*" and last + 1 == int(m[3])


def fetch_one(url: str, transport: Transport = no_transport, method: str = "get", body: bytes | None = None, max_length: int | None = PARTIAL, timeout: float = TIMEOUT, use_range: bool = True, accept: str = ACCEPT, language: str = "en", user_agent: str | None = None, content_type: str | None = None, authorization: str | None = None, headers: Headers = ()) -> dict:
    """{ok, status, final_url, headers, length, data, error} of one address.

    At most max_length bytes (None: LONGEST); redirects are followed (303 by get), a refused range
    is asked for again without one, ranges that stop early are continued, gzip is unpacked.
    """
    if url.startswith("data:"):
        found = decode_data_url(url)
        if not found or not found["ok"]:
            return {"ok": False, "error": (found or {}).get("error", "nodata")}
        own = [("content-type", found["mime"]), ("content-length", str(len(found["data"])))]
        return {"ok": True, "status": 200, "final_url": "data://", "headers": own, "length": len(found["data"]), "data": found["data"]}
    if method not in METHODS:
        return {"ok": False, "error": f"method {method}"}
    limit, got = LONGEST if max_length is None else min(max_length, LONGEST), b""
    hops = 0
    try:
        url = normalize(url)
        while True:
            agent = user_agent or (SIMPLE_AGENT if parts(url)[1] in SHORTENERS else AGENT)
            ask = [("Accept", accept), ("Accept-Encoding", "identity"), ("Accept-Language", f"{language},*;q=0"), ("User-Agent", agent), *headers]
            if max_length is not None and method == "get" and use_range:
                ask.append(("Range", f"bytes={len(got)}-{limit - 1}"))
            if authorization:
                ask.append(("Authorization", authorization))
            if body is not None:
                ask.append(("Content-Type", content_type or "application/octet-stream"))
            status, answer, data = transport(method, url, ask, body, timeout)
            again = status == 416 and use_range
            if again or status in (301, 302, 303, 307, 308):
                hops += 1
                if hops > REDIRECTS:
                    return {"ok": False, "status": status, "final_url": url, "error": "too many redirects"}
                if again:
                    use_range, method, got = False, "get", b""
                    continue
                if (to := _header(answer, "location")) is None:
                    return {"ok": False, "status": status, "final_url": url, "error": "no location header"}
                url = normalize(abs_link(to, url) or "")
                if status == 303:
                    method, body = "get", None
                continue
            got += data
            if 200 <= status < 300 and len(got) < limit and data and not _complete(answer, limit):
                continue
            if (_header(answer, "content-encoding") or "").lower() == "gzip":
                got = _unzipped(got, limit)
            got = got[:limit]
            ok = 200 <= status < 300
            return {"ok": ok, "status": status, "final_url": url, "headers": [(k.lower(), v) for k, v in answer], "length": len(got), "data": got, "error": None if ok else f"status {status}"}
    except (OSError, ValueError) as e:
        return {"ok": False, "final_url": url, "error": str(e) or type(e).__name__}


def location(url: str, transport: Transport = no_transport, timeout: float = TIMEOUT) -> str:
    """Where 301 answers to head requests lead; the address itself where nothing answers."""
    for _ in range(REDIRECTS):
        try:
            status, answer, _ = transport("head", url, [("User-Agent", AGENT)], None, timeout)
        except (OSError, ValueError):
            return url
        to = _header(answer, "location") if status == 301 else None
        if to is None:
            return url
        url = abs_link(to, url) or url
    return url


_TYPES = {"ok": pa.bool_(), "status": pa.int32(), "final_url": pa.string(), "headers": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), "length": pa.int64(), "data": pa.binary(), "error": pa.string()}


def _columns(urls: list[str | None], options: dict) -> list[pa.Array]:
    rows = [{} if u is None else fetch_one(u, **options) for u in urls]
    for r in rows:
        if r.get("headers") is not None:
            r["headers"] = [{"name": k, "value": v} for k, v in r["headers"]]
    return [pa.array(urls, pa.string()), *(pa.array([r.get(k) for r in rows], t) for k, t in _TYPES.items())]


def fetch(urls: DataFrame, url_col: str = "url", **options: object) -> DataFrame:
    """Each distinct address of a column, fetched once, by the options of fetch_one; a null address has null results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                some = batch.column(0).slice(at, 16).to_pylist()
                yield pa.RecordBatch.from_arrays(_columns(some, options), ["url", *_TYPES])

    return urls.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(run, SCHEMA)


def fetch_metadata(urls: DataFrame, url_col: str = "url", max_length: int = METADATA_LENGTH, **options: object) -> DataFrame:
    """(url, ok, status, error, metadata): each distinct address fetched as by fetch, and what its answer says of itself; null where nothing came."""
    found = fetch(urls, url_col, max_length=max_length, **options)
    at = F.when(F.col("final_url") == "data://", F.col("url")).otherwise(F.col("final_url"))
    return found.select("url", "ok", "status", "error", F.when(F.col("ok"), url_metadata(at, "data", "headers")).alias("metadata"))


def locations(urls: DataFrame, url_col: str = "url", transport: Transport = no_transport, timeout: float = TIMEOUT) -> DataFrame:
    """(url, location): for each distinct address where it has moved to for good; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_pylist()
            moved = [None if u is None else location(u, transport, timeout) for u in asked]
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array(moved, pa.string())], ["url", "location"])

    return urls.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(run, "url string, location string")


class _Urls(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.size = int(options.get("urlsperpartition", 16))
        self.max_length = int(options.get("maxlength", PARTIAL))
        self.transport = urllib_transport if options.get("network", "false").lower() == "true" else no_transport

    def partitions(self) -> list[_Urls]:
        return [_Urls(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(_columns(partition.urls, {"transport": self.transport, "max_length": self.max_length}), ["url", *_TYPES])


class UrlSource(DataSource):
    """spark.read.format("urlfetch").option("urls", JSON list): options maxLength, urlsPerPartition, network (true: by urllib)."""

    @classmethod
    def name(cls) -> str:
        return "urlfetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)
