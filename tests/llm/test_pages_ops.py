"""URL filter and WARC archives: contract cases, round trips and edge cases."""

from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import url_reputation, warc

PAGES = "page_id long, url string, html string, host string, sha1 string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


def test_hosts_paths_and_rules(spark):
    urls = {
        1: ("HTTPS://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("http://example.net/fr", "example.net", "/fr", "net/", "block"),
        3: ("http://b.example.com/de/1#top", "b.example.com", "/de/1", "example.com/de/", "block"),
        4: ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        5: ("http://net", "net", "", None, "allow"),
        6: (None, "", "", None, "allow"),
        7: ("no scheme/net/", "", "", None, "allow"),
        8: ("ftp://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        9: ("http://Ä.net?x", "Ä.net", "", None, "allow"),
        10: ("a://b://c.net/", "b:", "//c.net/", None, "allow"),
    }
    df = pages(spark, [(i, u[0], "") for i, u in urls.items()])
    none = spark.createDataFrame([], "host string, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(df, none).collect()}
    assert got == {i: u[1:] for i, u in urls.items()}
    assert url_reputation.judge_urls(df.limit(0), none).count() == 0


def test_bad_hosts_are_blocked_and_sparse_ones_shrink(spark):
    outcomes = [("bad.a.com", 0)] * 60 + [("good.a.com", 1)] * 200 + [("few.a.com", 0)] + [(f"h{i}.b.com", i % 10 > 0) for i in range(200)] + [(None, 1), ("x.com", None)]
    df = spark.createDataFrame([(h, None if g is None else int(g)) for h, g in outcomes], "host string, good int")
    urls = pages(spark, [(1, "http://bad.a.com/", ""), (2, "http://good.a.com/", ""), (3, "http://few.a.com/", ""), (4, "http://unseen.a.com/", ""), (1, "http://bad.a.com/", "")])
    got = sorted((r.page_id, r.verdict) for r in url_reputation.judge_urls(urls, df, rules=()).collect())
    assert got == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "allow")]
    rates = {r.host: r.a / (r.a + r.b) for r in url_reputation.host_reputation(df).collect()}
    assert rates["bad.a.com"] < rates["few.a.com"] < rates["good.a.com"]


def test_unseen_hosts_have_the_prior_of_domain_or_suffix(spark):
    outcomes = [(f"h{i}.spam.bad", 0) for i in range(40)] * 5 + [(f"h{i}.junk.bad", 0) for i in range(40)] * 5 + [(f"h{i}.fine.good", 1) for i in range(80)] * 5
    df = spark.createDataFrame(outcomes, "host string, good int")
    urls = pages(spark, [(1, "http://new.spam.bad/", ""), (2, "http://new.other.bad/", ""), (3, "http://new.fine.good/", ""), (4, "http://new.other.good/", ""), (5, "http://new.else/", ""), (6, None, "")])
    got = {r.page_id: r.verdict for r in url_reputation.judge_urls(urls, df, rules=()).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, tmp_path, least):
    rows = [(i, f"http://h/{i}", "payload é" * (i % 7)) for i in range(60)] + [(100, None, None), (101, "", ""), (None, "u\r\nInjected: yes", "payload é" * 2), (3, "http://h/3", "payload é" * 3), (200, "x", "\r\n\r\nWARC/1.1\r\n" * 9), (201, "x", "long " * 60000)]
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark, rows).repartition(3), path, least)
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    first: dict = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for r in got:
        options = [(u, (h or "").encode()) for i, u, h in rows if i == r.page_id]
        texts = [h for _, h in options]
        assert r.payload_bytes in map(len, texts)
        if r.record_type == "response":
            assert r.payload in texts
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
            assert r.page_id is None or len(r.payload) < least or first[r.payload.decode()] == r.page_id
        else:
            text = next(h for h in texts if base64.b32encode(hashlib.sha1(h).digest()).decode() == r.payload_digest)
            assert r.payload is None
            assert len(text) >= least
            assert r.refers_to == first[text.decode()] != r.page_id
    assert {r.url for r in got if r.page_id is None} == {"u%0D%0AInjected: yes"}


def test_pushed_predicates_and_headers_only(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark, [(i, f"http://h{i % 2}/{i}", f"t{i % 4}") for i in range(40)]), path)
    df = warc.read_archive(spark, path)
    assert df.where("record_type = 'revisit'").count() == 36
    assert df.where(F.col("page_id").isin(1, 2) & (F.length("payload") > 0)).count() == 2
    assert df.where(F.col("url").startswith("http://h1/")).count() == 20
    assert df.where("page_id > 35").count() == 4
    assert "payload" not in warc.read_archive(spark, path, payload=False).columns
    reader = warc.WarcReader({"path": path}, warc_schema(["page_id", "payload"]))
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"")])) == [warc.EqualTo(("payload",), b"")]


def warc_schema(names):
    from pyspark.sql.types import StringType, StructField, StructType

    return StructType([StructField(n, StringType()) for n in names])


def test_an_unfinished_write_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark, [(1, "a", "b")]), path)
    (tmp_path / "w" / "_writing-1").mkdir()
    (tmp_path / "w" / "_writing-1" / "part-lost.warc.gz").write_bytes(warc.member(warc.record(9, "u", b"x", "D", None, "2024-01-01T00:00:00Z"), 1))
    assert [r.page_id for r in warc.read_archive(spark, path).collect()] == [1]


def test_sites_have_registered_domains(spark):
    want = {"a.b.co.uk": ("a.b.co.uk", "b.co.uk", "co.uk"), "b.co.uk:8080": ("b.co.uk", "b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk", "co.uk"), "me:pw@x.example.com:80": ("x.example.com", "example.com", "com"), "localhost": ("localhost",) * 3, "10.0.0.1:99": ("10.0.0.1",) * 3, "": ("",) * 3, "notco.uk": ("notco.uk", "notco.uk", "uk"), "w.example.org.": ("w.example.org", "example.org", "org")}
    df = spark.createDataFrame([(h,) for h in want], "h string")
    got = df.select("h", F.struct(*(c.alias(n) for c, n in zip(url_reputation.site_of(F.col("h")), "nds", strict=True))).alias("s")).collect()
    assert {r.h: tuple(r.s) for r in got} == want


def ordinary(kind, url, body, more="", content="application/http; msgtype=response", version="1.0", ending="\r\n"):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nwarc-record-id:<urn:uuid:{url}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\n{more}Content-Type: {content}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.replace("\r\n", ending).encode() + body + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"


@pytest.mark.parametrize("form", ["plain", "by record", "whole"])
def test_ordinary_archives(spark, tmp_path, form):
    """Records of other writers: no private fields, folded headers, other types, chunks, an archive inside a payload."""
    import gzip

    inner = ordinary("response", "inner", HTTP + b"not to be seen")
    digest = warc.digest(b"abc" * 500_000)
    records = [
        ordinary("warcinfo", "info", b"software: x\r\n", content="application/warc-fields"), ordinary("request", "a", b"GET / HTTP/1.1\r\n\r\n", content="application/http; msgtype=request"),
        ordinary("response", "a", HTTP + b"abc" * 500_000, f"WARC-Payload-Digest: SHA1:{digest}\r\nX-Folded: one\r\n two\r\n"), ordinary("response", "b", HTTP + inner + gzip.compress(inner, mtime=0), version="1.1"),
        ordinary("response", "c", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n"), ordinary("resource", "d", b"\n\nplain body\r\n\r\n", content="text/plain"),
        ordinary("revisit", "a", HTTP, f"WARC-Payload-Digest: sha1:{digest}\r\n"), ordinary("response", "e", b"HTTP/1.0 204 No\r\n\r\n", ending="\n"),
    ]
    data = {"plain": b"".join(records), "by record": b"".join(map(gzip.compress, records)), "whole": gzip.compress(b"".join(records))}[form]
    (tmp_path / ("x.warc" if form == "plain" else "x.warc.gz")).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no archive")
    got = {(r.record_type, r.url): r for r in warc.read_archive(spark, f"file://{tmp_path}").collect()}
    want = {("response", "a"): b"abc" * 500_000, ("response", "b"): inner + gzip.compress(inner, mtime=0), ("response", "c"): b"Wikipedia", ("resource", "d"): b"\n\nplain body\r\n\r\n", ("response", "e"): b"", ("revisit", "a"): None, ("warcinfo", "info"): b"software: x\r\n", ("request", "a"): b""}
    assert {k: r.payload for k, r in got.items()} == want
    assert got["response", "a"].payload_digest == got["revisit", "a"].payload_digest == digest
    assert got["response", "b"].record_id == "urn:uuid:b"
    assert got["response", "b"].page_id is None
    lean = warc.read_archive(spark, f"file://{tmp_path}", payload=False).where("record_type = 'response' and url in ('a', 'e')")
    assert sorted((r.url, r.payload_bytes) for r in lean.collect()) == [("a", 1_500_000), ("e", 0)]


def test_damage_shows(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(ordinary("response", "a", HTTP + b"abd", f"WARC-Payload-Digest: sha1:{warc.digest(b'abc')}\r\n"))
    with pytest.raises(Exception, match="another digest"):
        warc.read_archive(spark, f"file://{tmp_path}").collect()
    assert warc.read_archive(spark, f"file://{tmp_path}", verify=False).first().payload == b"abd"
    (tmp_path / "x.warc").write_bytes(ordinary("response", "a", HTTP + b"abc")[:-9])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archive(spark, f"file://{tmp_path}").collect()


def test_unwanted_members_are_not_inflated(monkeypatch, tmp_path):
    members = [warc.member(warc.record(i, "u", bytes(900_000), warc.digest(bytes(900_000)), None, "2024-01-01T00:00:00Z"), 1) for i in range(5)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    reader = warc.WarcReader({"path": f"file://{tmp_path}"}, warc_schema(["page_id", "payload_bytes"]))
    monkeypatch.setattr(warc, "CHUNK", 4096)
    drops, inner = [], warc._Stream.drop
    monkeypatch.setattr(warc._Stream, "drop", lambda self, n: drops.append(self.next_member is not None and self.inflate is not None) or inner(self, n))
    rows = [r for p in reader.partitions() for r in reader.records(p)]
    assert [(r["page_id"], r["payload_bytes"]) for r in rows] == [(i, 900_000) for i in range(5)]
    assert drops == [True] * 5


def test_empty_archive(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(pages(spark, []).limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_members_are_plain_gzip():
    import gzip

    text = warc.record(1, "u", b"abc" * 99, "D", None, "2024-01-01T00:00:00Z")
    assert gzip.decompress(warc.member(text, 1) + warc.member(text, 6)) == text * 2
