import gzip
import hashlib
import io

import pytest

from ledgerlark.llm import warc


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, lang string, payload int")


def test_round_trip(spark):
    data = [(i, f"https://a.b/{i}?q=ä b\n", f"<p>{i % 40} ü</p>" * (i % 9), "en", 1) for i in range(300)] + [(300, None, None, "x", 2)]
    got = {r.page_id: r for r in warc.round_trip(rows(spark, data)).collect()}
    assert len(got) == 301 and all(r.valid for r in got.values())
    first = {}
    for page, _, html, *_ in data:
        first.setdefault(html or "", page)
    for page, _, html, *_ in data:
        payload, r = (html or "").encode(), got[page]
        assert r.payload_bytes == len(payload) and r.payload_digest == warc.base32_sha1(payload)
        want = first[html or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if want == page else ("revisit", want))


def test_least_bytes_nulls_repeats_and_empty(spark):
    data = [(1, "u", "same", "", 0), (2, "u", "same", "", 0), (2, "u", "same", "", 0), (None, None, "same", "", 0), (None, None, "alone", "", 0)]
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.round_trip(rows(spark, data)).collect())
    assert kinds == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (2, "revisit", 1), (2, "revisit", 1)]
    assert {r.record_type for r in warc.round_trip(rows(spark, data), least=5).collect()} == {"response"}
    assert warc.round_trip(rows(spark, [])).count() == 0


def test_members_rolling_and_payloads(spark):
    data = [(i, "u", f"{i} " * 5000, "", 0) for i in range(20)]
    archives = warc.write_archives(warc.planned(rows(spark, data)), warc.fresh_path(spark, "t"), roll=1)
    assert archives.count() == 20
    got = {r.page_id: r for r in warc.read_archives(archives, payloads=True).collect()}
    assert all(got[i].payload.decode() == html for i, _, html, *_ in data)
    path = archives.first().path.removeprefix("file://")
    with gzip.open(path) as f:
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_damage_is_found():
    good = warc.record(1, "u", b"abc" * 1000, "response", None) + warc.record(2, "u", b"abc" * 1000, "revisit", 1)
    assert [(r["page_id"], r["valid"], r["payload_bytes"]) for r in warc.records(io.BytesIO(good))] == [(1, True, 3000), (2, True, 3000)]
    plain = gzip.decompress(warc.record(1, "u", b"abc", "response", None))
    wrong = gzip.compress(plain.replace(b"abc", b"abd"))
    assert [r["valid"] for r in warc.records(io.BytesIO(wrong))] == [False]
    for broken in (good[:-9], gzip.compress(plain[:-6]), gzip.compress(plain + b"x")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(broken)))
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")
