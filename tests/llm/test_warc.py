import base64
import gzip
import hashlib
import io

import pytest
from kindred.llm import warc as R
from kindred.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, digest string"


def pages(spark):
    rows = [(1, "http://a/é x", "<p>one</p>", "clash"), (2, "http://b", "<p>one</p>", "c"), (3, None, None, None), (4, "u", "", "c"), (5, "u", "ünï" * 40_000, "c"), (None, "n", "<p>one</p>", "c"), (5, "u", "ünï" * 40_000, "c"), (None, "n", "alone", "c")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_round_trip(spark):
    rows, df = pages(spark)
    got = [tuple(r) for r in R.read_archives(R.write_archives(df, fresh_path(spark, "w"))).collect()]
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h, _ in rows:
        data = (h or "").encode()
        revisit = (h or "") in first and first[h or ""] != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, u or "", "revisit" if revisit else "response", digest, len(data), first[h or ""] if revisit else None, b"" if revisit else data))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert R.read_archives(R.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0


def test_reader_checks_framing_and_digest():
    good = R.page_record(1, "u", "text", R.base32_sha1(b"text"), None) + R.page_record(2, "v", "", R.base32_sha1(b""), None)
    assert [p for _, p in R.read_records(io.BytesIO(good))] == [b"text", b""]
    plain = gzip.decompress(R.page_record(1, "u", "text", R.base32_sha1(b"text"), None))
    for bad in (plain.replace(b"text", b"tax!"), plain[:-4], plain.replace(b"WARC/1.1", b"XARC/1.1"), plain + b"more"):
        with pytest.raises(R.WarcError):
            list(R.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(R.WarcError):
        list(R.read_records(io.BytesIO(good[:-20])))


def test_urls_come_back_unchanged(spark):
    urls = ["http://a/b%20c", "http://a/%2F%2f?x=%zz#y", "http://a/b c\td", "http://a/50% off ", " lead", "", "http://ä/日本?q=1&r=%"]
    pages = spark.createDataFrame([(i, u, f"<p>{i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r["url"] for r in R.read_archives(R.write_archives(pages), with_payload=False).collect()}
    assert [got[i] for i in range(len(urls))] == urls
