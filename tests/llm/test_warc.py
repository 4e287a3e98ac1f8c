import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import warc

ROWS = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u\r\nv", "é" * 1000), (5, "http://c", "<p>x</p>"), (6, "z", ""), (6, "z", ""), (None, "n", "only"), (7, "s", "tiny")]


def want(rows, least=0):
    last = {}
    for i, _, h in rows:
        last[h or ""] = max([x for x in (i, last.get(h or "")) if x is not None], default=None)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        own = len(b) < least or last[h or ""] == i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else last[h or ""]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_index(spark, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("strong", F.lit(1))
    archive = warc.write_archive(df, least_bytes=least)
    assert sorted(map(tuple, warc.read_index(archive).collect()), key=str) == want(ROWS, least)
    assert archive.payloads.count() == len({h or "" for _, _, h in ROWS})


def test_records_are_whole_and_exact(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    for r in warc.reconstruct(archive).collect():
        raw = bytes(r.record)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[:-4]
        assert raw.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(block)
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK")
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            assert payload == b"" and "WARC-Refers-To" in fields


def test_damage_is_an_error(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    bad = archive.payloads.withColumn("payload", F.concat("payload", F.lit("!").cast("binary"))).collect()
    spark.createDataFrame(bad, "strong string, payload binary").write.mode("overwrite").parquet(f"{archive.path}/payloads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_index(archive).collect()


def test_empty(spark):
    assert warc.read_index(warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_urls_cannot_add_headers(spark):
    rows = [(1, "http://a\u2028WARC-X-Page: 999", "x"), (2, "http://b\u0085WARC-Payload-Digest: sha1:NONE", "x"), (3, "\r\nWARC-X-Page: 7\r\n", "x"), (4, "\nWARC-Type: revisit\u2029WARC-X-Page: 8", "y")]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(map(tuple, warc.read_index(archive).collect())) == want(rows)


def test_long_payloads_and_many_copies(spark):
    rows = [(1, "a", "long " * 1_000_000), (2, "b", "long " * 1_000_000), *[(i, None, None) for i in range(3, 3000)]]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(map(tuple, warc.read_index(archive).collect()), key=str) == want(rows)
    assert archive.payloads.count() == 2
