"""A content-addressed WARC archive: payload bytes once by strong digest, exact record headers beside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.shared import base32_of_hex, keep, new_folder

CRLF = "\r\n"
#: When every record says it was written: archives of the same pages are equal byte for byte.
WRITTEN = "2024-01-01T00:00:00Z"


@dataclass
class Archive:
    """Two Parquet tables in one folder.  ``records``: page_id, record_type, header (the exact bytes from ``WARC/1.1`` to
    the blank line), http (the HTTP header block), strong (SHA-256 of the payload).  ``payloads``: strong, payload."""

    spark: SparkSession
    path: str

    @property
    def records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/payloads")


def _uuid(of: Column) -> Column:
    h = F.md5(of.cast("binary"))
    return F.concat(F.lit("urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]])


def _field(name: str, value: Column) -> Column:
    """A header line; none where the value is null.  Line breaks inside a value would end the header, so they are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def write_archive(pages: DataFrame, path: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> Archive:
    """One record per row.  Of the records whose equal payloads have ``least_bytes`` or more, the one of the largest id is
    the response and the others revisit it; all smaller ones are responses.  Repeated rows share their record type; a null
    id is a response only if no other record has its payload; a null payload is empty; a null url gives no target line.
    Line ends within a url are escaped, any other character stays, so a url cannot add a header.  Other columns are ignored,
    whatever their names; an empty table gives an empty archive.  A payload is one value of a row, so the longest that Spark
    can read can be stored.

    Payloads are grouped by SHA-256; that a group's members also agree in length and in a second hash is checked, and a
    group that does not is an error, not a wrong archive.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"strong": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long")})
    stored = rows.groupBy("strong").agg(F.first("payload").alias("payload"), F.min("n_bytes").alias("n0"), F.max("n_bytes").alias("n1"), F.min(F.xxhash64("payload")).alias("h0"), F.max(F.xxhash64("payload")).alias("h1"))
    sound = (F.col("n0") == F.col("n1")) & (F.col("h0") == F.col("h1"))
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("binary"))
    stored.select("strong", checked.alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    light = rows.select("page_id", "url", "strong", "n_bytes", F.sha1("payload").alias("sha1"))
    chosen = light.where(F.col("n_bytes") >= least_bytes).groupBy("strong").agg(F.max("page_id").alias("response_id"), F.max_by("url", "page_id").alias("response_url"), F.count(F.lit(1)).alias("n"))
    # written first, and only where there are copies: the join reads two plain exchanges, so a payload of very many pages
    # can be split, and most pages meet nothing
    chosen = keep(chosen.where("n > 1").drop("n"), "copies")
    named = light.join(chosen.withColumn("copied", F.lit(True)), "strong", "left")
    own = F.col("copied").isNull() | F.col("page_id").eqNullSafe(F.col("response_id"))
    kind = F.when(own, "response").otherwise("revisit")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    named = named.select("*", kind.alias("record_type"), http.alias("http"))
    id_of = lambda page: _uuid(F.coalesce(page.cast("string"), F.lit("none")))
    angle = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    length = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", angle(id_of(F.col("page_id")))),
        _field("WARC-Date", F.lit(WRITTEN)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1"), 40))),
        _field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("WARC-Refers-To", F.when(revisit, angle(id_of(F.col("response_id"))))),
        _field("WARC-Refers-To-Target-URI", F.when(revisit, F.col("response_url"))),
        _field("WARC-X-Page", F.col("page_id").cast("string")),
        _field("WARC-X-Refers-To-Page", F.when(revisit, F.col("response_id").cast("string"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    named.select("page_id", "record_type", header.cast("binary").alias("header"), F.col("http").cast("binary").alias("http"), "strong").write.option("compression", "zstd").parquet(f"{path}/records")
    return Archive(spark, path)


def _parts(archive: Archive) -> DataFrame:
    """The responses as they were: their header parts, and their payload fetched by digest, one to one.  A payload whose
    SHA-256 is not its key, or that is missing, is an error."""
    good = F.sha2("payload", 256) == F.col("strong")
    payloads = archive.payloads.select("strong", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("binary")).alias("payload"))
    found = archive.records.where("record_type = 'response'").join(payloads, "strong", "left")
    return found.withColumn("payload", F.coalesce(F.col("payload"), F.raise_error(F.lit("a payload is missing")).cast("binary")))


def reconstruct(archive: Archive) -> DataFrame:
    """(page_id, record binary): every original record, byte for byte.  Revisits hold no payload, so the payload of a large
    group of copies moves once."""
    end = F.lit(CRLF * 2).cast("binary")
    whole = _parts(archive).select("page_id", F.concat("header", "http", "payload", end).alias("record"))
    return whole.unionByName(archive.records.where("record_type = 'revisit'").select("page_id", F.concat("header", "http", end).alias("record")))


def _line(name: str) -> Column:
    """A header's value.  Only CRLF ends a line here; a url may hold other characters that some readers take for line ends."""
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_index(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archive: types, links and
    digests from the record headers, lengths and digests once more from the reconstructed responses, which must agree.
    Revisits take those of the response that has their payload."""
    page = F.nullif(_line("WARC-X-Page"), F.lit("")).cast("long").alias("page_id")
    said = F.regexp_replace(_line("WARC-Payload-Digest"), "^sha1:", "").alias("said")
    found = base32_of_hex(F.sha1("payload"), 40).alias("payload_digest")
    # lengths and digests are written once; the join that gives them to the revisits can split a payload of very many
    responses = keep(_parts(archive).select("strong", page, F.octet_length("payload").cast("long").alias("payload_bytes"), found, said), "responses")
    revisits = archive.records.where("record_type = 'revisit'").select("strong", page, said, F.nullif(_line("WARC-X-Refers-To-Page"), F.lit("")).cast("long").alias("refers_to"))
    by_payload = keep(responses.groupBy("strong").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")), "payload-index")
    both = responses.select("page_id", "payload_bytes", "payload_digest", "said", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    both = both.unionByName(revisits.join(by_payload, "strong").select("page_id", "payload_bytes", "payload_digest", "said", F.lit("revisit").alias("record_type"), "refers_to"))
    same = F.when(F.col("said") == F.col("payload_digest"), F.col("said")).otherwise(F.raise_error(F.lit("a record's digest is not its payload's")))
    return both.select("page_id", "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")
