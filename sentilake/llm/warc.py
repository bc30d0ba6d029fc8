"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by a join.

An archive is two tables in one folder. ``payloads`` holds each distinct payload with its SHA-256, found on the bytes
themselves and, where several pages give the same digest, verified by a second digest and the length. ``headers`` holds one
row a record: the header block byte for byte as it stands in a WARC file, and the digest by which its payload is found. A
revisit has a header and no payload of its own. Rebuilding joins both; reading checks each payload against its record.
"""

from pyspark.sql import functions as F

from sentilake.session import scratch_path

LEAST_REVISIT = 100  # bytes
END = "\r\n"
DATE = "2024-01-01T00:00:00Z"  # records carry no time of their own: the tables have none


def _record_id(key, kind):
    """A name-based identifier, so that a second run writes the same bytes."""
    h = F.sha2(F.concat(F.lit(f"{kind}:"), key), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name, value):
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def records(pages, id_col="page_id", url_col="url", html_col="html"):
    """One row a page without its payload: id, url, digest, second digest, bytes, and the first page with that payload."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.sha2(payload, 256).alias("digest"),
        F.xxhash64(payload).alias("second"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    first = rows.groupBy("digest").agg(
        F.min("id").alias("first"), F.min("second").alias("s0"), F.max("second").alias("s1"), F.min("bytes").alias("b0"), F.max("bytes").alias("b1")
    )
    same = F.raise_error(F.concat(F.lit("different payloads under digest "), F.col("digest")))
    first = first.select("digest", F.when((F.col("s0") != F.col("s1")) | (F.col("b0") != F.col("b1")), same.cast("long")).otherwise(F.col("first")).alias("first"))
    return rows.join(first, "digest")


def write(pages, path, id_col="page_id", url_col="url", html_col="html", least=LEAST_REVISIT, date=DATE):
    """Write the archive of pages into a new folder.

    Equal payloads of ``least`` bytes and more are stored for the smallest id and revisited by the others; shorter ones are
    all responses, stored once. Null html is an empty payload, a null url an empty one; a null id is never a response that
    others revisit unless no other page has the payload. Rows that repeat an id are records of their own; if it is the
    smallest of its payload, all of them are responses. Other columns are not read. An empty table gives an empty archive.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    stored = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    stored.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    r = records(pages, id_col, url_col, html_col)
    revisit = (F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("first"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + END),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(key, "record")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Page-ID", key),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Refers-To", _record_id(F.col("first").cast("string"), "record")),
                _line("WARC-Refers-To-Page-ID", F.col("first").cast("string")),
                _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                _line("WARC-Payload-Length", F.col("bytes").cast("string")),
            ),
        ).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(END),
    )
    r.select(head.cast("binary").alias("header"), "digest", revisit.alias("revisit")).write.parquet(f"{path}/headers")


def rebuild(spark, path):
    """(record, digest, header, payload) of each record, record being its bytes in a WARC file; revisits get the payload they refer to."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    body = F.when(F.col("revisit"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(F.col("header"), body, F.lit(END + END).cast("binary"))
    return headers.join(payloads, "digest").select(record.alias("record"), "digest", "header", "payload")


def _field(header, name):
    got = F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(got != "", got)


def read(spark, path):
    """One row a record, from its rebuilt header and payload: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A payload that is not the one its header names is an error.
    """
    h = F.decode("header", "UTF-8")
    rows = rebuild(spark, path).select(
        _field(h, "WARC-Page-ID").cast("long").alias("page_id"),
        F.coalesce(_field(h, "WARC-Target-URI"), F.lit("")).alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        _field(h, "WARC-Type").alias("record_type"),
        _field(h, "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        _field(h, "WARC-Payload-Digest").alias("named"),
        "payload",
    )
    broken = F.raise_error(F.concat(F.lit("payload does not match "), F.col("named")))
    checked = F.when(F.concat(F.lit("sha256:"), F.col("payload_digest")) == F.col("named"), F.col("payload_digest")).otherwise(broken.cast("string"))
    return rows.withColumn("payload_digest", checked).drop("named")


def parse(records_df, column="record"):
    """(header, payload) of record bytes: the header ends at the first empty line, the payload has the length it states."""
    text = F.decode(F.col(column), "ISO-8859-1")
    cut = F.instr(text, END + END) + 3
    header = F.substring(F.col(column), 1, cut)
    size = F.regexp_extract(F.decode(header, "UTF-8"), r"(?m)^Content-Length: ([0-9]+)\r?$", 1).cast("int")
    return records_df.select(header.alias("header"), F.substring(F.col(column), cut + 1, size).alias("payload"))


def archived(pages, id_col="page_id", url_col="url", html_col="html"):
    """Write pages into a new archive in the shared folder and read it back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, html_col)
    return read(pages.sparkSession, path)
