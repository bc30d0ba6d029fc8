import hashlib

import pytest

from sentilake.llm import warc


def want(pages):
    first = {}
    for i, _, html in pages:
        body = (html or "").encode()
        if i is not None:
            first[body] = min(first.get(body, i), i)
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        again = len(body) >= 100 and i != first.get(body)
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


PAGES = [
    (5, "http://a/", "é" * 60), (3, "http://b/", "é" * 60), (9, "http://c/", "é" * 60), (4, None, "short"), (2, "http://d/", "short"),
    (1, "http://e/", None), (7, "http://f/", ""), (8, "http://g/?x=\tü", "x" * 100), (10, "u", "x" * 99), (11, "u", "x" * 99),
    (12, "u", "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n\r\n" * 5), (13, "u", "y" * 200), (13, "u", "y" * 200), (14, "v", "y" * 200),
]


def test_archive(spark, rows, tmp_path):
    pages = rows([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    warc.write(pages, str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a"))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == want(PAGES)
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == len({p[2] or "" for p in PAGES})
    urls = {r.page_id: (r.url, bytes(r.payload).decode()) for r in got.collect()}
    assert urls[8] == ("http://g/?x=\tü", "x" * 100) and urls[4] == ("", "short")
    rebuilt = warc.rebuild(spark, str(tmp_path / "a"))
    parsed = warc.parse(rebuilt)
    a = sorted((bytes(r.header), bytes(r.record)) for r in rebuilt.collect())
    b = sorted((bytes(r.header), bytes(r.header) + bytes(r.payload) + b"\r\n\r\n") for r in parsed.collect())
    assert a == b
    assert all(h.startswith(b"WARC/1.1\r\n") and h.endswith(b"\r\n\r\n") for h, _ in a)


def test_a_changed_payload_is_an_error(spark, rows, tmp_path):
    warc.write(rows([(1, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "b"))
    good = spark.read.parquet(str(tmp_path / "b" / "payloads"))
    good.selectExpr("digest", "cast('abd' as binary) as payload").write.parquet(str(tmp_path / "c" / "payloads"))
    spark.read.parquet(str(tmp_path / "b" / "headers")).write.parquet(str(tmp_path / "c" / "headers"))
    with pytest.raises(Exception, match="does not match"):
        warc.read(spark, str(tmp_path / "c")).select("payload_digest").collect()


def test_edge_tables(rows):
    assert warc.archived(rows([], "page_id long, url string, html string")).count() == 0
    got = warc.archived(rows([(None, None, None), (None, None, "z" * 150), (6, "u", "z" * 150)], "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted([(None, "response", None), (None, "revisit", 6), (6, "response", None)], key=str)
