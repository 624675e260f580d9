import base64
import hashlib
from pathlib import Path

import pytest

from footgrid.llm import warc

PAGES = [(1, "http://a/\r\nX: y", "body é"), (2, None, "body é"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "x\r\n\r\ny"), (5, "http://d", "x\r\n\r\ny"), (None, "http://e", "body é"), (6, "http://f", "z" * 200_000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string")


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        best = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(data) >= least and page != best
        out.append((page or 0, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, least):
    got = [(r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(table(spark, PAGES), warc.Warc(min_revisit_bytes=least)).collect()]
    assert sorted(got, key=repr) == expected(PAGES, least)


def test_payloads_are_stored_once_and_verified(spark, tmp_path):
    path = warc.write_archive(table(spark, PAGES), f"file://{tmp_path}/archive")
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == 4 and spark.read.parquet(f"{path}/headers").count() == len(PAGES)
    broken = stored.selectExpr("sha256", "concat(payload, '!') AS payload")
    broken.write.parquet(f"{path}-broken/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-broken/headers")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"{path}-broken").collect()
    with pytest.raises(Exception, match="does not match"):
        warc.parsed(warc.read_archive(spark, f"{path}-broken")).collect()


def test_record_ids_are_unique_and_page_ids_of_any_type(spark, tmp_path):
    path = warc.write_archive(table(spark, PAGES), f"file://{tmp_path}/archive")
    headers = spark.read.parquet(f"{path}/headers").select(warc.header_value("WARC-Record-ID").alias("id"), warc.header_value("WARC-Refers-To").alias("to")).collect()
    ids = {r.id for r in headers}
    assert len(ids) == len(PAGES) and {r.to for r in headers if r.to} < ids
    names = spark.createDataFrame([("a b:>~", None, "x"), ("", None, "y"), (None, None, "y"), ("é", None, "x")], "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(names).collect()}
    assert got == {("a b:>~", "revisit", "é"), ("", "response", None), (None, "revisit", ""), ("é", "response", None)}


def test_exported_files_are_records(spark, tmp_path):
    path = warc.write_archive(table(spark, PAGES), f"file://{tmp_path}/archive")
    warc.export_warc(warc.read_archive(spark, path), f"file://{tmp_path}/files")
    found = []
    for file in Path(tmp_path, "files").glob("part-*"):
        data = file.read_bytes()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            found.append((fields["WARC-Type"], data[:n].decode()))
            assert head.startswith(b"WARC/1.1") and data[n : n + 4] == b"\r\n\r\n"
            data = data[n + 4 :]
    assert sorted(found) == sorted(("revisit", "") if r[3] == "revisit" else ("response", next(h or "" for _, _, h in PAGES if len((h or "").encode()) == r[1])) for r in expected(PAGES))


def test_empty_table(spark):
    assert warc.round_trip(table(spark, [])).count() == 0
