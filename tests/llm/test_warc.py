import gzip
import hashlib
import io

import pytest
from common import odd_rows

from chronofold.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_revisits_refer_to_the_largest_page(spark):
    same = "é" * 600
    rows = [(i, f"http://a/{i}\r\nx", same) for i in range(40)] + [(90, None, "small"), (91, "u", "small"), (92, "u", None), (None, "u", same), (93, "u", "x" * 300_000)]
    found = {r["page_id"]: r for r in warc.round_trip(pages(spark, rows)).collect()}
    assert len(found) == len(rows)
    for page, _, html in rows:
        raw, own = (html or "").encode(), found[page]
        assert (own["payload_bytes"], own["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == same and page != 39
        assert (own["record_type"], own["refers_to"]) == (("revisit", 39) if revisit else ("response", None))
        assert bytes(own["payload"]) == (b"" if revisit else raw)


def test_archives_have_one_member_a_record_and_roll_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    manifest = warc.write(pages(spark, [(i, "u", f"{i}" * 500) for i in range(10, 30)]).coalesce(1), str(tmp_path / "w")).collect()
    assert sum(r["records"] for r in manifest) == 20 and len(manifest) > 5
    for row in manifest:
        raw = open(row["archive"], "rb").read()
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == row["records"] == len(list(map(b"".join, warc.members(io.BytesIO(raw)))))


def test_the_reader_streams_and_verifies():
    good = warc.record(1, "u", b"payload" * 50_000, None, 350_000, warc._digest(b"payload" * 50_000))
    stream = lambda *records: warc.members(io.BytesIO(b"".join(map(warc.member, records))))
    assert [len(warc.parse(m)[2]) for m in stream(good, good)] == [350_000] * 2
    for bad in (good.replace(b"payload", b"paYload", 1), good[:-10], good.replace(b"Content-Length: 350", b"Content-Length: 351"), b"WARC/1.1\r\nno end"):
        with pytest.raises(ValueError):
            [warc.parse(m) for m in stream(bad)]
    with pytest.raises(ValueError):
        [warc.parse(m) for m in warc.members(io.BytesIO(warc.member(good)[:-9]))]


def test_odd_rows_and_an_empty_table(spark):
    rows = odd_rows(spark).selectExpr("doc_id as page_id", "key as url", "text as html", "a", "b")
    assert warc.round_trip(rows).count() == 13
    assert warc.round_trip(rows.limit(0)).count() == 0
