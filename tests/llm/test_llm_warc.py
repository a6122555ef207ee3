"""Archives round trip; the query equals its SQL through the general comparison."""

import hashlib

from themeloom.llm import warc
from themeloom.llm.common import Stages

BIG = "x" * 999 + "é"  # 1001 bytes


def round_trip(spark, tmp_path, rows, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, file string")
    folder = str(tmp_path / "archives")
    index = Stages(spark).keep(warc.write_warc(pages, folder, **kw))
    return index, folder


def test_round_trip_with_odd_rows(spark, tmp_path):
    rows = [(1, "http://a/ b\r\nX: y", BIG, "d", "f"), (2, None, BIG, "d", "f"), (7, "http://c", BIG, "d", "f"),
            (3, "http://d", None, None, None), (4, "http://e", "", None, None), (5, "http://f", "\r\n\r\nbody\r\n\r\n", None, None),
            (None, "http://g", "small", None, None), (6, "http://g", "small", None, None), (7, "http://c", BIG, "d", "f")]
    index, folder = round_trip(spark, tmp_path, rows, archive_bytes=300)
    found = warc.read_warc(index, folder, gap_bytes=0, read_bytes=10).collect()
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) for r in found)
    expected = [(-1, "response", None, 5, "small"), (1, "revisit", 7, 1001, None), (2, "revisit", 7, 1001, None),
                (3, "response", None, 0, ""), (4, "response", None, 0, ""), (5, "response", None, 12, "\r\n\r\nbody\r\n\r\n"),
                (6, "response", None, 5, "small"), (7, "response", None, 1001, BIG), (7, "response", None, 1001, BIG)]
    assert got == expected
    digests = {r["page_id"]: r["payload_digest"] for r in found}
    assert digests[1] == hashlib.sha1(BIG.encode()).hexdigest() and digests[4] == hashlib.sha1(b"").hexdigest()
    some = warc.read_warc(index.where("page_id = 5"), folder).collect()
    assert [r["page_id"] for r in some] == [5]


def test_empty_and_changed(spark, tmp_path):
    index, folder = round_trip(spark, tmp_path, [])
    assert warc.read_warc(index, folder).collect() == []


def test_index_rows_are_ranges_of_whole_members(spark, tmp_path):
    index, folder = round_trip(spark, tmp_path, [(i, f"http://h/{i}", "p" * i, None, None) for i in range(50)])
    for r in index.collect():
        with open(f"{folder}/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            fields = warc.parse_record(f.read(r["length"]))
        assert fields["payload"] == b"p" * r["page_id"] and fields["WARC-Target-URI"] == f"http://h/{r['page_id']}"
