import glob
import gzip
import hashlib

from kpiloom.llm import warc
from kpiloom.llm.common import scratch


def pages(spark):
    big, other = "é" * 500, "x" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (3, None, big), (None, "u", big),
            (4, "http://b/\r\nX: 1", other), (5, "http://ü/ ", other), (6, "c", None), (7, "c", ""),
            (None, "n", "y" * 1000), (None, "n", "y" * 1000), (9, "z", "a\r\n\r\nb" * 300)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def brute(rows):
    last = {}
    for i, _, html in rows:
        if i is not None and len(html or "") and len(html.encode()) >= 1000:
            last[html] = max(last.get(html, i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = last.get(html) if html is not None and len(body) >= 1000 else None
        revisit = to is not None and i != to
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_round_trip_matches_brute_force(spark):
    df = pages(spark)
    got = warc.warc_round_trip(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r.page_id, r.url, r.html) for r in df.collect()])


def test_selected_records_come_back_with_payloads(spark):
    folder = scratch(spark, "warc-test")
    df = pages(spark).repartition(3)
    index = warc.write_warc(df, folder)
    some = index.where("record_type = 'response' and page_id in (4, 7, 9)")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, folder, some).collect()}
    assert got == {4: "x" * 999, 7: "", 9: "a\r\n\r\nb" * 300}
    assert index.where("digest is null or offset is null or length is null").count() == 0
    # any reader of gzip members sees every record, in the order of the index
    n = sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in glob.glob(folder.removeprefix("file:") + "/*.gz"))
    assert n == df.count() == index.count()


def test_empty_table(spark):
    assert warc.warc_round_trip(pages(spark).where("false")).count() == 0


def test_ranges_are_merged():
    near = [(0, 10), (10, 10), (20 + warc.GAP, 5), (10 * warc.GAP, 5)]
    assert [(a, z, len(r)) for a, z, r in warc.coalesced(near)] == [
        (0, 25 + warc.GAP, 3), (10 * warc.GAP, 10 * warc.GAP + 5, 1)]
    big = [(i * warc.READ_BYTES, warc.READ_BYTES) for i in range(3)]
    assert len(list(warc.coalesced(big))) == 3
    assert list(warc.coalesced([])) == []
