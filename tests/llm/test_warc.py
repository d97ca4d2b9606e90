import hashlib
import struct

from pagesieve.llm import warc

PAGES = "page_id long, url string, html string, digest int"


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html) if first.get(html) != page_id else None
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "é" * (i % 7 * 30) + ("<p>x</p>" * 40 if i % 3 else "")) for i in range(300)]
    rows += [(300, None, None), (301, "", ""), (302, "http://h/\r\nX: y", "z" * 3_000_000), (303, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 5) for r in rows], PAGES).repartition(7)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, archive_bytes=1 << 16)
    back = warc.read_archives(spark, path).collect()
    found = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back)
    assert found == expected(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in back if r.record_type == "response")
    archives = [f.read_bytes() for f in tmp_path.glob("w/part-*")]
    assert len(archives) > 10
    assert all(struct.unpack("<I", a[:4])[0] == warc.DICTIONARY_FRAME for a in archives if a)


def test_equal_rows_and_null_ids(spark, tmp_path):
    html = "x" * 200
    rows = [(5, "u", html, 0), (5, "u", html, 0), (None, "u", html, 0), (None, "v", "y" * 200, 0), (None, "v", "y" * 200, 0)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    found = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()]
    assert sorted(map(str, found)) == sorted(map(str, [
        (5, "response", None), (5, "revisit", 5), (None, "revisit", 5), (None, "response", None), (None, "revisit", None)]))
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_dictionary_makes_archives_smaller():
    records = [f"<html><head><title>{i}</title></head><body>{'common text of every page ' * 3}{i * 7919}</body></html>".encode() for i in range(3000)]
    plain = sum(len(warc.zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    own = warc.zstandard.ZstdCompressor(level=3, dict_data=warc.zstandard.ZstdCompressionDict(warc.build_dictionary(records)))
    assert sum(len(own.compress(r)) for r in records) < plain / 2
