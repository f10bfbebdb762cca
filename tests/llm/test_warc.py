import base64
import gzip
import hashlib

from worksight.llm import warc


def brute_force(rows, min_bytes):
    largest = {}
    for page_id, _, page in rows:
        if page_id is not None:
            largest[page] = max(largest.get(page, page_id), page_id)
    out = []
    for page_id, _, page in rows:
        data = (page or "").encode()
        first = largest.get(page)
        again = len(data) >= min_bytes and first is not None and first != page_id
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str
    )


def pages(n=300):
    rows = [(i, f"https://Site{i % 7}.example.org:8080/p/{i % 40}?q={i % 3}", f"<p>page {i}</p>" * (i % 5)) for i in range(n)]
    rows += [(1000 + i, "https://hot.example.org/", "<p>same</p>") for i in range(80)]
    rows += [(2000, "", ""), (2001, "not a url", "x"), (2002, "http://[bad/", "é\r\n\r\n✓"), (2003, "http://a/\nb%", "y")]
    rows += [(2001, "not a url", "x"), (2004, "http://long/", "z" * 300_000), (None, "http://none/", "<p>same</p>")]
    return rows


def test_round_trip(spark, tmp_path, monkeypatch):
    rows = pages()
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int").repartition(4)
    for min_bytes in (0, 6):
        archive = warc.write_archives(table, f"file://{tmp_path}/{min_bytes}", min_bytes)
        expected = brute_force(rows, min_bytes)
        assert rows_of(warc.read_back(archive, table)) == expected
    some = table.where("page_id in (1003, 5, 2002)")
    found = warc.read_records(archive, warc.lookup(archive, some)).collect()
    assert {r.page_id for r in found} == {1003, 5, 2002}
    assert {r.page_id: bytes(r.payload or b"") for r in found}[2002] == "é\r\n\r\n✓".encode()
    gone = spark.createDataFrame([(9999, "http://nowhere/"), (5, "http://nowhere/")], "page_id long, url string")
    assert warc.lookup(archive, gone).count() == 0
    # each record is a gzip member of its own, so plain tools read the archives
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "6").glob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == len(rows)


def test_directory_with_many_blocks(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.org/", f"{i}") for i in range(8000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archives(table, str(tmp_path))
    wanted = table.where("page_id % 37 = 0")
    assert warc.lookup(archive, wanted).count() == wanted.count()


def test_nulls_and_empty_table(spark, tmp_path):
    table = spark.createDataFrame([(1, None, None), (2, None, None)], "page_id long, url string, html string")
    archive = warc.write_archives(table, str(tmp_path / "a"))
    assert [(r[0], r[1], r[3], r[4]) for r in rows_of(warc.read_back(archive, table))] == [
        (1, 0, "revisit", 2), (2, 0, "response", None)]
    archive = warc.write_archives(table.limit(0), str(tmp_path / "b"))
    assert warc.read_back(archive, table).count() == 0


def test_url_keys():
    assert warc.url_key("https://Blog.Example.com/a?b=1#c") == "com,example,blog)/a?b=1"
    assert warc.url_key(None) == ")/" and warc.url_key("http://[x/") == ")http://[x/"
