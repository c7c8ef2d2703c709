import base64
import gzip
import random
import time
import hashlib
import random

from pyspark.sql import functions as F

from probitas.llm.archives import arc_records, arc_to_warc, pages_as_arc, read_arc, warc_bytes

V1 = b"1 0 Somewhere\nURL IP-address Archive-date Content-type Archive-length\n"
V2 = b"2 0 Somewhere\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"


def arc(version, records, name=b"x.arc"):
    """An ARC file written the plain way: header line, block, newline."""
    about = V1 if version == 1 else V2
    out, parts = [], [(b"filedesc://" + name, b"0.0.0.0", b"19960101000000", b"text/plain", about), *records]
    for url, ip, date, kind, block in parts:
        more = b" " if version == 1 else b" 200 abc - 17 " + name + b" "
        out.append(b" ".join((url, ip, date, kind)) + more + str(len(block)).encode() + b"\n" + block + b"\n")
    return out


def sample(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        body = bytes(rnd.randrange(256) for _ in range(rnd.randrange(400)))
        http = b"HTTP/1.0 %d OK\r\nContent-type: Image/GIF; q=1\r\nX: y\r\n\r\n" % rnd.choice((200, 404)) + body
        out.append((b"http://h/%d a b" % k if k % 3 == 0 else b"http://h/%d" % k, b"10.0.0.1", b"2001010203%02d%02d" % (k % 60, k % 60), b"image/gif", http if k % 4 else body))
    return out


def files(spark, rows):
    return spark.createDataFrame(rows, "arc_name string, content binary")


def test_both_versions_and_compression(spark):
    records = sample(30)
    contents = [b"".join(arc(v, records)) for v in (1, 2)] + [b"".join(map(gzip.compress, arc(1, records)))]
    for content in contents:
        found = list(arc_records(content))
        assert [(r.url.encode(), r.date.encode(), r.block) for r in found[1:]] == [(u, d, b) for u, _, d, _, b in records]
        assert found[0].version_block and not any(r.truncated or r.version_block for r in found[1:])


def test_records(spark):
    records = sample(12)
    got = arc_to_warc(files(spark, [("a.arc", b"".join(arc(2, records)))])).orderBy("arc_offset").collect()
    assert got[0].warc_type == "warcinfo" and got[0].target_uri is None
    for row, (url, _, date, kind, block) in zip(got[1:], records, strict=True):
        assert row.target_uri == url.decode() and bytes(row.block) == block and row.content_length == len(block)
        assert row.warc_date.replace("-", "").replace(":", "") == f"{date[:8].decode()}T{date[8:].decode()}Z"
        assert row.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if block.startswith(b"HTTP/"):
            body = block.split(b"\r\n\r\n", 1)[1]
            assert (row.warc_type, row.payload_type, row.http_status) == ("response", "Image/GIF", int(block[9:12]))
            assert row.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            assert (row.warc_type, row.content_type, row.payload_digest) == ("resource", kind.decode(), None)
    assert len({r.record_id for r in got}) == len(got)
    written = {r.arc_offset: bytes(r.record) for r in warc_bytes(arc_to_warc(files(spark, [("a.arc", b"".join(arc(2, records)))]))).collect()}
    for row in got:
        head, block = written[row.arc_offset].split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.0\r\nWARC-Type: ") and block == bytes(row.block) + b"\r\n\r\n"
        assert f"Content-Length: {len(row.block)}".encode() in head


def test_damage(spark):
    parts = arc(1, sample(4))
    whole = b"".join(parts)
    assert [r.truncated for r in arc_records(whole[:-20])] == [False] * 4 + [True]
    assert len(list(arc_records(parts[0] + b"no header at all\n\n" + b"".join(parts[2:])))) == 4
    packed = b"".join(map(gzip.compress, parts))
    assert len(list(arc_records(packed[: -len(gzip.compress(parts[-1]))]))) == 4
    assert len(list(arc_records(packed[:-9]))) == 5


def test_edge_cases(spark):
    many = arc(1, [(b"http://h/", b"1.1.1.1", b"20010102", b"text/plain", b"x" * 5_000_000)])
    df = files(spark, [(None, b"".join(arc(1, sample(1)))), ("e", b""), ("n", None), ("t", b"plain words"), ("l", b"".join(many)), ("l", b"".join(many))]).withColumn("block", F.lit(1)).withColumn("warc_type", F.lit(2))
    got = arc_to_warc(df).collect()
    assert sorted(str(r.arc_name) for r in got) == ["None", "None", "l", "l", "l", "l"]
    long = [r for r in got if r.content_length == 5_000_000]
    assert len(long) == 2 and long[0].record_id == long[1].record_id and long[0].warc_date == "2001-01-02T00:00:00Z"
    assert arc_to_warc(df.limit(0)).collect() == []


def test_pages_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/b c", "<p>é</p>"), (2, "http://a/", ""), (3, None, "x"), (4, "http://b/", None), (None, "http://c/", "y")], "page_id bigint, url string, html string")
    got = {r.target_uri: bytes(r.block).decode() for r in arc_to_warc(pages_as_arc(pages)).collect() if r.warc_type == "response"}
    assert {u: b.split("\r\n\r\n", 1)[1] for u, b in got.items()} == {"http://a/b c": "<p>é</p>", "http://a/": ""}
    (tmp_path / "one.arc").write_bytes(b"".join(arc(1, sample(3))))
    assert arc_to_warc(read_arc(spark, str(tmp_path))).where("arc_name = 'one.arc'").count() == 4


def test_time_grows_with_the_size_of_a_compressed_file():
    rnd = random.Random(2)
    member = lambda: gzip.compress(b"http://h/x 1.2.3.4 20010203040506 text/html 3000\n" + rnd.randbytes(3000) + b"\n", 1)
    parts = [member() for _ in range(500)]

    def seconds(times):
        content, began = b"".join(parts * times), time.process_time()
        assert len(list(arc_records(content))) == 500 * times
        return time.process_time() - began

    seconds(1)
    assert seconds(32) < 8 * max(seconds(8), 0.05)  # 48 MB; four times the data, sixteen times if it were quadratic
