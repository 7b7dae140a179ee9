"""Archives that others wrote: several records in a gzip member, members that cut records, plain files, records without an HTTP head."""

import gzip
import os
import random

import pytest

from prismtally.llm import warc


def record(number, kind="response", body=b"<html>x</html>", head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", content="application/http; msgtype=response"):
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{number}>"), ("WARC-Target-URI", f"http://e.org/%25{number}"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", content)]
    return warc.record_bytes(headers, head + body)


def made(rng, count=60):
    out = []
    for k in range(count):
        size = rng.choice([0, 1, 10, 5000, 200_000])
        out.append((record(k, body=bytes(rng.choices(b"ab\r\n", k=size))), size))
    return out


def rows_in(folder, **options):
    reader = warc.WarcReader({"path": f"file://{folder}", **options})
    return [row for part in reader.partitions() for row in reader.read(part)]


def test_records_are_told_apart_by_their_lengths(folder):
    rng = random.Random(1)
    parts = made(rng)
    raw = b"".join(r for r, _ in parts)
    cuts = sorted(rng.sample(range(len(raw)), 9))
    members = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]
    files = {
        "one.warc.gz": gzip.compress(raw),
        "cut.warc.gz": b"".join(gzip.compress(m) for m in members),
        "own.warc.gz": b"".join(gzip.compress(r) for r, _ in parts) + b"\0" * 512,
        "plain.warc": raw,
    }
    for name, data in files.items():
        os.makedirs(f"{folder}/{name}.d")
        with open(f"{folder}/{name}.d/{name}", "wb") as out:
            out.write(data)
        got = rows_in(f"{folder}/{name}.d")
        assert [(r[0], r[5], len(r[8])) for r in got] == [(f"<urn:uuid:{k}>", n, n) for k, (_, n) in enumerate(parts)], name
        assert got[3][2] == "http://e.org/%253"
        slim = rows_in(f"{folder}/{name}.d", payload="false")
        assert [(r[5], r[8]) for r in slim] == [(n, None) for _, n in parts]


def test_records_of_other_kinds(folder):
    dns = record(1, kind="response", head=b"", body=b"20240101 example.org. 1 IN A", content="text/dns")
    bare = record(2, head=b"", body=b"no http head here")
    meta = record(3, kind="metadata", head=b"", body=b"k: v\r\n\r\nrest", content="application/warc-fields")
    visit = record(4, kind="revisit", head=b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", body=b"")
    odd = record(5, kind="revisit", head=b"", body=b"")
    with open(f"{folder}/a.warc.gz", "wb") as out:
        out.write(gzip.compress(dns + bare + meta + visit + odd))
    assert [(r[1], r[5], r[8]) for r in rows_in(folder)] == [
        ("response", 28, b"20240101 example.org. 1 IN A"), ("response", 17, b"no http head here"), ("metadata", 12, b"k: v\r\n\r\nrest"), ("revisit", 77, None), ("revisit", 0, None),
    ]


def test_cut_files_are_errors(folder):
    raw = record(1, body=b"x" * 1000)
    for name, data in (("a.warc", raw[:-500]), ("b.warc.gz", gzip.compress(raw)[:-20])):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(data)
        with pytest.raises(EOFError):
            rows_in(folder)
        os.remove(f"{folder}/{name}")


def test_files_of_bounded_size_and_null_ids(spark, folder):
    uri = f"file://{folder}/out"
    rows = [(k, "u", f"page {k} " + "x" * 3000) for k in range(40)] + [(None, "u", "page 1 " + "x" * 3000), (None, None, None), (7, "u", "page 7 " + "x" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.register(spark)
    warc.with_revisits(pages).coalesce(1).write.format("warc").option("fileBytes", "600").mode("append").save(uri)
    assert len([f for f in os.listdir(f"{folder}/out") if f.endswith(".warc.gz")]) > 5
    got = warc.read_records(spark, uri).where("record_type <> 'warcinfo'").collect()
    assert len(got) == 43 and sorted(r["page_id"] for r in got if r["page_id"] is not None) == sorted([*range(40), 7])
    nulls = {(r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None}
    assert nulls == {("revisit", "<urn:page:1>"), ("response", None)}
    assert [r["record_type"] for r in got if r["page_id"] == 7] == ["response", "response"]
