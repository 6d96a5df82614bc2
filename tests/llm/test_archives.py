"""WARC archives: round trip, revisits, faults that the reader reports."""

import hashlib
import io
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from botqa.llm import common, warc


def _page(i, words=60):
    rng = random.Random(i)
    return "<html><head><title>Page</title></head><body>" + " ".join(f"<p class='item'>word{rng.randint(0, 500)}</p>" for _ in range(words)) + "</body></html>"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def _read(pages, folder, whole=True, **options):
    archives = warc.write_archives(pages, f"file://{folder}", **options)
    records = common.staged(warc.read_archives(archives, whole), "records")
    return archives, records, common.staged(warc.resolved(records), "resolved")


@pytest.mark.parametrize("archive_bytes", [64 << 20, 3000])
def test_round_trip(spark, tmp_path, archive_bytes):
    same, short = _page(1), "x" * 99
    rows = [(i, f"http://a/{i}", _page(1000 + i)) for i in range(300)]
    rows += [(i, f"http://b/{i} \r\nx: y/é", same) for i in range(900, 500, -1)]          # one payload of 400 pages
    rows += [(7000 + i, "http://c", short) for i in range(5)] + [(8000, None, "y" * 100), (8001, None, "y" * 100)]
    rows += [(9000, "u", None), (9001, "u", ""), (None, "http://n", same), (None, None, "z" * 500), (None, None, "z" * 500)]
    rows += [(9100, "t", "w" * 200), (9100, "s", "w" * 200), (9100, "s", "w" * 200), (9200, "long", "é<p>" * 400_000)]
    archives, records, pages = _read(_pages(spark, rows), tmp_path, archive_bytes=archive_bytes)
    assert records.where("error is not null").count() == 0 and pages.where("error is not null").count() == 0
    assert archives.agg(F.sum("records")).first()[0] == records.count()
    assert records.where("record_type = 'warcinfo'").count() == archives.count()
    got = [(r["page_id"] and int(r["page_id"]), r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to_page"] and int(r["refers_to_page"]))
           for r in pages.collect()]
    first = {}
    for i, url, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100:
            key = ((i is None, i or 0), (url is None, url or ""))
            first[payload] = min(first.get(payload, key), key)
    want = []
    for i, url, html in rows:
        payload = (html or "").encode()
        again = payload in first and first[payload] != ((i is None, i or 0), (url is None, url or ""))
        (no_id, of), _ = first.get(payload, ((False, 0), None))
        want.append((i, hashlib.sha256(payload).hexdigest(), len(payload), "revisit" if again else "response", of if again and not no_id else None))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    whole = {r["page_id"]: bytes(r["payload"]).decode() for r in records.where("record_type = 'response' and page_id is not null").collect()}
    assert whole["9200"] == "é<p>" * 400_000 and whole["501"] == same
    assert all("\n" not in r["target_uri"] for r in records.where("target_uri is not null").select("target_uri").collect())
    assert (archives.count() > 100) == (archive_bytes == 3000)


def test_no_pages(spark, tmp_path):
    archives, records, pages = _read(_pages(spark, []), tmp_path)
    assert (archives.count(), records.count(), pages.count()) == (0, 0, 0)


def _archive(records, dictionary=None, **options):
    out = b""
    if dictionary:
        raw = dictionary.as_bytes()
        out = struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw
    compressor = zstandard.ZstdCompressor(dict_data=dictionary, **options)
    return out + b"".join(compressor.compress(r) for r in records)


def _records(n):
    out = []
    for i in range(n):
        payload = _page(i).encode()
        out.append(warc.page_record(i, f"http://a/{i}", payload, len(payload), hashlib.sha256(payload).hexdigest(), None))
    return out


def test_dictionary_leads_the_archive(tmp_path):
    records = _records(400)
    writer = warc._Writer(f"file://{tmp_path}")
    for r in records:
        assert writer.add(r) is None
    told = writer.close()
    raw = open(told["path"].removeprefix("file://"), "rb").read()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == warc.DICTIONARY_MAGIC and told["bytes"] == len(raw) and told["records"] == 401
    assert len(raw) < len(_archive(records))  # one frame a record pays through the dictionary
    found = list(warc.read_archive(io.BytesIO(raw)))
    assert [f["payload"].decode() for f in found[1:]] == [_page(i) for i in range(400)]
    assert found[1]["offset"] == 8 + size + found[0]["length"]
    for f in found:  # each frame decodes by itself
        frame = raw[f["offset"]:f["offset"] + f["length"]]
        assert warc.parse_record(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:8 + size])).decompress(frame))[0] == f["fields"]
    without = list(warc.read_archive(io.BytesIO(raw[8 + size:])))
    assert len(without) == 401 and all("dictionary" in f["error"] for f in without)


def test_forms_of_archives():
    records = _records(60)
    dictionary = warc.train(records)
    plain = [r["payload"] for r in warc.read_archive(io.BytesIO(_archive(records)))]
    assert plain == [_page(i).encode() for i in range(60)]
    unsized = _archive(records, dictionary, write_content_size=False, write_checksum=True)
    assert [r["payload"] for r in warc.read_archive(io.BytesIO(unsized))] == plain
    packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    body = _archive(records, dictionary)[8 + len(dictionary.as_bytes()):]
    skip = struct.pack("<II", 0x184D2A53, 5) + b"other"
    assert [r["payload"] for r in warc.read_archive(io.BytesIO(struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + skip + body))] == plain
    assert list(warc.read_archive(io.BytesIO(b""))) == []


def test_faults_are_rows():
    good, other = _records(2)

    def faults(*records):
        return [r.get("error") for r in warc.read_archive(io.BytesIO(_archive([*records, other])))]

    def broken(old, new):
        assert old in good
        return good.replace(old, new, 1)

    assert faults(good) == [None, None]
    for record, told in [(broken(b"WARC/1.1", b"WARC/3.0"), "version"), (broken(b"WARC-Date", b"X-Date"), "no WARC-Date"),
                         (broken(b"WARC-Type: ", b"WARC-Type "), "field line"), (good[:-1], "Content-Length"), (good + b"x", "Content-Length"),
                         (broken(b"word", b"drow"), "Block-Digest"), (broken(b"sha256:", b"sha256:0"), "Payload-Digest"), (b"", "version"),
                         (broken(b"http://a/0", b"http://a/\xff"), "UTF-8"), (good + other, "Content-Length"), (b"WARC/1.1\r\nA: b", "don't end")]:
        first, second = faults(record)
        assert told in first and second is None, (told, first)
    raw = _archive([good, other])
    cut = list(warc.read_archive(io.BytesIO(raw[:-3])))
    assert cut[0].get("error") is None and cut[1]["error"] == "truncated frame" and len(cut) == 2
    spoiled = list(warc.read_archive(io.BytesIO(_archive([good]) + b"garbage, not a frame")))
    assert spoiled[0].get("error") is None and spoiled[1]["error"] == "not a Zstandard frame"
    flipped = bytearray(_archive([good, other], write_checksum=True))
    flipped[200] ^= 0xFF
    assert [bool(r.get("error")) for r in warc.read_archive(io.BytesIO(bytes(flipped)))] == [True, False]


def test_a_revisit_without_its_response(spark, tmp_path):
    rows = [(1, "u", _page(1)), (2, "u", _page(1))]
    _, records, _ = _read(_pages(spark, rows), tmp_path)
    alone = warc.resolved(records.where("record_type = 'revisit'")).collect()
    assert len(alone) == 1 and alone[0]["error"] == "its response is not in the archives" and alone[0]["refers_to_page"] is None


def test_join_with_a_key_of_most_rows(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), *((str(i), i) for i in range(0, 20_000, 12))], "k string, v int")
    for counts in (None, rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))):
        got = {(r["id"], r["k"], r["v"]) for r in common.joined_to_unique(rows, table, "k", counts).collect()}
        assert got == {(r["id"], r["k"], r["v"]) for r in rows.join(table, "k", "left").collect()} and len(got) == 20_000
