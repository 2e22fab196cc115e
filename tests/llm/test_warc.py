import hashlib
import io

import pytest

from sparkloom.llm import warc
from sparkloom.session import scratch_dir


def written(spark, pages, **kw):
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, payload int")
    return warc.write_archives(df, f"{scratch_dir(spark)}/w", **kw)


def rows(spark, pages, **kw):
    return sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read_archives(written(spark, pages, **kw), with_payload=True).collect()), key=str)


def test_round_trip_and_revisits(spark):
    pages = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", "é" * 200_000), (4, "u", None), (5, "u", ""), (None, "n", "same"), (None, "n", "own\r\n\r\n")]
    got = {(r[0], r[5] or None): r for r in rows(spark, pages)}
    assert got[(2, b"same")][3:5] == ("response", None)
    assert sorted((r[0], r[3], r[4]) for r in rows(spark, pages) if r[0] is not None) == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "revisit", 5), (5, "response", None)]
    assert [(r[3], r[4], r[5]) for r in rows(spark, pages) if r[0] is None and r[2] != 4] == [("response", None, b"own\r\n\r\n")]
    assert got[(3, ("é" * 200_000).encode())][2] == 400_000


def test_least_bytes_and_repeats(spark):
    pages = [(1, "u", "ab"), (2, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    assert sorted((r[0], r[3]) for r in rows(spark, pages, least_bytes=3)) == [(1, "response"), (2, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    assert sorted((r[0], r[3]) for r in rows(spark, pages, archive_bytes=10)) == [(1, "revisit"), (2, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_damage_is_found():
    one = warc.record_bytes("response", b"hello", "x", {}, "d")
    assert [p for _, _, p in warc.read_records(io.BytesIO(one + one))] == [b"hello"] * 2
    for bad in (one[:-9], one + b"junk", one + one[:40]):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
    import zlib

    plain = zlib.decompress(one, 31)
    for changed in (plain.replace(b"hello", b"hellO"), plain[:-1], plain.replace(b"hello", b"hell")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(zlib.compress(changed, wbits=31))))
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert len(hashlib.sha1(b"").digest()) == 20
