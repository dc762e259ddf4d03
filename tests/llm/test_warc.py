import glob
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as ent
from periodlens.llm import queries, warc
from periodlens.plans import verify

SCHEMA = "page_id long, url string, html string"


def messy(n=300, seed=3):
    rng = random.Random(seed)
    long = ["ü" * 50, "a" * 99, "b" * 100, "\r\n\r\n" * 40, "<p>hot</p>" * 30, "WARC/1.1\r\n" * 20]
    rows = []
    for i in range(n):
        html = rng.choice([None, "", "short", rng.choice(long), long[4], long[4], f"own {i} " * rng.randrange(1, 60)])
        rows.append((None if i % 23 == 0 else i * 7 % n, rng.choice([None, f"http://h/{i}?q=a%20b", "http://h/\r\nX: y zé"]), html))
    rows += [rows[10]] * 2 + [(100_000, "u", "long " * 800_000), (100_001, "u", "long " * 800_000), (None, "n", "only nulls " * 20), (None, "n", "only nulls " * 20)]
    return rows


def brute(rows, least=100):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        of = first.get(html or "")
        back = len(data) >= least and of is not None and i != of
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if back else "response", of if back else None))
    return sorted(out, key=str)


def archive(spark, rows, **how):
    path = warc.archive_path(spark)
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(4), path, **how)
    return path


def result(records):
    return sorted((tuple(r) for r in records.select(warc.page_id("record_id"), "payload_bytes", "payload_digest", "record_type",
                                                   warc.page_id("refers_to")).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"shared": 0}, {"frame_bytes": 1, "bundle_bytes": 2000}, {"least": 0, "frame_bytes": 5000}])
def test_round_trip(spark, how):
    rows = messy()
    records = warc.read(spark, archive(spark, rows, **how))
    assert result(records) == brute(rows, how.get("least", 100))
    if how.get("shared") != 0:
        full = warc.resolved(records).select(warc.page_id("record_id").alias("i"), F.sha2("payload", 256).alias("h"), F.octet_length("payload").alias("n"))
        want = sorted(((i, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in rows), key=str)
        assert sorted((tuple(r) for r in full.collect()), key=str) == want


def test_files_are_plain_warc_for_any_reader(spark):
    """The frames in order are the records; the map and the footer are skipped by a plain reader."""
    rows = messy(80)
    path = archive(spark, rows, frame_bytes=1500, bundle_bytes=400)
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    assert len(files) > 4
    seen = 0
    for f in files:
        data = open(f, "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        table = warc.seek_table(data)
        assert plain == b"".join(warc.frame(data, e) for e in table[:-1]) and len(table) > 1
        at = 0
        for name, k, offset, length in warc.record_map(data, table):
            one = warc.parsed(warc.frame(data, table[k]), offset)
            assert (one["record_id"], one["length"]) == (name, length)
            assert plain[at : at + length] == warc.frame(data, table[k])[offset : offset + length]
            at += length
            seen += 1
        assert at == len(plain) and plain.startswith(b"WARC/1.1\r\nWARC-Type: ")
    assert seen == len(rows)


def test_records_are_found_by_id(spark):
    rows = [(i, f"http://h/{i}", f"<p>text {i}</p>" * 20) for i in range(200)]
    path = archive(spark, rows, frame_bytes=2000, bundle_bytes=8000)
    where = warc.index(spark, path)
    assert where.count() == 200 and where.agg(F.max("frame")).first()[0] > 0
    got = warc.fetch(spark, where.where(warc.page_id("record_id").isin(3, 77, 199))).collect()
    assert sorted((r["record_id"], r["target_uri"], bytes(r["payload"]).decode()) for r in got) == sorted(
        (f"{warc.ID_SCHEME}{i}", f"http://h/{i}", rows[i][2]) for i in (3, 77, 199))
    assert warc.fetch(spark, where.where("record_id = 'none'")).count() == 0


def test_damage_is_noticed(spark):
    path = archive(spark, [(i, "u", f"{i} " * 100) for i in range(50)])
    data = bytearray(open(glob.glob(path.removeprefix("file:") + "/part-*")[0], "rb").read())
    start, packed, plain, check = warc.seek_table(bytes(data))[0]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        data[start + packed // 2] ^= 1
        warc.frame(bytes(data), (start, packed, plain, check))
    with pytest.raises(ValueError):
        warc.seek_table(bytes(data[:-1]))
    one = bytearray(warc.record("urn:x-page:1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "d"))
    one[one.index(b"payload\r\n\r\n")] ^= 1
    with pytest.raises(ValueError):
        warc.parsed(bytes(one))


def test_empty_table_and_clashing_columns(spark):
    assert result(warc.read(spark, archive(spark, []))) == []
    rows = [(1, "u", "x" * 200), (2, None, "x" * 200)]
    pages = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "payload", "digest", "first", "same", "n", "name", "refers", "hot", "key", "value", "bundle"):
        pages = pages.withColumn(c, F.lit("x"))
    path = warc.archive_path(spark)
    warc.write(pages, path)
    assert result(warc.read(spark, path)) == brute(rows)


def test_query_matches_sql(spark, sf001):
    ok, said = verify.compare(spark, verify.duck(sf001), "op13_warc", sf001, ent.queries(), ent.oracle_sql())
    assert ok, said
    assert dict(queries.op13_warc(spark, sf001).dtypes)["refers_to"] == "bigint"
