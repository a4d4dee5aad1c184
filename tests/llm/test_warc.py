"""WARC archives and their index."""

import hashlib
import zlib

from helpers import by
from pyspark.sql import functions as F

from kindred.llm import common, warc


def test_warc_round_trip(spark):
    x = [(1, "http://a.com/x", "h" * 2000), (2, "http://a.com/x", "h" * 2000), (2, "http://a.com/x", "h" * 2000), (3, None, None), (4, "http://A.com/b c\n", "s"), (5, "q", "s"), (None, "u", "h" * 2000), (7, "http://www.b.co.uk:8080/Z?q", "é" * 600), (6, "zz", "é" * 600)]
    df = spark.createDataFrame(x, "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    got = by(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    top = {"h" * 2000: 2, "é" * 600: 7}
    want = [(p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("revisit", top[h]) if h in top and p != top[h] else ("response", None))) for p, _, h in x]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_files_and_lookup(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".example.com/"), F.col("id")).alias("url"), F.repeat(F.concat(F.lit("p"), F.col("id")), 20).alias("html"))
    a = warc.write(df)
    i = warc.index(a)
    some = warc.lookup(i, df.where("page_id in (0, 1, 777, 1999)").unionByName(spark.createDataFrame([(5, "http://nowhere/", "")], "page_id long, url string, html string")))
    assert by(warc.read(a, some), "page_id") == [(0,), (1,), (1999,), (777,)]
    paths = sorted(r["path"] for r in warc.export(a, str(tmp_path)).collect())
    assert len(paths) == a.select("archive").distinct().count() == len(list(tmp_path.iterdir()))
    z = zlib.decompressobj(31)
    head, block, http, payload = warc.parse(z.decompress(open(paths[0], "rb").read()))
    assert head["warc-type"] == "response" and int(http["content-length"]) == len(payload)
    assert warc.surt("https://user@WWW.Example.co.uk:443/A?b#c") == "uk,co,example)/a?b"


def test_warc_reads_one_block_and_one_record(spark, monkeypatch):
    """Bytes that come from the files when one page of many is looked up and read."""
    monkeypatch.setattr(warc, "LINES", 64)
    noise = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")), 512) for k in range(16)])
    df = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 97, F.lit(".example.com/"), F.col("id")).alias("url"), noise.alias("html"))
    a = warc.write(df)
    i = warc.index(a)
    stats = lambda: sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())
    place = common.table(warc.lookup(i, df.where("page_id = 7777")), "place")
    start = stats()
    assert place.count() == 1
    got = warc.read(a, place).collect()
    record = stats() - start
    assert [r["page_id"] for r in got] == [7777] and got[0]["payload_bytes"] == 2048
    start = stats()
    warc._at(i, [(0, 3)], "shard", "block").collect()
    block = stats() - start
    whole = lambda d: sum(__import__("os").path.getsize(f.removeprefix("file://")) for f in d.inputFiles())
    assert record < whole(a) / 10 and block < whole(i) / 4
    assert "PushedFilters: [" in warc._at(i, [(0, 3)], "shard", "block")._jdf.queryExecution().toString()
    many = warc.read(a, warc.lookup(i, df.where("page_id % 7 = 0")))
    assert sorted(r["page_id"] for r in many.collect()) == list(range(0, 20_000, 7))


def test_warc_of_equal_captures_and_a_very_long_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 8)
    rows = [(5, "http://a/x", "same")] * 300 + [(6, "http://a/x", "é" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(df).groupBy("page_id", "payload_bytes", "record_type").count().collect()
    assert sorted(tuple(r) for r in got) == [(5, 4, "response", 300), (6, 6_000_000, "response", 1)]
