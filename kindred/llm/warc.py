"""WARC archives of captures and a two-level index over them.

Archives. Records are gzip members, one after another, in archives of bounded size. A table holds them: a row is a member, with
its archive and the place where it begins there; an archive's members in order are the bytes of a .warc.gz file, which
``export`` writes. The table's files lie in the order of archives and offsets, in small pages whose bounds the files name: a
reader that is asked for one place reads the pages about it, from any store that Spark reads.

Index. The captures' keys (host reversed, then path) are sorted over range partitions. Each partition is a shard of compressed
blocks of LINES; the blocks' first keys are its sparse directory, columns of the same table that are read without the blocks. The
shards' first keys are the upper level; there are as many as range partitions, a setting of the session. A key is found by
a binary search among the shards, another in the shard's directory, and a read of one block; the line then names the
archive and the record's range in it. Few asked keys (FEW) read only the blocks and records that they name; many are joined
with them, block by block and record by record, so no task holds more of the index than a shard's directory.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import parts, ship, small, table

#: Payloads below this are never revisits; bytes after which an archive is closed; lines of a block of the index.
LEAST_PAYLOAD, ARCHIVE_BYTES, LINES = 1000, 4 << 20, 512
LEVEL = 1
#: Stands for a null page_id in the index.
NO_PAGE = -(1 << 63)
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Up to so many asked keys, blocks or records are read by their places alone.
FEW = 64
#: How the tables are laid out in files: rows groups and pages small enough for reads of one block or record.
PAGES = {"parquet.block.size": 16 << 20, "parquet.page.size": 64 << 10}
MEMBER = "archive string, offset bigint, length bigint, key string, page bigint, digest string, url string, member binary"
BLOCK = "shard int, block int, first_key string, first_page bigint, lines binary"
PLACE = "page bigint, archive string, offset bigint, length bigint"
_URL = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)")


def surt(url: str | None) -> str:
    """The sort key of a URL: labels of its host in reverse, then path and query, in lower case; other strings as they are."""
    m = _URL.match(url or "")
    if not m:
        return _plain((url or "").lower())
    host = re.sub(r"^www\d*\.", "", m[1].lower().rstrip("."))
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return _plain(",".join(reversed(host.split("."))) + port + ")" + ((m[3] or "/").lower()))


def _plain(s: str) -> str:
    """``s`` without white space and control characters, which would end a field or a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record, response or (where ``refers_to`` is an id) revisit; a revisit keeps the HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n" if refers_to is not None else ""
    name = base64.b32encode(bytes.fromhex(digest)).decode()
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: <urn:page:{'null' if page is None else page}>\r\n"
        f"WARC-Date: {DATE}\r\nWARC-Target-URI: {_plain(url or 'about:blank')}\r\nWARC-Payload-Digest: sha1:{name}\r\n{more}"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return b"".join((head.encode(), block, b"\r\n\r\n"))


def parse(raw: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """(WARC header, block, HTTP header, payload) of one record."""
    fields = lambda b: {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in b.decode("utf-8", "replace").split("\r\n")[1:])}
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, block, fields(http), payload


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, seq, at = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        rows, held = [], 0
        for page, url, html, digest, to in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers_to"], strict=True):
            page, to = (None if pd.isna(x) else int(x) for x in (page, to))
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = z.compress(record(page, url, (html or "").encode(), digest, to)) + z.flush()
            rows.append((f"{part:06d}-{seq:06d}", at, len(member), surt(url), NO_PAGE if page is None else page, digest, url, member))
            at += len(member)
            held += len(member)
            if at >= ARCHIVE_BYTES:
                at, seq = 0, seq + 1
            if held >= ARCHIVE_BYTES:
                yield pd.DataFrame(rows, columns=_MEMBER)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_MEMBER)


_MEMBER = [x.split()[0] for x in MEMBER.split(", ")]
_BLOCK = [x.split()[0] for x in BLOCK.split(", ")]
_PLACE = [x.split()[0] for x in PLACE.split(", ")]


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The archives of ``pages``, written, a row for each record (MEMBER): of equal payloads of LEAST_PAYLOAD bytes or more that of the
    largest page_id is a response and others revisit it, smaller payloads are all responses."""
    ship(pages.sparkSession)
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    d = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes"))
    again = d.where(F.col("bytes") >= LEAST_PAYLOAD).groupBy("digest", "bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    again = small(table(again.select(F.col("digest").alias("__d"), "bytes", "largest"), "again").withColumnRenamed("bytes", "__b"))
    d = d.join(again, (F.col("digest") == F.col("__d")) & (F.col("bytes") == F.col("__b")), "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("largest"))
    d = d.select("page_id", "url", "html", "digest", F.when(other, F.col("largest")).alias("refers_to"))
    return table(d.mapInPandas(_written, MEMBER), "archives", PAGES)


def _shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A sorted range of captures -> the blocks of one shard, each with its first key."""
    shard, block = TaskContext.get().partitionId(), 0
    lines: list[tuple[str, int, str]] = []

    def close() -> pd.DataFrame:
        nonlocal block
        z = zlib.compress("\n".join(f"{k} {p} {x}" for k, p, x in lines).encode(), 6)
        out = pd.DataFrame([(shard, block, lines[0][0], lines[0][1], z)], columns=_BLOCK)
        block += 1
        lines.clear()
        return out

    for b in batches:
        for key, page, archive, offset, length, digest, url in zip(b["key"], b["page"], b["archive"], b["offset"], b["length"], b["digest"], b["url"], strict=True):
            lines.append((key, page, json.dumps({"archive": archive, "offset": offset, "length": length, "digest": digest, "url": url}, ensure_ascii=False)))
            if len(lines) == LINES:
                yield close()
    if lines:
        yield close()


def index(archives: DataFrame) -> DataFrame:
    """The blocks of the index over archives (BLOCK), written; rows of one key and page, too, may lie in several shards."""
    n = parts(archives.sparkSession)
    c = archives.select("key", "page", "archive", "offset", "length", "digest", "url")
    c = c.repartitionByRange(n, "key", "page", "archive", "offset").sortWithinPartitions("key", "page", "archive", "offset")
    return table(c.mapInPandas(_shard, BLOCK), "index", PAGES)


def around(firsts: list[tuple[str, int]], w: tuple[str, int]) -> range:
    """The places in ``firsts``, sorted first keys, of the pieces that may hold ``w``: equal keys may run on into the next."""
    return range(max(0, bisect.bisect_left(firsts, w) - 1), max(1, bisect.bisect_right(firsts, w)))


def _to_shard(heads: list[tuple[str, int, int]]):
    firsts = [h[:2] for h in heads]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(heads[i][2], *w) for w in zip((surt(u) for u in b["url"]), b["page"], strict=True) for i in around(firsts, w)]
            yield pd.DataFrame(rows, columns=["shard", "key", "page"])

    return run


def _to_block(asked: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
    """A binary search in the directory of one shard for each key asked of it."""
    entries = sorted(zip(directory["first_key"], directory["first_page"], directory["block"], strict=True))
    firsts = [e[:2] for e in entries]
    wanted = sorted(set(zip(asked["key"], asked["page"], strict=True)))
    rows = [(int(directory["shard"].iloc[0]), entries[i][2], *w) for w in wanted for i in around(firsts, w)] if entries else []
    return pd.DataFrame(rows, columns=["shard", "block", "key", "page"])


def _in_block(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """What the lines of one block say of the keys asked of it."""
    wanted = set(zip(asked["key"], asked["page"].astype(int), strict=True))
    rows = []
    for z in block["lines"]:
        for line in zlib.decompress(z).decode().split("\n"):
            key, page, said = line.split(" ", 2)
            if (key, int(page)) in wanted:
                x = json.loads(said)
                rows.append((int(page), x["archive"], x["offset"], x["length"]))
    return pd.DataFrame(rows, columns=_PLACE)


def _places(rows: DataFrame, *cols: str) -> list[tuple] | None:
    """The distinct values of ``cols`` in ``rows``, which are written; None if they are more than FEW."""
    some = rows.select(*cols).distinct().limit(FEW + 1).collect()
    return [tuple(r) for r in some] if len(some) <= FEW else None


def _at(df: DataFrame, places: list[tuple] | None, *cols: str) -> DataFrame:
    """``df`` at ``places`` only: predicates that reach the files, of which then only some pages are read."""
    if places is None:
        return df
    each = [reduce(lambda x, y: x & y, [F.col(c) == F.lit(v) for c, v in zip(cols, p, strict=True)]) for p in places]
    return df.where(reduce(or_, each)) if each else df.where(F.lit(False))


def lookup(blocks: DataFrame, asked: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page, archive, offset, length) of all captures of the asked (url, page_id); those not in the index have no rows."""
    ship(blocks.sparkSession)
    directory = blocks.select("shard", "block", "first_key", "first_page")
    # one small row for each range partition: as many as spark.sql.shuffle.partitions at most
    heads = sorted(tuple(r["h"]) for r in directory.groupBy("shard").agg(F.min(F.struct("first_key", "first_page", "shard")).alias("h")).collect())
    a = asked.select(F.coalesce(F.col(f"`{page_id}`").cast("bigint"), F.lit(NO_PAGE)).alias("page"), F.col(f"`{url}`").alias("url"))
    few = a.limit(FEW + 1).count() <= FEW
    a = a.mapInPandas(_to_shard(heads), "shard int, key string, page bigint") if heads else a.select(F.lit(0).alias("shard"), F.col("url").alias("key"), "page").where(F.lit(False))
    if few:
        a = table(a, "asked")
        directory = _at(directory, _places(a, "shard"), "shard")
    hit = a.groupBy("shard").cogroup(directory.groupBy("shard")).applyInPandas(_to_block, "shard int, block int, key string, page bigint")
    if few:
        hit = table(hit, "hit")
        blocks = _at(blocks, _places(hit, "shard", "block"), "shard", "block")
    return hit.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block")).applyInPandas(_in_block, PLACE)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for page, member in zip(b["page"], b["member"], strict=True):
            warc, _, http, payload = parse(zlib.decompress(member, 31))
            digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
            kind = warc["warc-type"]
            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"record {warc['warc-record-id']} is damaged")
            to = warc.get("warc-refers-to", "<urn:page:>")[len("<urn:page:") : -1]
            rows.append((None if page == NO_PAGE else page, len(payload) if kind == "response" else int(http["content-length"]), digest, kind, int(to) if to else None, warc["warc-target-uri"]))
        out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])
        yield out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def read(archives: DataFrame, where: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of the records at (archive, offset).

    Few places are read by themselves; up to the size bound of a broadcast the archives are read in place; beyond it records
    meet the asked places in a join on both columns, which are even whatever is asked.
    """
    where = table(where.select("page", F.col("archive").alias("__archive"), F.col("offset").alias("__offset")), "where")
    data = _at(archives.select("archive", "offset", "member"), _places(where, "__archive", "__offset"), "archive", "offset")
    found = data.join(small(where), (F.col("archive") == F.col("__archive")) & (F.col("offset") == F.col("__offset")))
    return found.select("page", "member").mapInPandas(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to archives, index them, look every page up and read its record back: a row for each row.

    A null html is an empty payload, a null url has the empty key, a null page_id is never a group's response unless all are
    (then its rows are responses). Repeated rows each have a record; the largest page_id's repeats are all responses.
    An empty table gives no rows. Other columns are not read.
    """
    archives = write(pages, page_id, url, html)
    return read(archives, lookup(index(archives), pages, page_id, url))


def _exported(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = out = None
        for b in batches:
            done = []
            for archive, member in zip(b["archive"], b["member"], strict=True):
                if archive != name:
                    if out is not None:
                        done.append(close(out, name))
                    name = archive
                    out = open(f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}", "wb")  # noqa: SIM115
                out.write(member)
            yield pd.DataFrame({"path": done})
        if out is not None:
            yield pd.DataFrame({"path": [close(out, name)]})

    def close(out, name: str) -> str:
        out.close()
        path = f"{folder}/{name}.warc.gz"
        os.replace(out.name, path)  # a task that is run again writes the same file
        return path

    return run


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive to ``folder``, which all executors must have, as a .warc.gz file; (path) of each. Every archive is
    written by one task, none passes through the driver."""
    ship(archives.sparkSession)
    a = archives.select("archive", "offset", "member").repartition(parts(archives.sparkSession), "archive").sortWithinPartitions("archive", "offset")
    return a.mapInPandas(_exported(folder), "path string")
