"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a seek table in a skippable frame at the end
of the file gives every frame's sizes. The index maps a record to its archive, frame and place in the
decompressed frame, so one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.skew import join_by_key
from glyphmill.session import materialize

FRAME_BYTES, ARCHIVE_BYTES = 1 << 18, 1 << 30
# Frames in a row that one task reads from an archive.
RUN = 32
# Fixed values of the seekable format and of the revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id bigint, archive string, frame int, offset bigint, length bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a full response, or a revisit that carries the headers alone."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        # A header value is one line.
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])


def parse(frame: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` of a decompressed frame, and the place after it."""
    body = frame.index(b"\r\n\r\n", at) + 4
    head = _headers(frame[at : body - 4])
    end = body + int(head["Content-Length"])
    start = frame.index(b"\r\n\r\n", body) + 4
    http = _headers(frame[body : start - 4])
    revisit = head["WARC-Type"] == "revisit"
    payload = None if revisit else frame[start:end]
    found = {
        "page_id": _page(head["WARC-Record-ID"]),
        "url": head.get("WARC-Target-URI"),
        "payload_bytes": int(http["Content-Length"]) if payload is None else len(payload),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": head["WARC-Type"],
        "refers_to": _page(head["WARC-Refers-To"]) if revisit else None,
        "payload": payload,
    }
    return found, end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with ``(compressed, decompressed)`` sizes of all frames."""
    entries = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


@dataclass
class Archive:
    """Writer of one archive: frames go out as they fill."""

    path: str
    fs: pyarrow.fs.FileSystem
    frames: list[tuple[int, int]] = field(default_factory=list)
    buffer: list[bytes] = field(default_factory=list)
    waiting: list[tuple] = field(default_factory=list)
    held: int = 0
    total: int = 0

    def __post_init__(self) -> None:
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.codec = zstandard.ZstdCompressor(level=3)

    def add(self, page_id: int | None, data: bytes) -> list[tuple]:
        """Index rows of the frame that this record fills, if it does."""
        self.buffer.append(data)
        self.waiting.append((page_id, len(self.frames), self.held, len(data)))
        self.held += len(data)
        self.total += len(data)
        return self.flush() if self.held >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        if not self.buffer:
            return []
        packed = self.codec.compress(b"".join(self.buffer))
        self.out.write(packed)
        self.frames.append((len(packed), self.held))
        done, self.buffer, self.waiting, self.held = self.waiting, [], [], 0
        return done

    def close(self) -> list[tuple]:
        done = self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return done


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        archive, n = None, 0

        def rows(done: list[tuple]) -> pd.DataFrame:
            frame = pd.DataFrame(done, columns=["page_id", "frame", "offset", "length"])
            return frame.assign(archive=name, page_id=frame["page_id"].astype("Int64"))[["page_id", "archive", "frame", "offset", "length"]]

        for batch in batches:
            done: list[tuple] = []
            whole = lambda c: [None if pd.isna(v) else int(v) for v in batch[c]]
            for page_id, url, html, refers_to in zip(whole("page_id"), batch["url"], batch["html"], whole("refers_to")):
                if archive is None:
                    # The attempt is part of the name: what a lost attempt wrote is in no index.
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:04d}.warc.zst"
                    fs.create_dir(root, recursive=True)
                    archive, n = Archive(f"{root}/{name}", fs), n + 1
                done += archive.add(page_id, record(page_id, url, html.encode(), refers_to))
                if archive.total >= ARCHIVE_BYTES:
                    yield rows(done + archive.close())
                    archive, done = None, []
            if done:
                yield rows(done)
        if archive is not None:
            yield rows(archive.close())

    return write


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload a page of larger id also has.

    Only ids and digests move. A payload that a third of all pages share is one row of counts; its
    pages are salted when they meet it.
    """
    slim = pages.select("page_id", "digest").where(F.col("page_id").isNotNull())
    groups = materialize(slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    joined = join_by_key(slim, groups, ["digest"], "n", total, ["page_id"])
    return joined.where(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as archives below ``folder``; returns the index.

    Of the pages with equal payloads the one with the largest ``page_id`` is a response and the others
    revisit it; a page listed twice gets the same record twice. Rows without a ``page_id`` cannot be
    named: they are responses that nothing refers to. A NULL html is an empty payload. ``folder`` must be one
    that all executors reach. An empty table writes nothing.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    joined = rows.join(revisits(rows), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    index = materialize(joined.mapInPandas(_writer(folder), INDEX))
    return index.withColumn("archive", F.concat(F.lit(folder.rstrip("/") + "/"), "archive"))


class Reader:
    """Random access to the frames of one archive."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        frames, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(size - 9 - 8 * frames)
        table = self.file.read(8 * frames)
        self.sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(frames)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.codec = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        self.file.seek(self.starts[i])
        return self.codec.decompress(self.file.read(self.sizes[i][0]), max_output_size=self.sizes[i][1])


def _frames(places: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, bytes]]:
    for archive, rows in places.groupby("archive", sort=True):
        reader = Reader(archive)
        for i, mine in rows.groupby("frame", sort=True):
            yield mine, reader.frame(int(i))
        reader.file.close()


def _records(found: list[dict], payloads: bool) -> pd.DataFrame:
    rows = pd.DataFrame(found, columns=[c.split()[0] for c in RECORDS.split(", ")])
    if not payloads:
        rows["payload"] = None
    return rows.astype({"page_id": "Int64", "refers_to": "Int64"})


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in an index, frame by frame; a response's digest is computed again and checked."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, frame in _frames(batch):
                found, at = [], 0
                while at < len(frame):
                    row, at = parse(frame, at)
                    if row["payload"] is not None and digest_of(row["payload"]) != row["payload_digest"]:
                        raise ValueError(f"damaged record {row['page_id']}")
                    found.append(row)
                yield _records(found, payloads)

    frames = index.select("archive", "frame").distinct()
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames.repartition(tasks, "archive", F.expr(f"frame div {RUN}")).sortWithinPartitions("archive", "frame")
    return dealt.mapInPandas(scan, RECORDS)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the ids (column ``page_id``), each by decompressing its frame alone."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mine, frame in _frames(batch):
                yield _records([parse(frame, int(at))[0] for at in mine["offset"]], True)

    wanted = index.join(ids.select("page_id").distinct(), "page_id")
    return wanted.select("archive", "frame", "offset").sortWithinPartitions("archive", "frame").mapInPandas(pick, RECORDS)
