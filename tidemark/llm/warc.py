"""WARC archives as seekable Zstandard bundles.

A bundle is a file of at most about `BUNDLE_BYTES` of records, each record (WARC/1.1) within one frame; records are
gathered into a frame until it holds `FRAME_BYTES`, a larger record has a frame of its own. Frames are
compressed independently. The last thing in the file is the seek table of the seekable format: a skippable frame
with the compressed and decompressed size of every frame. The index, a Parquet table, maps each record id to
bundle, frame, offset and length within the decompressed frame, so that a reader fetches and decompresses just the frames
it needs.

Of records with equal payloads (SHA-1 and length) of at least `min_bytes`, the one with the largest page id is the response
and the others are revisits that refer to it; they are found by one aggregation over digests and one join, and Spark splits
the partition of a digest that very many pages share. Smaller payloads are always responses.

Null html is an empty payload. Null urls leave the target URI out. A row whose page id repeats the response's id is a response
too. Null page ids are never referred to while another row of the payload has one. An empty table makes no bundle. Files of lost task
attempts may stay in the folder; the index names only those of attempts that counted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_bytes, ship

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
LEVEL = 3
INDEX = "page_id {0}, url string, bundle string, frame int, offset long, length long"


def mark_revisits(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, record_type and refers_to of every row."""
    payload = F.coalesce(pages[html_col], F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    groups = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
    shared = groups.agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = rows.join(shared, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("largest")).alias("refers_to"),
    )


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has no payload of its own."""
    block = b"" if kind == "revisit" else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Payload-Length", str(len(payload))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    fields.append(("Content-Length", str(len(http) + len(block))))
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + http + block + b"\r\n\r\n"


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, payload and end of the record at `start`."""
    head_end = data.index(b"\r\n\r\n", start)
    version, *lines = data[start:head_end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at {start}")
    fields = dict(line.split(": ", 1) for line in lines)
    body, size = head_end + 4, int(fields["Content-Length"])
    http_end = data.index(b"\r\n\r\n", body) + 4
    return fields, data[http_end : body + size], body + size + 4


class BundleWriter:
    """Writes frames and, when closed, the seek table."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset in it where the record will be."""
        if self.waiting and self.size + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.frames), self.size
        self.waiting.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.waiting:
            frame = self.compressor.compress(b"".join(self.waiting))
            self.sink.write(frame)
            self.frames.append((len(frame), self.size))
            self.written += len(frame)
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, source):
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        end = source.size()
        source.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("the bundle has no seek table")
        source.seek(end - 9 - 8 * n)
        sizes = struct.unpack(f"<{2 * n}I", source.read(8 * n))
        self.sizes, self.starts = list(zip(sizes[::2], sizes[1::2])), [0]
        for size, _ in self.sizes:
            self.starts.append(self.starts[-1] + size)

    def frame(self, number: int) -> bytes:
        self.source.seek(self.starts[number])
        packed, size = self.sizes[number]
        return self.decompressor.decompress(self.source.read(packed), max_output_size=size)


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write the records (as mark_revisits gives them) to bundles below `folder`, a path all executors share.

    Returns the index, which is lazy: write or keep it, for every run of it writes the bundles.
    """
    ship(records.sparkSession)
    id_type = records.schema["page_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, number, bundle, name = TaskContext.get(), 0, None, ""
        for batch in by_bytes(batches, "payload", BATCH_BYTES):
            places = []
            for row in batch.to_pylist():
                if bundle is not None and bundle.written + bundle.size > BUNDLE_BYTES:
                    bundle.close()
                    bundle, number = None, number + 1
                if bundle is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    bundle = BundleWriter(store.open_output_stream(f"{root}/{name}", compression=None))
                data = record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["record_type"], row["refers_to"])
                places.append((name, *bundle.add(data), len(data)))
            names, frames, offsets, lengths = zip(*places)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(names, pa.string()), pa.array(frames, pa.int32()),
                    pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                ],
                names=["page_id", "url", "bundle", "frame", "offset", "length"],
            )
        if bundle is not None:
            bundle.close()

    return records.mapInArrow(write, INDEX.format(id_type))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a string) and payload (null in revisits) of the records
    that `index` names.

    The places are sorted by bundle and frame, so a task opens each bundle once and decompresses each frame it needs
    once, whether the index is whole or a selection.
    """
    ship(index.sparkSession)
    id_type = index.schema["page_id"].dataType.simpleString()
    places = index.select("page_id", "bundle", "frame", "offset", "length")
    places = places.repartition("bundle", (F.col("frame") / 64).cast("int")).sortWithinPartitions("bundle", "frame", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard  # noqa: F401 - fails early where it is missing
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        open_name, reader, at, data, source = None, None, -1, b"", None
        for batch in batches:
            rows, size = [], 0
            for place in batch.to_pylist():
                if place["bundle"] != open_name:
                    if source is not None:
                        source.close()
                    open_name, at = place["bundle"], -1
                    source = store.open_input_file(f"{root}/{open_name}")
                    reader = BundleReader(source)
                if place["frame"] != at:
                    at, data = place["frame"], reader.frame(place["frame"])
                fields, payload, end = parse(data, place["offset"])
                if end != place["offset"] + place["length"]:
                    raise ValueError(f"record of {place['length']} bytes ends at {end}")
                revisit = fields["WARC-Type"] == "revisit"
                rows.append(
                    (
                        place["page_id"], int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        fields["WARC-Type"], fields["WARC-Refers-To"][10:-1] if revisit else None, None if revisit else payload,
                    )
                )
                size += len(payload)
                if size >= BATCH_BYTES:
                    yield _records(rows, batch.column("page_id").type)
                    rows, size = [], 0
            if rows:
                yield _records(rows, batch.column("page_id").type)
        if source is not None:
            source.close()

    return places.mapInArrow(
        read,
        f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary",
    )


def _records(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
