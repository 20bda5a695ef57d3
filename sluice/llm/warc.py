"""WARC archives as seekable Zstandard bundles.

Records in ascending page_id are grouped into frames that decompress alone. After
the frames come two skippable frames: a map from record to (frame, place in the
decompressed frame), and the seek table of the public seekable format, which ends
the file. Readers that know neither still see plain Zstandard.

Equal payloads of LEAST bytes or more are stored once: the record of the largest
page_id is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import NO_ID, file_system, id_or_none, new_folder, put_file, stored

LEAST = 1000
#: Decompressed bytes after which a frame ends.
FRAME = 1 << 18
LEVEL = 3
# Fixed values of the public formats.
SKIPPABLE_MAP, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:sluice:page:"


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, more: str = "") -> bytes:
    """One record; payload_bytes and digest are those of the full payload for revisits too. more: what tells records of one page_id apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{page}{more}>",
        f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields, block, place after the record)."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(fields["Content-Length"])
    return fields, data[start : start + size], start + size + 4


def skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class Bundle:
    """Random access to a bundle."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * frames, size - 9 - 8 * frames)
        self.sizes = [struct.unpack_from("<II", table, 8 * k) for k in range(frames)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        import zstandard

        packed, size = self.sizes[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size)

    def entries(self) -> Iterator[tuple[int, int, int]]:
        """(page_id, frame, place) of each record; the map is the last entry of the seek table and decompresses to nothing."""
        packed, _ = self.sizes[-1]
        return struct.iter_unpack("<qII", self.file.read_at(packed, self.starts[-2])[8:])

    def places(self) -> dict[int, tuple[int, int]]:
        """page_id -> (frame, place) of its first record."""
        found: dict[int, tuple[int, int]] = {}
        for page, frame, at in self.entries():
            found.setdefault(page, (frame, at))
        return found

    def record(self, page: int) -> tuple[dict[str, str], bytes]:
        frame, at = self.places()[page]
        return parse(self.frame(frame), at)[:2]

    def chosen(self, pages: set[int]) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records of these pages; only frames that hold one are read."""
        now, data = -1, b""
        for page, frame, at in self.entries():
            if page in pages:
                if frame != now:
                    now, data = frame, self.frame(frame)
                yield parse(data, at)[:2]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.sizes) - 1):
            data, at = self.frame(k), 0
            while at < len(data):
                fields, block, at = parse(data, at)
                yield fields, block

    def close(self) -> None:
        self.file.close()


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the bundles; a row for each: file, uri, n_records, bytes, first_page, last_page.

    Null html is an empty payload, a null url leaves its field out. page_id is an integer.
    Rows that share one are records of their own, each with its own payload, in one file;
    those with the payload and page_id of a response are responses too. Rows without one
    come first, spread by payload. A task that is run again writes the same file again.
    """
    import zstandard  # noqa: F401  fail here, not in the tasks

    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col(html), F.lit(""))
    own = pages.select(F.coalesce(F.col(page_id), F.lit(NO_ID)).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("html"))
    own = own.withColumn("digest", F.sha1("html"))
    digests = stored(own.select("page", F.octet_length("html").cast("long").alias("n"), "digest"), "digests")
    # Only payloads that come twice have anything to refer to; copies are counted before they move.
    copied = digests.filter(F.col("n") >= LEAST).groupBy("digest", "n").agg(F.max("page").alias("first"), F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m")
    marked = digests.join(copied, ["digest", "n"]).filter("first <> page").select("page", "digest", F.col("first").alias("refers")).distinct()
    # Marks of revisits and pages meet in the shuffle that orders the pages, so html moves once.
    both = own.withColumns({"refers": F.lit(None).cast("long"), "side": F.lit(1)}).unionByName(
        marked.withColumns({"url": F.lit(None).cast("string"), "html": F.lit(None).cast("string"), "side": F.lit(0)})
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col("page") == NO_ID, F.col("digest")).otherwise(F.lit(""))
    ordered = both.repartitionByRange(n, F.col("page"), spread).sortWithinPartitions("page", "digest", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        uri, total = f"{folder}/part-{k:05d}.warc.zst", {"records": 0, "bytes": 0}

        def parts() -> Iterator[bytes]:
            packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
            frame, size, sizes, places = [], 0, [], []
            mark, before, again = (None, None, None), None, 0

            def packed() -> bytes:
                data = packer.compress(b"".join(frame))
                sizes.append((len(data), size))
                total["bytes"] += len(data)
                return data

            for batch in batches:
                for page, address, text, digest, refers, side in zip(*(batch[c] for c in ("page", "url", "html", "digest", "refers", "side")), strict=True):
                    if side == 0:
                        mark = page, digest, int(refers)
                        continue
                    again = again + 1 if page == before else 0
                    before = page
                    # Rows without an id may be in several files; the payload tells those apart.
                    more = f":{digest}:{again}" if page == NO_ID else f":{again}" if again else ""
                    refers_to = mark[2] if mark[:2] == (page, digest) else None
                    data = record(page, address, text.encode("utf-8", "surrogatepass"), digest, refers_to, date, more)
                    places.append((page, len(sizes), size))
                    frame.append(data)
                    size += len(data)
                    if size >= FRAME:
                        yield packed()
                        frame, size = [], 0
            if frame:
                yield packed()
            index = skippable(SKIPPABLE_MAP, b"".join(struct.pack("<qII", *p) for p in places))
            sizes.append((len(index), 0))
            table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
            seek = skippable(SKIPPABLE_SEEK, table)
            total.update(records=len(places), first=places[0][0] if places else None, last=places[-1][0] if places else None)
            total["bytes"] += len(index) + len(seek)
            yield index
            yield seek

        put_file(uri, parts())
        yield pd.DataFrame({"file": [k], "uri": [uri], "n_records": [total["records"]], "bytes": [total["bytes"]], "first_page": [total["first"]], "last_page": [total["last"]]}, dtype="object")

    schema = "file int, uri string, n_records long, bytes long, first_page long, last_page long"
    columns = ["page", "url", "html", "digest", "refers", "side"]
    # The refers column holds large integers; as text it survives nulls in pandas.
    return stored(ordered.select(*columns[:4], F.col("refers").cast("string").alias("refers"), "side").mapInPandas(run, schema), "archives")


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """Records of the bundles: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads are checked against their digests.

    pages: only the records of these, found by the files' page ranges, the record maps
    and the seek tables; no other frame is read.
    """
    wanted = None if pages is None else set(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                bundle, rows = Bundle(uri), []
                for fields, block in bundle.records() if wanted is None else bundle.chosen(wanted):
                    rows.append(row(fields, block))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=NAMES)
                        rows = []
                bundle.close()
                yield pd.DataFrame(rows, columns=NAMES)

    if wanted is not None:
        files = files.filter((F.col("last_page") >= min(wanted)) & (F.col("first_page") <= max(wanted))) if wanted else files.limit(0)
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = files.select("file", "uri").repartition(n, "file").select("uri").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({"page_id": id_or_none("page_id"), "refers_to": F.col("refers_to").cast("long")})


def row(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload differs from its digest")
    refers = fields.get("WARC-Refers-To")
    number = lambda urn: urn.strip("<>").removeprefix(URN).partition(":")[0]
    return int(number(fields["WARC-Record-ID"])), size, digest, kind, number(refers) if refers else None
