"""Token ids in binary files: blocks coded by a static range asymmetric numeral system.

A folder holds `table` (the frequencies shared by all files), `part-00000.rans`
and so on, in ascending order of doc_id. A file is a row of independent blocks and
a footer:

    file    magic, blocks, index (JSON), length of the index (4 bytes), magic
    block   header (JSON after its length), documents, states, checkpoints, words

Checksums cover the table, every block as written and the ids of every block. A
block says which documents' ids it holds, from where, so long documents continue
over blocks, and a block, or a checkpoint in it, can be decoded without the rest.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import rans
from sluice.llm.common import NO_ID, file_system, get_range, give_back, id_or_none, new_folder, put_file, stored
from sluice.llm.tokens import encoder, tokenizer_path

MAGIC = b"SLUICER1"
#: Ids of a block.
BLOCK = 1 << 20


def tokenized(docs: DataFrame, path: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, ids): each document's ids with the end id, as little-endian bytes of 2 each where the vocabulary allows, else 4. A null id is NO_ID."""
    width = id_width(path, end)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = encoder(path), np.uint32(end).tobytes()
        for batch in batches:
            ids = [np.frombuffer(x + last, "<u4") for x in own.ids(batch["text"])]
            yield pd.DataFrame({"doc": batch["doc"], "n": [len(x) for x in ids], "ids": [x.astype(width).tobytes() for x in ids]})
        give_back()

    own = docs.select(F.coalesce(F.col(doc_id), F.lit(NO_ID)).cast("long").alias("doc"), F.col(text).alias("text"))
    return own.mapInPandas(run, "doc long, n long, ids binary")


def id_width(path: str, end: int) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(True), end + 1) <= 1 << 16 else "<u4"


def counted(tokens: DataFrame, width: str) -> DataFrame:
    """(id, n) over all documents, summed in each task before they move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for x in batch["ids"]:
                own = np.bincount(np.frombuffer(x, width))
                if len(own) > len(counts):
                    counts = np.pad(counts, (0, len(own) - len(counts)))
                counts[: len(own)] += own
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"id": at, "n": counts[at]})

    return tokens.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def pack_block(coder: rans.Coder, ids: np.ndarray, docs: list[tuple[int, int, int]]) -> bytes:
    """docs: (doc_id, ids of it before this block, ids here)."""
    states, words, marks, places = coder.encode(ids)
    body = b"".join([np.array(docs, "<i8").tobytes(), states.astype("<u8").tobytes(), marks.astype("<u8").tobytes(), places.tobytes(), words.tobytes()])
    head = json.dumps({"ids": len(ids), "docs": len(docs), "marks": len(places), "words": len(words), "body_crc": zlib.crc32(body), "ids_crc": zlib.crc32(ids.astype("<u4").tobytes())}).encode()
    return len(head).to_bytes(4, "little") + head + body


def open_block(data: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(header, documents, states, checkpoint states, their places, words); raises if a checksum differs."""
    n = int.from_bytes(data[:4], "little")
    head, body = json.loads(data[4 : 4 + n]), data[4 + n :]
    if zlib.crc32(body) != head["body_crc"]:
        raise ValueError("block: checksum differs")
    at, parts = 0, []
    for kind, many in (("<i8", 3 * head["docs"]), ("<u8", rans.LANES), ("<u8", rans.LANES * head["marks"]), ("<u4", head["marks"]), ("<u4", head["words"])):
        size = many * int(kind[-1])
        parts.append(np.frombuffer(body[at : at + size], kind))
        at += size
    return head, parts[0].reshape(-1, 3), parts[1], parts[2].reshape(-1, rans.LANES), parts[3], parts[4]


def unpack_block(coder: rans.Coder, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, documents) of a block."""
    head, docs, states, _, _, words = open_block(data)
    ids = coder.decode(states, words, head["ids"])
    if zlib.crc32(ids.astype("<u4").tobytes()) != head["ids_crc"] or (coder.last != rans.LOW).any():
        raise ValueError("block: decoded ids differ")
    return ids, docs


def unpack_from(coder: rans.Coder, data: bytes, mark: int) -> np.ndarray:
    """The ids of a block from its checkpoint number mark (the first is 0) to the next, for decoders in parallel."""
    head, _, _, marks, places, words = open_block(data)
    return coder.decode(marks[mark], words, min(rans.EVERY, head["ids"] - (mark + 1) * rans.EVERY), int(places[mark]))


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files and return a row for each: file, uri, n_docs, n_ids, bytes, before (ids in all earlier files).

    Null and empty texts have the end id alone. Rows without doc_id come first; rows
    that share one are documents of their own. A task that is run again writes the
    same file again.
    """
    spark = docs.sparkSession
    path, folder = path or tokenizer_path(), folder or new_folder(spark, "tokens")
    width = id_width(path, end)
    tokens = stored(tokenized(docs, path, end, doc_id, text), "ids")
    counts = counted(tokens, width).collect()  # a row for each id of the vocabulary at most
    table = np.zeros(max([r["id"] for r in counts], default=0) + 1, np.int64)
    for r in counts:
        table[r["id"]] = r["n"]
    packed = rans.Table.of(table).to_bytes()
    put_text(spark, f"{folder}/table", packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        uri, coder = f"{folder}/part-{k:05d}.rans", rans.Coder(rans.Table.from_bytes(packed))
        index: list[dict] = []
        total = {"docs": 0, "ids": 0, "bytes": 0}

        def parts() -> Iterator[bytes]:
            at = len(MAGIC)
            yield MAGIC
            for ids, own in blocks(batches, width, total):
                data = pack_block(coder, ids, own)
                index.append({"at": at, "bytes": len(data), "ids": len(ids), "first_doc": own[0][0]})
                at += len(data)
                yield data
            foot = json.dumps(index).encode()
            total["bytes"] = at + len(foot) + 4 + len(MAGIC)
            yield foot + len(foot).to_bytes(4, "little") + MAGIC

        put_file(uri, parts())
        yield pd.DataFrame({"file": [k], "uri": [uri], "n_docs": [total["docs"]], "n_ids": [total["ids"]], "bytes": [total["bytes"]]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, "doc").sortWithinPartitions("doc")
    files = stored(ordered.mapInPandas(run, "file int, uri string, n_docs long, n_ids long, bytes long"), "files")
    before, rows = 0, []
    for r in files.orderBy("file").collect():  # a row for each file
        rows.append((*r, before))
        before += r["n_ids"]
    return spark.createDataFrame(rows, "file int, uri string, n_docs long, n_ids long, bytes long, before long")


def put_text(spark, uri: str, data: bytes) -> None:
    """Write a small file from the driver through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def blocks(batches: Iterator[pd.DataFrame], width: str, total: dict) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """(ids, documents in them) of BLOCK ids each, the last of fewer; one block and one document are held."""
    held, docs, size = [], [], 0
    for batch in batches:
        for doc, raw in zip(batch["doc"], batch["ids"], strict=True):
            ids, done = np.frombuffer(raw, width), 0
            total["docs"] += 1
            total["ids"] += len(ids)
            while done < len(ids):
                some = ids[done : done + BLOCK - size]
                held.append(some)
                docs.append((int(doc), done, len(some)))
                done, size = done + len(some), size + len(some)
                if size == BLOCK:
                    yield np.concatenate(held), docs
                    held, docs, size = [], [], 0
    if size:
        yield np.concatenate(held), docs


def read(files: DataFrame, each: str = "digest") -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, or with each="ids" also the ids themselves.

    files: as write() returns them. A task reads whole files, a block at a time.
    """
    with_ids = each == "ids"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, rans.Coder] = {}
        for batch in batches:
            for uri, before in zip(batch["uri"], batch["before"], strict=True):
                folder = uri.rpartition("/")[0]
                if folder not in tables:
                    fs, at = file_system(f"{folder}/table")
                    with fs.open_input_file(at) as f:
                        tables[folder] = rans.Coder(rans.Table.from_bytes(f.read()))
                rows: list[list] = []
                for data in block_bytes(uri):
                    ids, docs = unpack_block(tables[folder], data)
                    at = 0
                    for doc, first, n in docs.tolist():
                        own = ids[at : at + n].astype("<u4")
                        if first:
                            row = rows[-1]
                        else:
                            rows.append(row := [doc, before, 0, 0, []])
                        row[2] += n
                        row[3] = zlib.crc32(own.tobytes(), row[3])
                        if with_ids:
                            row[4].append(own)
                        before, at = before + n, at + n
                    # The last document may go on in the next block.
                    if len(rows) > 1:
                        yield frame(rows[:-1], with_ids)
                        rows = rows[-1:]
                if rows:
                    yield frame(rows, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = files.select("file", "uri", "before").repartition(n, "file").select("uri", "before").mapInPandas(run, schema)
    return found.withColumn("doc_id", id_or_none("doc_id"))


def frame(rows: list[list], with_ids: bool) -> pd.DataFrame:
    out = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    if with_ids:
        out["ids"] = [np.concatenate(r[4]).astype(np.int64) for r in rows]
    return out


def block_bytes(uri: str) -> Iterator[bytes]:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        end = f.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        if end[4:] != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is not such a file")
        n = int.from_bytes(end[:4], "little")
        index = json.loads(f.read_at(n, size - 4 - len(MAGIC) - n))
    for b in index:
        yield get_range(uri, b["at"], b["bytes"])
