"""Packing documents into training sequences by multiway differencing.

Documents are cut at the sequence length; whole sequences stand alone, and what is
left over is packed in portions. Each leftover starts as a partition into k windows
that holds it in one of them. The two partitions of the largest spread are merged
time and again, the fullest window of one with the emptiest of the other, so that
their imbalances cancel, until one partition into nearly equal windows is left. If
a window then exceeds the capacity, the portion is packed again with one window
more.

Portions are closed just below k windows by cutting the document that crosses
their end; other documents that fit in a sequence are cut only in portions that
would waste too many windows. Tasks pack their own rows, in the order of a written
table, so there is no shuffle and a task that is run again packs the same.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sluice.llm.common import id_or_none, small_batches, stored
from sluice.llm.token_output import id_width, tokenized
from sluice.llm.tokens import tokenizer_path

CAPACITY = 4096
#: Windows of a portion, and the ids left free in each when a portion is closed, which differencing rarely overruns.
WINDOWS, SLACK = 256, 24
#: Share of windows beyond the least possible number above which a portion's longest pieces are cut in two and it is packed again.
WASTE = 0.03


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items' indices in k groups of nearly equal sums (Karmarkar and Karp's method for many ways).

    A partition is the ascending list of its windows that hold something, each as sum
    and node in one integer. Where two partitions together have more than k of them,
    the fullest of one met the empty ones of the other already, and as many of the
    smallest of both as there are too many meet in opposite order.
    """
    if not sizes:
        return [[] for _ in range(k)]
    nodes: list[tuple[int, int] | None] = [None] * len(sizes)
    heap = [(-size, i, [size << 32 | i]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for serial in range(len(sizes), 2 * len(sizes) - 1):
        _, _, one = heapq.heappop(heap)
        _, _, two = heap[0]
        over = max(0, len(one) + len(two) - k)
        merged = one[over:] + two[over:]
        for x, y in zip(one[:over], reversed(two[:over]), strict=True):
            merged.append(((x >> 32) + (y >> 32)) << 32 | len(nodes))
            nodes.append((x & 0xFFFFFFFF, y & 0xFFFFFFFF))
        merged.sort()
        least = merged[0] >> 32 if len(merged) == k else 0
        heapq.heapreplace(heap, (least - (merged[-1] >> 32), serial, merged))
    groups: list[list[int]] = []
    for window in heap[0][2]:
        group, todo = [], [window & 0xFFFFFFFF]
        while todo:
            n = todo.pop()
            if n < len(sizes):
                group.append(n)
            else:
                todo += nodes[n]
        groups.append(group)
    return groups + [[] for _ in range(k - len(groups))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most capacity; their number rises from the least possible one until all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [sorted(g) for g in groups if g]
        k += 1


def padded(length: int, capacity: int = CAPACITY) -> int:
    """What a sequence takes: its capacity, but a power of two stays as it is."""
    return length if length & (length - 1) == 0 else capacity


def pack(
    docs: DataFrame, path: str | None = None, end: int = 2, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", ids: bool = False
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, with ids=True also the ids.

    Null and empty texts have the end id alone. Every id of every document is in one
    piece; pieces of a sequence have offsets without gaps from 0. Repeated rows are
    packed as often as they come. Sequence ids number the sequences of a task from
    its own multiple of 2 ** 32.
    """
    path = path or tokenizer_path()
    width = id_width(path, end)
    with small_batches(docs.sparkSession):
        tokens = stored(tokenized(docs, path, end, doc_id, text), "ids")
    full = WINDOWS * (capacity - SLACK * capacity // CAPACITY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        held: list[tuple[int, int, np.ndarray, int]] = []
        size = 0

        def place(own: list[tuple[int, int, np.ndarray, int]]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, some, n in own:
                out.append((doc, start, len(some), zlib.crc32(some.astype("<u4").tobytes()), n, sequence, at, some.astype(np.int64) if ids else None))
                at += len(some)
            sequence += 1

        def close() -> None:
            nonlocal held, size
            limit, least = capacity, -(-size // capacity)
            groups = windows_of([len(x[2]) for x in held], capacity)
            while len(groups) > least * (1 + WASTE) and limit > capacity // 4:
                limit = max(1, limit // 2)
                held = [(doc, start + at, own[at : at + limit], n) for doc, start, own, n in held for at in range(0, len(own), limit)]
                groups = windows_of([len(x[2]) for x in held], capacity)
            for group in groups:
                place([held[i] for i in group])
            held, size = [], 0

        def done() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            out.clear()
            return frame if ids else frame.drop(columns="ids")

        for batch in batches:
            for doc, raw in zip(batch["doc"], batch["ids"], strict=True):
                own = np.frombuffer(raw, width)
                whole = len(own) // capacity * capacity
                for start in range(0, whole, capacity):
                    place([(doc, start, own[start : start + capacity], len(own))])
                start = whole
                while start < len(own):
                    some = own[start : start + full - size]
                    held.append((doc, start, some, len(own)))
                    start, size = start + len(some), size + len(some)
                    if size == full:
                        close()
            yield done()
        if held:
            close()
        yield done()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.mapInPandas(run, schema + (", ids array<long>" if ids else "")).withColumn("doc_id", id_or_none("doc_id"))


def sequences(pieces: DataFrame, pad: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, length): pieces with ids put together and padded; a sequence is at most capacity ids, so a group is bounded."""
    from pyspark.sql import functions as F

    joined = pieces.groupBy("sequence_id").agg(F.expr("flatten(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids))").alias("ids"), F.sum("length").alias("length"))
    power = F.expr("length & (length - 1)") == 0
    return joined.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), (capacity - F.col("length")).cast("int")))).alias("ids"), "length")
