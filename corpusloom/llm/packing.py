"""Packing documents into fixed windows of token ids.

Bounded-space online packing: each partition keeps a fixed number of open
windows.  A piece goes to the open window it fills best; if none has room and
no more may be opened, the fullest is topped up from the piece and emitted.
Windows still open at the end are leftovers: their pieces are packed again in
ever fewer partitions, and what is open at the very end is cut into full
windows and windows of a power of two, which take no padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_path, stored
from .tokens import default_tokenizer, encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FIELDS = ["doc_id", "start", "ids", "doc_tokens"]
#: Rows of one Arrow batch sent back.
_BATCH = 2_000


class OpenWindows:
    """The open windows of one partition.  Pieces are ``(doc_id, start, ids, doc_tokens)``, ids as bytes."""

    def __init__(self, size: int, most_open: int, max_padding: int):
        self.size, self.most_open, self.max_padding = size, most_open, max_padding
        self.windows: list[list] = []  # [room, pieces]

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int):
        """Yields windows that are full, or as full as they get, as lists of pieces."""
        at, end = 0, len(ids) // 4
        while end - at >= self.size:
            yield [(doc_id, start + at, ids[4 * at : 4 * (at + self.size)], doc_tokens)]
            at += self.size
        while at < end:
            n = end - at
            best = min((w for w in self.windows if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.windows) < self.most_open:
                best = [self.size, []]
                self.windows.append(best)
            if best is None:
                best = min(self.windows, key=lambda w: w[0])
                n = best[0] if best[0] > self.max_padding else 0
            if n:
                best[1].append((doc_id, start + at, ids[4 * at : 4 * (at + n)], doc_tokens))
                best[0] -= n
                at += n
            if best[0] <= self.max_padding and (best[0] == 0 or at < end):
                self.windows.remove(best)
                yield best[1]

    def leftovers(self):
        for _, pieces in sorted(self.windows, key=lambda w: w[0]):
            yield pieces
        self.windows = []

    def closed(self):
        """The open windows without padding: full ones, then powers of two."""
        rest = [p for pieces in self.leftovers() for p in pieces]
        left = sum(len(p[2]) // 4 for p in rest)
        rest.reverse()
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left, out = left - room, []
            while room:
                doc_id, start, ids, total = rest.pop()
                n = min(room, len(ids) // 4)
                out.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.append((doc_id, start + n, ids[4 * n :], total))
                room -= n
            yield out


class _Rows:
    """Collects pieces into Arrow batches."""

    def __init__(self, level: int):
        from pyspark import TaskContext

        self.next = (level << 56) | (TaskContext.get().partitionId() << 32)
        self.rows: list[tuple] = []

    def window(self, pieces, leftover=False):
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, None if leftover else self.next, None if leftover else at))
            at += n
        self.next += not leftover

    def batches(self, least: int):
        if len(self.rows) >= least and self.rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), kinds)], names)
            self.rows = []


def _packed(batches, pieces_of, level, size, most_open, max_padding, last):
    rows, windows = _Rows(level), OpenWindows(size, most_open, max_padding)
    for batch in batches:
        for piece in pieces_of(batch):
            for full in windows.add(*piece):
                rows.window(full)
            yield from rows.batches(_BATCH)
    for pieces in windows.closed() if last else windows.leftovers():
        rows.window(pieces, leftover=not last)
    yield from rows.batches(1)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = 2048, most_open: int = 32, max_padding: int = 8, end_id: int = 1, fold: int = 16) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence.

    Returns ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ``ids``
    are little-endian unsigned 32-bit.  A null or empty text is its end id alone;
    a null id stays null; repeated rows are packed each on its own; an empty table
    gives no rows; other columns are ignored.  Texts of any length are cut, never
    shortened.  A sequence holds ``size`` ids, up to ``max_padding`` fewer, or a
    power of two.  Leftovers are at most ``most_open`` windows a partition and are
    merged ``fold`` partitions into one, again and again.
    """
    path = tokenizer or default_tokenizer()
    end = np.asarray([end_id], "<u4").tobytes()

    def first(batches):
        text = encoder(path)

        def pieces_of(batch):
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = text.encode(t.as_py()) + end
                yield doc_id, 0, ids, len(ids) // 4

        return _packed(batches, pieces_of, 0, size, most_open, max_padding, False)

    def again(level, last):
        def merged(batches):
            def pieces_of(batch):
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _FIELDS]
                return zip(*columns)

            return _packed(batches, pieces_of, level, size, most_open, max_padding, last)

        return merged

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    now = stored(source.mapInArrow(first, PIECES), "packed", new_path(spark, "packed"))
    done, level = [now.where("sequence_id is not null")], 0
    parts = now.rdd.getNumPartitions()
    while True:
        level += 1
        left = now.where("sequence_id is null")
        parts = max(1, parts // fold)
        now = stored(left.coalesce(parts).mapInArrow(again(level, parts == 1), PIECES), "packed", new_path(spark, "packed"))
        done.append(now.where("sequence_id is not null"))
        if parts == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op3_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
