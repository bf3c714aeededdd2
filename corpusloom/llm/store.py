"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal
passages give equal chunks wherever they stand.  The store is three tables below
one path:

``chunks``    chunk id (BLAKE2b of the body), body: each chunk once
``recipes``   document, tokens, ids before it in its part, chunk ids, leaf hash;
              in ascending order of the id, part after part
``manifest``  part, documents, tokens, Merkle root of the part's leaves
``root``      one row: parts, documents, tokens, Merkle root of the parts' roots

Bodies hold little-endian ids of two bytes, or four if the vocabulary needs them.
Reading checks every body against its id, computes every leaf again from its
recipe, every part's root from the leaves, and the store's root from the parts, so
changed, missing or added rows of any table fail the read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .crc import Joiner
from .storage import new_path, removed, stored
from .tokens import default_tokenizer, encoder

#: Chunks end where the hash of the last WINDOW ids has MASK's bits zero, after LEAST and at MOST ids.
WINDOW, MASK, LEAST, MOST = 16, 0x1FF, 128, 2048
#: Chunk ids a task remembers to have written already.
REMEMBERED = 200_000


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each id (the finaliser of splitmix64)."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ends(candidates: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids that may end at ``candidates``."""
    ends, last = [], 0
    for end in candidates:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST:
            last = end
            ends.append(end)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def cuts_of(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each stream ``ids[bounds[i]:bounds[i + 1]]``, counted from its start.

    One pass hashes all streams: the first ids' windows reach into the stream before,
    but no chunk ends before ``LEAST``, which is more than ``WINDOW``, ids.
    """
    each = _mixed(ids)
    rolling = each.copy()
    for j in range(1, min(WINDOW, len(ids))):
        rolling[j:] += each[: len(ids) - j] << np.uint64(j)
    at = np.flatnonzero((rolling >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
    first = np.searchsorted(at, bounds[:-1] + LEAST)
    after = np.searchsorted(at, bounds[1:], side="right")
    return [_ends((at[i:j] - start).tolist(), end - start) if end - start > LEAST else [end - start] * (end > start) for i, j, start, end in zip(first.tolist(), after.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream of ids."""
    return cuts_of(np.asarray(ids), np.array([0, len(ids)]))[0]


def chunk_id(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def leaf(doc_id, n_tokens: int, chunk_ids: list[bytes]) -> bytes:
    return hashlib.blake2b(repr((doc_id, n_tokens)).encode() + b"".join(chunk_ids), digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree of hashes; an odd one out moves up; of no leaves the hash of nothing."""
    level = list(leaves) or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        pairs = [hashlib.blake2b(a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, wide: bool = False) -> None:
    """Encode whole texts, each with its end id, and write the store to ``path``.

    A null or empty text is its end id.  Rows that repeat an id are documents of
    their own, in a fixed order; rows without an id come first.  An empty table gives
    an empty store.
    """
    file = tokenizer or default_tokenizer()
    kind = "<u4" if wide else "<u2"
    tail = np.array([end_id], "<u4").tobytes()

    def code(batches):
        from pyspark import TaskContext

        text, uid, seen = encoder(file), TaskContext.get().partitionId() << 33, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                streams = [text.encode(t.as_py()) + tail for t in part.column(1)]
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in streams])])
                ids = np.frombuffer(b"".join(streams), "<u4")
                small, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                for doc_id, start, end, ends in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), cuts_of(ids, bounds)):
                    bodies = [small[width * (start + a) : width * (start + b)] for a, b in zip([0, *ends], ends)]
                    names = [chunk_id(b) for b in bodies]
                    for i, name in enumerate(names):
                        if name in seen:
                            bodies[i] = None
                        elif len(seen) < REMEMBERED:
                            seen[name] = None
                    rows.append((uid, doc_id, end - start, names, bodies))
                    uid += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["uid", "doc_id", "n_tokens", "names", "bodies"])

    def ordered(batches):
        from pyspark import TaskContext

        part, at, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            rows = []
            for uid, doc_id, n, names in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((part, at, uid, doc_id, n, start, names, leaf(doc_id, n, names)))
                at, start = at + 1, start + n
            kinds = [pa.int64()] * 6 + [pa.list_(pa.binary()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["part", "at", "uid", "doc_id", "n_tokens", "start", "names", "leaf"])

    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    staging = new_path(spark, "staging")
    staged = stored(source.mapInArrow(code, "uid long, doc_id long, n_tokens long, names array<binary>, bodies array<binary>"), "staging", staging)
    pairs = staged.select(F.explode(F.arrays_zip("names", "bodies")).alias("c")).select(F.col("c.names").alias("id"), F.col("c.bodies").alias("body")).where("body is not null")
    stored(pairs.groupBy("id").agg(F.first("body").alias("body")), "", f"{path}/chunks")
    by_id = staged.select("uid", "doc_id", "n_tokens", "names").repartitionByRange(F.col("doc_id").asc_nulls_first(), "uid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "uid")
    recipes = stored(by_id.mapInArrow(ordered, "part long, at long, uid long, doc_id long, n_tokens long, start long, names array<binary>, leaf binary"), "", f"{path}/recipes")
    manifest = stored(_roots(recipes), "", f"{path}/manifest")
    stored(_root(spark, manifest), "", f"{path}/root")
    removed(spark, staging)


def _wrong(what: str):
    raise ValueError(f"the store does not verify: {what}")


def _part_roots(batches):
    """One row for each part, whose recipes come together and in order; leaves are computed, not believed."""
    now, leaves, n, out = None, [], 0, []
    for batch in batches:
        for part, at, doc_id, tokens, start, names, own in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now:
                if now is not None:
                    out.append((now, len(leaves), n, merkle_root(leaves)))
                now, leaves, n = part, [], 0
            if at != len(leaves) or start != n or own != leaf(doc_id, tokens, names):
                _wrong(f"recipe {at} of part {part}")
            leaves.append(own)
            n += tokens
    if now is not None:
        out.append((now, len(leaves), n, merkle_root(leaves)))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*out)] or [[]] * 4, kinds)], ["part", "docs", "tokens", "root"])


def _roots(recipes: DataFrame) -> DataFrame:
    """``part, docs, tokens, root`` computed from the recipes."""
    ordered = recipes.select("part", "at", "doc_id", "n_tokens", "start", "names", "leaf").repartition("part").sortWithinPartitions("part", "at")
    return ordered.mapInArrow(_part_roots, "part long, docs long, tokens long, root binary")


def _root(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row for the whole store; a part is a task's output, so parts are few."""
    rows = manifest.orderBy("part").collect()
    whole = merkle_root([hashlib.blake2b(repr((r["part"], r["docs"], r["tokens"])).encode() + bytes(r["root"]), digest_size=16).digest() for r in rows])
    return spark.createDataFrame([(len(rows), sum(r["docs"] for r in rows), sum(r["tokens"] for r in rows), bytearray(whole))], "parts long, docs long, tokens long, root binary")


def _checked(spark: SparkSession, path: str) -> DataFrame:
    """The recipes, each with the ids before its part; what does not verify fails the read."""
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    found = _roots(recipes)
    said = manifest.select("part", *[F.col(c).alias(f"_{c}") for c in ("docs", "tokens", "root")])
    alike = (F.col("docs") == F.col("_docs")) & (F.col("tokens") == F.col("_tokens")) & (F.col("root") == F.col("_root"))
    if not found.join(said, "part", "full").where(~F.coalesce(alike, F.lit(False))).isEmpty():
        _wrong("parts and manifest")
    if [tuple(r) for r in spark.read.parquet(f"{path}/root").collect()] != [tuple(r) for r in _root(spark, manifest).collect()]:
        _wrong("manifest and root")
    before = F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")  # one row a part
    return recipes.join(manifest.select("part", before.alias("before")), "part")


def _digests(wide: bool):
    def run(batches):
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(chunk_id(b) != i for i, b in zip(ids, bodies)):
                _wrong("a chunk")
            crcs = [zlib.crc32(b if wide else np.frombuffer(b, "<u2").astype("<u4").tobytes()) for b in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([len(b) // (4 if wide else 2) for b in bodies], pa.int64()), pa.array(crcs, pa.int64())], ["id", "n", "crc"])

    return run


def _joined(batches):
    joiner = Joiner(4)
    for batch in batches:
        uid, lists = batch.column(0), batch.column(1)
        flat = lists.flatten()
        order, n, crc = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        count = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(count)), count)
        sort = np.lexsort((order, doc))
        n, crc = n[sort], crc[sort].astype(np.uint32)
        total = np.bincount(doc, n, len(count)).astype(np.int64)
        upto = np.cumsum(n)
        after = np.cumsum(total)[doc] - upto
        moved = joiner.shifted(crc, after)
        starts = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        whole = np.bitwise_xor.reduceat(moved, starts) if len(moved) else np.zeros(0, np.uint32)
        yield pa.RecordBatch.from_arrays([uid, pa.array(total), pa.array(whole.astype(np.int64))], ["uid", "read", "ids_crc32"])


def digests(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Per document of the store, from its files: ``doc_id, start, n_tokens, ids_crc32``.

    Bodies are read, checked and digested where they lie; only digests move.
    """
    recipes = _checked(spark, path)
    bodies = spark.read.parquet(f"{path}/chunks").mapInArrow(_digests(wide), "id binary, n long, crc long")
    wanted = spark.read.parquet(f"{path}/recipes").select("uid", F.posexplode("names").alias("k", "id"))
    lists = wanted.join(bodies, "id").groupBy("uid").agg(F.collect_list(F.struct("k", "n", "crc")).alias("c"))
    whole = lists.mapInArrow(_joined, "uid long, read long, ids_crc32 long")
    found = recipes.drop("names", "leaf").join(whole, "uid", "left")
    complete = F.when(F.col("read") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("the store does not verify: a document")).cast("long"))
    return found.select("doc_id", (F.col("before") + F.col("start")).alias("start"), complete.alias("n_tokens"), "ids_crc32")


def read(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """Documents from the store: ``doc_id, start, n_tokens, ids`` with ids as an array."""

    def joined(batches):
        for batch in batches:
            uids, lists = batch.column(0), batch.column(1).to_pylist()
            ids = [np.frombuffer(b"".join(x["body"] for x in sorted(c, key=lambda x: x["k"])), "<u4" if wide else "<u2").astype(np.int64) for c in lists]
            yield pa.RecordBatch.from_arrays([uids, pa.array(ids, pa.list_(pa.int64()))], ["uid", "ids"])

    recipes = _checked(spark, path)
    wanted = spark.read.parquet(f"{path}/recipes").select("uid", F.posexplode("names").alias("k", "id"))
    lists = wanted.join(spark.read.parquet(f"{path}/chunks"), "id").groupBy("uid").agg(F.collect_list(F.struct("k", "body")).alias("c"))
    found = recipes.drop("names", "leaf").join(lists.mapInArrow(joined, "uid long, ids array<long>"), "uid")
    return found.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def op5_store(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(spark, path)
