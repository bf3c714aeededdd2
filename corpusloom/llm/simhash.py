"""SimHash near-duplicates of documents, found by pigeonring filtering.

A fingerprint of 64 bits is a ring of four segments of 16.  If two differ in at
most three bits, then from some segment on the differences of the first 1, 2, 3
and 4 segments of the ring are at most 0, 1, 2 and 3: a chain within proportional
budgets.  Candidates share the first segment of such a chain and three of the
four quarters of the second; the chain and then the full distance are checked.

Equal fingerprints are one node.  Inside a group of candidates links are found
by bit operations on blocks and only a spanning forest of them leaves the task,
so copies in any number cost rows in proportion.  Groups above a size are dealt
as pairs of chunks to as many tasks as it takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, joined_components
from .storage import new_path, removed, stored
from .words import lower_words

#: Fingerprints of one group that one task compares at once.
CHUNK = 4096
#: For copies of a similarity: least shingle hashes by which a document is found, and differing bits it may have before it is verified.
KEYS, NEAR_BITS = 6, 24


def _shingles(found: list[bytes], shingle: int) -> list[bytes]:
    if not found:
        return []
    if len(found) <= shingle:
        return [b" ".join(found)]
    return [b" ".join(s) for s in zip(*(found[i:] for i in range(shingle)))]


def _majority(hashes: list[int]) -> int:
    """Bits set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):  # memory of the bit matrix stays bounded for texts of any length
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned; a bit is set if over half of the shingles' XXH64 have it; without words zero."""
    digest = xxhash.xxh64_intdigest
    return _majority([digest(s, seed) for s in _shingles(lower_words(text), shingle)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` with ``fp`` the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _keys(fp):
    """16 keys of a fingerprint: the chain's first segment, and its second without one quarter."""
    keys = []
    for i in range(4):
        head = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
        follow = F.shiftrightunsigned(fp, 16 * ((i + 1) % 4)).bitwiseAND(F.lit(0xFFFF))
        for q in range(4):
            kept = follow.bitwiseAND(F.lit(0xFFFF & ~(0xF << (4 * q))))
            keys.append(F.shiftleft(F.lit(4 * i + q).cast("long"), 32).bitwiseOR(F.shiftleft(head, 16)).bitwiseOR(kept))
    return F.array(*keys)


def chain_within(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether the differing bits ``x`` keep the chain's budgets 0, 1, 2, 3 from segment ``start`` on."""
    ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.uint8)
    for k in range(4):
        total = total + np.bitwise_count((x >> np.uint64(16 * ((start + k) % 4))) & np.uint64(0xFFFF)).astype(np.uint8)
        ok &= total <= k
    return ok


def _linked(a: np.ndarray, b: np.ndarray, start: int, most: int) -> np.ndarray:
    """Boolean matrix of links between two sets of fingerprints, in blocks of rows."""
    out = np.empty((len(a), len(b)), bool)
    for at in range(0, len(a), 256):
        x = a[at : at + 256, None] ^ b[None, :]
        ok = chain_within(x, start)
        out[at : at + 256] = ok
        rows, cols = np.nonzero(ok)
        out[at + rows, cols] = np.bitwise_count(x[rows, cols]) <= most
    return out


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric boolean matrix as (node, root of its tree)."""
    todo, out = links.any(1), []
    for root in range(len(links)):
        if not todo[root]:
            continue
        todo[root], front = False, np.array([root])
        while len(front):
            new = links[front].any(0) & todo
            todo &= ~new
            front = np.nonzero(new)[0]
            out += [(int(v), root) for v in front]
    return out


def _group_links(fps: np.ndarray, side: np.ndarray, start: int, most: int):
    """Links that span what is linked among ``fps``; across the two sides only, if both are there."""
    if side.any() and not side.all():
        a, b = fps[~side], fps[side]
        across = _linked(a, b, start, most)
        links = np.zeros((len(fps), len(fps)), bool)
        links[: len(a), len(a) :] = across
        links[len(a) :, : len(a)] = across.T
        fps = np.concatenate([a, b])
    elif len(fps) == 2:
        x = fps[:1] ^ fps[1:]
        return [(fps[0], fps[1])] if chain_within(x, start)[0] and np.bitwise_count(x[0]) <= most else []
    else:
        links = _linked(fps, fps, start, most)
        np.fill_diagonal(links, False)
    return [(fps[v], fps[r]) for v, r in _forest(links)]


def _search(most: int):
    def run(batches):
        kept: list[np.ndarray] | None = None  # rows of the last, perhaps unfinished group
        out: list[tuple] = []

        def groups(columns):
            key, p, q, side, fp = columns
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            edges = np.concatenate([[0], new, [len(key)]])
            for lo, hi in zip(edges[:-1][np.diff(edges) > 1], edges[1:][np.diff(edges) > 1]):
                f = fp[lo:hi].view(np.uint64)
                for a, b in _group_links(f, side[lo:hi].astype(bool) & (p[lo] != q[lo]), int(key[lo] >> 32) // 4, most):
                    out.append((a, b))

        def flush():
            a, b = (np.array([x[i] for x in out], np.uint64).view(np.int64) for i in (0, 1))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if kept is not None:
                columns = [np.concatenate([k, c]) for k, c in zip(kept, columns)]
            key, p, q = columns[:3]
            same = (key == key[-1]) & (p == p[-1]) & (q == q[-1])
            cut = len(key) - int(same[::-1].argmin()) if not same.all() else 0
            kept = [c[cut:] for c in columns]
            if cut:
                groups([c[:cut] for c in columns])
            if len(out) > 50_000:
                yield flush()
        if kept is not None:
            groups(kept)
        yield flush()

    return run


def links(fps: DataFrame, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links that span the classes of the distinct fingerprints in column ``fp``."""
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("long").alias("n"))
    dealt = keyed.join(large, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"), (F.col("c") > F.col("o")).cast("int").alias("side"), "fp")
    dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.mapInArrow(_search(most), "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``most``
    differing bits, its own included.  Null and empty texts have fingerprint zero
    and are linked like any other.  Rows that repeat an id come back each; a null id
    takes part as a row, and ``component_id`` is null only if no row of its class has
    an id.  An empty table gives none.  Other columns are ignored.
    """
    own = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes.select("fp"), most, chunk), "a", "b")
    rooted = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(classes, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int = 3) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id, once.

    Rows without an id cannot be named and stay as they are.
    """
    classes = near_duplicates(docs, id_col, text_col, shingle, most)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    once = named.join(kept, F.col(id_col).cast("long") == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    return once.unionByName(docs.where(F.col(id_col).isNull()))


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id, t, node, fp, n, keys``: equal sets of shingles are one node; the keys are the set's least hashes."""

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            nodes, fps, sizes, keys = [], [], [], []
            for t in batch.column(1):
                hashes = [digest(s, 42) for s in _shingles(lower_words(t.as_py()), shingle)]
                each = np.unique(np.array(hashes, np.uint64))
                nodes.append(xxhash.xxh64_intdigest(each.tobytes()))
                fps.append(_majority(hashes))
                sizes.append(len(each))
                keys.append(each[:KEYS].view(np.int64))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *longs, pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t", "node", "fp", "n", "keys"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return own.mapInArrow(run, "doc_id long, t binary, node long, fp long, n int, keys array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similar: float) -> DataFrame:
    """The pairs ``a, b`` whose sets of shingles have a Jaccard similarity of ``similar`` or more."""

    def run(batches):
        for batch in batches:
            kept, last, x = [], None, set()
            for i, (s, t) in enumerate(zip(batch.column(2), batch.column(3))):
                s = s.as_py()
                if s != last:
                    last, x = s, set(_shingles(lower_words(s), shingle))
                y = set(_shingles(lower_words(t.as_py()), shingle))
                both = len(x & y)
                if both >= similar * (len(x) + len(y) - both) - 1e-9:
                    kept.append(i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("s")), "a").join(texts.select(F.col("node").alias("b"), "t"), "b")
    return met.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def _ring(nodes: DataFrame, most: int) -> DataFrame:
    """``a, b``: links that span the nodes whose SimHashes ``links`` joins; nodes of one SimHash are tied to the least of them."""
    nodes = nodes.select("node", "fp")
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    side = lambda c: least.select(F.col("fp").alias(f"fp_{c}"), F.col("least").alias(c))
    between = links(least.select("fp"), most).withColumnsRenamed({"a": "fp_a", "b": "fp_b"})
    between = between.join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "b")
    same = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return between.unionByName(same).distinct()


def _rarest(nodes: DataFrame, texts: DataFrame, shingle: int, similar: float) -> DataFrame:
    """``nodes`` (with ``node, n``) by ``h``, their rarest shingle hashes among them, with ``at``, its place from the rarest on.

    Of sets ordered alike, two of a similarity of ``similar`` share one of the first ``n - similar * n + 1``
    hashes of each.  Rarest first, a passage that many sets have comes last.  Hashes of one set only are left out.
    """

    def run(batches):
        for batch in batches:
            for node, t in zip(batch.column(0), batch.column(1)):
                each = np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in _shingles(lower_words(t.as_py()), shingle)], np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), node.as_py(), np.int64)), pa.array(each.view(np.int64))], ["node", "h"])

    spark = nodes.sparkSession
    path = new_path(spark, "sketch-hashes")
    each = stored(texts.join(nodes.select("node"), "node", "left_semi").select("node", "t").mapInArrow(run, "node long, h long"), "sketch-hashes", path)
    several = each.groupBy("h").agg(F.count("*").alias("holders")).where("holders > 1")
    own = Window.partitionBy("node")
    shared = each.join(several, "h").withColumn("i", F.row_number().over(own.orderBy("holders", "h"))).withColumn("of", F.count("*").over(own))
    # hashes of one set only come before all these
    first = shared.join(nodes, "node").withColumn("at", F.col("n") - F.col("of") + F.col("i") - 1).where(F.col("at") <= F.col("n") - F.ceil(similar * F.col("n") - 1e-9))
    first = stored(first.select("h", "at", *nodes.columns), "sketch-rarest")
    removed(spark, path)
    return first


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: float = 0.8, most: int = NEAR_BITS, ring: int = 3) -> DataFrame:
    """``docs`` with one document of each class of copies of Jaccard similarity ``similar`` on shingles: that with the smallest id, once.

    SimHashes that differ in ``ring`` bits or fewer are found by pigeonring filtering, as
    in ``near_duplicates``, and those links are verified on their shingles.  Three bits don't
    reach that similarity, which needs some 10 of 64, and segments
    don't sieve for so many; so further candidates share one of their ``KEYS`` least shingle hashes
    (of two sets of similarity 0.8 all but about 0.2 ** KEYS do), differ in at most
    ``most`` bits and are verified on their shingles.  Sets that share a hash and are apart after
    a first search meet by their rarest hashes, so a passage in many documents makes no pairs of all of them.
    Rows without an id cannot be named and stay as they are.
    """
    named = docs.where(F.col(id_col).isNotNull())
    spark = docs.sparkSession
    at_own, at_keys, at_ring, at_parts = (new_path(spark, f"sketch-{n}") for n in ("texts", "keys", "ring", "parts"))
    own = stored(_sketches(named, id_col, text_col, shingle), "sketches", at_own)
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.first(F.struct("fp", "n", "keys")).alias("s")).select("node", "least", "s.*")
    nodes = stored(nodes, "sketch-nodes")
    keyed = nodes.select("node", "fp", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("node", "fp", "n")).alias("lead"), F.count("*").alias("holders")).where("holders > 1")
    keyed = stored(keyed.join(shared.select("key", "lead"), "key"), "sketch-keys", at_keys)
    alike = stored(_ring(nodes, ring), "sketch-ring", at_ring)
    asked = keyed.select("node").unionByName(alike.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = own.join(asked, "node", "left_semi").groupBy("node").agg(F.first("t").alias("t"))
    able = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= most) & (F.least("n", "n2") >= similar * F.greatest("n", "n2") - 1e-9)
    # every node with the first of each of its groups; then every pair that is still apart and shares one of its rarest hashes
    led = keyed.select("node", "fp", "n", *[F.col(f"lead.{c}").alias(f"{c}2") for c in ("node", "fp", "n")]).where("node <> node2").where(able)
    led = alike.unionByName(led.select(F.col("node2").alias("a"), F.col("node").alias("b"))).distinct()
    led = stored(_verified(led, texts, shingle, similar), "sketch-led")
    classes = components(led, "a", "b")
    part = keyed.join(classes, "node", "left").select("key", "node", "fp", "n", F.coalesce("root", "node").alias("comp"))
    part = stored(part, "sketch-parts", at_parts)
    split = part.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    part = part.join(split, "key", "left_semi").select("node", "fp", "n", "comp").distinct()
    part = _rarest(part, texts, shingle, similar)
    other = part.select("h", *[F.col(c).alias(f"{c}2") for c in ("at", "node", "fp", "n", "comp")])
    # at the first hash in common those from there on are all that two sets may share
    enough = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= similar / (1 + similar) * (F.col("n") + F.col("n2")) - 1e-9
    apart = part.join(other, "h").where((F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")) & enough & able)
    more = _verified(apart.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct(), texts, shingle, similar)
    found = joined_components(classes, more, "a", "b").withColumnRenamed("node", "b")
    removed(spark, at_own, at_keys, at_ring, at_parts)
    rooted = nodes.select("node", "least").join(found, F.col("node") == F.col("b"), "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("__kept")).select("__kept").distinct()
    once = named.join(kept, F.col(id_col).cast("long") == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    return once.unionByName(docs.where(F.col(id_col).isNull()))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
