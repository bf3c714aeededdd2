"""Approximate nearest neighbours by additive quantisation.

Codebooks of full-dimensional vectors are fitted to the residuals of a bounded
sample.  Every vector is encoded by beam search as a sum of one entry of each
codebook, and the norm of that sum is stored.  A query scores codes by lookup
tables of its products with all entries, and the best are ranked again by exact
distances of the original vectors.

Vectors lie in cells, by the nearest entry of the first codebook; a query visits so
many of its nearest cells as held the neighbours of the sample's own queries, and more
until they hold a shortlist; this is one rule for tables of all sizes.  Codes
move once, to their cell; large cells are dealt to parts.  A task holds one block of
queries and reads one block of codes at a time, so memory is bounded by their sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored

#: Rows that the codebooks are fitted on, at most, and those of them that are asked for their neighbours' cells.
SAMPLE, ASKED = 32_768, 512
#: Share of the sample's neighbours whose cells must be visited, and how many more cells are.
FOUND, MORE = 0.98, 1.25
#: Scores that a task holds for its queries before it gives them out.
HELD = 8_000_000


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite and one of them not zero."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = (centers * centers).sum(1)
    return np.concatenate([(squares - 2 * part @ centers.T).argmin(1) for part in np.array_split(x, len(x) // 4096 + 1)])


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 5) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        best = _nearest(x, centers)
        n = np.bincount(best, minlength=len(centers))
        total = np.stack([np.bincount(best, x[:, d], len(centers)) for d in range(x.shape[1])], 1)
        centers[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        centers[empty] = x[rng.choice(len(x), len(empty))]
    return centers


class Codebooks:
    """``books``: codebooks x entries x dimensions."""

    def __init__(self, books: np.ndarray):
        self.books = books
        self.flat = books.reshape(-1, books.shape[2])
        self.squares = (self.flat**2).sum(1).reshape(books.shape[:2])

    @classmethod
    def fitted(cls, sample: np.ndarray, count: int, entries: int, seed: int = 7) -> Codebooks:
        """K-means of the sample, then of its residuals, and so on."""
        rng, rest, books = np.random.default_rng(seed), sample.copy(), []
        entries = min(entries, len(sample))
        for _ in range(count):
            book = _kmeans(rest, entries, rng)
            rest = rest - book[_nearest(rest, book)]
            books.append(book)
        return cls(np.stack(books))

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x codebooks) and squared norms of their sums, by beam search."""
        codes, norms = [], []
        for part in np.array_split(x, len(x) // 1024 + 1):
            c, n = self._encode(part, beam)
            codes.append(c)
            norms.append(n)
        return np.concatenate(codes), np.concatenate(norms)

    def _encode(self, x, beam):
        count, entries, width = self.books.shape
        at = np.arange(len(x))[:, None]
        rest, size, chosen = x[:, None, :], (x * x).sum(1)[:, None], np.zeros((len(x), 1, 0), np.int64)
        for m in range(count):
            new = size[:, :, None] - 2 * (rest.reshape(-1, width) @ self.books[m].T).reshape(len(x), -1, entries) + self.squares[m]
            flat = new.reshape(len(x), -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, entry = best // entries, best % entries
            size = np.take_along_axis(flat, best, 1)
            rest = rest[at, parent] - self.books[m][entry]
            chosen = np.concatenate([chosen[at, parent], entry[:, :, None]], 2)
        first = size.argmin(1)[:, None]
        total = x - rest[at, first][:, 0]
        return chosen[at, first][:, 0].astype(np.uint16), (total * total).sum(1)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cells_by_distance(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Numbers of all cells for each row, nearest first."""
    return np.argsort((centers * centers).sum(1) - 2 * x @ centers.T, axis=1, kind="stable")


def cells_to_visit(sample: np.ndarray, centers: np.ndarray, k: int) -> int:
    """Cells that hold ``FOUND`` of the ``k`` nearest in the sample of its first rows, and ``MORE``; in all the data, which is denser, neighbours are nearer."""
    asked = sample[:ASKED]
    gaps = (sample * sample).sum(1) - 2 * asked @ sample.T
    gaps[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centers)
    near = np.argpartition(gaps, k - 1, axis=1)[:, :k]
    place = np.argsort(cells_by_distance(asked, centers), axis=1)
    ranks = np.take_along_axis(place, _nearest(sample, centers)[near], 1)
    return int(min(len(centers), np.ceil(MORE * (np.quantile(ranks, FOUND) + 1))))


def _encoded(vectors: DataFrame, books: Codebooks, beam: int, block: int) -> DataFrame:
    """One row for each cell of a block of vectors: ``cell, n, ids, codes, norms``, the last three as binaries."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                codes, norms = books.encode(x, beam)
                cell = _nearest(x, books.books[0])
                rows = []
                for c in np.unique(cell).tolist():
                    own = np.flatnonzero(cell == c)
                    rows.append((c, len(own), ids[own].astype("<i8").tobytes(), codes[own].astype("<u2").tobytes(), norms[own].astype("<f4").tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["cell", "n", "ids", "codes", "norms"])

    return vectors.mapInArrow(run, "cell long, n long, ids binary, codes binary, norms binary")


def cells_of(x: np.ndarray, centers: np.ndarray, visits: int, held: np.ndarray, least: int) -> list[np.ndarray]:
    """The cells that each row visits, nearest first: ``visits`` of them and as many more as it takes to hold ``least`` vectors besides the row's own, or all."""
    if not len(x):
        return []
    cells = cells_by_distance(x, centers)
    upto = (np.cumsum(held[cells], 1) <= least).sum(1) + 1
    return [c[: max(visits, n)] for c, n in zip(cells.astype(np.int64), upto)]


def _query_blocks(queries: DataFrame, centers: np.ndarray, visits: int, held: np.ndarray, least: int, size: int, parts: DataFrame) -> DataFrame:
    """``cell, part, qids, qvectors``: at most ``size`` queries a row, once for each part of each cell they visit (``cells_of``)."""

    def visited(batches):
        for batch in batches:
            cells = cells_of(_matrix(batch.column(1)), centers, visits, held, least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], ["id", "vector", "cells"])

    def packed(batches):
        key, ids, vectors = None, [], []

        def row():
            cells = [np.array(ids, "<i8").tobytes(), np.array(vectors, "<f8").tobytes()]
            ids.clear(), vectors.clear()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], ["cell", "part", "qids", "qvectors"])

        for batch in batches:
            for own, i, v in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist(), _matrix(batch.column(3))):
                if ids and (own != key or len(ids) >= size):
                    yield row()
                key = own
                ids.append(i)
                vectors.append(v)
        if ids:
            yield row()

    asked = queries.select("id", "vector").mapInArrow(visited, "id long, vector array<double>, cells array<long>")
    asked = asked.select("id", "vector", F.explode("cells").alias("cell")).join(parts, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "vector")
    return asked.repartition("cell", "part").sortWithinPartitions("cell", "part", "id").mapInArrow(packed, "cell long, part long, qids binary, qvectors binary")


class _Shortlists:
    """The best codes so far of one block of queries."""

    def __init__(self, books: Codebooks, short: int, qids: bytes, qvectors: bytes):
        self.books, self.short, self.key = books, short, qids
        self.asked = np.frombuffer(qids, "<i8")
        x = np.frombuffer(qvectors, "<f8").reshape(len(self.asked), -1)
        self.tables = (-2 * x @ books.flat.T).astype(np.float32).reshape(len(x), *books.books.shape[:2])
        self.ids, self.scores = np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0), np.float32)

    def add(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray):
        score = np.repeat(norms[None, :], len(self.asked), 0)
        for m in range(codes.shape[1]):
            score += self.tables[:, m][:, codes[:, m]]
        score[self.asked[:, None] == ids[None, :]] = np.inf
        score = np.concatenate([self.scores, score], 1)
        all_ids = np.concatenate([self.ids, np.repeat(ids[None, :], len(self.asked), 0)], 1)
        if score.shape[1] > self.short:
            best = np.argpartition(score, self.short - 1, axis=1)[:, : self.short]
            score, all_ids = np.take_along_axis(score, best, 1), np.take_along_axis(all_ids, best, 1)
        self.scores, self.ids = score, all_ids


class _Found:
    """The best codes of each query over all cells that a task has read, ties to smaller ids."""

    def __init__(self, short: int):
        self.short, self.count, self.best = short, 0, {}

    def add(self, block: _Shortlists):
        for q, ids, scores in zip(block.asked.tolist(), block.ids, block.scores):
            ok = np.isfinite(scores)
            own = self.best.setdefault(q, [])
            own.append((ids[ok], scores[ok]))
            self.count += len(own[-1][0])
            if sum(len(i) for i, _ in own) >= 4 * self.short:
                self.best[q] = [self._least(q)]

    def _least(self, q: int):
        ids, scores = (np.concatenate(c) for c in zip(*self.best[q]))
        if len(ids) > self.short:
            self.count -= len(ids) - self.short
            first = np.lexsort((ids, scores))[: self.short]
            ids, scores = ids[first], scores[first]
        return ids, scores

    def rows(self):
        """All that is held, which is then forgotten."""
        asked = list(self.best)
        for at in range(0, len(asked), 64):
            found = [self._least(q) for q in asked[at : at + 64]]
            q = np.repeat(np.array(asked[at : at + 64], np.int64), [len(i) for i, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([x for _, x in found]))], ["query_id", "vec_id", "approx"])
        self.count, self.best = 0, {}


def _scored(books: Codebooks, short: int, block: int):
    """Blocks of queries against blocks of codes; rows that follow each other with the same queries share a shortlist, and their codes are scored together.

    A task gives out one shortlist a query, of all the cells that it reads; only where its queries'
    scores exceed ``HELD`` are they given out before.
    """

    def run(batches):
        now, held, count, found = None, [], 0, _Found(short)

        def add():
            ids = np.concatenate([np.frombuffer(h[0], "<i8") for h in held])
            now.add(ids, np.frombuffer(b"".join(h[1] for h in held), "<u2").reshape(len(ids), -1), np.frombuffer(b"".join(h[2] for h in held), "<f4"))
            held.clear()

        for batch in batches:
            cells = {n: batch.column(batch.schema.get_field_index(n)) for n in ("qids", "qvectors", "ids", "codes", "norms")}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in cells.items()}
                if now is None or now.key != row["qids"]:
                    if now is not None:
                        if held:
                            add()
                        found.add(now)
                        if found.count > HELD:
                            yield from found.rows()
                    now, count = _Shortlists(books, short, row["qids"], row["qvectors"]), 0
                held.append((row["ids"], row["codes"], row["norms"]))
                count += len(row["ids"]) // 8
                if count >= block:
                    add()
                    held, count = [], 0
        if now is not None:
            if held:
                add()
            found.add(now)
            yield from found.rows()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", codebooks: int = 16, entries: int = 256, beam: int = 8, shortlist: int = 1000, sample: int = SAMPLE, block: int = 4096, query_block: int = 1024, part: int = 100_000) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by Euclidean distance, nearest first.

    ``vectors`` and ``queries`` have an id and an array.  A query's own id is no
    candidate; ties go to the smaller id.  Vectors that are null, empty, zero or hold
    null or non-finite components, rows without an id, and arrays of another length
    than most take no part (of lengths as frequent the least counts).  Ids that repeat
    count once, by the vector of the least hash.  Other columns, whatever their names,
    are ignored.  Empty tables give no rows; with fewer candidates than ``k`` all are
    returned.  Codebooks and the number of cells to visit
    are fitted on at most ``sample`` rows; everything else covers all.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    own, asked = plain(vectors), plain(queries)
    facts = own.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if facts is None:
        return spark.createDataFrame([], schema)
    own, asked = (df.where(F.size("vector") == facts["d"]) for df in (own, asked))
    picked = own.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000.0 * sample / facts["count"]))).limit(sample)
    rows = sorted(picked.collect(), key=lambda r: r["id"])
    if not rows:
        rows = own.limit(sample).collect()
    fitted = np.array([r["vector"] for r in rows], np.float64)
    books = Codebooks.fitted(fitted, codebooks, entries)
    centers = books.books[0]
    visits = cells_to_visit(fitted, centers, k)
    own, asked = _once(own), _once(asked)
    coded = stored(_encoded(own, books, beam, block), "codes")
    cells = stored(coded.groupBy("cell").agg(F.sum("n").alias("n"), F.ceil(F.sum("n") / part).cast("long").alias("parts")), "cells")  # a row a cell
    held, parts = np.zeros(len(centers), np.int64), cells.select("cell", "parts")
    for r in cells.collect():
        held[r["cell"]] = r["n"]
    tables = _query_blocks(asked, centers, visits, held, shortlist, query_block, parts)
    dealt = coded.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts"))).select("cell", "part", "ids", "codes", "norms")
    met = tables.join(dealt, ["cell", "part"])
    found = met.mapInArrow(_scored(books, shortlist, block), "query_id long, vec_id long, approx float")
    found = _best(found, "approx", shortlist)
    exact = found.join(own.select(F.col("id").alias("vec_id"), F.col("vector").alias("v")), "vec_id")
    exact = exact.join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    gap = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    ranked = _best(exact.select("query_id", "vec_id", F.sqrt(gap).alias("score")), "score", k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _once(rows: DataFrame) -> DataFrame:
    """``id, vector``, one row an id: the same one wherever this is asked; only ids that repeat go through an aggregation."""
    several = rows.groupBy("id").count().where("count > 1").select("id")
    if several.isEmpty():
        return rows
    once = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    return rows.join(several, "id", "left_anti").unionByName(once)


def _best(found: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` least of each query; Spark keeps the ``k`` of every task before the exchange."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(by, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op2_additive(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
