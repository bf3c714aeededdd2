"""A hidden Markov language model: Baum-Welch training and exact scaled likelihoods.

States emit word classes.  The most frequent words are classes of their own; all
other words, unknown ones too, fall into a fixed number of classes by their last
bytes, and inside such a class a word has its add-one share of training tokens, an
unknown one the share of one.  What every task holds stays bounded: the frequent
words and one row of numbers for each class.  Counts of words beyond the lookup,
which grow with the input, come by a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import bucket
from .storage import stored
from .words import lower_words

#: The end of a text; no word holds white space.
END = b"\n"
#: Words that are classes of their own; words whose counts every task looks up; classes of all other words.
HEAD, LOOKUP, BINS = 20_000, 100_000, 1024
STATES, ROUNDS = 8, 4
#: Classes whose company in documents gives the states' first guess.
ANCHORS = 128
#: Tokens of a longer text whose recursion is held at once; the recursion itself runs through the whole text.
SEGMENT = 100_000
#: Words one task counts before it hands on its counts.
HELD = 300_000


def bin_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BINS


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 2 on division by 7; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _counted(batches):
    seen: Counter = Counter()

    def flush():
        words = [*seen]
        cells = [pa.array(words, pa.binary()), pa.array([bin_of(w) for w in words], pa.int32()), pa.array([seen[w] for w in words], pa.int64())]
        seen.clear()
        return pa.RecordBatch.from_arrays(cells, ["word", "bin", "c"])

    for batch in batches:
        for text in batch.column(0):
            seen.update(lower_words(text.as_py()))
            seen[END] += 1
            if len(seen) > HELD:
                yield flush()
    yield flush()


def vocabulary(texts: DataFrame) -> DataFrame:
    """``word, bin, c`` of all tokens of the column of texts (as binary)."""
    return texts.mapInArrow(_counted, "word binary, bin int, c long").groupBy("word", "bin").agg(F.sum("c").alias("c"))


class Lexicon:
    """What every task knows of the vocabulary: bounded by ``LOOKUP`` words and ``BINS`` classes."""

    def __init__(self, rows: list, bin_totals: dict, tokens: int, types: int, head: int):
        rows = sorted(rows, key=lambda r: (bytes(r["word"]) != END, -r["c"], bytes(r["word"])))
        self.index = {bytes(r["word"]): i for i, r in enumerate(rows)}
        self.head = min(head, len(rows))
        self.count = np.array([r["c"] for r in rows], np.float64)
        self.classes = np.array([i if i < self.head else self.head + r["bin"] for i, r in enumerate(rows)], np.int64)
        self.tokens, self.types = tokens, types
        bins = np.ones(BINS)  # the one is for unknown words
        for b, total in bin_totals.items():
            bins[b] += total
        for i in range(self.head, len(rows)):
            bins[self.classes[i] - self.head] += rows[i]["c"] + 1
        self.log_bins = np.log10(bins)
        self.log_count = np.log10(self.count + 1)

    @property
    def size(self) -> int:
        return self.head + BINS

    def coded(self, text: bytes | None):
        """Classes, and the sums and rare words that a score is made of."""
        words = lower_words(text)
        words.append(END)
        get = self.index.get
        at = np.array([get(w, -1) for w in words], np.int64)
        rare = [(words[i], bin_of(words[i])) for i in np.flatnonzero(at < 0)]
        known = at[at >= 0]
        classes = np.empty(len(at), np.int64)
        classes[at >= 0] = self.classes[known]
        classes[at < 0] = [self.head + b for _, b in rare]
        binned = classes[classes >= self.head] - self.head
        in_head = known < self.head
        logs = self.log_count[known]
        return classes, len(words), len(known), float(logs[in_head].sum()), float(logs[~in_head].sum()), float(self.log_bins[binned].sum()), [w for w, _ in rare]


def lexicon(words: DataFrame, head: int = HEAD, lookup: int = LOOKUP) -> Lexicon:
    """``words``: a stored vocabulary."""
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    is_end = F.col("word") == F.lit(bytearray(END))
    # the least count that no more than ``lookup`` words reach, from counts in log-linear buckets: a few thousand rows
    # at most; of the bucket that holds the limit as many words as fit, by their hashes
    least, share, above = 1, 1.0, 0
    for r in sorted(words.where(~is_end).groupBy(bucket(F.col("c")).alias("c")).count().collect(), key=lambda r: -r["c"]):
        if above + r["count"] > lookup:
            least, share = r["c"], (lookup - above) / r["count"]
            break
        above += r["count"]
    looked_up = (bucket(F.col("c")) > least) | (bucket(F.col("c")) == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = words.where(is_end | looked_up).collect()
    rest = {r["bin"]: r["t"] for r in words.where(~is_end & ~looked_up).groupBy("bin").agg(F.sum(F.col("c") + 1).alias("t")).collect()}
    return Lexicon(rows, rest, total["n"] or 0, total["v"], head)


class Model:
    """Start, transition and emission probabilities; ``emit`` is classes x states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, sequences: list[np.ndarray], keep: bool = False):
        """Natural logs of the likelihoods of sequences sorted by falling length; ``keep`` returns the recursion instead of them."""
        lengths = np.array([len(s) for s in sequences])
        logs, trail, now = np.zeros(len(sequences)), [], None
        padded = np.zeros((lengths[0], len(sequences)), np.int64)
        for i, s in enumerate(sequences):
            padded[: len(s), i] = s
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        each, alive = self.emit[padded] if padded.size <= 1_000_000 else None, alive.tolist()
        for t in range(lengths[0]):
            n = alive[t]
            e = each[t, :n] if each is not None else self.emit[padded[t, :n]]
            now = (self.start if t == 0 else now[:n] @ self.move) * e
            scale = now.sum(1)
            now /= scale[:, None]
            if keep:
                trail.append((now, scale, e))
            else:
                logs[:n] += np.log(scale)
        return (logs, trail, padded, alive) if keep else logs

    def expected(self, sequences: list[np.ndarray]):
        """Expected counts of starts, moves and emissions over sequences sorted by falling length."""
        _, trail, padded, alive = self.forward(sequences, keep=True)
        states, gammas, classes = len(self.start), [], []
        moves, back = np.zeros((states, states)), None
        for t in range(len(trail) - 1, -1, -1):
            now, _, _ = trail[t]
            beta = np.ones((alive[t], states))
            if back is not None:
                nxt, scale, e = trail[t + 1]
                ahead = e * back / scale[:, None]
                moves += now[: len(ahead)].T @ ahead
                beta[: len(ahead)] = ahead @ self.move.T
            back = beta
            gammas.append(now * beta)
            classes.append(padded[t, : alive[t]])
        gamma, flat = np.concatenate(gammas), np.concatenate(classes)
        emit = np.stack([np.bincount(flat, gamma[:, k], len(self.emit)) for k in range(states)], 1)
        return gammas[-1].sum(0), moves * self.move, emit


    def expected_long(self, sequence: np.ndarray, step: int = SEGMENT):
        """``expected`` of one sequence, holding ``step`` tokens of the recursion at a time.

        The forward recursion keeps its state before each piece; pieces are then taken from
        the last on, each run forward again and back with what came after it.
        """
        states = len(self.start)
        pieces = [sequence[i : i + step] for i in range(0, len(sequence), step)]

        def forward(piece, before):
            now, scale, e = np.empty((len(piece), states)), np.empty(len(piece)), self.emit[piece]
            for t in range(len(piece)):
                now[t] = (self.start if before is None else before @ self.move) * e[t]
                scale[t] = now[t].sum()
                before = now[t] = now[t] / scale[t]
            return now, scale, e

        entries, before = [], None
        for piece in pieces:
            entries.append(before)
            before = forward(piece, before)[0][-1]
        moves, emit, ahead = np.zeros((states, states)), np.zeros_like(self.emit), None
        for piece, before in zip(reversed(pieces), reversed(entries)):
            now, scale, e = forward(piece, before)
            for t in range(len(piece) - 1, -1, -1):
                if ahead is not None:
                    moves += np.outer(now[t], ahead)
                beta = self.move @ ahead if ahead is not None else np.ones(states)
                gamma = now[t] * beta
                emit[piece[t]] += gamma
                ahead = e[t] * beta / scale[t]
        return gamma, moves * self.move, emit


def groups(sequences: list[np.ndarray], most: int = 256, cells: int = 400_000):
    """Indexes of sequences in groups sorted by falling length, so that a group's recursion runs at once."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        n = max(1, min(most, cells // max(1, len(sequences[order[at]]))))
        yield order[at : at + n]
        at += n


def _classes(column) -> list[np.ndarray]:
    return [np.frombuffer(c.as_py(), "<u2").astype(np.int64) for c in column]


def _first_guess(coded: DataFrame, lex: Lexicon, states: int) -> Model:
    """Frequent words that share documents start in one state."""
    anchors, size = min(ANCHORS, lex.head), lex.size
    base = np.ones(size)
    base[: lex.head] += lex.count[: lex.head]
    for i in range(lex.head, len(lex.count)):
        base[lex.classes[i]] += lex.count[i]
    base[lex.head :] += 10.0 ** lex.log_bins
    base /= base.sum()

    def together(batches):
        total = np.zeros((anchors, anchors), np.int64)
        for batch in batches:
            has = np.zeros((batch.num_rows, anchors), np.float32)
            for i, c in enumerate(_classes(batch.column(0))):
                has[i, np.unique(c[c < anchors])] = 1
            total += (has.T @ has).astype(np.int64)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    seen = np.zeros(anchors * anchors)
    for r in coded.select("classes").mapInArrow(together, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        seen[r["at"]] = r["n"]
    seen = seen.reshape(anchors, anchors)
    own = np.sqrt(np.maximum(np.diag(seen), 1))
    near = seen / own[:, None] / own[None, :]
    near -= near.mean(0)
    near /= np.maximum(np.linalg.norm(near, axis=1), 1e-12)[:, None]
    picked = [int(np.argmax(np.diag(seen)))]
    while len(picked) < min(states, anchors):
        picked.append(int(np.argmin((near @ near[picked].T).max(1))))
    centers = near[picked]
    for _ in range(10):
        cluster = (near @ centers.T).argmax(1)
        centers = np.stack([near[cluster == k].mean(0) if (cluster == k).any() else centers[k] for k in range(len(picked))])
    emit = np.repeat(base[:, None], states, 1)
    for k in range(states):
        emit[:anchors, k] *= np.where(cluster == k, 5.0, 0.2) if k < len(picked) else 1.0
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def _trained(coded: DataFrame, lex: Lexicon, states: int, rounds: int) -> Model:
    spark = coded.sparkSession
    if not lex.head:  # nothing to learn from
        return Model(np.full(states, 1 / states), np.full((states, states), 1 / states), np.full((lex.size, states), 1 / lex.size))
    model, size = _first_guess(coded, lex, states), lex.size
    base = model.emit.mean(1, keepdims=True)
    names = [f"g{k}" for k in range(states)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # classes x states numbers: at most HEAD + BINS rows

        def counts(batches, shared=shared):
            own, start, moves, emit = shared.value, np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
            for batch in batches:
                found = _classes(batch.column(0))
                for c in found:
                    if len(c) > SEGMENT:
                        s, m, e = own.expected_long(c)
                        start, moves, emit = start + s, moves + m, emit + e
                parts = [c for c in found if len(c) <= SEGMENT]
                for group in groups(parts):
                    s, m, e = own.expected([parts[i] for i in group])
                    start, moves, emit = start + s, moves + m, emit + e
            table = np.concatenate([start[None], moves, emit])
            at = np.flatnonzero(table.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(table[at, k]) for k in range(states)]], ["at", *names])

        schema = "at long, " + ", ".join(f"{n} double" for n in names)
        summed = coded.select("classes").mapInArrow(counts, schema).groupBy("at").agg(*[F.sum(n).alias(n) for n in names])
        table = np.zeros((1 + states + size, states))
        for r in summed.collect():  # at most 1 + states + HEAD + BINS rows
            table[r["at"]] = [r[n] for n in names]
        start, moves, emit = table[0] + 1, table[1 : 1 + states] + 0.1, table[1 + states :] + 100 * base
        model = Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, lookup: int = LOOKUP) -> DataFrame:
    """Base and model score of every row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows that are not held out.  A null or empty text is its end
    alone; a null id is not held out; repeated rows are learnt and scored each; an
    empty table gives none.  Texts are learnt and scored whole, however long; words that
    are as frequent are told apart by their hashes; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    words = stored(vocabulary(source.where("not held_out").select("text")), "words")
    lex = lexicon(words, head, lookup)
    shared = spark.sparkContext.broadcast(lex)  # at most LOOKUP words
    names = ["classes", "n_tokens", "known", "s_head", "s_binned", "s_bins", "rare"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]

    def code(batches):
        from pyspark import TaskContext

        lex, uid = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [lex.coded(t.as_py()) for t in part.column(2)]
                rows = [(r[0].astype("<u2").tobytes(), *r[1:]) for r in rows]
                uids = pa.array(range(uid, uid + len(rows)), pa.int64())
                uid += len(rows)
                yield pa.RecordBatch.from_arrays([uids, part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], ["uid", "doc_id", "held_out", *names])

    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("classes", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in names[1:3]], *[T.StructField(n, T.DoubleType()) for n in names[3:6]], T.StructField("rare", T.ArrayType(T.BinaryType()))])
    coded = stored(source.mapInArrow(code, schema), "coded")
    model = _trained(coded.where("not held_out"), lex, states, rounds)
    model_shared = spark.sparkContext.broadcast(model)

    def likelihoods(batches):
        for batch in batches:
            parts = _classes(batch.column(batch.schema.get_field_index("classes")))
            out = np.zeros(len(parts))
            for group in groups(parts):
                out[group] = model_shared.value.forward([parts[i] for i in group])
            keep = [batch.column(batch.schema.get_field_index(n)) for n in ("uid", "doc_id", "held_out", *names[1:6])]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out / math.log(10))], ["uid", "doc_id", "held_out", *names[1:6], "hmm"])

    scored = coded.drop("rare").mapInArrow(likelihoods, T.StructType([f for f in schema if f.name not in ("classes", "rare")] + [T.StructField("hmm", T.DoubleType())]))
    rare = coded.select("uid", F.explode("rare").alias("word")).groupBy("uid", "word").agg(F.count("*").alias("n"))
    rare = rare.join(words.select("word", "c"), "word", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("s_rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("k_rare"))
    found = scored.join(rare, "uid", "left").withColumn("s_rare", F.coalesce("s_rare", F.lit(0.0)))
    base = F.col("s_head") + F.col("s_binned") + F.col("s_rare") - F.col("n_tokens") * F.lit(math.log10(lex.tokens + lex.types + 1))
    return found.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k_rare", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("hmm") + F.col("s_binned") + F.col("s_rare") - F.col("s_bins")).alias("score"))


def op10_hmm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
