"""Scoring by a hidden Markov language model.

Tokens are the lower-cased words of a text and one end token.  A latent state emits a class of words
(a hash of the word; the end and unknown words have classes of their own), and the word is
drawn from its class by the smoothed counts of the corpus:

    P(word | state) = E[state, class] * p(word) / p(class),    p(word) = (c + 1) / (N + V + 1)

so that the states, of bounded size, hold what context tells, and the counts, which grow with the
corpus, what the word is.  The probabilities of all V known tokens and one unknown sum to 1.

Counts come from all training texts: N, V and c by a word count, transitions and emissions by
Baum-Welch, whose expected counts every task sums over its own texts before they are added
up.  A text's likelihood is exact: the forward recursion, scaled at every token, over all its
tokens.

Word counts reach the texts in blocks: a block of some thousand documents asks for its distinct words
once, so the vocabulary is never sent anywhere whole.  Words are told apart by a 64-bit hash.

Edge cases: null and empty texts are one end token; repeated rows are scored and learned from each;
without training rows N and V are 0, the states are uniform and every token is unknown; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versify.llm.common import doc_bytes, fold_ascii, keep, span_hashes, table, word_spans

STATES = 6
CLASSES = 1 << 12
END, UNKNOWN = CLASSES, CLASSES + 1
ROUNDS = 4
#: Characters of a block of documents, tokens that a task gathers, texts whose recursions run side by side.
BLOCK_CHARS = 12_000_000
GATHER = 2_000_000
TOGETHER = 4_096
#: Positions whose states Baum-Welch holds at once.
HELD = 1 << 19
#: Fixed value: the end token's identity among word hashes.
END_HASH = np.uint64(0x454E44)
#: Pseudo-counts of Baum-Welch for a class and a transition.
CLASS_PRIOR, STEP_PRIOR = 0.01, 0.1


@dataclass
class States:
    start: np.ndarray  # [state]
    step: np.ndarray  # [from, to]
    emit: np.ndarray  # [class, state]


def learn_fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of texts: first and last row, hashes of their words, and where each text's words begin."""
    for first, last, data, offsets in doc_bytes(texts):
        data = fold_ascii(data)
        starts, ends, edge = word_spans(data, offsets)
        yield first, last, span_hashes(data, starts, ends), edge


def _with_ends(own: np.ndarray, edge: np.ndarray, end: int) -> np.ndarray:
    """Classes of the words with the class of the end token after each text."""
    texts = len(edge) - 1
    seq = np.full(len(own) + texts, end, np.int32)
    seq[np.arange(len(own)) + np.repeat(np.arange(texts), np.diff(edge))] = own
    return seq


def classes(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(20)).astype(np.int64) % CLASSES


def _in_buckets(words: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted hashes dealt out by their size."""
    of = (words >> np.uint64(32)).astype(np.int64) * buckets >> 32
    cut = np.searchsorted(of, np.arange(buckets + 1))
    return [(k, int(cut[k]), int(cut[k + 1])) for k in range(buckets) if cut[k] < cut[k + 1]]


def word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, words, counts, n, v) over (text): the distinct words of a bucket of hashes and the end,
    ascending, with their counts; n and v sum up counts and words.  Tasks count their own first."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(held), return_counts=True)
            parts = _in_buckets(w, buckets)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.int64()), pa.array([w[s:e].tobytes() for _, s, e in parts], pa.binary()), pa.array([c[s:e].tobytes() for _, s, e in parts], pa.binary())], ["bucket", "words", "counts"])

        for batch in batches:
            for first, last, words, _ in tokens(batch.column(0)):
                held += [words, np.full(last - first, END_HASH)]
                if sum(map(len, held)) >= GATHER:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    def added(group: pa.Table) -> pa.Table:
        words, counts = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("words", np.uint64), ("counts", np.int64)))
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        cut = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        total = np.add.reduceat(counts, cut)
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int64()), "words": pa.array([words[cut].tobytes()], pa.binary()), "counts": pa.array([total.tobytes()], pa.binary()), "n": pa.array([int(total.sum())], pa.int64()), "v": pa.array([len(cut)], pa.int64())})

    return docs.select("text").mapInArrow(sent, "bucket long, words binary, counts binary").groupBy("bucket").applyInArrow(added, "bucket long, words binary, counts binary, n long, v long")


def class_weights(counts: DataFrame) -> np.ndarray:
    """Sum of (count + 1) over the known words of each class."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES + 2, np.int64)
        for batch in batches:
            for words, own in zip(batch.column(0), batch.column(1), strict=True):
                w, c = np.frombuffer(words.as_py(), np.uint64), np.frombuffer(own.as_py(), np.int64)
                np.add.at(total, np.where(w == END_HASH, END, classes(w)), c + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "s"])

    out = np.zeros(CLASSES + 2)
    for row in counts.select("words", "counts").mapInArrow(summed, "k long, s long").groupBy("k").agg(F.sum("s").alias("s")).collect():  # a row for each class
        out[row["k"]] = row["s"]
    return out


def first_states(share: np.ndarray, seed: int = 11) -> States:
    """A start that tells the states apart: emissions of the corpus, tilted at random, in states that
    last, so that the first rounds sort the texts before they sort the words."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(rng.normal(0, 1, (len(share), STATES)))
    emit[END] = share[END]
    emit[UNKNOWN] = share[UNKNOWN]
    step = np.full((STATES, STATES), 1.0) + np.eye(STATES) * 50 * STATES
    return States(np.full(STATES, 1 / STATES), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _side_by_side(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of texts of like length, at most TOGETHER of them and half a million tokens unless one is longer."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        many = int(min(TOGETHER, max(1, (1 << 19) // max(1, lengths[order[at]]))))
        yield order[at : at + many]
        at += many


def forward(model: States, seq: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence of classes, by the scaled forward recursion."""
    lengths, out = np.diff(edge), np.zeros(len(edge) - 1)
    for group in _side_by_side(lengths):
        begin, length = edge[group], lengths[group]
        a = model.start * model.emit[seq[begin]]
        scale = a.sum(1)
        total = np.log(scale)
        a /= scale[:, None]
        live = len(group)
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length[:live], -t, "left"))  # texts longer than t come first
            a = a[:live] @ model.step
            a *= model.emit[seq[begin[:live] + t]]
            scale = a.sum(1)
            a /= scale[:, None]
            total[:live] += np.log(scale)
        out[group] = total
    return out


def expected(model: States, seq: np.ndarray, edge: np.ndarray, into: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Add the expected starts, transitions and emissions of the sequences to ``into``.

    Positions are read in stretches of at most HELD tokens (or the square root of a longer text).  The way forward
    keeps the states at the end of each stretch, the way back makes those inside a stretch again."""
    start, step, emit = into
    lengths, states = np.diff(edge), len(start)
    for group in _side_by_side(lengths):
        begin, length = edge[group], lengths[group]
        most = int(length[0])
        live = np.searchsorted(-length, -np.arange(most), "left")  # texts longer than t come first
        stride = max(math.isqrt(most) + 1, HELD // len(group))
        stretches = [(first, min(first + stride, most)) for first in range(0, most, stride)]

        def ahead(a, first: int, last: int, begin=begin, live=live) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
            """Where each position begins, its classes, states and scales; ``a``: the states before ``first``."""
            cut = [0, *np.cumsum(live[first:last]).tolist()]
            of, alpha, scale = np.empty(cut[-1], np.int32), np.empty((cut[-1], states)), np.empty((cut[-1], 1))
            for t, (x, y) in enumerate(zip(cut, cut[1:], strict=False), first):
                of[x:y] = seq[begin[: y - x] + t]
                now = alpha[x:y]
                np.multiply(a[: y - x] @ model.step if t else model.start, model.emit[of[x:y]], out=now)
                scale[x:y] = now.sum(1, keepdims=True)
                now /= scale[x:y]
                a = now
            return cut, of, alpha, scale

        before: list = [None]
        for first, last in stretches[:-1]:
            cut, _, alpha, _ = ahead(before[-1], first, last)
            before.append(alpha[cut[-2] :].copy())
        beta = np.ones((int(live[-1]), states))
        for (first, last), prior in zip(reversed(stretches), reversed(before), strict=True):
            cut, of, alpha, scale = ahead(prior, first, last)
            for t in range(last - 1, first - 1, -1):
                x, y = cut[t - first], cut[t - first + 1]
                if len(beta) < y - x:  # texts that end here
                    beta = np.concatenate([beta, np.ones((y - x - len(beta), states))])
                alpha[x:y] *= beta  # from here on the share of each state
                if t:
                    right = model.emit[of[x:y]] * beta / scale[x:y]
                    left = alpha[cut[t - first - 1] : x] if t > first else prior
                    step += model.step * (left[: y - x].T @ right)
                    beta = right @ model.step.T
            if not first:
                start += alpha[: cut[1]].sum(0)
            for k in range(states):
                emit[:, k] += np.bincount(of, weights=alpha[:, k], minlength=len(emit))


def baum_welch(docs: DataFrame, model: States, rounds: int = ROUNDS, width: int = 1) -> States:
    """``rounds`` of Baum-Welch over all of (text).  A task sends its summed counts in pieces; of each piece
    ``width`` tasks add up a part of them, then one task adds up these, so with ``width`` the square root of the number
    of tasks no task reads more than that many rows of bounded size."""
    pieces = np.array_split(np.arange(CLASSES + 2), 8)
    for _ in range(rounds):
        now = model

        def counted(batches: Iterator[pa.RecordBatch], now: States = now) -> Iterator[pa.RecordBatch]:
            into = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 2, STATES))
            context = TaskContext.get()
            salt = context.partitionId() % width if context else 0
            seqs: list[np.ndarray] = []
            many: list[np.ndarray] = []

            def run() -> None:
                expected(now, np.concatenate(seqs), np.r_[0, np.cumsum(np.concatenate(many))], into)
                seqs.clear()
                many.clear()

            for batch in batches:
                for _, _, words, edge in tokens(batch.column(0)):
                    seqs.append(_with_ends(classes(words), edge, END))
                    many.append(np.diff(edge) + 1)
                    if sum(map(len, seqs)) >= GATHER:
                        run()
            if seqs:
                run()
            rows = [into[0], into[1].ravel(), *(into[2][p].ravel() for p in pieces)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["piece", "salt", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    row = np.frombuffer(blob.as_buffer(), np.float64)
                    total[k] = total[k] + row if k in total else row.copy()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["piece", "salt", "sums"])

        kind = "piece int, salt int, sums binary"
        sums = docs.select("text").mapInArrow(counted, kind)
        for tasks in (width * (len(pieces) + 2), len(pieces) + 2):
            sums = sums.repartition(tasks, "piece", "salt").mapInArrow(added, kind)
        total: dict[int, np.ndarray] = {}
        for row in sums.collect():  # a row of bounded size for each piece
            part = np.frombuffer(row["sums"], np.float64)
            total[row["piece"]] = total.get(row["piece"], 0) + part
        if not total:
            return model
        start, step = total[0] + STEP_PRIOR, total[1].reshape(STATES, STATES) + STEP_PRIOR
        emit = np.concatenate([total[k + 2].reshape(-1, STATES) for k in range(len(pieces))]) + CLASS_PRIOR
        model = States(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def score_texts(docs: DataFrame, counts: DataFrame, model: States, share: np.ndarray, n: int, v: int, end: int, blocks: int) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of (block, id, text)."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        many = 0

        def flush() -> pa.RecordBatch:
            rows = []
            for block, lists in held.items():
                w = np.unique(np.concatenate(lists))
                rows += [(k, block, w[s:e].tobytes()) for k, s, e in _in_buckets(w, blocks)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["bucket", "block", "words"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            for first, last, words, edge in tokens(batch.column(2)):
                for block in np.unique(of[first:last]):
                    held.setdefault(int(block), []).append(words[np.repeat(of[first:last] == block, np.diff(edge))])
                many += len(words)
                if many >= GATHER:
                    yield flush()
                    held, many = {}, 0
        if held:
            yield flush()

    def told(want: pa.Table, known: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        w = np.frombuffer(b"".join(known.column("words").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(known.column("counts").to_pylist()), np.int64)
        for block, blob in zip(want.column("block").to_pylist(), want.column("words").to_pylist(), strict=True):
            own = np.frombuffer(blob, np.uint64)
            at = np.minimum(np.searchsorted(w, own), max(len(w) - 1, 0))
            hit = w[at] == own if len(w) else np.zeros(len(own), bool)
            for held, x in zip(out, (block, own[hit].tobytes(), c[at[hit]].tobytes()), strict=True):
                held.append(x)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "words", "counts"])

    def scored(own: pa.Table, known: pa.Table) -> pa.Table:
        w = np.frombuffer(b"".join(known.column("words").to_pylist()), np.uint64)
        c = np.frombuffer(b"".join(known.column("counts").to_pylist()), np.int64)
        order = np.argsort(w, kind="stable")
        w, c = w[order], c[order]
        unknown = np.log10(1 / (n + v + 1))
        within = np.log(np.maximum(share, 1e-300))
        bases, knowns, seqs, many = [], [], [], []
        for first, last, words, edge in tokens(own.column("text")):
            count = np.diff(edge)
            doc = np.repeat(np.arange(last - first), count)
            at = np.minimum(np.searchsorted(w, words), max(len(w) - 1, 0))
            hit = w[at] == words if len(w) else np.zeros(len(words), bool)
            base = np.where(hit, np.log10((np.where(hit, c[at] if len(w) else 0, 0) + 1) / (n + v + 1)), unknown)
            bases.append(np.bincount(doc, weights=base, minlength=last - first) + np.log10((end + 1) / (n + v + 1)))
            knowns.append(np.bincount(doc, weights=hit, minlength=last - first) + (end > 0))
            seqs.append(_with_ends(np.where(hit, classes(words), UNKNOWN), edge, END if end else UNKNOWN))
            many.append(count + 1)
        seq, length = np.concatenate(seqs), np.concatenate(many)
        edge = np.r_[0, np.cumsum(length)]
        gain = forward(model, seq, edge) - np.add.reduceat(within[seq], edge[:-1])
        base = np.concatenate(bases)
        columns = [pa.array(length, pa.int64()), pa.array(np.concatenate(knowns).astype(np.int64)), pa.array(base), pa.array(base + gain / np.log(10))]
        return pa.table([own.column("id"), *columns], schema.names)

    wide = docs.select("block", "id", "text").repartition("block")  # asks for its words, then gets scored
    want = wide.mapInArrow(asked, "bucket long, block long, words binary")
    found = want.groupBy("bucket").cogroup(counts.select("bucket", "words", "counts").groupBy("bucket")).applyInArrow(told, "block long, words binary, counts binary")
    return wide.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(scored, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    learn = source.where(learn_fold(F.col("id"))).select("text")
    chars = source.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = int(chars // BLOCK_CHARS) + 1
    counts = keep(word_counts(learn, blocks), "counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    share = class_weights(counts)
    end = max(int(share[END]) - 1, 0)
    share[UNKNOWN] = 1
    share /= n + v + 1
    model = baum_welch(learn, first_states(np.maximum(share, 1e-12)), rounds, math.isqrt(blocks) + 1) if n else first_states(np.maximum(share, 1e-12))
    emit = model.emit.copy()  # classes of which no word is known give nothing; the unknown word gets its smoothed share
    emit[share == 0] = 0
    emit[UNKNOWN] = 0
    emit *= (1 - share[UNKNOWN]) / np.maximum(emit.sum(0), 1e-300) if n else 0
    emit[UNKNOWN] = share[UNKNOWN]
    model = States(model.start, model.step, emit)
    blocked = source.withColumn("block", F.pmod(F.xxhash64(F.col("id").cast("string"), F.length("text")), F.lit(blocks)))
    out = score_texts(blocked, counts, model, share, int(n), int(v), end, blocks)
    return out.select("doc_id", (~learn_fold(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_hmm_lm": op7_hmm_lm}
