"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy
from confirmed toxic texts and from unlabelled ones. With the share of toxic
texts (the class prior) given, the risk on the negatives is the unlabelled risk
less the prior's part of the positive one; where that estimate falls below
zero, the step is taken against it (Kiryo et al. 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import byte_lengths, spans_to_index, text_bytes, text_slices, tidied, utf8
from cadenza.llm.hashing import Bytes, mix, words

#: Features are hashed into 2**BITS weights. Beginnings of words are of so many bytes.
BITS, BEGINNINGS = 19, (4, 6, 8)
THRESHOLD = 0.3


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of a text column: feature numbers, and how many each text has."""
    lower = pc.utf8_lower(utf8(texts))
    for a, b in text_slices(byte_lengths(lower)):
        raw, bounds = text_bytes(lower.slice(a, b - a))
        starts, ends, counts = words(raw, bounds)
        hashed = Bytes(raw)
        kinds = [hashed.hashes(starts, ends)] + [mix(hashed.hashes(starts, np.minimum(ends, starts + n)) + np.uint64(n)) for n in BEGINNINGS]
        yield (np.stack(kinds, 1).ravel() >> np.uint64(64 - BITS)).astype(np.int32), counts * len(kinds)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_margins(self.weights, self.bias, found, counts), -30, 30)))


def _margins(weights: np.ndarray, bias: float, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[found], dtype=np.float64)])
    ends = np.cumsum(counts)
    return bias + (sums[ends] - sums[ends - counts]) / np.sqrt(np.maximum(counts, 1))


#: A text's features, each once, and how often it has them.
Row = tuple[np.ndarray, np.ndarray]


def risk_slopes(margins: np.ndarray, n_positive: int, prior: float) -> tuple[float, np.ndarray]:
    """The negatives' corrected risk, and the slopes in the margins of the step to take: positive texts first, then unlabelled ones.

    With the logistic loss: the risk of calling a text negative over unlabelled
    texts, less ``prior`` times that over positive ones. Where it is below
    zero, the step goes against its slope alone.
    """
    s, n, k = 1 / (1 + np.exp(-np.clip(margins, -30, 30))), n_positive, len(margins) - n_positive
    losses = np.logaddexp(0, margins)
    risk = float(losses[n:].mean() - prior * losses[:n].mean())
    slope = np.concatenate([-prior * s[:n] / n, s[n:] / k])
    if risk < 0:
        return risk, -slope
    slope[:n] += prior * (s[:n] - 1) / n
    return risk, slope


def train(positive: list[Row], unlabelled: list[Row], prior: float, epochs: int = 40, batch: int = 512, rate: float = 0.05, decay: float = 1e-4, smooth: float = 1.0, start: float = 0.1, seed: int = 7) -> Model:
    """Adam on the non-negative risk with the logistic loss.

    Without positive or unlabelled texts the model says the prior everywhere.
    """
    prior = min(max(prior, 1e-4), 0.5)
    size, bias = 1 << BITS, float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.zeros(size, np.float32), bias)
    # Features weigh as they tell toxic from unlabelled texts: the log ratio of the shares of texts that have them.
    with_it = [np.bincount(np.concatenate([x for x, _ in rows]), minlength=size) for rows in (positive, unlabelled)]
    ratio = np.log((with_it[0] + smooth) / (len(positive) + 2 * smooth)) - np.log((with_it[1] + smooth) / (len(unlabelled) + 2 * smooth))
    # Features of one or two texts say nothing; the others alone are kept from here on.
    used = np.flatnonzero((with_it[0] + with_it[1] > 2) & (ratio != 0))
    ratio = ratio[used].astype(np.float32)
    slot = np.full(size, -1, np.int32)
    slot[used] = np.arange(len(used))
    rows = [(slot[x], c) for x, c in positive + unlabelled]
    totals = np.array([c.sum() for _, c in rows])
    lengths = np.array([(x >= 0).sum() for x, _ in rows])
    begins = np.cumsum(lengths) - lengths
    numbers, times = (np.concatenate(x) for x in zip(*((x[x >= 0], c[x >= 0]) for x, c in rows), strict=True))
    del rows, with_it, slot
    root = np.sqrt(np.maximum(totals, 1))
    w = np.full(len(used), start, np.float32)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    mb = vb = 0.0
    rng = np.random.default_rng(seed)
    n_batches = max(1, len(unlabelled) // batch)
    for _ in range(epochs):
        p_order, u_order = (np.array_split(rng.permutation(n), n_batches) for n in (len(positive), len(unlabelled)))
        for p_rows, u_rows in zip(p_order, u_order, strict=True):
            if not len(p_rows) or not len(u_rows):
                continue
            chosen = np.concatenate([p_rows, len(positive) + u_rows])
            own, at = lengths[chosen], spans_to_index(begins[chosen], lengths[chosen])
            found, often = numbers[at], times[at]
            sums, ends = np.concatenate([[0.0], np.cumsum((w * ratio)[found] * often, dtype=np.float64)]), np.cumsum(own)
            _, slope = risk_slopes(bias + (sums[ends] - sums[ends - own]) / root[chosen], len(p_rows), prior)
            gradient = np.bincount(found, np.repeat(slope / root[chosen], own) * often, len(w)).astype(np.float32) * ratio + decay * w
            step += 1
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient * gradient - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            gb = float(slope.sum())
            mb += 0.1 * (gb - mb)
            vb += 0.01 * (gb * gb - vb)
            bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros(size, np.float32)
    weights[used] = w * ratio
    return Model(weights, bias)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, max_positive: int = 2000, max_unlabelled: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on a bounded sample of labelled rows, as one task trains; only the model comes to the driver.

    Confirmed toxic rows outside the held-out fold, ``max_positive`` at most,
    and as unlabelled texts any labelled rows outside it, ``max_unlabelled`` at
    most, whose labels are not read: those with the smallest hashes of their
    ids. The class prior is the share of toxic rows among all labelled rows
    outside the held-out fold. A text comes as its distinct features and their
    counts, made where it lies. Rows without id or mark are left out; of
    documents with one id one is taken; without toxic or unlabelled texts
    (empty tables) the model says the prior everywhere.
    """
    free = ~held_out(F.col("id"))
    marks = labels.select(labels["doc_id"].cast("bigint").alias("id"), labels["toxic"].alias("toxic")).where("id is not null and toxic is not null").where(free)
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    rows = documents.select(documents[id_col].cast("bigint").alias("id"), documents[text_col].alias("text")).where("id is not null")
    by_hash = [F.xxhash64("id"), "id"]
    ids = [{r[0] for r in x.select("id").distinct().orderBy(*by_hash).limit(n).collect()} for x, n in ((marks.where("toxic = 1"), max_positive), (marks, max_unlabelled))]
    chosen = documents.sparkSession.createDataFrame([(i,) for i in sorted(ids[0] | ids[1])], "id bigint")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for numbers, counts in features(batch.column(1)):
                # Distinct features of each text, by one sort of (text, feature).
                both = np.sort((np.repeat(np.arange(len(counts)), counts) << BITS) | numbers)
                new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
                often = np.diff(np.append(new, len(both))).astype(np.int32)
                bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(both[new] >> BITS, minlength=len(counts)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ((both[new] & ((1 << BITS) - 1)).astype(np.int32), often)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), *lists], names=["id", "features", "counts"])
                at += len(counts)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = {i: (x.values.to_numpy(), n.values.to_numpy()) for batch in batches for i, x, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)}
        model = train([one[i] for i in sorted(ids[0]) if i in one], [one[i] for i in sorted(ids[1]) if i in one], prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([float(model.bias)])], names=["weights", "bias"])

    # At most max_positive + max_unlabelled ids are broadcast, and as many texts' features meet in the task that trains.
    sample = rows.join(F.broadcast(chosen), "id", "left_semi").mapInArrow(tidied(found), "id bigint, features array<int>, counts array<int>")
    model = sample.repartition(1).mapInArrow(tidied(fit), "weights binary, bias double").first()
    return Model(np.frombuffer(model["weights"], np.float32), model["bias"]) if model else train([], [], prior)


def score_documents(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    Null and empty texts get the score of a text without words; a null id is
    not held out; repeated rows are scored alike; an empty table gives no rows;
    other columns are not read. The weights (2**BITS floats) are broadcast.
    """
    weights = documents.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [weights.value.scores(*x) for x in features(batch.column(2))]
            s = np.concatenate(own) if own else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(documents[id_col].cast("bigint").alias("id"), held_out(documents[id_col].cast("bigint")).alias("held"), documents[text_col])
    return rows.mapInArrow(tidied(scores), "doc_id bigint, held_out boolean, score double, predicted int")


def without_toxic(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's rows, all columns, whose score is below THRESHOLD. A narrow operator."""
    weights = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [weights.value.scores(*x) for x in features(batch.column(at))]
            yield batch.filter(pa.array((np.concatenate(own) if own else np.zeros(0)) < THRESHOLD))

    return documents.mapInArrow(tidied(clean), documents.schema)
