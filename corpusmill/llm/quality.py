"""Quality classifier by positive-unlabelled learning with the non-negative risk (Kiryo and others, 2017).

The risk and its gradient are sums over all trusted positives and all unlabelled rows: each task adds up
its own, and the driver holds the parameters, a vector of fixed size. The class prior is estimated from
positives and unlabelled rows alone, by the share of each that a first classifier puts on top.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusmill.llm.common import as_bytes, batch_of, require, small, small_batches, written

#: Passes over the rows of the first classifier, which serves the prior alone, and of the final one.
PRIOR_PASSES, PASSES = 8, 12

#: Weight decay.
DECAY = 2e-4

#: Gradients and steps that the optimiser remembers.
MEMORY = 8

#: Bins of scores from which the prior is read, from -SCORES to SCORES; share of the positives that a top must hold.
BINS, SCORES, LEAST_TOP = 400, 20.0, 0.1

#: Slices of a vector that is summed over tasks, and the most tasks that add them up.
SLICES = 32

BUCKETS = 1 << 14
_LETTERS = bytes(c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 0x80)
_DIGITS, _UPPER, _SPACE = b"0123456789", bytes(range(0x41, 0x5B)), b" \t\n\r\v\f"
_PLAIN_MARKS = b".,;:!?'\"()-"
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c not in _PLAIN_MARKS)
DENSE = 18


def features(text: bytes) -> tuple[list[float], list[int], list[int]]:
    """Shares that tell how a text is built, and hashed words with their counts."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [1.0] + [0.0] * (DENSE - 1), [], []
    of = lambda kind: size - len(text.translate(None, kind))
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(w.translate(None, _MARKS) != w for w in words) if of(_MARKS) else 0
    solo = sum(len(w) == 1 for w in words)
    dense = [
        0.0,
        1.0,
        math.log1p(n) / 10,
        (size - of(_SPACE)) / n / 10,
        len(counts) / n,
        len(counts) / math.sqrt(n) / 20,
        repeats / n,
        math.sqrt(repeats / n),
        marked / n,
        math.sqrt(marked / n),
        of(_MARKS) / size,
        of(_PLAIN_MARKS) / size,
        of(_DIGITS) / size,
        of(_UPPER) / size,
        solo / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))) / 5,
        counts.most_common(1)[0][1] / n,
    ]
    return dense, [zlib.crc32(w) % BUCKETS for w in counts], list(counts.values())


@dataclass
class Model:
    """A linear model on standardised shares and on words weighed by the root of their share of the text."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, rows: Rows) -> np.ndarray:
        return sigmoid(rows.product(self.weights, self.mean, self.scale))


@dataclass
class Rows:
    """Features of rows: shares, and of all rows' words in a line the row, the bucket and the weight."""

    dense: np.ndarray
    owner: np.ndarray
    index: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, dense: list, index: list, counts: list) -> Rows:
        """From each row's shares, and buckets and counts of words as bytes."""
        sizes = np.array([len(x) // 2 for x in index], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n = np.frombuffer(b"".join(counts), "<u4").astype(np.float64)
        total = np.bincount(owner, n, len(sizes))
        return cls(np.array(dense, np.float64).reshape(-1, DENSE), owner, np.frombuffer(b"".join(index), "<u2").astype(np.int64), np.sqrt(n / total[owner]))

    def product(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Each row's product with the weights of shares, words and the constant, in this order."""
        words = np.bincount(self.owner, self.value * weights[DENSE + self.index], len(self.dense))
        return (self.dense - mean) / scale @ weights[:DENSE] + words + weights[-1]

    def back(self, g: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The sum of the rows' features, each times its number."""
        return np.concatenate([g @ ((self.dense - mean) / scale), np.bincount(self.index, self.value * g[self.owner], BUCKETS), [g.sum()]])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id_col: str, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0; a null id is not held out, and has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def summed(table: DataFrame, part_of) -> np.ndarray:
    """The sum over all rows of ``table`` of vectors that ``part_of(positive, rows, half)`` gives for each batch, in two levels of tasks.

    Each task cuts its vector into ``SLICES``, and each slice is added up over all tasks by itself, so the
    driver gets one vector in all, and ends few tasks a pass, however many parts and shuffle partitions there are.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = Rows.of(*(batch.column(c).to_pylist() for c in ("dense", "index", "counts")))
                flags = [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("positive", "half")]
                found = part_of(flags[0], rows, flags[1])
                total = found if total is None else total + found
        if total is not None:
            part = TaskContext.get().partitionId()
            cut = [x.tobytes() for x in np.array_split(total.astype("<f8"), min(SLICES, len(total)))]
            yield batch_of(("part", "slice", "sums"), (pa.int64(), pa.int64(), pa.binary()), ([part] * len(cut), list(range(len(cut))), cut))

    def add(rows):
        order = np.argsort(rows["part"].to_numpy())
        total = np.sum([np.frombuffer(x, "<f8") for x in rows["sums"].take(pa.array(order)).to_pylist()], axis=0)
        return pa.table({"slice": rows["slice"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    found = table.mapInArrow(run, "part long, slice long, sums binary").groupBy("slice").applyInArrow(add, "slice long, sums binary").coalesce(SLICES)
    parts = sorted(found.collect(), key=lambda r: r.slice)
    return np.concatenate([np.frombuffer(r.sums, "<f8") for r in parts]) if parts else np.zeros(0)


def fit(risk, start: np.ndarray, passes: int) -> np.ndarray:
    """Minimise ``risk(theta) -> (value, gradient)`` by limited-memory quasi-Newton steps (Nocedal, 1980), halved while the risk grows; each call is a pass."""
    theta = start
    value, gradient = risk(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    size, used = 1.0, 1
    while used < passes and np.abs(gradient).max() > 1e-6:
        q, weights = gradient.copy(), []
        for s, y in reversed(steps):
            a = s @ q / (s @ y)
            q -= a * y
            weights.append(a)
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(steps, reversed(weights), strict=True):
            q += s * (a - y @ q / (s @ y))
        if q @ gradient <= 0:
            q, steps = gradient / max(1.0, np.linalg.norm(gradient)), []
        after = theta - size * q
        next_value, next_gradient = risk(after)
        used += 1
        if next_value > value - 1e-4 * size * (q @ gradient):
            size /= 2
            if size < 1e-3:
                break
            continue
        s, y = after - theta, next_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps[1 - MEMORY :], (s, y)]
        theta, value, gradient, size = after, next_value, next_gradient, 1.0
    return theta


def non_negative_risk(table: DataFrame, prior: float, mean: np.ndarray, scale: np.ndarray, n_positive: float, n_free: float, of_positive: np.ndarray, half: bool = False):
    """``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))`` of the logistic loss and its gradient, with weight decay, as a function of the weights.

    ``of_positive`` is the positives' mean row: the losses of calling a row positive or negative
    differ by its score, so one gradient over the positives serves both.
    """

    def risk(theta):
        def part_of(positive, rows, of_half):
            use = of_half if half else np.ones(len(positive), bool)
            z = rows.product(theta, mean, scale)
            s, down = sigmoid(z), np.logaddexp(0, z)  # loss of calling a row negative
            p, u = positive & use, use
            of_p = rows.back(np.where(p, s - 1, 0.0), mean, scale)
            of_u = rows.back(np.where(u, s, 0.0), mean, scale)
            return np.concatenate([[down[p].sum(), z[p].sum(), down[u].sum()], of_p, of_u])

        sums = summed(table, part_of)
        n = len(theta)
        down_p, z_p, down_u = sums[0] / n_positive, sums[1] / n_positive, sums[2] / n_free
        g_p, g_u = sums[3 : 3 + n] / n_positive, sums[3 + n :] / n_free
        rest = down_u - prior * down_p
        value, gradient = prior * (down_p - z_p), prior * g_p
        if rest > 0:
            value, gradient = value + rest, gradient + g_u - prior * (g_p + of_positive)
        free = np.append(theta[:-1], 0.0)
        return value + DECAY / 2 * float(free @ free), gradient + DECAY * free

    return risk


def estimated_prior(positive: np.ndarray, free: np.ndarray) -> float:
    """The class prior from histograms of scores of positives and of unlabelled rows, highest first.

    A share ``prior`` of the unlabelled rows is as the positives are, so of any top of the scores they
    have at least the prior times what the positives have; the least ratio, with the bounds of both
    shares at 95 per cent, is the estimate (Garg and others, 2021). Tops must hold ``LEAST_TOP`` of the positives.
    """
    n_p, n_u = positive.sum(), free.sum()
    if not n_p or not n_u:
        return 0.5
    top_p, top_u = np.cumsum(positive) / n_p, np.cumsum(free) / n_u
    off = lambda n: math.sqrt(math.log(4 / 0.05) / (2 * n))
    use = top_p >= LEAST_TOP
    best = np.argmin((top_u[use] + off(n_u) + off(n_p)) / top_p[use])
    return float(np.clip((top_u[use] / top_p[use])[best], 0.01, 0.99))


def feature_table(docs: DataFrame, positive: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written features of all ``docs``, with whether each is a trusted positive, and a half that a hash of the text deals."""
    small_batches(docs.sparkSession)
    trusted = small(written(positive.select(F.col(id_col).alias("trusted")).distinct(), "trusted"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.join(trusted, F.col("id") == F.col("trusted"), "left").select("text", F.col("trusted").isNotNull().alias("positive"), (F.pmod(F.xxhash64(F.lit(71), "text"), F.lit(2)) == 0).alias("half"))

    def extract(batches):
        types = (pa.bool_(), pa.bool_(), pa.list_(pa.float64()), pa.binary(), pa.binary())
        for batch in batches:
            found = [features(t) for t in as_bytes(batch.column(0))]
            index = [np.array(i, "<u2").tobytes() for _, i, _ in found]
            counts = [np.array(c, "<u4").tobytes() for _, _, c in found]
            yield batch_of(("positive", "half", "dense", "index", "counts"), types, (batch.column(1), batch.column(2), [d for d, _, _ in found], index, counts))

    return written(own.mapInArrow(extract, "positive boolean, half boolean, dense array<double>, index binary, counts binary"), "features")


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> Model:
    """Fit a model on all trusted positives and all unlabelled rows.

    Trusted positives are the documents with a label of 1 (an id with several labels counts by the
    greatest); unlabelled are all documents, as labels of 0 are not used. Held-out rows are neither.
    The prior is estimated from both: a first classifier is fitted on one half of the rows, and its
    scores are compared on the other. Without positives or rows the model is the constant 0.5.
    """
    require(docs, id=id_col, text=text_col)
    require(labels, id=id_col, label=label_col)
    positive = labels.where(~held_out(id_col, folds) & (F.col(label_col) == 1)).select(id_col)
    table = feature_table(docs.where(~held_out(id_col, folds)), positive, id_col, text_col)
    nothing = np.zeros(DENSE + BUCKETS + 1)
    zero, one = np.zeros(DENSE), np.ones(DENSE)

    def first(p, rows, half):
        everywhere = np.ones(len(p))
        x = rows.dense
        of = [p.sum(), len(p), (p & half).sum(), half.sum()]
        return np.concatenate([of, x.sum(0), (x**2).sum(0), rows.back(p * everywhere, zero, one), rows.back((p & half) * everywhere, zero, one)])

    sums = summed(table, first)
    if not len(sums) or min(sums[0], sums[2], sums[3], sums[1] - sums[3], sums[0] - sums[2]) < 1:
        return Model(zero, one, nothing)
    n_p, n_u, half_p, half_u = sums[:4]
    mean = sums[4 : 4 + DENSE] / n_u
    scale = np.sqrt(np.maximum(sums[4 + DENSE : 4 + 2 * DENSE] / n_u - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rest = sums[4 + 2 * DENSE :]

    def mean_row(x, n):
        x = x / n
        return np.concatenate([(x[:DENSE] - mean) / scale, x[DENSE:-1], [1.0]])

    risk = non_negative_risk(table, 0.5, mean, scale, half_p, half_u, mean_row(rest[len(rest) // 2 :], half_p), half=True)
    theta = fit(risk, nothing, PRIOR_PASSES)

    def histograms(p, rows, half):
        z = np.clip(rows.product(theta, mean, scale), -SCORES, SCORES)
        at = np.minimum(((SCORES - z) / (2 * SCORES) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at[p & ~half], minlength=BINS), np.bincount(at[~half], minlength=BINS)]).astype(float)

    counts = summed(table, histograms)
    prior = estimated_prior(counts[:BINS], counts[BINS:])
    start = theta.copy()
    start[-1] += math.log(prior / (1 - prior))
    risk = non_negative_risk(table, prior, mean, scale, n_p, n_u, mean_row(rest[: len(rest) // 2], n_p))
    return Model(mean, scale, fit(risk, start, PASSES))


def score_rows(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row, score``: every whole text of a table with one column ``row``, a struct, is scored.

    The model is of fixed size and broadcast, and rows are independent. A null or empty text has the
    score of an empty one.
    """
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        m = shared.value
        for batch in batches:
            found = [features(t) for t in as_bytes(batch.column(0))]
            x = Rows.of([d for d, _, _ in found], [np.array(i, "<u2").tobytes() for _, i, _ in found], [np.array(c, "<u4").tobytes() for _, _, c in found])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(m.scores(x) if len(found) else [], pa.float64())], names=["row", "score"])

    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("score", DoubleType())])
    return rows.select(F.col("row")[text_col].alias("text"), "row").mapInArrow(apply, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Train on ``labels`` and score every document: ``id_col, held_out, score, predicted``, one row for each row of ``docs``.

    Ids may be null or repeat; a null or empty text has the score of an empty one; an empty table
    gives no rows; other columns are not read.
    """
    model = train_quality(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.struct(F.col(id_col), F.col(text_col)).alias("row"))
    scored = score_rows(rows, model, text_col).select(F.col("row")[id_col].alias(id_col), "score")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
