"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

The words before a token give one predicted vector, the sum of their vectors weighed by their distance
(Mnih and Hinton, 2007). An output is scored by its product with that vector and a bias. Outputs stand
in classes of like total frequency, and a token's probability is that of its class among all classes
times that of its output within the class (Mnih and Hinton, 2008), each normalised for each context by
products of blocks of contexts with all vectors concerned.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, batch_of, require, small_batches, written

#: Most words whose exact counts and vectors are broadcast, and classes of all others by their ending.
COUNTED, ENDINGS = 1 << 18, 512

#: A word with at least this count, and this share of the root of all tokens, has vectors of its own if it is
#: broadcast. So the words that have them grow as the root of the corpus, and the sums for a context as its fourth root.
LEAST_NAMED, NAMED_ROOT = 16, 1 / 12

#: Size of vectors, and words before a token that predict it.
WIDTH, SPAN = 16, 4

#: Noise classes of a batch, noise outputs of a class in a batch, tokens of a batch.
NOISE, CLASS_NOISE, BATCH = 24, 8, 16_384

#: Contexts whose products with all classes are held at once.
BLOCK = 2_048

#: Of a token's gradient within a batch's sum.
GRADIENT_SCALE = 1 / 64

#: Passes over all tokens are cut into this many rounds, by a hash of the row, and tasks' models are averaged after each.
ROUNDS = 2

#: Rows of parameters that are averaged in one task.
AVERAGED_ROWS = 4_096

#: Distinct words that a task holds before it passes their counts on.
FLUSH = 400_000

#: The token that ends a text; no word is empty.
END = b""

_F4 = np.float32


def tokens(text: bytes) -> list[bytes]:
    """Words at ASCII white space with A-Z lower-cased, then the end."""
    return [*text.lower().split(), END]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word binary, c long`` of all tokens; counts are summed in each task before the shuffle."""
    small_batches(docs.sparkSession)

    def count(batches):
        held: Counter = Counter()

        def flush():
            out = batch_of(("word", "c"), (pa.binary(), pa.int64()), (list(held.keys()), list(held.values())))
            held.clear()
            return out

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                held.update(tokens(text))
                if len(held) > FLUSH:
                    yield flush()
        yield flush()

    return docs.select(text_col).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The words with known counts, most frequent first.

    Outputs of the model are the first ``n_named`` words and the endings of all others, by falling
    total count; ``of_word`` and ``of_ending`` give their places. Classes are runs of outputs with
    like total counts; ``starts`` has their first outputs and the end.
    """

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    n_named: int
    ending_total: np.ndarray
    ending_distinct: np.ndarray

    def __post_init__(self) -> None:
        mass = np.concatenate([self.counts[: self.n_named], self.ending_total]) + 1.0
        order = np.argsort(-mass, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.mass = mass[order] / mass.sum()
        self.of_ending = place[self.n_named :].astype(np.int32)
        self.of_word = place[: self.n_named].astype(np.int32)
        classes = max(1, math.ceil(math.sqrt(len(order))))
        before = np.cumsum(self.mass) - self.mass
        cls = np.minimum((before * classes).astype(np.int64), classes - 1)
        self.starts = np.append(np.flatnonzero(np.diff(cls, prepend=-1)), len(order))
        self.class_of = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)).astype(np.int32)

    def prepare(self) -> None:
        """What a worker looks words up in; not sent with the rest."""
        self.place = {w: i for i, w in enumerate(self.words)}
        endings = np.array([ending(w) for w in self.words[self.n_named :]], np.int64)
        self.output = np.concatenate([self.of_word, self.of_ending[endings]]).astype(np.int32)
        self.log_count = np.log10(self.counts + 1.0)
        log_ending = np.log10(self.ending_total + self.ending_distinct + 1)
        self.log_share = np.zeros(len(self.words))
        self.log_share[self.n_named :] = self.log_count[self.n_named :] - log_ending[endings]
        self.log_unseen = -log_ending

    @property
    def outputs(self) -> int:
        return len(self.mass)

    @property
    def start(self) -> int:
        """The context before a text; no output."""
        return len(self.mass)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, float]:
        """Place of each token (-1: none), its output, and the sum of log10 shares of their endings' words.

        A word without an output of its own has, of its ending, add-one over the ending's words and
        one unseen; a place of -1 counts as unseen here.
        """
        get = self.place.get
        place = np.fromiter(map(get, words, itertools.repeat(-1)), np.int64, len(words))
        known = place >= 0
        output = np.empty(len(words), np.int32)
        output[known] = self.output[place[known]]
        share = float(self.log_share[place[known]].sum())
        for i in np.flatnonzero(~known):
            e = ending(words[i])
            output[i] = self.of_ending[e]
            share += self.log_unseen[e]
        return place, output, share


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    """From the counts of all words: totals over all, and by name those above a count that at most ``COUNTED`` words reach."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("c") * 16)
    steps = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    kept, least = 0, None
    for step, n in steps:
        if kept + n > COUNTED:
            break
        kept, least = kept + n, step
    top = counts.where(level >= least if least is not None else F.lit(False)).toArrow()
    c, words = top["c"].to_numpy().astype(np.float64), top["word"].to_pylist()
    order = sorted(range(len(words)), key=lambda k: (-c[k], words[k]))
    c, words = c[order], [words[k] for k in order]
    n_named = int((c >= max(LEAST_NAMED, NAMED_ROOT * math.sqrt(total))).sum())
    sums = counts.groupBy((F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")) % ENDINGS).alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    by_total, by_distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in sums:
        by_total[r.e], by_distinct[r.e] = r.c, r.n
    for w, n in zip(words[:n_named], c, strict=False):
        by_total[ending(w)] -= n
        by_distinct[ending(w)] -= 1
    return Vocabulary(words, c, int(total), int(distinct), n_named, by_total, by_distinct)


def order_of(ids: np.ndarray) -> np.ndarray:
    """Stable order of non-negative numbers under 2**32, by radix sorts of their halves."""
    order = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")
    if len(ids) and ids.max() > 0xFFFF:
        high = (ids >> 16).astype(np.uint16)
        order = order.take(np.argsort(high.take(order), kind="stable"))
    return order


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.flatnonzero(np.diff(x, prepend=-1, append=-1))


@dataclass
class Model:
    """Vectors of context words (the last is the start), of outputs and of classes, biases of both, and weights of distances.

    An output's bias is within its class.
    """

    context: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    position: np.ndarray

    def predicted(self, held: np.ndarray) -> np.ndarray:
        """The vector predicted for each token after the first ``SPAN``, from the context vectors of all."""
        n = len(held) - SPAN
        q = self.position[0] * held[SPAN - 1 : SPAN - 1 + n]
        for d in range(2, SPAN + 1):
            q += self.position[d - 1] * held[SPAN - d : SPAN - d + n]
        return q

    def log_probability(self, ids: np.ndarray, v: Vocabulary) -> np.ndarray:
        """Natural logarithm of the probability of each token of ``ids`` after the first ``SPAN``; 0 for starts."""
        target = ids[SPAN:]
        order = order_of(target)
        target = target.take(order)
        live = int(np.searchsorted(target, v.start))
        order, target = order[:live], target[:live]
        q = self.predicted(self.context.take(ids, axis=0)).take(order, axis=0)
        cls, found = v.class_of.take(target), np.empty(live, np.float64)
        q1 = np.concatenate([q, np.ones((live, 1), _F4)], axis=1)  # the bias is one more product
        vectors = np.concatenate([self.classes.T, self.class_bias[None, :]])
        # no exponential overflows where no product of norms is great, so most often no row's maximum is sought
        norm = lambda x: math.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))
        reach = norm(q) * max(norm(self.classes), norm(self.output)) + max(np.abs(self.bias).max(initial=0), np.abs(self.class_bias).max(initial=0))
        for i in range(0, live, BLOCK):
            s = q1[i : i + BLOCK] @ vectors
            found[i : i + BLOCK] = _log_share(s, cls[i : i + BLOCK], reach)
        edges = runs(cls)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            lo, hi = v.starts[cls[a]], v.starts[cls[a] + 1]
            if hi - lo > 1:
                own = np.concatenate([self.output[lo:hi].T, self.bias[None, lo:hi]])
                for i in range(a, b, BLOCK):
                    j = min(b, i + BLOCK)
                    s = q1[i:j] @ own
                    found[i:j] += _log_share(s, target[i:j] - lo, reach)
        out = np.zeros(len(ids) - SPAN)
        out[order] = found
        return out


def _log_share(s: np.ndarray, target: np.ndarray, reach: float) -> np.ndarray:
    """Log of the target's share in each row's exponentials of scores up to ``reach``; ``s`` is used up."""
    own = s[np.arange(len(s)), target].astype(np.float64)
    if reach > 60:
        shift = s.max(1, keepdims=True)
        s -= shift
        own -= shift[:, 0]
    np.exp(s, out=s)
    return own - np.log(s @ np.ones(s.shape[1], _F4), dtype=np.float64)


def first_model(v: Vocabulary, seed: int) -> Model:
    """Unigrams: the biases are the logarithms of the classes' shares and of those within them."""
    random = np.random.default_rng(seed)
    draw = lambda n, spread: random.normal(0, spread, (n, WIDTH)).astype(_F4)
    of_class = np.add.reduceat(v.mass, v.starts[:-1])
    position = np.repeat(1.0 / np.arange(1, SPAN + 1), WIDTH).reshape(SPAN, WIDTH).astype(_F4)
    return Model(draw(v.outputs + 1, 0.3), draw(v.outputs, 0.1), np.log(v.mass / of_class[v.class_of]).astype(_F4), draw(len(of_class), 0.1), np.log(of_class).astype(_F4), position)


class Trainer:
    """Gradient steps of noise-contrastive estimation with step sizes by each row's past gradients.

    Of a batch, every token is one true example with its whole context. Its class is told from noise
    classes drawn from their shares; within its class it is told from noise outputs of the class. The
    noise is shared by the batch, so that all scores are products of matrices.
    """

    def __init__(self, model: Model, v: Vocabulary, rate: float, random: np.random.Generator):
        self.m = Model(*(x.copy() for x in vars(model).values()))
        self.v, self.rate, self.random = v, rate, random
        of_class = np.add.reduceat(v.mass, v.starts[:-1])
        self.cumulative = np.cumsum(of_class)
        self.log_noise = np.log(of_class * NOISE).astype(_F4)
        self.within = np.cumsum(v.mass)
        self.log_within = np.log(v.mass / of_class[v.class_of] * CLASS_NOISE).astype(_F4)
        self.past = {k: np.full(len(x), 1e-3, _F4) for k, x in vars(self.m).items()}
        self.seen = np.zeros(len(model.context))

    @staticmethod
    def _contrast(real: np.ndarray, fake: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients for the scores of the true examples, and of the noise; ``fake`` is used up."""
        np.clip(fake, -30, 30, out=fake)
        np.negative(fake, out=fake)
        np.exp(fake, out=fake)
        fake += 1
        np.divide(_F4(GRADIENT_SCALE), fake, out=fake)
        return _F4(-GRADIENT_SCALE) / (1 + np.exp(np.clip(real, -30, 30))), fake

    def step(self, ids: np.ndarray) -> None:
        """One step on the tokens of ``ids`` after the first ``SPAN``."""
        m, v = self.m, self.v
        n = len(ids) - SPAN
        everything = order_of(ids)
        held = m.context.take(ids, axis=0)
        order = everything[everything >= SPAN] - SPAN
        target = ids[SPAN:].take(order)
        live = int(np.searchsorted(target, v.start))
        if not live:
            return
        order, target = order[:live], target[:live]
        q, cls = m.predicted(held).take(order, axis=0), v.class_of.take(target)
        # classes
        noise = np.minimum(np.searchsorted(self.cumulative, self.random.random(NOISE)), len(self.cumulative) - 1)
        true, false = m.classes.take(cls, axis=0), m.classes[noise]
        real = np.einsum("ij,ij->i", q, true) + (m.class_bias - self.log_noise).take(cls)
        real, fake = self._contrast(real, q @ false.T + (m.class_bias - self.log_noise)[noise])
        g_q = real[:, None] * true
        g_q += fake @ false
        edges = runs(cls)
        at = cls.take(edges[:-1])
        g_class, g_bias = np.zeros_like(m.classes), np.zeros_like(m.class_bias)
        g_class[at] = np.add.reduceat(real[:, None] * q, edges[:-1], axis=0)
        g_bias[at] = np.add.reduceat(real, edges[:-1])
        np.add.at(g_class, noise, fake.T @ q)
        np.add.at(g_bias, noise, fake.sum(0))
        # outputs within their classes
        true_out, offset = m.output.take(target, axis=0), (m.bias - self.log_within)
        true_offset = offset.take(target)
        g_out, g_off = np.zeros((live, WIDTH), _F4), np.zeros(live, _F4)
        rows, drawn, drawn_bias = [], [], []
        for a, b, c in zip(edges[:-1].tolist(), edges[1:].tolist(), at.tolist(), strict=True):
            lo, hi = v.starts[c], v.starts[c + 1]
            if hi - lo < 2:
                continue
            low, high = (self.within[lo - 1] if lo else 0.0), self.within[hi - 1]
            picks = lo + np.minimum(np.searchsorted(self.within[lo:hi], low + (high - low) * self.random.random(CLASS_NOISE)), hi - lo - 1)
            false, true, x = m.output[picks], true_out[a:b], q[a:b]
            real, fake = self._contrast(np.einsum("ij,ij->i", x, true) + true_offset[a:b], x @ false.T + offset[picks])
            g_q[a:b] += real[:, None] * true
            g_q[a:b] += fake @ false
            np.multiply(real[:, None], x, out=g_out[a:b])
            g_off[a:b] = real
            rows.append(picks)
            drawn.append(fake.T @ x)
            drawn_bias.append(fake.sum(0))
        # back to the words of the contexts: each place adds up what it did for the tokens after it
        back = np.zeros((n, WIDTH), _F4)
        back[order] = g_q
        g_context, g_position = np.zeros((len(ids), WIDTH), _F4), np.empty_like(m.position)
        for d in range(1, SPAN + 1):
            g_context[SPAN - d : SPAN - d + n] += m.position[d - 1] * back
            g_position[d - 1] = np.einsum("ij,ij->j", back, held[SPAN - d : SPAN - d + n])
        starts = runs(ids.take(everything))[:-1]
        self._down("context", ids.take(everything.take(starts)), np.add.reduceat(g_context.take(everything, axis=0), starts, axis=0))
        if rows:
            starts = runs(target)[:-1]
            rows = np.concatenate([target.take(starts), *rows])
            g = np.concatenate([np.add.reduceat(g_out, starts, axis=0), *drawn])
            g_off = np.concatenate([np.add.reduceat(g_off, starts), *drawn_bias])
            again = order_of(rows)
            starts = runs(rows.take(again))[:-1]
            used = rows.take(again.take(starts))
            self._down("output", used, np.add.reduceat(g.take(again, axis=0), starts, axis=0))
            self._down("bias", used, np.add.reduceat(g_off.take(again), starts), 0.3)
        every = np.arange(len(g_bias))
        self._down("classes", every, g_class)
        self._down("class_bias", every, g_bias, 0.3)
        self._down("position", np.arange(SPAN), g_position, 0.1)
        starts = runs(target)[:-1]
        self.seen[target.take(starts)] += np.diff(np.append(starts, live))

    def _down(self, name: str, rows: np.ndarray, gradient: np.ndarray, share: float = 1.0) -> None:
        """One step of distinct rows down their gradients."""
        past, matrix = self.past[name], getattr(self.m, name)
        past[rows] += (gradient**2).mean(1) if gradient.ndim == 2 else gradient**2
        size = _F4(share * self.rate) / np.sqrt(past[rows])
        matrix[rows] -= size[:, None] * gradient if gradient.ndim == 2 else size * gradient


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every whole text as the outputs of its tokens, with what counts alone give; texts are cut into words here and not again.

    Returns ``id_col, keep..., row, n_tokens, n_known, base, share, rare, ids``: a number of the row,
    the tokens with broadcast counts, the sum of their log10 counts plus one, the logarithm of the
    shares of words without outputs of their own, and the words without a broadcast count.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    complete = len(vocabulary.words) >= vocabulary.distinct
    kinds = dict(docs.dtypes)
    names = (id_col, *[c for c in keep if c != id_col])
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def apply(batches):
        v = shared.value
        if not hasattr(v, "place"):
            v.prepare()
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for text in as_bytes(batch.column("__text")):
                words = tokens(text)
                place, output, share = v.encode(words)
                known = place >= 0
                rare = [] if complete else [{"word": w, "n": n} for w, n in Counter([words[i] for i in np.flatnonzero(~known)]).items()]
                out.append((number, len(words), int(known.sum()), float(v.log_count[place[known]].sum()), share, rare, output))
                number += 1
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rare_type, pa.list_(pa.int32()))
            yield batch_of((*names, "row", "n_tokens", "n_known", "base", "share", "rare", "ids"), (*[batch.column(c).type for c in names], *types), (*[batch.column(c) for c in names], *map(list, columns)))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", row long, n_tokens long, n_known long, base double, share double, rare array<struct<word: binary, n: long>>, ids array<int>"
    return docs.select(*names, F.col(text_col).alias("__text")).mapInArrow(apply, schema)


def joined(column: pa.Array, start: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' outputs in one array, ``SPAN`` starts before each, and the number of the text that each belongs to."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy()
    ids = np.full(len(flat) + SPAN * len(lengths), start, np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths + SPAN)
    ids[np.arange(len(flat)) + SPAN * (np.repeat(np.arange(len(lengths)), lengths) + 1)] = flat
    return ids, owner


def train(encoded: DataFrame, vocabulary: Vocabulary, seed: int = 3, rate: float = 0.2) -> Model:
    """Train on every token of ``encoded``: each task steps through its own, and the tasks' models are averaged.

    The rounds are parts of one pass: each takes the rows that a hash deals to it, whole, and starts
    at the mean of the last. A row of parameters is averaged by how often its output was met in each
    task, so tasks that never saw a word do not blur its vectors. Means are by blocks of rows in two
    levels, so no task or driver holds one model a task.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    model = first_model(vocabulary, seed)
    words = spark.sparkContext.broadcast(vocabulary)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def learn(batches, shared=shared, turn=turn):
            part, v = TaskContext.get().partitionId(), words.value
            trainer = Trainer(shared.value, v, rate / (1 + turn), np.random.default_rng([seed, turn, part]))
            held, n = [], 0

            def flush(least: int):
                nonlocal held, n
                x = np.concatenate(held)
                at = 0
                while len(x) - at - SPAN >= least:
                    trainer.step(x[at : at + SPAN + BATCH])
                    at = min(at + BATCH, len(x) - SPAN)
                    if at == len(x) - SPAN:
                        break
                held, n = [x[at:]], len(x) - at

            for batch in batches:
                if batch.num_rows:
                    ids, _ = joined(batch.column(0), v.start)
                    held.append(ids)
                    n += len(ids)
                    if n > 4 * BATCH:
                        flush(BATCH)
            if n > SPAN:
                flush(1)
            if trainer.seen.any():
                yield _parts(trainer.m, trainer.seen, part)

        def mean(table):
            total, weight = 0.0, 0.0
            for w, x in zip(table["weight"].to_pylist(), table["values"].to_pylist(), strict=True):
                w, x = np.frombuffer(w, "<f4").astype(np.float64), np.frombuffer(x, "<f2").astype(np.float64)
                total, weight = total + w[:, None] * x.reshape(len(w), -1), weight + w
            value = (total / weight[:, None]).astype("<f2")
            return pa.table({"block": table["block"][:1], "salt": pa.array([0]), "weight": pa.array([weight.astype("<f4").tobytes()]), "values": pa.array([value.tobytes()])})

        schema = "block long, salt long, weight binary, values binary"
        own = encoded.where(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(ROUNDS)) == turn).select("ids")
        found = own.mapInArrow(learn, schema).groupBy("block", "salt").applyInArrow(mean, schema).groupBy("block").applyInArrow(mean, schema)
        model = _put({r.block: r["values"] for r in found.select("block", "values").toLocalIterator()}, model)
    return model


def _parts(m: Model, seen: np.ndarray, part: int) -> pa.RecordBatch:
    """A task's model as blocks of rows in half precision with their weights; the last block is that of classes and distances."""
    rows = np.concatenate([m.context, np.concatenate([m.output, np.zeros((1, WIDTH), _F4)]), np.append(m.bias, _F4(0))[:, None]], axis=1)
    rest = np.concatenate([m.classes.ravel(), m.class_bias, m.position.ravel()])[None, :]
    blocks = [(seen[i : i + AVERAGED_ROWS] + 1e-3, rows[i : i + AVERAGED_ROWS]) for i in range(0, len(rows), AVERAGED_ROWS)]
    blocks.append((np.array([seen.sum()]), rest))
    columns = [pa.array(range(len(blocks))), pa.array([part % 64] * len(blocks)), pa.array([w.astype("<f4").tobytes() for w, _ in blocks], pa.binary()), pa.array([x.astype("<f2").tobytes() for _, x in blocks], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "salt", "weight", "values"])


def _put(parts: dict[int, bytes], last: Model) -> Model:
    """The model of averaged blocks; without any, the last one."""
    if not parts:
        return last
    found = [np.frombuffer(parts[k], "<f2").astype(_F4) for k in sorted(parts)]
    rows = np.concatenate(found[:-1]).reshape(-1, 2 * WIDTH + 1)
    a, b = last.classes.size, last.classes.size + last.class_bias.size
    rest = found[-1]
    parts = (rows[:, :WIDTH], rows[:-1, WIDTH : 2 * WIDTH], rows[:-1, 2 * WIDTH], rest[:a].reshape(-1, WIDTH), rest[a:b], rest[b:].reshape(SPAN, WIDTH))
    return Model(*map(np.ascontiguousarray, parts))


def score(encoded: DataFrame, model: Model, vocabulary: Vocabulary, counts: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Score the texts of a written ``encoded`` by add-one unigrams (base) and by the model, in log10.

    Counts of words beyond those broadcast are joined by word: such a word is rare, so no key of
    that join is large. They raise the share of the word within its ending as they do the base.

    Returns ``keep..., n_tokens, n_known, base_score, score``, a row for each of ``encoded``.
    """
    spark = encoded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model, vocabulary))
    log_all = math.log10(vocabulary.total + vocabulary.distinct + 1)

    kinds = dict(encoded.dtypes)
    names = (*keep, "row", "n_tokens", "n_known", "base", "share")

    def apply(batches):
        m, v = shared.value
        for batch in batches:
            found = np.zeros(batch.num_rows)
            if batch.num_rows:
                ids, owner = joined(batch.column("ids"), v.start)
                for i in range(SPAN, len(ids), BATCH):
                    p = m.log_probability(ids[i - SPAN : i + BATCH], v)
                    found += np.bincount(owner[i : i + BATCH], p, len(found))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found / math.log(10))], names=[*names, "found"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", found double"
    scored = encoded.select(*names, "ids").mapInArrow(apply, schema)
    extra, known = F.lit(0.0), F.lit(0)
    if len(vocabulary.words) < vocabulary.distinct:
        least = float(vocabulary.counts.min()) if len(vocabulary.counts) else math.inf
        others = counts.where(F.col("c") < least)
        more = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(others, "word")
        more = more.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
        scored = scored.join(more, "row", "left")
        extra, known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    base = F.col("base") + extra - F.col("n_tokens") * log_all
    return scored.select(*keep, "n_tokens", (F.col("n_known") + known).alias("n_known"), base.alias("base_score"), (F.col("found") + F.col("share") + extra).alias("score"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, seed: int = 3) -> DataFrame:
    """Learn from documents whose crc32 of the id as text does not leave ``held`` by ``folds``, and score all.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row for
    each row of ``docs``. A null or empty text is its end alone; a null id is not held out; without
    training rows the model is its start, unigrams of equal shares, and every word unknown; ids may
    repeat; an empty table gives no rows; other columns are not read.
    """
    require(docs, id=id_col, text=text_col)
    out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), out.alias("held_out"))
    counts = written(word_counts(own.where("not held_out")), "words")
    vocabulary = read_vocabulary(counts)
    encoded = written(encode_documents(own, vocabulary, "id", "text", keep=("held_out",)), "encoded")
    model = train(encoded.where("not held_out"), vocabulary, seed)
    scored = score(encoded, model, vocabulary, counts, ("id", "held_out"))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
