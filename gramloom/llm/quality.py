"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 for low quality, 1 for good quality but toxic, 2 for good and not toxic. With a score s that is
linear in hashed text features and ordered thresholds t0 < t1, P(grade > k) = 1 / (1 + exp(t_k - s)): the
weights are shared by all thresholds, and both thresholds are fitted with them. The expected grade is the sum of
these tail probabilities; a document is kept if P(grade >= 2) reaches the model's cut-off.

The cut-off comes from ratings that the fit doesn't see, every ``HELD``-th of the sample: the one that parts grade 2
from the others best there (clean ones kept less others kept, of each kind the share), in the middle of the gap
between the ratings on either side. Fewer than ``CROSSED`` ratings are all held out in turn, a fold at a time, since a
fifth of them is too few to part; the model is then fitted to all of them.

A word's features are its core (without punctuation at its ends), the core's first bytes (``HEADS``),
the punctuation at its end, whether it is in capitals, and whether it repeats the word before. Each is
hashed into ``BITS`` bits; a feature's value is its number
divided by the number of words and ``SMOOTH`` more, times ``SCALE``. Features in fewer
than ``LEAST`` rated texts have weight 0.

The model is fitted in one task, on at most ``sample`` rated documents, the ones with the smallest
hash of their id; the bound is a parameter, and what the fit costs doesn't grow with the input. Every
document is scored, by whole text, without a shuffle. Defined results: ratings that are null, or of
documents that don't exist, are not used; of several ratings the lowest grade counts; without any rating
all documents are kept (null probabilities); a null text is an empty one, whose score is 0; repeated rows
have repeated results; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table, unused, utf8
from ._text import Buffer, chunks, mix

BITS, HEADS, LEAST, SMOOTH, SAMPLE, STEPS, HELD, CROSSED = 20, (4, 6), 5, 20, 8000, 250, 5, 2000
#: Values of a word's features: core, heads, then punctuation, capitals and repetition, which a whole text may share.
SCALE = np.array([30.0, *[30.0] * len(HEADS), 2.0, 2.0, 2.0])
#: The prior on the distance of the thresholds: its strength, and its middle.
GAP = (1e-2, 4.0)


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, hashed features with a row for each word, first word of each text and one more), chunk by chunk."""
    for first, last in chunks(texts):
        buf = Buffer(texts[first:last])
        start, end, at = buf.words()
        raw = buf.raw
        letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128) | ((raw >= 48) & (raw <= 57))
        place = np.arange(len(raw))
        last_letter = np.maximum.accumulate(np.where(letter, place, -1))
        next_letter = np.minimum.accumulate(np.where(letter, place, len(raw))[::-1])[::-1]
        a, b = (np.minimum(next_letter[start], end), np.maximum(last_letter[end - 1] + 1, start)) if len(start) else (start, end)
        b = np.maximum(b, a)
        core, whole = buf.hash(a, b), buf.hash(start, end)
        heads = [buf.hash(a, np.minimum(b, a + k)) for k in HEADS]
        tail = buf.hash(b, end)
        upper = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
        small = np.concatenate(([0], np.cumsum((raw >= 97) & (raw <= 122))))
        capital = (upper[b] - upper[a] > 1) & (small[b] == small[a])
        same = np.concatenate(([False], whole[1:] == whole[:-1])) if len(whole) else np.empty(0, bool)
        kinds = [core, *heads, tail, capital.astype(np.uint64), same.astype(np.uint64)]
        yield first, np.stack([(mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int32) for k, h in enumerate(kinds)], 1), at


@dataclass
class Model:
    weights: np.ndarray
    thresholds: tuple[float, float]
    keep_at: float = 0.5

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, ids, at in features(texts):
            sums = np.concatenate(([0.0], np.cumsum(self.weights[ids] @ SCALE)))
            out[first : first + len(at) - 1] = (sums[at[1:]] - sums[at[:-1]]) / (np.diff(at) + SMOOTH)
        return out

    def tails(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_sigmoid(scores - t) for t in self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


#: Texts in order: their distinct features, the features' values, and where each text begins (one more at the end).
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def block_of(texts: list[bytes]) -> Block:
    cols, values, sizes = [np.empty(0, np.int32)], [np.empty(0, np.float32)], [0]
    for _, ids, at in features(texts):
        for a, b in zip(at[:-1], at[1:]):
            own, which = np.unique(ids[a:b], return_inverse=True)
            cols.append(own)
            values.append(np.bincount(which.ravel(), np.tile(SCALE / (b - a + SMOOTH), b - a), len(own)).astype(np.float32))
            sizes.append(len(own))
    return np.concatenate(cols), np.concatenate(values), np.cumsum(sizes)


def fit(grades: np.ndarray, blocks: list[Block], steps: int = STEPS, penalty: float = 1e-5) -> Model:
    """Maximum likelihood with a quadratic penalty on the weights, by limited-memory BFGS.

    Sums are taken block by block, so that they need little more memory than the blocks, 8 bytes a feature.
    """
    seen = np.zeros(1 << BITS, np.int32)
    for cols, _, at in blocks:
        seen += np.bincount(cols, minlength=1 << BITS).astype(np.int32)
    names = np.flatnonzero(seen >= LEAST)
    number = np.full(1 << BITS, -1, np.int32)
    number[names] = np.arange(len(names))
    n, m, first = len(grades), len(names), 0
    own = []
    while blocks:
        cols, values, at = blocks.pop(0)
        new = number[cols]
        used = new >= 0
        own.append((first, new[used], values[used], np.concatenate(([0], np.cumsum(used)))[at]))
        first += len(at) - 1

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        """Of the weights, t1 and log(t1 - t0), with its gradient."""
        w, gap = x[:m], np.exp(x[m + 1])
        s = np.zeros(n)
        for k, cols, values, at in own:
            sums = np.concatenate(([0.0], np.cumsum(w[cols] * values)))
            s[k : k + len(at) - 1] = sums[at[1:]] - sums[at[:-1]]
        value, by0, by1 = likelihood(s, grades, x[m] - gap, x[m])
        g_w = penalty * w
        for k, cols, values, at in own:
            g_w += np.bincount(cols, np.repeat((by0 + by1)[k : k + len(at) - 1], np.diff(at)) * values, minlength=m)
        far = x[m + 1] - np.log(GAP[1])
        return value + penalty / 2 * w @ w + GAP[0] / 2 * far**2, np.concatenate((g_w, [-by0.sum() - by1.sum(), by0.sum() * gap + GAP[0] * far]))

    top = (np.sum(grades == 2) + 1) / (n + 2)
    x = np.concatenate((np.zeros(m), [np.log((1 - top) / top), np.log(GAP[1])]))
    f, g = loss(x)
    memory: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = -g, []
        for ds, dg, rho in reversed(memory):
            kept.append(rho * (ds @ d))
            d = d - kept[-1] * dg
        if memory:
            d = d * (memory[-1][0] @ memory[-1][1]) / (memory[-1][1] @ memory[-1][1])
        for (ds, dg, rho), a in zip(memory, reversed(kept)):
            d = d + ds * (a - rho * (dg @ d))
        slope, size = g @ d, 1.0 if memory else 1.0 / max(1e-12, np.abs(g).max())
        while size > 1e-10:
            f1, g1 = loss(x + size * d)
            if f1 <= f + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        ds, dg = size * d, g1 - g
        if ds @ dg > 1e-12:
            memory = [*memory[-9:], (ds, dg, 1 / (ds @ dg))]
        done = f - f1 < 1e-7 * max(1.0, f)
        x, f, g = x + ds, f1, g1
        if done:
            break
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = x[:m]
    return Model(weights, (float(x[m] - np.exp(x[m + 1])), float(x[m])))


def likelihood(s: np.ndarray, grades: np.ndarray, t0: float, t1: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of grades at scores, and its derivatives by s - t0 and by s - t1."""
    p0, p1, n = _sigmoid(s - t0), _sigmoid(s - t1), max(1, len(s))
    like = np.maximum(np.select([grades == 0, grades == 1], [1 - p0, p0 - p1], p1), 1e-12)
    by0 = np.select([grades == 0, grades == 1], [1.0, -1.0], 0.0) / like * p0 * (1 - p0) / n
    by1 = np.select([grades == 1, grades == 2], [1.0, -1.0], 0.0) / like * p1 * (1 - p1) / n
    return float(-np.log(like).sum() / n), by0, by1


def cut_off(clean: np.ndarray, grades: np.ndarray) -> float:
    """The probability of grade 2 that parts it best from the others; 0.5 if there is nothing to part."""
    good, n = grades == 2, len(grades)
    if not good.any() or good.all():
        return 0.5
    order = np.argsort(clean, kind="stable")
    # gain of keeping what stands at each place and after
    gain = np.append(np.cumsum((good[order] / good.sum() - ~good[order] / (~good).sum())[::-1])[::-1], 0.0)
    sorted_ = clean[order]
    may = np.flatnonzero(np.concatenate(([True], sorted_[1:] > sorted_[:-1])))  # equal ones stay together
    k = may[gain[may].argmax()]
    return float((sorted_[k - 1] + sorted_[k]) / 2) if k else float(sorted_[0] / 2)


def _fitted(rated: DataFrame, steps: int) -> DataFrame:
    """(cols, weights, t0, t1, keep_at) of a model fitted to the texts (grade, text) of one partition, in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen = [], 0
        for batch in batches:
            for k in range(0, len(batch), 250):
                part = batch.slice(k, 250)
                texts = [x.encode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
                parts.append((block_of(texts), part.column(0).to_pylist(), seen))
                seen += len(texts)
        if seen:
            model, keep_at = fitted(parts, steps)
            cols = np.flatnonzero(model.weights).astype("<i4")
            row = (cols.tobytes(), model.weights[cols].astype("<f4").tobytes(), *model.thresholds, keep_at)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["cols", "weights", "t0", "t1", "keep_at"])

    return rated.mapInArrow(run, "cols binary, weights binary, t0 double, t1 double, keep_at double")


#: A block, its texts' grades, and the number of its first text.
Part = tuple[Block, list[int], int]


def fitted(parts: list[Part], steps: int = STEPS) -> tuple[Model, float]:
    """A model and its cut-off; ``parts`` is used up."""
    if sum(len(grade) for _, grade, _ in parts) >= CROSSED:
        blocks, grades, held, own = _split(parts, HELD - 1, spend=True)
        model = fit(np.array(grades), blocks, steps)
        return model, cut_off(_clean(model, held), np.array(own))
    clean, graded = [np.empty(0)], []
    for fold in range(HELD):
        blocks, grades, held, own = _split(parts, fold)
        if grades and own:
            clean.append(_clean(fit(np.array(grades), blocks, steps), held))
            graded += own
    every = [g for _, grade, _ in parts for g in grade]
    return fit(np.array(every), [block for block, _, _ in parts], steps), cut_off(np.concatenate(clean), np.array(graded, np.int64))


def _split(parts: list[Part], fold: int, spend: bool = False) -> tuple[list[Block], list[int], list[Block], list[int]]:
    """Blocks and grades of the texts outside a fold, then of those in it; ``spend`` frees each part when it is split."""
    blocks, grades, held, own = [], [], [], []
    for i in range(len(parts)):
        block, grade, first = parts.pop(0) if spend else parts[i]
        apart = [(first + j) % HELD == fold for j in range(len(grade))]
        for chosen, to, marks in ((apart, held, own), ([not x for x in apart], blocks, grades)):
            some, theirs = _some(block, grade, chosen)
            to.append(some)
            marks += theirs
    return blocks, grades, held, own


def _clean(model: Model, blocks: list[Block]) -> np.ndarray:
    """The probability of grade 2 of each text of the blocks."""
    return model.tails(np.concatenate([_block_scores(block, model.weights) for block in blocks]))[1]


def _some(block: Block, grades: list[int], chosen: list[bool]) -> tuple[Block, list[int]]:
    """The chosen texts of a block, and their grades."""
    cols, values, at = block
    which = np.array(chosen, bool)
    inside = np.repeat(which, np.diff(at))
    return (cols[inside], values[inside], np.concatenate(([0], np.cumsum(np.diff(at)[which])))), [g for g, x in zip(grades, chosen) if x]


def _block_scores(block: Block, weights: np.ndarray) -> np.ndarray:
    cols, values, at = block
    sums = np.concatenate(([0.0], np.cumsum(weights[cols] * values)))
    return sums[at[1:]] - sums[at[:-1]]


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> Model | None:
    """A model from ``ratings`` (doc_id, quality, toxic) of ``docs`` (doc_id, text); None without any rating."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") != 0, 1).otherwise(2)
    rated = ratings.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    # half as many again, for ratings whose document is missing
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample * 3 // 2)
    texts = docs.select("doc_id", utf8(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    found = _fitted(texts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("grade").cast("int"), "text").coalesce(1), steps).collect()
    if not found:
        return None
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(found[0]["cols"], "<i4")] = np.frombuffer(found[0]["weights"], "<f4")
    return Model(weights, (found[0]["t0"], found[0]["t1"]), found[0]["keep_at"])


def score(docs: DataFrame, model: Model | None, keep_at: float | None = None, text_col: str = "text", names: Sequence[str] = ("expected_grade", "p_usable", "p_clean", "keep")) -> DataFrame:
    """Adds expected_grade, p_usable (grade >= 1), p_clean (grade >= 2) and keep to every row, in place of columns of these names; ``keep_at`` in place of the model's cut-off."""
    added = list(names)
    docs = docs.drop(*added)
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in added[:3]}).withColumn(added[3], F.lit(True))
    bar = model.keep_at if keep_at is None else keep_at
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added[:3]), T.StructField(added[3], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                texts = [(x or "").encode("utf-8", "surrogatepass") for x in part.column(at).to_pylist()]
                usable, clean = m.tails(m.scores(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(usable + clean), pa.array(usable), pa.array(clean), pa.array(clean >= bar)], [*part.schema.names, *added])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model | None, keep_at: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows that the model keeps, with their own columns only."""
    names = unused(docs, "_grade", "_usable", "_clean", "_keep")
    return score(docs, model, keep_at, text_col, names).filter(F.col(names[3])).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels"))).drop("text")
