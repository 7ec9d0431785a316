"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealmark.llm import text as tx
from sealmark.scratch import written

GRAMS = (3, 4, 5, 6)
BITS = 22
#: Labelled rows that a fit reads at most, taken in the order of a hash of their ids.
MAX_FIT_ROWS = 20_000
#: Features kept: all whose log-count ratio is this many standard errors from 0.
LEAST_Z = 3.0


def gram_hashes(texts: pa.Array):
    """For each n of GRAMS: feature number and row of every n-gram of the lower-cased texts, blanks as one space."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    texts = pc.replace_substring_regex(pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(" "), ""), r"[\x20\x09-\x0D]+", " ")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data, _ = tx.raw(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # characters up to the row's end
    with np.errstate(over="ignore"):
        h = points * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + points[n - 1 :] if len(h) > 1 else h[:0]
            if n in GRAMS:
                yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS), left[: len(h)] >= n, ends


def held_out(ids) -> np.ndarray:
    """crc32(id as text) mod 4 is 2; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2 for i in ids], bool)


def _hits(texts: pa.Array, wanted: np.ndarray | None):
    """Distinct (row, feature) pairs; wanted: a boolean per feature."""
    rows, features = [], []
    for feature, whole, ends in gram_hashes(texts):
        ok = whole if wanted is None else whole & wanted[feature]
        at = np.flatnonzero(ok)
        rows.append(np.searchsorted(ends, at, side="right"))
        features.append(feature[at])
    pairs = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(features))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, pos, neg): in how many toxic and other documents of the sample each n-gram feature is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, to, texts in tx.slices(batch.column(0), 1 << 20):
                rows, features = _hits(texts, None)
                for toxic in (0, 1):
                    counts[toxic] += np.bincount(features[labels[at:to][rows] == toxic], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(counts.sum(0))
        for k in range(0, len(some), 1 << 18):
            part = some[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[1, part]), pa.array(counts[0, part])], ["feature", "pos", "neg"])

    counts = sample.select("text", "toxic").mapInArrow(work, "feature int, pos int, neg int")
    return counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


class Model:
    """Weights of the kept features, and an intercept."""

    def __init__(self, features=(), weights=(), intercept=0.0):
        self.features, self.weights, self.intercept = np.asarray(features, np.int64), np.asarray(weights, np.float64), float(intercept)

    def scores(self, texts: pa.Array) -> np.ndarray:
        table = np.zeros(1 << BITS)
        table[self.features] = self.weights
        return self._scores(texts, table, table != 0)

    def _scores(self, texts, table, wanted) -> np.ndarray:
        rows, features = _hits(texts, wanted)
        total = np.bincount(rows, weights=table[features], minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


#: Entries of the sample that a task looks at in one go.
BLOCK_ENTRIES = 1 << 20


def _sums(coded: DataFrame, weights: np.ndarray, intercept: float) -> tuple[float, float, np.ndarray]:
    """Summed log loss over coded (toxic, hits), and its slopes by the intercept and by each weight; one row a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, by_intercept, by_weight = 0.0, 0.0, np.zeros(len(weights))
        for batch in batches:
            y, lists = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), batch.column(1)
            starts, cols = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, max(starts[-1], 1), BLOCK_ENTRIES)), len(y))).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, sizes = cols[starts[a] : starts[b]], np.diff(starts[a : b + 1])
                s = np.bincount(np.repeat(np.arange(b - a), sizes), weights=weights[own], minlength=b - a) + intercept
                loss += float((np.logaddexp(0, s) - y[a:b] * s).sum())
                g = 1 / (1 + np.exp(-np.clip(s, -60, 60))) - y[a:b]
                by_weight += np.bincount(own, weights=np.repeat(g, sizes), minlength=len(weights))
                by_intercept += float(g.sum())
        yield pa.RecordBatch.from_pydict({"loss": [loss], "by_intercept": [by_intercept], "by_weight": [by_weight.tobytes()]})

    total = [0.0, 0.0, np.zeros(len(weights))]
    for r in coded.mapInArrow(work, "loss double, by_intercept double, by_weight binary").collect():
        total = [total[0] + r.loss, total[1] + r.by_intercept, total[2] + np.frombuffer(bytes(r.by_weight))]
    return tuple(total)


def _solve(coded: DataFrame, ratios: np.ndarray, pos: int, neg: int, penalty: float, steps: int = 300, precision: float = 1e-4):
    """Logistic regression by limited-memory BFGS; feature f has the value ratios[f], the intercept isn't penalised.

    Each step sums loss and gradient in Spark; the driver holds vectors as long as the weights alone. It ends when
    the gradient is `precision` of its first length, or after `steps` sums.
    """
    n = pos + neg

    def at(x: np.ndarray):
        loss, by_intercept, by_weight = _sums(coded, x[:-1] * ratios, float(x[-1]))
        return loss / n + penalty / 2 * float(x[:-1] @ x[:-1]), np.append(by_weight * ratios / n + penalty * x[:-1], by_intercept / n)

    x = np.append(np.zeros(len(ratios)), np.log((pos + 1) / (neg + 1)))
    f, g = at(x)
    done, goal, pairs = 1, precision * np.linalg.norm(g), deque(maxlen=8)
    while np.linalg.norm(g) > goal and done < steps:
        d, used = -g, []
        for s, y in reversed(pairs):
            used.append(s @ d / (s @ y))
            d = d - used[-1] * y
        d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]) if pairs else min(1.0, 1 / np.abs(g).sum()))
        for (s, y), k in zip(pairs, reversed(used)):
            d = d + (k - y @ d / (s @ y)) * s
        rate, slope = 1.0, g @ d
        to, (f1, g1) = x + d, at(x + d)
        done += 1
        while f1 > f + 1e-4 * rate * slope and done < steps:
            rate /= 2
            to, (f1, g1) = x + rate * d, at(x + rate * d)
            done += 1
        if f1 >= f:
            break
        if (to - x) @ (g1 - g) > 0:
            pairs.append((to - x, g1 - g))
        x, f, g = to, f1, g1
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS, penalty: float = 1e-4) -> Model:
    """Fit on labelled rows outside the held-out quarter.

    Features are n-grams present in a text. Each is scaled by its naive Bayes log-count ratio, over the sample's
    documents; those whose ratio is not far from 0 by its standard error are dropped, then logistic regression
    weighs the rest. The sample is bounded by max_rows; kept features and weights reach the driver, rows don't.
    With no labels of one kind the score is the smoothed share of toxic rows. Null labels and ids are left out, an id
    labelled both ways is toxic; equal hashes of ids are taken in order of the ids.
    """
    mine = labels.select(F.col(id_col).alias("fit_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and fit_id is not null")
    mine = mine.where(F.pmod(F.crc32(F.col("fit_id").cast("string").cast("binary")), F.lit(4)) != 2)
    mine = mine.groupBy("fit_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("fit_id"), "fit_id").limit(max_rows)
    chosen = F.broadcast(written(mine, "fit-rows"))  # at most max_rows ids
    texts = docs.join(chosen, docs[id_col] == chosen["fit_id"]).select("fit_id", F.col(text_col).cast("string").alias("text"), "toxic")
    sample = written(texts.repartition(8, "fit_id"), "fit-texts")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    prior = float(np.log((pos + 1) / (neg + 1)))
    if not pos or not neg:
        return Model(intercept=prior)
    p, q = F.col("pos") + 1.0, F.col("neg") + 1.0
    ratio = F.log(p / (pos + 2.0)) - F.log(q / (neg + 2.0))
    z = F.abs(ratio) / F.sqrt(1 / p + 1 / q)
    kept = _feature_counts(sample).select("feature", ratio.alias("ratio"), z.alias("z")).where(F.col("z") >= LEAST_Z)
    kept = kept.select("feature", "ratio").toPandas().sort_values("feature")
    if kept.empty:
        return Model(intercept=prior)
    features, ratios = kept["feature"].to_numpy(np.int64), kept["ratio"].to_numpy()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << BITS, bool)
        own[features] = True
        for batch in batches:
            for at, to, texts in tx.slices(batch.column(0), 1 << 20):
                rows, hits = _hits(texts, own)
                lists = pa.ListArray.from_arrays(pa.array(tx.runs(rows, to - at).astype(np.int32)), pa.array(np.searchsorted(features, hits).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, to - at), lists], ["toxic", "hits"])

    coded = written(sample.select("text", "toxic").mapInArrow(encode, "toxic int, hits array<int>"), "fit-hits")
    w, b = _solve(coded, ratios, pos, neg, penalty)
    return Model(features, w * ratios, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted): every row's score from its text alone.

    Null, empty and blank texts have no n-grams of weight: they get the intercept's score. Null ids stay (not held
    out); repeated rows stay; an empty table gives no rows; other columns are not read. Very long texts are scored
    whole. Scores of equal texts are equal, so there are no ties to order.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[model.features] = model.weights
        wanted = table != 0
        for batch in batches:
            for at, to, texts in tx.slices(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(at, to - at)
                s = model._scores(texts, table, wanted)
                yield pa.RecordBatch.from_arrays([ids, pa.array(held_out(ids.to_pylist())), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")
