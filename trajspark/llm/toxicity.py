"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each later model also gets the log-odds that the models before it predict.
For training, those come from models that have not seen the row (out-of-fold predictions), so a later model learns how
far it can trust them; at prediction the models fitted on all rows feed the chain.

Features are the words that a text holds, and their first bytes (compounds of one stem share them), hashed into
SLOTS. Each model takes the FEATURES slots whose presence differs most between the classes, and is a logistic regression
with a penalty on absolute weights, so slots of no use get the weight zero.

The models are fitted on a bounded sample of the labelled rows: at most `per_class` of each value of the last category,
those with the smallest hash of their id. Scoring is one pass over the texts without a shuffle.

Defined results: a null or empty text has no features and gets the model's base rate. Labels with a null are not used; of
labels that repeat an id, the greatest counts. Without both values of a category among the labels, its probability is
the share of ones (0 without labels). Rows without an id are scored too. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textops import MARKS, U64, Words, batches, mix

SLOTS = 1 << 18
PREFIXES = (4, 5)  # bytes
FEATURES = 512
FOLDS = 4
STEPS = 200
PENALTY = 0.006
RIDGE = 0.0003
PER_CLASS = 5000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of all word occurrences: of each word itself and of its prefixes."""
    words = Words(texts, MARKS)
    hashes = [words.hashes(), *[mix(words.hashes(n) ^ U64(0xA0761D6478BD642F + n)) for n in PREFIXES]]
    slot = (np.concatenate(hashes) % U64(SLOTS)).astype(np.int64)
    return np.tile(words.row, len(hashes)), slot


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def descend(x: np.ndarray, y: np.ndarray, w: np.ndarray, absolute: float = 0.0, square: float = 0.0) -> np.ndarray:
    """Accelerated proximal gradient descent on the mean log loss; the last column is the bias, without a penalty."""
    n = len(y)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # largest eigenvalue, for the step size
        v = x.T @ (x @ v)
        norm = float(np.linalg.norm(v))
        v /= norm
    step = 1 / (norm / (4 * n) + square)
    keep = np.ones(len(w), np.float32)
    keep[-1] = 0
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        gradient = x.T @ (sigmoid(x @ ahead) - y).astype(np.float32) / n + square * keep * ahead
        new = ahead - step * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - step * absolute * keep, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return w


class Linear:
    """Sparse logistic regression on presence of slots and on dense extra columns."""

    def __init__(self, row: np.ndarray, slot: np.ndarray, extra: np.ndarray, y: np.ndarray):
        """row, slot: distinct pairs; extra: rows x columns."""
        n, ones = len(y), int(y.sum())
        self.weights, self.extra_weights, self.slots = np.zeros(0), np.zeros(extra.shape[1]), np.zeros(0, np.int64)
        self.bias = float(np.log(max(ones, 1e-6) / max(n - ones, 1e-6))) if n else -35.0
        if not 0 < ones < n:
            return
        with_one = np.bincount(slot[y[row] == 1], minlength=SLOTS) / ones
        without = np.bincount(slot[y[row] == 0], minlength=SLOTS) / (n - ones)
        p = np.bincount(slot, minlength=SLOTS) / n
        z = np.abs(with_one - without) / np.sqrt(p * (1 - p) * (1 / ones + 1 / (n - ones)) + 1e-9)
        self.slots = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
        x = np.zeros((n, FEATURES + extra.shape[1] + 1), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.slots, slot), FEATURES - 1)
        hit = self.slots[at] == slot
        x[row[hit], at[hit]] = 1
        x[:, FEATURES:-1] = extra
        x[:, -1] = 1
        w = np.zeros(x.shape[1], dtype=np.float32)
        w[-1] = self.bias
        w = descend(x, y, w, absolute=PENALTY)
        used = np.flatnonzero(w)  # what the penalty has kept is fitted again without its shrinkage
        w[used] = descend(x[:, used], y, w[used], square=RIDGE)
        self.weights, self.extra_weights, self.bias = w[:FEATURES], w[FEATURES:-1], float(w[-1])

    def predict(self, row: np.ndarray, slot: np.ndarray, extra: np.ndarray) -> np.ndarray:
        dense = np.zeros(SLOTS, dtype=np.float32)
        dense[self.slots] = self.weights
        score = np.bincount(row, weights=dense[slot], minlength=len(extra))
        return sigmoid(score + extra @ self.extra_weights + self.bias)


def distinct(row: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * SLOTS + slot)
    return both // SLOTS, both % SLOTS


def fit_chain(row: np.ndarray, slot: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model for each column of y, in order; each sees out-of-fold log-odds of the columns before."""
    n, k = y.shape
    extra, models = np.zeros((n, 0)), []
    for c in range(k):
        models.append(Linear(row, slot, extra, y[:, c]))
        if c + 1 < k:
            held_out = np.zeros(n)
            for f in range(FOLDS):
                out = fold == f
                number = np.cumsum(~out) - 1
                seen = ~out[row]
                part = Linear(number[row[seen]], slot[seen], extra[~out], y[~out, c])
                held_out[out] = part.predict(row, slot, extra)[out]
            extra = np.column_stack([extra, log_odds(held_out)])
    return models


def labelled_sample(labels: DataFrame, categories: dict[str, Column], id_col: str, per_class: int) -> DataFrame:
    """(id, category columns): at most per_class rows of each value of the last category."""
    y = labels.select(F.col(id_col).alias("_label_id"), *[v.cast("int").alias(k) for k, v in categories.items()])
    y = y.na.drop().groupBy("_label_id").agg(*[F.max(k).alias(k) for k in categories])
    order = F.xxhash64("_label_id")
    parts = [y.where(F.col([*categories][-1]) == v).orderBy(order, "_label_id").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, per_class: int
) -> list[dict]:
    """The chain's models, fitted by one task on the sample (2 * per_class rows at most)."""
    names = [*categories]
    sample = labelled_sample(labels, categories, id_col, per_class)
    joined = docs.select(F.col(id_col).alias("_label_id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "_label_id"
    )

    def featured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches("text", stream):
            row, slot = distinct(*features(batch.column(1)))
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            slots = pa.ListArray.from_arrays(pa.array(at), pa.array(slot.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *batch.columns[2:], slots], ["id", *names, "slots"]
            )

    def fitted(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids = rows.column("id").to_numpy()
        slots = pa.concat_arrays(rows.column("slots").chunks or [pa.array([], pa.list_(pa.int32()))])
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(slots).to_numpy(zero_copy_only=False))
        slot = slots.flatten().to_numpy().astype(np.int64)
        y = np.column_stack([rows.column(c).to_numpy() for c in names])
        fold = (mix(ids.astype(np.int64).view(U64)) % U64(FOLDS)).astype(int)
        models = fit_chain(row, slot, y, fold)
        return pa.Table.from_pylist(
            [
                {"c": c, "slots": m.slots.tolist(), "weights": [float(w) for w in m.weights],
                 "extra": [float(w) for w in m.extra_weights], "bias": m.bias}
                for c, m in enumerate(models)
            ],
            schema=pa.schema([("c", pa.int32()), ("slots", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())),
                              ("extra", pa.list_(pa.float64())), ("bias", pa.float64())]),
        )

    columns = ", ".join(f"`{c}` int" for c in names)
    rows = joined.select("_label_id", "text", *names).mapInArrow(featured, f"id long, {columns}, slots array<int>")
    models = rows.groupBy().applyInArrow(
        fitted, "c int, slots array<long>, weights array<double>, extra array<double>, bias double"
    )
    return [r.asDict() for r in models.orderBy("c").collect()]


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = PER_CLASS,
) -> DataFrame:
    """docs with a column p_<category> for each category, in the chain's order.

    categories: name -> 0/1 expression over labels (id_col and label columns), in the order of prediction.
    """
    ship(docs.sparkSession)
    names = [*categories]
    models = train(docs, labels, categories, id_col, text_col, per_class)
    if not models:
        models = [{"slots": [], "weights": [], "extra": [0.0] * c, "bias": -35.0} for c in range(len(names))]
    kept = [c for c in docs.columns if c not in {f"p_{x}" for x in names}]

    def scored(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((len(models), SLOTS), dtype=np.float32)
        for c, m in enumerate(models):
            dense[c, m["slots"]] = m["weights"]
        useful = (dense != 0).any(axis=0)
        for batch in batches(text_col, stream):
            row, slot = features(batch.column(kept.index(text_col)))
            hit = useful[slot]
            row, slot = distinct(row[hit], slot[hit])
            extra = np.zeros((batch.num_rows, 0))
            out = []
            for c, m in enumerate(models):
                score = np.bincount(row, weights=dense[c][slot], minlength=batch.num_rows)
                p = sigmoid(score + extra @ np.asarray(m["extra"], dtype=float) + m["bias"])
                extra = np.column_stack([extra, log_odds(p)])
                out.append(pa.array(p))
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*kept, *[f"p_{x}" for x in names]])

    schema = docs.select(*kept).schema
    for x in names:
        schema = schema.add(f"p_{x}", "double")
    return docs.select(*kept).mapInArrow(scored, schema)


#: The chain for the labels at hand: junk first, as what makes a text junk says little about toxicity.
def label_categories() -> dict[str, Column]:
    return {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}


THRESHOLD = 0.6
