"""Quality by attention over passages: each passage is encoded, gated attention weighs them, the weighted sum is scored.

A document is a bag of passages of which only the whole has a label. Attention weights are learned from those labels.
Passages are described by what their bytes and words are like; the network is small and trained here, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, rolling, slices, split_words, table, word_hashes
from .labelled import held_out, training_rows

#: Words of a passage.
PASSAGE = 64
#: Labelled rows that are learned from, at most, for each label, and the passages of all of them together: rows are
#: taken whole, in order of a hash, while they fit. Steps and sizes of the network.
ROWS_PER_LABEL, TRAINING_PASSAGES = {0: 3_000, 1: 6_000}, 160_000
HIDDEN, GATES, STEPS, RATE = 16, 8, 400, 0.02
THRESHOLD = 0.3

_CLASSES = ("\n", " \t\r\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "#", "*", "$", "%", "&", "|", "<>", "-_=+", "'\"`", "/\\:@", "()[]{}", "?;")
_CLASS = np.full(256, len(_CLASSES), np.int64)  # other signs
for _i, _group in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _group]] = _i
_CLASS[128:] = len(_CLASSES) + 1
_N_CLASSES = len(_CLASSES) + 2
FEATURES = _N_CLASSES + 8


def passages(text: str | None) -> np.ndarray:
    """FEATURES numbers for each passage of a text; a text without words is one passage of zeros."""
    words = split_words(text)
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(words)
    count = -(-n // PASSAGE)
    starts = np.arange(count) * PASSAGE
    sizes = np.diff(np.append(starts, n))
    lengths = np.fromiter(map(len, words), np.int64, n)
    # the k-th passage ends with the last byte of its last word; white space before a word belongs to it
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.flatnonzero(~space & np.append(space[1:], True))[np.append(starts[1:], n) - 1] + 1
    of_byte = np.repeat(np.arange(count), np.diff(np.concatenate([[0], ends])))
    shares = np.bincount(of_byte * _N_CLASSES + _CLASS[raw[: len(of_byte)]], minlength=count * _N_CLASSES).reshape(count, _N_CLASSES)
    shares = shares / np.maximum(1, shares.sum(axis=1, keepdims=True))

    hashes = word_hashes(words)
    of_word = np.repeat(np.arange(count), sizes)
    same = np.append(False, hashes[1:] == hashes[:-1])
    order = np.lexsort((hashes, of_word))
    first = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1]))
    distinct = np.bincount(of_word[order][first], minlength=count)
    runs = rolling(hashes, 3)
    again = np.ones(n, np.bool_)
    if len(runs):
        again[: len(runs)][np.unique(runs, return_index=True)[1]] = False
    again[len(runs) :] = False
    mean = np.add.reduceat(lengths, starts) / sizes
    columns = [
        np.add.reduceat(same, starts, dtype=np.int64) / sizes,
        distinct / sizes,
        np.add.reduceat(again, starts, dtype=np.int64) / sizes,
        mean / 10,
        np.sqrt(np.maximum(0, np.add.reduceat(lengths**2, starts) / sizes - mean**2)) / 10,
        np.minimum(1, sizes / PASSAGE),
        np.full(count, np.log1p(n) / 10),
        np.ones(count),
    ]
    return np.column_stack([np.sqrt(shares), *columns]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
        """starts: where each document's passages begin; of: the document of each passage."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        s = (t * g) @ p["a"]
        e = np.exp(s - np.maximum.reduceat(s, starts)[of])
        weights = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(weights[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "weights": weights, "z": z, "out": _sigmoid(z @ p["c"] + p["d"])}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self.forward(x, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes))["out"]


def train(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS, seed: int = 11) -> AttentionModel:
    """Cross entropy by Adam on all documents at once, with a small weight decay."""
    sizes = np.array([len(b) for b in bags])
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)
    x = np.concatenate(bags).astype(np.float64)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    shapes = {"w": (x.shape[1], HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "d": ()}
    model = AttentionModel(mean, scale, {k: np.asarray(rng.normal(0, 1 / np.sqrt(s[0]) if s else 0, s)) for k, s in shapes.items()})
    p = model.p
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    weights = weights / weights.sum()
    for step in range(1, steps + 1):
        f = model.forward(x, starts, of)
        d_out = weights * (f["out"] - labels)
        d_z = d_out[:, None] * p["c"]
        d_h = f["weights"][:, None] * d_z[of]
        pull = (f["h"] * d_z[of]).sum(axis=1)
        d_s = f["weights"] * (pull - np.add.reduceat(f["weights"] * pull, starts)[of])
        d_tg = d_s[:, None] * p["a"]
        d_t, d_g = d_tg * f["g"] * (1 - f["t"] ** 2), d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h += d_t @ p["v"].T + d_g @ p["u"].T
        d_pre = d_h * (1 - f["h"] ** 2)
        grads = {"w": x.T @ d_pre, "b": d_pre.sum(axis=0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_g, "a": (f["t"] * f["g"]).T @ d_s, "c": f["z"].T @ d_out, "d": d_out.sum()}
        for k, grad in grads.items():
            grad = grad + 1e-4 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 64):
        found = [passages(text) for text in part.column(2).to_pylist()]
        bags = pa.array([bag.tobytes() for bag in found], pa.binary())
        yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([len(b) for b in found], pa.int64()), bags], ["doc_id", "label", "n", "bag"])


def learn_quality(docs: DataFrame, labels: DataFrame, rows_per_label: dict[int, int] = ROWS_PER_LABEL, passages_in_all: int = TRAINING_PASSAGES) -> AttentionModel:
    """A model of labels.quality from a bounded number of rows outside the held-out fold, each weighed as in all such rows.

    All passages of a row that is learned from count. Without rows of any label the model has one score for all.
    """
    rows = training_rows(docs, labels, "quality", rows_per_label)
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy(F.col("quality").cast("int").alias("label")).agg(F.count("*").alias("n"))
    bags = table(rows.select("doc_id", "label", "text").mapInArrow(_bags, "doc_id long, label int, n long, bag binary"), "bags")
    # at most as many rows as rows_per_label has
    line = Window.orderBy("turn", "doc_id", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = bags.withColumn("turn", F.xxhash64("doc_id")).withColumn("upto", F.sum("n").over(line))
    found = turns.filter(F.col("upto") <= passages_in_all).orderBy("turn", "doc_id", "n").select("label", "bag").toArrow()
    y = found.column(0).to_numpy().astype(np.float64)
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found.column(1).to_pylist()]
    if not bags:  # nothing to learn from: one neutral score for all
        bags, y = [np.zeros((1, FEATURES), np.float32)] * 2, np.array([0.0, 1.0])
    totals = {r["label"]: r["n"] for r in known.collect()}
    weights = np.array([max(1, totals.get(int(v), 1)) / max(1, (y == v).sum()) for v in y])
    return train(bags, y, weights)


def score_quality(docs: DataFrame, model: AttentionModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every text.

    One scan, no shuffle; all passages of every text count, however long it is. Null, empty and wordless texts are one
    empty passage. Repeated rows, repeated ids and null ids (which are held out) are scored each by itself; other
    columns are dropped, whatever their names, and never read. A score equal to the threshold is over it. An empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            scores = model.scores([passages(t) for t in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, learn_quality(docs, read(spark, sf_dir, "labels")))
