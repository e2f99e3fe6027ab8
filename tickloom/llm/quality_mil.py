"""Document quality by attention-based multiple-instance learning over passages, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, text_buffers

PASSAGE = 512  # bytes
SKETCH, DISTINCT = 64, 1024  # cells for three-byte strings: their shares, and how many differ
HIDDEN, ATTENTION = 16, 8
#: The bound of the training sample: documents of each label, and passages of each document.
TRAIN_PER_LABEL, TRAIN_PASSAGES = 1500, 24
EPOCHS, BATCH, RATE, DECAY, SEED = 30, 64, 0.01, 1e-4, 1
THRESHOLD = 0.3
FEATURES = 129 + SKETCH + 3


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of the texts, and where each text's passages start.

    Shares of the ASCII characters and of other bytes, shares of hashed three-byte strings, the
    share of these that differ, the share of capitals among letters, and the passage's length. An
    empty text has one empty passage.
    """
    sizes = np.diff(offsets)
    n = np.maximum(-(-sizes // PASSAGE), 1)
    starts = np.concatenate([[0], np.cumsum(n)])
    total = int(starts[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if len(data):
        inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)
        at = np.repeat(starts[:-1], sizes) + inside // PASSAGE
        length = np.maximum(np.bincount(at, minlength=total), 1).astype(np.float32)
        counts = np.bincount(at * 129 + np.minimum(data, 128), minlength=total * 129).reshape(total, 129)
        out[:, :129] = np.sqrt(counts / length[:, None])
        if len(data) > 2:
            same = at[2:] == at[:-2]
            where = at[2:][same]
            code = data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]
            code = (code[same] * np.uint32(0x9E3779B1)) >> np.uint32(22)
            cells = np.bincount(where * DISTINCT + code, minlength=total * DISTINCT).reshape(total, DISTINCT)
            out[:, 129 : 129 + SKETCH] = np.sqrt(cells.reshape(total, SKETCH, -1).sum(2) / length[:, None])
            out[:, -3] = (cells > 0).sum(1) / length
        upper = counts[:, 65:91].sum(1)
        out[:, -2] = upper / np.maximum(upper + counts[:, 97:123].sum(1), 1)
        out[:, -1] = np.log1p(length) / 6
    return out, starts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Fit encoder, gated attention and classifier by Adam on the documents' labels."""
    rng = np.random.default_rng(SEED)
    rows = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    model = Model(rows.mean(0), rows.std(0) + 0.02, {})
    w = {"encode": rng.normal(0, 0.1, (FEATURES, HIDDEN)), "encode_b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "u": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
         "a": rng.normal(0, 0.3, ATTENTION), "out": rng.normal(0, 0.3, HIDDEN), "out_b": np.zeros(1)}
    model.weights = w = {k: v.astype(np.float32) for k, v in w.items()}
    if not bags:
        return model
    scaled = [((b - model.mean) / model.scale).astype(np.float32) for b in bags]
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            x = np.concatenate([scaled[i] for i in some])
            n = np.array([len(scaled[i]) for i in some])
            begin = np.cumsum(n) - n
            bag = np.repeat(np.arange(len(some)), n)
            y = labels[some]
            h, tv, su, alpha, z, score = _forward(w, x, begin, bag)
            d = (score - y) / len(some)
            g = {"out": z.T @ d, "out_b": np.array([d.sum()])}
            dz = d[:, None] * w["out"][None]
            da = (dz[bag] * h).sum(1)
            ds = alpha * (da - np.add.reduceat(alpha * da, begin)[bag])
            gate = tv * su
            g["a"] = gate.T @ ds
            dgate = ds[:, None] * w["a"][None]
            dv, du = dgate * su * (1 - tv**2), dgate * tv * su * (1 - su)
            g["v"], g["u"] = h.T @ dv, h.T @ du
            dh = alpha[:, None] * dz[bag] + dv @ w["v"].T + du @ w["u"].T
            dpre = dh * (1 - h**2)
            g["encode"], g["encode_b"] = x.T @ dpre + DECAY * w["encode"], dpre.sum(0)
            step += 1
            for k in w:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                w[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


def _forward(w: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, bag: np.ndarray):
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    tv, su = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    s = (tv * su) @ w["a"]
    e = np.exp(s - np.maximum.reduceat(s, begin)[bag])
    alpha = e / np.add.reduceat(e, begin)[bag]
    z = np.add.reduceat(alpha[:, None] * h, begin, axis=0)
    return h, tv, su, alpha, z, _sigmoid(z @ w["out"] + w["out_b"][0])


def score_texts(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's score, and the weight of its weightiest passage."""
    features, starts = passage_features(data, offsets)
    bag = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    _, _, _, alpha, _, score = _forward(model.weights, (features - model.mean) / model.scale, starts[:-1], bag)
    return score, np.maximum.reduceat(alpha, starts[:-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = TRAIN_PER_LABEL) -> Model:
    """Train on a sample of ``labels`` (doc_id and label 0 or 1): about ``per_label`` documents of each label.

    The counts cover all labels; a document is in the sample if a hash of its id falls below its
    label's share. Of a long text, TRAIN_PASSAGES passages at even distances are used.
    """
    rows = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return train([], np.zeros(0))
    share = F.when(F.col("y") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    few = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)) < share).limit(4 * per_label)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")  # few has no more than 4 * per_label rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for low, high in row_chunks(offsets):
                features, starts = passage_features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                bags = []
                for a, b in zip(starts[:-1], starts[1:], strict=True):
                    pick = np.unique(np.linspace(a, b - 1, min(b - a, TRAIN_PASSAGES)).astype(np.int64))
                    bags.append(features[pick].astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), batch.column("y").slice(low, high - low).cast(pa.int32()), pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])

    found = sample.mapInArrow(run, "doc_id bigint, y int, bag binary").collect()
    found = sorted(found, key=lambda r: (str(r.doc_id), r.y, bytes(r.bag)))
    y = np.array([r.y for r in found], np.float32)
    return train([np.frombuffer(r.bag, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in found], y)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted and top_weight (the attention of its weightiest passage).

    Every passage of the whole text counts. Null texts count as empty; rows are judged each by
    itself from their text alone. Columns of ``docs`` with the names of the new ones are replaced.
    """
    docs = docs.drop("score", "predicted", "top_weight")
    names = docs.columns
    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "top_weight": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for low, high in row_chunks(offsets):
                s, top = score_texts(model, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                part = batch.slice(low, high - low)
                s = s.astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(top.astype(np.float64))], names=[*names, "score", "predicted", "top_weight"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op4_quality_mil(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``, learned from the labels that are not held out; empty texts have a score too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = fit(docs, labels)
    return score(docs.withColumn("held_out", held_out()), model).select("doc_id", "held_out", "score", "predicted")
