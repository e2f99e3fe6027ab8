"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, text_buffers

WINDOW = 256  # bytes of a window; a text's last one is filled up with zeros
WIDTHS, FILTERS, EMBED = (2, 3, 4), 8, 8
#: The bound of the training sample: texts of each language, and characters of each.
TRAIN_PER_LANGUAGE, TRAIN_CHARS = 700, 1000
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.01, 1
UNDETERMINED = "und"
#: Below this score a prediction counts as a rejection in a filter.
LEAST_SCORE = 0.5


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: dict[int, np.ndarray]  # width: (width, EMBED, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    dense: np.ndarray
    offset: np.ndarray


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts cut into rows of WINDOW bytes, and where each text's rows start."""
    sizes = np.diff(offsets)
    n = -(-sizes // WINDOW)
    starts = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(starts[-1]) * WINDOW, np.uint8)
    out[np.repeat(starts[:-1] * WINDOW - offsets[:-1], sizes) + np.arange(offsets[-1])] = data
    return out.reshape(-1, WINDOW), starts


def train(texts: list[bytes], labels: list[str], epochs: int = EPOCHS) -> Model:
    """Fit embedding, filters and softmax by Adam on cross-entropy over windows of the texts."""
    rng = np.random.default_rng(SEED)
    languages = sorted(set(labels))
    rows, starts = windows(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    y = np.repeat([languages.index(x) for x in labels], np.diff(starts))
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(len(WIDTHS) * FILTERS), "dense": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))), "offset": np.zeros(len(languages))}
    p |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for low in range(0, len(order), BATCH):
            some = order[low : low + BATCH]
            x, want = rows[some], y[some]
            if rng.random() < 0.3:  # short windows too, as at the end of a text
                x = x.copy()
                x[:, int(rng.integers(20, WINDOW)) :] = 0
            e = p["embed"][x]
            pooled, where, views = [], [], []
            for w in WIDTHS:
                view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WINDOW - w + 1, w * EMBED)
                conv = view @ p[f"f{w}"]
                at = conv.argmax(1)
                pooled.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
                where.append(at)
                views.append(view)
            pre = np.concatenate(pooled, 1) + p["bias"]
            h = np.maximum(pre, 0)
            z = h @ p["dense"] + p["offset"]
            prob = np.exp(z - z.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            dz = prob.copy()
            dz[np.arange(len(want)), want] -= 1
            dz /= len(want)
            g = {"dense": h.T @ dz, "offset": dz.sum(0)}
            dh = (dz @ p["dense"].T) * (pre > 0)
            g["bias"] = dh.sum(0)
            g["embed"] = np.zeros_like(p["embed"])
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                picked = views[i][np.arange(len(x))[:, None], where[i]]  # (batch, filter, w * EMBED)
                g[f"f{w}"] = np.einsum("bfk,bf->kf", picked, d)
                back = (d[:, :, None] * p[f"f{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
                for j in range(w):
                    np.add.at(g["embed"], x[np.arange(len(x))[:, None], where[i] + j], back[:, :, j])
            step += 1
            for k in p:
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.001 * (g[k] ** 2 - second[k])
                p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return Model(languages, p["embed"], {w: p[f"f{w}"].reshape(w, EMBED, FILTERS) for w in WIDTHS}, p["bias"], p["dense"], p["offset"])


class Predictor:
    """A model with its filters as tables over one byte and over pairs of bytes."""

    def __init__(self, model: Model):
        self.model, self.tables = model, {}
        for w, f in model.filters.items():
            one = [model.embed @ f[j] for j in range(w)]
            self.tables[w] = [(j, np.ascontiguousarray((one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS)), 2) if j + 1 < w else (j, one[j], 1) for j in range(0, w, 2)]

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for low in range(0, len(rows), 512):
            x = rows[low : low + 512]
            pairs = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                conv = None
                for j, table, size in self.tables[w]:
                    part = table.take((pairs if size == 2 else x)[:, j : j + n], axis=0)
                    conv = part if conv is None else np.add(conv, part, out=conv)
                pooled.append(conv.max(1))
            z = np.maximum(np.concatenate(pooled, 1) + self.model.bias, 0) @ self.model.dense + self.model.offset
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.model.languages)), np.float32)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language of each text and its probability: the mean of its windows' log-probabilities by bytes."""
        rows, starts = windows(data, offsets)
        logs = self.log_probabilities(rows)
        sizes, n = np.diff(offsets), np.diff(starts)
        weight = np.full(len(rows), float(WINDOW))
        some = np.flatnonzero(n)
        weight[starts[1:][some] - 1] = sizes[some] - (n[some] - 1) * WINDOW
        total = np.zeros((len(n), len(self.model.languages)))
        if len(some):
            total[some] = np.add.reduceat(logs * weight[:, None], starts[:-1][some], axis=0) / sizes[some, None]
        z = np.exp(total - total.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        return z.argmax(1), z.max(1)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE, chars: int = TRAIN_CHARS) -> Model:
    """Train on a sample of the labelled rows: about ``per_language`` texts of each language, and of each one piece of at most ``chars`` characters.

    The counts cover all rows; a row is in the sample if a hash of its key falls below its
    language's share. Rows without text or language don't count.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([], [])
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    begin = F.pmod(F.xxhash64(key, F.lit(1)), F.greatest(F.char_length(text) - chars, F.lit(1))).cast("int") + 1
    sample = rows.where(draw < share[F.col(lang)]).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.substring(F.col(text), begin, F.lit(chars)).alias("t")).limit(2 * per_language * len(counts)).collect()
    sample = sorted(sample, key=lambda r: (str(r.k), r.t))
    return train([r.t.encode() for r in sample], [r.l for r in sample])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    Every window of the whole text is scored. ``und`` with score 0 where the text is null, has no
    letter, or no language was learned; rows are judged each by itself. Columns of ``docs`` with
    the names of the new ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "_letters")
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    names = docs.columns
    ready = docs.withColumn("_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model)
        labels = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            for low, high in row_chunks(offsets):
                best, score = predictor.predict(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                some = letters[low:high]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(labels[np.where(some, best, -1)], pa.string()), pa.array(np.where(some, score, 0.0))], names=[*names, "lang_pred", "score"])

    return ready.mapInArrow(run, schema)


def accepted() -> Column:
    """What a filter keeps of identified rows: a language, with a score of at least LEAST_SCORE."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``documents``; ``und`` for texts without letters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
