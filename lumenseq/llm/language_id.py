"""Language identification by a byte-level convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes. Each filter bank of width w adds a
learned vector for every (offset, byte), then takes the maximum over the window; the pooled
features go through a softmax layer. Applied to a text, the network scores all its windows, and
the mean of their log probabilities decides.

For inference two neighbouring offsets are merged into one table of 65,536 byte pairs, so that a
filter of width 2, 3, 4 or 5 costs one to three lookups a position.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
#: The training sample's bound in rows for each language.
ROWS_PER_LANGUAGE = 250
EPOCHS = 6
UNDETERMINED = "und"


class Model(NamedTuple):
    languages: list[str]
    filters: list[np.ndarray]  # width x 256 x FILTERS
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def to_windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """The text's bytes as rows of `size`; the last row is padded with spaces."""
    rows = max(1, -(-len(data) // size))
    return np.frombuffer(data.ljust(rows * size), np.uint8).reshape(rows, size)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7, batch: int = 64) -> Model:
    """Adam on the cross entropy. The gradient of max pooling goes to the maximal position."""
    rng = np.random.default_rng(seed)
    k, f = len(languages), FILTERS
    params = [rng.normal(0, 0.1, (w, 256, f)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(f * len(WIDTHS), np.float32), rng.normal(0, 0.1, (f * len(WIDTHS), k)).astype(np.float32), np.zeros(k, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            x, y = windows[order[at : at + batch]], labels[order[at : at + batch]]
            n, pooled, where = len(x), [], []
            for w, table in zip(WIDTHS, params):
                span = x.shape[1] - w + 1
                z = sum(table[o][x[:, o : o + span]] for o in range(w))
                top = z.argmax(1)
                where.append(top)
                pooled.append(np.take_along_axis(z, top[:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + params[-3]
            hidden = np.maximum(raw, 0)
            error = softmax(hidden @ params[-2] + params[-1])
            error[np.arange(n), y] -= 1
            error /= n
            back = (error @ params[-2].T) * (raw > 0)
            grads = []
            for b, (w, top) in enumerate(zip(WIDTHS, where)):
                g = np.zeros((w, 256, f), np.float32)
                part = back[:, b * f : (b + 1) * f]
                for o in range(w):
                    np.add.at(g[o], (x[np.arange(n)[:, None], top + o], np.arange(f)[None, :]), part)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            for p, g, a, v in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(languages, params[:-3], *params[-3:])


class Network:
    """The trained model with merged tables."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = []
        for table in model.filters:
            merged = []
            for o in range(0, len(table) - 1, 2):
                merged.append((o, (table[o + 1][:, None, :] + table[o][None, :, :]).reshape(1 << 16, -1)))
            if len(table) % 2:
                merged.append((len(table) - 1, table[-1]))
            self.tables.append((len(table), merged))

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """One row per window."""
        out = []
        for at in range(0, len(windows), 256):
            x = windows[at : at + 256]
            pair = x[:, :-1].astype(np.uint16) | (x[:, 1:].astype(np.uint16) << 8)
            pooled = []
            for width, merged in self.tables:
                span = x.shape[1] - width + 1
                z = None
                for o, table in merged:
                    y = table.take((pair if len(table) > 256 else x)[:, o : o + span], 0)
                    z = y if z is None else np.add(z, y, out=z)
                pooled.append(z.max(1))
            hidden = np.maximum(np.concatenate(pooled, 1) + self.model.bias, 0)
            out.append(np.log(softmax(hidden @ self.model.dense + self.model.dense_bias) + 1e-12))
        return np.concatenate(out)

    def predict(self, data: list[bytes]) -> list[tuple[str, float]]:
        """(language, score 0 to 1) of each text; all their windows go through in one batch."""
        windows = [to_windows(x) for x in data]
        counts = np.array([len(w) for w in windows])
        logs = self.log_probabilities(np.concatenate(windows))
        means = np.add.reduceat(logs, np.cumsum(counts) - counts, axis=0) / counts[:, None]
        shares = softmax(means)
        best = shares.argmax(1)
        return [(self.model.languages[b], float(s[b])) if any(map(str.isalpha, x.decode("utf-8", "replace"))) else (UNDETERMINED, 0.0) for x, b, s in zip(data, best, shares)]


def sampled_windows(rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """(lang, window) of a bounded sample: all windows of about rows_per_language rows of each language, chosen by hashed id."""
    labelled = rows.where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").count().collect()
    # A row is taken by its hashed id alone, at a rate that yields the bound on average.
    rates = {r["lang"]: min(1.0, rows_per_language / r["count"]) for r in counts}
    if not rates:
        return []
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [(lang, w.tobytes()) for lang, data in zip(batch.column(0).to_pylist(), texts(batch)) if data.strip() for w in to_windows(data)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in cut], pa.string()), pa.array([x[1] for x in cut], pa.binary())], ["lang", "spot"])

    chosen = labelled.where(rank < rate).select("lang", "text").mapInArrow(run, "lang string, spot binary")
    return [(r.lang, bytes(r.spot)) for r in chosen.collect()]


def learn(rows: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Network | None:
    """A network fitted on labelled rows (text, lang, doc_id), or None if there are none."""
    pairs = sorted(sampled_windows(rows, rows_per_language))
    languages = sorted({x for x, _ in pairs})
    if not languages:
        return None
    x = np.concatenate([to_windows(w)[:1] for _, w in pairs])
    y = np.array([languages.index(l) for l, _ in pairs])
    return Network(train(x, y, languages))


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone.

    A text that is null or has no letter gets `und` and score 0, as does every text if there was
    nothing to learn from. Repeated rows get equal results. Very long texts are scored whole, window by window.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(network and network.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value and Network(held.value)
        for batch in batches:
            data, found = texts(batch), []
            for at in range(0, len(data), 64):
                part = data[at : at + 64]
                found += net.predict(part) if net else [(UNDETERMINED, 0.0)] * len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
