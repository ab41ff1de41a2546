"""Language identification with a byte convolutional network, trained and run in numpy.

A text is cut into windows of ``WINDOW`` bytes (the last one filled with spaces).  Filters
of several widths run over embedded bytes, each filter keeps its greatest response in the
window, and a softmax layer gives the languages' shares; a text's shares are the mean over
its windows weighted by their bytes.  For prediction the embedding and the filters are
folded into tables by byte pair, so a response is a sum of at most two look-ups.

Training takes a bounded sample of labelled rows: ``PER_LANGUAGE`` documents of every language,
fewer (``LEAST`` or more) of each if there are over ``LANGUAGES``, chosen by a hash of doc_id,
``WINDOWS`` evenly spaced windows each; the steps grow with the languages.  Everything else
reads all rows and whole texts.

Null texts and texts without a letter get ``und`` and score 0, and so does every text when
there is nothing to learn from.  Equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from canlake.llm import kernels as K
from canlake.llm.common import table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
PER_LANGUAGE = 600
#: With more languages than this, the sample of each is smaller.
LANGUAGES = 64
LEAST = 20
WINDOWS = 4
STEPS = 400
BATCH = 64
_PAD = max(WIDTHS) - 1


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class ByteNetwork:
    """Embedding, convolutions of several widths, max pooling and softmax."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.embedding = rng.normal(0, 0.3, (256, EMBEDDED)).astype(np.float32)
        self.filters = [rng.normal(0, (2 / (w * EMBEDDED)) ** 0.5, (w * EMBEDDED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.dense_bias = np.zeros(len(classes), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.dense, self.dense_bias]

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross entropy; ``windows`` are padded by ``_PAD`` columns."""
        n = len(windows)
        embedded = self.embedding[windows]
        pooled, places = [], []
        for width, weight, bias in zip(WIDTHS, self.filters, self.bias):
            patches = np.concatenate([embedded[:, i : i + WINDOW] for i in range(width)], axis=2)
            response = patches.reshape(-1, width * EMBEDDED) @ weight
            response = response.reshape(n, WINDOW, FILTERS)
            place = response.argmax(axis=1)
            pooled.append(np.take_along_axis(response, place[:, None, :], axis=1)[:, 0] + bias)
            places.append(place)
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        error = softmax(hidden @ self.dense + self.dense_bias)
        error[np.arange(n), labels] -= 1
        error /= n
        back = (error @ self.dense.T) * (hidden > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_bias = [], []
        for k, (width, weight, place) in enumerate(zip(WIDTHS, self.filters, places)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            taken = windows[np.arange(n)[:, None, None], place[:, :, None] + np.arange(width)]  # n, filter, offset
            patch = self.embedding[taken].reshape(n, FILTERS, width * EMBEDDED)
            d_filters.append(np.einsum("nf,nfe->ef", g, patch))
            d_bias.append(g.sum(axis=0))
            spread = (g[:, :, None] * weight.T[None]).reshape(n, FILTERS, width, EMBEDDED)
            np.add.at(d_embedding, taken, spread)
        return [d_embedding, *d_filters, *d_bias, hidden.T @ error, error.sum(axis=0)]

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = 0.01, seed: int = 9) -> None:
        """Adam on batches in which every language has the same chance."""
        rng = np.random.default_rng(seed)
        padded = np.pad(windows, ((0, 0), (0, _PAD)), constant_values=32)
        by_class = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, steps + 1):
            wanted = rng.integers(0, len(by_class), BATCH)
            chosen = np.array([rng.choice(by_class[c]) for c in wanted])
            pace = rate * (1 - step / (steps + 1))
            for p, g, m, v in zip(self.parameters(), self.gradients(padded[chosen], labels[chosen]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def fold(self) -> list[list[np.ndarray]]:
        """For each width its look-up tables: one for each byte pair, and one for an odd last byte."""
        out = []
        for width, weight in zip(WIDTHS, self.filters):
            single = [self.embedding @ weight[i * EMBEDDED : (i + 1) * EMBEDDED] for i in range(width)]
            tables = [(single[i][:, None] + single[i + 1][None]).reshape(-1, FILTERS) for i in range(0, width - 1, 2)]
            out.append(tables + ([single[-1]] if width % 2 else []))
        return out

    def shares(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Softmax shares of each window of ``WINDOW`` bytes."""
        out = np.zeros((len(windows), len(self.classes)))
        for a in range(0, len(windows), 64):
            block = np.pad(windows[a : a + 64], ((0, 0), (0, _PAD)), constant_values=32)
            pairs = (block[:, :-1].astype(np.intp) << 8) | block[:, 1:]
            hidden = []
            for width, look, bias in zip(WIDTHS, tables, self.bias):
                response = look[0].take(pairs[:, :WINDOW], axis=0)
                for i in range(1, width // 2):
                    response += look[i].take(pairs[:, 2 * i : 2 * i + WINDOW], axis=0)
                if width % 2:
                    response += look[-1].take(block[:, width - 1 : width - 1 + WINDOW], axis=0)
                hidden.append(response.max(axis=1) + bias)
            out[a : a + 64] = softmax(np.maximum(np.concatenate(hidden, axis=1), 0) @ self.dense + self.dense_bias)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as rows of ``WINDOW`` bytes, and the number of rows of each text."""
    counts = -(-np.diff(offsets) // WINDOW)
    out = np.full(int(counts.sum()) * WINDOW, 32, np.uint8)
    at = 0
    for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), counts.tolist()):
        out[at : at + b - a] = data[a:b]
        at += n * WINDOW
    return out.reshape(-1, WINDOW), counts


def training_windows(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and labels of a bounded sample of the labelled rows."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 40))
    # One row for each language comes to the driver; its first text by hash is always in the sample.
    first = F.min(F.when(F.length("text") > 0, place)).alias("first")
    counts = usable.groupBy("lang").agg(F.count("*").alias("count"), first).where("first is not null").orderBy("lang").collect()
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    each = max(min(PER_LANGUAGE, PER_LANGUAGE * LANGUAGES // len(counts)), LEAST)
    until = [(r["lang"], max(int(min(1.0, each / r["count"]) * (1 << 40)), r["first"] + 1)) for r in counts]
    limits = F.broadcast(docs.sparkSession.createDataFrame(until, "lang string, _until long"))
    classes = [r["lang"] for r in counts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("text"))
            langs, found = [], []
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                rows, _ = windows_of(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                for k in sorted({int(x) for x in np.linspace(0, len(rows) - 1, WINDOWS)}) if len(rows) else []:
                    langs.append(lang)
                    found.append(rows[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    rows = usable.join(limits, "lang").where(place < F.col("_until")).select("lang", "text").mapInArrow(cut, "lang string, window binary").orderBy("lang", "window").collect()
    if not rows:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    number = {c: i for i, c in enumerate(classes)}
    windows = np.frombuffer(b"".join(r["window"] for r in rows), np.uint8).reshape(-1, WINDOW)
    labels = np.array([number[r["lang"]] for r in rows])
    present = sorted(set(labels.tolist()))
    return [classes[i] for i in present], windows, np.searchsorted(present, labels)


def trained(docs: DataFrame, steps: int = STEPS) -> ByteNetwork | None:
    classes, windows, labels = training_windows(docs)
    if not classes:
        return None
    network = ByteNetwork(classes)
    if len(classes) > 1:
        network.train(windows, labels, steps * -(-len(classes) // LANGUAGES))
    return network


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    count = np.concatenate([[0], np.cumsum(ascii_letter)])[offsets]
    found = np.diff(count) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def with_language(docs: DataFrame, network: ByteNetwork | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the predicted language and its share as ``names`` to ``docs``, replacing columns of these names.

    Nothing but ``text`` is read for the prediction.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    columns = [*docs.columns, *names]
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.fold() if model else []
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("text"))
            # A window has a share of every language, so slices are shorter with many.
            size = 4 * K.BLOCK * LANGUAGES // max(len(model.classes) if model else 1, LANGUAGES)
            for a, b in K.slices(data, offsets, size):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                known = has_letter(part, at)
                shares = np.zeros((b - a, len(model.classes) if model else 1))
                if model and len(part):
                    windows, counts = windows_of(part, at)
                    row = np.repeat(np.arange(b - a), counts)
                    weight = np.minimum(WINDOW, np.diff(at)[row] - WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)))
                    weighted = model.shares(windows, tables) * weight[:, None]
                    full = counts > 0
                    shares[full] = np.add.reduceat(weighted, (np.cumsum(counts) - counts)[full], axis=0) / np.diff(at)[full, None]
                best = shares.argmax(axis=1)
                known &= model is not None
                best_names = [model.classes[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
                score = np.where(known, np.clip(shares.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns), pa.array(best_names, pa.string()), pa.array(score)],
                    names=columns,
                )

    return docs.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    predicted = with_language(docs.select("doc_id", "text"), trained(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
