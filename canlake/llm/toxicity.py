"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text (``FEATURES``): densities of a fixed lexicon and of one learned
from labels (words and word beginnings, which catch inflected insults), how near its
hits stand to a second person, capitals, punctuation, obfuscation, and lexicon hits after
undoing it (``id1ot``, ``i.d.i.o.t``).  Words are runs of letters, digits and other non-ASCII
characters; they are compared as 64-bit hashes, so no Python code runs per word.

Learning reads a bounded sample of labelled rows (``SAMPLE`` rows by a hash of doc_id, of
those the caller admits).  The learned lexicon is cross-fitted: a training row's features
come from a lexicon that never saw its half.  Scores lie in 0..1, ``predicted`` is 1 from
``THRESHOLD`` on.

Null text counts as empty; empty texts get the score of a text without any feature.
Without labels of both kinds every score is 0.  Equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from canlake.llm import kernels as K
from canlake.llm.common import table
from canlake.llm.language import held_out

SAMPLE = 20_000
THRESHOLD = 0.3
#: Common insults, and words for a second person in several languages.
INSULTS = ("clown", "disgusting", "dumb", "fool", "idiot", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SECOND_PERSON = ("you", "your", "yours", "ur", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "te", "toi", "ton", "vous", "votre",
                 "ti", "tú", "usted", "ustedes", "vosotros")
PREFIXES = (4, 5, 6)
NEAR = 4
FEATURES = ("insults", "learned_words", "learned_beginnings", "strongest", "hits", "near_second_person", "capitals", "capital_words",
            "punctuation", "exclamations", "obfuscated", "undone_hits", "long_runs", "words")

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: The letters that digits and marks stand for.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_UNDONE = np.where(_LETTER, np.arange(256), 0).astype(np.uint8)
_UNDONE[list(map(ord, _STANDS_FOR))] = list(map(ord, _STANDS_FOR.values()))


def term_hashes(words: tuple[str, ...] | list[str]) -> np.ndarray:
    """The hashes that ``word_runs`` gives these words, sorted."""
    found = []
    for w in words:
        raw = np.frombuffer(w.encode(), np.uint8)
        found.append(K.span_hashes(raw, np.array([0]), np.array([len(raw)]), lower=True))
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


class Terms:
    """A set of hashed terms with a weight each; look-ups pass a bitmap first."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray | None = None):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.weights = np.ones(len(hashes)) if weights is None else weights[order]
        self.first = np.zeros(1 << 16, dtype=bool)
        self.first[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def weight_of(self, terms: np.ndarray) -> np.ndarray:
        """The terms' weights, 0 for those outside the set."""
        out = np.zeros(len(terms))
        near = np.flatnonzero(self.first[(terms >> np.uint64(48)).astype(np.int64)])
        if len(near) and len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, terms[near]), len(self.hashes) - 1)
            hit = self.hashes[place] == terms[near]
            out[near[hit]] = self.weights[place[hit]]
        return out


def word_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of word bytes."""
    inside = np.concatenate([[False], _WORD_BYTE[data], [False]])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge)) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge)) if len(data) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the words' first ``n`` bytes; 0 for shorter words."""
    long = ends - starts >= n
    out = np.zeros(len(starts), np.uint64)
    out[long] = K.span_hashes(data, starts[long], starts[long] + n, lower=True) ^ np.uint64(n)
    return out


class Lexicon:
    """Fixed insults and learned words and beginnings with their log odds."""

    def __init__(self, words: Terms, starts: dict[int, Terms]):
        self.fixed, self.second = Terms(term_hashes(INSULTS)), Terms(term_hashes(SECOND_PERSON))
        self.words, self.starts = words, starts

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros((n, len(FEATURES)))
        starts, ends, row = word_runs(data, offsets)

        def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.bincount(at, weights=values, minlength=n)[:n]

        def per_byte(mask: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)

        hashes = K.span_hashes(data, starts, ends, lower=True)
        words = np.maximum(per_text(np.ones(len(row)), row), 1)
        insult, learned = self.fixed.weight_of(hashes), self.words.weight_of(hashes)
        begun = np.zeros(len(row))
        for length, terms in self.starts.items():
            begun = np.maximum(begun, terms.weight_of(beginnings(data, starts, ends, length)))
        strength = np.maximum(learned, begun)
        hit = np.flatnonzero((strength > 0) | (insult > 0))
        strongest = np.zeros(n)
        np.maximum.at(strongest, row[hit], np.maximum(strength, 3 * insult)[hit])
        person = np.flatnonzero(self.second.weight_of(hashes))
        near = np.zeros(n)
        if len(person) and len(hit):
            after = np.minimum(np.searchsorted(person, hit), len(person) - 1)
            for side in (after, np.maximum(after - 1, 0)):
                close = (np.abs(person[side] - hit) <= NEAR) & (row[person[side]] == row[hit])
                near += np.bincount(row[hit[close]], minlength=n)[:n]

        letters = np.maximum(per_byte(_LETTER[data]), 1)
        upper = _UPPER[data]
        upper_sum = np.concatenate([[0], np.cumsum(upper)])
        shouted = (ends - starts >= 3) & (upper_sum[ends] - upper_sum[starts] == ends - starts)
        undone, odd = self._undone(data, offsets, n)
        same = np.zeros(len(data), dtype=bool)
        same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
        size = np.maximum(np.diff(offsets), 1)
        return np.column_stack([
            per_text(insult, row) / words, per_text((learned > 0).astype(float), row) / words, per_text((begun > 0).astype(float), row) / words,
            strongest, np.log1p(np.bincount(row[hit], minlength=n)[:n]), np.log1p(near), per_byte(upper) / letters,
            per_text(shouted.astype(float), row) / words, per_byte(_PUNCTUATION[data]) / size, per_byte(data == 33) / size,
            odd / words, undone / words, per_byte(same) / size, np.log1p(words),
        ])

    def _undone(self, data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Lexicon hits after undoing obfuscation, and obfuscated words, for each text.

        Obfuscated: a letter next to a digit or on both sides of a mark, within one word.
        """
        letter, digit, mark = _LETTER[data], _DIGIT[data], _PUNCTUATION[data]
        strange = np.zeros(len(data), dtype=bool)
        strange[1:] = (letter[1:] & digit[:-1]) | (digit[1:] & letter[:-1])
        strange[1:-1] |= letter[:-2] & mark[1:-1] & letter[2:]
        odd, undone = np.zeros(n), np.zeros(n)
        where = np.flatnonzero(strange)
        if not len(where):
            return undone, odd
        for at, end in K.blocks(data, offsets, 1 << 23):
            starts, ends = K.word_spans(data, offsets, at, end)
            if not len(starts):
                continue
            inside = where[(where >= at) & (where < end)] - at
            word = np.unique(np.searchsorted(starts, inside, side="right") - 1)
            word = word[word >= 0]
            row = np.searchsorted(offsets, starts[word] + at, side="right") - 1
            odd += np.bincount(row, minlength=n)[:n]
            if not len(word):
                continue
            # Letters, digits and marks read as letters; the other marks go.
            lengths = ends[word] - starts[word]
            read = _UNDONE[data[K.ragged(starts[word] + at, lengths)]]
            kept = np.concatenate([[0], np.cumsum(read > 0)])
            cut = kept[np.concatenate([[0], np.cumsum(lengths)])]
            read = read[read > 0]
            found = K.span_hashes(read, cut[:-1], cut[1:], lower=True)
            hit = (self.fixed.weight_of(found) > 0) | (self.words.weight_of(found) > 0)
            for length, terms in self.starts.items():
                hit |= terms.weight_of(beginnings(read, cut[:-1], cut[1:], length)) > 0
            undone += np.bincount(row, weights=hit.astype(float), minlength=n)[:n]
        return undone, odd


class Trees:
    """Boosted regression trees on binned features for the logistic loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, bins: int = 32, rate: float = 0.2):
        self.rounds, self.depth, self.bins, self.rate = rounds, depth, bins, rate
        self.trees: list[list[tuple[int, float, float]]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        shares = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.concatenate([[0.0], np.quantile(c, shares), np.quantile(c[c > 0], shares) if (c > 0).any() else []])) for c in x.T]
        binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)])
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, value = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += value

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[list, np.ndarray]:
        """A complete binary tree: (feature, cut) in the inner nodes, values in the leaves."""
        node = np.zeros(len(gradient), np.int64)
        inner = 2**self.depth - 1
        tree: list = [(0, np.inf, 0.0)] * (2 * inner + 1)
        for k in range(inner):
            at = np.flatnonzero(node == k)
            best = (1e-6, 0, len(self.edges[0]))
            if len(at):
                g, h = gradient[at], hessian[at]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for f, edges in enumerate(self.edges):
                    gs = np.cumsum(np.bincount(binned[at, f], weights=g, minlength=len(edges) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[at, f], weights=h, minlength=len(edges) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                    gain[(hs < 0.5) | (h.sum() - hs < 0.5)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            _, f, cut = best
            edge = self.edges[f][cut] if cut < len(self.edges[f]) else np.inf
            tree[k] = (f, float(edge), 0.0)
            node[at] = 2 * k + 1 + (binned[at, f] > cut)
        value = np.zeros(len(gradient))
        for k in range(inner, 2 * inner + 1):
            at = node == k
            leaf = self.rate * gradient[at].sum() / (hessian[at].sum() + 1)
            tree[k] = (0, np.inf, float(leaf))
            value[at] = leaf
        return tree, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            feature, edge, value = (np.array(c) for c in zip(*tree))
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > edge[node])
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares rising function (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    means, sizes, lasts = [], [], []
    for i, value in enumerate(y.tolist()):
        means.append(value), sizes.append(1), lasts.append(i)
        while len(means) > 1 and means[-2] >= means[-1]:
            total = sizes[-2] + sizes[-1]
            means[-2] = (means[-2] * sizes[-2] + means[-1] * sizes[-1]) / total
            sizes[-2], lasts[-2] = total, lasts[-1]
            means.pop(), sizes.pop(), lasts.pop()
    first = np.concatenate([[0], np.array(lasts[:-1], np.int64) + 1])
    middle = (x[first] + x[np.array(lasts)]) / 2
    return middle, np.array(means)


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees, knots: np.ndarray, values: np.ndarray):
        self.lexicon, self.trees, self.knots, self.values = lexicon, trees, knots, values

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(self.lexicon.features(data, offsets))
        # A little of the raw margin keeps texts apart that share a step.
        raw = 1 / (1 + np.exp(-margin))
        return np.clip(0.98 * np.interp(margin, self.knots, self.values) + 0.02 * raw, 0, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, half) of at most about ``SAMPLE`` labelled rows that may be learned from."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    n = usable.count()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(1 << 40))
    chosen = usable.where(place < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 40))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # About SAMPLE rows of two numbers, whatever the table.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(2)).cast("int").alias("half")
    )


def learned_lexicons(sample: DataFrame) -> list[Lexicon]:
    """Lexicons from half 0, half 1 and both."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("text"))
            toxic, half = batch.column("toxic").to_numpy(), batch.column("half").to_numpy()
            for a, b in K.slices(data, offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, row = word_runs(part, at)
                for kind in (0, *PREFIXES):
                    h = K.span_hashes(part, starts, ends, lower=True) if kind == 0 else beginnings(part, starts, ends, kind)
                    pairs = np.unique(np.column_stack([row[h != 0].astype(np.uint64), h[h != 0]]), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                    rows = pairs[:, 0].astype(np.int64) + a
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), kind, np.int32)), pa.array(pairs[:, 1].astype(np.int64)),
                         pa.array(toxic[rows].astype(np.int64)), pa.array(half[rows].astype(np.int64))],
                        names=["kind", "term", "toxic", "half"],
                    )

    sizes = np.zeros((2, 2))
    for r in sample.groupBy("half", "toxic").count().collect():
        sizes[r["half"], r["toxic"]] = r["count"]
    least = [max(2, 0.01 * t) for t in (sizes[0, 1], sizes[1, 1], max(3, sizes[:, 1].sum()))]
    counted = sample.mapInArrow(terms, "kind int, term long, toxic long, half long").groupBy("kind", "term").agg(
        *[F.sum(((F.col("half") == h) & (F.col("toxic") == t)).cast("int")).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)]
    )
    # Terms in a hundredth of the toxic sample: bounded by the words of the sample.
    often = counted.where((F.col("n01") >= least[0]) | (F.col("n11") >= least[1]) | (F.col("n01") + F.col("n11") >= least[2]))
    odds = (F.col("n01") + F.col("n11") + 0.5) / (F.col("n00") + F.col("n10") + 0.5) * float(sizes[:, 0].sum() + 1) / float(sizes[:, 1].sum() + 1)
    rows = often.where(odds > 5).collect()
    out = []
    for halves in ((0,), (1,), (0, 1)):
        tables: dict[int, tuple[list, list]] = {k: ([], []) for k in (0, *PREFIXES)}
        total = [sum(sizes[h, t] for h in halves) for t in (0, 1)]
        for r in rows:
            clean, toxic = (sum(r[f"n{h}{t}"] for h in halves) for t in (0, 1))
            weight = np.log((toxic + 0.5) / (total[1] + 1)) - np.log((clean + 0.5) / (total[0] + 1))
            if toxic >= max(2, 0.01 * total[1]) and weight > 2.5:
                tables[r["kind"]][0].append(r["term"] & (2**64 - 1))
                tables[r["kind"]][1].append(weight)
        made = {k: Terms(np.array(h, np.uint64), np.array(w, float)) for k, (h, w) in tables.items()}
        out.append(Lexicon(made.pop(0), made))
    return out


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """None when the labels are not of both kinds."""
    sample = labelled_sample(docs, labels)
    lexicons = learned_lexicons(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("text"))
            half = batch.column("half").to_numpy()
            for a, b in K.slices(data, offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                other = [shared.value[1 - h].features(part, at) for h in (0, 1)]
                x = np.where((half[a:b] == 0)[:, None], other[0], other[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic").slice(a, b - a), batch.column("half").slice(a, b - a)],
                    names=["x", "toxic", "half"],
                )

    rows = sorted((r["half"], r["toxic"], r["x"]) for r in sample.mapInArrow(measure, "x array<double>, toxic int, half int").collect())
    if len({r[1] for r in rows}) < 2:
        return None
    half, y, x = np.array([r[0] for r in rows]), np.array([float(r[1]) for r in rows]), np.array([r[2] for r in rows])
    # Calibration uses margins of trees that did not see the row.
    margin = np.zeros(len(y))
    for h in (0, 1):
        part = Trees()
        if len(set(y[half != h])) == 2:
            part.fit(x[half != h], y[half != h])
            margin[half == h] = part.margin(x[half == h])
    trees = Trees()
    trees.fit(x, y)
    return Model(lexicons[2], trees, *isotonic(margin, y))


def with_toxicity(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """Adds the score as ``name`` to ``docs``, replacing a column of this name; only ``text`` is read for it."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [*docs.columns, name]
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("text"))
            for a, b in K.slices(data, offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                score = shared.value.scores(part, at) if shared.value else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns), pa.array(score)], names=columns
                )

    return docs.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = with_toxicity(docs.select("doc_id", "text"), trained(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
