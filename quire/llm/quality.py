"""Quality classifier: a generalised additive model with pairwise interactions.

Surface measures of a whole text are binned; cyclic boosting visits one measure after another and adds a
small step of a shallow tree over its bins to that measure's lookup table. Then the pairs of measures that explain
most of what is left get two-dimensional tables, grown the same way. A score is the logistic function
of a few table look-ups added up.

The model is fitted on the driver from the measures of a bounded sample of labelled rows (``SAMPLE_PER_CLASS``, chosen by a
hash of the id); the measures are computed by Spark tasks. Scoring is one pass over every whole text without
a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import byte_groups, joined, segment_sums, tidy
from quire.llm.common import crc_mod
from quire.llm.toxicity import labelled_sample, pieces
from quire.llm.wordhash import mix, words_in

SAMPLE_PER_CLASS = 8000
THRESHOLD = 0.5
BINS = 32
COARSE = 8
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 40
STEP = 0.15

MEASURES = ["log_words", "word_bytes", "upper", "digits", "symbols", "marks", "line_breaks", "short_words", "long_words",
            "sentence_ends", "same_as_last", "distinct_words", "distinct_triples", "blank_runs"]


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.float32)
    t[np.frombuffer(chars, np.uint8)] = 1
    return t


UPPER, LOWERCASE = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
DIGIT, BLANK, BREAK = _class(b"0123456789"), _class(b" \t\r"), _class(b"\n")
MARK, END = _class(b".,;:!?'\"()-"), _class(b".!?")
SYMBOL = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:!?'\"()-"))
CLASSES = np.stack([UPPER, LOWERCASE, DIGIT, BLANK, BREAK, MARK, END, SYMBOL], 1)


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    first = np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1]))) if len(o) else np.zeros(0, bool)
    return np.bincount(o[first], minlength=n)


def measures(texts: list[bytes]) -> np.ndarray:
    """texts x MEASURES; an empty text has only zeros."""
    n = len(texts)
    parts, owner = pieces(texts)
    chars, words, word_owner, word_bytes, blank_runs = np.zeros((n, 8)), [], [], [], np.zeros(n)
    for a in range(0, len(parts), 4096):
        some = parts[a:a + 4096]
        buf, starts, ends = joined(some)
        own = owner[a:a + 4096]
        for k in range(CLASSES.shape[1]):
            np.add.at(chars[:, k], own, segment_sums(CLASSES[:, k][buf], starts, ends))
        both = np.concatenate(((buf[:-1] == 32) & (buf[1:] == 32), [False])).astype(np.float32)
        np.add.at(blank_runs, own, segment_sums(both, starts, ends - 1))
        h, first, after = words_in(buf)
        words.append(h)
        word_bytes.append(after - first)
        word_owner.append(own[np.searchsorted(ends, first, side="right")])
    size = np.maximum(np.array([len(t) for t in texts], float), 1)
    h = np.concatenate(words) if words else np.zeros(0, np.uint64)
    of = np.concatenate(word_owner) if words else np.zeros(0, np.int64)
    length = np.concatenate(word_bytes) if words else np.zeros(0, np.int64)
    count = np.bincount(of, minlength=n).astype(float)
    per_word = np.maximum(count, 1)
    pair = of[1:] == of[:-1]
    same = np.bincount(of[1:][pair & (h[1:] == h[:-1])], minlength=n)
    triple = (of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, bool)
    t_hash = mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[triple] if len(of) > 2 else np.zeros(0, np.uint64)
    t_owner = of[2:][triple] if len(of) > 2 else np.zeros(0, np.int64)
    triples = np.maximum(np.bincount(t_owner, minlength=n), 1)
    letters = np.maximum(chars[:, 0] + chars[:, 1], 1)
    out = np.column_stack([
        np.log1p(count), np.bincount(of, length, n) / per_word, chars[:, 0] / letters, chars[:, 2] / size, chars[:, 7] / size,
        chars[:, 5] / size, chars[:, 4] / per_word, np.bincount(of[length <= 3], minlength=n) / per_word,
        np.bincount(of[length >= 12], minlength=n) / per_word, chars[:, 6] / per_word, same / per_word,
        _distinct(of, h, n) / per_word, _distinct(t_owner, t_hash, n) / triples, blank_runs / per_word])
    out[np.array([len(t) == 0 for t in texts], bool)] = 0
    return out


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """Leaf value of every bin for the tree of that depth with the best splits of the sums ``grad`` and ``hess``."""
    out = np.full(len(grad), grad.sum() / (hess.sum() + ridge))
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad), np.cumsum(hess)
        gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g[-1] ** 2 / (h[-1] + ridge) + 1e-12:
            out[:cut], out[cut:] = _tree(grad[:cut], hess[:cut], depth - 1, ridge), _tree(grad[cut:], hess[cut:], depth - 1, ridge)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best one cut in each direction."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)

    def four(s):
        a = s[:-1, :-1]
        b, c = s[:-1, -1:] - a, s[-1:, :-1] - a
        return a, b, c, s[-1, -1] - a - b - c
    sums = list(zip(four(g), four(h), strict=True))
    gain = sum(x ** 2 / (y + ridge) for x, y in sums)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = np.empty(grad.shape)
    cells = [np.s_[:i + 1, :j + 1], np.s_[:i + 1, j + 1:], np.s_[i + 1:, :j + 1], np.s_[i + 1:, j + 1:]]
    for cell, (x, y) in zip(cells, sums, strict=True):
        value[cell] = x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + ridge)), value


class Model:
    """Lookup tables of single measures and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        d = x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, COARSE + 1)[1:-1])) for j in range(d)]
        b, c = self._bins(x, self.cuts), self._bins(x, self.coarse)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(len(cut) + 1) for cut in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j in range(d):
                p = 1 / (1 + np.exp(-z))
                size = len(self.tables[j])
                step = STEP * _tree(np.bincount(b[:, j], y - p, size), np.bincount(b[:, j], p * (1 - p), size), 2)
                self.tables[j] += step
                z += step[b[:, j]]
        p = 1 / (1 + np.exp(-z))
        ranked = sorted(((-_quadrants(*self._grid(c, i, j, y, p))[0], i, j) for i in range(d) for j in range(i)))
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for _, i, j in ranked[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                p = 1 / (1 + np.exp(-z))
                step = STEP * _quadrants(*self._grid(c, i, j, y, p))[1]
                table += step
                z += step[c[:, i], c[:, j]]

    def _grid(self, c, i, j, y, p):
        shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
        cell = c[:, i] * shape[1] + c[:, j]
        n = shape[0] * shape[1]
        g, h = np.bincount(cell, y - p, n).reshape(shape), np.bincount(cell, p * (1 - p), n).reshape(shape)
        # a measure with one bin cannot be cut: an empty second bin keeps the shape of the search
        pad = ((0, max(0, 2 - shape[0])), (0, max(0, 2 - shape[1])))
        if max(pad[0][1], pad[1][1]):
            g, h = np.pad(g, pad), np.pad(h, pad)
            self._pad(i, j, g.shape)
        return g, h

    def _pad(self, i, j, shape) -> None:
        for k, (a, b, table) in enumerate(self.pairs):
            if (a, b) == (i, j) and table.shape != shape:
                self.pairs[k] = (a, b, np.pad(table, ((0, shape[0] - table.shape[0]), (0, shape[1] - table.shape[1]))))

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]) if len(x) else np.zeros((0, len(cuts)), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b, c = self._bins(x, self.cuts), self._bins(x, self.coarse)
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for i, j, table in self.pairs:
            z += table[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS) -> Model | None:
    """Fit on ``labels`` (``doc_id, quality``) and the texts of ``docs``; None unless both classes have texts."""
    rows = labelled_sample(docs, labels, "quality", {"fit": sample})
    fields = "label int, " + ", ".join(f"{m} double" for m in MEASURES)

    def run(batches):
        for batch in batches:
            x = np.concatenate([measures(t) for _, t in byte_groups(batch.column(1))] or [np.zeros((0, len(MEASURES)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, j]) for j in range(x.shape[1])]], names=["label", *MEASURES])

    got = rows.select("label", "text").mapInArrow(tidy(run), fields).toPandas()  # bounded by the sample
    if got["label"].nunique() < 2:
        return None
    got = got.sort_values(["label", *MEASURES])
    return Model(got[MEASURES].to_numpy(), (got["label"] == 1).to_numpy().astype(float))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each row; without a model every score is 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            m = sent.value
            s = [m.scores(measures(t)) if m else np.zeros(len(t)) for _, t in byte_groups(batch.column(1))]
            s = np.concatenate(s or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    return source.mapInArrow(tidy(run), f"doc_id {source.schema[0].dataType.simpleString()}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``, learned from the labels outside the held-out fold (crc32 of
    the id). Null or empty text has all measures 0; a null id is in the fold of the empty text and its label is not used; of
    several labels for one id the largest counts; repeated rows are scored each; without labels of both kinds every score is
    0; a very long text is measured whole; an empty table gives an empty result; other columns are ignored."""
    held = crc_mod(F.col("doc_id"), folds) == held_out_fold
    model = train(docs, labels.filter(~held))
    return score(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted")
