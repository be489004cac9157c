"""Language identification with error-correcting output codes.

Each language has a codeword; a binary n-gram classifier predicts each bit (weights: the log ratio
of how often a hashed byte trigram occurs in the languages whose bit is 1 and in the others). A text
is decoded to the codeword with the least loss, where every bit counts as much as its
classifier is sure of it; a second codeword that is almost as near flags the text as ambiguous.

Training uses a bounded sample, at most ``SAMPLE_PER_LANGUAGE`` whole texts of each language, chosen by a
hash of the id. Counting runs on Spark; the driver gets languages x buckets numbers. Prediction is
one pass without a shuffle over every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import GROUP_BYTES, byte_groups, joined, small_batches, tidy
from quire.llm.common import crc_mod, sampled_ids

SAMPLE_PER_LANGUAGE = 400
BUCKETS = 1 << 16
NO_LANGUAGE = "und"
SHARPNESS = 6.0  # margins are mean log ratios a trigram; this spreads them over the loss's slope
AMBIGUOUS = 0.05  # loss a bit by which the nearest codeword must beat the second


def _fold() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


FOLD = _fold()


def trigram_buckets(buf: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two; three spaces are bucket 0."""
    low = FOLD[buf]
    code = (low[:-2].astype(np.uint32) << 16) | (low[1:-1].astype(np.uint32) << 8) | low[2:]
    code ^= np.uint32(0x202020)
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n x bits matrix of +1 and -1: the exhaustive code up to 5 languages, else the best of random codes of
    10 log2(n) bits (largest least distance). Every bit splits the languages."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        rows = [[1 if (v >> (n - 1 - i)) & 1 else -1 for v in range((1 << (n - 1)), (1 << n) - 1)] for i in range(n)]
        return np.array(rows, float)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits).min()
        if best is None or gap > best[0]:
            best = (gap, code)
    return best[1]


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages x BUCKETS trigram counts of the sample."""
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        plus = np.stack([share[self.code[:, b] > 0].mean(0) for b in range(self.code.shape[1])], 1)
        minus = np.stack([share[self.code[:, b] < 0].mean(0) if (self.code[:, b] < 0).any() else plus[:, b]
                          for b in range(self.code.shape[1])], 1)
        self.weights = (np.log(plus) - np.log(minus)).astype(np.float32)
        self.weights[0] = 0  # three spaces

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """texts x bits: the mean weight of a text's trigrams."""
        if len(texts) == 1 and len(texts[0]) > GROUP_BYTES:  # one long text, in slices
            buf = np.frombuffer(b" " + texts[0] + b" ", np.uint8)
            total = sum(self.weights[trigram_buckets(buf[i:i + GROUP_BYTES + 2])].sum(0, dtype=np.float64)
                        for i in range(0, len(buf) - 2, GROUP_BYTES))
            return (total / (len(buf) - 2))[None]
        buf, starts, ends = joined(texts)
        idx = trigram_buckets(np.concatenate((buf, np.array([32, 32], np.uint8))))
        keep = np.ones(len(buf), bool)  # a trigram that reaches into the next text has no weight
        keep[ends - 1] = keep[ends - 2] = False
        idx[~keep] = 0
        sums = np.add.reduceat(self.weights[idx], starts, axis=0, dtype=np.float64)
        return sums / np.maximum(ends - starts - 2, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its score (0 to 1) and whether the second is almost as near."""
        z = margins * SHARPNESS
        weight = np.abs(np.tanh(z)) + 1e-6
        weight /= weight.sum(1, keepdims=True)
        losses = np.stack([(weight * np.log1p(np.exp(-z * row))).sum(1) for row in self.code], 1)
        order = np.argsort(losses, axis=1, kind="stable")
        best = order[:, 0]
        share = np.exp(-(losses - losses.min(1, keepdims=True)) * self.code.shape[1])
        score = 1.0 / share.sum(1)
        if len(self.languages) == 1:
            return best, score, np.zeros(len(best), bool)
        ordered = np.take_along_axis(losses, order[:, :2], 1)
        return best, score, ordered[:, 1] - ordered[:, 0] < AMBIGUOUS


def train(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on rows of ``docs`` (``doc_id, text, lang``); None without a labelled text."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = sampled_ids(labelled, "lang", sample_per_language)
    # bounded: sample_per_language ids of each language
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in byte_groups(batch.column(1)):
                for lang, text in zip(langs[first:first + len(texts)], texts, strict=True):
                    mine = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    buf = np.frombuffer(b" " + text + b" ", np.uint8)
                    for i in range(0, max(0, len(buf) - 2), GROUP_BYTES):
                        mine += np.bincount(trigram_buckets(buf[i:i + GROUP_BYTES + 2]), minlength=BUCKETS)
        for lang, t in totals.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(t[at], pa.int64())], names=["lang", "bucket", "n"])

    counted = (sample.mapInArrow(tidy(count), "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    if counted.empty:
        return None
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(), counted["bucket"].to_numpy()] = counted["n"]
    return Model(languages, counts)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model | None, boxed: str | None = None) -> DataFrame:
    """``doc_id`` of each row of ``docs`` with ``lang_pred, score, ambiguous, rejected``; or the column ``boxed``, a struct that has the text.

    Null, empty and letterless texts are ``rejected``, with ``und`` and score 0. If nothing was learned, every text has ``und`` and score 0, but
    texts with letters are not rejected; a learned language may be called ``und`` too. Repeated rows are judged each; ties go to the
    language that sorts first; a very long text is judged whole, in slices; an empty table gives an empty result; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS weights at most

    def run(batches):
        m = shared.value
        for batch in batches:
            langs, scores, unsure, none = [], [], [], []
            for _, texts in byte_groups(batch.column(0).field("text") if boxed else batch.column(1)):
                letters = [t[:200].upper() != t[:200].lower() or _has_letter(t) for t in texts]
                if m is None:
                    best, score, vague = [0] * len(texts), [0.0] * len(texts), [False] * len(texts)
                else:
                    best, score, vague = m.decode(m.margins(texts))
                langs += [m.languages[b] if ok and m is not None else NO_LANGUAGE for b, ok in zip(best, letters, strict=True)]
                scores += [float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)]
                unsure += [bool(v) and ok for v, ok in zip(vague, letters, strict=True)]
                none += [not ok for ok in letters]
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_()), pa.array(none, pa.bool_())],
                names=[first, "lang_pred", "score", "ambiguous", "rejected"])
            yield from small_batches(out)

    first = boxed or "doc_id"
    source = docs.select(boxed) if boxed else docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    return source.mapInArrow(tidy(run), f"{first} {source.schema[0].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean, rejected boolean")


def identify(docs: DataFrame, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """Train on the rows outside the held-out fold (crc32 of the id), predict every row:
    ``doc_id, held_out, lang_pred, score, ambiguous``. A null id belongs to the fold of the empty text. Texts without a letter are ``und``;
    so is every text of a table that has no labelled text to learn from. The rest is as ``predict`` says."""
    held = crc_mod(F.col("doc_id"), folds) == held_out_fold
    model = train(docs.filter(~held).select("doc_id", "text", "lang"))
    return predict(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns. Rejected: null texts and
    texts without a letter. An ambiguous text has a language among the learned ones and stays, and where nothing could be learned
    all texts with letters stay."""
    model = train(docs.filter(crc_mod(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return predict(boxed, model, "__row").filter(~F.col("rejected")).select("__row.*")
