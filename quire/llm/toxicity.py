"""Toxicity by class-conditional Kneser-Ney models, one of toxic and one of ordinary texts, on two scales.

Spelling: the next byte of a word from the bytes of the same word before it (order 6), so that an expression that was never seen whole still
scores by its stem. Phrases: a word from the word before it, so that an expression of words which all occur in ordinary texts is told by their
sequence. Where a class has not seen a continuation, it backs off to one distribution that both share: of bytes, in how many different contexts a
shorter gram occurs in the whole corpus, labelled or not, in a chain of orders down to single bytes; of words, the pairs of both classes and
then the probability of the word's spelling in that chain. Rare expressions that only chance put into one class thus look alike to both.

A text's signs are length-normalised log-likelihood ratios of the two classes: of the whole text on either scale, of its two most telling words
and of its most telling stretch of words. Logistic regression on labelled texts whose words were not counted turns them into a score.

Class counts and calibration come from a bounded, documented sample of labelled rows (``SAMPLE_PER_CLASS``,
``CALIBRATION_PER_CLASS``, chosen by a hash of the id); word pairs of fewer than ``MIN_TEXTS`` sampled texts say nothing about other texts and are
left to the backoff. The backoff counts are a Spark aggregation over every
document; only those for the contexts of the sample's grams come back, so what is broadcast is bounded
by the sample. Scoring is one pass over every whole text without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import GROUP_BYTES, byte_groups, joined, tidy
from quire.llm.common import columns_of, crc_mod, sampled_ids, stored
from quire.llm.langid import FOLD
from quire.llm.wordhash import _slices, mix, words_in
from quire.llm.wordscan import TABLE

ORDER = 6
DISCOUNT = 0.75
SAMPLE_PER_CLASS = 6000
CALIBRATION_PER_CLASS = 2000
MIN_TEXTS = 2
WHOLE = 3  # bytes of the grams whose contexts all come to the driver
STRETCH = 3  # word pairs of the most telling stretch
UNKNOWN = -4.0  # log probability of a byte in a gram that the sample lacks
THRESHOLD = 0.3
PAD = b" " * 8
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
SEEN_SLOTS = 1 << 21


def pieces(texts: list[bytes], limit: int = GROUP_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Texts with long ones cut at blanks into parts of about ``limit`` bytes, and the text that each part is of."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > limit:
            cut = t.find(b" ", at + limit)
            if cut < 0:
                break
            parts.append(t[at:cut])
            owner.append(i)
            at = cut
        parts.append(t[at:])
        owner.append(i)
    return parts, np.array(owner, np.int64)


def grams(parts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes of all parts, the position of each part's end, and for every byte the gram of at most
    ``order`` bytes that ends there and begins in the same word (with the blank before it)."""
    buf = FOLD[np.frombuffer(b"".join([PAD + p + b" " for p in parts]) if parts else b"", np.uint8)]
    ends = np.cumsum([len(p) + len(PAD) + 1 for p in parts], dtype=np.int64)
    code = buf.astype(np.uint64)
    wide = code.copy()
    for j in range(1, order):
        code[j:] |= wide[:-j] << np.uint64(8 * j)
    place = np.arange(len(buf))
    blank = np.maximum.accumulate(np.where(buf == 32, place, 0))
    before = np.concatenate(([0], blank[:-1])) if len(blank) else blank
    return buf, ends, code & LOW_BYTES[np.minimum(place - before + 1, order)]


class Table:
    """64-bit keys to numbers: one slot each by a hash, the few keys that share a slot in a sorted list."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, spare: int = 2):
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + spare)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.float32)
        self.filled = np.zeros(1 << self.bits, np.int8)  # 0 empty, 1 one key, 2 more in the list
        slot = self._slot(keys)
        self.keys[slot], self.values[slot], self.filled[slot] = keys, values, 1
        over = self.keys[slot] != keys
        self.filled[slot[over]] = 2
        order = np.argsort(keys[over])
        self.more, self.more_values = keys[over][order], values[over][order].astype(np.float32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 for unknown keys) and which keys are known."""
        slot = self._slot(keys)
        known = (self.keys[slot] == keys) & (self.filled[slot] > 0)
        out = np.where(known, self.values[slot], np.float32(0))
        look = np.flatnonzero(~known & (self.filled[slot] == 2))
        if len(look) and len(self.more):
            at = np.minimum(np.searchsorted(self.more, keys[look]), len(self.more) - 1)
            found = self.more[at] == keys[look]
            out[look[found]], known[look[found]] = self.more_values[at[found]], True
        return out, known


def class_logs(inverse: np.ndarray, contexts: int, toxic: np.ndarray, ordinary: np.ndarray, shared: np.ndarray,
               discount: float = DISCOUNT) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log probabilities of grams in the two classes, and by context the log weight that a class leaves to the shared backoff."""
    logs, spare = [], []
    for n in (toxic, ordinary):
        seen = np.bincount(inverse, n, contexts)
        kinds = np.bincount(inverse, n > 0, contexts)
        left = np.where(seen > 0, np.minimum(1.0, discount * kinds / np.maximum(seen, 1)), 1.0)
        p = np.maximum(n - discount, 0) / np.maximum(seen, 1)[inverse] + left[inverse] * shared
        logs.append(np.log(p))
        spare.append(np.log(left))
    return logs, spare


def backoff(wanted: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], discount: float = DISCOUNT) -> np.ndarray:
    """Kneser-Ney probability of the last byte of each wanted gram given the bytes before it, by a chain of orders. ``levels``: grams
    with the numbers of their different contexts, longest first, single bytes last."""
    keys, contexts = levels[0]
    prefix, at = np.unique(keys >> np.uint64(8), return_inverse=True)
    totals, kinds = np.bincount(at, contexts, len(prefix)), np.bincount(at, minlength=len(prefix)).astype(float)
    mine = _pick(keys, contexts, wanted)
    total, kind = _pick(prefix, totals, wanted >> np.uint64(8)), _pick(prefix, kinds, wanted >> np.uint64(8))
    if len(levels) == 1:
        return (mine + 0.5) / (total + 128.0)
    shorter, where = np.unique(wanted & LOW_BYTES[len(levels) - 1], return_inverse=True)
    rest = backoff(shorter, levels[1:], discount)[where]
    return np.where(total > 0, np.maximum(mine - discount, 0) / np.maximum(total, 1) + discount * kind / np.maximum(total, 1) * rest, rest)


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Word hashes of texts, where each text's begin (with the total last), and as (buffers, starts, ends) their places for ``spelling``."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        for piece in _slices(t) if len(t) > GROUP_BYTES else (t,):
            parts.append(piece)
            owner.append(i)
    buf, starts, _ = joined(parts) if parts else (np.frombuffer(b"  ", np.uint8), np.zeros(0, np.int64), None)
    h, a, b = words_in(buf)
    of = np.array(owner, np.int64)[np.searchsorted(starts, a, side="right") - 1] if len(a) else np.zeros(0, np.int64)
    return h, np.searchsorted(of, np.arange(len(texts) + 1)), buf, a, b


def pairs_of(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of neighbouring words of one text, the place of each pair's second word, and where each text's pairs begin (with the total last)."""
    second = np.ones(len(h), bool)
    second[offsets[:-1][offsets[:-1] < len(h)]] = False
    place = np.flatnonzero(second)
    key = mix(h[place - 1] * np.uint64(0x9E3779B97F4A7C15) + h[place]) if len(place) else np.zeros(0, np.uint64)
    return key, place, np.searchsorted(place, offsets)


class Phrases:
    """Log ratios of the two classes for a word after another, by pair, and by first word for pairs that no class has seen (``pair_ratios``)."""

    def __init__(self, pair: np.ndarray, ratio: np.ndarray, first: np.ndarray, spare: np.ndarray):
        self.by_pair, self.by_word = Table(pair, ratio, spare=1), Table(first, spare)

    def ratios(self, h: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        out, known = self.by_pair.get(key)
        rest = np.flatnonzero(~known)
        out[rest] = self.by_word.get(h[place[rest] - 1])[0]
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        """texts x 2: mean ratio of a text's word pairs, and that of its best stretch of ``STRETCH`` pairs (all, if it has fewer)."""
        out = np.zeros((len(texts), 2))
        h, offsets, *_ = text_words(texts)
        key, place, at = pairs_of(h, offsets)
        if not len(key):
            return out
        run = np.concatenate(([0.0], np.cumsum(self.ratios(h, key, place), dtype=np.float64)))
        n = np.diff(at)
        some = n > 0
        out[some, 0] = out[some, 1] = (run[at[1:]] - run[at[:-1]])[some] / n[some]
        long = np.flatnonzero(n >= STRETCH)
        if len(long):
            window = np.concatenate((run[STRETCH:] - run[:-STRETCH], np.full(STRETCH, -np.inf)))
            window[(at[long + 1][:, None] - np.arange(1, STRETCH)[None, :]).ravel()] = -np.inf  # would reach beyond the text
            out[long, 1] = np.maximum.reduceat(window, np.stack((at[long], at[long + 1]), 1).ravel())[::2] / STRETCH
        return out


class Model:
    """Log ratios of the two class models by gram, and by context for grams that no class has seen."""

    def __init__(self, gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, lower: np.ndarray, contexts: np.ndarray,
                 order: int = ORDER, discount: float = DISCOUNT, shorter: list[tuple[np.ndarray, np.ndarray]] | None = None):
        """gram: distinct grams with their class counts; lower, contexts: grams one byte shorter with the number of
        different grams that end in them, over the corpus; shorter: the same for still shorter grams, down to one byte (without them the
        backoff is a single step)."""
        self.order, self.slope = order, None
        low = gram & LOW_BYTES[order - 1]
        if shorter is None:  # share of the different contexts of low's prefix that go on with low's last byte
            by_prefix, at = np.unique(lower >> np.uint64(8), return_inverse=True)
            totals = np.bincount(at, contexts, len(by_prefix))
            shared = (_pick(lower, contexts, low) + 0.02) / (_pick(by_prefix, totals, low >> np.uint64(8)) + 1.0)
        else:
            shared = backoff(low, [(lower, contexts), *shorter], discount)
        context, inverse = np.unique(gram >> np.uint64(8), return_inverse=True)
        logs, spare = class_logs(inverse, len(context), toxic, ordinary, shared, discount)
        self.by_gram = Table(gram, logs[0] - logs[1])
        self.by_context = Table(context, spare[0] - spare[1])
        self.gram, self.log_shared = gram, np.log(shared)

    def ratios(self, code: np.ndarray) -> np.ndarray:
        out, known = self.by_gram.get(code)
        rest = np.flatnonzero(~known)
        out[rest] = self.by_context.get(code[rest] >> np.uint64(8))[0]
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        """texts x 2: the two largest length-normalised log-likelihood ratios of a text's words."""
        out = np.zeros((len(texts), 2))
        parts, owner = pieces(texts)
        buf, ends, code = grams(parts, self.order)
        if not len(buf):
            return out
        run = np.concatenate(([0.0], np.cumsum(self.ratios(code), dtype=np.float64)))
        inside = np.diff((buf != 32).view(np.int8))
        first, after = np.flatnonzero(inside == 1) + 1, np.flatnonzero(inside == -1) + 1
        if not len(first):
            return out
        ratio = (run[after + 1] - run[first]) / (after + 1 - first)
        of = owner[np.searchsorted(ends, first, side="right")]
        order = np.lexsort((-ratio, of))
        of, ratio = of[order], ratio[order]
        top = np.concatenate(([True], of[1:] != of[:-1]))
        second = np.concatenate(([False], top[:-1])) & ~top
        out[of[top], 0] = ratio[top]
        out[of[top], 1] = np.minimum(ratio[top], 0)  # a text of one word has no second sign
        out[of[second], 1] = ratio[second]
        return out

    def calibrate(self, features: np.ndarray, labels: np.ndarray, strength: float = 1.0) -> None:
        """Ridge logistic regression by Newton steps."""
        x = np.column_stack((features, np.ones(len(features))))
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)) * [1, 1, 1e-6] + 1e-9 * np.eye(len(w)),
                                   x.T @ (labels - p) - strength * w * [1, 1, 1e-6])
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.slope = w

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.features(texts) @ self.slope[:2] + self.slope[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def signs_of(spelling: Model, phrases: Phrases, texts: list[bytes]) -> np.ndarray:
    """texts x 5: two most telling words, whole text by spelling, whole text and best stretch by word pairs."""
    parts, owner = pieces(texts)
    whole = np.zeros(len(texts))
    buf, ends, code = grams(parts, spelling.order)
    if len(buf):
        run = np.concatenate(([0.0], np.cumsum(spelling.ratios(code), dtype=np.float64)))
        begin = np.concatenate(([0], ends[:-1]))
        letters = np.concatenate(([0], np.cumsum(buf != 32)))
        sums = np.bincount(owner, run[ends] - run[begin], len(texts))
        whole = sums / np.maximum(np.bincount(owner, letters[ends] - letters[begin], len(texts)), 1)
    return np.column_stack((spelling.features(texts), whole, phrases.features(texts)))


class TextModel:
    """Both scales and the regression over a text's signs."""

    def __init__(self, spelling: Model, phrases: Phrases):
        self.spelling, self.phrases, self.middle, self.spread, self.slope, self.sent = spelling, phrases, 0.0, 1.0, None, None

    def send(self, spark):
        """The tables as a broadcast, made once; the regression's few numbers travel with the tasks."""
        self.sent = self.sent or spark.sparkContext.broadcast((self.spelling, self.phrases))
        return self.sent

    def features(self, texts: list[bytes]) -> np.ndarray:
        return signs_of(self.spelling, self.phrases, texts)

    def calibrate(self, features: np.ndarray, labels: np.ndarray, strength: float = 1.0) -> None:
        """Ridge logistic regression by Newton steps over standardised signs."""
        self.middle, self.spread = features.mean(0), np.maximum(features.std(0), 1e-9)
        x = np.column_stack(((features - self.middle) / self.spread, np.ones(len(features))))
        ridge = strength * np.append(np.ones(x.shape[1] - 1), 1e-6)
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (labels - p) - ridge * w)
            w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        self.slope = w

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return score_of(self.features(texts), self.middle, self.spread, self.slope)


def score_of(signs: np.ndarray, middle, spread, slope) -> np.ndarray:
    z = (signs - middle) / spread @ slope[:-1] + slope[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def spelled(words: list[bytes], table: Table, order: int) -> np.ndarray:
    """Probability of each word's spelling, and of its end, in the shared backoff (``table``: log probabilities by gram)."""
    if not words:
        return np.zeros(0)
    _, ends, code = grams(words, order)
    value, known = table.get(code)
    run = np.concatenate(([0.0], np.cumsum(np.where(known, value, UNKNOWN), dtype=np.float64)))
    return np.exp(np.clip(run[ends] - run[ends - 1 - np.array([len(w) for w in words], np.int64)], -60, -1))


def _pick(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)
    return np.where(keys[order[at]] == wanted, values[order[at]], 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limits: dict[str, int]) -> DataFrame:
    """``part, label, text`` of a bounded sample: of each label value, at most as many rows as
    ``limits`` add up to (those with the smallest hash of the id), dealt to the parts in proportion by another hash."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = sum(limits.values())
    ranked = sampled_ids(known, "label", total)
    few = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(total))
    at, by_hash = 0, F.lit(None).cast("string")
    for name, n in limits.items():
        by_hash = F.when((few >= at) & (few < at + n), F.lit(name)).otherwise(by_hash)
        at += n
    chosen = ranked.select("doc_id", "label", by_hash.alias("part"))
    # bounded: at most sum(limits) ids of each label value, and of rows repeated under an id the text that sorts first
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "part", "label").agg(F.min("text").alias("text")).select("part", "label", "text")


def corpus_contexts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``low, contexts``: for each gram of ``order`` - 1 bytes, the number of different grams that end in it, over all texts."""
    def distinct(batches):
        seen = np.zeros(SEEN_SLOTS, np.uint64)  # grams already sent by this task, one a slot
        bits = np.uint64(64 - SEEN_SLOTS.bit_length() + 1)
        for batch in batches:
            for _, texts in byte_groups(batch.column(0)):
                buf, _, code = grams(pieces(texts)[0], order)
                slot = (mix(code) >> bits).astype(np.int64)
                code = np.unique(code[seen[slot] != code])
                seen[(mix(code) >> bits).astype(np.int64)] = code
                if len(code):
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64))], names=["gram"])

    every = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(distinct), "gram long")
    low = F.col("gram").bitwiseAND(F.lit(int(LOW_BYTES[order - 1])))
    return every.distinct().groupBy(low.alias("low")).agg(F.count("*").alias("contexts"))


def train(docs: DataFrame, labels: DataFrame, order: int = ORDER, sample: int = SAMPLE_PER_CLASS,
          calibration: int = CALIBRATION_PER_CLASS) -> TextModel | None:
    """Fit on ``labels`` (``doc_id, toxic``) and the texts of ``docs``; None unless both classes have texts."""
    rows = stored(labelled_sample(docs, labels, "toxic", {"count": sample, "calibrate": calibration}), "op4-sample")

    def count(batches):
        for batch in batches:
            flags = np.array(batch.column(0).to_pylist(), np.int64)
            for first, texts in byte_groups(batch.column(1)):
                for value in (0, 1):
                    mine = [t for t, f in zip(texts, flags[first:first + len(texts)], strict=True) if f == value]
                    code, n = np.unique(grams(pieces(mine)[0], order)[2], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n * (value == 1), pa.int64()),
                                                      pa.array(n * (value == 0), pa.int64())], names=["gram", "toxic", "ordinary"])

    counted = (rows.filter("part = 'count'").select("label", "text").mapInArrow(tidy(count), "gram long, toxic long, ordinary long")
               .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    counted = stored(counted, "op4-grams")
    level, columns = stored(corpus_contexts(docs, order), "op4-contexts"), []
    for k in range(order - 1, WHOLE, -1):  # grams of k bytes and their contexts; what comes back is bounded by the sample
        wanted = counted.select(F.shiftright(F.col("gram").bitwiseAND(F.lit(int(LOW_BYTES[k]))), 8).alias("prefix")).distinct()
        columns.append(columns_of(level.withColumn("prefix", F.shiftright("low", 8)).join(wanted, "prefix", "left_semi").select("low", "contexts")))
        level = level.groupBy(F.col("low").bitwiseAND(F.lit(int(LOW_BYTES[k - 1]))).alias("low")).agg(F.count("*").alias("contexts"))
        level = stored(level, "op4-contexts") if k - 1 > WHOLE else level
    shared, *shorter = [(low.view(np.uint64), contexts) for low, contexts in columns]
    # grams of WHOLE bytes are few (155 different folded bytes), so all of them come back, and the shorter ones follow from them
    low, contexts = columns_of(level.select("low", "contexts"))
    shorter.append((low.view(np.uint64), contexts))
    for k in range(WHOLE - 1, 0, -1):
        shorter.append(np.unique(shorter[-1][0] & LOW_BYTES[k], return_counts=True))
    gram, toxic, ordinary = columns_of(counted.select("gram", "toxic", "ordinary"))
    if not toxic.any() or not ordinary.any():
        return None
    spelling = Model(gram.view(np.uint64), toxic, ordinary, *shared, order, shorter=shorter)
    ratios, spares = pair_ratios(stored(spelled_pairs(rows.filter("part = 'count'").select("label", "text"), spelling), "op4-pairs"))
    (pair, ratio), (first, spare) = columns_of(ratios), columns_of(spares)
    spelling.gram = spelling.log_shared = None  # not needed any more
    phrases = Phrases(pair.view(np.uint64), ratio, first.view(np.uint64), spare)
    model = TextModel(spelling, phrases)
    sent = model.send(docs.sparkSession)
    signs = ["a", "b", "c", "d", "e"]

    def features(batches):
        for batch in batches:
            x = np.concatenate([signs_of(*sent.value, t) for _, t in byte_groups(batch.column(1))] or [np.zeros((0, len(signs)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(len(signs))]], names=["label", *signs])

    schema = "label int, " + ", ".join(f"{c} double" for c in signs)
    held = rows.filter("part = 'calibrate'").select("label", "text").mapInArrow(tidy(features), schema).toPandas()
    if held["label"].nunique() < 2:  # too few rows to set any aside
        held = rows.select("label", "text").mapInArrow(tidy(features), schema).toPandas()
    held = held.sort_values(["label", *signs])
    model.calibrate(held[signs].to_numpy(), (held["label"] == 1).to_numpy().astype(float))
    return model


PAIRS = "pair long, first long, word binary, toxic long, ordinary long, texts long"


def spelled_pairs(labelled: DataFrame, spelling: Model) -> DataFrame:
    """``pair, first, toxic, ordinary, spelled``: counts of the word pairs of at least ``MIN_TEXTS`` texts of ``labelled`` (``label, text``), and the
    probability of the second word's spelling."""
    pairs = labelled.mapInArrow(tidy(count_pairs), PAIRS).groupBy("pair").agg(
        *[F.min(c).alias(c) for c in ("first", "word")], *[F.sum(c).alias(c) for c in ("toxic", "ordinary", "texts")]).filter(F.col("texts") >= MIN_TEXTS)
    sent = labelled.sparkSession.sparkContext.broadcast((spelling.gram, spelling.log_shared, spelling.order))

    def spell(batches):
        table = None
        for batch in batches:
            gram, log_shared, order = sent.value
            table = table or Table(gram, log_shared)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(spelled(batch.column(4).to_pylist(), table, order))], names=["pair", "first", "toxic", "ordinary", "spelled"])

    return pairs.select("pair", "first", "toxic", "ordinary", "word").mapInArrow(tidy(spell), "pair long, first long, toxic long, ordinary long, spelled double")


def pair_ratios(pairs: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """``pair, ratio`` and ``first, spare`` from counts (``pair, first, toxic, ordinary, spelled``): the log ratio of the two classes'
    Kneser-Ney probabilities of a word after another, and after a first word that of the weights they leave to the shared backoff, which is the
    same model over both classes' counts, backing off to the spelling."""
    def kinds(c):
        return F.count_if(F.col(c) > 0)

    totals = pairs.groupBy("first").agg(*[F.sum(c).alias(f"n_{c}") for c in ("toxic", "ordinary")], *[kinds(c).alias(f"k_{c}") for c in ("toxic", "ordinary")], F.count("*").alias("k"))

    def left(n, k):
        return F.when(n > 0, F.least(F.lit(1.0), discount * k / n)).otherwise(1.0)

    def own(count, total):
        return F.greatest(count - discount, F.lit(0.0)) / F.greatest(total, F.lit(1))

    spare = {c: left(F.col(f"n_{c}"), F.col(f"k_{c}")) for c in ("toxic", "ordinary")}
    every = F.col("n_toxic") + F.col("n_ordinary")
    shared = own(F.col("toxic") + F.col("ordinary"), every) + left(every, F.col("k")) * F.col("spelled")
    joined_up = pairs.join(totals, "first").withColumn("shared", shared)
    p = {c: own(F.col(c), F.col(f"n_{c}")) + spare[c] * F.col("shared") for c in spare}
    return (joined_up.select("pair", (F.log(p["toxic"]) - F.log(p["ordinary"])).cast("float").alias("ratio")),
            totals.select("first", (F.log(spare["toxic"]) - F.log(spare["ordinary"])).cast("float").alias("spare")))


def count_pairs(batches):
    """``PAIRS`` of labelled texts: each word pair with its first word's hash, its second word and how often and in how many texts it stands."""
    for batch in batches:
        flags = np.array(batch.column(0).to_pylist(), np.int64)
        for first, texts in byte_groups(batch.column(1)):
            for value in (0, 1):
                h, offsets, buf, a, b = text_words([t for t, f in zip(texts, flags[first:first + len(texts)], strict=True) if f == value])
                key, place, at = pairs_of(h, offsets)
                if not len(key):
                    continue
                pair, index, n = np.unique(key, return_index=True, return_counts=True)
                owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
                order = np.lexsort((owner, key))
                new = np.ones(len(key), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                _, texts_of_pair = np.unique(key[order][new], return_counts=True)
                text = buf.tobytes()
                words = [text[a[p]:b[p]].translate(TABLE) for p in place[index]]
                yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(h[place[index] - 1].view(np.int64)), pa.array(words, pa.binary()), pa.array(n * (value == 1), pa.int64()),
                                                  pa.array(n * (value == 0), pa.int64()), pa.array(texts_of_pair.astype(np.int64))], names=[f.split()[0] for f in PAIRS.split(", ")])


def score(docs: DataFrame, model: TextModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each row; without a model every score is 0."""
    sent = model.send(docs.sparkSession) if model else None
    numbers = (model.middle, model.spread, model.slope) if model else ()

    def run(batches):
        for batch in batches:
            s = [score_of(signs_of(*sent.value, t), *numbers) if sent else np.zeros(len(t)) for _, t in byte_groups(batch.column(1))]
            s = np.concatenate(s or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    return source.mapInArrow(tidy(run), f"doc_id {source.schema[0].dataType.simpleString()}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``, learned from the labels outside the held-out fold (crc32 of
    the id). Null or empty text has no word and gets the score of no sign at all; a very long text is scored whole, in pieces; an empty table gives an
    empty result; a null id is in the fold
    of the empty text and its label is not used; of several labels for one id the largest counts; repeated rows are
    scored each; without labels of both kinds every score is 0; other columns are ignored."""
    held = crc_mod(F.col("doc_id"), folds) == held_out_fold
    model = train(docs, labels.filter(~held))
    return score(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted")
