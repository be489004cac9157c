"""Personal data: fixed patterns, and a character LSTM with CRF that finds what the patterns miss.

The tagger is trained on the driver from labelled spans: windows of a bounded sample of documents
(``SAMPLE_TEXTS`` of at most ``SAMPLE_CHARS``, chosen by a hash) with their pattern spans, and the same windows with written variants of
such data, and with harmless numbers, put in. Texts are cut into overlapping windows; every window is decoded by Viterbi,
and the spans of all windows of a text are reconciled globally: where a window's edge cuts a span that no neighbour
sees whole, the stretch around it is decoded again with twice the reach until the span ends inside, and of all whole spans the
non-overlapping set of greatest confidence is taken. Pattern spans always stay. Stretches of more than ``WIDE`` characters are decoded in
overlapping parts, and each character has the tag of the part where it is most central, so no length is lost.

A span must hold a digit or an @, so windows without either cannot hold one and are not decoded at first.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import tidy
from quire.llm.common import hash_share, stored
from quire.llm.crf_tagger import KINDS, Tagger, character_ids
from quire.llm.wordscan import texts_of

WINDOW = 64
STRIDE = 32
WIDE = 1024  # characters of a stretch decoded at once
SAMPLE_TEXTS = 1500
SAMPLE_CHARS = 4000  # of a training text, from a place in it that a hash picks; searching reads whole texts
TRAIN_WINDOWS = 2000
TRAIN_WIDTH = 160  # of the wide training windows
CONFIDENCE = 0.7
BATCH_WINDOWS = 2048

# The patterns that every result must contain. Possessive forms match the same places in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SIGN = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, upto = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > upto and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
        upto = m.end() if start < m.start() else max(upto, m.start() + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans by start, then kind as listed."""
    if not SIGN.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=_place)


def _place(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an @."""
    return sorted({s for m in SIGN.finditer(text) for s in range(max(0, (m.start() - WINDOW) // STRIDE + 1) * STRIDE, m.start() + 1, STRIDE)})


def _padded(ids: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int16)
    part = ids[start:start + WINDOW]
    out[:len(part)] = part
    return out


def tag_row(spans: list[tuple[str, int, int]], start: int, width: int = WINDOW) -> np.ndarray:
    """Tags of the window at ``start``."""
    out = np.zeros(width, np.int8)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        lo, hi = max(a - start, 0), min(b - start, width)
        if lo < hi and not out[lo:hi].any():
            out[lo:hi] = 2 + 2 * k
            out[lo] = 1 + 2 * k
    return out


def written_variant(rng: np.random.Generator) -> tuple[str | None, str]:
    """Personal data as people also write it, or (kind None) a harmless number."""
    def digits(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def name():
        return "".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(3, 9)))
    which = int(rng.integers(0, 12))
    d = rng.choice([" ", "-", "."])
    if which == 0:
        return "email", f"{name()}{rng.choice(['.', '_', ''])}{digits(2)}@{name()}.{name()}.com"
    if which == 1:
        return "email", f"{name()} @ {name()}.{rng.choice(['com', 'org', 'net'])}"
    if which == 2:
        return "email", f"{name()}.{digits(2)}@{name()}{digits(1)} .com"
    if which == 3:
        return "ip", ".".join(str(x) for x in rng.integers(0, 256, 4))
    if which == 4:
        return "ip", " . ".join(str(x) for x in rng.integers(0, 256, 4))
    if which in (5, 6):
        number = next(n for n in (f"{stem}{c}" for stem in [digits(15)] for c in range(10)) if luhn(n))
        return "card", number if which == 6 else d.join(number[i:i + 4] for i in range(0, 16, 4))
    if which == 7:
        return "phone", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"
    if which == 8:
        return "phone", f"({digits(3)}) {digits(3)}-{digits(4)}"
    if which == 9:
        return "phone", f"{digits(3)}{d}{digits(3)}{d}{digits(4)}"
    return None, rng.choice([f"{digits(4)}", f"{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
                             f"{digits(2)} %", f"{digits(1)},{digits(3)}", f"{digits(6)}", f"{digits(2)}:{digits(2)}", f"No. {digits(3)}", "@", f"@{name()}"])


def long_variant(rng: np.random.Generator) -> tuple[str, str]:
    """Personal data written with 32 to 100 characters, longer than what neighbouring windows share."""
    def name():
        return "".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(3, 13)))
    length, which = int(rng.integers(32, 101)), int(rng.integers(0, 8))
    if which == 0:  # every digit of a card or phone number apart
        n = int(rng.integers(12, 16))
        number = "".join(map(str, rng.integers(0, 10, n)))
        number = next(x for x in (f"{number}{c}" for c in range(10)) if luhn(x))
        return "card", rng.choice([" - ", " . "]).join(number)
    if which == 1:
        return "phone", "+" + rng.choice([" - ", " . "]).join(map(str, rng.integers(0, 10, rng.integers(10, 13))))
    at = rng.choice([" @ ", " @", "@ "])
    local, domain = name(), f"{name()}.{rng.choice(['com', 'org', 'net', 'edu'])}"
    while len(local) + len(at) + len(domain) < length:
        if rng.random() < 0.5 and len(local) < 48:
            local = f"{name()}{rng.choice(['.', '_', '-'])}{local}"
        else:
            domain = f"{name()}.{domain}"
    return "email", f"{local}{at}{domain}"[-100:].lstrip("._- @")


def training_windows(texts: list[str], limit: int = TRAIN_WINDOWS, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: pattern spans as found, and texts with written variants put in at a blank."""
    rng = np.random.default_rng(seed)
    ids, tags = [], []
    found = [(t, base_spans(t)) for t in texts]
    for t, spans in [f for f in found if f[1]][:limit // 3]:
        chars = character_ids(t)
        starts = window_starts(t)
        for s in sorted(rng.choice(starts, min(4, len(starts)), replace=False).tolist()):
            ids.append(_padded(chars, s))
            tags.append(tag_row(spans, s))
    plain = [t for t, spans in found if not spans and len(t) > 20] or ["some words of plain text and some more words here"]
    while len(ids) < limit:
        t = plain[int(rng.integers(0, len(plain)))]
        at = int(rng.integers(0, max(1, len(t) - WINDOW)))
        part = t[at:at + WINDOW]
        cut = part.find(" ", int(rng.integers(0, 50)))
        cut = len(part) if cut < 0 else cut + 1
        kind, data = written_variant(rng)
        whole = part[:cut] + str(data) + " " + part[cut:]
        shift = int(rng.integers(0, cut + 1))
        ids.append(_padded(character_ids(whole), shift))
        tags.append(tag_row([(kind, cut, cut + len(data))] if kind else [], shift))
    return np.array(ids[:limit]), np.array(tags[:limit])


def long_windows(texts: list[str], limit: int, width: int, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags of texts with data put in at a blank: in narrow windows long spans, mostly cut; in wide ones long and short spans, mostly whole."""
    rng = np.random.default_rng(seed)
    ids, tags = np.zeros((limit, width), np.int16), np.zeros((limit, width), np.int8)
    plain = [t for t in texts if len(t) > 20 and not base_spans(t)] or ["some words of plain text and some more words here"]
    for n in range(limit):
        t = plain[int(rng.integers(0, len(plain)))]
        at = int(rng.integers(0, max(1, len(t) - 2 * width)))
        part = t[at:at + 2 * width]
        cut = part.find(" ", int(rng.integers(0, width)))
        cut = len(part) if cut < 0 else cut + 1
        kind, data = written_variant(rng) if width > WINDOW and rng.random() < 0.4 else long_variant(rng)
        whole = part[:cut] + str(data) + " " + part[cut:]
        sign = cut + (data.find("@") if kind == "email" else len(data) - 1)  # the window holds a sign
        shift = int(rng.integers(max(0, sign - width + 1), sign + 1) if width == WINDOW else rng.integers(max(0, cut + len(data) - width), cut + 1))
        chars = character_ids(whole[shift:shift + width])
        ids[n, :len(chars)] = chars
        tags[n] = tag_row([(kind, cut, cut + len(data))] if kind else [], shift, width)
    return ids, tags


def fitted(texts: list[str], windows: int = TRAIN_WINDOWS, epochs: int = 8) -> Tagger:
    """A tagger trained on the windows of ``texts``, narrow and wide."""
    tagger = Tagger()
    tagger.fit(*training_windows(texts, windows), epochs,
               more=[long_windows(texts, windows // 4, WINDOW), long_windows(texts, windows // 2, TRAIN_WIDTH)])
    return tagger


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, windows: int = TRAIN_WINDOWS, epochs: int = 8) -> Tagger:
    """Fit on a bounded sample: half of texts with a digit or @, half of any texts, by a hash of the id. Of a long text the stretch that a hash
    of the id picks is learned from. Rows are kept by a share derived from their number before they are ranked, so that what meets in a
    task and on the driver does not grow with the input."""
    size = F.length("text")
    at = F.pmod(F.xxhash64("doc_id", F.lit("at")), F.greatest(size - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    known = docs.filter(size > 0).select("doc_id", F.substring("text", at, F.lit(SAMPLE_CHARS)).alias("text"))
    signed = F.col("text").rlike("[0-9@]")
    n, n_signed = known.agg(F.count("*"), F.count_if(signed)).first()
    key = [F.col("doc_id"), F.substring("text", 1, 100)]

    def some(rows, count):
        near = rows.filter(hash_share(sample_texts // 2, F.lit(count), *key))
        return stored(near.orderBy(F.xxhash64(*key), "text").limit(sample_texts // 2), "op1-sample").collect()

    some = some(known, n) + some(known.filter(signed), n_signed)
    return fitted([r["text"] for r in some], windows, epochs)


def plausible(kind: str, found: str) -> bool:
    n = sum(c.isdigit() for c in found)
    if kind == "email":
        return "@" in found.strip("@ ") and "." in found
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= n <= 19 and luhn(re.sub("[^0-9]", "", found))
    return 7 <= n <= 15


def trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span without what the tagger took along: numbers begin with a digit, + or ( and end with a digit; an address ends with
    the word after its last dot."""
    if kind == "email":
        dot = text.rfind(".", a, b)
        if dot >= 0:
            word = re.compile(r"\s?[A-Za-z0-9-]*").match(text, dot + 1, b)
            b = word.end()
        return a, a + len(text[a:b].rstrip(" .,;:\n"))
    while a < b and not (text[a].isdigit() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isdigit():
        b -= 1
    return a, b


def window_spans(text: str, start: int, tags: np.ndarray, sure: np.ndarray) -> tuple[list[tuple[float, str, int, int]], list[tuple[str, int, int]]]:
    """(confidence, kind, start, end) of the whole spans of a decoded window, and (kind, start, end) of those that its edges may have cut."""
    out, cut, s = [], [], 0
    inside = min(len(tags), len(text) - start)
    while s < inside:
        tag = int(tags[s])
        if tag == 0:
            s += 1
            continue
        k, e = (tag - 1) // 2, s + 1
        while e < inside and tags[e] == 2 + 2 * k:
            e += 1
        a, b = trimmed(KINDS[k], text, start + s, start + e)
        whole = (s > 0 or start == 0) and (e < len(tags) or start + e == len(text))
        confidence = float(sure[s:e].mean())
        if not whole:
            cut.append((KINDS[k], start + s, start + e))
        elif confidence >= CONFIDENCE and plausible(KINDS[k], text[a:b]):
            out.append((confidence, KINDS[k], a, b))
        s = e
    return out, cut


def stretches(pieces: list[tuple[str, int, int]], reach: int, size: int) -> list[tuple[int, int]]:
    """The pieces of a text of ``size`` characters with ``reach`` more on both sides, joined where they overlap."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a - reach), min(size, b + reach)) for _, a, b in pieces):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def decode_stretches(texts: list[str], work: list[tuple[int, int, int]], tagger: Tagger) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tags and their marginals of each (text, start, end). A stretch of more than ``WIDE`` characters is decoded in parts that overlap by half."""
    out, by_width = [], {}
    for j, (i, a, b) in enumerate(work):
        out.append((np.zeros(b - a, np.int8), np.zeros(b - a, np.float32)))
        width = min(WIDE, 1 << (b - a - 1).bit_length())
        starts = [a] if b - a <= WIDE else range(a, b - WIDE // 2, WIDE // 2)
        by_width.setdefault(width, []).extend((j, i, s, s == starts[0], s == starts[-1]) for s in starts)
    for width, parts in by_width.items():
        rows = max(1, BATCH_WINDOWS * WINDOW // width)
        for some in (parts[x:x + rows] for x in range(0, len(parts), rows)):
            ids = np.zeros((len(some), width), np.int16)
            for row, (j, i, s, _, _) in zip(ids, some, strict=True):
                chars = character_ids(texts[i][s:min(s + width, work[j][2])])
                row[:len(chars)] = chars
            tags, sure = tagger.decode(ids)
            for (j, _, s, first, last), t, p in zip(some, tags, sure, strict=True):
                a, b = work[j][1:]
                lo, hi = s if first else s + width // 4, b if last else s + 3 * width // 4  # where this part is the most central
                out[j][0][lo - a:hi - a], out[j][1][lo - a:hi - a] = t[lo - s:hi - s], p[lo - s:hi - s]
    return out


def _open(cut: list[tuple[str, int, int]], found: list[tuple[float, str, int, int]], fixed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The cut pieces that neither touch a fixed span nor lie in a whole span of their kind."""
    ends = np.array(sorted((b, a) for _, a, b in fixed)).reshape(-1, 2)
    out = []
    whole: dict[str, list[tuple[int, int]]] = {}
    for _, kind, a, b in sorted(found, key=lambda f: (f[2], f[3])):
        mine = whole.setdefault(kind, [])
        if not mine or b > mine[-1][1]:  # starts and ends both ascend
            mine.append((a, b))
    for kind, a, b in cut:
        at = int(np.searchsorted(ends[:, 0], a, side="right"))
        if (ends[at:, 1] < b).any():
            continue
        mine = whole.get(kind, [])
        at = bisect.bisect_right(mine, (a, float("inf"))) - 1
        if at < 0 or mine[at][1] < b:
            out.append((kind, a, b))
    return out


def add_long_spans(texts: list[str], base: list[list], found: list[list], cut: list[list], tagger: Tagger) -> None:
    """Add to ``found`` the spans whose pieces in ``cut`` the edges of windows have cut, from stretches that are widened until
    nothing is cut. The reach doubles and stretches that overlap are one, so a text is decoded at most a logarithmic number of times."""
    reach = WINDOW
    while any(cut):
        work = [(i, a, b) for i, pieces in enumerate(cut) if pieces
                for a, b in stretches(_open(pieces, found[i], base[i]), reach, len(texts[i]))]
        cut = [[] for _ in texts]
        for (i, a, _), (tags, sure) in zip(work, decode_stretches(texts, work, tagger), strict=True):
            spans, pieces = window_spans(texts[i], a, tags, sure)
            found[i] += spans
            cut[i] += pieces
        reach *= 2


def reconcile(found: list[tuple[float, str, int, int]], fixed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The non-overlapping spans of greatest total confidence times length, away from the fixed ones (weighted interval scheduling)."""
    best: dict[tuple[str, int, int], float] = {}
    for c, *span in found:
        if not any(a < span[2] and span[1] < b for _, a, b in fixed):
            best[tuple(span)] = max(c, best.get(tuple(span), 0.0))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends, value, choice = [s[2] for s in spans], [0.0], []
    for i, (kind, a, b) in enumerate(spans):
        before = int(np.searchsorted(ends, a, side="right"))
        before = min(before, i)
        take = value[before] + best[kind, a, b] * (b - a)
        choice.append((take > value[i], before))
        value.append(max(take, value[i]))
    out, i = [], len(spans)
    while i:
        taken, before = choice[i - 1]
        if taken:
            out.append(spans[i - 1])
        i = before if taken else i - 1
    return out


def find_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    cut: list[list] = [[] for _ in texts]
    if tagger is not None:
        work = [(i, s) for i, t in enumerate(texts) for s in window_starts(t)]
        chars, last = None, -1
        for a in range(0, len(work), BATCH_WINDOWS):
            some, rows = work[a:a + BATCH_WINDOWS], []
            for i, s in some:
                if i != last:
                    chars, last = character_ids(texts[i]), i
                rows.append(_padded(chars, s))
            tags, sure = tagger.decode(np.array(rows))
            for (i, s), t, p in zip(some, tags, sure, strict=True):
                if t.any():
                    spans, pieces = window_spans(texts[i], s, t, p)
                    found[i] += spans
                    cut[i] += pieces
        add_long_spans(texts, base, found, cut, tagger)
    return [(b, sorted(b + reconcile(f, b), key=_place) if f else b) for b, f in zip(base, found, strict=True)]


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row of ``docs``; the counts and the digest are those
    of the pattern spans, ``spans`` are all, in code points with the end exclusive.

    A tagger is trained on ``docs`` unless one is given. Null or empty text has no spans (the digest of the empty string); ids may be
    null; repeated rows are searched each; other columns are ignored; an empty table gives an empty result."""
    tagger = tagger or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(tagger)  # fixed size

    def run(batches):
        for batch in batches:
            rows = []
            for base, every in find_spans(texts_of(batch.column(1)), sent.value):
                rows.append([sum(k == kind for k, _, _ in base) for kind in KINDS]
                            + [hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every)])
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    return source.mapInArrow(tidy(run), f"doc_id {source.schema[0].dataType.simpleString()}, {RESULT}")
