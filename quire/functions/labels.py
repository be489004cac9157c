"""Label-array expressions (N1-N12, R4, R16-R19, W6): higher-order functions on one row.

Every operator here works inside a row (``transform`` / ``filter`` / ``aggregate``), so it
needs no shuffle; sequential state machines (IOB1->IOB2, IOB->spans) are one ``aggregate``
over the row's array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels ignored when spans are turned into tags.
IGNORED_SPAN_LABELS = ["[PAD]", "X"]
SEP = "[SEP]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Higher-order functions re-evaluate every non-lambda expression inside their lambda for each
    element; binding a computed array first keeps per-row work linear instead of quadratic.
    (``aggregate`` over a one-element array with ``value`` as the start, finished by ``fn``.)"""
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _x: acc, fn)


def _indices(arr: Column) -> Column:
    """0..size-1 (empty for an empty array; ``sequence(0,-1)`` would count down)."""
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(F.array().cast("array<int>"))


def split_at_sep(tokens: Column, labels: Column | None = None, sep: str = SEP) -> Column:
    """Split at every ``sep`` token; returns ``array<struct<tokens[, labels]>>``. Empty
    sentences (doubled, leading or trailing separators) are kept; labels are sliced in parallel."""
    def body(toks, labs):
        n = F.size(toks)
        seps = F.filter(_indices(toks), lambda i: F.get(toks, i) == F.lit(sep))

        def with_bounds(bounds):
            def piece(j):
                lo = F.get(bounds, j) + 1
                ln = F.get(bounds, j + 1) - lo
                fields = [F.slice(toks, lo + 1, ln).alias("tokens")]
                if labs is not None:
                    fields.append(F.slice(labs, lo + 1, ln).alias("labels"))
                return F.struct(*fields)

            return F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), piece)

        return let(F.concat(F.array(F.lit(-1)), seps, F.array(n)), with_bounds)

    if labels is None:
        return let(_c(tokens), lambda t: body(t, None))
    return let(_c(tokens), lambda t: let(_c(labels), lambda l: body(t, l)))


def join_with_sep(arrays: Column, sep: str) -> Column:
    """Flatten sentences with ``sep`` between consecutive ones."""
    def body(arrs):
        n = F.size(arrs)
        return F.flatten(F.transform(arrs, lambda a, i: F.when(i < n - 1, F.concat(a, F.array(F.lit(sep)))).otherwise(a)))

    return let(_c(arrays), body)


def strip_bi(labels) -> Column:
    """Remove the first ``B-``/``I-`` prefix of every label."""
    return F.transform(_c(labels), lambda x: F.regexp_replace(x, "^[BI]-", ""))


def labels_to_iob(labels) -> Column:
    """Plain labels -> IOB2; a label equal to the previous one continues (``I-``)."""
    def body(arr):
        return F.transform(
            arr,
            lambda x, i: F.when(x == "O", x)
            .when((i > 0) & (x == F.get(arr, i - 1)), F.concat(F.lit("I-"), x))
            .otherwise(F.concat(F.lit("B-"), x)),
        )

    return let(_c(labels), body)


def iob_to_binary(labels) -> Column:
    """``O`` -> 0, anything else -> 1."""
    return F.transform(_c(labels), lambda x: F.when(x == "O", 0).otherwise(1))


def iob1_to_iob2(tags) -> Column:
    """IOB1 -> IOB2. An ``I-x`` that starts the sentence, follows ``O`` or follows another
    type becomes ``B-x``. At the first malformed tag (not ``O``, not ``B-x``/``I-x`` with exactly
    one dash) conversion stops and later tags are returned unchanged."""
    def bad(x):
        return (x != "O") & ((F.size(F.split(x, "-")) != 2) | ~F.substring(x, 1, 1).isin("B", "I"))

    def body(arr):
        first_bad = F.coalesce(F.array_min(F.filter(_indices(arr), lambda i: bad(F.get(arr, i)))), F.size(arr))
        return let(first_bad.cast("int"), lambda fb: F.transform(
            arr,
            lambda x, i: F.when(
                (i < fb)
                & (x != "O")
                & (F.substring(x, 1, 1) == "I")
                & ((i == 0) | (F.get(arr, i - 1) == "O") | (F.substring(F.get(arr, i - 1), 2, 10**6) != F.substring(x, 2, 10**6))),
                F.concat(F.lit("B"), F.substring(x, 2, 10**6)),
            ).otherwise(x),
        ))

    return let(_c(tags), body)


def spans_to_iob(text, spans, words=None) -> Column:
    """Character spans ``array<struct<start,end,label>>`` -> IOB2 tags over the whitespace
    words of ``text``. ``[PAD]``/``X`` spans are ignored; a span whose start is not a word start
    is skipped; a span whose end is not a word end makes the whole result NULL (to be routed to
    the quarantine table by the caller). Later spans overwrite earlier ones."""
    def body(words):
        idx = _indices(words)

        def span_info(s):
            bi = F.coalesce(F.array_min(F.filter(idx, lambda i: F.get(words, i)["start"] == s["start"])), F.lit(-1))
            same = (bi >= 0) & (F.get(words, bi)["end"] == s["end"])
            later = F.array_min(F.filter(idx, lambda j: (j > bi) & (F.get(words, j)["end"] == s["end"])))
            ei = F.when(bi < 0, F.lit(-1)).when(same, bi).otherwise(F.coalesce(later, F.lit(-2)))
            return F.struct(bi.alias("bi"), ei.alias("ei"), s["label"].alias("label"))

        def tag(live):
            tags = F.transform(
                idx,
                lambda i: F.aggregate(
                    live,
                    F.lit("O"),
                    lambda acc, s: F.when((s["bi"] <= i) & (i <= s["ei"]),
                                          F.concat(F.when(i == s["bi"], F.lit("B-")).otherwise(F.lit("I-")), s["label"])).otherwise(acc),
                ),
            )
            return F.when(F.exists(live, lambda s: s["ei"] == -2), F.lit(None)).otherwise(tags)

        live = F.filter(F.transform(_c(spans), span_info), lambda s: ~s["label"].isin(*IGNORED_SPAN_LABELS) & (s["bi"] >= 0))
        return let(live, tag)

    from quire.functions.text import ws_token_spans_inline

    return let(_c(words) if words is not None else ws_token_spans_inline(_c(text)), body)


def spans_to_binary(spans) -> Column:
    """Span labels -> ints; ``[PAD]``/``X`` -> 0."""
    return F.transform(_c(spans), lambda s: F.when(s["label"].isin(*IGNORED_SPAN_LABELS), 0).otherwise(s["label"].cast("int")))


def _tag_runs(tags: Column, fn, kept) -> Column:
    """``fn(first index, last index)`` of every run of an IOB array whose first tag passes ``kept``: a run goes on while ``I-x`` follows ``B-x`` or ``I-x``. Runs come from their
    borders, so the work is linear in the tags."""
    def linked(i):
        t, before = F.get(tags, i), F.get(tags, i - 1)
        return (i > 0) & t.startswith("I-") & (before.startswith("B-") | before.startswith("I-")) & (F.substring(t, 3, 10**6) == F.substring(before, 3, 10**6))

    borders = F.concat(F.filter(_indices(tags), lambda i: ~F.coalesce(linked(i), F.lit(False))), F.array(F.size(tags)))
    return let(borders, lambda at: F.transform(
        F.filter(F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda first, k: F.struct(first.alias("a"), (F.get(at, k + 1) - 1).alias("b"))),
                 lambda r: kept(F.get(tags, r["a"]))), lambda r: fn(r["a"], r["b"])))


def iob_to_spans(tags, probs=None, score: str = "next") -> Column:
    """IOB tags -> entities ``array<struct<tag, start, end, prob>>`` (token indices, end inclusive).

    ``I-x`` continuing an open ``x`` extends it; ``I-`` of another type closes the open entity
    and does not open one; ``O`` closes. ``score='next'`` keeps the reference's probability (of
    the token that closes the entity, or the last token); ``score='mean'`` averages the entity."""
    def spans(arr, pr):
        def one(first, last):
            if score == "mean":
                part = F.slice(pr, first + 1, last - first + 1)
                total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double"))
                prob = F.when(first == last, F.get(pr, first).cast("double") + 0.0).otherwise(total / (last - first + 1))
            else:
                prob = F.get(pr, F.least(last + 1, F.size(arr) - 1)).cast("double")
            return F.struct(F.substring(F.get(arr, first), 3, 10**6).alias("tag"), first.alias("start"), last.alias("end"), prob.alias("prob"))

        return _tag_runs(arr, one, lambda t: t.startswith("B-"))

    given = _c(probs) if probs is not None else None
    return let(_c(tags), lambda arr: let(given if given is not None else F.transform(arr, lambda x: F.lit(1.0)), lambda pr: spans(arr, pr)))


def lenient_chunks(tags) -> Column:
    """Entity chunks for entity-level scoring (M8): like ``iob_to_spans`` but an ``I-x`` that does
    not continue an open ``x`` starts a new entity. Returns ``array<struct<tag,start,end>>``."""
    def chunks(arr):
        return _tag_runs(arr, lambda first, last: F.struct(F.substring(F.get(arr, first), 3, 10**6).alias("tag"), first.alias("start"), last.alias("end")),
                         lambda t: t.startswith("B-") | t.startswith("I-"))

    return let(_c(tags), chunks)


def word_to_token_labels(word_labels, initial_mask, filler: str = "X") -> Column:
    """Word labels spread over sub-word tokens: the k-th word-initial token gets the k-th
    word label (NULL where there are fewer labels), other tokens ``filler``. Put together word by word, linear in the tokens."""
    def spread(wl, mask, at):
        def word(first, k):
            size = F.coalesce(F.get(at, k + 1), F.size(mask)) - first
            label = F.array(F.get(wl, k).cast("string"))
            return let(size, lambda n: F.when(n == 1, label).otherwise(F.concat(label, F.array_repeat(F.lit(filler), n - 1))))

        head = F.array_repeat(F.lit(filler), F.coalesce(F.get(at, 0), F.size(mask)))
        return F.concat(head, F.flatten(F.transform(at, word)))

    return let(_c(word_labels), lambda wl: let(_c(initial_mask), lambda mask: let(
        F.filter(_indices(mask), lambda i: F.get(mask, i) == 1), lambda at: spread(wl, mask, at))))


def token_record(tokens, initial_mask, word_labels, width: int, filler: str = "X", pad_token: str = "[PAD]") -> Column:
    """One sequence as a record of fixed width: ``struct<tokens, padding_mask, segment_ids, initial_mask, labels, n>``, every array of
    ``width`` elements. Labels are those of N10; padding has ``pad_token``, ``filler`` and zeros. More than ``width`` tokens, or a number of labels other than
    that of word-initial tokens (N12), give NULL, to be routed to the quarantine table by the caller."""
    def packed(toks, mask, wl):
        n = F.size(toks)
        ok = (n <= width) & (F.size(mask) == n) & (F.size(F.filter(mask, lambda m: m == 1)) == F.size(wl))
        record = F.struct(pad_to(toks, width, pad_token).alias("tokens"), pad_to(F.array_repeat(F.lit(1), n), width).alias("padding_mask"),
                          F.array_repeat(F.lit(0), width).alias("segment_ids"), pad_to(mask, width).alias("initial_mask"),
                          pad_to(word_to_token_labels(wl, mask, filler), width, filler).alias("labels"), n.alias("n"))
        return F.when(ok, record)

    return let(_c(tokens), lambda toks: let(_c(initial_mask), lambda mask: let(_c(word_labels), lambda wl: packed(toks, mask, wl))))


def pad_to(arr, n, value=0) -> Column:
    """Right-pad ``arr`` with ``value`` up to length ``n`` (never truncates). The array is computed once."""
    nn = _c(n) if not isinstance(n, int) else F.lit(n)
    return let(_c(arr), lambda a: F.concat(a, F.array_repeat(F.lit(value), F.greatest(nn - F.size(a), F.lit(0)))))


def pad_left(arr, n, value=0) -> Column:
    nn = _c(n) if not isinstance(n, int) else F.lit(n)
    return let(_c(arr), lambda a: F.concat(F.array_repeat(F.lit(value), F.greatest(nn - F.size(a), F.lit(0))), a))


def misaligned(a, b) -> Column:
    """token/label arrays of different length."""
    return F.size(_c(a)) != F.size(_c(b))


def run_starts(labels) -> Column:
    """1 where a label differs from the previous one (previous-row comparison in-array)."""
    arr = _c(labels)
    return F.transform(arr, lambda x, i: F.when((i == 0) | (x != F.get(arr, i - 1)), 1).otherwise(0))


def array_mode(values) -> Column:
    """Most frequent element of an array; ties -> the smallest element (deterministic). The array and its counts are bound once."""
    def best(counted):
        return F.aggregate(counted, F.get(counted, 0), lambda acc, s: F.when(s["n"] > acc["n"], s).otherwise(acc))["v"]

    def counts(vals):
        return F.transform(F.array_sort(F.array_distinct(vals)),
                           lambda v: F.struct(F.size(F.filter(vals, lambda x: x == v)).alias("n"), v.alias("v")))

    return let(_c(values), lambda vals: let(counts(vals), best))


def argmax_prob(logits) -> Column:
    """Arg-max class index and its softmax probability from an array of logits."""
    def both(arr, mx):
        z = F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.exp(x - mx))
        return F.struct((F.array_position(arr, mx) - 1).cast("int").alias("label_id"), (F.lit(1.0) / z).alias("probability"))

    return let(_c(logits), lambda arr: let(F.array_max(arr), lambda mx: both(arr, mx)))


def multilabel_decision(label_list, logits, threshold: float = 0.5) -> Column:
    """Labels whose sigmoid exceeds ``threshold`` (strict)."""
    z = F.arrays_zip(_c(label_list).alias("l"), _c(logits).alias("x"))
    return F.transform(F.filter(z, lambda s: F.lit(1.0) / (F.lit(1.0) + F.exp(-s["x"])) > threshold), lambda s: s["l"])


def select_initial(seq, mask) -> Column:
    """Keep elements at word-initial positions (mask = 1)."""
    return F.transform(F.filter(F.arrays_zip(_c(seq).alias("v"), _c(mask).alias("m")), lambda s: s["m"] == 1), lambda s: s["v"])


def masked_pairs(preds, labels) -> Column:
    """(prediction, label) pairs where the label is not -1."""
    z = F.arrays_zip(_c(preds).alias("p"), _c(labels).alias("l"))
    return F.filter(z, lambda s: s["l"] != -1)


def multi_hot(label_list, raw, sep: str = ",") -> Column:
    """Multi-hot vector over ``label_list`` from a comma separated string (empty pieces ignored)."""
    pieces = F.filter(F.split(_c(raw), sep), lambda p: p != "")
    return F.transform(_c(label_list), lambda l: F.array_contains(pieces, l).cast("int"))
