"""Licence scan: Aho-Corasick finds notice phrases and identifier tags; a shunting-yard parser
evaluates the licence expression after a tag.

One pass over each text where it is read, no shuffle, and the automaton is a fixed small list.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import tidy
from quire.llm.wordscan import automaton, line_of, starts_in, texts_of, words_of

# Phrases and labels that the scan must know.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notice phrases of public licences.
NOTICES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(r"SPDX[^A-Za-z0-9\n]License[^A-Za-z0-9\n]Identifier\s*:?[ \t]*([^\n\r]*)", re.I)

# How freely a licence family lets a text be used, 1 (public domain) to 0 (all rights reserved).
FREEDOM = {"public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "bsl": 0.9, "apache": 0.9,
           "zlib": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3,
           "cc-by-nc": 0.2, "cc-by-nd": 0.2, "reserved": 0.0}
UNKNOWN = 0.5
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")


def freedom(identifier: str) -> float:
    """Freedom of the longest known family that begins the identifier."""
    known = [k for k in FREEDOM if identifier == k or identifier.startswith(k + "-")]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


def to_postfix(text: str) -> list[str]:
    """Shunting-yard: the expression that ``text`` begins with, in postfix order.

    Reading stops at the first token that cannot continue the expression, so prose after it does no
    harm; an operator that lacks its right side and an unclosed bracket are dropped."""
    out, ops, want_id = [], [], True
    for tok in TOKEN.findall(text):
        low = tok.lower().rstrip(".:")
        if tok == "(":
            if not want_id:
                break
            ops.append("(")
        elif tok == ")":
            if want_id or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif low in PRECEDENCE:
            if want_id:
                break
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            want_id = True
        elif low:
            if not want_id:
                break
            out.append(low)
            want_id = False
    if want_id and ops:  # dangling operators and brackets
        while ops and want_id:
            want_id = ops.pop() == "("
    return out + [o for o in reversed(ops) if o != "("]


def evaluate(text: str) -> tuple[set[str], float | None]:
    """Licence ids of the expression and its freedom: ``or`` lets the reader choose the freer side, ``and``
    binds to the stricter one, ``with`` adds an exception that can only loosen its licence."""
    stack: list[tuple[set[str], float]] = []
    for tok in to_postfix(text):
        if tok not in PRECEDENCE:
            stack.append(({tok}, freedom(tok)))
            continue
        (right_ids, right), (left_ids, left) = stack.pop(), stack.pop()
        if tok == "with":
            stack.append((left_ids, max(left, FREEDOM["lgpl"]) if left > 0 else left))
        else:
            stack.append((left_ids | right_ids, max(left, right) if tok == "or" else min(left, right)))
    return stack[0] if stack else (set(), None)


def _patterns() -> dict[str, tuple[str, str]]:
    out = {f" {p} ": ("base", label) for p, label in BASE.items()}
    out |= {f" {p} ": ("notice", label) for p, label in NOTICES.items()}
    out[f" {TAG} "] = ("tag", "")
    return out


def scan_text(text: str, a) -> tuple:
    words = words_of(text)
    line = line_of(words)
    hits = [(end, kind, label) for end, (kind, label, _) in a.iter(line)]
    lengths = [n for _, (_, _, n) in a.iter(line)] if hits else []
    starts = (starts_in(line, [e for e, _, _ in hits]) - lengths).tolist() if hits else []
    base = [(s, label) for s, (_, kind, label) in zip(starts, hits, strict=True) if kind == "base"]
    labels = {label for _, kind, label in hits if kind != "tag"}
    freedoms = [freedom(label) for label in labels]
    notices = [{"label": label, "word": s} for s, (_, kind, label) in zip(starts, hits, strict=True) if kind != "tag"]
    if any(kind == "tag" for _, kind, _ in hits):
        for m in TAG_TEXT.finditer(text):
            ids, value = evaluate(m[1])
            if value is not None:
                labels |= ids
                freedoms.append(value)
    return (len(words), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None),
            ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)),
            round(1.0 - min(freedoms, default=1.0), 6), notices)


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, notices array<struct<label:string,word:long>>")


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id`` of each row with the notices found: ``n_words``, ``n_base`` (all places of the base phrases),
    ``first_word``/``last_word`` (their smallest and largest start, null without any), ``base_labels``,
    ``labels`` (with notices and tag expressions), ``score`` (0: nothing restricts the text, 1: all
    rights reserved; the strictest notice counts) and ``notices``.

    Null or empty text has no words, no labels and score 0; repeated rows are scanned each; an
    empty table gives an empty result; other columns are ignored."""
    def scan(batches):
        a = automaton({p: (kind, label, p.count(" ") - 1) for p, (kind, label) in _patterns().items()})
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(),
                                    pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))]
        for batch in batches:
            rows = [scan_text(t, a) for t in texts_of(batch.column(1))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_base", "first_word", "last_word",
                                                            "base_labels", "labels", "score", "notices"])

    source = docs.select("doc_id", F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(tidy(scan), f"doc_id {source.schema[0].dataType.simpleString()}, {RESULT}")
