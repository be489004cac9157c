"""Text expressions: cleaning, link removal, repeat collapse, tokenising.

Every function takes and returns a ``Column``; nothing here leaves the JVM.

Regex dialect: Java's ``\\s``/``\\S``/``\\w`` are ASCII-only unless ``(?U)`` is given, while the
source semantics are Python's Unicode-aware ``str.split()``/``str.strip()``. Python's whitespace
set is the Unicode White_Space property plus U+001C..U+001F; Spark patterns use that property
form (one property lookup per character), the DuckDB oracle (RE2, no such property) the same set
spelled out code point by code point (``RE2`` below).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts (str.split()/str.strip() use them).
PY_WHITESPACE = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# The same set as a Java class body: Unicode White_Space plus the four separator controls.
JAVA_WHITESPACE = r"\x{1C}-\x{1F}\p{IsWhite_Space}"

# Link pattern, the multi-underscore rule of the cleaning chain, and the word
# characters of the rule-based tokenizer (letter, mark, digit, apostrophe, underscore, hyphen);
# any other non-whitespace character stands alone as a token.
UNDERSCORES = "__+"
WORD_CHARS = "\\p{L}\\p{M}\\p{N}'_\\x{2D}"


def _patterns(ws_body: str) -> dict:
    ws = "[" + ws_body + "]"
    non_ws = "[^" + ws_body + "]"
    return {
        "WS": ws,
        "NON_WS": non_ws,
        "LINK_PATTERN": "https?://" + non_ws + "+",
        "TOKEN_PUNCT": "([^" + WORD_CHARS + ws_body + "])",
        # one token = one punctuation character, or a maximal run of word characters
        "WORD_TOKEN": "([^" + WORD_CHARS + ws_body + "]|[" + WORD_CHARS + "]+)",
    }


RE2 = _patterns(PY_WHITESPACE)
_J = _patterns(JAVA_WHITESPACE)
WS, NON_WS, LINK_PATTERN, TOKEN_PUNCT, WORD_TOKEN = (_J[k] for k in ("WS", "NON_WS", "LINK_PATTERN", "TOKEN_PUNCT", "WORD_TOKEN"))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), "^" + WS + "+|" + WS + "+$", "")


def collapse_ws(col) -> Column:
    """Python ``' '.join(s.split())``: runs of whitespace become one blank, ends trimmed (after
    the collapse the only whitespace left at the ends is a single blank, which ``trim`` removes)."""
    return F.trim(F.regexp_replace(_c(col), WS + "+", " "))


def remove_links(col, substitute: str = "") -> Column:
    """Drop http(s) links (up to the next whitespace), then strip."""
    return py_strip(F.regexp_replace(_c(col), LINK_PATTERN, substitute))


def remove_repeating_characters(col) -> Column:
    """A run of four or more equal non-word characters collapses to ONE character; strip."""
    return py_strip(F.regexp_replace(_c(col), r"(?U)(\W)\1{3,}", "$1"))


def preprocess_text(col) -> Column:
    """Newline -> blank, remove ``__+``, remove links, strip, collapse whitespace."""
    # the newline -> blank step is subsumed by the final whitespace collapse (no step in between
    # treats a newline differently from a blank)
    c = F.regexp_replace(_c(col), UNDERSCORES, "")
    c = F.regexp_replace(c, LINK_PATTERN, "")  # the strip of remove_links is subsumed by the collapse
    return collapse_ws(c)


def word_tokens(col) -> Column:
    """Rule-based word tokenizer (punctuation split off, whitespace split).

    Used as a join key and a length, so the only contract is that both sides of a join use the
    same rule. Empty or blank text gives an empty array.
    """
    return F.regexp_extract_all(_c(col), F.lit(WORD_TOKEN), 1)


def ws_tokens(col) -> Column:
    """T7 tokens: maximal runs of non-whitespace (``re.finditer(r'\\S+')``)."""
    return F.regexp_extract_all(_c(col), F.lit("(" + NON_WS + "+)"), 1)


def ws_token_spans(col) -> Column:
    """T7 with character offsets: ``array<struct<token, start, end>>`` (0-based, end exclusive),
    equal to ``[(m.group(), m.start(), m.end()) for m in re.finditer(r'\\S+', text)]``.

    Tokens come from the JVM regex; their start offsets from ``token_offsets_batch`` (linear,
    Arrow-batched), zipped in-row. Python UDFs cannot sit inside higher-order functions, so
    compute this as its own column first (``ws_token_spans_inline`` is the JVM-only variant)."""
    c = _c(col)
    return F.zip_with(ws_tokens(c), token_offsets_batch(c),
                      lambda t, s: F.struct(t.alias("token"), s.alias("start"), (s + F.length(t)).alias("end")))


def ws_token_spans_inline(col) -> Column:
    """JVM-only T7 offsets for sentence-sized text (one ``aggregate`` over whitespace /
    non-whitespace runs; appending makes it quadratic in the token count)."""
    runs = F.regexp_extract_all(_c(col), F.lit("(" + WS + "+|" + NON_WS + "+)"), 1)
    init = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("acc"))

    def step(acc, r):
        ln = F.length(r)
        tok = F.struct(r.alias("token"), acc["pos"].alias("start"), (acc["pos"] + ln).alias("end"))
        new_acc = F.when(F.regexp_like(r, F.lit("^" + NON_WS)), F.concat(acc["acc"], F.array(tok))).otherwise(acc["acc"])
        return F.struct((acc["pos"] + ln).alias("pos"), new_acc.alias("acc"))

    return F.aggregate(runs, init, step, lambda a: a["acc"])


def token_offsets_batch(col) -> Column:
    """Start offsets of the whitespace tokens of long texts (documents), as ``array<int>``.

    An Arrow UDF that looks at all characters of a batch at once in numpy: a token starts where a character that is no whitespace follows
    whitespace or the text's start. Tokens themselves come from ``ws_tokens`` (JVM); both use the same whitespace rule."""
    return _token_starts(_c(col))


OFFSET_CHARS = 1 << 18  # characters looked at together; a longer text is taken alone
GROUP_BYTES = 1 << 20


def text_groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of rows with at most ``limit`` bytes of text; a longer text comes alone. A worker that turns one run after the
    other into Python objects holds few of them, however many rows an Arrow batch has."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last - first
        first = last


def _is_space() -> np.ndarray:
    """For each code point up to the last whitespace character, whether it is one (Python's own rule: ``str.isspace``)."""
    return np.array([chr(c).isspace() for c in range(0x3002)])


def _start_offsets(texts: pa.Array) -> pa.Array:
    """``array<int>`` of token starts for an Arrow array of texts (null: null)."""
    space, values, sizes = _is_space(), [], []
    group: list[str] = []

    def flush() -> None:
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = ~space[np.minimum(codes, len(space) - 1)]
        ends = np.cumsum([len(t) for t in group])
        begins = np.concatenate(([0], ends[:-1]))
        first = word.copy()
        first[1:] &= ~word[:-1]
        edge = begins[begins < len(word)]
        first[edge] = word[edge]  # the text before ends here
        at = np.flatnonzero(first)
        bounds = np.searchsorted(at, np.append(begins, len(codes)))
        values.append((at - np.repeat(begins, np.diff(bounds))).astype(np.int32))
        sizes.append(np.diff(bounds))
        group.clear()

    for first, n in text_groups(texts, OFFSET_CHARS):
        group.extend(t or "" for t in texts.slice(first, n).to_pylist())
        flush()
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)) if sizes else [])).astype(np.int32)
    flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=texts.is_null())


def _make_token_starts():
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<int>")
    def token_starts(texts: pa.Array) -> pa.Array:
        try:
            return _start_offsets(texts)
        finally:
            release_unused()

    return token_starts


def release_unused() -> None:
    """Give freed memory back to the system: Python workers live on, and what their allocators hoard would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class _Lazy:
    fn = None


def _token_starts(c: Column) -> Column:
    if _Lazy.fn is None:
        _Lazy.fn = _make_token_starts()
    return _Lazy.fn(c)


def normalize_answer(col) -> Column:
    """Lower-case, drop ASCII punctuation, drop articles a/an/the, collapse whitespace."""
    c = F.lower(_c(col))
    c = F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")
    c = F.regexp_replace(c, r"(?U)\b(a|an|the)\b", " ")
    return collapse_ws(c)


def punct_split(col) -> Column:
    """Split into runs of non-punctuation and single punctuation characters."""
    return F.regexp_extract_all(_c(col), F.lit(r"(\p{P}|[!-/:-@\[-`{-~]|[^\p{P}!-/:-@\[-`{-~]+)"), 1)


def lower_words(col) -> Column:
    """Lower-case, split on blanks, then punctuation split of each piece, empties removed."""
    # one expression over the whole text: a blank is no punctuation and ends a run
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(r"(\p{P}|[!-/:-@\[-`{-~]|[^ \p{P}!-/:-@\[-`{-~]+)"), 1)


# Abbreviations after which a dot ends no sentence (with single letters, as in "J. Smith").
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "vs", "etc", "Inc", "Ltd", "Co", "No", "Fig", "e.g", "i.e", "bzw", "ca", "Nr", "usw", "z.B", "d.h"]


def split_sentences(col) -> Column:
    """T5 (approximation): break after ``.!?`` followed by whitespace and an upper-case letter,
    a quote or a digit, but not after the dot of an abbreviation or of a single capital letter; the newline is a break as well. Returns non-empty
    stripped pieces."""
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    guard = r"(?<!\b(?:" + known + r"|\p{Lu})\.)"
    marked = F.regexp_replace(_c(col), r"(?U)([.!?])" + guard + WS + r"+(?=[\p{Lu}\"'\p{N}])", "$1\u0001")
    marked = F.regexp_replace(marked, "\n", "\u0001")
    parts = F.transform(F.split(marked, "\u0001"), py_strip)
    return F.filter(parts, lambda t: t != F.lit(""))
