"""DuckDB spellings of the text rules, for the oracle SQL texts.

The constants are shared with the Spark expressions (one definition of the rule); the SQL is
written independently of the DataFrame code.
"""

from quire.functions.text import RE2, UNDERSCORES

WS, NON_WS, LINK_PATTERN, WORD_TOKEN = RE2["WS"], RE2["NON_WS"], RE2["LINK_PATTERN"], RE2["WORD_TOKEN"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def preprocess(x: str) -> str:
    c = f"replace({x}, chr(10), ' ')"
    c = f"regexp_replace({c}, {q(UNDERSCORES)}, '', 'g')"
    c = f"regexp_replace({c}, {q(LINK_PATTERN)}, '', 'g')"
    return collapse(c)


def word_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(WORD_TOKEN)}, 1)"


def ws_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q('(' + NON_WS + '+)')}, 1)"


def seeded_hash(seed, *keys: str) -> str:
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5({inner}), 1, 15)) AS BIGINT)"
