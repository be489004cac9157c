"""DuckDB spellings of the SQuAD answer normalisation (oracle only)."""

from quire.catalog.sqlbits import collapse, q

PUNCT = r"[!-/:-@\[-`{-~]"
# Python's \b around a/an/the, emulated with explicit non-word neighbours; two passes catch
# articles that share a separator.
ARTICLE = r"(^|[^\pL\pN_])(a|an|the)([^\pL\pN_]|$)"


def normalize(x: str) -> str:
    c = f"regexp_replace(lower({x}), {q(PUNCT)}, '', 'g')"
    c = f"regexp_replace({c}, {q(ARTICLE)}, '\\1 \\3', 'g')"
    c = f"regexp_replace({c}, {q(ARTICLE)}, '\\1 \\3', 'g')"
    return collapse(c)


def tokens(x: str) -> str:
    return f"list_filter(string_split({normalize(x)}, ' '), lambda t: t <> '')"


def bag_f1(g: str, p: str) -> str:
    same = (f"list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), "
            f"len(list_filter({g}, lambda x: x = t)))))")
    return (f"CASE WHEN len({g}) = 0 OR len({p}) = 0 THEN CASE WHEN len({g}) = len({p}) THEN 1.0 ELSE 0.0 END "
            f"WHEN coalesce({same}, 0) = 0 THEN 0.0 "
            f"ELSE 2.0 * ({same} / len({p})) * ({same} / len({g})) / (({same} / len({p})) + ({same} / len({g}))) END")
