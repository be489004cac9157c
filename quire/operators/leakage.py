"""Train/test leakage: array-key joins and the containment join.

Token arrays are compared through a 64-bit key (``xxhash64`` of the joined tokens) **and** the
arrays themselves, so the hash join is exact. Nothing here is a nested loop: the reference's
``test x train`` loops become one semi/anti join each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import winnow
from quire.plans.bitset import maybe_in
from quire.plans.scalar import scalar_join
from quire.session import checkpoint_dir

SEP = "[SEP]"


def token_key(tokens) -> Column:
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.xxhash64(F.array_join(c, "\u0001"))


def _keyed(df: DataFrame, tokens: str, kname: str = "__k") -> DataFrame:
    return df.withColumn(kname, token_key(tokens))


def _match_cond(left: DataFrame, right: DataFrame, ltok: str, rtok: str):
    return (left["__k"] == right["__rk"]) & (left[ltok] == right[rtok])


def test_keys(test: DataFrame, tokens: str) -> DataFrame:
    """Distinct test token arrays with their key (columns ``__rk``, ``__rtok``)."""
    return test.select(token_key(tokens).alias("__rk"), F.col(tokens).alias("__rtok")).distinct()


def matching_rows(train: DataFrame, test: DataFrame, train_tokens: str, test_tokens: str) -> DataFrame:
    """Train rows whose token array occurs in the test set (``left_semi``)."""
    k = _keyed(train, train_tokens)
    t = test_keys(test, test_tokens)
    return k.join(t, _match_cond(k, t, train_tokens, "__rtok"), "left_semi").drop("__k")


def remove_all_matches(train: DataFrame, test: DataFrame, train_tokens: str, test_tokens: str) -> DataFrame:
    """U4 / J2 sentence step: every train row whose token array occurs in the test set is removed."""
    k = _keyed(train, train_tokens)
    t = test_keys(test, test_tokens)
    return k.join(t, _match_cond(k, t, train_tokens, "__rtok"), "left_anti").drop("__k")


def first_matches(train: DataFrame, test: DataFrame, train_tokens: str, test_tokens: str,
                  order_cols: Sequence[str]) -> DataFrame:
    """The train rows J1 removes: for every distinct test token array, the matching train row with
    the smallest ``order_cols`` (``min(struct(order))`` per key, a map-side partial aggregate).
    Output: ``order_cols`` only."""
    order_cols = list(order_cols)
    hits = matching_rows(train.select(*order_cols, train_tokens), test, train_tokens, test_tokens)
    return (
        hits.groupBy(token_key(train_tokens).alias("__k"), F.col(train_tokens).alias("__t"))
        .agg(F.min(F.struct(*[F.col(c) for c in order_cols])).alias("__m"))
        .select(*[F.col("__m." + c).alias(c) for c in order_cols])
    )


def remove_first_matches(train: DataFrame, test: DataFrame, train_tokens: str, test_tokens: str,
                         order_cols: Sequence[str]) -> DataFrame:
    """For every distinct test token array, only the FIRST matching train row (smallest
    ``order_cols``) is removed; later equal train rows stay (the reference breaks after the
    first hit)."""
    return train.join(first_matches(train, test, train_tokens, test_tokens, order_cols), list(order_cols), "left_anti")


def explode_instances(df: DataFrame, id_col: str, tokens: str, labels: str | None = None) -> DataFrame:
    """N1 for tables: ``(id, tokens[, labels])`` with ``[SEP]`` markers -> one row per sentence
    ``(id, sent_idx, tokens[, labels])``; empty sentences are kept."""
    from quire.functions.labels import split_at_sep

    parts = split_at_sep(F.col(tokens), F.col(labels) if labels else None)
    out = df.select(F.col(id_col), F.posexplode(parts).alias("sent_idx", "__s"))
    cols = [F.col(id_col), F.col("sent_idx"), F.col("__s.tokens").alias("tokens")]
    if labels:
        cols.append(F.col("__s.labels").alias("labels"))
    return out.select(*cols)


def regroup_instances(sent: DataFrame, id_col: str, with_labels: bool = True) -> DataFrame:
    """N2 for tables: sentences back into one instance, ordered by ``sent_idx``, separated by
    ``[SEP]`` (label ``O``). Groups are single instances (the size of one input row)."""
    from quire.functions.labels import join_with_sep

    fields = [F.col("sent_idx"), F.col("tokens")] + ([F.col("labels")] if with_labels else [])
    g = sent.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__ss"))
    cols = [F.col(id_col), join_with_sep(F.transform("__ss", lambda s: s["tokens"]), SEP).alias("tokens"),
            F.size("__ss").alias("n_sentences")]
    if with_labels:
        cols.append(join_with_sep(F.transform("__ss", lambda s: s["labels"]), "O").alias("labels"))
    return g.select(*cols)


def remove_sentences_from_instances(instances: DataFrame, test: DataFrame, id_col: str, tokens: str, labels: str,
                                    test_tokens: str) -> DataFrame:
    """Drop ALL sentences of an instance that occur in the test set and rebuild the instance;
    an instance whose sentences are all removed disappears. Adds ``n_sentences``, ``n_removed``
    and the no-trigger count of the kept sentences (A3).

    One shuffle of narrow rows: an instance sends (id, sentence index, 64-bit key) of the sentences that a bit set does not rule out;
    they meet the distinct test sentences; a hit brings the test sentence's tokens back, so that equality is checked where the instance is rebuilt, in one
    pass over its array. Adaptive execution picks the join by the hits' measured size."""
    from quire.functions.labels import join_with_sep, let, split_at_sep

    keys = let(split_at_sep(F.col(tokens)), lambda ps: F.transform(ps, lambda p: F.xxhash64(F.array_join(p["tokens"], "\u0001"))))
    sents = instances.select(id_col, F.posexplode(keys).alias("__i", "__k"))
    t = test_keys(test, test_tokens)
    near = maybe_in(sents, t.withColumnRenamed("__rk", "__k"), "__k")
    hits = near.join(t, near["__k"] == t["__rk"]).groupBy(id_col).agg(
        F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__rtok").alias("t"))).alias("__hits"))  # within one instance
    j = instances.select(id_col, tokens, labels).join(hits, id_col, "left")
    rm = F.col("__hits")

    def rebuilt(parts):
        kept = F.when(rm.isNull(), parts).otherwise(F.filter(parts, lambda p, i: ~F.exists(rm, lambda h: (h["i"] == i) & (h["t"] == p["tokens"]))))
        return F.struct(F.size(parts).alias("n"), kept.alias("kept"))

    out = j.select(F.col(id_col), let(split_at_sep(F.col(tokens), F.col(labels)), rebuilt).alias("__x")).select(id_col, "__x.n", "__x.kept").select(
        F.col(id_col),
        join_with_sep(F.transform("kept", lambda x: x["tokens"]), SEP).alias("tokens"),
        join_with_sep(F.transform("kept", lambda x: x["labels"]), "O").alias("labels"),
        F.size("kept").alias("n_sentences"),
        (F.col("n") - F.size("kept")).alias("n_removed"),
        F.size(F.filter("kept", lambda x: ~F.array_contains(x["labels"], "B-trigger"))).alias("n_without_trigger"),
    )
    return out.filter(F.size("tokens") > 0)


# --- J4: containment join --------------------------------------------------------------------


def _chosen_keys(items: DataFrame, docs: DataFrame, sample: float) -> DataFrame:
    """``id, level, key, key2``: of every item's keys the one that is rarest in a sample of the documents (ties: the least). The sample
    steers the plan only: every document is searched."""
    levels = _levels(items)
    per = winnow.item_keys(items, "__iid", "__itext").filter(F.col("level") >= winnow.EXACT)
    part = docs.sample(False, sample, seed=17) if sample < 1 else docs
    seen = winnow.document_keys(part, "__did", "__dtext", [lv for lv in levels if lv >= winnow.EXACT])
    freq = seen.join(per.select("level", "key").distinct(), ["level", "key"], "left_semi").groupBy("level", "key").agg(F.count(F.lit(1)).alias("__f"))
    return per.join(freq, ["level", "key"], "left").groupBy("id", "level").agg(
        F.min_by("key", F.struct(F.coalesce("__f", F.lit(0)), F.col("key"))).alias("key"))


def _levels(items: DataFrame) -> list[int]:
    """Levels that occur: at most ``EXACT + len(LEVELS)`` numbers reach the driver."""
    level = winnow.level_of(F.length("__itext"))
    return sorted(r[0] for r in items.select(level.alias("l")).filter("l is not null").distinct().collect())


def containment_first_doc(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text",
                          doc_id: str = "doc_id", doc_text: str = "text", anchor_sample: float = 1 / 16) -> DataFrame:
    """For every item (sentence) the smallest ``doc_id`` whose text contains it (Python ``in``).

    Never a cross join: a minimizer index (``functions.winnow``) over both sides. Equal item texts are searched once. Items of 16 and more
    characters meet the documents on ONE of their winnowing keys, which any document that contains them has too, whatever the
    characters are and wherever the item stands; ``contains`` verifies the candidates. Shorter items are compared as a whole with the
    documents' grams of their length (two independent 64-bit hashes), reduced to the least ``doc_id`` a gram before anything is
    joined, so a short item that stands in every document makes no pairs. The empty item is contained in every document.

    Skew: boilerplate (a licence line, an URL's first part) would turn into all (item, document) pairs of a hot key. Every key of
    an item is a choice; frequencies are estimated on a seeded ``anchor_sample`` of the documents and the item keeps its
    RAREST key. The result does not depend on the sample. Output: ``item_id, doc_id``; items contained in no document, null items among
    them, are absent; null documents contain nothing."""
    named = items.select(F.col(item_id).alias("__id"), F.col(item_text).cast("string").alias("__itext")).filter("__itext is not null")
    text_key = F.struct(F.xxhash64("__itext").alias("a"), F.md5("__itext").alias("b"))
    named = named.withColumn("__iid", F.concat_ws(":", text_key["a"].cast("string"), text_key["b"]))
    it = named.groupBy("__iid").agg(F.first("__itext").alias("__itext"))
    d = docs.select(F.col(doc_id).alias("__did"), F.col(doc_text).cast("string").alias("__dtext")).filter("__dtext is not null")

    levels = _levels(it)
    long_levels, short = [lv for lv in levels if lv >= winnow.EXACT], [lv for lv in levels if lv < winnow.EXACT]
    found = []
    if long_levels:
        checkpoint_dir(items.sparkSession)
        chosen = _chosen_keys(it, d, anchor_sample).withColumnRenamed("id", "__iid").checkpoint()  # one narrow row an item, used twice
        keys = maybe_in(winnow.document_keys(d, "__did", "__dtext", long_levels).withColumnRenamed("id", "__did"), chosen, "key")
        cand = keys.join(chosen, ["level", "key"]).select("__did", "__iid").distinct()
        found.append(d.join(cand, "__did").join(it, "__iid").filter(F.contains("__dtext", "__itext")).groupBy("__iid").agg(F.min("__did").alias("__did")))
    if short:
        wanted = winnow.item_keys(it, "__iid", "__itext").filter(F.col("level") < winnow.EXACT).withColumnRenamed("id", "__iid")
        grams = maybe_in(winnow.document_keys(d, "__did", "__dtext", short), wanted, "key")
        hit = grams.join(wanted.drop("__iid"), ["level", "key", "key2"], "left_semi").groupBy("level", "key", "key2").agg(F.min("id").alias("__did"))
        found.append(wanted.join(hit, ["level", "key", "key2"]).select("__iid", "__did"))
    empty = it.filter(F.length("__itext") == 0).select("__iid")
    first_doc = d.agg(F.min("__did").alias("__did"))
    found.append(scalar_join(empty, F.broadcast(first_doc)).filter("__did is not null").select("__iid", "__did"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return named.join(hits, "__iid").select(F.col("__id").alias(item_id), F.col("__did").alias(doc_id)).groupBy(item_id).agg(F.min(doc_id).alias(doc_id))


def split_without_leakage(train: DataFrame, test: DataFrame, tokens: str, key_cols: Sequence[str], seed, dev_fraction: float = 0.2,
                          test_tokens: str | None = None) -> DataFrame:
    """Dev rows drawn only from the rows of ``train`` whose tokens do not occur in ``test``. The dev set has
    ``round(dev_fraction * all rows)`` rows (half to even); too few clean rows are an error. Output: ``key_cols, split``."""
    from quire.operators.splits import exact_split

    k = _keyed(train.select(*key_cols, tokens), tokens)
    t = test_keys(test, test_tokens or tokens).withColumn("__dup", F.lit(True))
    flagged = k.join(t, _match_cond(k, t, tokens, "__rtok"), "left").select(*key_cols, F.coalesce("__dup", F.lit(False)).alias("__dup"))
    n, n_clean = flagged.agg(F.count(F.lit(1)), F.count_if(~F.col("__dup"))).first()
    size = round(n * dev_fraction)
    if n_clean < size:
        raise ValueError(f"{n_clean} rows without a duplicate are too few for a dev set of {size}")
    clean = flagged.filter(~F.col("__dup")).withColumn("__key", F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols]))
    split = exact_split(clean, "__key", seed, size) if size else clean.withColumn("split", F.lit("train"))
    return split.select(*key_cols, "split").unionByName(
        flagged.filter("__dup").select(*key_cols, F.lit("train").alias("split")))


def overlap_summary(pairs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """Number of common pairs, documents and sentences (the reference counts are not
    distinct, so all three are equal; the distinct document count is reported too)."""
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count(doc_id).alias("n_docs"),
        F.count(item_id).alias("n_sentences"),
        F.countDistinct(doc_id).alias("n_distinct_docs"),
    )
