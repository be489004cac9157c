"""Training-table builders: record expansion and label preparation (Q16, Q19-Q21, J13, R5-R9,
A7, T15, U7, U8, L16, L17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.metrics import scalar_join
from quire.plans.hashing import seeded_hash, seeded_unit
from quire.plans.ordered import ordered_index


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pairs_to_rows(df: DataFrame, query: str, pos: str, neg: str) -> DataFrame:
    """Q16: (query, positive, negative) -> two rows (query, passage, label 1 / 0)."""
    return df.select(_c(query).alias("query"), F.explode(F.array(
        F.struct(_c(pos).alias("passage"), F.lit(1).alias("label")),
        F.struct(_c(neg).alias("passage"), F.lit(0).alias("label")))).alias("r")).select("query", "r.*")


def next_sentence_pairs(docs: DataFrame, doc_id: str, lines: str, seed: int = 0, p_next: float = 0.5) -> DataFrame:
    """Q19 + J13: consecutive sentence pairs inside each document (in-row, no shuffle); with
    probability ``1 - p_next`` the second sentence is replaced by a sentence of ANOTHER document.

    The partner document is chosen without retries or cross joins: documents get a dense index
    ``i`` (P0), and the partner is ``(i + 1 + h mod (n-1)) mod n`` with a seeded hash ``h`` - never
    ``i`` itself; its sentence is ``h2 mod n_lines``. The partner lookup is an equi-join. Needs
    at least 2 documents. Output: ``doc_id, line_no, first, second, is_next, partner_doc``."""
    idx = ordered_index(docs.select(doc_id, lines), [doc_id], name="__i", total="__n")
    pairs = idx.select(doc_id, "__i", "__n", F.posexplode(F.arrays_zip(
        F.slice(_c(lines), 1, F.greatest(F.size(_c(lines)) - 1, F.lit(0))).alias("a"),
        F.slice(_c(lines), 2, F.greatest(F.size(_c(lines)) - 1, F.lit(0))).alias("b"))).alias("line_no", "z"))
    pairs = pairs.withColumn("__u", seeded_unit(seed, doc_id, "line_no")).withColumn("is_next", F.col("__u") < p_next)
    h = seeded_hash(seed + 1, doc_id, "line_no")
    pairs = pairs.withColumn("__partner", (F.col("__i") + 1 + h % F.greatest(F.col("__n") - 1, F.lit(1))) % F.col("__n"))
    own = pairs.filter("is_next").select(doc_id, "line_no", F.col("z.a").alias("first"), F.col("z.b").alias("second"), "is_next",
                                         F.lit(None).cast(docs.schema[doc_id].dataType).alias("partner_doc"))
    # only replaced rows are joined, first with the partner's number of lines, then with one of its lines
    about = idx.select(F.col("__i").alias("__partner"), F.col(doc_id).alias("partner_doc"), F.size(_c(lines)).alias("__size"))
    every = idx.select(F.col("__i").alias("__partner"), F.posexplode(_c(lines)).alias("__k", "second"))
    other = pairs.filter(~F.col("is_next")).join(about, "__partner").withColumn(
        "__k", (seeded_hash(seed + 2, doc_id, "line_no") % F.greatest(F.col("__size"), F.lit(1))).cast("int"))
    other = other.join(every, ["__partner", "__k"], "left")
    return own.unionByName(other.select(doc_id, "line_no", F.col("z.a").alias("first"), "second", "is_next", "partner_doc"))


def fill_to_budget(lengths: Column, budget: int) -> Column:
    """Q20: greedy packing of consecutive sentences (token lengths) into chunks; a chunk is closed after the
    sentence that brings it to ``budget`` tokens or more. The rest of the document is the last chunk, with
    ``full`` false (training uses the full ones only). Returns
    ``array<struct<first,last,n_tokens,full>>`` (sentence indices). One ``aggregate`` over the document's
    sentence lengths."""
    t = "struct<first:int,last:int,n_tokens:int,full:boolean>"
    init = F.struct(F.array().cast(f"array<{t}>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def chunk(acc, last, n, full):
        return F.struct(acc["first"].alias("first"), last.alias("last"), n.alias("n_tokens"), F.lit(full).alias("full"))

    def step(acc, ln):
        n = acc["n"] + ln
        closes = n >= budget
        return F.struct(
            F.when(closes, F.concat(acc["done"], F.array(chunk(acc, acc["i"], n, True)))).otherwise(acc["done"]).alias("done"),
            F.when(closes, acc["i"] + 1).otherwise(acc["first"]).alias("first"),
            F.when(closes, 0).otherwise(n).alias("n"),
            (acc["i"] + 1).alias("i"),
        )

    def finish(acc):
        rest = chunk(acc, acc["i"] - 1, acc["n"], False)
        return F.when(acc["first"] < acc["i"], F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    return F.aggregate(_c(lengths), init, step, finish)


def label_ids(df: DataFrame, label: str, label_list: list[str], out: str = "label_id"):
    """R5 + R15: label -> position in ``label_list``; rows with an unknown label go to a
    quarantine frame with a reason. Returns (good, rejected)."""
    pos = F.array_position(F.array(*[F.lit(x) for x in label_list]), _c(label)) - 1
    tagged = df.withColumn(out, pos.cast("int"))
    good = tagged.filter(F.col(out) >= 0)
    rejected = tagged.filter((F.col(out) < 0) | F.col(out).isNull()).drop(out).withColumn("operator", F.lit("label_ids")).withColumn(
        "reason", F.coalesce(F.concat(F.lit("unknown label: "), _c(label).cast("string")), F.lit("no label")))
    return good, rejected


def reject_baskets(samples: DataFrame, basket: str, bad: Column, reason: Column, baskets: DataFrame | None = None):
    """R15, whole baskets: a basket (the samples of one input record) of which one sample is bad is rejected as a whole. Returns
    ``(samples of good baskets, rejected)``; ``rejected`` has one row a basket: ``basket, n_bad, reason`` (the least text of its reasons), ``operator``. A basket
    of ``baskets`` (column ``basket``) without any sample is rejected too. NULL in ``bad`` counts as bad; samples without a basket are one basket.

    Only bad rows are grouped; good samples are shuffled only if the rejected baskets are too many to broadcast, and a large
    basket then splits like any skewed join key."""
    fault = samples.filter(F.coalesce(bad, F.lit(True))).groupBy(F.col(basket).alias("__b")).agg(
        F.count(F.lit(1)).alias("n_bad"), F.min(F.coalesce(reason.cast("string"), F.lit("bad sample"))).alias("reason"))
    good = samples.join(fault.select("__b"), F.col(basket).eqNullSafe(F.col("__b")), "left_anti")
    rejected = fault.withColumnRenamed("__b", basket)
    if baskets is not None:
        present = samples.select(F.col(basket).alias("__b")).distinct()
        empty = baskets.select(basket).distinct().join(present, F.col(basket).eqNullSafe(F.col("__b")), "left_anti")
        rejected = rejected.unionByName(empty.select(basket, F.lit(0).cast("long").alias("n_bad"), F.lit("no samples").alias("reason")))
    return good, rejected.withColumn("operator", F.lit("reject_baskets"))


def fit_scaler(train: DataFrame, col: str) -> DataFrame:
    """Mean and population std of the train labels (std 0 -> 1), one row."""
    return train.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std")).select(
        "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(F.lit(1.0)).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame, col: str, out: str) -> DataFrame:
    """``(x - mean) / scale`` with the broadcast one-row scaler."""
    return scalar_join(df, F.broadcast(scaler)).withColumn(out, (F.col(col) - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def unscale(df: DataFrame, scaler: DataFrame, col: str, out: str) -> DataFrame:
    """``pred * scale + mean``."""
    return scalar_join(df, F.broadcast(scaler)).withColumn(out, F.col(col) * F.col("scale") + F.col("mean")).drop("mean", "scale")


def class_weights(df: DataFrame, label: str, multilabel: bool = False) -> DataFrame:
    """Balanced weights with one artificial observation per class:
    ``(N + K) / (K * (n_c + 1))``; multi-hot labels are exploded first."""
    src = df.select(F.explode(_c(label)).alias("__l")) if multilabel else df.select(_c(label).alias("__l"))
    counts = src.groupBy("__l").agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("N"), F.count(F.lit(1)).alias("K"))
    return scalar_join(counts, tot).select(
        F.col("__l").alias(label), ((F.col("N") + F.col("K")) / (F.col("K") * (F.col("n_c") + 1))).alias("weight"))


def truncate_pair(a, b, max_len: int, strategy: str = "longest_first", n_special: int = 0) -> Column:
    """Truncate one or two token arrays to ``max_len`` tokens in total. ``longest_first``
    removes tokens one by one from the longer array (closed form), ``only_first``/``only_second``
    cut one side."""
    la, lb = F.size(_c(a)), F.size(_c(b))
    over = F.greatest(la + lb + n_special - max_len, F.lit(0))
    if strategy == "only_first":
        na, nb = F.greatest(la - over, F.lit(0)), lb
    elif strategy == "only_second":
        na, nb = la, F.greatest(lb - over, F.lit(0))
    else:
        # one token at a time from the longer side; on equal lengths the second loses first
        d = F.abs(la - lb)
        from_long = F.least(over, d)
        rest = over - from_long
        na = F.when(la >= lb, la - from_long).otherwise(la) - F.floor(rest / 2)
        nb = F.when(lb > la, lb - from_long).otherwise(lb) - F.ceil(rest / 2)
    return F.struct(F.slice(_c(a), 1, na.cast("int")).alias("a"), F.slice(_c(b), 1, nb.cast("int")).alias("b"))


def multitask_table(tokens_df: DataFrame, sentences_df: DataFrame, seed: int, n_negative: int) -> DataFrame:
    """Token instances (label 1, IOB tags, binary tags R4) united with an exact-size seeded
    sample of negative sentences (label 0, all-``O`` tags), shuffled by a seeded hash key."""
    from quire.functions import labels as L
    from quire.operators.splits import exact_sample

    pos = tokens_df.select(F.array_join("tokens", " ").alias("text"), F.col("tokens").alias("text_tokens"),
                           F.col("labels").alias("token_label_iob"), L.iob_to_binary("labels").alias("token_label_binary"),
                           F.lit(1).alias("text_label"))
    neg = exact_sample(sentences_df, "id", seed, n_negative).select(
        F.col("text"), F.col("tokens").alias("text_tokens"),
        F.transform("tokens", lambda t: F.lit("O")).alias("token_label_iob"),
        F.transform("tokens", lambda t: F.lit(0)).alias("token_label_binary"), F.lit(0).alias("text_label"))
    return pos.unionByName(neg).withColumn("shuffle_key", seeded_hash(seed, "text"))


def concat_by_position(a, b) -> Column:
    """U8: element-wise concatenation of two lists of lists."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.concat(F.coalesce(x, F.array()), F.coalesce(y, F.array())))


def global_shuffle(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Spread rows over ``n`` partitions by a seeded hash (order-free)."""
    return df.repartition(n, seeded_hash(seed, key))


def choose_passages(pos_arr, neg_arr, n_pos: int, n_neg: int, seed, key: str, shuffle: bool = True) -> Column:
    """First (or seeded-random) ``n_pos`` positives and ``n_neg`` hard negatives, padded with
    empty passages; label vector ``[1]*n_pos + [0]*n_neg`` regardless of padding."""
    def order(arr):
        if not shuffle:
            return _c(arr)
        keyed = F.transform(_c(arr), lambda p, i: F.struct(
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))).alias("k"), p.alias("p")))
        return F.transform(F.array_sort(keyed), lambda s: s["p"])

    empty = F.struct(F.lit("").alias("title"), F.lit("").alias("text"), F.lit("").alias("passage_id"))

    def take(arr, k):
        s = F.slice(order(arr), 1, k)
        return F.concat(s, F.array_repeat(empty, F.greatest(F.lit(k) - F.size(s), F.lit(0))))

    labels = F.array(*([F.lit(1)] * n_pos + [F.lit(0)] * n_neg))
    return F.struct(F.concat(take(pos_arr, n_pos), take(neg_arr, n_neg)).alias("passages"), labels.alias("labels"))


def choose_passage_rows(df: DataFrame, query: str, passage: Column, positive: Column, order: Column, n_pos: int, n_neg: int) -> DataFrame:
    """L17 on rows: for each query the first ``n_pos`` positives and ``n_neg`` hard negatives by ``order``, padded with empty passages:
    ``query, passages, labels``. Only the chosen rows of a query meet (a partial top-k runs before the shuffle)."""
    # ``passage``: struct<title, text, passage_id>
    x = df.select(F.col(query).alias("__q"), passage.alias("__p"), F.coalesce(positive, F.lit(False)).alias("__pos"), order.alias("__o"))
    w = Window.partitionBy("__q", "__pos").orderBy("__o")
    top = x.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max(n_pos, n_neg)).filter(F.col("__r") <= F.when(F.col("__pos"), n_pos).otherwise(n_neg))
    seen = top.groupBy("__q").agg(F.array_sort(F.collect_list(F.struct((~F.col("__pos")).alias("n"), F.col("__r").alias("r"), F.col("__p").alias("p")))).alias("c"))
    empty = F.struct(F.lit("").alias("title"), F.lit("").alias("text"), F.lit("").alias("passage_id"))

    def side(negative, k):
        mine = F.transform(F.filter("c", lambda e: e["n"] == F.lit(negative)), lambda e: e["p"])
        return F.concat(mine, F.array_repeat(empty, F.lit(k) - F.size(mine)))

    labels = F.array(*([F.lit(1)] * n_pos + [F.lit(0)] * n_neg))
    return seen.select(F.col("__q").alias(query), F.concat(side(False, n_pos), side(True, n_neg)).alias("passages"), labels.alias("labels"))


def questions_per_document(df: DataFrame, doc: str, question: str) -> DataFrame:
    """Distinct questions per document."""
    return df.groupBy(doc).agg(F.countDistinct(question).alias("n_questions"))


def one_sequence_per_sentence(docs: DataFrame, doc_id: str, lines: str, max_len: int) -> DataFrame:
    """Q21: one training sequence per sentence (whitespace tokens, truncated to ``max_len``)."""
    from quire.functions import text as T

    return docs.select(doc_id, F.posexplode(lines).alias("line_no", "sentence")).select(
        doc_id, "line_no", F.slice(T.ws_tokens(F.col("sentence")), 1, max_len).alias("tokens"))


# Tokens that are never masked.
UNMASKED = ["[CLS]", "[SEP]", "[PAD]"]
FIRST_GROUPS = 64  # groups put in order before the rest


def whole_word_mask(tokens, seed, key: str, p: float = 0.15, max_predictions: int = 20, mask_token: str = "[MASK]") -> Column:
    """Q22 + Q23: whole-word masking. Word groups = a word-initial token plus its ``##``
    continuations; special tokens belong to no group. Groups are taken in seeded-hash order until
    ``max(1, round(n * p))`` tokens (capped at ``max_predictions``, a training parameter) are chosen, skipping a group
    that would overshoot; chosen tokens become ``[MASK]`` (80 %), stay (10 %) or become another
    token of the sequence (10 %). Returns ``struct<tokens, labels>`` with labels = original token
    at masked positions, ``""`` elsewhere.

    Groups come from their borders and only chosen groups, of which there are at most ``max_predictions``, are listed: the work is
    linear in the tokens."""
    from quire.functions.labels import _indices, let

    def plain(t):
        return ~t.isin(*UNMASKED)

    def group_starts(toks):  # the first token of each group, and the end
        return let(F.filter(_indices(toks), lambda i: plain(F.get(toks, i))), lambda at: let(F.get(at, 0), lambda first: F.concat(
            F.filter(at, lambda i: ~F.get(toks, i).startswith("##") | (i == first)), F.array(F.size(toks)))))

    def picked(toks, starts, budget):
        number = F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), lambda a, k: k)
        prefix = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit(""))
        hashes = let(prefix, lambda before: F.transform(number, lambda k: F.md5(F.concat(before, (k + 1).cast("string")))))

        def in_order(hs, which):  # (hash, first token, end, tokens) of some groups, in hash order
            def group(k):
                start, end = F.get(starts, k), F.get(starts, k + 1)
                size = F.when(end - start == 1, 1).otherwise(F.size(F.filter(F.slice(toks, start + 1, end - start), plain)))
                return F.struct(F.get(hs, k).alias("h"), start.alias("a"), end.alias("b"), size.alias("s"))
            return F.sort_array(F.transform(F.filter(number, lambda k: which(F.get(hs, k))), group))  # array_sort would interpret a comparator

        def some(groups, start):  # every step copies what was chosen so far
            return F.aggregate(groups, start, lambda acc, z: F.when(acc["n"] + z["s"] <= budget, F.struct(
                F.concat(acc["gs"], F.array(F.struct(z["a"].alias("a"), z["b"].alias("b")))).alias("gs"), (acc["n"] + z["s"]).alias("n"))).otherwise(acc))

        def chosen(hs, last):  # the first groups in hash order, and the rest only where they do not fill the budget
            none = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("gs"), F.lit(0).alias("n"))
            return let(some(in_order(hs, lambda h: last.isNull() | (h <= last)), none), lambda got: F.when(
                (got["n"] >= budget) | last.isNull(), got["gs"]).otherwise(some(in_order(hs, lambda h: h > last), got)["gs"]))
        return let(hashes, lambda hs: let(F.get(F.sort_array(hs), FIRST_GROUPS - 1), lambda last: chosen(hs, last)))

    def masked(toks, chosen):
        n = F.size(toks)
        places = F.array_sort(F.flatten(F.transform(chosen, lambda g: F.filter(F.sequence(g["a"], g["b"] - 1), lambda i: plain(F.get(toks, i))))))

        def drawn(i):
            return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}m"), F.col(key).cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long") % 10

        def new(i):
            return let(drawn(i), lambda u: F.when(u < 8, F.lit(mask_token)).when(u < 9, F.get(toks, i)).otherwise(F.get(toks, ((u * 7919 + i) % n).cast("int"))))

        def rebuilt(hits):  # stretches between chosen tokens are copied whole
            after = lambda k: F.when(k > 0, F.get(hits, k - 1) + 1).otherwise(0)
            rest = let(F.coalesce(F.get(hits, F.size(hits) - 1) + 1, F.lit(0)), lambda a: F.struct(
                F.slice(toks, a + 1, n - a).alias("t"), F.array_repeat(F.lit(""), n - a).alias("l")))
            tokens = F.transform(hits, lambda i, k: F.concat(F.slice(toks, after(k) + 1, i - after(k)), F.array(new(i))))
            labels = F.transform(hits, lambda i, k: F.concat(F.array_repeat(F.lit(""), i - after(k)), F.array(F.get(toks, i))))
            return let(rest, lambda r: F.struct(F.concat(F.flatten(tokens), r["t"]).alias("tokens"), F.concat(F.flatten(labels), r["l"]).alias("labels")))

        return let(places, rebuilt)

    def run(toks):
        budget = F.least(F.greatest(F.lit(1), F.bround(F.size(toks) * p)).cast("int"), F.lit(max_predictions))
        return let(let(group_starts(toks), lambda starts: picked(toks, starts, budget)), lambda chosen: masked(toks, chosen))

    return let(_c(tokens), run)


def next_sentence_label(is_next) -> Column:
    """Q23: 0 = the true next sentence, 1 = random."""
    return F.when(_c(is_next), 0).otherwise(1)


def bi_encoder_length_stats(df: DataFrame, query_len: str, passage_lens: str, max_query: int, max_passage: int) -> DataFrame:
    """A5: clipped share / mean / max for queries and for passages (averaged over passages)."""
    q = F.least(_c(query_len), F.lit(max_query))
    pl = F.explode(F.transform(_c(passage_lens), lambda x: F.least(x, F.lit(max_passage))))
    a = df.agg(F.avg((q >= max_query).cast("double")).alias("q_clipped"), F.avg(q).alias("q_mean"), F.max(q).alias("q_max"))
    b = df.select(pl.alias("p")).agg(F.avg((F.col("p") >= max_passage).cast("double")).alias("p_clipped"),
                                     F.avg("p").alias("p_mean"), F.max("p").alias("p_max"))
    return scalar_join(a, b)


def samples_per_file_estimate(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines - 2 * blank lines`` for line-structured files (one pass)."""
    return lines.agg((F.count(F.lit(1)) - 2 * F.count_if(F.length(F.trim(_c(value))) == 0)).alias("n_samples"))


def format_by_scheme(tags, probs, scheme: str) -> Column:
    """Predictions formatted per tag scheme: IOB -> entity spans (N8), plain tags -> the
    non-``O`` positions, anything else passed through."""
    from quire.functions import labels as L

    if scheme == "iob":
        return L.iob_to_spans(tags, probs)
    if scheme == "plain":
        z = F.arrays_zip(_c(tags).alias("tag"), _c(probs).alias("prob"))
        return F.filter(F.transform(z, lambda s, i: F.struct(s["tag"].alias("tag"), i.alias("start"), i.alias("end"),
                                                            s["prob"].alias("prob"))), lambda s: s["tag"] != "O")
    return _c(tags)


MAX_TASKS = 1000


def demux_tasks(df: DataFrame, task_col: str = "task", tasks: list | None = None):
    """Split multi-task predictions into one frame per task value (returns a dict). ``tasks`` names them; without it the task
    set, which is as small as the model's list of heads, is read from the distinct values (a bounded number, ``MAX_TASKS``)."""
    if tasks is None:
        tasks = [r[0] for r in df.select(task_col).distinct().limit(MAX_TASKS + 1).collect()]
        if len(tasks) > MAX_TASKS:
            raise ValueError(f"column {task_col} has more than {MAX_TASKS} values: it does not name tasks")
    return {t: df.filter(F.col(task_col).eqNullSafe(F.lit(t))) for t in tasks}


def normalize_whitespace_tokens(text) -> Column:
    """Every whitespace character becomes a blank, then whitespace tokens."""
    from quire.functions import text as T

    return T.ws_tokens(F.regexp_replace(_c(text), T.WS, " "))


def negative_sentences(df: DataFrame, label: str = "label", text: str = "text", min_tokens: int = 4) -> DataFrame:
    """R2: sentences with ``label == 0`` and more than ``min_tokens`` word tokens."""
    from quire.functions import text as T

    return df.filter((F.col(label) == 0) & (F.size(T.word_tokens(F.col(text))) > min_tokens))


def instance_counts(instances: DataFrame, tokens: str = "tokens", labels: str = "labels", sep: str = "[SEP]") -> DataFrame:
    """A3: sentence, instance and no-trigger counts in one pass. ``multi_*`` counts consider only
    instances with more than one sentence (the reference's first count), ``all_*`` every instance."""
    from quire.functions import labels as L

    parts = L.split_at_sep(F.col(tokens), F.col(labels))
    x = instances.select(parts.alias("p")).select(F.size("p").alias("n_s"), F.size(F.filter("p", lambda s: ~F.array_contains(s["labels"], "B-trigger"))).alias("n_nt"))
    multi = F.col("n_s") > 1
    return x.agg(
        F.count(F.lit(1)).alias("all_instances"), F.sum("n_s").alias("all_sentences"), F.sum("n_nt").alias("all_without_trigger"),
        F.count_if(multi).alias("multi_instances"), F.sum(F.when(multi, F.col("n_s")).otherwise(0)).alias("multi_sentences"),
        F.sum(F.when(multi, F.col("n_nt")).otherwise(0)).alias("multi_without_trigger"))


def split_token_data(df: DataFrame, key: str, seed, dev_size, tokens: str = "tokens", labels: str = "labels"):
    """L4 (+N12): exact-size split of token instances; instances whose token and label arrays
    differ in length are routed to a quarantine frame instead of failing later.
    Returns (split frame with ``split`` column, rejected)."""
    from quire.functions import labels as L
    from quire.operators.splits import exact_split

    bad = L.misaligned(tokens, labels)
    rejected = df.filter(bad).withColumn("operator", F.lit("split_token_data")).withColumn("reason", F.lit("token/label length mismatch"))
    return exact_split(df.filter(~bad), key, seed, dev_size), rejected
