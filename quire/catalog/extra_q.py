"""More operator queries: sampling (L11, L14), IOB1 -> IOB2 (N7), spans -> IOB (N3), span
candidates from logits (Q14), repeat collapse (T3), sample estimate (A15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.functions import labels as L
from quire.functions import text as T
from quire.operators import qa, records, splits
from quire.sources.tables import table

R = 6


@register(
    "negative_downsampling",
    f"""
    SELECT user_id, event_id FROM events WHERE event_type = 'purchase'
    UNION ALL
    SELECT user_id, event_id FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {S.seeded_hash(9, 'event_id')}, event_id) AS rn
      FROM events WHERE event_type <> 'purchase') WHERE rn <= 2
    """,
)
def negative_downsampling(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return splits.downsample_negatives(ev, "user_id", "event_id", F.col("event_type") == "purchase", 9, 2).select("user_id", "event_id")


@register(
    "keep_one_sampling",
    f"""
    WITH h AS (SELECT user_id, event_id, event_type = 'error' AS ans, {S.seeded_hash(4, 'event_id')} AS h FROM events),
    kept AS (SELECT user_id, event_id FROM h WHERE ans OR h < CAST(0.01 * 1152921504606846976 AS BIGINT)),
    rescue AS (SELECT user_id, arg_min(event_id, (h, event_id)) AS event_id FROM h
               WHERE user_id NOT IN (SELECT user_id FROM kept) GROUP BY user_id)
    SELECT * FROM kept UNION ALL SELECT * FROM rescue
    """,
)
def keep_one_sampling(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return splits.sample_keep_one(ev, "user_id", "event_id", F.col("event_type") == "error", 4, 0.01).select("user_id", "event_id")


def _conv_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", T.ws_tokens(F.col("text")).alias("toks"))


@register(
    "iob1_to_iob2",
    f"""
    WITH t AS (SELECT conv_id, turn, unnest(toks) AS tok, unnest(range(len(toks))) AS i
               FROM (SELECT conv_id, turn, {S.ws_tokens('text')} AS toks FROM conversations)),
    g AS (SELECT conv_id, turn, i, CASE WHEN length(tok) >= 9 THEN 'I-' || CASE WHEN tok LIKE '%,' THEN 'A' ELSE 'B' END ELSE 'O' END AS tag FROM t),
    c AS (SELECT conv_id, turn, i, tag, lag(tag) OVER (PARTITION BY conv_id, turn ORDER BY i) AS prev FROM g)
    SELECT conv_id, turn, string_agg(CASE WHEN tag LIKE 'I-%' AND (prev IS NULL OR prev = 'O' OR substr(prev, 2) <> substr(tag, 2))
                                          THEN 'B' || substr(tag, 2) ELSE tag END, ' ' ORDER BY i) AS tags
    FROM c GROUP BY conv_id, turn
    """,
)
def iob1_to_iob2_q(spark, sf_dir):
    c = _conv_tokens(spark, sf_dir)
    iob1 = F.transform("toks", lambda t: F.when(F.length(t) >= 9, F.concat(F.lit("I-"), F.when(t.endswith(","), "A").otherwise("B"))).otherwise("O"))
    return c.filter(F.size("toks") > 0).select("conv_id", "turn", F.array_join(L.iob1_to_iob2(iob1), " ").alias("tags"))


@register(
    "spans_to_iob",
    f"""
    WITH t AS (SELECT conv_id, turn, unnest(toks) AS tok, unnest(range(len(toks))) AS i
               FROM (SELECT conv_id, turn, {S.ws_tokens('text')} AS toks FROM conversations))
    SELECT conv_id, turn, string_agg(CASE WHEN regexp_matches(tok, '^[A-Z]') THEN 'B-CAP' ELSE 'O' END, ' ' ORDER BY i) AS tags
    FROM t GROUP BY conv_id, turn
    """,
)
def spans_to_iob_q(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").withColumn("w", T.ws_token_spans(F.col("text")))
    spans = F.transform(F.filter(F.col("w"), lambda w: F.regexp_like(w["token"], F.lit("^[A-Z]"))),
                        lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lit("CAP").alias("label")))
    tags = L.spans_to_iob(F.col("text"), spans, words=F.col("w"))
    return c.select("conv_id", "turn", tags.alias("t")).filter(F.size("t") > 0).select("conv_id", "turn", F.array_join("t", " ").alias("tags"))


@register(
    "top_spans_from_logits",
    f"""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS s, list_reverse(CAST(embedding AS DOUBLE[])) AS e FROM embeddings),
    z AS (SELECT vec_id, s, e, list_sum(list_transform(s, lambda x: exp(x))) AS zs, list_sum(list_transform(e, lambda x: exp(x))) AS ze FROM v),
    p AS (SELECT vec_id, s, e, zs, ze, CAST(st AS INTEGER) AS st FROM z, range(0, 64) a(st)),
    q AS (SELECT vec_id, st, CAST(en AS INTEGER) AS en, s[st + 1] + e[en + 1] AS score,
                 (exp(s[st + 1]) / zs + exp(e[en + 1]) / ze) / 2 AS conf
          FROM p, range(0, 64) b(en) WHERE en >= st AND en <= least(st + 7, 63))
    SELECT vec_id, st AS start, en AS "end", round(score, {R}) AS score, round(conf, {R}) AS confidence, CAST(rk AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, st, en) AS rk FROM q) WHERE rk <= 5
    """,
)
def top_spans_from_logits_q(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    e = e.withColumn("e", F.reverse("s"))
    r = qa.top_spans_from_logits(e, "s", "e", None, "vec_id", max_answer_length=8, n_best=5)
    return r.select("vec_id", F.col("start").cast("int"), F.col("end").cast("int"), F.round("score", R).alias("score"),
                    F.round("confidence", R).alias("confidence"), F.col("rank").cast("int"))


@register(
    "samples_per_file",
    """
    SELECT CAST(count(*) - 2 * count_if(trim(line) = '') AS BIGINT) AS n_samples
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    """,
)
def samples_per_file(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return records.samples_per_file_estimate(lines).select(F.col("n_samples").cast("long"))


# RE2 has no back-references: runs of equal characters come from their borders
@register(
    "pages_repeat_collapse",
    f"""
    WITH c AS (SELECT page_id, unnest(string_split(html, '')) AS c, unnest(range(length(html))) AS i FROM pages),
    b AS (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY page_id ORDER BY i) THEN 0 ELSE 1 END AS first FROM c),
    r AS (SELECT *, sum(first) OVER (PARTITION BY page_id ORDER BY i) AS run FROM b),
    g AS (SELECT page_id, run, min(c) AS c, count(*) AS n FROM r GROUP BY page_id, run),
    t AS (SELECT page_id, string_agg(CASE WHEN n >= 4 AND regexp_matches(c, '[^\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]') THEN c ELSE repeat(c, n) END, '' ORDER BY run) AS t FROM g GROUP BY page_id)
    SELECT page_id, CAST(length({S.strip('t')}) AS BIGINT) AS n_chars, md5({S.strip('t')}) AS clean_md5 FROM t
    """,
)
def pages_repeat_collapse(spark, sf_dir):
    """T3 on pages."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    c = T.remove_repeating_characters(F.col("html"))
    return p.select("page_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("clean_md5"))


@register(
    "argmax_accuracy",
    f"""
    WITH x AS (SELECT label, CAST(embedding AS DOUBLE[]) AS l FROM embeddings),
    y AS (SELECT label, list_position(l, list_max(l)) - 1 AS pred,
                 1.0 / list_sum(list_transform(l, lambda v: exp(v - list_max(l)))) AS prob FROM x)
    SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), {R}) AS acc, round(avg(prob), {R}) AS mean_prob,
           CAST(count(*) AS BIGINT) AS n FROM y
    """,
)
def argmax_accuracy(spark, sf_dir):
    """R16 + M1: class arg-max and softmax probability of all components as logits."""
    from quire.operators import metrics

    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("l"))
    p = e.select("label", L.argmax_prob("l").alias("a")).select("label", F.col("a.label_id").alias("pred"), F.col("a.probability").alias("prob"))
    acc = metrics.accuracy(p, "label", "pred")
    rest = p.agg(F.avg("prob").alias("mean_prob"), F.count(F.lit(1)).cast("long").alias("n"))
    return metrics.scalar_join(acc, rest).select(F.round("acc", R).alias("acc"), F.round("mean_prob", R).alias("mean_prob"), "n")


@register(
    "truncate_pairs",
    f"""
    WITH t AS (SELECT u.conv_id, u.turn, len({S.ws_tokens('u.text')}) AS la, len({S.ws_tokens('a.text')}) AS lb
               FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
    o AS (SELECT *, greatest(la + lb - 64, 0) AS over FROM t),
    r AS (SELECT *, least(over, abs(la - lb)) AS fl, over - least(over, abs(la - lb)) AS rest FROM o)
    SELECT conv_id, turn,
           CAST(CASE WHEN la >= lb THEN la - fl ELSE la END - floor(rest / 2) AS INTEGER) AS len_a,
           CAST(CASE WHEN lb > la THEN lb - fl ELSE lb END - ceil(rest / 2) AS INTEGER) AS len_b
    FROM r
    """,
)
def truncate_pairs(spark, sf_dir):
    """Longest-first truncation of (turn, next turn) token pairs to 64 tokens."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("toks"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("toks").alias("b"))
    j = c.join(a, ["conv_id", "turn"]).select("conv_id", "turn", records.truncate_pair("toks", "b", 64).alias("t"))
    return j.select("conv_id", "turn", F.size("t.a").alias("len_a"), F.size("t.b").alias("len_b"))


@register(
    "pairs_to_rows",
    """
    SELECT l_orderkey AS query, l_partkey AS passage, 1 AS label FROM lineitem
    UNION ALL SELECT l_orderkey, l_suppkey, 0 FROM lineitem
    """,
)
def pairs_to_rows(spark, sf_dir):
    """Q16: (query, positive, negative) -> two labelled rows."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return records.pairs_to_rows(li, "l_orderkey", "l_partkey", "l_suppkey")


@register(
    "context_windows",
    """
    WITH b AS (SELECT conv_id, turn, text, length(text) AS n, length(text) // 3 AS s, least(length(text) // 3 + 20, length(text)) AS e
               FROM conversations),
    c AS (SELECT *, greatest(20, e - s + 1) AS sz FROM b),
    d AS (SELECT *, (e - s) // 2 + s AS mid FROM c),
    w AS (SELECT *, mid - sz // 2 AS ws, mid + sz // 2 AS we FROM d),
    x AS (SELECT *, greatest(0, ws - greatest(0, we - n)) AS s1, least(n, we + greatest(0, -ws)) AS e1 FROM w)
    SELECT conv_id, turn, CASE WHEN s = 0 AND e = 0 THEN '' ELSE substr(text, CAST(s1 AS BIGINT) + 1, CAST(e1 - s1 AS BIGINT)) END AS context,
           CAST(CASE WHEN s = 0 AND e = 0 THEN 0 ELSE s1 END AS INTEGER) AS start,
           CAST(CASE WHEN s = 0 AND e = 0 THEN 0 ELSE e1 END AS INTEGER) AS "end"
    FROM x
    """,
)
def context_windows(spark, sf_dir):
    """T12 on conversation turns: answer = 20 characters from a third of the text on, window 20."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    n = F.length("text")
    w = qa.context_window(F.col("text"), F.floor(n / 3).cast("int"), F.least((F.floor(n / 3) + 20).cast("int"), n), 20)
    return c.select("conv_id", "turn", w.alias("w")).select("conv_id", "turn", "w.context", "w.start", "w.end")


LABEL_LIST = ["view", "click", "purchase", "signup", "error"]


@register(
    "multilabel_macro_f1",
    f"""
    WITH e AS (SELECT event_type AS y,
                      CASE WHEN {S.seeded_hash(21, 'event_id')} % 4 = 0 THEN event_type || ',click' ELSE event_type END AS p FROM events),
    h AS (SELECT unnest(range(5)) AS k, y, p FROM e),
    b AS (SELECT k, CAST(list_contains(string_split(y, ','), ['view', 'click', 'purchase', 'signup', 'error'][k + 1]) AS INTEGER) AS yy,
                 CAST(list_contains(string_split(p, ','), ['view', 'click', 'purchase', 'signup', 'error'][k + 1]) AS INTEGER) AS pp FROM h),
    f AS (SELECT k, sum(yy * pp) AS tp, sum((1 - yy) * pp) AS fp, sum(yy * (1 - pp)) AS fn FROM b GROUP BY k)
    SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), {R}) AS f1_macro FROM f
    """,
)
def multilabel_macro_f1(spark, sf_dir):
    """R6 + M11: multi-hot vectors over a label list from comma-separated labels; macro F1 over positions."""
    from quire.operators import metrics
    from quire.plans.hashing import seeded_hash

    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    pred = F.when(seeded_hash(21, "event_id") % 4 == 0, F.concat(F.col("event_type"), F.lit(",click"))).otherwise(F.col("event_type"))
    lst = F.array(*[F.lit(x) for x in LABEL_LIST])
    mh = ev.select(L.multi_hot(lst, F.col("event_type")).alias("y"), L.multi_hot(lst, pred).alias("p"))
    return metrics.multilabel_macro_f1(mh, "y", "p").select(F.round("f1_macro", R).alias("f1_macro"))


@register(
    "spans_to_binary",
    """
    SELECT conv_id, turn, array_to_string(list_transform({toks}, lambda t: CASE WHEN length(t) >= 9 THEN '0' ELSE '1' END), '') AS bits
    FROM conversations
    """.replace("{toks}", S.ws_tokens("text")),
)
def spans_to_binary_q(spark, sf_dir):
    """Span labels -> ints (``X``/``[PAD]`` -> 0); long tokens are labelled ``X`` here."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("toks"))
    spans = F.transform("toks", lambda t: F.struct(F.when(F.length(t) >= 9, F.lit("X")).otherwise(F.lit("1")).alias("label")))
    return c.select("conv_id", "turn", F.array_join(F.transform(L.spans_to_binary(spans), lambda b: b.cast("string")), "").alias("bits"))


@register(
    "passage_doc_spans",
    """
    WITH n AS (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM documents),
    p AS (SELECT doc_id, CAST(unnest(range(greatest(1, CAST(ceil(n / 64.0) AS BIGINT)))) AS INTEGER) AS passage_id FROM n)
    SELECT doc_id, passage_id,
           CAST(CASE WHEN (doc_id + passage_id) % 4 = 0 THEN -1 ELSE (doc_id + passage_id) % 4 + passage_id * 64 END AS INTEGER) AS start,
           CAST(CASE WHEN (doc_id + passage_id) % 4 = 0 THEN -1 ELSE (doc_id + passage_id) % 4 + 2 + passage_id * 64 END AS INTEGER) AS "end"
    FROM p
    """,
)
def passage_doc_spans(spark, sf_dir):
    """Q10: passage-relative spans -> document spans; (0, 0) = no answer -> (-1, -1)."""
    n = F.size(F.filter(F.split("text", " "), lambda x: x != ""))
    last = F.greatest(F.lit(1), F.ceil(n / 64)).cast("int") - 1  # passages of 64 tokens over the whole text
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("passage_id"))
    k = ((F.col("doc_id") + F.col("passage_id")) % 4).cast("int")
    st = F.when(k == 0, 0).otherwise(k)
    en = F.when(k == 0, 0).otherwise(k + 2)
    s = qa.passage_to_doc_span(st, en, F.col("passage_id") * 64)
    return d.select("doc_id", "passage_id", s.alias("s")).select("doc_id", "passage_id", F.col("s.start").cast("int").alias("start"),
                                                                 F.col("s.end").cast("int").alias("end"))


@register(
    "concat_by_position",
    f"""
    SELECT u.conv_id, u.turn, CAST(len(flatten([{S.ws_tokens("u.text")}, {S.ws_tokens("a.text")}])) AS INTEGER) AS n_tokens
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    """,
)
def concat_by_position(spark, sf_dir):
    """U8: element-wise concatenation of two lists of lists (here: [turn tokens] and [next-turn tokens])."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("t"))
    a = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("n"))
    j = c.join(a, ["conv_id", "turn"]).select("conv_id", "turn", records.concat_by_position(F.array("t"), F.array("n")).alias("x"))
    return j.select("conv_id", "turn", F.size(F.flatten("x")).alias("n_tokens"))


@register(
    "choose_passages",
    """
    WITH g AS (SELECT l_orderkey AS qid,
                      list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_returnflag = 'R') AS pos,
                      list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_returnflag <> 'R') AS neg
               FROM lineitem GROUP BY l_orderkey),
    s AS (SELECT qid,
                 list_transform(list_sort(list_transform(coalesce(pos, []), lambda p, i: {'k': md5('5:' || CAST(qid AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), 'p': p})), lambda x: x.p) AS sp,
                 list_transform(list_sort(list_transform(coalesce(neg, []), lambda p, i: {'k': md5('5:' || CAST(qid AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)), 'p': p})), lambda x: x.p) AS sn
          FROM g)
    SELECT qid, array_to_string(list_concat(sp[1:1], list_transform(range(greatest(1 - len(sp[1:1]), 0)), lambda x: '')), '|') || '#' ||
                array_to_string(list_concat(sn[1:2], list_transform(range(greatest(2 - len(sn[1:2]), 0)), lambda x: '')), '|') AS chosen
    FROM s
    """,
)
def choose_passages_q(spark, sf_dir):
    """One positive and two hard negatives per query in seeded-hash order, padded with empty
    passages (query = order, passages = its parts, positive = returned line)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    ctx = F.struct(F.lit("").alias("title"), F.lit("").alias("text"), F.col("l_partkey").cast("string").alias("passage_id"))
    ordered = F.struct("l_linenumber", "l_partkey")
    g = li.groupBy(F.col("l_orderkey").alias("qid")).agg(
        F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct(ordered.alias("o"), ctx.alias("c"))))).alias("pos"),
        F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "R", F.struct(ordered.alias("o"), ctx.alias("c"))))).alias("neg"))
    pos = F.transform("pos", lambda x: x["c"])
    neg = F.transform("neg", lambda x: x["c"])
    ch = records.choose_passages(pos, neg, 1, 2, 5, "qid")
    ids = F.transform(ch["passages"], lambda p: p["passage_id"])
    return g.select("qid", F.concat(F.array_join(F.slice(ids, 1, 1), "|"), F.lit("#"), F.array_join(F.slice(ids, 2, 2), "|")).alias("chosen"))


@register(
    "reduce_labels",
    """
    WITH l AS (SELECT conv_id, turn, [{'start': turn % 3 - 1, 'end': turn % 3 - 1}, {'start': 0, 'end': 4}, {'start': 0, 'end': 4},
                                      {'start': CAST(conv_id % 2 AS INTEGER) * 5 - 1, 'end': 7}] AS labs FROM conversations)
    SELECT conv_id, turn,
           array_to_string(list_sort(list_transform(
               CASE WHEN len(list_distinct(list_filter(labs, lambda x: x.start <> -1 OR x."end" <> -1))) > 0
                    THEN list_distinct(list_filter(labs, lambda x: x.start <> -1 OR x."end" <> -1))
                    ELSE [{'start': -1, 'end': -1}] END,
               lambda x: CAST(x.start AS VARCHAR) || '-' || CAST(x."end" AS VARCHAR))), ',') AS labels
    FROM l
    """,
)
def reduce_labels_q(spark, sf_dir):
    """Distinct answer spans of a question, ``[(-1,-1)]`` when none is left."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    sp = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))
    labs = F.array(sp(F.col("turn") % 3 - 1, F.col("turn") % 3 - 1), sp(F.lit(0), F.lit(4)), sp(F.lit(0), F.lit(4)),
                   sp((F.col("conv_id") % 2) * 5 - 1, F.lit(7)))
    red = qa.reduce_labels(labs)
    txt = F.array_join(F.array_sort(F.transform(red, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))), ",")
    return c.select("conv_id", "turn", txt.alias("labels"))
