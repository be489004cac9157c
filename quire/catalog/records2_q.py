"""Record helpers over whole tables: R2, R7, R9-R14, R17-R20, Q2, Q4, Q15, Q18, Q21, Q23, T13, T18, A5, U4, U7, N15, L1, L4, L13, L16, J12, M26, F2, F3."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog import leakage_q
from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.functions import labels as L
from quire.functions import text as T
from quire.operators import leakage, metrics, nq, qa, records, score, splits
from quire.plans.hashing import seeded_hash
from quire.sources.tables import table

R = 6


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


QID = "conv_id * 1000 + turn"


@register(
    "question_inputs",
    rf"""SELECT {QID} AS qid, regexp_replace(text || CASE WHEN turn % 2 = 0 THEN '??' ELSE '' END, '\?$', '') AS question, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS title,
    md5(text) AS passage_md5, CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE 'd' || turn END AS external_id, len(string_split(text, ' ')) AS n_tokens,
    CAST(384 - len(string_split(text, ' ')) - 3 AS INTEGER) AS window_length FROM conversations""",
)
def question_inputs(spark, sf_dir):
    """API records of every turn."""
    c = conversations(spark, sf_dir)
    asked = F.concat("text", F.when(F.col("turn") % 2 == 0, "??").otherwise(""))
    api = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text"), F.array(asked).alias("questions"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("title"),
                   F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).otherwise("").alias("example_id"), F.concat(F.lit("d"), "turn").alias("doc_id"))
    asked_of = api.withColumn("asked", nq.question_of(api))
    rows = nq.api_qa_input(asked_of.withColumn("context", F.lit(None).cast("string"))).select("context", "question")
    same = rows.groupBy(F.xxhash64("context", "question").alias("k")).agg(F.first("question").alias("q"), F.first("context").alias("ctx"))
    x = asked_of.withColumn("k", F.xxhash64("text", "asked")).join(same, "k").withColumn("ext", nq.external_id(asked_of))
    p = nq.title_passage("title", "ctx")
    pair = nq.pack_pair(nq.normalize_question("q"), p["text"])
    n = F.size(F.split("ctx", " "))
    return x.select("qid", pair["text"].alias("question"), p["title"].alias("title"), F.md5(pair["text_b"]).alias("passage_md5"), F.col("ext").alias("external_id"),
                    n.cast("long").alias("n_tokens"), nq.window_length(384, n).alias("window_length"))


@register(
    "negative_sentences",
    f"""WITH s AS (SELECT doc_id, toxic, unnest(string_split(text, chr(10))) AS line FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, md5(line) AS line_md5, CAST(count(*) AS BIGINT) AS n FROM s WHERE toxic = 0 AND len({S.word_tokens('line')}) > 4 GROUP BY ALL""",
)
def negative_sentences(spark, sf_dir):
    """R2: the ordinary lines of more than four words."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "toxic", F.explode(F.split("text", "\n")).alias("line"))
    return records.negative_sentences(d, "toxic", "line").groupBy("doc_id", F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


@register(
    "scaled_and_back",
    f"SELECT l_orderkey, l_linenumber, round(l_quantity, {R}) AS back FROM (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem)",
)
def scaled_and_back(spark, sf_dir):
    """Scaled by the table's own mean and deviation, and back."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    s = records.fit_scaler(li, "q")
    u = records.unscale(records.apply_scaler(li, s, "q", "z"), s, "z", "b")
    return u.select("l_orderkey", "l_linenumber", F.round("b", R).alias("back")).distinct()


@register(
    "decisions_and_pairs",
    f"""
    WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE)) AS x, list_transform(range(8), lambda i: CASE WHEN (vec_id + i) % 3 = 0 THEN 0 ELSE 1 END) AS m FROM embeddings)
    SELECT vec_id, array_to_string(list_transform(list_filter(range(8), lambda i: 1.0 / (1.0 + exp(-x[i + 1])) > 0.5), lambda i: 'c' || i), ',') AS decided,
           round(list_sum(list_transform(range(8), lambda i: CASE WHEN m[i + 1] = 1 THEN x[i + 1] ELSE 0 END)), {R}) + 0.0 AS initial_sum,
           CAST(list_sum(m) AS BIGINT) AS n_pairs FROM e""",
)
def decisions_and_pairs(spark, sf_dir):
    """Labels above the threshold, elements at word starts, pairs whose label is not masked."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 8).alias("x"))
    names = F.array(*[F.lit(f"c{i}") for i in range(8)])
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("vec_id") + i) % 3 == 0, 0).otherwise(1))
    kept = L.select_initial("x", m)
    pairs = L.masked_pairs("x", F.transform(m, lambda v: F.when(v == 0, -1).otherwise(v)))
    return e.select("vec_id", F.array_join(L.multilabel_decision(names, "x"), ",").alias("decided"),
                    (F.round(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), R) + 0.0).alias("initial_sum"), F.size(pairs).cast("long").alias("n_pairs"))


@register(
    "passage_labels",
    f"""
    WITH d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents),
    a AS (SELECT doc_id, text, w, {S.seeded_hash(61, 'doc_id')} % len(w) AS p FROM d),
    b AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE length(array_to_string(w[1:p], ' ')) + 1 END AS c FROM a),
    o AS (SELECT *, len({S.ws_tokens('text')}) AS k, len({S.ws_tokens('substr(text, 1, c + 1)')}) AS started, len({S.ws_tokens('substr(text, 1, greatest(c + length(w[p + 1]), 1))')}) AS ended FROM b),
    s AS (SELECT doc_id, CASE WHEN started = k THEN k ELSE started - 1 END AS st, CASE WHEN ended = k THEN k ELSE ended - 1 END AS en, length(w[p + 1]) AS n FROM o WHERE length(w[p + 1]) > 0)
    SELECT doc_id, CAST(CASE WHEN st >= 0 AND st < 64 AND en >= 0 AND en <= 64 THEN st + 9 ELSE 0 END AS INTEGER) AS start_t,
           CAST(CASE WHEN st >= 0 AND st < 64 AND en >= 0 AND en <= 64 THEN en + 9 ELSE 0 END AS INTEGER) AS end_t FROM s""",
)
def passage_labels(spark, sf_dir):
    """Q4: the token labels, behind a question of seven tokens, of a word of the document in its first passage."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", " ").alias("w"), T.token_offsets_batch(F.col("text")).alias("o"))
    p = (seeded_hash(61, "doc_id") % F.size("w")).cast("int")
    d = d.withColumn("word", F.get("w", p)).withColumn("c", nq.blank_token_span("w", p, p + 1)["start_c"]).filter(F.length("word") > 0)
    answers = F.array(F.struct(F.col("c").alias("answer_start"), F.col("word").alias("text")))
    lab = qa.answers_to_passage_labels(answers, F.lit(0), F.lit(63), "o", 1, question_len=7, special_start=1, special_mid=1)
    return d.select("doc_id", F.get(lab, 0)["start"].alias("start_t"), F.get(lab, 0)["end"].alias("end_t"))


@register(
    "answer_texts",
    f"""
    WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(text, {S.q(S.WS + '+')}, ' ', 'g')), ' ') AS w FROM documents),
    a AS (SELECT doc_id, w, {S.seeded_hash(62, 'doc_id')} % len(w) AS s, least(len(w) - 1, {S.seeded_hash(62, 'doc_id')} % len(w) + {S.seeded_hash(63, 'doc_id')} % 9) AS e FROM d)
    SELECT doc_id, array_to_string(w[s + 1:e + 1], ' ') AS answer, CAST(CASE WHEN s = 0 THEN 0 ELSE length(array_to_string(w[1:s], ' ')) + 1 END AS INTEGER) AS "start",
           CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(w[s + 1:e + 1], ' ') END AS prediction FROM a""",
)
def answer_texts(spark, sf_dir):
    """Token spans of the cleaned text as answers, and the prediction of a question."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.collapse_ws("text").alias("text"))
    d = d.select("doc_id", "text", T.token_offsets_batch(F.col("text")).alias("o"))
    n = F.greatest(F.size("o"), F.lit(1))
    s = (seeded_hash(62, "doc_id") % n).cast("int")
    e = F.least(n - 1, s + (seeded_hash(63, "doc_id") % 9).cast("int"))
    x = d.select("doc_id", qa.span_text(F.col("text"), F.col("o"), s, e).alias("a"))
    answers = F.array(F.struct(F.col("a.answer").alias("answer"), F.when(F.col("doc_id") % 4 == 0, "no_answer").otherwise("span").alias("answer_type")))
    ranked = x.withColumn("answers", answers)
    best = nq.format_qa_result(ranked, "doc_id", "answers", squad=True)
    return ranked.join(best, ranked["doc_id"] == best["id"]).select("doc_id", F.col("a.answer").alias("answer"), F.col("a.start").alias("start"), "prediction")


@register(
    "sentence_sequences",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, array_to_string({S.ws_tokens('line')}[1:32], ' ') AS tokens, CAST(line_no % 2 AS INTEGER) AS label,
           array_to_string({S.ws_tokens('line')}, ' ') AS whole FROM l""",
)
def sentence_sequences(spark, sf_dir):
    """A sequence a line (32 tokens of it are the feature), the label of a next sentence, and the whole line's tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    seq = records.one_sequence_per_sentence(d, "doc_id", "lines", 32)
    whole = d.select("doc_id", F.posexplode("lines").alias("line_no", "line")).select("doc_id", "line_no", F.array_join(records.normalize_whitespace_tokens("line"), " ").alias("whole"))
    return seq.join(whole, ["doc_id", "line_no"]).select("doc_id", "line_no", F.array_join("tokens", " ").alias("tokens"), records.next_sentence_label(F.col("line_no") % 2 == 0).alias("label"), "whole")


@register(
    "bi_encoder_lengths",
    f"""
    WITH l AS (SELECT conv_id, role, len({S.ws_tokens('text')}) AS n FROM conversations), q AS (SELECT least(n, 20) AS q FROM l WHERE role = 'user'), p AS (SELECT least(n, 60) AS p FROM l WHERE role <> 'user')
    SELECT round(avg(CASE WHEN q >= 20 THEN 1.0 ELSE 0.0 END), {R}) AS q_clipped, round(avg(q), {R}) AS q_mean, CAST(max(q) AS INTEGER) AS q_max,
           (SELECT round(avg(CASE WHEN p >= 60 THEN 1.0 ELSE 0.0 END), {R}) FROM p) AS p_clipped, (SELECT round(avg(p), {R}) FROM p) AS p_mean, (SELECT CAST(max(p) AS INTEGER) FROM p) AS p_max FROM q""",
)
def bi_encoder_lengths(spark, sf_dir):
    """A5: clipped shares, means and maxima of questions (user turns) and passages (the other turns)."""
    c = conversations(spark, sf_dir).select("role", F.size(T.ws_tokens(F.col("text"))).alias("n"))
    user = F.col("role") == "user"
    x = c.select(F.when(user, F.col("n")).alias("q"), F.when(user, F.array().cast("array<int>")).otherwise(F.array("n")).alias("p"))
    return _lengths(x).select(*[F.round(k, R).alias(k) for k in ("q_clipped", "q_mean")], "q_max", *[F.round(k, R).alias(k) for k in ("p_clipped", "p_mean")], "p_max")


def _lengths(x):
    q, p = x.filter("q is not null"), x.filter("q is null")
    first = records.bi_encoder_length_stats(q, "q", "p", 20, 60).select("q_clipped", "q_mean", "q_max")
    second = records.bi_encoder_length_stats(p, F.lit(0), "p", 20, 60).select("p_clipped", "p_mean", "p_max")
    return metrics.scalar_join(first, second)


@register("matches_removed", f"WITH {leakage_q.LINES_SQL} SELECT doc_id, line_no FROM dl WHERE tok NOT IN (SELECT tok FROM bl)")
def matches_removed(spark, sf_dir):
    """U4: every document line without the lines that the benchmark has."""
    left = leakage.remove_all_matches(leakage_q.doc_lines(spark, sf_dir), leakage_q.bench_lines(spark, sf_dir), "tokens", "tokens")
    return left.select("doc_id", F.col("line_no").cast("int").alias("line_no"))


@register(
    "multitask_rows",
    f"""
    WITH t AS (SELECT conv_id, turn, {S.ws_tokens('text')} AS w FROM conversations),
    p AS (SELECT array_to_string(w, ' ') AS text, CAST(coalesce(list_sum(list_transform(w, lambda x: CASE WHEN length(x) >= 9 THEN 1 ELSE 0 END)), 0) AS BIGINT) AS ones, 1 AS text_label FROM t),
    s AS (SELECT doc_id, {S.collapse('text')} AS text FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND len({S.word_tokens('text')}) > 4),
    n AS (SELECT text, 0 AS ones, 0 AS text_label FROM s QUALIFY row_number() OVER (ORDER BY {S.seeded_hash(9, 'doc_id')}, doc_id) <= 50)
    SELECT md5(text) AS text_md5, ones, text_label, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM p UNION ALL SELECT * FROM n) GROUP BY ALL""",
)
def multitask_rows(spark, sf_dir):
    """U7 with R2: tagged turns united with fifty ordinary texts (a sampling operator)."""
    t = conversations(spark, sf_dir).select(T.ws_tokens(F.col("text")).alias("tokens"))
    t = t.withColumn("labels", F.transform("tokens", lambda x: F.when(F.length(x) >= 9, "B-trigger").otherwise("O")))
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    ordinary = records.negative_sentences(d, "toxic", "text").select(F.col("doc_id").alias("id"), T.collapse_ws("text").alias("text"), T.ws_tokens(F.col("text")).alias("tokens"))
    m = records.multitask_table(t, ordinary, 9, 50)
    ones = F.aggregate("token_label_binary", F.lit(0), lambda a, x: a + x).cast("long")
    return m.select(F.md5("text").alias("text_md5"), ones.alias("ones"), "text_label").groupBy("text_md5", "ones", "text_label").agg(F.count("*").alias("n"))


@register(
    "task_predictions",
    "SELECT event_type AS task, CAST(count(*) AS BIGINT) AS n, CAST(min(event_id) AS BIGINT) AS first_id FROM events GROUP BY event_type",
)
def task_predictions(spark, sf_dir):
    """A frame a task, each aggregated on its own."""
    ev = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("task"))
    out = None
    for name, part in sorted(records.demux_tasks(ev).items()):
        one = part.agg(F.lit(name).alias("task"), F.count("*").alias("n"), F.min("event_id").cast("long").alias("first_id"))
        out = one if out is None else out.unionByName(one)
    return out


HASHED = S.seeded_hash(13, "doc_id")


@register(
    "dev_slices",
    f"""
    WITH r AS (SELECT doc_id, {HASHED} AS h, row_number() OVER (ORDER BY {HASHED}, doc_id) AS r, count(*) OVER () AS n FROM documents)
    SELECT doc_id, h AS shuffle_key, CASE WHEN r <= ceil(n * 0.1) THEN 'dev' ELSE 'train' END AS split, CASE WHEN doc_id % 7 = 0 THEN 'dev' ELSE 'train' END AS custom FROM r""",
)
def dev_slices(spark, sf_dir):
    """A dev slice of exact size, a user's own split, and no row lost or doubled by either."""
    d = splits.seeded_order(table(spark, sf_dir, "documents").select("doc_id"), 13, "doc_id", "shuffle_key")
    train, dev = splits.dev_from_train(d, "doc_id", 13, 0.1)
    mine, other = splits.custom_split(d, lambda x: (x.filter("doc_id % 7 <> 0"), x.filter("doc_id % 7 = 0")))
    exact = train.withColumn("split", F.lit("train")).unionByName(dev.withColumn("split", F.lit("dev")))
    custom = mine.withColumn("custom", F.lit("train")).unionByName(other.withColumn("custom", F.lit("dev")))
    return exact.join(custom.select("doc_id", "custom"), "doc_id")


@register(
    "token_data_split",
    f"""
    WITH t AS (SELECT {QID} AS id, {S.ws_tokens('text')} AS w, turn % 5 = 0 AS short FROM conversations),
    ok AS (SELECT id, row_number() OVER (ORDER BY {S.seeded_hash(3, 'id')}, id) AS r, count(*) OVER () AS n FROM t WHERE NOT short OR len(w) = 0)
    SELECT id, CASE WHEN r <= ceil(n * 0.25) THEN 'dev' ELSE 'train' END AS split FROM ok UNION ALL SELECT id, 'rejected' FROM t WHERE short AND len(w) > 0""",
)
def token_data_split(spark, sf_dir):
    """Tagged turns, every fifth a label short, which are quarantined."""
    c = conversations(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", T.ws_tokens(F.col("text")).alias("tokens"))
    n = F.when(F.col("turn") % 5 == 0, F.greatest(F.size("tokens") - 1, F.lit(0))).otherwise(F.size("tokens"))
    good, bad = records.split_token_data(c.withColumn("labels", F.slice("tokens", F.lit(1), n)), "id", 3, 0.25)
    return good.select("id", "split").unionByName(bad.select("id", F.lit("rejected").alias("split")))


@register("shuffled_rows", f"SELECT doc_id, {S.seeded_hash(8, 'doc_id')} % 3 AS third FROM documents")
def shuffled_rows(spark, sf_dir):
    """Rows spread over partitions by a seeded hash; all are there and the same."""
    return records.global_shuffle(table(spark, sf_dir, "documents").select("doc_id"), 8, 8, "doc_id").select("doc_id", (seeded_hash(8, "doc_id") % 3).alias("third"))


@register(
    "passage_evaluation",
    f"""
    WITH s AS (SELECT l_orderkey AS qid, l_linenumber AS pid, {S.seeded_hash(71, 'l_orderkey', 'l_linenumber')} % 1000 AS score, l_returnflag = 'R' AS pos
               FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS r FROM s),
    q AS (SELECT qid, max(CASE WHEN pos AND r <= 3 THEN 1.0 / r ELSE 0 END) AS rr, bool_or(pos) AS has FROM r GROUP BY qid)
    SELECT round(sum(rr) / count(*), {R}) + 0.0 AS mrr, CAST(count(*) AS BIGINT) AS n_queries FROM q WHERE has""",
)
def passage_evaluation(spark, sf_dir):
    """M26 with Q18: scores of every line of every order, ranked and held against the positives."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("pid")).agg(F.min("l_returnflag").alias("f"))
    x = li.withColumn("score", (seeded_hash(71, "qid", "pid") % 1000).cast("double")).withColumn("positive", F.when(F.col("f") == "R", F.col("pid")))
    dev = nq.in_batch_labels(x, "qid", "pid", "positive").withColumn("label", F.coalesce("label", F.lit(0)))
    out = metrics.passage_eval(dev, x.select("qid", "pid", "score"), k=3)
    n = dev.filter("label = 1").agg(F.countDistinct("qid").alias("n_queries"))
    return metrics.scalar_join(out.select((F.round(out.columns[0], R) + 0.0).alias("mrr")), n)


@register("batch_scores", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def batch_scores(spark, sf_dir):
    """F2: a scorer plugged in, here the characters of each text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score.score_batches(d, score.length_loader, "text", "n_chars long").select("doc_id", "n_chars")
