"""Files written by the sinks and read back by the sources (S1-S19, K1-K7, K10-K12), below the session's shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog.registry import register
from quire.functions import text as T
from quire.session import checkpoint_dir
from quire.sources import formats, writers
from quire.sources.tables import table

R = 6


def folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/quire-files/{name}-{uuid.uuid4().hex}"


def write_json_values(records: DataFrame, path: str, opening: str, closing: str) -> None:
    """One JSON value a part file: ``opening``, the records (one column of JSON objects) with commas between them, ``closing``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = opening
        for batch in batches:
            lines = []
            for v in batch.column(0).to_pylist():
                lines.append(head + v)
                head = ", "
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([(opening if head == opening else "") + closing])], names=["value"])

    records.mapInArrow(run, "value string").write.text(path)


@register("jsonl_files", "SELECT doc_id AS id, md5(text) AS text_md5, lang FROM documents")
def jsonl_files(spark, sf_dir):
    """K1, K6 -> S1, S2: JSON lines, a folder a language."""
    path = folder(spark, "jsonl")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    writers.write_jsonl(d, path, partition_by="lang")
    return formats.read_jsonl(spark, path, formats.DOCUMENT_SCHEMA + ", lang STRING").select("id", F.md5("text").alias("text_md5"), "lang")


TURNS = f"SELECT conv_id, turn, {S.ws_tokens('text')} AS toks FROM conversations"


def _turns(spark, sf_dir, suffix: bool = False) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    extra = lambda t: F.when(F.length(t) % 2 == 0, "part").otherwise("deriv") if suffix else F.lit("")
    labels = F.transform("tokens", lambda t: F.when(F.length(t) >= 9, F.concat(F.lit("B-LOC"), extra(t))).otherwise("O"))
    return c.withColumn("labels", labels).withColumn("pos", F.struct("conv_id", "turn"))


def _label_rows(df: DataFrame, labels) -> DataFrame:
    return df.select(F.array_join("tokens", " ").alias("tokens"), F.array_join(labels, " ").alias("labels"))


LABELLED = f"""WITH t AS ({TURNS}) SELECT array_to_string(toks, ' ') AS tokens, array_to_string(list_transform(toks, lambda x: CASE WHEN length(x) >= 9 THEN 'B-LOC' ELSE 'O' END), ' ') AS labels
    FROM t WHERE len(toks) > 0"""


@register("token_block_files", LABELLED)
def token_block_files(spark, sf_dir):
    """K2 -> S3."""
    path = folder(spark, "blocks")
    writers.write_token_blocks(_turns(spark, sf_dir), path)
    return _label_rows(formats.read_token_blocks(spark, path), "labels")


@register("token_block_folders", f"""WITH t AS ({TURNS}) SELECT role, CAST(count(*) AS BIGINT) AS n_blocks, CAST(sum(len(toks)) AS BIGINT) AS n_tokens
    FROM t JOIN conversations USING (conv_id, turn) WHERE len(toks) > 0 GROUP BY role""")
def token_block_folders(spark, sf_dir):
    """K7 -> S3: a folder a role."""
    path = folder(spark, "block-folders")
    writers.write_token_blocks(_turns(spark, sf_dir).join(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"]), path, partition_by="role")
    b = formats.read_token_blocks(spark, path).withColumn("role", F.regexp_extract("pos.file", "role=([^/]*)/", 1))
    return b.groupBy("role").agg(F.count("*").alias("n_blocks"), F.sum(F.size("tokens")).alias("n_tokens"))


@register("conll_files", f"{LABELLED} AND NOT starts_with(toks[1], '# ')")
def conll_files(spark, sf_dir):
    """K3 -> S4, S5: labels with the suffixes of nested annotations, which the reader's rule removes."""
    path = folder(spark, "conll")
    writers.write_conll(_turns(spark, sf_dir, suffix=True), path, labels="labels")
    return _label_rows(formats.read_conll(spark, path), formats.germeval_labels("ner_label"))


@register("tsv_files", f"""SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, {S.preprocess('text')} AS sentence, role AS label FROM conversations
    WHERE length({S.preprocess('text')}) > 0""")
def tsv_files(spark, sf_dir):
    """K4 -> S6: cleaned text as delimited text, three of its columns read under other names."""
    path = folder(spark, "tsv")
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.col("role").alias("label"))
    writers.sentence_to_tsv(c, path)
    return formats.read_tsv(spark, path, ["id", "text", "label"], rename={"text": "sentence"})


@register("tsv_pair_files", f"SELECT {S.collapse('text')} AS text, role AS text_b, CASE WHEN turn % 3 = 0 THEN '' ELSE CAST(turn AS VARCHAR) END AS label FROM conversations WHERE length({S.collapse('text')}) > 0")
def tsv_pair_files(spark, sf_dir):
    """Text pairs, read without a quote character."""
    path = folder(spark, "pairs")
    line = F.concat_ws("\t", T.collapse_ws("text"), "role", F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("turn").cast("string")))
    rows = table(spark, sf_dir, "conversations").filter(F.length(T.collapse_ws("text")) > 0).select(line.alias("value"))

    def headed(batches):  # every part file has the header
        yield pa.RecordBatch.from_arrays([pa.array(["text\ttext_b\tlabel"])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    rows.mapInArrow(headed, "value string").write.text(path)
    return formats.read_tsv_pair(spark, path)


@register("document_text_files", """
    WITH l AS (SELECT list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM documents)
    SELECT CAST(len(lines) AS INTEGER) AS n_lines, md5(array_to_string(lines, chr(10))) AS lines_md5 FROM l WHERE len(lines) > 0""")
def document_text_files(spark, sf_dir):
    """K5 -> S8: documents as language-model text, a blank line after each."""
    path = folder(spark, "lm")
    lines = F.filter(F.split("text", "\n"), lambda l: F.length(F.trim(l)) > 0)
    writers.write_lm_text(table(spark, sf_dir, "documents").select(lines.alias("sentences")).filter(F.size("sentences") > 0), path)
    return formats.read_docs_from_txt(spark, path).select(F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


@register("squad_files", """
    SELECT conv_id * 1000 + turn AS qid, md5(text) AS context_md5, role AS question, CASE WHEN turn % 2 = 0 THEN 'no_answer' ELSE 'span' END AS answer_type,
           CAST(CASE WHEN turn % 2 = 0 THEN NULL ELSE turn END AS INTEGER) AS answer_start FROM conversations""")
def squad_files(spark, sf_dir):
    """An article a turn, each part file one JSON value cut at its articles."""
    path = folder(spark, "squad")
    c = table(spark, sf_dir, "conversations")
    none = F.array().cast("array<struct<text:string,answer_start:int>>")
    answers = F.when(F.col("turn") % 2 == 0, none).otherwise(F.array(F.struct(F.substring("text", 1, 4).alias("text"), F.col("turn").cast("int").alias("answer_start"))))
    qa = F.struct((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), F.col("role").alias("question"), (F.col("turn") % 2 == 0).alias("is_impossible"), answers.alias("answers"))
    article = F.struct(F.lit("t").alias("title"), F.array(F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs"))
    write_json_values(c.select(F.to_json(article).alias("value")), path, '{"version": "v2.0", "data": [', "]}")
    q = formats.read_squad(spark, path)
    return q.select(F.col("qid").cast("long").alias("qid"), F.md5("context").alias("context_md5"), "question", "answer_type", F.get("answers", 0)["answer_start"].alias("answer_start"))


@register("nq_files", """
    SELECT CAST(doc_id AS VARCHAR) AS example_id, md5(text) AS text_md5, CAST(doc_id % 50 AS INTEGER) AS start_token, CAST(doc_id % 3 AS INTEGER) AS n_short FROM documents""")
def nq_files(spark, sf_dir):
    """K1 -> S10: question records with a nested, declared schema."""
    path = folder(spark, "nq")
    span = F.struct((F.col("doc_id") % 50).cast("int").alias("start_token"), (F.col("doc_id") % 50 + 5).cast("int").alias("end_token"))
    shorts = F.array_repeat(span, (F.col("doc_id") % 3).cast("int"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("example_id"), F.lit("what?").alias("question_text"), F.col("text").alias("document_text"),
                                                 F.array(F.struct(span.alias("long_answer"), shorts.alias("short_answers"), F.lit("NONE").alias("yes_no_answer"))).alias("annotations"))
    writers.write_jsonl(d, path)
    a = F.get("annotations", 0)
    return formats.read_nq_jsonl(spark, path).select("example_id", F.md5("document_text").alias("text_md5"), a["long_answer"]["start_token"].alias("start_token"),
                                                     F.size(a["short_answers"]).alias("n_short"))


@register("retrieval_files", """
    SELECT 'q' || conv_id || '-' || turn AS query, md5(text) AS positive_md5, 'p' || turn AS passage_id, CAST(least(2, turn % 4) AS INTEGER) AS n_negatives FROM conversations""")
def retrieval_files(spark, sf_dir):
    """Retrieval records under alias keys, each part file one array cut at its records."""
    path = folder(spark, "retrieval")
    ctx = F.struct(F.lit("t").alias("title"), F.col("text"), F.concat(F.lit("p"), "turn").alias("passage_id"))
    negatives = F.array_repeat(F.struct(F.lit("other").alias("text")), (F.col("turn") % 4).cast("int"))
    r = table(spark, sf_dir, "conversations").select(F.to_json(F.struct(
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("q"), "conv_id", F.lit("-"), "turn", F.lit("?"))).alias("question"),
        F.when(F.col("turn") % 2 == 1, F.concat(F.lit("q"), "conv_id", F.lit("-"), "turn")).alias("query"),
        F.array(ctx).alias("positive_ctxs"), negatives.alias("hard_negative_contexts"))).alias("value"))
    write_json_values(r, path, "[", "]")
    d = formats.read_retrieval_json(spark, path, num_hard_negatives=2)
    p = F.get("positives", 0)
    return d.select("query", F.md5(p["text"]).alias("positive_md5"), p["passage_id"].alias("passage_id"), F.size("hard_negatives").alias("n_negatives"))


@register("multitask_files", f"""WITH t AS ({TURNS}) SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS text, CAST(len(toks) AS INTEGER) AS n,
    md5(array_to_string(toks, ' ')) AS tokens_md5, CAST(coalesce(list_sum(list_transform(toks, lambda x: CASE WHEN length(x) >= 9 THEN 1 ELSE 0 END)), 0) AS INTEGER) AS ones,
    CAST(turn % 2 AS INTEGER) AS text_label FROM t""")
def multitask_files(spark, sf_dir):
    """Quoted cells with list literals, one of them over several lines."""
    path = folder(spark, "multitask")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ws_tokens(F.col("text")).alias("toks"))

    def literal(arr, quote: str, end: str = "]"):
        inner = F.transform(arr, lambda t: F.concat(F.lit(quote), F.replace(F.replace(t.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit(quote)))
        return F.concat(F.lit("["), F.array_join(inner, ", "), F.lit(end))

    flags = F.transform("toks", lambda t: F.when(F.length(t) >= 9, 1).otherwise(0))
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("text"), literal("toks", '"', "\n]").alias("text_tokens"),
                    literal(F.transform("toks", lambda t: F.lit("O")), '"').alias("token_label_iob"), literal(flags, "").alias("token_label_binary"), (F.col("turn") % 2).alias("text_label"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    m = formats.read_mtl_csv(spark, path)
    return m.select("text", F.size("text_tokens").alias("n"), F.md5(F.array_join("text_tokens", " ")).alias("tokens_md5"),
                    F.aggregate("token_label_binary", F.lit(0), lambda a, x: a + x).alias("ones"), "text_label")


@register("ranking_files", "SELECT CAST(conv_id AS INTEGER) AS qid, CAST(length(text) AS INTEGER) AS pid, CAST(turn AS INTEGER) AS rank, CAST(turn % 2 AS INTEGER) AS rel FROM conversations")
def ranking_files(spark, sf_dir):
    """Judgements and a run as tab-separated text, joined after reading."""
    run, judged = folder(spark, "run"), folder(spark, "qrels")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("pid"))
    c.select("conv_id", "pid", "turn").write.option("sep", "\t").csv(run)
    c.select("conv_id", "turn", "pid", F.col("turn") % 2).write.option("sep", "\t").csv(judged)
    q = formats.read_qrels(spark, judged).select("qid", F.col("iter").alias("rank"), "pid", "rel")
    return formats.read_run(spark, run).join(q, ["qid", "rank", "pid"]).select("qid", "pid", "rank", "rel")


@register("vector_files", f"""
    SELECT 'v' || vec_id AS word, CAST(vec_id % 7 + 1 AS BIGINT) AS n, CAST(len(embedding) AS INTEGER) AS dim,
           CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), {R}) + 0.0 END AS total FROM embeddings""")
def vector_files(spark, sf_dir):
    """K10 -> S15, S16: word vectors read for a vocabulary file, some of whose words have none."""
    path, vocab = folder(spark, "vectors"), folder(spark, "vocab")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("v"), "vec_id").alias("word"), F.col("embedding").alias("vec"))
    writers.write_vectors(e.filter("vec_id % 5 <> 0"), path)
    e.select(F.concat_ws(" ", "word", F.col("vec_id") % 7 + 1).alias("value")).write.text(vocab)
    v = formats.read_word_vectors(spark, path, vocab=formats.read_vocab(spark, vocab))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("word", "n", F.size("vec").alias("dim"), (F.round(total, R) + 0.0).alias("total"))


@register("set_files", r"SELECT DISTINCT regexp_replace(unnest(string_split(text, chr(10))), ' +$', '') AS value FROM documents")
def set_files(spark, sf_dir):
    """The set of a file's lines."""
    path = folder(spark, "set")
    table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return formats.read_set(spark, path)


@register("split_file_sizes", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(ceil(count(*) / 500.0) AS BIGINT) AS n_files, CAST(count(*) // 4 AS BIGINT) AS n_prefix, CAST(round_even(count(*) * 0.3, 0) AS BIGINT) AS n_sample FROM events")
def split_file_sizes(spark, sf_dir):
    """Rows dealt to files in order, then a prefix in file order and a seeded sample of the files."""
    path = folder(spark, "parts")
    ev = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("pos"))
    n = ev.count()
    formats.split_files(ev, path, 500, n_rows=n)
    back = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    files = back.agg(F.count("*").alias("n_rows"), F.countDistinct("file").alias("n_files"))
    prefix = formats.sample_at_read(back, max_rows=n // 4).agg(F.count("*").alias("n_prefix"), F.max("pos").alias("last"))
    ok = ev.orderBy("pos").limit(n // 4).agg(F.max("pos").alias("last"))
    sample = formats.sample_at_read(back, fraction=0.3, seed=3, key="event_id").agg(F.count("*").alias("n_sample"))
    return files.join(prefix.join(ok, "last").drop("last"), how="cross").join(sample, how="cross")


@register("metric_files", "SELECT 'iris' AS task, split, metric, CAST(v AS DOUBLE) AS value FROM (SELECT 'dev' AS split, 'n' AS metric, count(*) AS v FROM labels UNION ALL SELECT 'dev', 'toxic', sum(toxic) FROM labels UNION ALL SELECT 'test', 'quality', sum(quality) FROM labels)")
def metric_files(spark, sf_dir):
    """Metrics as a long table; the second writing of a split replaces the first."""
    path, l = folder(spark, "metrics"), table(spark, sf_dir, "labels")
    writers.write_metrics(l.agg(F.lit(0).alias("stale")), path, "iris", "dev")
    writers.write_metrics(l.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")), path, "iris", "dev")
    writers.write_metrics(l.agg(F.sum("quality").alias("quality")), path, "iris", "test")
    return spark.read.schema("metric string, value double, task string, split string").parquet(path).select("task", "split", "metric", "value")


@register("label_dump_files", "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 2 = 0 THEN [role] ELSE [role, 'other'] END AS label, md5(text) AS pred FROM conversations")
def label_dump_files(spark, sf_dir):
    """Gold answers without repeats and the prediction, as JSON lines."""
    path = folder(spark, "dump")
    answers = F.when(F.col("turn") % 2 == 0, F.array("role", "role")).otherwise(F.array(F.col("role"), F.lit("other"), F.col("role")))
    writers.dump_labels_and_preds(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), answers.alias("answers"), F.md5("text").alias("pred")), path)
    return spark.read.schema("id bigint, label array<string>, pred string").json(path)
