"""Writers for the corpus and result formats (K1-K12). Rows are sorted only here, in the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """K1 / K6 (``partition_by='lang'``) / K12: JSON lines."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def _token_lines(tokens, labels) -> F.Column:
    """``token<TAB>label`` lines up to the end of the shorter list."""
    t, l = F.col(tokens), F.col(labels)
    n = F.least(F.size(t), F.size(l))
    pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(l, F.lit(1), n), lambda x, y: F.concat(x, F.lit("\t"), F.coalesce(y, F.lit(""))))
    return F.array_join(pairs, "\n")


def token_block(tokens, labels, opener: str = "SAMPLE_START\tO") -> F.Column:
    """One K2 record: opener line, ``token<TAB>label`` lines (pairs stop at the shorter list), blank line."""
    return F.concat(F.lit(opener + "\n"), _token_lines(tokens, labels), F.lit("\n"))


def write_token_blocks(df: DataFrame, path: str, tokens: str = "tokens", labels: str = "labels", order: str = "pos",
                       partition_by=None, mode: str = "overwrite") -> None:
    """K2 / K7: ``SAMPLE_START\\tO`` blocks in ``order``."""
    cols = [token_block(tokens, labels).alias("value")] + ([F.col(partition_by)] if partition_by else [])
    out = df.orderBy(order).select(*cols) if order in df.columns else df.select(*cols)
    w = out.write.mode(mode).option("lineSep", "\n")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.text(path)


CONLL_HEADER = "-DOCSTART- O\n"


def write_conll(df: DataFrame, path: str, tokens: str = "tokens", labels: str = "ner_label", order: str = "pos",
                mode: str = "overwrite") -> None:
    """K3: a ``-DOCSTART-`` header (once, before the first sentence), ``token<TAB>label`` lines, a blank line after every sentence."""
    rows = df.select(F.concat(_token_lines(tokens, labels), F.lit("\n")).alias("value"), F.lit(1).alias("__part"),
                     *([F.col(order).alias("__order")] if order in df.columns else [F.lit(None).cast("int").alias("__order")]))
    header = df.sparkSession.range(1).select(F.lit(CONLL_HEADER).alias("value"), F.lit(0).alias("__part"),
                                             F.lit(None).cast(rows.schema["__order"].dataType).alias("__order"))
    header.unionByName(rows).orderBy("__part", "__order").select("value").write.mode(mode).text(path)


def sentence_to_tsv(df: DataFrame, path: str, text: str = "text", cols=("id", "text", "label"), drop_empty: bool = True,
                    mode: str = "overwrite") -> None:
    """K4: T1-cleaned text as TSV with header; empty rows dropped unless ``drop_empty=False``
    (the reference meant to drop them but discards the result of ``dropna``)."""
    out = df.withColumn(text, T.preprocess_text(F.col(text)))
    if drop_empty:
        out = out.filter(F.length(text) > 0)
    out.select(*cols).write.mode(mode).option("sep", "\t").option("escape", '"').option("header", True).csv(path)


def write_lm_text(df: DataFrame, path: str, sentences: str = "sentences", per_document: bool = True, mode: str = "overwrite") -> None:
    """K5: language-model text: a document's sentences one per line followed by a blank line, or
    (``per_document=False``) every sentence followed by a blank line."""
    if per_document:
        rec = F.concat(lm_record(sentences), F.lit("\n"))
        df.select(rec.alias("value")).write.mode(mode).text(path)
    else:
        df.select(F.concat(F.explode(F.col(sentences)), F.lit("\n")).alias("value")).write.mode(mode).text(path)


def squad_predictions(preds: DataFrame, gold_ids: DataFrame, qid: str = "qid", answer: str = "answer") -> DataFrame:
    """K8: top answer per question (NULL -> ``""``) plus every gold id without a prediction
    (left anti join) with ``""``."""
    top = preds.select(F.col(qid), F.coalesce(F.col(answer), F.lit("")).alias(answer))
    missing = gold_ids.select(qid).join(top, qid, "left_anti").withColumn(answer, F.lit(""))
    return top.unionByName(missing)


def msmarco_scores(df: DataFrame, label: str = "label", prob: str = "probability") -> DataFrame:
    """K9: relevance score per row: ``p`` for label 1, ``1-p`` for label 0."""
    return df.withColumn("score", F.when(F.col(label) == "1", F.col(prob)).when(F.col(label) == "0", 1 - F.col(prob)))


def vector_line(word, vec) -> F.Column:
    """K10, one line: ``word v1 ... vd``."""
    return F.concat_ws(" ", F.col(word), F.array_join(F.transform(F.col(vec), lambda x: x.cast("string")), " "))


def lm_record(sentences) -> F.Column:
    """K5, one document: its sentences one per line."""
    return F.array_join(F.col(sentences), "\n")


def write_vectors(df: DataFrame, path: str, word: str = "word", vec: str = "vec", mode: str = "overwrite") -> None:
    """``word v1 ... vd`` text lines."""
    df.select(vector_line(word, vec).alias("value")) \
        .write.mode(mode).text(path)


def write_metrics(df: DataFrame, path: str, task: str, split: str) -> None:
    """Metrics as a long table ``(task, split, metric, value)`` (one column per metric in, one row
    per metric out) in a Parquet table with a folder for each task and split; a retry replaces its own folder only."""
    cols = [c for c in df.columns]
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m"))
    stacked.select(F.lit(task).alias("task"), F.lit(split).alias("split"), "m.metric", "m.value").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("task", "split").parquet(path)


def dump_labels_and_preds(df: DataFrame, path: str, qid: str = "qid", answers: str = "answers", pred: str = "pred",
                          mode: str = "overwrite") -> None:
    """Per-question dump of the de-duplicated gold answers and the prediction (JSON lines)."""
    df.select(F.col(qid).alias("id"), F.array_distinct(F.col(answers)).alias("label"), F.col(pred).alias("pred")) \
        .write.mode(mode).json(path)
