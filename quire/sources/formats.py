"""Readers for the corpus file formats (S1-S19). Schemas are declared, never inferred.

Multi-line records (token blocks, CoNLL sentences, paragraph documents) are read with the text
source and a record separator (``lineSep``), so Hadoop's splittable line reader cuts large files
at record boundaries and every block is parsed inside its task. File order, which the source
format makes meaningful (keep-first de-duplication, first-match containment), is kept as a
``pos`` struct ``(file, block_start, row)`` built from the hidden ``_metadata`` column and a
per-task increasing id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quire.functions import text as T
from quire.functions.labels import let
from quire.plans.scalar import scalar_join
from quire.sources.records import csv_records, json_records

SENTENCE_SCHEMA = "id BIGINT, sentence STRING, label INT"
DOCUMENT_SCHEMA = "id BIGINT, text STRING"
FAILFAST = {"mode": "FAILFAST"}
LINE_MARK = "\ue000\ue001"  # private use characters


def file_pos() -> Column:
    """Stable file-order key of a row: (file path, block start, increasing id)."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(df: DataFrame, content: Column) -> Column:
    """An id from the file, the record's content and its number among equal records of the file: the same however the input
    is split, so a seeded split on it is reproducible."""
    w = Window.partitionBy("pos.file", F.xxhash64(content)).orderBy("pos")
    return F.xxhash64(F.col("pos.file"), content, F.row_number().over(w))


def read_jsonl(spark: SparkSession, path, schema: str | Ty.StructType = SENTENCE_SCHEMA, with_pos: bool = True) -> DataFrame:
    """JSON lines with a declared schema; a malformed line fails the job (FAILFAST)."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.withColumn("pos", file_pos()) if with_pos else df


def _blocks(spark: SparkSession, path, sep: str) -> DataFrame:
    return spark.read.option("lineSep", sep).text(path).select(F.col("value").alias("block"), file_pos().alias("pos"))


def parse_token_block(block, train: bool = True) -> Column:
    """S3, one record without its opener: ``struct<tokens,labels>``; per line ``token<TAB>label``, token stripped, label = field 1;
    test records hold tokens only (whole lines) and NULL labels."""
    lines = F.split(T.py_strip(_col(block)), "\n")
    if not train:
        return F.struct(lines.alias("tokens"), F.lit(None).cast("array<string>").alias("labels"))
    return let(F.transform(lines, lambda l: F.split(l, "\t")), lambda fields: F.struct(
        F.transform(fields, lambda f: T.py_strip(F.get(f, 0))).alias("tokens"), F.transform(fields, lambda f: F.get(f, 1)).alias("labels")))


def read_token_blocks(spark: SparkSession, path, train: bool = True) -> DataFrame:
    """S3: blocks opened by ``SAMPLE_START\\tO`` (train) or ``SAMPLE_START`` (test); a block of
    length <= 1 is dropped; each is read by ``parse_token_block``. Output: ``instance_id, tokens, labels, pos``."""
    b = _blocks(spark, path, "SAMPLE_START\tO" if train else "SAMPLE_START").filter(F.length("block") > 1)
    return b.select(stable_id(b, F.col("block")).alias("instance_id"), parse_token_block("block", train).alias("x"), "pos").select(
        "instance_id", "x.tokens", "x.labels", "pos")


def read_conll(spark: SparkSession, path, sep: str = "\t", comment_prefix: str = "# ", token_field: int = 0,
               label_field: int = -1) -> DataFrame:
    """CoNLL column file; sentences end at blank lines and ``-DOCSTART-`` lines; comment
    lines (``comment_prefix``; the reference drops every line starting with ``#``, losing hashtag
    tokens) are skipped; token = ``token_field``, label = ``label_field`` (GermEval: 1 and -2), empty
    label -> ``O``. Output: ``sent_id, text, tokens, ner_label, pos``."""
    b = _blocks(spark, path, "\n\n")
    sents = b.select(F.posexplode(conll_sentences("block")).alias("part", "s"), "pos")
    out = sents.select(parse_conll_sentence("s", sep, comment_prefix, token_field, label_field).alias("x"),
                       F.struct(F.col("pos.file"), F.col("pos.block"), F.col("pos.row"), F.col("part")).alias("pos"))
    out = out.select(F.col("x.tokens").alias("tokens"), F.col("x.labels").alias("ner_label"), "pos").filter(F.size("tokens") > 0)
    content = F.concat_ws("\u0001", F.col("tokens"), F.lit("\u0002"), F.col("ner_label"))
    return out.select(stable_id(out, content).alias("sent_id"), F.array_join("tokens", " ").alias("text"),
                      "tokens", "ner_label", "pos")


def conll_sentences(block) -> Column:
    """Text between blank lines, cut at ``-DOCSTART-`` lines."""
    return F.split(_col(block), "(?m)^[^\n]*-DOCSTART-[^\n]*$")


def parse_conll_sentence(sentence, sep: str = "\t", comment_prefix: str = "# ", token_field: int = 0, label_field: int = -1) -> Column:
    """S4, one sentence: ``struct<tokens,labels>``; comment and blank lines are skipped, an empty label is ``O``."""
    lines = F.filter(F.split(_col(sentence), "\n"), lambda l: (F.length(T.py_strip(l)) > 0) & ~l.startswith(comment_prefix))

    def pick(f, i):
        return F.get(f, i) if i >= 0 else F.get(f, F.size(f) + i)

    return let(F.transform(lines, lambda l: F.split(l, sep)), lambda fields: F.struct(
        F.transform(fields, lambda f: pick(f, token_field)).alias("tokens"),
        F.transform(fields, lambda f: F.when(pick(f, label_field) == "", "O").otherwise(T.py_strip(pick(f, label_field)))).alias("labels")))


def germeval_labels(labels) -> Column:
    """Drop the ``part``/``deriv`` suffixes of the first annotation level."""
    return F.transform(F.col(labels) if isinstance(labels, str) else labels, lambda x: F.regexp_replace(x, "part|deriv", ""))


def read_tsv(spark: SparkSession, path, columns: Sequence[str], rename: dict | None = None, delimiter: str = "\t",
             quotechar: str = '"', header: bool = True) -> DataFrame:
    """Delimited text, every column a string, missing values ``""``; only ``columns`` are
    kept (CSV column pruning); ``rename`` maps file names to ours."""
    df = spark.read.option("sep", delimiter).option("quote", quotechar).option("escape", quotechar).option(
        "header", header).csv(path)
    rename = rename or {}
    out = df.select(*[F.col(c).cast("string").alias(rename.get(c, c)) for c in columns])
    return out.na.fill("")


def read_tsv_pair(spark: SparkSession, path, delimiter: str = "\t", header: bool = True) -> DataFrame:
    """``text, text_b, label``; no quote character; only the label is filled with ``""``."""
    df = spark.read.option("sep", delimiter).option("quote", "\u0000").option("header", header).csv(path)
    return df.select(F.col("text"), F.col("text_b"), F.coalesce(F.col("label"), F.lit("")).alias("label"))


def read_docs_from_txt(spark: SparkSession, path) -> DataFrame:
    """Documents separated by blank lines -> ``doc_id, lines, pos``; empty documents skipped.
    (The reference also drops a last document equal to the previous one; de-duplication is U1's job.)"""
    b = _blocks(spark, path, "\n\n")
    lines = F.filter(F.split(F.col("block"), "\n"), lambda l: F.length(T.py_strip(l)) > 0)
    d = b.select(lines.alias("lines"), "pos").filter(F.size("lines") > 0)
    return d.select(stable_id(d, F.array_join("lines", "\n")).alias("doc_id"), "lines", "pos")


NQ_SCHEMA = ("example_id STRING, question_text STRING, document_text STRING, annotations ARRAY<STRUCT<long_answer: STRUCT<start_token: INT, end_token: INT>, "
             "short_answers: ARRAY<STRUCT<start_token: INT, end_token: INT>>, yes_no_answer: STRING>>")


def read_nq_jsonl(spark: SparkSession, path, with_pos: bool = False) -> DataFrame:
    """Question records, one JSON object a line, with their nested schema declared."""
    return read_jsonl(spark, path, NQ_SCHEMA, with_pos)


SQUAD_SCHEMA = Ty.StructType([
    Ty.StructField("data", Ty.ArrayType(Ty.StructType([
        Ty.StructField("title", Ty.StringType()),
        Ty.StructField("paragraphs", Ty.ArrayType(Ty.StructType([
            Ty.StructField("context", Ty.StringType()),
            Ty.StructField("qas", Ty.ArrayType(Ty.StructType([
                Ty.StructField("id", Ty.StringType()),
                Ty.StructField("question", Ty.StringType()),
                Ty.StructField("is_impossible", Ty.BooleanType()),
                Ty.StructField("answers", Ty.ArrayType(Ty.StructType([
                    Ty.StructField("text", Ty.StringType()), Ty.StructField("answer_start", Ty.IntegerType())]))),
            ]))),
        ]))),
    ]))),
])


def read_squad(spark: SparkSession, path) -> DataFrame:
    """S9 + R13: SQuAD JSON documents -> one row per question
    ``(doc_idx, par_idx, context, qid, question, answers, answer_type)``. A file is one JSON value: it is cut at its articles
    (``sources.records``), so that many tasks read it; ``doc_idx`` is the article's number in its file."""
    article = SQUAD_SCHEMA["data"].dataType.elementType
    raw = json_records(spark, path, depth=2).select(F.col("idx").cast("int").alias("doc_idx"), F.from_json("value", article, FAILFAST).alias("d"))
    p = raw.select("doc_idx", F.posexplode("d.paragraphs").alias("par_idx", "p"))
    q = p.select("doc_idx", "par_idx", F.col("p.context").alias("context"), F.explode("p.qas").alias("qa"))
    return q.select(
        "doc_idx", "par_idx", "context", F.col("qa.id").alias("qid"), F.col("qa.question").alias("question"),
        F.col("qa.answers").alias("answers"),
        F.when(F.col("qa.is_impossible"), "no_answer").otherwise("span").alias("answer_type"),
    )


# Alias keys of retrieval records.
RETRIEVAL_POS = ["positive_contexts", "positive_ctxs", "positive_context", "positive_ctx"]
RETRIEVAL_NEG = ["hard_negative_contexts", "hard_negative_ctxs", "hard_negative_context", "hard_negative_ctx"]


def read_retrieval_json(spark: SparkSession, path, num_positives: int = 1, num_hard_negatives: int = 1, max_samples: int | None = None,
                        shuffle_positives: bool = False, shuffle_negatives: bool = False, seed: int = 0, lines: bool = False) -> DataFrame:
    """S11 + R10 + R11: retrieval records with alias keys. Query from ``question``/``questions``/
    ``query``; positives from ``RETRIEVAL_POS``, hard negatives from ``RETRIEVAL_NEG``. Missing passage id -> ``xxhash64`` of the text.
    Output: ``query, positives, hard_negatives`` (title, text, passage_id structs, sliced).

    A file is one array, cut at its records so that many tasks read it, or (``lines``) one record a line. ``max_samples``: a seeded sample of at
    most so many records; ``shuffle_positives`` / ``shuffle_negatives``: passages in a seeded order before the first ones are taken."""
    ctx_t = "array<struct<title:string,text:string,passage_id:string>>"
    keys = {"question": "string", "query": "string", "questions": "string", **{k: ctx_t for k in RETRIEVAL_POS + RETRIEVAL_NEG}}
    records = json_records(spark, path, depth=0 if lines else 1)
    if max_samples is not None:
        records = records.orderBy(F.xxhash64(F.lit(seed), "file", "idx"), "file", "idx").limit(max_samples)
    df = records.select(F.from_json("value", ", ".join(f"{k} {t}" for k, t in keys.items()), FAILFAST).alias("r")).select("r.*")

    def norm(names, k, shuffled):
        arr = F.coalesce(*[F.col(n) for n in names], F.array().cast(ctx_t))
        if shuffled:
            ranked = F.transform(arr, lambda c, i: F.struct(F.xxhash64(F.lit(seed), c["text"], i).alias("h"), i.alias("i"), c.alias("c")))
            arr = F.transform(F.array_sort(ranked), lambda x: x["c"])
        fixed = F.transform(F.slice(arr, 1, k), lambda c: F.struct(
            F.coalesce(c["title"], F.lit("")).alias("title"), c["text"].alias("text"),
            F.coalesce(c["passage_id"].cast("string"), F.xxhash64(c["text"]).cast("string")).alias("passage_id")))
        return fixed

    q = F.coalesce("question", "questions", "query")
    return df.select(F.regexp_replace(q, "\\?$", "").alias("query"), norm(RETRIEVAL_POS, num_positives, shuffle_positives).alias("positives"),
                     norm(RETRIEVAL_NEG, num_hard_negatives, shuffle_negatives).alias("hard_negatives"))


def python_list(col, element: str) -> Column:
    """A Python list literal (``['a', "don't"]``) as an array: single or double quotes, backslash escapes."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, f"array<{element}>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def read_quoted_csv(spark: SparkSession, path, delimiter: str = ",") -> DataFrame:
    """CSV files with one header, whose quoted cells may hold line breaks and doubled quotes: every column a string."""
    header = spark.read.option("header", True).option("sep", delimiter).option("escape", '"').option("multiLine", True).csv(path).columns
    rows = csv_records(spark, path).filter("idx > 0").select(F.regexp_replace("value", "\r?\n\\z", "").alias("v")).filter("length(v) > 0")
    schema = Ty.StructType([Ty.StructField(f"c{i}", Ty.StringType()) for i in range(len(header))])
    # cells hold their line breaks under a mark that text does not have, as from_csv takes one line
    cells = F.from_csv(F.replace("v", F.lit("\n"), F.lit(LINE_MARK)), schema.simpleString()[7:-1].replace(":", " "), {"sep": delimiter, "escape": '"'})
    parsed = rows.select(cells.alias("r"))
    return parsed.select(*[F.replace(F.col(f"r.c{i}"), F.lit(LINE_MARK), F.lit("\n")).alias(c) for i, c in enumerate(header)])


def read_mtl_csv(spark: SparkSession, path) -> DataFrame:
    """Multi-task CSV whose cells hold Python list literals -> native arrays. Quoted cells may hold line breaks; a file is cut at its
    records, so that many tasks read it."""
    df = read_quoted_csv(spark, path)
    return df.select(
        F.col("text"), python_list("text_tokens", "string").alias("text_tokens"),
        python_list("token_label_iob", "string").alias("token_label_iob"),
        python_list("token_label_binary", "int").alias("token_label_binary"), F.col("text_label").cast("int").alias("text_label"),
    )


def read_qrels(spark: SparkSession, path) -> DataFrame:
    """``qid iter pid rel`` (tab separated); pid is the third field."""
    return spark.read.schema("qid INT, iter INT, pid INT, rel INT").option("sep", "\t").option("mode", "FAILFAST").csv(path)


def read_run(spark: SparkSession, path) -> DataFrame:
    """``qid pid rank``; a duplicate (qid, rank) keeps the last line in file order."""
    df = spark.read.schema("qid INT, pid INT, rank INT").option("sep", "\t").option("mode", "FAILFAST").csv(path)
    df = df.withColumn("pos", file_pos())
    return df.groupBy("qid", "rank").agg(F.max_by("pid", "pos").alias("pid"))


def read_word_vectors(spark: SparkSession, path, vocab: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """``word v1 ... vd`` text; header lines (fewer than 4 fields) and lines of the wrong
    width are skipped; the first occurrence of a word wins; with ``vocab`` (column ``word``) the
    result is left-joined from the vocabulary and missing words get a zero vector."""
    t = spark.read.text(path).select(F.split(F.col("value"), " ").alias("f"), file_pos().alias("pos"))
    t = t.filter(F.size("f") >= 4)
    if dim is not None:
        t = t.filter(F.size("f") == dim + 1)
    v = t.select(F.get("f", 0).alias("word"), F.transform(F.slice("f", 2, 1 << 20), lambda x: x.cast("float")).alias("vec"), "pos")
    v = v.groupBy("word").agg(F.min_by("vec", "pos").alias("vec"))
    if vocab is None:
        return v
    size = v.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("__dim")) if dim is None else None
    j = vocab.join(v, "word", "left")
    j = scalar_join(j, size) if size is not None else j.withColumn("__dim", F.lit(dim))
    return j.withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), F.col("__dim")))).drop("__dim")


def parse_vector(line) -> Column:
    """S15, one line ``word v1 ... vd``: ``struct<word,vec>``."""
    return let(F.split(_col(line), " "), lambda f: F.struct(
        F.get(f, 0).alias("word"), F.transform(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0))), lambda x: x.cast("float")).alias("vec")))


def read_vocab(spark: SparkSession, path) -> DataFrame:
    """``word count`` lines (space separated)."""
    return spark.read.schema("word STRING, n BIGINT").option("sep", " ").csv(path)


def read_set(spark: SparkSession, path) -> DataFrame:
    """Distinct right-stripped lines."""
    return spark.read.text(path).select(F.rtrim("value").alias("value")).distinct()


def split_files(df: DataFrame, out: str, rows_per_file: int, order: str = "pos", n_rows: int | None = None) -> None:
    """Write ``df`` as many part files holding whole records in ``order`` (range partitioned);
    re-read the directory as one input."""
    n = n_rows if n_rows is not None else df.count()
    parts = max(1, -(-n // rows_per_file))
    df.repartitionByRange(parts, order).sortWithinPartitions(order).write.mode("overwrite").parquet(out)


def sample_at_read(df: DataFrame, max_rows: int | None = None, fraction: float | None = None, seed: int = 0,
                   key: str | None = None) -> DataFrame:
    """``max_rows`` = the prefix in file order (the reference's ``max_docs``), or an exact-size
    seeded sample of ``fraction`` (``operators.splits.exact_sample``)."""
    if max_rows is not None:
        return df.orderBy("pos").limit(max_rows)
    from quire.operators.splits import exact_sample

    return exact_sample(df, key or "pos", seed, fraction)
