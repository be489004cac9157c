"""Label sequences over whole documents (N8-N12, T16, Q22, Q23), basket rejection (R15), vocabularies with vectors (A10, J11), fold ensembles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.catalog import sqlbits as S
from quire.catalog.files_q import folder
from quire.catalog.registry import register
from quire.functions import labels as L
from quire.functions import text as T
from quire.operators import corpus, ensemble, records, score
from quire.operators import vectors as V
from quire.operators.splits import kfold
from quire.plans.hashing import seeded_hash
from quire.sources.tables import table

R = 6


def tagged(spark, sf_dir):
    """A tag and a probability for every token of every document, by the token's length."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.ws_tokens(F.col("text")).alias("tok"))
    k = lambda t: F.length(t) % 9
    tag = F.transform("tok", lambda t: F.when(k(t) == 0, "B-PER").when(k(t).isin(1, 2), "I-PER").when(k(t) == 3, "B-LOC").when(k(t) == 4, "I-LOC").otherwise("O"))
    return d.select("doc_id", tag.alias("tags"), F.transform("tok", lambda t: (F.length(t) * 37 % 100) / 100.0).alias("probs"))


TAGGED = f"""
tk AS (SELECT doc_id, unnest(t) AS t, unnest(range(len(t))) AS i FROM (SELECT doc_id, {S.ws_tokens('text')} AS t FROM documents)),
tg AS (SELECT doc_id, i, (length(t) * 37 % 100) / 100.0 AS p, CASE length(t) % 9 WHEN 0 THEN 'B-PER' WHEN 1 THEN 'I-PER' WHEN 2 THEN 'I-PER'
         WHEN 3 THEN 'B-LOC' WHEN 4 THEN 'I-LOC' ELSE 'O' END AS tag FROM tk),
lg AS (SELECT *, lag(tag) OVER w AS before, coalesce(lead(p) OVER w, p) AS after FROM tg WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
rn AS (SELECT *, sum(CASE WHEN tag[1:2] = 'I-' AND before <> 'O' AND tag[3:] = before[3:] THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM lg)
"""


@register(
    "entity_spans",
    f"""WITH {TAGGED}
    SELECT doc_id, 'iob' AS scheme, min(tag)[3:] AS tag, CAST(min(i) AS INTEGER) AS "start", CAST(max(i) AS INTEGER) AS "end",
           CAST(arg_max(after, i) AS DOUBLE) AS prob, round(CAST(avg(p) AS DOUBLE), {R}) AS mean_prob
    FROM rn GROUP BY doc_id, run HAVING arg_min(tag, i)[1:2] = 'B-'
    UNION ALL SELECT doc_id, 'plain', tag, CAST(i AS INTEGER), CAST(i AS INTEGER), CAST(p AS DOUBLE), round(CAST(p AS DOUBLE), {R}) FROM tg WHERE tag <> 'O'""",
)
def entity_spans(spark, sf_dir):
    """Entities of IOB tags with the closing and the mean probability, and the positions of plain tags."""
    t = tagged(spark, sf_dir)

    def rows(scheme):
        spans = records.format_by_scheme("tags", "probs", scheme)
        both = F.arrays_zip(spans.alias("s"), (L.iob_to_spans("tags", "probs", score="mean") if scheme == "iob" else spans).alias("m"))
        return t.select("doc_id", F.lit(scheme).alias("scheme"), F.explode(both).alias("x")).select(
            "doc_id", "scheme", "x.s.tag", "x.s.start", "x.s.end", "x.s.prob", F.round("x.m.prob", R).alias("mean_prob"))

    return rows("iob").unionByName(rows("plain"))


def pieces(words: Column, size: int = 4) -> Column:
    """Sub-word tokens: words (without blanks) cut after every ``size`` characters, the rest marked ``##``. One regular expression over all words of a row."""
    cut = F.regexp_replace(F.array_join(words, " "), f"([^ ]{{{size}}})(?=[^ ])", "$1 ##")
    return F.filter(F.split(cut, " "), lambda t: t != "")  # no words: no tokens


PIECES = f"""
wd AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS wi FROM (SELECT doc_id, {S.word_tokens('text')} AS t FROM documents)),
pc AS (SELECT doc_id, wi, k, CASE WHEN k > 0 THEN '##' ELSE '' END || substr(w, 4 * k + 1, 4) AS t
       FROM (SELECT *, unnest(range((length(w) - 1) // 4 + 1)) AS k FROM wd))
"""


@register(
    "whole_word_masking",
    f"""WITH RECURSIVE {PIECES},
    tok AS (SELECT doc_id, -1 AS wi, 0 AS k, '[CLS]' AS t FROM documents UNION ALL SELECT * FROM pc UNION ALL SELECT doc_id, 1000000000000, 0, '[SEP]' FROM documents),
    num AS MATERIALIZED (SELECT doc_id, t, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n,
                   CASE WHEN t IN ('[CLS]', '[SEP]', '[PAD]') THEN 0 ELSE count(*) FILTER (t NOT IN ('[CLS]', '[SEP]', '[PAD]') AND t[1:2] <> '##') OVER w END AS g
            FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY wi, k)),
    grp AS MATERIALIZED (SELECT doc_id, g, s, b, row_number() OVER (PARTITION BY doc_id ORDER BY md5('5:' || doc_id || ':' || g)) AS o
            FROM (SELECT doc_id, g, count(*) AS s, max(least(greatest(1, CAST(round_even(n * 0.15, 0) AS BIGINT)), 20)) AS b FROM num WHERE g > 0 GROUP BY ALL)),
    pick(doc_id, o, g, used, hit) AS (
      SELECT doc_id, 0, 0, 0, false FROM documents
      UNION ALL SELECT p.doc_id, grp.o, grp.g, used + CASE WHEN used + s <= b THEN s ELSE 0 END, used + s <= b
      FROM pick p JOIN grp ON grp.doc_id = p.doc_id AND grp.o = p.o + 1 WHERE used < b),
    lab AS (SELECT num.*, p.g IS NOT NULL AS hit, CAST('0x' || substr(md5('5m:' || num.doc_id || ':' || i), 1, 8) AS BIGINT) % 10 AS u
            FROM num LEFT JOIN (SELECT doc_id, g FROM pick WHERE hit) p ON p.doc_id = num.doc_id AND p.g = num.g),
    new AS (SELECT l.doc_id, l.i, l.t, hit, CASE WHEN NOT hit THEN l.t WHEN u < 8 THEN '[MASK]' WHEN u < 9 THEN l.t ELSE o.t END AS m
            FROM lab l LEFT JOIN num o ON o.doc_id = l.doc_id AND o.i = (u * 7919 + l.i) % l.n)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens, CAST(count(*) FILTER (hit) AS INTEGER) AS n_masked, md5(string_agg(m, ' ' ORDER BY i)) AS tokens_md5,
           md5(string_agg(CASE WHEN hit THEN t ELSE '' END, ' ' ORDER BY i)) AS labels_md5
    FROM new GROUP BY doc_id""",
)
def whole_word_masking(spark, sf_dir):
    """Q22, Q23: whole documents as sub-word sequences, masked by whole words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.array(F.lit("[CLS]")), pieces(T.word_tokens(F.col("text"))), F.array(F.lit("[SEP]"))).alias("tok"))
    m = d.select("doc_id", records.whole_word_mask("tok", 5, "doc_id").alias("m"))
    return m.select("doc_id", F.size("m.tokens").alias("n_tokens"), F.size(F.filter("m.labels", lambda x: x != "")).alias("n_masked"),
                    F.md5(F.array_join("m.tokens", " ")).alias("tokens_md5"), F.md5(F.array_join("m.labels", " ")).alias("labels_md5"))


WIDTH = 128


@register(
    "token_records",
    f"""WITH {PIECES},
    num AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY wi, k) - 1 AS i FROM pc),
    lab AS (SELECT doc_id, i // {WIDTH} AS record, i, t, CASE WHEN t[1:2] = '##' THEN 'X' WHEN length(t) = 4 THEN 'LONG' ELSE 'O' END AS l FROM num)
    SELECT doc_id, CAST(record AS INTEGER) AS record, CAST(count(*) AS INTEGER) AS n,
           array_to_string(list_concat(list(t ORDER BY i), list_transform(range({WIDTH} - count(*)), lambda x: '[PAD]')), ' ') AS tokens,
           array_to_string(list_concat(list(l ORDER BY i), list_transform(range({WIDTH} - count(*)), lambda x: 'X')), ' ') AS labels,
           CAST(count(*) FILTER (l <> 'X') AS INTEGER) AS n_words
    FROM lab GROUP BY doc_id, record""",
)
def token_records(spark, sf_dir):
    """Whole documents as records of fixed width, word labels spread over sub-word tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", pieces(T.word_tokens(F.col("text"))).alias("tok"))
    # null for no tokens, not a filter: that would be pushed below and cut every text twice
    parts = d.select("doc_id", F.posexplode(F.when(F.size("tok") > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size("tok") - 1) / WIDTH).cast("int")), lambda c: F.slice("tok", c * WIDTH + 1, F.lit(WIDTH))))).alias("record", "t"))
    mask = F.transform("t", lambda x: F.when(x.startswith("##"), 0).otherwise(1))
    words = F.transform(F.filter("t", lambda x: ~x.startswith("##")), lambda x: F.when(F.length(x) == 4, "LONG").otherwise("O"))
    r = parts.select("doc_id", "record", L.token_record("t", mask, words, WIDTH).alias("r"))
    return r.select("doc_id", F.col("record").cast("int").alias("record"), "r.n", F.array_join("r.tokens", " ").alias("tokens"), F.array_join("r.labels", " ").alias("labels"),
                    F.aggregate("r.initial_mask", F.lit(0), lambda a, x: a + x).alias("n_words"))


def baskets(spark, sf_dir):
    """A basket a document, a sample a line; a sample is bad if its line is blank or longer than 400 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    blank, long = F.length(T.py_strip("line")) == 0, F.length("line") > 400
    return records.reject_baskets(d, "doc_id", blank | long, F.when(blank, "blank line").otherwise("long line"))


BASKETS = f"""
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
fl AS (SELECT doc_id, line, {S.strip('line')} = '' AS blank, length(line) > 400 AS long FROM ln)
"""


@register("baskets_kept", f"""WITH {BASKETS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(length(line)) AS BIGINT) AS n_chars
    FROM fl GROUP BY doc_id HAVING NOT bool_or(blank OR long)""")
def baskets_kept(spark, sf_dir):
    """The samples of whole good baskets."""
    return baskets(spark, sf_dir)[0].groupBy("doc_id").agg(F.count("*").alias("n_samples"), F.sum(F.length("line")).alias("n_chars"))


@register("baskets_rejected", f"""WITH {BASKETS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_bad, min(CASE WHEN blank THEN 'blank line' ELSE 'long line' END) AS reason,
    'reject_baskets' AS operator FROM fl WHERE blank OR long GROUP BY doc_id""")
def baskets_rejected(spark, sf_dir):
    """The quarantine of rejected baskets."""
    return baskets(spark, sf_dir)[1]


SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
VECTOR = ", ".join(f"({S.seeded_hash(42 + k, 'word')} % 1000) / 1000.0::DOUBLE" for k in range(3))


@register(
    "vocabulary_vectors",
    f"""
    WITH w AS (SELECT unnest({S.word_tokens('text')}) AS word FROM documents),
    v AS (SELECT word, count(*) AS n FROM w GROUP BY word UNION ALL SELECT unnest({SPECIALS}), 0),
    kept AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS idx FROM v WHERE n >= 5 OR word IN (SELECT unnest({SPECIALS}))),
    vec AS (SELECT word, [{VECTOR}] AS v FROM v WHERE n > 0 AND {S.seeded_hash(41, 'word')} % 3 <> 0),
    mean AS (SELECT [avg(v[1]), avg(v[2]), avg(v[3])] AS m FROM vec)
    SELECT word, CAST(n AS BIGINT) AS n, CAST(idx AS BIGINT) AS idx, list_transform(CASE WHEN v IS NULL OR word IN (SELECT unnest({SPECIALS})) THEN m ELSE v END,
      lambda x: round(x, {R}) + 0.0) AS vec
    FROM kept LEFT JOIN vec USING (word) CROSS JOIN mean""",
)
def vocabulary_vectors(spark, sf_dir):
    """The trimmed, re-indexed vocabulary of all documents with word vectors; special tokens and words without one have the mean."""
    d = table(spark, sf_dir, "documents").select(T.word_tokens(F.col("text")).alias("t"))
    path = folder(spark, "vocabulary")
    corpus.vocabulary(d, "t").write.parquet(path)  # read four times below: texts are cut once
    counted = spark.read.schema("word string, n long").parquet(path)
    vectors = counted.filter(seeded_hash(41, "word") % 3 != 0).select("word", F.array(*[(seeded_hash(42 + k, "word") % 1000) / 1000.0 for k in range(3)]).alias("vec"))
    specials = spark.createDataFrame([(s, 0) for s in SPECIALS], "word string, n long")
    vocab = corpus.trim_vocabulary(counted.select("word", F.col("n").cast("long").alias("n")).unionByName(specials), 5, SPECIALS)
    out = V.vocab_vectors(vocab, vectors)
    return out.select("word", "n", F.col("index").cast("long").alias("idx"), F.transform("vec", lambda x: F.round(x, R) + 0.0).alias("vec"))


FOLDS = 7


@register("fold_ensemble_votes")
def fold_ensemble_votes(spark, sf_dir):
    """F4 (no SQL: fitted models): every fold's model votes on the documents of the held-out part, whether a text is English."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text", (F.col("lang") == "en").cast("int").alias("label"))
    held = seeded_hash(51, "id") % 5 == 0
    train, test = d.filter(~held).dropna(subset=["label"]), d.filter(held)
    folds = kfold(train.select("id"), "id", seed=3, k=FOLDS).select("id", "fold")
    votes = score.train_fold_ensemble(train, test.select("id", "text"), folds, n_folds=FOLDS, num_features=1 << 12)
    return ensemble.sentence_majority(votes, "id")


@register(
    "choose_passage_rows",
    f"""
    WITH r AS (SELECT l_orderkey AS qid, l_partkey, l_returnflag = 'R' AS pos, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R'
                 ORDER BY {S.seeded_hash(5, 'l_orderkey', 'l_linenumber', 'l_partkey')}, l_linenumber, l_partkey) AS r FROM lineitem),
    c AS (SELECT qid, list(CAST(l_partkey AS VARCHAR) ORDER BY r) FILTER (pos AND r <= 1) AS p, list(CAST(l_partkey AS VARCHAR) ORDER BY r) FILTER (NOT pos AND r <= 2) AS n
          FROM r GROUP BY qid)
    SELECT qid, array_to_string(list_concat(coalesce(p, []), list_transform(range(1 - len(coalesce(p, []))), lambda x: '')), '|') || '#' ||
                array_to_string(list_concat(coalesce(n, []), list_transform(range(2 - len(coalesce(n, []))), lambda x: '')), '|') AS chosen FROM c""",
)
def choose_passage_rows(spark, sf_dir):
    """L17 on rows: a query's passages never meet whole."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    passage = F.struct(F.lit("").alias("title"), F.lit("").alias("text"), F.col("l_partkey").cast("string").alias("passage_id"))
    order = F.struct(seeded_hash(5, "l_orderkey", "l_linenumber", "l_partkey").alias("h"), "l_linenumber", "l_partkey")
    c = records.choose_passage_rows(li, "qid", passage, F.col("l_returnflag") == "R", order, 1, 2)
    ids = F.transform("passages", lambda p: p["passage_id"])
    return c.select("qid", F.concat(F.array_join(F.slice(ids, 1, 1), "|"), F.lit("#"), F.array_join(F.slice(ids, 2, 2), "|")).alias("chosen"))


@register(
    "nested_kfold_stratified",
    f"""
    WITH h AS (SELECT *, {S.seeded_hash(7, 'doc_id')} AS hh FROM labels),
    sz AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
    st AS (SELECT quality, coalesce(sum(n) OVER (ORDER BY quality NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM sz),
    o AS (SELECT h.*, (s + row_number() OVER (PARTITION BY h.quality ORDER BY hh, doc_id) - 1) % 3 AS f FROM h JOIN st ON h.quality = st.quality),
    x AS (SELECT o.*, t.outer_fold FROM o, (SELECT unnest([0, 1, 2]) AS outer_fold) t)
    SELECT doc_id, quality, toxic, CAST(outer_fold AS INTEGER) AS outer_fold, CAST(CASE WHEN f = outer_fold THEN -1
             ELSE (row_number() OVER (PARTITION BY outer_fold, quality, f = outer_fold ORDER BY hh, doc_id) - 1) % 4 END AS INTEGER) AS inner_fold FROM x""",
)
def nested_kfold_stratified(spark, sf_dir):
    """L9, stratified."""
    from quire.operators.splits import nested_kfold

    return nested_kfold(table(spark, sf_dir, "labels"), "doc_id", 7, 3, 4, label="quality").select("doc_id", "quality", "toxic", "outer_fold", "inner_fold")


@register("kmeans_nearest", "SELECT vec_id, true AS nearest FROM embeddings")
def kmeans_nearest(spark, sf_dir):
    """A13 by its invariant: every vector is with its nearest centre."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    assigned, centres, _ = V.kmeans_centres(e, "v", k=10, seed=1)
    every = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])  # k x d numbers
    distances = F.transform(every, lambda m: F.aggregate(F.zip_with("v", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return assigned.select("vec_id", L.let(distances, lambda d: F.get(d, F.col("cluster")) <= F.array_min(d) + 1e-9).alias("nearest"))


@register("pca_removed_direction", "SELECT vec_id, true AS along_one_direction, true AS shorter FROM embeddings")
def pca_removed_direction(spark, sf_dir):
    """A12 by its invariants: what is taken from every vector lies along one direction, and no vector grows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    r = V.remove_top_components(e, "v", k=1).withColumn("d", F.zip_with("v", "reduced", lambda a, b: a - b))
    longest = r.agg(F.max_by("d", V.norm("d")).alias("u"))  # one row
    x = V.scalar_join(r, F.broadcast(longest))
    along = F.abs(F.abs(V.dot("d", "u")) - V.norm("d") * V.norm("u")) <= 1e-9 + 1e-6 * V.norm("u") * V.norm("u")
    return x.select("vec_id", along.alias("along_one_direction"), (V.norm("reduced") <= V.norm("v") + 1e-9).alias("shorter"))


@register(
    "s3e_invariants",
    f"""SELECT conv_id * 1000 + turn AS sid, len({S.ws_tokens('text')}) > 0 AS known, CASE WHEN len({S.ws_tokens('text')}) > 0 THEN 64 + 10 END AS n_dims,
        CASE WHEN len({S.ws_tokens('text')}) > 0 THEN true END AS unit FROM conversations""",
)
def s3e_invariants(spark, sf_dir):
    """Q25, Q26 by their invariants: an embedding has the vectors' dimensions and those of the upper triangle of 4 x 4 clusters, whose part has length one."""
    from quire.catalog.vectors_q import s3e_sentence_embeddings

    e = s3e_sentence_embeddings(spark, sf_dir)
    tail = F.slice("embedding", F.size("embedding") - 9, F.lit(10))
    length = F.sqrt(F.aggregate(tail, F.lit(0.0), lambda a, x: a + x * x))
    return e.select("sid", F.col("embedding").isNotNull().alias("known"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n_dims"),
                    (F.abs(length - 1) < 1e-4).alias("unit"))
