"""Question answering: passages, span bookkeeping, answer aggregation and SQuAD-style
evaluation (T12, T13, Q1, Q3, Q4, Q10-Q13, U5, U6, J9, W2-W4, M14-M17, M19-M23).

Questions, passages and candidates are rows; the per-question and per-document reductions are
``groupBy`` aggregates (map-side partial) or windows partitioned by question/document. The
threshold searches (W2, W3) are global prefix sums (``plans.ordered``) over questions ordered by
no-answer probability, not single-partition windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.labels import let
from quire.operators.metrics import scalar_join
from quire.plans.ordered import prefix_sum


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- text answers (M19) -----------------------------------------------------------------------


def answer_tokens(col) -> Column:
    """``get_tokens``: normalised answer split on whitespace (empty text -> [])."""
    return _tokens_of(T.normalize_answer(col))


def _tokens_of(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda t: t != "")


def bag_f1(gold_toks: Column, pred_toks: Column) -> Column:
    """Token-bag F1: overlap = sum over distinct tokens of min(count in gold, count in pred);
    one side empty -> 1 if both empty else 0."""
    def score(gold, pred, same):
        ng, np_ = F.size(gold), F.size(pred)
        p, r = same / np_, same / ng
        return (F.when((ng == 0) | (np_ == 0), (ng == np_).cast("double"))
                .when(same == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))

    def overlap(gold, pred):
        return F.aggregate(
            F.array_distinct(pred), F.lit(0),
            lambda acc, t: acc + F.least(F.size(F.filter(pred, lambda x: x == t)), F.size(F.filter(gold, lambda x: x == t))))

    # both token arrays are bound once; the lambdas would tokenize again for every element
    return let(gold_toks, lambda g: let(pred_toks, lambda p: let(overlap(g, p), lambda same: score(g, p, same))))


def text_scores(df: DataFrame, answers: str, pred: str) -> DataFrame:
    """Per question ``exact`` and ``f1``, max over gold answers. Gold answers that
    normalise to empty are removed; none left -> ``['']``. Adds ``has_ans``."""
    def golds(normalised):
        some = F.filter(normalised, lambda a: a != "")
        return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("")))

    def scores(gold, p):
        ex = F.array_max(F.transform(gold, lambda g: (g == p).cast("double")))
        f1 = let(_tokens_of(p), lambda pt: F.array_max(F.transform(gold, lambda g: bag_f1(_tokens_of(g), pt))))
        return F.struct(ex.alias("exact"), f1.alias("f1"))

    normalised = F.transform(_c(answers), lambda a: T.normalize_answer(a))
    both = let(golds(normalised), lambda gold: let(T.normalize_answer(_c(pred)), lambda p: scores(gold, p)))
    return df.withColumn("__scores", both).withColumn("exact", F.col("__scores.exact")).withColumn(
        "f1", F.col("__scores.f1")).drop("__scores").withColumn("has_ans", F.size(_c(answers)) > 0)


def apply_na_threshold(df: DataFrame, na_prob: str, thresh: float, cols=("exact", "f1")) -> DataFrame:
    """Where ``na_prob > thresh`` the prediction counts as "no answer": score =
    ``not has_ans``."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.when(F.col(na_prob) > thresh, (~F.col("has_ans")).cast("double")).otherwise(F.col(c)))
    return out


def squad_summary(scored: DataFrame) -> DataFrame:
    """M20 blocks in one pass: overall, HasAns and NoAns exact/f1 (x100) and totals."""
    h = F.col("has_ans")
    return scored.agg(
        (100 * F.avg("exact")).alias("exact"), (100 * F.avg("f1")).alias("f1"), F.count(F.lit(1)).alias("total"),
        (100 * F.avg(F.when(h, F.col("exact")))).alias("HasAns_exact"), (100 * F.avg(F.when(h, F.col("f1")))).alias("HasAns_f1"),
        F.count_if(h).alias("HasAns_total"),
        (100 * F.avg(F.when(~h, F.col("exact")))).alias("NoAns_exact"), (100 * F.avg(F.when(~h, F.col("f1")))).alias("NoAns_f1"),
        F.count_if(~h).alias("NoAns_total"),
    )


def best_threshold(scored: DataFrame, score: str, na_prob: str, pred: str, order: str, has_ans_average: bool = False) -> DataFrame:
    """Sweep the no-answer threshold over questions sorted by ``na_prob`` (ties by
    ``order``). Start = number of unanswerable questions, threshold 0.0; each question adds its
    score (answerable), -1 (unanswerable with a non-empty prediction) or 0; the first strict
    maximum wins. Output ``best_<score>`` (x100) and ``best_<score>_thresh``; with ``has_ans_average`` (the second version
    of the search) also ``<score>_has_ans``, the mean score of the answerable questions (not x100)."""
    diff = F.when(F.col("has_ans"), F.col(score)).when(F.length(F.col(pred)) > 0, F.lit(-1.0)).otherwise(F.lit(0.0))
    base = scored.select(F.col(na_prob).alias("p"), F.col(order).alias("o"), diff.alias("d"), F.col("has_ans"))
    cum = prefix_sum(base, ["p", "o"], "d", name="cum")
    tot = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("has_ans")).alias("n_no"),
                   F.avg(F.when(F.col("has_ans"), F.col("d"))).alias("has_avg"))
    best = cum.agg(F.max("cum").alias("mx"), F.min_by("p", F.struct(-F.col("cum"), F.col("p"), F.col("o"))).alias("pt"))
    r = scalar_join(tot, best)
    better = F.col("n_no") + F.col("mx") > F.col("n_no")
    return r.select(
        (100.0 * F.greatest(F.col("n_no").cast("double"), F.col("n_no") + F.col("mx")) / F.col("n")).alias(f"best_{score}"),
        F.when(better, F.col("pt")).otherwise(F.lit(0.0)).alias(f"best_{score}_thresh"),
        *([F.col("has_avg").alias(f"{score}_has_ans")] if has_ans_average else []),
    )


def average_precision(scored: DataFrame, scores: dict, na_prob: str) -> DataFrame:
    """Precision-recall over the no-answer probability; a threshold exists only at the
    end of a tie group, so questions are first aggregated per distinct probability and the
    prefix sums run over distinct values (one pass for all score columns). ``scores`` maps an
    output name to a per-question score column; AP x100, NULL when nothing is answerable."""
    from quire.plans.ordered import prefix_sums

    names = list(scores)
    per_v = scored.groupBy(F.col(na_prob).alias("v")).agg(
        F.count(F.lit(1)).alias("c"),
        *[F.sum(F.when(F.col("has_ans"), scores[n]).otherwise(0.0)).alias(f"tp_{i}") for i, n in enumerate(names)])
    cum = prefix_sums(per_v, ["v"], {"cc": "c", **{f"ctp_{i}": f"tp_{i}" for i in range(len(names))}})
    n_pos = scored.agg(F.count_if(F.col("has_ans")).alias("npos"))
    ap = cum.agg(*[F.sum(F.col(f"ctp_{i}") / F.col("cc") * F.col(f"tp_{i}")).alias(f"s_{i}") for i in range(len(names))])
    return scalar_join(ap, n_pos).select(
        *[F.when(F.col("npos") > 0, 100.0 * F.col(f"s_{i}") / F.col("npos")).alias(n) for i, n in enumerate(names)])


def na_prob_histogram(scored: DataFrame, na_prob: str, bins: int = 20) -> DataFrame:
    """Normalised histogram (share of questions) of the no-answer probability on [0, 1],
    per answerability; empty bins 0."""
    b = F.least(F.floor(F.col(na_prob) * bins), F.lit(bins - 1)).cast("int")
    cnt = scored.groupBy("has_ans", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tot = scored.groupBy("has_ans").agg(F.count(F.lit(1)).alias("total"))
    grid = tot.select("has_ans", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(cnt, ["has_ans", "bin"], "left").select(
        "has_ans", "bin", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


# --- spans (M14-M17) ----------------------------------------------------------------------------


def span_f1(ps: Column, pe: Column, ls: Column, le: Column) -> Column:
    """``squad_f1_single``: token overlap F1 of two inclusive spans; if either span is (0,0)-like
    (start+end = 0) only the starts are compared."""
    ov = F.greatest(F.lit(0), F.least(pe, le) - F.greatest(ps, ls) + 1)
    p = ov / (pe - ps + 1)
    r = ov / (le - ls + 1)
    return (
        F.when((ps + pe == 0) | (ls + le == 0), (ps == ls).cast("double"))
        .when(ov == 0, F.lit(0.0))
        .otherwise(2 * p * r / (p + r))
    )


def span_metrics(df: DataFrame, cands: str, labels: str) -> DataFrame:
    """M14-M17 in one pass. ``cands``: ``array<struct<start,end>>`` best first; ``labels``:
    ``array<struct<start,end>>`` (no answer = (-1,-1)). Overall, text-answer and no-answer
    blocks of EM, EM-start, F1 and top-n accuracy."""
    top = F.get(_c(cands), 0)
    em = F.exists(_c(labels), lambda l: (l["start"] == top["start"]) & (l["end"] == top["end"])).cast("double")
    ems = F.exists(_c(labels), lambda l: l["start"] == top["start"]).cast("double")
    f1 = F.array_max(F.transform(_c(labels), lambda l: span_f1(top["start"], top["end"], l["start"], l["end"])))
    topn = F.exists(_c(cands), lambda c: F.exists(_c(labels), lambda l: span_f1(c["start"], c["end"], l["start"], l["end"]) > 0)).cast("double")
    no_ans = F.exists(_c(labels), lambda l: (l["start"] == -1) & (l["end"] == -1))
    x = df.select(em.alias("em"), ems.alias("em_start"), f1.alias("f1"), topn.alias("top_n"), no_ans.alias("na"))

    def block(cond, suffix):
        return [F.coalesce(F.avg(F.when(cond, F.col(m))), F.lit(0.0)).alias(m + suffix) for m in ("em", "em_start", "f1", "top_n")] + [
            F.count_if(cond).alias("total" + suffix)]

    return x.agg(*block(F.lit(True), ""), *block(~F.col("na"), "_text_answer"), *block(F.col("na"), "_no_answer"))


def reduce_labels(labels) -> Column:
    """Distinct answer spans other than the no-answer span (-1, -1); none -> ``[(-1,-1)]``."""
    kept = F.array_distinct(F.filter(_c(labels), lambda l: (l["start"] != -1) | (l["end"] != -1)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))))


def join_gold_pred(gold: DataFrame, pred: DataFrame, qid: str = "qid"):
    """(matched rows, gold ids without a prediction). The missing ids are a report, not
    an error."""
    return gold.join(pred, qid), gold.join(pred, qid, "left_anti").select(qid)


# --- passages and answer aggregation ---------------------------------------------------------------


def passages(docs: DataFrame, id_col: str, text: str, passage_len: int, stride: int) -> DataFrame:
    """Sliding windows over whitespace tokens: passage ``i`` covers tokens
    ``[i*stride, i*stride + passage_len]``; windows continue until the end index reaches the
    token count. ``end_c`` is the stripped length of the text before the first token after the
    window (the reference's rule: one token more than the token slice), or the text length for the
    last windows. Output: ``id, passage_id, start_t, end_t, start_c, end_c, text``."""
    if stride > passage_len:
        raise ValueError("stride must not exceed the passage length (gaps)")
    d = docs.select(F.col(id_col), F.col(text).alias("__t"), T.ws_tokens(F.col(text)).alias("__tok")).withColumn(
        "__off", T.token_offsets_batch(F.col("__t")))
    n = F.size("__off")
    m = F.greatest(F.lit(0), F.ceil((n - passage_len) / stride)).cast("int")
    tt = F.col("__t")

    def one(i):
        st = i * stride
        et = st + passage_len
        start_c = F.coalesce(F.get("__off", st), F.lit(0))
        # len(text[:off[et+1]].strip()) = end of token et - leading whitespace of the text
        stripped_len = F.get("__off", et) + F.length(F.get("__tok", et)) - F.get("__off", 0)
        end_c = F.when(et >= n - 1, F.length(tt)).otherwise(stripped_len)
        return F.struct(i.alias("passage_id"), st.alias("start_t"), et.alias("end_t"), start_c.alias("start_c"),
                        end_c.alias("end_c"), F.substring(tt, start_c + 1, end_c - start_c).alias("text"))

    # passages are built inside the row (no copy of the whole text per exploded row)
    return d.select(F.col(id_col), F.explode(F.transform(F.sequence(F.lit(0), m), one)).alias("__p")).select(
        id_col, "__p.*")


def char_to_token(offsets, c, vectorised: bool = False) -> Column:
    """Q3: index of the token containing character ``c`` = number of offsets <= c, minus one. The
    loop variant gives the last token for a character before the first offset; the vectorised
    variant gives -1 there, and one past the last token's index for a character at or past the last
    offset."""
    off = _c(offsets)
    k = F.size(F.filter(off, lambda o: o <= c)) - 1
    if vectorised:
        last = F.array_max(off)
        return F.when(c >= last, F.array_position(off, last).cast("int")).otherwise(k)
    return F.when(k < 0, F.size(off) - 1).otherwise(k)


def passage_to_doc_span(start: Column, end: Column, passage_start_t: Column) -> Column:
    """Q10: passage-relative token span -> document span; (0,0) (no answer in the passage) -> (-1,-1)."""
    none = (start == 0) & (end == 0)
    return F.struct(F.when(none, -1).otherwise(start + passage_start_t).alias("start"),
                    F.when(none, -1).otherwise(end + passage_start_t).alias("end"))


def aggregate_candidates(cands: DataFrame, doc: str, n_best: int = 5, no_ans_boost: float = 0.0, confidence: str | None = None,
                         no_ans_confidence: str | None = None, rank_by_confidence: bool = False) -> DataFrame:
    """Q11-Q13 (W4): candidates ``(doc, passage_id, start, end, score, no_ans_score)`` from all
    passages of a document -> document answers.

    * Q11 equal spans from different passages are merged keeping the max score (first passage on ties);
    * Q12 ``no_answer_gap = -min(no_ans_score + boost - best_score)`` over the passages (the best candidate of a
      passage may be its no-answer), and a synthetic no-answer candidate whose score is that of the
      document's best SPAN minus the gap;
    * Q13 top ``n_best`` by score, or by confidence (``row_number`` per document -> WindowGroupLimit).
    With ``confidence`` / ``no_ans_confidence`` columns the synthetic candidate's confidence and
    ``no_answer_gap_confidence`` follow the same rule.
    """
    conf = F.col(confidence).cast("double") if confidence else F.lit(None).cast("double")
    na_conf = F.col(no_ans_confidence).cast("double") if no_ans_confidence else F.lit(None).cast("double")
    x = cands.withColumn("__conf", conf).withColumn("__na_conf", na_conf)
    is_span = ~((F.col("start") == -1) & (F.col("end") == -1))
    merged = x.filter(is_span).groupBy(doc, "start", "end").agg(
        F.max_by(F.struct("score", "passage_id", "__conf"), F.struct(F.col("score"), -F.col("passage_id"))).alias("b"))
    merged = merged.select(doc, "start", "end", F.col("b.score").alias("score"), F.col("b.passage_id").alias("passage_id"),
                           F.col("b.__conf").alias("confidence"), F.lit("span").alias("answer_type"))
    per_p = x.groupBy(doc, "passage_id").agg(
        F.max_by(F.struct("score", "__conf"), F.struct(F.col("score"), F.col("__conf"))).alias("best"),
        F.max("no_ans_score").alias("na"), F.max("__na_conf").alias("na_conf"),
        F.max(F.when(is_span, F.col("score"))).alias("span"), F.max(F.when(is_span, F.col("__conf"))).alias("span_conf"))
    gap = per_p.groupBy(doc).agg((-F.min(F.col("na") + no_ans_boost - F.col("best.score"))).alias("no_answer_gap"),
                                 (-F.min(F.col("na_conf") - F.col("best.__conf"))).alias("no_answer_gap_confidence"),
                                 F.max("span").alias("mx"), F.max("span_conf").alias("mx_conf"))
    no_ans = gap.select(doc, F.lit(-1).alias("start"), F.lit(-1).alias("end"), (F.col("mx") - F.col("no_answer_gap")).alias("score"),
                        F.lit(-1).cast("long").alias("passage_id"),
                        (F.col("mx_conf") - F.col("no_answer_gap_confidence")).alias("confidence"), F.lit("no_answer").alias("answer_type"))
    allc = merged.withColumn("passage_id", F.col("passage_id").cast("long")).unionByName(no_ans)
    w = Window.partitionBy(doc).orderBy(F.desc("confidence" if rank_by_confidence else "score"), F.col("start"), F.col("end"))
    gaps = ["no_answer_gap"] + (["no_answer_gap_confidence"] if confidence else [])
    out = allc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_best).join(gap.select(doc, *gaps), doc)
    return out if confidence else out.drop("confidence")


def context_window(text: Column, start_c: Column, end_c: Column, size: int) -> Column:
    """Context window around an answer: the window (at least answer length + 1) is centred on
    the answer's midpoint; a part hanging over one end of the text is added at the other end.
    No answer (0, 0) -> ('', 0, 0)."""
    n = F.length(text)
    alen = end_c - start_c
    sz = F.greatest(F.lit(size), alen + 1)
    mid = F.floor(alen / 2) + start_c
    half = F.floor(sz / 2)
    ws, we = mid - half, mid + half
    over_start = F.greatest(F.lit(0), -ws)
    over_end = F.greatest(F.lit(0), we - n)
    s1 = F.greatest(F.lit(0), ws - over_end).cast("int")
    e1 = F.least(n, we + over_start).cast("int")
    none = (start_c == 0) & (end_c == 0)
    return F.when(none, F.struct(F.lit("").alias("context"), F.lit(0).alias("start"), F.lit(0).alias("end"))).otherwise(
        F.struct(F.substring(text, s1 + 1, e1 - s1).alias("context"), s1.alias("start"), e1.alias("end")))


def span_text(text: Column, offsets: Column, start_t: Column, end_t: Column) -> Column:
    """Token span (end inclusive) -> answer text and char offsets: from the start token's
    offset to the offset of token ``min(end+1, n)`` (or the text end), stripped; blank -> no answer."""
    n = F.size(offsets)
    sc = F.get(offsets, start_t)
    ec = F.when(end_t + 1 < n, F.get(offsets, end_t + 1)).otherwise(F.length(text))
    raw = F.substring(text, sc + 1, ec - sc)
    ans = T.py_strip(raw)
    return F.when(F.length(ans) == 0, F.struct(F.lit("").alias("answer"), F.lit(0).alias("start"), F.lit(0).alias("end"))).otherwise(
        F.struct(ans.alias("answer"), sc.alias("start"), (sc + F.length(ans)).alias("end")))


def join_passage_classifier(cands: DataFrame, cls: DataFrame, doc: str = "doc_id", passage: str = "passage_id") -> DataFrame:
    """QA candidates left-joined with a passage classifier ``(doc, passage, label)``
    where label is ``span``/``yes``/``no``/``no_answer``. A candidate whose passage has no
    classification becomes ``no_answer``; ``yes``/``no`` override the answer type and move the span
    to the supporting-evidence columns."""
    j = cands.join(cls.withColumnRenamed("label", "__cls"), [doc, passage], "left")
    t = F.coalesce(F.col("__cls"), F.lit("no_answer"))
    yn = t.isin("yes", "no")
    return (j.withColumn("answer_type", t)
            .withColumn("support_start", F.when(yn, F.col("start")))
            .withColumn("support_end", F.when(yn, F.col("end")))
            .withColumn("start", F.when(yn | (t == "no_answer"), F.lit(-1)).otherwise(F.col("start")))
            .withColumn("end", F.when(yn | (t == "no_answer"), F.lit(-1)).otherwise(F.col("end")))
            .drop("__cls"))


def answers_to_passage_labels(answers, passage_start_t, passage_end_t, offsets, max_answers: int = 6, doc_text=None,
                              question_len=0, special_start: int = 0, special_mid: int = 0) -> Column:
    """Q4: document-level character answers ``array<struct<answer_start,text>>`` -> passage
    token labels, ``max_answers`` rows padded with (-1, -1).

    Start and end token come from the vectorised Q3, relative to the passage (``passage_end_t`` inclusive) and moved
    behind the question and the special tokens (``special_start + question_len + special_mid``); an
    answer not inside the passage -> (0, 0); no answers at all -> (0, 0) first. More answers than
    ``max_answers`` are an error. With ``doc_text``, an answer inside the passage whose text does not stand at its offsets gives (-100, -100) and ends
    the list."""
    shift = F.lit(special_start) + (F.lit(question_len) if isinstance(question_len, int) else _c(question_len)) + F.lit(special_mid)
    length = passage_end_t - passage_start_t + 1

    def lab(a):
        st = char_to_token(offsets, a["answer_start"], vectorised=True) - passage_start_t
        en = char_to_token(offsets, a["answer_start"] + F.length(a["text"]) - 1, vectorised=True) - passage_start_t
        inside = (st >= 0) & (st < length) & (en >= 0) & (en <= length)
        wrong = F.lit(False)
        if doc_text is not None:
            there = F.substring(_c(doc_text), a["answer_start"] + 1, F.length(a["text"]))
            wrong = (st >= 0) & (en < length) & ((F.instr(_c(doc_text), a["text"]) == 0) | (T.py_strip(there) != T.py_strip(a["text"])))
        return F.struct(F.when(wrong, -100).when(inside, st + shift).otherwise(0).cast("int").alias("start"),
                        F.when(wrong, -100).when(inside, en + shift).otherwise(0).cast("int").alias("end"))

    def padded(labs):
        bad = F.array_position(F.transform(labs, lambda x: x["start"] == -100), True)
        kept = F.when(bad > 0, F.slice(labs, 1, bad.cast("int"))).otherwise(labs)
        pad = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
        return F.concat(kept, F.array_repeat(pad, F.greatest(F.lit(max_answers) - F.size(kept), F.lit(0))))

    none = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    labs = F.when(F.size(_c(answers)) == 0, none).when(F.size(_c(answers)) > max_answers, F.raise_error(F.lit(f"more than {max_answers} answers"))) \
        .otherwise(F.transform(_c(answers), lab))
    return let(labs, padded)


def top_spans_from_logits(df: DataFrame, start_logits: str, end_logits: str, mask: str | None, id_cols, max_answer_length: int = 30,
                          n_best: int = 5) -> DataFrame:
    """Q14: legal (start, end) pairs ``start <= end < start + max_answer_length`` (bounded
    explode, never all pairs), optional token mask, score = start + end logit, the ``n_best`` per
    passage (WindowGroupLimit). Confidence = mean of the softmax probabilities of start and end."""
    id_cols = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    sl, el = F.col(start_logits), F.col(end_logits)
    # log of the sum of exponentials, around the maximum: no overflow for large logits
    def log_sum(v):
        return let(F.array_max(v), lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - m))))

    x = df.select(*id_cols, sl.alias("__s"), el.alias("__e"), log_sum(sl).alias("__zs"), log_sum(el).alias("__ze"),
                  *([F.col(mask).alias("__m")] if mask else []), F.posexplode(sl).alias("start", "__sl"))
    x = x.select("*", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + max_answer_length - 1, F.size("__s") - 1))).alias("end"))
    if mask:
        x = x.filter((F.get("__m", F.col("start")) == 1) & (F.get("__m", F.col("end")) == 1))
    x = x.withColumn("score", F.col("__sl") + F.get("__e", F.col("end"))).withColumn(
        "confidence", (F.exp(F.col("__sl") - F.col("__zs")) + F.exp(F.get("__e", F.col("end")) - F.col("__ze"))) / 2)
    w = Window.partitionBy(*id_cols).orderBy(F.desc("score"), "start", "end")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_best).select(
        *id_cols, "start", "end", "score", "confidence", "rank")
