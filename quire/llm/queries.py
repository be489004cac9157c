"""Registered queries of the training-data operators and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quire.llm import decontam, exact_dedup, langid, licenses, near_dedup, packing, pii, prefix_trie, quality, repair, suffix_dedup, toxicity, warc
from quire.llm.common import documents
from quire.llm.conversation_sql import ORACLES as SHARED_SQL
from quire.llm.tokenizer_files import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("spans")


@query
def op1_pii(spark, sf_dir):
    return pii.personal_data(documents(spark, sf_dir))


@query
def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


@query
def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query
def op6_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicate_classes(documents(spark, sf_dir)).drop("text_key")


@query
def op7_decontamination(spark, sf_dir):
    marked = decontam.mark_contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op8_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op9_license_scan(spark, sf_dir):
    return licenses.scan_licenses(documents(spark, sf_dir)).drop("notices")


@query
def op10_language_id(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


@query
def op11_conversation_repair(spark, sf_dir):
    return repair.repair_conversations(documents(spark, sf_dir, "conversations"))


@query
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(documents(spark, sf_dir, "conversations"))


@query
def op13_warc(spark, sf_dir):
    return warc.archive_pages(documents(spark, sf_dir, "pages")).drop("url")


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op5_exact_dedup"] = f"""
with d as (select doc_id, {AZ} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on d.t = g.t
"""

WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op7_decontamination"] = f"""
with item as (select item_id, {WORDS.format(AZ)} as w from benchmark),
win as (
  select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) as i from item where len(w) > 0)),
doc as (select doc_id, {WORDS.format(AZ)} as w from documents),
place as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i
        from doc cross join (select distinct k from win) where len(w) >= k)),
found as (select p.doc_id, p.i, p.k, win.item_id from place p join win on p.g = win.g and p.k = win.k),
hit as (select doc_id, count(distinct pos) as n_hit
        from (select doc_id, unnest(generate_series(i, i + k - 1)) as pos from found) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
        from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(coalesce(len(d.w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from doc d left join hit using (doc_id) left join its using (doc_id)
"""

ORACLES["op6_minhash_near_dedup"] = f"""
with recursive doc as materialized (select doc_id, {WORDS.format(AZ)} as w from documents),
sh as materialized (
  select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from doc where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
link as materialized (
  select a.doc_id as x, b.doc_id as y from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 5 * count(*) >= 4 * (na.n + nb.n - count(*))),
reach(x, y) as (select x, y from link union select r.x, l.y from reach r join link l on r.y = l.x),
c as (select d.doc_id, least(d.doc_id, coalesce(min(r.y), d.doc_id)) as class_id
      from documents d left join reach r on r.x = d.doc_id group by d.doc_id)
select doc_id, class_id, count(*) over (partition by class_id) as class_size, doc_id = class_id as kept from c
"""

ORACLES.update(SHARED_SQL)
