"""Near-duplicate classes: DartMinHash sketches, banded joining, exact verification.

1. Every whole text becomes the set (or multiset) of its five-word shingles and a sketch of 84 darts, in 21
   bands of 4: a pair of similarity 0.8 misses all bands once in 60,000 times. Texts with the same words
   are one node from here on, so copies cost nothing.
2. Nodes that share a band key form a bucket; every link between different texts lies in one. The smallest id is
   passed on through the buckets twice, and nodes with the same id then are a neighbourhood: a guess that
   brings most links together.
3. A neighbourhood is dealt into blocks of bounded size, each joined by the neighbourhood's hub (its most
   popular node). All pairs of a block are compared exactly inside one task, and only a star for
   each class leaves it.
4. Links may still join classes of different blocks. Buckets that reach over several blocks and hold nodes of
   different classes are compared exactly too: nodes outside the bucket's largest class against
   all its nodes, again in blocks of bounded size. What steps 2 and 3 guess badly thus costs time, not links.

Classes are the connected components of the links. No bucket or neighbourhood is capped, and none is gathered
whole in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import tidy
from quire.llm.common import among, keep_rows, stored, text_or_empty
from quire.llm.components import components
from quire.llm.dartminhash import bands, sketches, weight_regions
from quire.llm.wordhash import shingles, word_groups

WIDTH = 5
SIMILARITY = 0.8
COORDINATES = 84
BAND_ROWS = 4
BLOCK_SHINGLES = 200_000


def _weighted(s: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, their owners and counts."""
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])))) if len(s) else np.zeros(0, np.int64)
    return s[first], owner[first], np.diff(np.append(first, len(s)))


def sketch_documents(docs: DataFrame, width: int = WIDTH, coordinates: int = COORDINATES, band_rows: int = BAND_ROWS,
                     weighting: str = "set", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, node, n_shingles, bands`` of each row. ``node`` names the word sequence (null
    without words); ``weighting`` is ``set`` (every shingle weighs 1) or ``count``."""
    source = docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"),
                         F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            nodes, counts, keys = [], [], []
            for _, rows, h, offsets in word_groups(batch.column(2)):
                s, at = shingles(h, offsets, width)
                owner = np.repeat(np.arange(rows), np.diff(at))
                covered = None
                if weighting == "count":
                    s, owner, covered = weight_regions(*(lambda x, o, c: (x, c.astype(float), o))(*_weighted(s, owner)))
                key = bands(sketches(s, owner, rows, coordinates, covered), band_rows).view(np.int64)
                for r in range(rows):
                    a, b = offsets[r], offsets[r + 1]
                    nodes.append(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                    keys.append(key[r] if b > a else None)
                counts.append(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()),
                 pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "node", "n_shingles", "bands"])

    id_type = source.schema[0].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"doc_id {id_type}, text_key long, node binary, n_shingles long, bands array<long>")


def shingle_sets(texts, width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, rows, h, offsets in word_groups(texts):
        s, at = shingles(h, offsets, width)
        out += [np.unique(s[at[r]:at[r + 1]]) for r in range(rows)]
    return out


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float):
    """(i, js) for each left set with the right sets whose Jaccard similarity reaches the bound, by posting lists."""
    n = len(right)
    sizes = np.array([len(x) for x in right], np.int64)
    values = np.concatenate(right) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for i, x in enumerate(left):
        a, b = np.searchsorted(values, x), np.searchsorted(values, x, side="right")
        counts = b - a
        total = int(counts.sum())
        if not total:
            continue
        at = np.repeat(a - (np.cumsum(counts) - counts), counts) + np.arange(total)
        common = np.bincount(owner[at], minlength=n)
        either = len(x) + sizes - common
        yield i, np.flatnonzero((common > 0) & (common >= similarity * either - 1e-9))


class Forest:
    """Union-find over numbered items."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)

    def stars(self, names: list[int], hub: int | None = None) -> list[tuple[int, int]]:
        """(name, centre) where they differ; the centre of a tree is ``hub`` if the tree has it, else its smallest name."""
        centre: dict[int, int] = {}
        for i, name in enumerate(names):
            r = self.root(i)
            known = centre.get(r, name)
            centre[r] = hub if hub in (name, known) else min(name, known)
        return sorted({(name, centre[self.root(i)]) for i, name in enumerate(names)} - {(x, x) for x in names})


def _by_key(batches, n_keys: int):
    """Tables of adjacent rows that share the first ``n_keys`` columns, across batches."""
    held, key = [], None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        keys = list(zip(*(t.column(i).to_pylist() for i in range(n_keys)), strict=True))
        a = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[a]:
                if held and keys[a] != key:
                    yield pa.concat_tables(held)
                    held = []
                held.append(t.slice(a, i - a))
                key, a = keys[a], i
    if held:
        yield pa.concat_tables(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())],
                                      names=["a", "b"])


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH,
                           coordinates: int = COORDINATES, band_rows: int = BAND_ROWS, weighting: str = "set",
                           block_shingles: int = BLOCK_SHINGLES, text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, kept, text_key`` (a hash of the text).

    ``class_id`` is the smallest id of the class, whose row stays (if it has several texts, one of them); links are exact Jaccard similarities of
    shingle sets. A text of fewer than five words has one shingle of all its words; null, empty and
    wordless texts are similar to nothing and form classes of their own; a null id is never the
    class id unless all are null; rows repeated with the same id and text count each in ``class_size``
    and are marked alike; a very long text is compared whole; an empty table gives an empty result; other columns are ignored."""
    sketch = stored(sketch_documents(docs, width, coordinates, band_rows, weighting, text_col), "op6-sketch")
    nodes = sketch.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("rep"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "op6-nodes")
    banded = nodes.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("size")).filter("size > 1")
    buckets = stored(buckets, "op6-buckets")  # a table of its own, so that a skewed join may split a bucket with a third of the rows
    members = stored(banded.join(buckets, "key"), "op6-members")

    # twice: an item takes the smallest id that its buckets know, a bucket the smallest that its items know
    first = members.groupBy("id").agg(F.min("low").alias("area"), F.sum("size").alias("popular"))
    known = members.join(first, "id").groupBy("key").agg(F.min("area").alias("area"))
    near = members.select("key", "id").join(known, "key").groupBy("id").agg(F.min("area").alias("area"))
    near = near.join(first.select("id", "popular"), "id").join(nodes.select("id", "rep", "n"), "id")
    near = stored(near, "op6-area")
    areas = near.groupBy("area").agg(
        F.max_by("id", F.struct("popular", "id")).alias("hub"),
        F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))

    texts = docs.select("doc_id", F.col(text_col).cast("string").alias("text")).withColumn(
        "text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = among(texts, near.select(F.col("rep.text_key").alias("text_key")), "text_key").filter("maybe").drop("maybe")
    wanted = near.select("id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"))
    node_texts = texts.join(wanted, (texts["text_key"] == wanted["rep_key"]) & texts["doc_id"].eqNullSafe(wanted["rep_id"]))
    node_texts = stored(node_texts.dropDuplicates(["id"]).select("id", "text"), "op6-texts")

    own_block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    home = near.join(areas, "area").select("id", "n", "area", "hub", "blocks", own_block.alias("block"))
    placed = home.select("id", "area", "hub", F.explode(F.when(
        F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("block"))
    blocks = (node_texts.join(placed, "id").select("area", "block", "id", "hub", "text")
              .repartition("area", "block").sortWithinPartitions("area", "block"))

    def compare_block(batches):
        for t in _by_key(batches, 2):
            names, sets = t["id"].to_pylist(), shingle_sets(t["text"].combine_chunks(), width)
            forest = Forest(len(names))
            for i, js in similar_pairs(sets, sets, similarity):
                for j in js.tolist():
                    forest.join(i, j)
            if stars := forest.stars(names, t["hub"][0].as_py()):
                yield _edges(stars)

    links = stored(blocks.mapInArrow(tidy(compare_block), "a long, b long"), "op6-links")
    classes = components(links, "op6-class")  # the hub is the centre in each of its blocks, so these are stars already
    # links across blocks join classes: the components of the classes
    joined = components(_across(members, home, classes, node_texts, similarity, width, block_shingles), "op6-joined")
    classes = classes.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("wider")), "comp", "left").select(
        "node", F.coalesce("wider", "comp").alias("comp")).unionByName(
        joined.join(classes, "node", "left_anti").select("node", "comp"))

    of_node = nodes.select("node", "id").join(classes.withColumnRenamed("node", "id"), "id", "left").select(
        "node", F.coalesce("comp", "id").alias("comp"))
    named = sketch.select("doc_id", "text_key", "node").join(of_node, "node", "left").select("doc_id", "text_key", "comp")
    worded = named.filter("comp is not null")
    sizes = worded.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"),
                                       F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"))
    out = worded.join(stored(sizes, "op6-sizes"), "comp").select(
        "doc_id", "class_id", "class_size",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"), "text_key")
    alone = named.filter("comp is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
                                                F.lit(True).alias("kept"), "text_key")
    return out.unionByName(alone)


def _across(members, home, classes, node_texts, similarity, width, block_shingles) -> DataFrame:
    """Links between classes (pairs of class numbers), looked for in the buckets over several blocks that hold several classes."""
    inside = members.select("key", "id").join(home.select("id", "n", "area", "block"), "id")
    inside = inside.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    per_class = inside.groupBy("key", "comp").agg(
        F.count("*").alias("m"), F.sum("n").alias("n"), F.min(F.struct("area", "block")).alias("low"), F.max(F.struct("area", "block")).alias("high"))
    per_key = per_class.groupBy("key").agg(
        F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("n").alias("all"), F.max_by("n", F.struct("m", "comp")).alias("main_n"),
        F.count("*").alias("classes"), F.min("low").alias("low"), F.max("high").alias("high")).filter("classes > 1 and low != high")
    per_key = per_key.select("key", "main", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("main_n")) / block_shingles)).cast("int").alias("lefts"),
                             F.ceil(F.col("all") / block_shingles).cast("int").alias("rights"))
    inside = inside.select("key", "id", "comp")
    rows = stored(inside.join(per_key, "key"), "op6-open")
    spread = F.xxhash64(F.col("id"), F.lit(1))
    left = rows.filter("comp != main").select(
        "key", F.pmod(spread, F.col("lefts")).cast("int").alias("l"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("r"),
        "id", "comp", F.lit(True).alias("outside"))
    right = rows.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("l"), F.pmod(spread, F.col("rights")).cast("int").alias("r"),
        "id", "comp", F.lit(False).alias("outside"))
    blocks = left.unionByName(right).join(node_texts, "id").select("key", "l", "r", "id", "comp", "outside", "text")
    blocks = blocks.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")

    def compare(batches):
        for t in _by_key(batches, 3):
            comps, outside = t["comp"].to_pylist(), t["outside"].to_pylist()
            sets = shingle_sets(t["text"].combine_chunks(), width)
            lefts, rights = [i for i, o in enumerate(outside) if o], [i for i, o in enumerate(outside) if not o]
            forest, first = Forest(len(comps)), {}
            for i, c in enumerate(comps):
                forest.join(first.setdefault(c, i), i)
            for a, js in similar_pairs([sets[i] for i in lefts], [sets[j] for j in rights], similarity):
                for b in js.tolist():
                    forest.join(lefts[a], rights[b])
            if stars := forest.stars(comps):
                yield _edges(stars)

    return blocks.mapInArrow(tidy(compare), "a long, b long")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns; wordless rows, which are similar to nothing,
    all stay."""
    classes = stored(near_duplicate_classes(docs, similarity), "op6-kept")
    judged = classes.select("doc_id", F.col("text_key").alias("key"), "kept", (F.col("class_size") > 1).alias("once"))
    return keep_rows(docs, F.xxhash64(text_or_empty()), judged)
