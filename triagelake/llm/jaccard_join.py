"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Two texts are linked when the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more.

1. Texts of the same words are copies; everything else is done once per text, of
   which the copies are counted.
2. Each of ``TREES`` tries holds a sequence of minimum hashes per class.  Matched
   prefixes start at ``DEEPEST`` and are shortened, a trie at a time, until a
   pair at the threshold meets in some trie with probability ``RECALL``.  Classes
   with the same prefix are a trie node.
3. In a trie node, sketches of ``SKETCH`` further bytes drop chance meetings; what
   is left is a forest of edges, as many as members.  Its components hold every
   pair that can be linked.
4. Within a component all pairs are compared exactly on their shingle sets.  A
   component is cut into blocks and every pair of blocks is a cell, so a task
   holds two blocks however large the component; a cell gives each member its
   number of links, never the pairs.

No candidate is capped or dropped.  Shingle sets are sets of 64-bit hashes.

Defined results: a text of one to four words has one shingle, all of its words;
texts without a word (empty, white space) are one class without links to others;
a null text is a class of its own for every row; repeated rows are members of
their class; of documents with a null ``doc_id``, class and copy ids come from
the other members, or are null; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.columns import passed, whole_row
from triagelake.llm.components import connected_components
from triagelake.llm.text_arrays import (
    _BASE, _power_table, chunks, mix, row_sums, shingle_hashes, utf8, word_hashes,
)
from triagelake.llm.workers import prepare
from triagelake.session import scratch_path

WIDTH = 5
NUMERATOR, DENOMINATOR = 4, 5  # similarity of 0.8
TREES, DEEPEST, RECALL = 40, 10, 0.9999
SKETCH, SKETCH_MATCHES = 64, 35
NODE_BLOCK = 4096
CELL_BLOCK = 128
CELL_SHINGLES = 1 << 20
SIGNATURE = (
    "doc_id bigint, text_hash bigint, node bigint, shingles int, prefixes array<bigint>, "
    "sketch binary"
)


def depths(
    similarity: float = NUMERATOR / DENOMINATOR,
    recall: float = RECALL,
    trees: int = TREES,
    deepest: int = DEEPEST,
) -> list[int]:
    """Prefix length of each trie: shortened one trie at a time until ``recall`` is met."""
    found = [deepest] * trees
    while True:
        missed = np.prod([1 - similarity**d for d in found])
        longest = max(found)
        if 1 - missed >= recall or longest == 1:
            return found
        found[found.index(longest)] -= 1


def _hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """(what to xor, odd factor) per hash function, from a fixed rule."""
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE))
    return (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)


def _nodes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 63-bit hash of each row's word sequence."""
    counts = np.diff(first)
    places = np.arange(len(words)) - np.repeat(first[:-1], counts)
    powers = _power_table(_BASE, int(counts.max(initial=0)) + 1)
    sums = row_sums(words * powers[places], first)
    return (mix(sums + counts.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, hash of its words, number of shingles, trie prefixes, sketch."""
    prepare(docs.sparkSession)
    lengths = depths()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = max(sum(lengths), SKETCH)
        flips, factors = _hash_functions(total)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                words, first = word_hashes(raw, offsets[a : b + 1])
                sets, at = shingle_hashes(words, first, WIDTH)
                full = np.flatnonzero(np.diff(at))
                low = (sets >> np.uint64(32)).astype(np.uint32)
                minima = np.zeros((total, len(full)), np.uint32)
                if len(full):
                    work = np.empty_like(low)
                    for k in range(total):
                        np.bitwise_xor(low, flips[k], out=work)
                        np.multiply(work, factors[k], out=work)
                        np.minimum.reduceat(work, at[:-1][full], out=minima[k])
                prefixes, k = np.empty((len(full), len(lengths)), np.int64), 0
                for tree, depth in enumerate(lengths):
                    key = np.full(len(full), tree + 1, np.uint64)
                    for _ in range(depth):
                        key = mix(key * np.uint64(_BASE) + minima[k])
                        k += 1
                    prefixes[:, tree] = key.view(np.int64)
                sketch = np.ascontiguousarray((minima[:SKETCH] >> np.uint32(7)).astype(np.uint8).T)
                held = np.zeros(b - a, np.int64)
                held[full] = len(lengths)
                marks = np.zeros(b - a, object)
                marks[:] = b""
                marks[full] = [row.tobytes() for row in sketch]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(_nodes(words, first), pa.int64(), mask=null[a:b]),
                        pa.array(np.diff(at).astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32)),
                            pa.array(prefixes.reshape(-1)),
                        ),
                        pa.array(marks, pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "node", "shingles", "prefixes", "sketch"],
                )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    ).mapInArrow(sign, SIGNATURE)


def _cells(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Deal members of each ``key`` into blocks; a row per member and pair of blocks."""
    blocks = F.greatest(blocks.cast("int"), F.lit(1))
    dealt = rows.withColumn("_blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("node", key), F.col("_blocks")).cast("int")
    )
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return other.withColumn("low", F.least("block", "_other")).withColumn(
        "high", F.greatest("block", "_other")
    ).drop("_blocks", "_other")


def _by_cell(rows: DataFrame, key: str) -> DataFrame:
    """Each cell whole in one partition, its rows together."""
    cell = [key, "low", "high"]
    return rows.select(*cell, *[c for c in rows.columns if c not in cell]).repartition(
        *cell
    ).sortWithinPartitions(*cell, "node")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a cell ends, from rows sorted by their first three columns."""
    held: list[pa.RecordBatch] = []

    def cell(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in range(3))

    for batch in batches:
        if not batch.num_rows:
            continue
        last = cell(batch, batch.num_rows - 1)
        if held and cell(held[-1], held[-1].num_rows - 1) == last:
            held.append(batch)
            continue
        columns = [batch.column(k).to_numpy() for k in range(3)]
        same = np.logical_and.reduce([c == v for c, v in zip(columns, last, strict=True)])
        start = int(same.argmax())
        if start or held:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _cell_ranges(table: pa.Table) -> Iterator[tuple[int, int]]:
    """Row ranges of the cells in a table of whole cells."""
    if not table.num_rows:
        return
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in range(3):
        column = table.column(k).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(change)
    yield from zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True)


def _sketch_forest(sketches: np.ndarray) -> np.ndarray:
    """For each row the first row of its component, rows being joined by like sketches."""
    root = np.arange(len(sketches))
    open_ = np.ones(len(sketches), bool)
    for start in range(len(sketches)):
        if not open_[start]:
            continue
        open_[start] = False
        queue = [start]
        while queue:
            row = queue.pop()
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            near = rest[(sketches[rest] == sketches[row]).sum(axis=1) >= SKETCH_MATCHES]
            open_[near] = False
            root[near] = start
            queue.extend(near.tolist())
    return root


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(a, b): a forest over classes that share a trie node and have like sketches."""
    prefixes = classes.select("node", F.explode("prefixes").alias("prefix"))
    shared = prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("members")).filter(
        F.col("members") > 1
    )
    members = prefixes.join(shared, "prefix").join(classes.select("node", "sketch"), "node")
    cells = _cells(members, "prefix", F.ceil(F.col("members") / NODE_BLOCK)).select(
        "prefix", "low", "high", "node", "sketch"
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            node = table.column(3).to_numpy()
            raw = table.column(4).combine_chunks()
            raw = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, SKETCH)
            root = np.arange(table.num_rows)
            for a, b in _cell_ranges(table):
                root[a:b] = a + _sketch_forest(raw[a:b])
            some = root != np.arange(len(root))
            yield pa.record_batch(
                [pa.array(node[some]), pa.array(node[root[some]])], names=["a", "b"]
            )

    return _by_cell(cells, "prefix").mapInArrow(join, "a bigint, b bigint").distinct()


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets of distinct hashes."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, member = every[order], member[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    member, number = member[shared], number[shared]
    counts = np.zeros((len(sets), len(sets)), np.float64)
    if not len(number):
        return counts
    number = np.unique(number, return_inverse=True)[1]
    step = 8192
    for first in range(0, int(number[-1]) + 1, step):
        a, b = np.searchsorted(number, (first, first + step))
        dense = np.zeros((len(sets), step), np.float32)
        dense[member[a:b], number[a:b] - first] = 1
        counts += dense @ dense.T
    return counts


def _verify_cell(
    node: np.ndarray, block: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], same: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Per member: documents it is linked to in the other block, and its local root."""
    size = np.array([len(s) for s in sets], np.float64)
    common = _intersections(sets)
    union = size[:, None] + size[None, :] - common
    linked = (DENOMINATOR * common >= NUMERATOR * union) & (common > 0)
    linked &= node[:, None] != node[None, :]
    if not same:
        linked &= block[:, None] != block[None, :]
    links = (linked * copies[None, :]).sum(axis=1)
    root = np.arange(len(node))
    while True:  # the smallest row within reach, until it settles
        reach = np.where(linked, root[None, :], len(node)).min(axis=1, initial=len(node))
        reach = np.minimum(root, reach)
        reach = reach[reach]
        if (reach == root).all():
            return links, root
        root = reach


def verified(docs: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """(node, links, root): exact links of each class, a row per cell it is in."""
    members = components.join(
        classes.select("node", "doc_id", "text_hash", "copies", "shingles"), "node"
    )
    sizes = members.groupBy("root").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("shingles").alias("_s")
    )
    blocks = F.greatest(F.ceil(F.col("_n") / CELL_BLOCK), F.ceil(F.col("_s") / CELL_SHINGLES))
    cells = _cells(members.join(sizes, "root"), "root", blocks).select(
        "root", "low", "high", "node", "block", "copies", F.col("doc_id").alias("_id"), "text_hash"
    )
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("_hash"),
    ).filter(F.col("text").isNotNull())
    # by the hash as well: rows without an id, or of one id, do not all meet
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("text_hash") == F.col("_hash"))
    wanted = cells.join(texts, same).select(
        "root", "low", "high", "node", "block", "copies", "text"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            columns = [table.column(k).to_numpy() for k in (1, 2, 3, 4, 5)]
            for a, b in _cell_ranges(table):
                low, high, node, block, copies = (c[a:b] for c in columns)
                raw, offsets = utf8(table.column(6).slice(a, b - a))
                own, sets, kept, seen = [], [], [], set()
                for x, y in chunks(offsets):
                    words, first = word_hashes(raw, offsets[x : y + 1])
                    shingles, at = shingle_hashes(words, first, WIDTH)
                    own.append(_nodes(words, first))
                    for k in range(x, y):
                        # a repeated id may have brought another text, or the same again
                        if own[-1][k - x] == node[k] and int(node[k]) not in seen:
                            seen.add(int(node[k]))
                            kept.append(k)
                            sets.append(np.unique(shingles[at[k - x] : at[k - x + 1]]))
                if not kept:
                    continue
                pick = np.array(kept)
                links, root = _verify_cell(
                    node[pick], block[pick], copies[pick], sets, bool(low[0] == high[0])
                )
                yield pa.record_batch(
                    [pa.array(node[pick]), pa.array(links.astype(np.int64)),
                     pa.array(node[pick][root])],
                    names=["node", "links", "root"],
                )

    return _by_cell(wanted, "root").mapInArrow(verify, "node bigint, links bigint, root bigint")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _joined(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, node, copy_id, n_links, root, class_id."""
    signed = _stored(signatures(docs), "signatures")
    classes = _stored(
        signed.filter(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            # one of its rows stands for the class: the smallest id, null last
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("_one"),
            F.count(F.lit(1)).alias("copies"),
            F.first("shingles").alias("shingles"),
            F.first("prefixes").alias("prefixes"),
            F.first("sketch").alias("sketch"),
        )
        .select("node", "_one.doc_id", "_one.text_hash", "copies", "shingles", "prefixes", "sketch"),
        "classes",
    )
    components = connected_components(candidate_edges(classes))
    found = _stored(verified(docs, classes, components), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    info = classes.select("node", "doc_id", "copies").join(links, "node", "left").join(
        groups, "node", "left"
    ).withColumn("root", F.coalesce("root", "node"))
    least = info.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    info = info.join(least, "root").select(
        "node",
        "root",
        F.col("doc_id").alias("copy_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "class_id",
    )
    return signed.select("doc_id", "text_hash", "node").join(info, "node", "left")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id, n_links, copy_id.

    ``class_id`` is the smallest id among all documents it is linked to, directly
    or through others, and itself; ``n_links`` the number of other documents it
    is linked to (copies included); ``copy_id`` the smallest id among documents
    of the same words.
    """
    own = F.col("node").isNull()
    return _joined(docs).select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        F.when(own, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the smallest id stays.

    Of rows that repeat that id and text one stays.  Rows with a null text stay.
    """
    groups = _joined(docs).filter(F.col("node").isNotNull())
    first = groups.groupBy("root").agg(
        F.min(
            F.struct(
                F.col("doc_id").isNull().alias("_none"),
                F.coalesce("doc_id", F.lit(0)).alias("_id"),
                F.col("text_hash").alias("_hash"),
            )
        ).alias("_first")
    ).select("_first.*").distinct()
    text, key = F.col("text").cast("string"), ["_none", "_id", "_hash"]
    rows = docs.select(
        whole_row(),
        F.col("doc_id").isNull().alias("_none"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"),
        F.xxhash64(text).alias("_hash"),
        text.isNull().alias("_blank"),
    )
    kept = rows.filter(~F.col("_blank")).join(first, key, "left_semi").dropDuplicates(key)
    return kept.unionByName(rows.filter("_blank")).select(*passed(docs))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, links and groups of all ``documents``."""
    return jaccard_join(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))


#: All pairs that share a shingle, and the closure of the links.
OP3_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, CASE WHEN text IS NOT NULL
                      THEN regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 5 * c >= 4 * (x.n + y.n - c)
  UNION ALL
  SELECT x.doc_id, y.doc_id FROM t x JOIN t y ON x.doc_id < y.doc_id
  WHERE len(x.w) = 0 AND len(y.w) = 0),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS g FROM t UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.g),
k AS (SELECT doc_id, min(g) AS group_id FROM r GROUP BY doc_id),
c AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT t.doc_id,
       group_id AS class_id, coalesce(n_links, 0)::BIGINT AS n_links,
       CASE WHEN w IS NULL THEN t.doc_id
            ELSE min(t.doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS copy_id
FROM t JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""
