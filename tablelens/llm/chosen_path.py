"""Similarity join on word shingles by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablelens.llm.common import in_pieces, mixed, pin_batches, utf8, word_hashes, words, written

SAMPLE = 64  # expected tokens of a set that paths may choose from
BRANCHES = 3.0  # expected common choices, per level, of a pair at the threshold
SMALL = 256  # a bucket up to this size is compared pair by pair
BLOCK = 512  # larger ones that cannot be split are compared in blocks of about this size
DEPTH = 4
MARGIN = 0.45  # by which a sample's estimate may fall below the threshold
COLUMNS = 2048  # shingles of a bucket that are multiplied at once
_LINK = {"node": pa.int64(), "root": pa.int64(), "links": pa.int64()}
_AT = pa.list_(pa.struct([("leaf", pa.int64()), ("members", pa.int64())]))
_SET = {"node": pa.int64(), "copies": pa.int64(), "at": _AT, "shingles": pa.binary()}


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each text's distinct shingles, sorted.

    Words are lower-cased runs without ASCII white space; a text with fewer than ``width`` words has
    one shingle of all its words, a text without words none.
    """
    raw, offsets = utf8(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, owner = words(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(texts)), count)
    begin = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    value = np.zeros(len(begin), np.uint64)
    for step in range(width):
        at = begin + step
        inside = at < (first + n)[text]
        value = value * np.uint64(0xD6E8FEB86659FD93)
        value[inside] += hashes[at[inside]]
    value = mixed(value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[fresh], value[fresh].view(np.int64)


def _sampled(width: int, seed: int, sample: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("size", pa.int64()), ("sample", pa.list_(pa.int64()))])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_pieces(batch.column(2)):
                text, value = shingles(texts, width)
                size = np.bincount(text, minlength=len(texts))
                luck = mixed(value.view(np.uint64) + np.uint64(seed)) / 2.0**64
                chosen = luck < sample / np.maximum(size, 1)[text]
                kept = np.bincount(text[chosen], minlength=len(texts))
                cells = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.array(value[chosen])
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(size), cells],
                    schema=schema,
                )

    return sampled, from_arrow_schema(schema)


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_pieces(batch.column(3)):
                text, value = shingles(texts, width)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
                blobs = pa.array([value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                rest = [batch.column(k).slice(first, len(texts)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*rest[:2], rest[2].cast(_AT), blobs], schema=pa.schema(_SET.items()))

    return sets


def _overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Common elements of every two sets, by products of incidence matrices a few thousand columns wide."""
    owner = np.repeat(np.arange(len(sets)), [len(one) for one in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for low in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            part = np.zeros((len(sets), COLUMNS), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            total += part @ part.T
    return total


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    label = np.arange(len(linked), dtype=np.int32)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.int32(len(linked))).min(1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compare(rows: dict[int, tuple], leaf: int, within: bool, threshold: float) -> list[tuple]:
    """(member, root, links) of one bucket's members with links; rows: node -> (block, copies, leaves, set).

    A pair that a bucket with a smaller number also holds is linked here, but counted there.
    """
    nodes = sorted(rows)
    if len(nodes) < 2:
        return []
    block, copies, leaves, sets = zip(*(rows[node] for node in nodes))
    sizes = np.array([len(one) for one in sets], np.float32)
    common = _overlap(list(sets))
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    if not within:
        block = np.array(block)
        linked &= block[:, None] != block[None, :]
    if not linked.any():
        return []
    before = _overlap([one[one < leaf] for one in leaves]) > 0
    links = (linked & ~before) @ np.array(copies, np.int64)
    root = _roots(linked)
    return [(nodes[k], nodes[root[k]], int(links[k])) for k in np.flatnonzero(linked.any(1))]


def _buckets(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for each run of rows with equal first ``keys`` columns."""
    now, rows = None, []
    for batch in batches:
        for cells in zip(*(column.to_pylist() for column in batch.columns)):
            if cells[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = cells[:keys], []
            rows.append(cells[keys:])
    if rows:
        yield now, rows


def _brute_force(threshold: float):
    def brute_force(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leaf, a, b), rows in _buckets(batches, 3):
            members = {
                node: (block, copies, np.array(leaves, np.int64), np.frombuffer(blob, np.int64))
                for block, node, copies, leaves, blob in rows
            }
            if found := compare(members, leaf, a == b, threshold):
                yield pa.RecordBatch.from_pydict(dict(zip(_LINK, map(list, zip(*found)))), schema=pa.schema(_LINK.items()))

    return brute_force


_PLACE = {"leaf": pa.int64(), "node": pa.int64(), "members": pa.int64()}


def _sketch_filter(threshold: float):
    """Members of small buckets whose samples resemble another member's, unless the two meet in a lower bucket.

    The filter is the same in all runs, so its misses add to theirs. Under the Poisson model of samples of 64 tokens
    the estimate of a pair at the threshold of 0.8 falls below the threshold less MARGIN with chance 1.3e-13 for equal
    sizes and 8e-10 if one set is 0.8 of the other.
    """

    def sketch_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (leaf,), rows in _buckets(batches, 1):
            node, members, size, sample, leaves = zip(*rows)
            count, size = np.array([len(one) for one in sample], float), np.array(size, float)
            common = _overlap([np.array(one, np.int64) for one in sample])
            ratio = np.minimum(size[:, None] / size[None, :], 1.0)  # of the row's sample that the column's rule also keeps
            union = count[:, None] * ratio + count[None, :] * ratio.T - common
            near = (common >= (threshold - MARGIN) * union) & (np.minimum(ratio, ratio.T) >= threshold - 1e-9)
            np.fill_diagonal(near, False)
            if near.any():
                near &= _overlap([np.array([one for one in own if one < leaf], np.int64) for own in leaves]) == 0
            out += [(leaf, node[k], members[k]) for k in np.flatnonzero(near.any(1))]
            if len(out) > 5000:
                yield pa.RecordBatch.from_pydict(dict(zip(_PLACE, map(list, zip(*out)))), schema=pa.schema(_PLACE.items()))
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(_PLACE, map(list, zip(*out)))), schema=pa.schema(_PLACE.items()))

    return sketch_filter


def runs_needed(recall: float, branches: float = BRANCHES, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is met with probability ``recall``.

    A pair shares a Poisson number of choices per level, ``branches`` on average; a run misses it if this
    branching process dies out within ``depth`` levels.
    """
    miss = 0.0
    for _ in range(depth):
        miss = math.exp(-branches * (1 - miss))
    return math.ceil(math.log(1 - recall) / math.log(miss))


def _split(members: DataFrame, threshold: float, sample: int) -> DataFrame:
    """Every member of a bucket moves on with the tokens that the bucket's path chooses from its set."""
    chance = F.least(F.lit(1.0), F.lit(BRANCHES / threshold) / F.least("size", F.lit(sample)))
    full = members.withColumn("chance", chance)
    chosen = F.filter("sample", lambda token: (F.xxhash64("path", token).bitwiseAND(F.lit((1 << 63) - 1)) / 2.0**63) < F.col("chance"))
    return full.select(F.col("path").alias("parent"), "node", F.explode(chosen).alias("token")).select(
        "parent", "node", F.xxhash64("parent", "token", F.lit("next")).alias("path")
    )


def _leaves(classes: DataFrame, threshold: float, recall: float, sample: int) -> DataFrame:
    """Buckets to compare: (leaf, node, members)."""
    runs = runs_needed(recall)
    sets = classes.select("node", "size", "sample")
    members = sets.withColumn("path", F.explode(F.array(*[F.lit(7919 * k).cast("long") for k in range(runs)])))
    found = done = None
    same = ["members", "mark1", "mark2"]  # equal for buckets with the same members
    for level in range(1, DEPTH + 1):
        moved = written(_split(members, threshold, sample), "paths")
        mark = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
        sizes = moved.groupBy("parent", "path").agg(F.count("*").alias("members"), *mark).where("members > 1")
        if level > 1:
            # a bucket whose members mostly meet again is compared as it is
            squares = sizes.groupBy("parent").agg(F.sum(F.col("members") * F.col("members")).alias("squares"))
            before = large.select("node", F.col("path").alias("parent"), *same)
            dense = (
                before.select("parent", *same).distinct().join(squares.hint("shuffle_hash"), "parent")
                .where(F.col("squares") >= 0.5 * BRANCHES * F.col("members") * F.col("members")).select("parent", *same)
            )
            dense = written(dense, "dense")
            one = dense.groupBy(*same).agg(F.min("parent").alias("parent"))
            done = done.unionByName(one.select(*same))
            found = found.unionByName(
                before.join(one.select("parent").hint("shuffle_hash"), "parent").select(F.col("parent").alias("leaf"), "node", "members")
            )
            sizes = sizes.join(dense.select("parent").hint("shuffle_hash"), "parent", "left_anti")
        # buckets with the same members are compared once, but split each on its own: runs stay independent
        last = level == DEPTH
        sizes = written(sizes.select("path", *same), "buckets")
        once = sizes.groupBy(*same).agg(F.min("path").alias("path"), F.count("*").alias("times"))
        if done is not None:
            once = once.join(done.hint("shuffle_hash"), same, "left_anti")
        if not last:
            # members that meet again and again over tokens and runs are compared as they are
            once = once.where((F.col("members") <= SMALL) | (F.col("times") >= runs * (0.5 * BRANCHES) ** level))
        once = written(once.select("path", *same), "once")
        here = moved.select("node", "path").distinct() if level > 1 else moved.select("node", "path")
        leaf = here.join(once.select("path", "members").hint("shuffle_hash"), "path").select(F.col("path").alias("leaf"), "node", "members")
        found = leaf if found is None else found.unionByName(leaf)
        settled = once.where(F.col("members") > SMALL).select(*same)
        done = settled if done is None else done.unionByName(settled)
        more = sizes.where(F.col("members") > SMALL).join(done.hint("shuffle_hash"), same, "left_anti")
        if last or not more.limit(1).count():
            break
        large = written(here.join(more.hint("shuffle_hash"), "path"), "large")
        members = large.select("node", "path").hint("merge").join(sets, "node")
    found = written(found.distinct(), "found")
    lists = found.groupBy("node").agg(F.collect_list("leaf").alias("leaves"))
    small = found.where(F.col("members") <= SMALL).join(sets.join(lists.hint("merge"), "node"), "node")
    small = small.select("leaf", "node", "members", "size", "sample", "leaves")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = small.repartition(parts, "leaf").sortWithinPartitions("leaf")
    near = dealt.mapInArrow(
        _sketch_filter(threshold), from_arrow_schema(pa.schema(_PLACE.items()))
    )
    large = found.where(F.col("members") > SMALL).select("leaf", "node", "members")
    return written(near.unionByName(large), "leaves")


def _components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge list, by turns of large and small stars."""
    edges = written(edges.where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def similarity_classes(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = 0.8,
    width: int = 5,
    recall: float = 0.99999,
    seed: int = 20,
    sample: int = SAMPLE,
) -> DataFrame:
    """Join texts whose sets of ``width``-word shingles have Jaccard similarity of at least ``threshold``.

    Equal texts collapse first (map-side), so a hot group of copies is one node. Then each run
    splits the nodes by the shared tokens that its paths choose: a hash of path and token keeps a token of
    set x with chance 3 / (threshold |x|), so a pair at the threshold expects three common choices per level.
    Paths choose from about ``sample`` tokens of each set, the same for all sets that hold them.
    Buckets up to 256 nodes are compared pair by pair, first on the samples, then exactly on whole shingle sets; larger ones are split
    again, unless their members mostly stay together; then they are compared in blocks of
    about 512. Runs are repeated until a pair at the threshold is found with probability ``recall``
    (5 runs); likelier pairs are missed less. A pair in several buckets counts in the lowest one.

    Returns, per row: ``doc_id``, ``class_id`` (smallest id linked to it directly or over others, its own
    if none), ``copy_of`` (smallest id with the same text), ``links`` (other rows with similarity of at least
    the threshold, copies included), ``text_key`` (MD5 of the text) and ``class_key`` (that of the one text that stands for
    the class; its smallest id is ``class_id``). Texts without words, null or empty,
    are copies of each other, but linked to nothing and in a class of their own. Rows without an id take part; repeated rows are
    copies. Other columns are not carried.
    """
    pin_batches(df.sparkSession)
    docs = df.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("key", F.unhex(F.md5("text")))
    sampled, schema = _sampled(width, seed, sample)
    rows = written(docs.select("doc_id", "key", "text").mapInArrow(sampled, schema), "samples")
    classes = rows.groupBy("key").agg(
        F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("sample").alias("sample")
    )
    # a number for each text, fixed by writing it: all that follows carries 8 bytes instead of the digest
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    worded = classes.where("size > 0")
    leaves = _leaves(worded, threshold, recall, sample)
    of_node = leaves.groupBy("node").agg(F.collect_list(F.struct("leaf", "members")).alias("at"))
    wanted = of_node.hint("merge").join(worded.select("node", "key", "copy_of", "copies"), "node")
    texts = docs.join(wanted.hint("merge"), (docs["key"] == wanted["key"]) & docs["doc_id"].eqNullSafe(wanted["copy_of"])).select(
        wanted["node"], "copies", "at", "text"
    )
    sets = texts.mapInArrow(_sets(width), from_arrow_schema(pa.schema(_SET.items())))
    sets = sets.withColumn("place", F.explode("at")).select(
        "node", "copies", "shingles", F.col("place.leaf").alias("leaf"), F.col("place.members").alias("members"),
        F.col("at.leaf").alias("leaves"),
    )
    blocks = F.when(F.col("members") > SMALL, F.ceil(F.col("members") / BLOCK)).otherwise(1)
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node", "leaf"), blocks).cast("int"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    sets = sets.select(
        "leaf", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node",
        "copies", "leaves", "shingles",
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(parts, "leaf", "a", "b").sortWithinPartitions("leaf", "a", "b")
    found = written(dealt.mapInArrow(_brute_force(threshold), from_arrow_schema(pa.schema(_LINK.items()))), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("linked"))
    roots = _components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = classes.select("node", "key", "copy_of", "copies").join(roots, "node", "left")
    roots = roots.withColumn("root", F.coalesce("root", "node"))
    best = F.struct(F.col("copy_of").isNull(), "copy_of", "key")
    named = roots.groupBy("root").agg(F.min("copy_of").alias("class_id"), F.min_by("key", best).alias("class_node"))
    nodes = roots.join(named, "root").join(links, "node", "left")
    joined = rows.select("doc_id", "key", "size").join(
        nodes.select("key", "copy_of", "copies", "class_id", "class_node", "linked"), "key"
    )
    worded_row = F.col("size") > 0
    return joined.select(
        "doc_id",
        F.when(worded_row, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        "copy_of",
        F.when(worded_row, F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).alias("links"),
        F.lower(F.hex("key")).alias("text_key"),
        F.lower(F.hex(F.when(worded_row, F.col("class_node")).otherwise(F.col("key")))).alias("class_key"),
    )


JOIN_SQL = """
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS words FROM texts),
sets AS (
  SELECT doc_id, text, len(words) AS n, list_distinct(CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles FROM cut),
cells AS (SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met, any_value(a.size) AS size_a, any_value(b.size) AS size_b
  FROM cells a JOIN cells b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 5 * met >= 4 * (size_a + size_b - met)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a),
degrees AS (SELECT a AS doc_id, count(*) AS links FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(c.least, doc_id)) AS class_id, min(doc_id) OVER (PARTITION BY text) AS copy_of,
  coalesce(g.links, 0)::BIGINT AS links
FROM sets LEFT JOIN classes c USING (doc_id) LEFT JOIN degrees g USING (doc_id)
"""
