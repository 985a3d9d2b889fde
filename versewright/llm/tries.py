"""The trie of all conversations, node by node, from shards cut at splitter paths.

A conversation is the path of its turns' digests. Equal paths are one row with a weight; rows are dealt to shards by splitter
paths taken from a sample. A node whose members fall into two shards is a prefix of the splitter between them: these few
nodes are the skeleton, known to every task. All other nodes lie in one shard each, where a stack over the sorted paths
finishes them; of skeleton nodes a shard gives partial aggregates, which are reduced and then summed up the skeleton.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewright.session import written

#: Bytes of a turn's digest in a path.
WIDTH = 16
#: Paths sampled for each shard, to cut shards of about one size, and the turns of a splitter path at most: the skeleton has
#: no more than shards * MOST_TURNS nodes and the root, whatever the paths.
SAMPLED, MOST_TURNS = 20, 32
#: Ids that are joined to one piece of a node's list of ends.
PIECE = 1 << 16
ROOT = hashlib.md5(b"").digest()

_NODE = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, skeleton boolean"
_NODE_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.bool_()]
_NODE_NAMES = [part.split()[0] for part in _NODE.split(", ")]


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` of ``conversations (conv_id, turn, role, text)``: a row a conversation, its turns in order.

    A turn is ``turn, digest, words``; texts stay behind. Turns are ordered by number, null first, equal numbers by digest;
    a null role or text counts as empty. Rows without a ``conv_id`` belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull())
    rows = rows.select(F.col("conv_id").cast("long"), F.struct(F.col("turn"), digest.alias("digest"), words.alias("words")).alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def rebuilt(own: DataFrame, shared: Column, most: int, base: Column) -> DataFrame:
    """``own (conv_id, turns)`` with the first ``shared`` turns (``most`` at most) taken from the conversation ``base``."""
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    rows = own.withColumns({"base": base, "h": shared}).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", 1, F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(head, rest).alias("turns"))


def _skeleton(splitters: list[bytes]) -> dict[bytes, tuple[bytes | None, int]]:
    """Parent and depth of every prefix of the splitters, by key."""
    found: dict[bytes, tuple[bytes | None, int]] = {ROOT: (None, 0)}
    for path in splitters:
        parent, running = ROOT, hashlib.md5()
        for depth, at in enumerate(range(0, len(path), WIDTH), 1):
            running.update(path[at:at + WIDTH])
            key = running.digest()
            found[key] = parent, depth
            parent = key
    return found


def _sharder(splitters: list[bytes]):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect_right(splitters, p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    return shards


def _grower(skeleton: frozenset[bytes]):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An open node: key, hash of its path so far, words, members, smallest one, children, leaves and tokens below.
        stack: list[list] = []
        out: list[tuple] = []
        last = b""

        def close() -> None:
            depth = len(stack) - 1
            key, _, words, n, least, children, leaves, saved = stack.pop()
            partial = key in skeleton
            if not partial:
                leaves = leaves if children else 1
                saved += (n - 1) * words
            above = stack[-1] if stack else None
            out.append((key, above[0] if above else None, depth, least, n, children, leaves, saved, words, partial))
            if above:
                above[3] += n
                above[4] = min(above[4], least)
                above[5] += not partial
                above[6] += leaves
                above[7] += saved

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), _NODE_TYPES)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, _NODE_NAMES)

        for batch in batches:
            for path, words, n, least in zip(*(batch.column(c) for c in ("path", "words", "n", "first"))):
                path, words, n, least = path.as_py(), words.as_py(), n.as_py(), least.as_py()
                common, shorter = 0, min(len(path), len(last))
                while common < shorter and path[common:common + WIDTH] == last[common:common + WIDTH]:
                    common += WIDTH
                while len(stack) > common // WIDTH + 1:
                    close()
                if not stack:
                    stack.append([ROOT, hashlib.md5(), 0, 0, least, 0, 0, 0])
                for depth, at in enumerate(range(common, len(path), WIDTH), common // WIDTH):
                    running = stack[-1][1].copy()
                    running.update(path[at:at + WIDTH])
                    stack.append([running.digest(), running, words[depth], 0, least, 0, 0, 0])
                stack[-1][3] += n
                stack[-1][4] = min(stack[-1][4], least)
                last = path
                if len(out) > 20_000:
                    yield batch_of()
        while stack:
            close()
        if out:
            yield batch_of()

    return grow


def _summed(partial: list, skeleton: dict[bytes, tuple[bytes | None, int]]) -> list[tuple]:
    """Skeleton nodes with what lies below them in the skeleton added, deepest first."""
    nodes = {bytes(r["key"]): r.asDict() for r in partial}
    for key in nodes:
        parent = skeleton[key][0]
        if parent is not None:
            nodes[parent]["n_children"] += 1
    out, below = [], {key: [0, 0] for key in nodes}
    for key in sorted(nodes, key=lambda k: -skeleton[k][1]):
        r, (parent, depth), (leaves, saved) = nodes[key], skeleton[key], below[key]
        leaves += r["n_leaves"] if r["n_children"] else 1
        saved += r["saved_tokens"]
        own = (r["n_convs"] - 1) * r["words"]
        out.append((key, parent, depth, r["conv_id"], r["n_convs"], r["n_children"], leaves, saved + own))
        if parent is not None:
            # The partial aggregates of the parent hold those of this node already: only the skeleton's own share goes up.
            below[parent][0] += below[key][0] + (not r["n_children"])
            below[parent][1] += below[key][1] + own
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node, joined in pieces, of rows sorted by node and id."""
    key, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch_of() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "first", "piece"])

    for batch in batches:
        for own, conv_id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if own != key or len(ids) >= PIECE:
                close()
                key = own
            ids.append(conv_id)
        if len(out) > 20_000:
            yield batch_of()
    close()
    if out:
        yield batch_of()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, of rows sorted by node and first id; one piece is held at a time."""
    key, running, out = None, None, []
    for batch in batches:
        for own, piece in zip(batch.column("key"), batch.column("piece")):
            own, piece = own.as_py(), piece.as_py().encode()
            if own == key:
                running.update(b"," + piece)
                continue
            if running:
                out.append((key, running.hexdigest()))
            key, running = own, hashlib.sha256(piece)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], ["key", "ends_sha256"])
            out = []
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["key", "ends_sha256"])


def nodes(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``conversations (conv_id, turns)``, as :func:`paths` gives them.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over the subtree: words of a node's last turn for each member but one), ``ends_sha256``
    (of the ids of the conversations that end there, ascending, joined by commas). A conversation without turns is a member
    of the root alone; without conversations there is no node. A conversation is one row, 50 bytes for each of its turns.
    """
    spark = conversations.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.unhex(F.array_join("turns.digest", ""))
    rows = written(conversations.select("conv_id", path.alias("path"), F.col("turns.words").alias("words")), "paths")
    # Equal conversations are one path; what they share is counted before anything is dealt out.
    distinct = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.any_value("words").alias("words"))
    distinct = written(distinct, "distinct")
    every = max(1, distinct.count() // (SAMPLED * tasks))
    sample = distinct.where(F.pmod(F.xxhash64("path"), F.lit(every)) == 0)
    sample = sorted(bytes(r[0]) for r in sample.select(F.expr(f"substring(path, 1, {WIDTH * MOST_TURNS})")).collect())
    splitters = sorted({sample[len(sample) * k // tasks] for k in range(1, tasks)} - {b""}) if sample else []
    skeleton = _skeleton(splitters)
    shards = distinct.mapInArrow(_sharder(splitters), "path binary, n long, first long, words array<bigint>, shard int")
    shards = shards.repartition(tasks, "shard").sortWithinPartitions("shard", "path")
    grown = written(shards.mapInArrow(_grower(frozenset(skeleton)), _NODE), "grown")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    partial = grown.where("skeleton").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *sums)
    kept = ["key", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    # No more rows than the skeleton has: tasks * MOST_TURNS + 1.
    whole = spark.createDataFrame(_summed(partial.collect(), skeleton), grown.select(*kept).schema)
    found = written(grown.where("not skeleton").select(*kept).unionByName(whole), "nodes")
    above = found.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = rows.select(F.unhex(F.md5("path")).alias("key"), "conv_id")
    ends = ends.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ends.mapInArrow(_pieces, "key binary, first long, piece string")
    ends = pieces.repartition(tasks, "key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends_sha256 string")
    found = found.join(above, "parent", "left").join(ends, "key", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: CRC-32 of a short text, byte by byte and bit by bit.
_CRC32 = """
xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def rebuilt_nodes_sql() -> str:
    """The trie of the rebuilt conversations in SQL."""
    crc = _CRC32.format(text="conv_id::VARCHAR")
    return rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY i) AS turns, {crc} % 4 AS h FROM turns GROUP BY conv_id
), paths AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS path
  FROM own a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), prefixes AS (
  SELECT conv_id, d AS depth, path[1:d] AS prefix, d = len(path) AS ends
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)
), members AS (
  SELECT conv_id, depth, ends, CASE WHEN depth > 0 THEN len(regexp_extract_all(prefix[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words,
    min(conv_id) OVER (PARTITION BY depth, prefix) AS node
  FROM prefixes
), nodes AS (
  SELECT node, depth, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), linked AS (
  SELECT n.*, m.node AS parent_conv_id FROM nodes n LEFT JOIN members m ON m.conv_id = n.node AND m.depth = n.depth - 1
), children AS (
  SELECT parent_conv_id AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (node, depth)
), below AS (
  SELECT m.node, m.depth, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
  FROM counted c JOIN members m ON m.conv_id = c.node AND m.depth <= c.depth GROUP BY ALL
)
SELECT node AS conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM counted JOIN below USING (node, depth)"""
