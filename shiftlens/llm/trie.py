"""Conversation prefix trie by truncation peeling.

A conversation is the sequence of its turns' digests; the node of its first d
turns is named by a chained 128-bit key, so equal prefixes have equal keys.
Conversations of one sequence become one *piece*.  Peeling descends from the
maximum depth: pieces that end at a depth merge with the nodes surviving from
below, the merged node is complete and emitted, its last turn is stripped and
what is left regroups one turn higher.  Counts, leaves and savings are added up
on the way, so nodes are discovered and aggregated in the same pass.

Depths are peeled in blocks (lo, hi] with borders 0, 1, 2, 4, 8, ...: the pieces
of a block meet by their prefix of ``lo`` turns, and each such group peels its
turns inside one task.  Groups of more than ``GROUP_TURNS`` turns (a first turn
that a third of all conversations share) are instead peeled turn by turn with
grouped aggregates, whose partial sums split any hot node.  No group is
collected beyond that bound.  The digest of a node's ended conversations runs
over sorted ids as a stream, with one id held at a time.

Defined results: a null conv_id belongs to no conversation and is left out;
turns of equal rank are ordered by the MD5 of role and text, repeated rows are
turns of their own; null role or text counts as empty; the turns of one
conversation (some 40 bytes each, not their texts) must fit a task; other
columns are not read; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, landed

# Fixed values of the rebuilding rule.
HEAD_EVERY = 100
HEAD_TURNS = 6

GROUP_TURNS = 100_000
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()
PIECE = ("depth int, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, path array<binary>, chars array<long>")
PIECE_NAMES = [field.split()[0] for field in PIECE.split(", ")]
PIECE_ARROW = pa.schema([
    ("depth", pa.int32()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("path", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64()))])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the rebuilt turns (digest, chars) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
                F.col("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("t")))
    own = landed(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")), "own-turns")
    base = F.col("conv_id") - F.col("conv_id") % HEAD_EVERY
    heads = own.where(F.col("conv_id") == base).select(
        F.col("conv_id").alias("base"), F.slice("own", 1, HEAD_TURNS - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS).cast("int")
    head = F.coalesce(F.col("head"), F.slice("own", 1, 0))
    return (own.withColumn("base", base).join(heads, "base", "left")
            .select("conv_id", F.concat(F.slice(head, F.lit(1), n),
                                        F.slice("own", n + 1, F.size("own"))).alias("turns")))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, lasts = [], []
        for digests in batch.column("digests").to_pylist():
            key, path = ROOT, []
            for digest in digests:
                key = hashlib.blake2b(key + digest, digest_size=16).digest()
                path.append(key)
            paths.append(path)
            lasts.append(key)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(lasts, pa.binary()), pa.array(paths, pa.list_(pa.binary())),
             batch.column("chars")], ["conv_id", "key", "path", "chars"])


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, path, chars) of every rebuilt conversation, landed once."""
    turns = rebuilt(conversations).select("conv_id", F.col("turns.digest").alias("digests"),
                                          F.col("turns.chars").alias("chars"))
    return landed(turns.mapInArrow(_chain, "conv_id long, key binary, path array<binary>, chars array<long>"),
                  "sequences")


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of equal keys in rows sorted by (key, conv_id)."""
    key, first, n, sha = None, None, 0, None

    def flush(rows: list) -> None:
        if n:
            rows.append((key, first, n, sha.hexdigest()))

    def table(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                          ["key", "conv_id", "n_convs", "ends_sha256"])

    for batch in batches:
        rows: list = []
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if n and k == key:
                sha.update(b",%d" % c)
                n += 1
            else:
                flush(rows)
                key, first, n, sha = k, c, 1, hashlib.sha256(b"%d" % c)
        yield table(rows)
    rows = []
    flush(rows)
    yield table(rows)


def pieces_of(seqs: DataFrame) -> DataFrame:
    """One piece per distinct sequence, landed once."""
    ended = (seqs.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
             .mapInArrow(_digest_ends, "key binary, conv_id long, n_convs long, ends_sha256 string"))
    zero = F.lit(0).cast("long")
    return landed(ended.drop("key").join(seqs.drop("key"), "conv_id").select(
        F.size("path").alias("depth"), "n_convs", "conv_id", zero.alias("n_children"), zero.alias("n_leaves"),
        zero.alias("saved_tokens"), "ends_sha256", "path", "chars"), "pieces")


class Node:
    """Running sums of one node while its pieces merge."""

    __slots__ = ("n", "conv", "children", "leaves", "saved", "ends", "path", "chars")

    def __init__(self, n, conv, children, leaves, saved, ends, path, chars):
        self.n, self.conv, self.children, self.leaves, self.saved = n, conv, children, leaves, saved
        self.ends, self.path, self.chars = ends, path, chars

    def merge(self, other: "Node") -> None:
        self.n += other.n
        self.conv = min(self.conv, other.conv)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends

    def close(self, depth: int) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.chars[depth - 1]

    def row(self, depth: int) -> tuple:
        return (depth, self.n, self.conv, self.children, self.leaves, self.saved, self.ends,
                self.path[:depth], self.chars[:depth])


def peel_group(rows: list[tuple], lo: int) -> list[tuple]:
    """Pieces that share ``lo`` turns -> their nodes deeper than ``lo`` and the survivor at ``lo``."""
    levels: dict[int, dict[bytes, Node]] = {}

    def place(depth: int, node: Node) -> None:
        level = levels.setdefault(depth, {})
        key = node.path[depth - 1] if depth else ROOT
        if key in level:
            level[key].merge(node)
        else:
            level[key] = node

    for depth, *rest in rows:
        place(depth, Node(*rest))
    out: list[tuple] = []
    for depth in range(max(levels), lo, -1):
        for node in levels.pop(depth, {}).values():
            node.close(depth)
            out.append(node.row(depth)[:7] + (node.path[max(depth - 2, 0):depth], []))
            place(depth - 1, Node(node.n, node.conv, 1, node.leaves, node.saved, None, node.path, node.chars))
    out.extend(node.row(lo) for node in levels.get(lo, {}).values())
    return out


def _peel(lo: int):
    """Rows sorted by stem -> finished nodes and survivors, one group in memory at a time."""
    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(PIECE_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE_ARROW)],
                                          schema=PIECE_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, group = None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in PIECE_NAMES]
            for s, row in zip(batch.column("stem").to_pylist(), zip(*columns)):
                if group and s != stem:
                    out.extend(peel_group(group, lo))
                    group = []
                stem = s
                group.append(row)
            yield table(out)
        yield table(peel_group(group, lo) if group else [])
    return run


def _sum_pieces(pieces: DataFrame, *keys) -> DataFrame:
    return pieces.groupBy(*keys).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))


def _peel_hot(pieces: DataFrame, lo: int, hi: int) -> DataFrame:
    """The same peeling for groups of any size: one grouped aggregate per turn."""
    done, alive = None, pieces.where(F.col("depth") == hi)
    for depth in range(hi, lo, -1):
        at = F.element_at("path", depth)
        merged = (_sum_pieces(alive.withColumn("key", at), "depth", "key")
                  .join(alive.groupBy(at.alias("key")).agg(F.max("path").alias("path"), F.max("chars").alias("chars")),
                        "key")
                  .withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("long")))
                  .withColumn("saved_tokens", F.col("saved_tokens")
                              + (F.col("n_convs") - 1) * F.element_at("chars", depth)))
        merged = landed(merged.select(*PIECE_NAMES), "peeled")
        short = F.slice("path", max(depth - 1, 1), min(depth, 2))
        nodes = merged.withColumn("path", short).withColumn("chars", F.slice("chars", 1, 0))
        done = nodes if done is None else done.unionByName(nodes)
        stripped = (merged.withColumn("depth", F.lit(depth - 1)).withColumn("n_children", F.lit(1).cast("long"))
                    .withColumn("ends_sha256", F.lit(None).cast("string"))
                    .withColumn("path", F.slice("path", 1, depth - 1))
                    .withColumn("chars", F.slice("chars", 1, depth - 1)))
        alive = stripped if depth - 1 == lo else stripped.unionByName(pieces.where(F.col("depth") == depth - 1))
    return done.unionByName(alive)


def peel_block(pieces: DataFrame, lo: int, hi: int, bound: int = GROUP_TURNS) -> DataFrame:
    """Nodes of depths (lo, hi] and survivors at ``lo`` from pieces of those depths, landed."""
    stem = F.element_at("path", lo) if lo else F.lit(ROOT)
    pieces = pieces.withColumn("stem", stem)
    sizes = landed(pieces.groupBy("stem").agg(F.sum(F.col("depth").cast("long")).alias("turns")), "stems")
    largest = sizes.agg(F.max("turns")).first()[0] or 0

    def local(rows: DataFrame) -> DataFrame:
        return (rows.select("stem", *PIECE_NAMES).repartition("stem").sortWithinPartitions("stem")
                .mapInArrow(_peel(lo), PIECE))
    if largest <= bound:
        return landed(local(pieces), "block")
    sized = join_groups(pieces, sizes, "stem", "turns")
    hot = landed(sized.where(F.col("turns") > bound).select(*PIECE_NAMES), "hot-pieces")
    return landed(local(sized.where(F.col("turns") <= bound)).unionByName(_peel_hot(hot, lo, hi)), "block")


def prefix_trie(conversations: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """Every node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    items = pieces_of(sequences(conversations))
    deepest = items.agg(F.max("depth")).first()[0] or 0
    borders = [0]
    while borders[-1] < deepest:
        borders.append(max(1, 2 * borders[-1]))
    blocks, alive = [], items.limit(0)
    for lo, hi in zip(borders[-2::-1], borders[:0:-1]):
        fresh = items.where((F.col("depth") > lo) & (F.col("depth") <= hi))
        block = peel_block(alive.unionByName(fresh), lo, hi, group_turns)
        blocks.append(block.where(F.col("depth") > lo))
        alive = block.where(F.col("depth") == lo)
    root = _sum_pieces(alive.unionByName(items.where(F.col("depth") == 0)), F.lit(0).alias("depth"))
    nodes = (root.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("long")))
             .withColumn("key", F.lit(ROOT)).withColumn("parent", F.lit(None).cast("binary")))
    for block in blocks:
        above = F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(F.element_at("path", 1))
        nodes = nodes.unionByName(block.withColumn("key", F.element_at("path", -1)).withColumn("parent", above)
                                  .drop("path", "chars"))
    nodes = landed(nodes, "trie-nodes")
    parents = nodes.where(F.col("n_children") > 0).select(
        F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("fan_out"))
    named = join_groups(nodes.where(F.col("depth") > 0), parents, "parent", "fan_out").unionByName(
        nodes.where(F.col("depth") == 0).withColumn("parent_conv_id", F.lit(None).cast("long"))
        .withColumn("fan_out", F.lit(None).cast("long")))
    return named.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
                        "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
