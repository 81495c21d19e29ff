"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set holds one 64-bit hash per distinct shingle; its sketch keeps
the ``K`` smallest values (small sets whole).  Documents of equal sets form one
class.  Inverted lists of retained values bring classes together; a pair is
estimated on the bottom ``K`` values of both sketches' union, and pairs that
pass are verified on the full sets.

*Which values are indexed.*  Linked classes share at least ``needed`` of their
retained values, so with values in one global order (rarest first) it is enough
to index each class by its first ``size - needed + 1``: two classes that miss
each other there cannot share enough.  For sets above ``K`` the bound 28 of 64
fails for a pair of similarity 0.8 with a chance below 1e-10; for small sets it
is exact.  Common passages rank last and are seldom indexed.

*How lists are worked off.*  Pairs of a list are never all rows.  In each
round up to ``width`` members of a list lead: they meet every other member of
another component, then leave the list with all their pairs decided.  Links
found merge components, and a list whose members are all one component is done.
The width grows from round to round, so a list of any length ends; no list,
pair or partner is capped.  The first round, of one
leader a list, estimates pair by pair on the ``K`` values; later rounds test members
in blocks beside the leaders of their lists on the bottom ``LONG_K`` values, where
a refused pair is no row.  Tables of a round are dropped when the next one has read them.  A list of many classes that are alike but not linked still
costs comparisons in the square of its open members: each of them must be refused.

Defined results: null or wordless text has an empty set, is linked with nothing
and is its own component; a text of fewer than four words is one shingle; a
null doc_id never names a component that has another id; rows repeating a
doc_id are linked by their own texts; texts of any length are hashed whole;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, join_groups, landed, shuffles_end
from .graph import components

SHINGLE = 4
K = 64
NEEDED = 28        # of K retained values
NEEDED_SMALL = 48  # bound for sets just below K, whose partner may be above it
SIMILAR, OF = 80, 100
# Leaders a list by round (the last for any later one), and whether members with many links lead before open ones.
# Linked leaders first draw the open members of a list of copies in, for a few pairs each; open members lead last.
ROUNDS = ((1, True), (8, True), (1024, False))
PAIRS_A_PART = 1000
BLOCK = 512         # members of a list tested in one row group beside their leaders
LONG_K = 256        # bottom values compared in blocks
LONG_NEEDED = 156   # of them; fewer at similarity 0.8 with a chance below 1e-10
BROADCAST_IDS = 2_000_000
SLICE = 1 << 20
KNOWN_WORDS = 1 << 18


class WordHashes(dict):
    """XXH64 of words, remembered up to ``KNOWN_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 42)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, known: WordHashes, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes (signed) of one UTF-8 text."""
    lower, at, parts = text.lower(), 0, []  # bytes.lower() touches A-Z only
    while at < len(lower):
        end = lower.find(b" ", at + SLICE)
        end = len(lower) if end < 0 else end
        words = lower[at:end].split()
        parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
        at = end
    words = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    if not len(words):
        return np.empty(0, dtype=np.int64)
    span = min(length, len(words))
    hashes = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        hashes = _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words[i:len(words) - span + 1 + i])
    return np.unique(hashes.view(np.int64))


def _sets(batch: pa.RecordBatch, known: WordHashes) -> list[np.ndarray]:
    return [shingle_set(t or b"", known) for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _longs(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        sets = _sets(batch, known)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([_digest(s) for s in sets], pa.binary()), _longs([s[:K] for s in sets])],
            ["doc_id", "n_shingles", "digest", "sketch"])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        sets = _sets(batch, known)
        yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), _longs(sets)],
                                         ["digest", "shingles"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), sketch of every row, landed once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return landed(rows.mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, sketch array<long>"),
                  "sketches")


def classes_of(rows: DataFrame) -> DataFrame:
    """One landed row per distinct set: cls, digest, n, sketch, first (smallest doc_id), rows."""
    groups = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"), F.min("doc_id").alias("first"),
        F.count(F.lit(1)).alias("rows"))
    return landed(groups.withColumn("cls", F.monotonically_increasing_id()), "classes")


def needed(n: Column) -> Column:
    """Retained values that a class of ``n`` shingles shares with any class it is linked to, at least."""
    small = F.least(F.ceil(n * SIMILAR / OF), F.lit(NEEDED_SMALL))
    return F.when(n <= K, small).otherwise(F.lit(NEEDED))


def inverted_lists(classes: DataFrame) -> DataFrame:
    """Landed rows (value, cls, n) of indexed retained values that some other class holds too."""
    held = classes.select("cls", "n", F.explode("sketch").alias("value"))
    shared = landed(held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared-values")
    rows = join_groups(held, shared, "value", "df")
    rarest = Window.partitionBy("cls").orderBy("df", "value")
    size = F.least("n", F.lit(K))
    alone = size - F.count(F.lit(1)).over(Window.partitionBy("cls"))  # values no other class holds come first
    lists = landed(rows.withColumn("place", F.row_number().over(rarest) + alone)
                   .where(F.col("place") <= size - needed(F.col("n")) + 1).select("value", "cls", "n"), "inverted")
    dropped(shared)
    return lists


def _both(pairs: DataFrame, leaders: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Values of member and leader beside each pair; a hot leader's pairs are dealt over its parts."""
    copies = (table.select(F.col("cls").alias("leader"), F.col(value).alias("vb")).join(leaders, "leader")
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    members = table.select(F.col("cls").alias("member"), F.col(value).alias("va"))
    return pairs.join(copies, ["leader", "part"]).join(members, "member")


def estimated(pairs: DataFrame, leaders: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose similarity on the union's sketch does not rule a link out."""
    union = F.slice(F.array_sort(F.array_union("va", "vb")), 1, K)
    agree = F.size(F.array_intersect(F.array_intersect(union, "va"), "vb"))
    return (_both(pairs, leaders, classes, "sketch").where(agree * K >= F.size(union) * NEEDED)
            .select("member", "leader", "part"))


def verified(pairs: DataFrame, leaders: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs linked on their full sets."""
    both = F.size(F.array_intersect("va", "vb"))
    return (_both(pairs, leaders, sets, "shingles")
            .where(both * OF >= (F.size("va") + F.size("vb") - both) * SIMILAR)
            .select(F.col("member").alias("a"), F.col("leader").alias("b")))


def full_sets(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """(cls, shingles) of every class in ``asked``, from one document of each, landed once."""
    wanted = asked.select("cls").distinct().join(classes.select("cls", "digest", "first"), "cls")
    wanted = landed(wanted, "wanted-sets")
    ids = wanted.select("first").distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # eight bytes each; above the bound texts are joined by a shuffle
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets = (rows.join(ids, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
            .mapInArrow(_full, "digest binary, shingles array<long>"))
    # One exchange of the sets: rows repeating a doc_id collapse on the key of the join.
    sets = landed(sets.groupBy("digest").agg(F.max("shingles").alias("shingles"))
                  .join(wanted.select("cls", "digest"), "digest").select("cls", "shingles"), "shingle-sets")
    dropped(wanted)
    return sets


def _open(lists: DataFrame, labels: DataFrame | None, width: int, linked_first: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of open lists, those lists with their leaders, the leaders), all landed.

    Lists of one component are gone.  ``leads`` marks the rows of leaders, ``parts`` deals a
    leader's pairs.
    """
    rows = (lists.withColumn("root", F.col("cls")).withColumn("degree", F.lit(0).cast("long")) if labels is None else
            landed(lists.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
                   .select("value", "cls", "n", F.coalesce("root", "cls").alias("root"),
                           F.coalesce("degree", F.lit(0).cast("long")).alias("degree")), "list-rows"))
    still = rows.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("low"),
                                      F.max("root").alias("high")).where("low < high").select("value", "members")
    degree = F.col("degree").desc() if linked_first else F.col("degree").asc()
    first = Window.partitionBy("value").orderBy(degree, "cls")  # the limit is applied before the shuffle too
    lead = (rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= width)
            .groupBy("value").agg(F.collect_list(F.struct("cls", "n", "root")).alias("leaders")))
    led = landed(still.join(lead, "value"), "leaders")
    met = landed(join_groups(rows, led, "value", "members").select(
        "value", "cls", "n", "root", "members",
        F.exists("leaders", lambda x: x["cls"] == F.col("cls")).alias("leads")), "led-rows")
    parts = F.ceil(F.col("members") / PAIRS_A_PART).cast("int")
    leaders = (led.select(F.explode("leaders.cls").alias("leader"), parts.alias("parts"))
               .groupBy("leader").agg(F.max("parts").alias("parts")))
    if labels is not None:
        dropped(rows)
    return met, led, landed(leaders, "pair-leaders")


def single_pairs(met: DataFrame, led: DataFrame, leaders: DataFrame, classes: DataFrame) -> DataFrame:
    """Estimated pairs (member, leader, part) of a round of one leader a list."""
    led = led.select("value", "members", F.col("leaders")[0].alias("lead"))
    n, other = F.col("lead.n"), F.col("n")
    parts = F.ceil(F.col("members") / PAIRS_A_PART).cast("int")
    pairs = (join_groups(met.drop("members"), led, "value", "members")
             .where((F.col("lead.root") != F.col("root"))
                    & (F.least(n, other) * OF >= F.greatest(n, other) * SIMILAR))
             .select(F.col("cls").alias("member"), F.col("lead.cls").alias("leader"),
                     F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"))
             .groupBy("member", "leader").agg(F.min("part").alias("part")))
    return estimated(pairs, leaders, classes)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _column(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).combine_chunks()


def _wanted(members: pa.Table, lists: pa.Table) -> pa.Table:
    """Members of one block, each with the distinct leaders of its lists that it has to be tested with.

    The row without a member names every leader that the block wants.
    """
    ids, index = np.unique(_column(lists, "ids").flatten().to_numpy(), return_inverse=True)
    n, root = (np.empty(len(ids), dtype=np.int64) for _ in range(2))
    n[index], root[index] = (_column(lists, name).flatten().to_numpy() for name in ("ns", "roots"))
    stops = np.concatenate([[0], np.cumsum(_lengths(_column(lists, "ids")))])
    led = {v: index[lo:hi] for v, lo, hi in zip(_column(lists, "value").to_pylist(), stops[:-1], stops[1:])}
    wanted = []
    for values, size, own in zip(*(members.column(name).to_pylist() for name in ("lists", "n", "root"))):
        met = np.zeros(len(ids), dtype=bool)
        for value in values:
            met[led[value]] = True
        met = np.flatnonzero(met)
        alike = np.minimum(n[met], size) * OF >= np.maximum(n[met], size) * SIMILAR
        wanted.append(ids[met[alike & (root[met] != own)]])
    new = members.select(["home", "block", "member"]).append_column("wanted", _longs(wanted))
    new = new.filter(pa.array([len(w) > 0 for w in wanted], pa.bool_()))
    every = pa.table([new.column("home")[:1], new.column("block")[:1], pa.nulls(min(1, len(new)), pa.int64()),
                      _longs([np.unique(np.concatenate(wanted))][:len(new)])], new.column_names)
    return pa.concat_tables([new.cast(every.schema), every])


def _block_hits(members: pa.Table, leaders: pa.Table) -> pa.Table:
    """(member, leader, part) of wanted pairs of one block that their sketches do not rule out.

    Up to the smaller of two sketches' last values both are complete, so their union there
    is a bottom-k sketch of the union with k of at least ``LONG_K``, and every value shared counts.
    """
    if not members.num_rows or not leaders.num_rows:
        return pa.table({"member": pa.array([], pa.int64()), "leader": pa.array([], pa.int64()),
                         "part": pa.array([], pa.int32())})
    top = np.iinfo(np.int64).max
    ids = _column(leaders, "leader").to_numpy()
    order = np.argsort(ids)
    rows = np.repeat(np.arange(members.num_rows), _lengths(_column(members, "wanted")))
    named = order[np.searchsorted(ids, _column(members, "wanted").flatten().to_numpy(), sorter=order)]
    asked = np.zeros((len(ids), members.num_rows), dtype=bool)
    asked[named, rows] = True

    size = _column(members, "n").to_numpy()
    held = _column(members, "low").flatten().to_numpy()
    ends = np.cumsum(_lengths(_column(members, "low")))
    starts, last = np.concatenate([[0], ends[:-1]]), np.where(size <= LONG_K, top, held[ends - 1])
    values = _column(leaders, "low").flatten().to_numpy()
    stops = np.concatenate([[0], np.cumsum(_lengths(_column(leaders, "low")))])
    known, code = np.unique(values, return_inverse=True)
    at = np.minimum(np.searchsorted(known, held), len(known) - 1)
    at[known[at] != held] = len(known)  # a value no leader holds
    mark = np.zeros(len(known) + 1, dtype=bool)
    hits = np.zeros_like(asked)
    for j, n in enumerate(_column(leaders, "n").to_numpy()):
        mine = slice(stops[j], stops[j + 1])
        end = top if n <= LONG_K else values[mine][-1]
        mark[code[mine]] = True
        agree = np.add.reduceat(mark[at], starts, dtype=np.int64)
        mark[code[mine]] = False
        union = (np.add.reduceat(held <= end, starts, dtype=np.int64)
                 + np.searchsorted(values[mine], last, side="right") - agree)
        # Sets no longer than the sketch are known whole: the rule itself decides.
        whole = (size <= LONG_K) & (n <= LONG_K)
        hits[j] = asked[j] & np.where(whole, agree * OF >= union * SIMILAR, agree * LONG_K >= union * LONG_NEEDED)
    leader, member = np.nonzero(hits)
    found = _column(members, "member").to_numpy()[member]
    parts = _column(leaders, "parts").to_numpy()[leader].astype(np.uint64)
    return pa.table({"member": found, "leader": ids[leader],
                     "part": (_mix(found.view(np.uint64)) % parts).astype(np.int32)})


def blocked_pairs(met: DataFrame, led: DataFrame, leaders: DataFrame, sets: DataFrame) -> DataFrame:
    """Estimated pairs (member, leader, part) of a round of many leaders a list.

    A member is one row, in a block of about ``BLOCK`` members that have the same longest
    list.  The leaders of their lists go to a block once as ids, from which each member takes
    those it wants, and then once as sketches, so refused pairs never become rows.  A block
    is one Arrow group: some 512 members and the leaders of their lists, 2 KB each.
    """
    low = sets.select("cls", F.size("shingles").cast("long").alias("n"), F.slice("shingles", 1, LONG_K).alias("low"))
    members = landed(
        met.groupBy(F.col("cls").alias("member"))
        .agg(F.max("n").alias("n"), F.max("root").alias("root"), F.max(F.struct("members", "value")).alias("longest"),
             F.collect_set("value").alias("lists"))
        .select("member", "n", "root", "lists", F.col("longest.value").alias("home"),
                F.pmod(F.xxhash64("member"), F.ceil(F.col("longest.members") / BLOCK)).cast("int").alias("block")),
        "block-members")
    held = landed(members.select("home", "block", F.explode("lists").alias("value")).distinct(), "block-lists")
    meet = join_groups(held, led, "value", "members").select(
        "home", "block", "value", *(F.col(f"leaders.{c}").alias(x) for c, x in (("cls", "ids"), ("n", "ns"), ("root", "roots"))))
    asked = landed(members.groupBy("home", "block").cogroup(meet.groupBy("home", "block")).applyInArrow(
        _wanted, "home long, block int, member long, wanted array<long>"), "block-wanted")
    leads = landed(asked.where(F.col("member").isNull()).select("home", "block", F.explode("wanted").alias("leader")),
                   "block-leaders")
    asks = leads.groupBy("leader").agg(F.count(F.lit(1)).alias("asks"))
    tables = landed(asks.join(low.withColumnRenamed("cls", "leader"), "leader").join(leaders, "leader"),
                    "leader-sketches")
    beside = join_groups(leads, tables, "leader", "asks").select("home", "block", "leader", "n", "low", "parts")
    tested = asked.where(F.col("member").isNotNull()).join(low.withColumnRenamed("cls", "member"), "member")
    pairs = landed(tested.groupBy("home", "block").cogroup(beside.groupBy("home", "block"))
                   .applyInArrow(_block_hits, "member long, leader long, part int"), "pairs")
    dropped(members, held, asked, leads, tables)
    return pairs


def link_classes(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(node, root) of classes linked to others; None without links."""
    met = inverted_lists(classes)
    lists, sets, edges, labels = met, None, None, None
    for width, linked_first in chain(ROUNDS, repeat(ROUNDS[-1])):
        before, (met, led, leaders) = met, _open(lists, labels, width, linked_first)
        dropped(before)
        if not led.limit(1).count():  # every list is one component
            dropped(met, led, leaders, *([] if sets is None else [sets]))
            return labels
        lists = met.where(~F.col("leads")).select("value", "cls", "n")
        if sets is None:
            pairs = landed(single_pairs(met, led, leaders, classes), "pairs")
            named = pairs.select(F.explode(F.array("member", "leader")).alias("cls"))
            sets = full_sets(docs, classes, named.unionByName(lists.select("cls")))
        else:
            pairs = blocked_pairs(met, led, leaders, sets)
        if pairs.limit(1).count():
            links = landed(verified(pairs, leaders, sets), "links")
            edges = links if edges is None else edges.unionByName(links)
            if labels is not None:
                dropped(labels)
            labels = components(edges)
        dropped(led, leaders, pairs)
        if not lists.limit(1).count():
            dropped(met, sets)
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    with shuffles_end(docs.sparkSession):
        rows = sketches(docs)
        classes = classes_of(rows)
        labels = link_classes(docs, classes)
        member = classes.select("cls", "digest", "first", "rows")
        member = (member.withColumn("root", F.col("cls")) if labels is None else
                  member.join(labels.select(F.col("node").alias("cls"), "root"), "cls", "left")
                  .withColumn("root", F.coalesce("root", "cls")))
        member = landed(member, "members")
        dropped(classes, *([] if labels is None else [labels]))
        lowest = landed(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("size")),
                        "lowest")
        named = landed(join_groups(member, lowest, "root", "size").select("digest", "rows", "component_id"), "named")
        dropped(member, lowest)
    linked = join_groups(rows.where(F.col("digest").isNotNull()).select("doc_id", "n_shingles", "digest"),
                         named, "digest", "rows")
    alone = rows.where(F.col("digest").isNull()).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return (linked.select(*columns).unionByName(alone.select(*columns))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
