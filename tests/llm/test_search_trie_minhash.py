"""Ranked search, conversation trie and bottom-k near-duplicates against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shiftlens.llm import graph, lexical, minhash, trie
from shiftlens.session import checkpoint_root

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# ---------------------------------------------------------------- ranked search

def brute_search(docs, items):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    live = [(i, Counter(t), len(t)) for i, t in terms if t]
    n_docs, n_terms = len(live), sum(n for _, _, n in live)
    df = Counter(t for _, c, _ in live for t in c)
    asked: dict = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, []).extend(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, counts, n in live:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in wanted if t in counts)
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(scored[:10], 1)]
    return sorted(out, key=str)


def test_search_odd_rows_ties_blocks_and_wide_items(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)] + ["Ça", "ÉTÉ", "x_y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .,; "), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (103, "w1 w2 w3"),
             (104, "w1 w2 w3"), (104, "w1 w2 w3"), (105, "W7 " * 400_000), (2**62 + 1, "w1 w2 w3 w4")]
    items = [(1, "w1 W1 w2"), (1, "w1 W1 w2"), (2, None), (3, "zzz nowhere"), (4, " ".join(words * 2)), (None, "w3 ça"),
             (5, "w5"), (5, "w6 w7")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("score", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    want = brute_search(docs, items)
    assert rows_of(lexical.search(d, b), "item_id", "rank", "doc_id", "score") == want
    assert rows_of(lexical.search(d, b, block_bytes=200), "item_id", "rank", "doc_id", "score") == want
    assert lexical.search(d.limit(0), b).count() == 0 and lexical.search(d, b.limit(0)).count() == 0


def test_search_stops_early_without_changing_the_list():
    rng = np.random.default_rng(3)
    n_docs, n_terms = 3000, 70
    counts = rng.poisson(0.2, (n_docs, n_terms))
    docs, terms = np.nonzero(counts)
    offsets = np.concatenate([[0], np.cumsum((counts > 0).sum(axis=1))])
    weights = rng.integers(1, 9000, n_terms)
    m = rng.integers(25, 200, n_docs)
    tfs = counts[docs, terms].astype(np.int64)
    asked, repeats = np.arange(n_terms), rng.integers(1, 3, n_terms)
    gain = np.where(counts > 0, weights * ((10**9 * counts) // (1000 * counts + 8 * m[:, None])), 0) @ repeats
    best = lexical.TopList()
    for at in range(0, n_docs, 500):
        lo, hi = offsets[at], offsets[at + 500]
        chunk = lexical.Chunk(np.arange(at, at + 500), np.zeros(500, dtype=bool), m[at:at + 500],
                              offsets[at:at + 501] - lo, terms[lo:hi], tfs[lo:hi], weights, m[at:at + 500])
        chunk.search(asked, repeats, best)
    order = np.lexsort((np.arange(n_docs), -gain))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == gain[order].tolist()


# ---------------------------------------------------------------- conversation trie

def brute_trie(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    nodes: dict = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children: dict = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in children.get(k, [])) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children.get(k, [])),
                    leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bound", [trie.GROUP_TURNS, 12])
def test_trie_deep_shared_odd_and_hot(spark, bound):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randint(1, 3))
            for c in range(95, 140) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", f"long {t}" if t < 20 + c % 3 else f"tail {c} {t}") for c in range(300, 306) for t in range(26)]
    rows += [(-7, 1, "user", "é" * 3), (-7, 1, "user", "é" * 3), (-7, None, None, None), (-100, 0, "system", "head"),
             (None, 1, "user", "lost"), (2**62, 3, "user", "big id"), (500, 1, "u", "x"), (600, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame(rows, CONV).withColumn("depth", F.lit("clash")).withColumn("key", F.lit(3))
    assert rows_of(trie.prefix_trie(df, bound), *TRIE) == brute_trie(rows)


def test_trie_copies_turnless_and_empty(spark):
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(3)]
    turnless = [(7701, 0, "user", "gone with the missing base")]  # its base is absent and its head longer
    assert zlib.crc32(b"7701") % 6 >= 1
    df = spark.createDataFrame(copies + turnless, CONV)
    assert rows_of(trie.prefix_trie(df), *TRIE) == brute_trie(copies + turnless)
    assert trie.prefix_trie(df.limit(0)).count() == 0


# ---------------------------------------------------------------- bottom-k near-duplicates

def brute_links(docs):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        return {tuple(w[i:i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    groups: dict = {}
    for i, (doc, _) in enumerate(docs):
        groups.setdefault(top(i), []).append(doc)
    low = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, len(sets[i]), low[top(i)], d == low[top(i)]) for i, (d, _) in enumerate(docs)), key=str)


MINHASH = ("doc_id", "n_shingles", "component_id", "kept")


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


def test_links_equal_brute_force(spark):
    rng = random.Random(11)
    docs, at = [], 2**60
    for length in (3, 5, 9, 30, 60, 66, 90, 300):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        for _ in range(8):
            docs.append((at, " ".join(changed(rng, base, rng.randint(0, max(1, length // 22))))))
            at += 1
    passage = [f"p{i}" for i in range(170)]  # many documents of one passage and a fifth of their own, not linked
    for _ in range(40):
        docs.append((at, " ".join(passage + [f"own{rng.random()}" for _ in range(25)])))
        at += 1
    for step in range(12):  # a chain: neighbours are linked, its ends are not
        docs.append((at, " ".join(f"c{i}" for i in range(step * 9, step * 9 + 100))))
        at += 1
    docs += [(1, None), (2, ""), (3, " \n"), (None, "a lost id with words"), (4, "A lost ID with words"), (5, "one"),
             (5, "One"), (6, "one two"), (7, "word " * 200_000), (8, "x " * 9), (8, "a lost id with words"), (None, None)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).withColumn(
        "digest", F.lit("clash"))
    assert rows_of(minhash.near_duplicates(df), *MINHASH) == brute_links(docs)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert rows_of(minhash.near_duplicates(df.where("doc_id = 5")), *MINHASH) == [(5, 1, 5, True)] * 2


def test_hot_leaders_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_A_PART", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(changed(rng, base, rng.randint(0, 5)))) for i in range(60)]
    assert rows_of(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), *MINHASH) == brute_links(docs)


def test_components_of_hub_chain_and_ring(spark):
    edges = [(5, i) for i in range(100, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 8), (8, 9), (9, 7)]
    got = dict(tuple(r[:2]) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 5 for i in [5, *range(100, 300)]}, **{i: 1000 for i in range(1000, 1041)}, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("long_k, needed", [(256, 156), (64, 28)])
def test_blocks_refuse_alike_texts_and_find_links(spark, monkeypatch, long_k, needed):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "LONG_K", long_k)
    monkeypatch.setattr(minhash, "LONG_NEEDED", needed)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(changed(rng, base, rng.randint(0, 40)))) for i in range(150)]  # few of them are linked
    got = rows_of(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), *MINHASH)
    assert got == brute_links(docs) and 1 < len({r[2] for r in got}) < 150


def test_finished_tables_and_shuffles_leave_the_disk(spark, monkeypatch):
    from shiftlens.llm import common

    key, folders = common.SHUFFLE_CLEANUP, Path(checkpoint_root(spark).removeprefix("file:"))
    cleaned, write = [], minhash.landed
    monkeypatch.setattr(minhash, "landed", lambda df, name: (cleaned.append(spark.conf.get(key)), write(df, name))[1])
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(changed(rng, base, rng.randint(0, 40)))) for i in range(60)]
    before = set(folders.iterdir())
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    left = {p.name.removeprefix("shiftlens-").rsplit("-", 1)[0] for p in set(folders.iterdir()) - before}
    assert left <= {"sketches", "named", "links"}
    assert set(cleaned) == {"true"} and spark.conf.get(key) == "false"
    assert rows_of(out, *MINHASH) == brute_links(docs)


def test_wanted_leaders_of_a_block_by_hand():
    members = pa.table({"home": [1, 1, 1], "block": pa.array([0, 0, 0], pa.int32()), "member": [10, 11, 12],
                        "n": [100, 100, 50], "root": [10, 20, 12], "lists": pa.array([[1, 2], [1], [2]])})
    lists = pa.table({"value": [2, 1], "ids": pa.array([[20, 30], [20, 21, 10]]),
                      "ns": pa.array([[90, 70], [90, 125, 100]]), "roots": pa.array([[20, 30], [20, 21, 10]])})
    got = minhash._wanted(members, lists).to_pydict()
    # 20 is met in two lists and wanted once; 30 and member 12 differ too much in size; 11 has the root of 20
    assert got["member"] == [10, 11, None] and got["wanted"] == [[20, 21], [10, 21], [10, 20, 21]]
