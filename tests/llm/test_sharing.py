"""Operators 11 to 13 against brute force, in the ways that change their plans, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.llm import components, importance, odd_sketch, prefix_trie
from factlens.llm.queries import QUERIES
from test_llm import EDGES, LONG, SF, documents, frame, words

SPACE = "[^\x20\x09-\x0D]+"


# 11

def brute_sequences(rows):
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def brute_trie(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
        ends[tuple(seqs[c])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=lambda r: r[:2])


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n_convs int, path string")


def test_op11_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(QUERIES["op11_prefix_trie"](spark, SF)) == brute_trie(brute_sequences(rows))


def test_op11_common_starts_and_edges(spark):
    rng = random.Random(5)
    rows = []
    for c in range(330):  # a common first turn, families of whole conversations, one long conversation
        n = 300 if c == 200 else rng.randrange(1, 9)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"t{rng.randrange(3) if t else 0}" if c % 3 else "same") for t in range(n)]
    rows += [(None, 0, "user", "lost"), (1000, None, None, None), (1000, None, None, None), (1000, 3, "user", ""), (1001, 7, "user", "a"), (1001, 7, "user", "A"), (1001, 7, "", "é😀"),
             (1057, 1, "user", LONG), (1058, 1, "user", LONG)]
    rows += [(2001 + i, 0, "user", "alone") for i in range(12)]  # there is no conversation 2000
    want = brute_trie(brute_sequences(rows))
    assert max(r[6] for r in want) and any(len(s) == 0 for s in brute_sequences(rows).values())
    seqs = prefix_trie.with_shared_starts(prefix_trie.sequences(turns(spark, rows)))
    for shard, most in ((2048, 1 << 18), (7, 1 << 18), (50, 40)):  # one shard, many, shards cut by turns
        assert trie_rows(prefix_trie.prefix_trie(seqs, shard, most)) == want


def test_op11_empty_and_text_ids(spark):
    assert prefix_trie.prefix_trie(prefix_trie.sequences(turns(spark, []))).collect() == []
    df = spark.createDataFrame([("b", 0, "user", "hi"), ("a", 0, "user", "hi"), ("a", 1, "user", "ho")], "conv_id string, turn long, role string, text string")
    got = trie_rows(prefix_trie.prefix_trie(prefix_trie.sequences(df)))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [("a", 0, None, 2), ("a", 1, "a", 2), ("a", 2, "a", 1)]


# 12

def brute_resample(rows, target, percent=10, max_n=1, buckets=10000, least=20, seed=2024):
    def feats(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    docs = [(i, feats(t), len(words(t))) for i, t in rows]
    s = Counter(b for _, f, _ in docs for b in f)
    t = Counter(b for x in target for b in feats(x))
    sn, tn = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (sn + buckets)) / ((s[b] + 1) * (tn + buckets))))
    out = []
    for i, f, n in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def resampled(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_op12_equals_brute_force(spark):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = resampled(QUERIES["op12_importance_resample"](spark, SF))
    assert got == brute_resample(documents(spark), target) and any(r[4] for r in got)


def test_op12_ties_runs_and_edges(spark):
    tied = [(i % 40, "alpha beta gamma " * 8) for i in range(200)]  # equal ids and texts: equal scores
    rows = EDGES + tied + [(None, "delta " * 30), (None, "delta " * 30)]
    target = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "item_id long, text string")
    for percent in (0, 10, 55, 100):
        got = resampled(importance.importance_resample(frame(spark, rows), target, percent=percent))
        want = brute_resample(rows, ["alpha beta", "", ""], percent=percent)
        assert got == want
    got = resampled(importance.importance_resample(frame(spark, rows), target, max_n=3, buckets=50, min_words=0, percent=30))
    assert got == brute_resample(rows, ["alpha beta"], 30, 3, 50, 0)
    assert importance.importance_resample(frame(spark, []), target).collect() == []
    names = spark.createDataFrame([(f"d{i}", "some words " * 15) for i in range(30)], "doc_id string, text string")
    ranks = [r["rank"] for r in importance.importance_resample(names, target, percent=50).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 16)) and len(ranks) == 30


# 13

def shingles(t, n=5):
    w = words(t, SPACE)
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
    return {tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def brute_near(rows, threshold=85):
    sets = [(i, shingles(t)) for i, t in rows]
    at = defaultdict(list)
    for r, (_, s) in enumerate(sets):
        for g in s:
            at[g].append(r)
    both = Counter((a, b) for rs in at.values() for x, a in enumerate(rs) for b in rs[x + 1:])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= threshold * (len(sets[a][1]) + len(sets[b][1]) - n):
            root[find(a)] = find(b)
    ids = defaultdict(list)
    for r, (i, _) in enumerate(sets):
        if i is not None:
            ids[find(r)].append(i)
    out = []
    for r, (i, s) in enumerate(sets):
        c = min(ids[find(r)], default=None) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def near(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_op13_equals_brute_force(spark):
    got = near(QUERIES["op13_odd_sketch"](spark, SF))
    assert got == brute_near(documents(spark)) and any(not r[3] for r in got)


def family(rng, n, length, edits, tag):
    """Copies of one text with up to ``edits`` changed words each, and chains where each changes the one before."""
    base = [f"{tag}{rng.randrange(10 ** 6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("crowd, block, star", [(4096, 1024, 4096), (16, 8, 4)])
def test_op13_families_and_chains(spark, crowd, block, star):
    rng = random.Random(11)
    texts = family(rng, 120, 200, 3, "a") + family(rng, 60, 150, 12, "b") + family(rng, 40, 90, 1, "c")
    chain = [f"k{i}" for i in range(300)]
    for step in range(25):  # neighbours are alike, ends are not
        chain = list(chain)
        chain[step * 8: step * 8 + 4] = [f"n{step}{j}" for j in range(4)]
        texts.append(" ".join(chain))
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 5000, texts[0]) for i in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(odd_sketch.odd_sketch_components(df, crowd=crowd, block=block, star=star)) == brute_near(rows)


def test_op13_edges(spark):
    rows = EDGES + [(10, "THE SAME few words"), (None, LONG), (11, "five words make one shingle"), (12, "five words make one Shingle")]
    assert near(odd_sketch.odd_sketch_components(frame(spark, rows))) == brute_near(rows)
    assert odd_sketch.odd_sketch_components(frame(spark, [])).collect() == []
    named = spark.createDataFrame([("b", "one two three"), ("a", "one two  three"), ("c", "none")], "doc_id string, text string")
    assert near(odd_sketch.odd_sketch_components(named)) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 1, "c", True)]


def test_op13_odd_sketches_estimate(spark):
    rng = np.random.default_rng(3)
    for similarity in (0.95, 0.85, 0.7):
        minhash = rng.integers(0, 2 ** 63, (400, odd_sketch.SAMPLES), dtype=np.uint64)
        other = np.where(rng.random(minhash.shape) < similarity, minhash, rng.integers(0, 2 ** 63, minhash.shape, dtype=np.uint64))
        x = np.bitwise_count(odd_sketch._sketches(minhash) ^ odd_sketch._sketches(other)).sum(axis=1)
        assert abs(odd_sketch.estimate(x).mean() - similarity) < 0.01
    assert odd_sketch.apart(1.0) == 0 and odd_sketch.apart(0.5) > odd_sketch.apart(0.8)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(400)] + [(1000 + i, 1000) for i in range(50)] + [(5, 5)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(401)} | {i: 1000 for i in range(1000, 1050)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
