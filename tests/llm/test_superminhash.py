"""Signatures against the sequential algorithm, union-find, and groups against brute force over all pairs."""

import random
import re

import numpy as np

from qaflow.llm import superminhash as S
from qaflow.llm.jaccard_join import mixed, sets

SCHEMA = "doc_id bigint, text string, node string, n int, key string, buckets int, comp int, id string"


def one_by_one(tokens, slots):
    """The algorithm for one set, shingle by shingle with early stopping."""
    least = [0xFFFFFFFFFFFFFFFF] * slots
    for t in tokens:
        order = list(range(slots))
        for j in range(slots):
            if max(least) < j << 56:
                break
            draw = int(mixed(np.array([np.uint64(t) + S.salt(2 * j + 1)]))[0])
            k = j + int(mixed(np.array([np.uint64(t) + S.salt(2 * j + 2)]))[0]) % (slots - j)
            order[j], order[k] = order[k], order[j]
            least[order[j]] = min(least[order[j]], j << 56 | draw >> 8)
    return least


def test_signatures_equal_the_sequential_ones(monkeypatch):
    rng = np.random.default_rng(0)
    own = [rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (1, 2, 7, 40, 300)]
    owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
    with np.errstate(over="ignore"):
        want = [one_by_one(x, 16) for x in own]
        for step in (1 << 15, 11):  # sets cut between steps
            monkeypatch.setattr(S, "STEP", step)
            assert S.signatures(np.concatenate(own), owner, len(own), 16).tolist() == want


def test_estimate_and_bands():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for both, each in ((80, 10), (30, 35), (400, 50)):
            found, hits = [], 0
            for _ in range(60):
                x = rng.integers(0, 1 << 63, both + 2 * each).astype(np.uint64)
                a, b = x[: both + each], np.concatenate([x[:both], x[both + each :]])
                sig = S.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
                found.append((sig[0] == sig[1]).mean())
                hits += (S.buckets(sig)[0] == S.buckets(sig)[1]).any()
            true = both / (both + 2 * each)
            assert abs(np.mean(found) - true) < 0.02
            assert np.var(found) < true * (1 - true) / S.SLOTS * 1.3
            assert hits == 60 if true >= 0.8 else True


def brute(rows, width=S.WIDTH):
    own = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own.append({tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            if a and own[j] and 100 * len(a & own[j]) >= 80 * len(a | own[j]):
                up[root(i)] = root(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[root(i)] = min(names.get(root(i), d), d)
    return [(d, len(own[i]), names.get(root(i)), d == names.get(root(i))) for i, (d, _) in enumerate(rows)]


def made(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["γάμμα", "日本", "Zeta"]
    rows = [(None, "one two three four five six"), (None, None), (7, None), (8, ""), (9, " \t\n"), (10, "Alone"), (11, "aLONE"), (12, "a b c"), (13, "A B C D"), (14, "a b c d")]
    n = 20
    for size in (5, 9, 30, 120, 900):
        for _ in range(6):
            base = [rng.choice(vocab) for _ in range(size)]
            for _ in range(6):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 30))):
                    copy[rng.randrange(size)] = f"new{rng.randint(0, 99)}"
                rows.append((n, " ".join(copy)))
                n += 1
    long = " ".join(rng.choice(vocab) + str(rng.randint(0, 9999)) for _ in range(20000))
    rows += [(n, long), (n + 1, long + " tail"), (n + 1, long), (None, long + " other tail")] + [(5000 + k, "the very same text in many rows") for k in range(60)]
    rng.shuffle(rows)
    return rows


def key(r):
    return tuple((x is not None, x) for x in r)


def test_groups_equal_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        df = spark.createDataFrame([(d, t, "x", 1, "k", 2, 3, "i") for d, t in rows], SCHEMA).repartition(4)
        out = S.near_duplicates(df)
        assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        got = sorted((tuple(r) for r in out.collect()), key=key)
        want = [(d, n, c, d == c) for d, n, c, _ in brute(rows)]
        assert got == sorted(want, key=key)
    assert S.near_duplicates(df.limit(0)).count() == 0
    only = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id bigint, text string")
    assert sorted(map(tuple, S.near_duplicates(only).collect())) == [(1, 1, 1, True), (2, 0, 2, True)]
    kept = S.without_near_duplicates(df)
    assert kept.columns == df.columns
    left = [r.text for r in kept.collect()]
    own = [x for x in sets(left, S.WIDTH) if len(x)]
    assert sum(t == "the very same text in many rows" for t in left) == 1 and len(own) > 10


def test_text_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "else")]
    got = sorted(map(tuple, S.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()))
    assert got == [("a", 3, "a", True), ("b", 3, "a", False), ("c", 1, "c", True)]


def test_forest(spark):
    rng = random.Random(3)
    links = [(bytes([rng.randint(0, 60)]), bytes([rng.randint(0, 60)])) for _ in range(50)]
    trees = S.Forest()
    for a, b in links:
        trees.link(a, b)
    got = {bytes(r.node): bytes(r.component) for r in S.components(S.forest(spark.createDataFrame(links, "a binary, b binary").repartition(3)), "a", "b").collect()}
    assert got == {x: trees.root(x) for x in trees.up if x in got}
    assert all(x in got for x in trees.up if any(trees.root(y) == trees.root(x) for y in trees.up if y != x))
