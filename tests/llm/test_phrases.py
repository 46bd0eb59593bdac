"""The filter's round trip and merge; phrases against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from qaflow.llm import phrases as P
from qaflow.llm import quotient_filter as qf

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int, rank int, chunk string, w1 string"


@pytest.mark.parametrize("bits,shard_bits", [(1, 0), (2, 2), (9, 3), (17, 4), (21, 0), (32, 5)])
def test_filter_round_trip(bits, shard_bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, (3000, 3))
    ids[:1000] = ids[0]
    high, low = qf.permuted(ids, bits)
    assert (qf.restored(high, low, bits) == ids).all()
    assert len(set(zip(high.tolist(), low.tolist()))) == len({tuple(x) for x in ids.tolist()})
    wanted: dict[int, Counter] = defaultdict(Counter)
    by_shard = defaultdict(list)
    for part in np.array_split(np.arange(len(ids)), 4):
        h, lo, c = qf.tallied(high[part], low[part], None, bits)
        shard = (h >> np.uint64(bits - shard_bits)).astype(int)
        for s in np.unique(shard):
            here = shard == s
            data = qf.build(h[here], lo[here], c[here], bits, shard_bits)
            back = qf.entries(data)
            assert all((x == y).all() for x, y in zip(back, (h[here], lo[here], c[here]), strict=True))
            by_shard[s].append(data)
            for row, k in zip(qf.restored(h[here], lo[here], bits).tolist(), c[here].tolist(), strict=True):
                wanted[s][tuple(row)] += k
    total = 0
    for s, parts in by_shard.items():
        h, lo, c = qf.entries(qf.merged(parts))
        assert dict(zip(map(tuple, qf.restored(h, lo, bits).tolist()), c.tolist(), strict=True)) == dict(wanted[s])
        total += int(c.sum())
    assert total == len(ids)


def test_large_counts():
    h, lo = np.array([1, 2, 5], np.uint64), np.array([9, 9, 9], np.uint64)
    c = np.array([254, 255, 1 << 40])
    assert qf.entries(qf.merged([qf.build(h, lo, c, 8, 0)] * 2))[2].tolist() == [508, 510, 1 << 41]
    empty = qf.build(h[:0], lo[:0], c[:0], 8, 0)
    assert [len(x) for x in qf.entries(empty)] == [0, 0, 0]


def brute(rows, least, top, inside):
    f: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        n = sum(c for w, c in own.items() if len(w) == 1)
        found = []
        for w, a in own.items():
            if len(w) == 1 or a < least:
                continue
            if len(w) == 2 and any(len(v) == 3 and c >= least and w in (v[:2], v[1:]) and 100 * c >= inside * a for v, c in own.items()):
                continue
            score, k = min((1000000 * a * a // (own[w[:k]] * own[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), own[w[:k]], own[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made():
    rng = random.Random(5)
    vocab = ["new", "york", "city", "of", "the", "São", "Paulo", "日本", "x y", "a\x1cb", "to", "be", "or", "not"]
    rows = []
    for k in range(160):
        text = "".join(rng.choice(vocab) + rng.choice([" ", "  ", "\t", ". ", ",", "\r\n", " ", " "]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text + " New York City" * rng.randint(0, 2)))
    rows += [("en", None), (None, None), ("zz", ""), ("en", "a" * 70000 + " b c"), ("en", "the " * 30000), ("de", "eins zwei " * 12)]
    return rows + [("fr", "la vie en rose. la vie")] * 25


def test_phrases_equal_brute_force(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame([(i, t, lang, "p", 1, 2, "c", "w") for i, (lang, t) in enumerate(rows)], SCHEMA)
    for parts, top, chunk in ((1, 2000, 1 << 19), (7, 5, 1 << 19)):
        out = P.collocations(df.repartition(parts), top=top)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == brute(rows, 10, top, 50)
    assert P.collocations(df.limit(0)).count() == 0
    assert P.collocations(spark.createDataFrame([("once only", "en")], "text string, lang string")).count() == 0


def test_exact_scores(spark):
    big = [(10**14 + 7, 10**15 - 1, 10**16 + 3), (3, 7, 9), (10, 10, 10)]
    got = spark.createDataFrame(big, "a bigint, l bigint, r bigint").select(P._score("a", "l", "r")).collect()
    assert [r[0] for r in got] == [1000000 * a * a // (x * y) for a, x, y in big]


def test_chunks_and_sizes():
    own = P.Chunk()
    own.add(b"A b.c\xc3\x89\tA")
    assert list(own.codes) == [1, 2, 0, 3, 1, 0] and list(own.ids) == [b"\n", b"a", b"b", b"c\xc3\x89"]


def test_merged_filters_stay_in_one_python_worker(spark):
    laid = P.chunks(spark.createDataFrame([(i, "a b c a b", "en") for i in range(20)], "doc_id long, text string, lang string").repartition(3)).localCheckpoint()
    words = P.vocabulary(laid, 2).localCheckpoint()
    found = P.frequent(P.filters(laid, words, 2, 1), 2, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "").replace("FlatMapCoGroupsInArrow", "")
    ids = {r.word: r.id for r in words.collect()}
    got = {(r.w1, r.w2, r.w3): r.a for r in found.collect()}
    a, b, c = ids["a"], ids["b"], ids["c"]
    assert got == {(a, b, 0): 40, (b, c, 0): 20, (c, a, 0): 20, (a, b, c): 20, (b, c, a): 20, (c, a, b): 20}
