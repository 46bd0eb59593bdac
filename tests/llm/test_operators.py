"""Edge rows (nulls, empty and long texts, ties, repeated rows, empty tables, extra columns) against brute force."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from qaflow.llm import bpe_tree, decontaminate, html_crf, huffman_tokens, jaccard_join, kd_shards, line_templates, simhash, toxicity, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid int, sig string"
BASE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    long = " ".join(rng.choice(("alpha", "beta", "γάμμα", "x1", "日本語", "😀")) + str(rng.randint(0, 999)) for _ in range(6000))
    rows = [(1, BASE), (2, BASE + " tail"), (3, None), (4, ""), (5, "  \n "), (6, "One two"), (7, "one TWO"), (8, long), (9, "a" * 5000),
            (None, BASE), (11, "Share this page now\nkeep me safe here\n\nvalue 12 of the day"), (12, "Share this page now\nvalue 13 of the day"),
            (13, "Share this page now\nx"), (1, BASE)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, None, "s", None, 0, "z") for d, t in texts], SCHEMA).repartition(3)


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def test_tree_bpe_equals_library():
    ranks = bpe_tree.load_ranks(public_tokenizers.path(bpe_tree.RANKS_FILE))
    tree = bpe_tree.TreeBPE(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, old = random.Random(1), bpe_tree.LEAF_CHARS
    bpe_tree.LEAF_CHARS = 8
    try:
        for _ in range(1500):
            x = "".join(rng.choices(["a", "the", " ", "  ", "\n", "'s", "é", "1", "!!", "　", "日本", "😀", "aaaa", "ing", "\t"], k=rng.randint(0, 60)))
            assert list(array("I", tree.encode(x))) == library.encode_ordinary(x)
        for c in "aé=":
            assert list(array("I", tree.encode(c * 700))) == library.encode_ordinary(c * 700)
    finally:
        bpe_tree.LEAF_CHARS = old


def test_bpe_rows(spark, docs, texts):
    ranks = bpe_tree.load_ranks(public_tokenizers.path(bpe_tree.RANKS_FILE))
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in texts:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe_tree.encode_decode(docs).collect()), key=key) == sorted(want, key=key)
    assert bpe_tree.encode_decode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n,top", [(1, 16), (2, 16), (5, 3), (300, 9), (40000, 16)])
def test_huffman_round_trip(n, top):
    rng = np.random.default_rng(n)
    counts = np.minimum(rng.pareto(0.5, n) * 3 + 1, 1e12).astype(np.int64)
    lengths = huffman_tokens.code_lengths(counts, top)
    assert lengths.max() <= top and (n == 1 or abs(sum(2.0 ** -lengths.astype(float)) - 1) < 1e-9)
    codes, table, size = huffman_tokens.canonical(lengths)
    for k in (0, 1, 1023, 1024, 1025, 5000):
        ids = rng.choice(n, k).astype(np.uint32)
        payload, at = huffman_tokens.pack(ids, codes, lengths)
        assert (huffman_tokens.unpack(payload, k, at, table, size) == ids).all()


def test_token_files(spark, texts):
    # the library's default: the string of a special token is one id
    texts = [*texts, (21, "end <|endoftext|> of text"), (22, "<|endoftext|>"), (23, "a<|endoftext|>b  <|endoftext|> c\n <|endoftext|>\n"), (24, "x <|endoftext|>y <|endoftext|> <|endoftext|>")]
    docs = spark.createDataFrame([(d, t, None, "s", None, 0, "z") for d, t in texts], SCHEMA).repartition(3)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(huffman_tokens.TOKENIZER_FILE))
    want, start = [], 0
    for d, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = huffman_tokens.read_tokens(spark, huffman_tokens.write_tokens(docs)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = huffman_tokens.read_tokens(spark, huffman_tokens.write_tokens(docs.limit(0).withColumn("doc_id", docs["doc_id"].cast("string"))))
    assert empty.count() == 0 and dict(empty.dtypes)["doc_id"] == "string"
    named = spark.createDataFrame([("b", "two words"), ("a", "one")], "doc_id string, text string")
    assert [(r.doc_id, r.start) for r in huffman_tokens.read_tokens(spark, huffman_tokens.write_tokens(named)).orderBy("start").collect()] == [("a", 0), ("b", 2)]


def test_decontamination_edges(spark, docs):
    bench = spark.createDataFrame([(10, " ".join(f"w{i}" for i in range(5, 17))), (9, "ONE two"), (8, ""), (7, None), (9, "one-two")], "item_id bigint, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.scan(docs, bench).collect()}
    assert (1, 60, 12, 1, True) in got and (None, 60, 12, 1, True) in got and (6, 2, 2, 1, True) in got and (7, 2, 2, 1, True) in got and (3, 0, 0, 0, False) in got
    assert decontaminate.scan(docs, bench).count() == docs.count()
    assert decontaminate.scan(docs, bench.limit(0)).filter("contaminated").count() == 0
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 6
    cut = decontaminate.clean(docs, bench, spans=True)
    assert cut.count() == docs.count() and decontaminate.scan(cut, bench).filter("contaminated").count() == 0


def test_line_templates_edges(docs):
    out = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_templates.drop_lines(docs).collect() if r.doc_id in (3, 4, 11, 12, 13)}
    assert out == {
        (3, 0, 0, None), (4, 1, 0, ""), (11, 4, 0, "Share this page now\nkeep me safe here\n\nvalue 12 of the day"), (12, 2, 1, "value 13 of the day"), (13, 2, 1, "x"),
    }
    kept = line_templates.without_repeated_lines(docs)
    assert kept.columns == docs.columns and line_templates.drop_lines(docs.limit(0)).count() == 0


def test_lines_of_figures_stay(spark):
    rows = [(i, f"{i} 30 45 6\n2021-01-0{i} 00:1{i} 41 {i}7 x\nsame 2021 07 line\nvalue {i} of the day\nshare this page  now") for i in range(1, 5)]
    rows += [(i, f"{i} {i * 7} 0.{i}") for i in range(5, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_templates.without_repeated_lines(docs).collect()}
    assert got == {1: rows[0][1]} | {i: "\n".join(t.split("\n")[:2]) if i < 5 else t for i, t in rows[1:]}


def test_long_lines_without_blanks_are_dropped(spark):
    line = "このページをあなたの友達と共有してください。"
    docs = spark.createDataFrame([(i, f"Les.\n{line}\n{i} {chr(97 + i) * 20}") for i in range(1, 5)], "doc_id bigint, text string")
    got = {r.doc_id: line in r.text for r in line_templates.without_repeated_lines(docs).collect() if "Les." in r.text}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_jaccard_edges(docs, texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = []
    for i, (d, _) in enumerate(texts):
        ids = [texts[k][0] for k in range(len(texts)) if group[k] == group[i] and texts[k][0] is not None]
        want.append((d, len(sets[i]), min(ids)))
    assert sorted(map(tuple, jaccard_join.similar_groups(docs).collect()), key=key) == sorted(want, key=key)


def test_jaccard_short_texts_only(spark):
    rows = [(5, "two words"), (2, "Two  words"), (3, "other"), (4, "")]
    for part in (rows[:1], rows):
        docs = spark.createDataFrame(part, "doc_id bigint, text string").coalesce(1)
        want = [(5, 1, 5)] if len(part) == 1 else [(2, 1, 2), (3, 1, 3), (4, 0, 4), (5, 1, 2)]
        assert sorted(map(tuple, jaccard_join.similar_groups(docs).collect())) == want


def test_jaccard_rows_without_ids_and_repeated_rows(spark):
    a = [f"a{i}" for i in range(60)]
    near, far = " ".join([*a, "x"]), " ".join([*a, "x", *(f"y{i}" for i in range(14))])
    other, again = " ".join(f"o{i}" for i in range(30)), " ".join(f"p{i}" for i in range(30))
    # 7 and 4 are linked through a row without an id only; 9 has two texts that have nothing in common
    rows = [(7, " ".join(a)), (None, near), (4, far), (9, other), (9, again), (None, " ".join(f"n{i}" for i in range(40))), (8, ""), (None, None)]
    rows.append((None, rows[5][1] + " end"))
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows * 2)], "doc_id bigint, text string, rid int").repartition(4)
    got = sorted(map(tuple, jaccard_join.similar_groups(docs).collect()), key=key)
    want = [(7, 56, 4), (None, 57, 4), (4, 71, 4), (9, 26, 9), (9, 26, 9), (None, 36, None), (8, 0, 8), (None, 0, None), (None, 37, None)] * 2
    assert got == sorted(want, key=key)
    kept = jaccard_join.one_of_each(docs)
    kept_rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(d for d, t in kept_rows if d is not None) == [4, 8, 9, 9]
    assert sum(d is None and t is not None for d, t in kept_rows) == 1 and sum(t is None for _, t in kept_rows) == 2


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    sketch = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint32)
    for trial in range(300):
        n = int(rng.integers(2, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        sketch[:] = 0
        sketch[(a & np.uint64(len(sketch) - 1)).astype(np.int64)] = rng.choice([1, 500], len(a))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 1 << 63, int(rng.integers(0, n // 10 + 1))).astype(np.uint64)]))
        if len(b) and jaccard_join.overlap_links(a, b) and len(a) != len(np.intersect1d(a, b)):
            assert len(np.intersect1d(jaccard_join.signatures(a, sketch, 64), jaccard_join.signatures(b, sketch, 64))), trial


def test_simhash_edges(docs, texts):
    got = simhash.compare(docs).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == "0" * 16 and by[6].fingerprint == by[7].fingerprint
    assert by[1].fingerprint == by[None].fingerprint and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert simhash.compare(docs.limit(0)).count() == 0


def test_simhash_columns(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = {i: " ".join(rng.choices(words, k=rng.randint(1, 80))) for i in range(0, 160, 10)}
    rows |= {3: rows[50], 104: rows[100] + " w1", 7: ""}
    ids = sorted(rows)
    follows = {i: rows[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    edited = {i: t[: len(t) - len(t) // 2] + follows[i][: len(t) // 2] for i, t in rows.items()}
    make = lambda texts: {r.doc_id: r for r in simhash.compare(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    got, again = make(rows), make(edited)
    fp = {i: int(r.fingerprint, 16) for i, r in got.items()}
    differ = lambda a, b: (a ^ b).bit_count()
    for k, i in enumerate(ids):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(rows[i]), hashlib.sha256(edited[i].encode()).hexdigest())
        assert r.edited_fingerprint == again[i].fingerprint
        assert r.near_edited == 1 - differ(fp[i], int(r.edited_fingerprint, 16)) / 64
        assert r.near_next == 1 - differ(fp[i], fp[ids[(k + 1) % len(ids)]]) / 64
        assert r.n_near == (sum(differ(fp[i], f) <= 3 for f in fp.values()) - 1 if i % 50 == 0 else None)
    assert got[50].n_near >= 1


def test_simhash_search_is_exact(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(63) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(63), k)) for f in fps for k in (1, 2, 3, 4)]
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {r.fp: r.found for r in simhash.near(df.limit(len(fps)), df).collect()}
    assert got == {f: sum(bin(f ^ g).count("1") <= 3 for g in fps) for f in set(fps)}


def test_shards_edges(docs, texts):
    got = kd_shards.shard(docs, 3).collect()
    assert len(got) == len(texts) and sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 8 for _, t in texts)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 0 <= s < 3
    assert kd_shards.shard(docs.limit(0)).count() == 0


def test_warc_edges(spark):
    rows = [(1, "u", "x"), (2, "v\r\nw", "x"), (3, None, None), (4, "e", ""), (None, "n", "z"), (6, "n", "z\r\n\r\nq"), (6, "n", "z\r\n\r\nq")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload string")
    path = warc.archive(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()), key=key)
    want = [(p, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "revisit" if p in (1, 3) else "response", {1: 2, 3: 4}.get(p)) for p, _, h in rows]
    assert got == sorted(want, key=key)
    assert {r.page_id for r in warc.read(spark, path, payload=False).filter("record_type = 'revisit'").collect()} == {1, 3}
    assert warc.read(spark, warc.archive(pages.limit(0))).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=40) + (["vile", "nasty"] if i % 5 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, None), (601, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600, 2)] + [(None, 1), (1, None), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == (i % 5 == 0) for i in range(1, 600, 2)) >= 295 and not got[None] and not got[601]
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert (np.diff(model.thresholds) > 0).all()
    nothing = toxicity.train(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(docs, nothing).collect())


def test_ordinal_gradient_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 3)).astype(float)
    grade = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=400) > 0).astype(int) + (x @ [2.0, -1.0, 0.0] + rng.logistic(size=400) > 2.5)
    w, th = toxicity.fit_ordinal(x, grade)
    assert w[0] > 0.5 > 0 > w[1] and th[0] < th[1]


def test_html_blocks_and_field(spark):
    rng = random.Random(11)
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "x", "<p>a&amp;b <b>c</b>d<br>e</p"), (4, "y", "<article><h1>T</h1><p>One  two.\n<p>Three four.</article><footer>&copy; z</footer>")],
                                  "page_id bigint, url string, html string")
    field = html_crf.train(pages)
    right = total = 0
    for _ in range(100):
        page, labels = html_crf.labelled_page(rng)
        got = html_crf.blocks(page)
        assert len(got) == len(labels)
        right, total = right + sum(a == b for a, b in zip(field.decode(html_crf.found_in(got)), labels, strict=True)), total + len(labels)
    assert right / total > 0.97
    out = {r.page_id: (r.text, r.n_chars) for r in html_crf.extract(pages, field).collect()}
    assert out[1] == ("", 0) and out[2] == ("", 0) and out[4] == ("T One two. Three four.", 22)
    assert [b[1] for b in html_crf.blocks("<p>a&amp;b <b>c</b>d<br>e</p")] == ["a&b cd e"]
    assert html_crf.extract(pages.limit(0), field).count() == 0


def test_html_hidden_elements_end():
    article = "<article><p>One two.</p><p>Three.</p></article>"
    for before in ('<svg class="i"/>', "<svg/>", "<svg-icon name=x></svg-icon>", "<button-group></button-group>", "<select-box>", "<div><button>Menu</div>", "<button>Menu", "<object data=x>old",
                   "<select><option>a<option>b</select>", "<select><option>a", "<div><template><p>no</div>", "<div><iframe src=x></div>", '<iframe src="x"/>', '<script src="x"/>', "<svg><title>no</title>",
                   "<svg><g><p></p></svg>", "<noscript><img src=x></noscript>", "<style>p{}</style >", "<textarea><p>no</textarea>", "<scripted></scripted>", "<svg><foreignObject><div>no</div></foreignObject></svg>"):
        for page in (f"<body>{before}{article}</body>", f"<body><header>{before}</header>{article}</body>"):
            assert [b[1] for b in html_crf.blocks(page)] == ["One two.", "Three."], page
    assert [b[1] for b in html_crf.blocks("<p>a <button><b>x</b><p>y</button>b<svg><path/><a>z</a></svg> c</p>d")] == ["a b c", "d"]
    assert [b[1] for b in html_crf.blocks("<p>a <button><b>x</b></button>b<svg><path/><a>z</a></svg> c</p><script>x</script>d")] == ["a b c", "d"]
    assert [b[1] for b in html_crf.blocks("<p>a</p><script>var b = '<p>c'")] == ["a"]


def test_bitmaps_never_rule_out_a_linked_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 3000)), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(len(a) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, int(len(a) * rng.uniform(0, 0.2)), dtype=np.uint64)]))
        differ = sum((int(x) ^ int(y)).bit_count() if (x ^ y) >= 0 else ((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(jaccard_join.parities(a), jaccard_join.parities(b), strict=True))
        assert differ <= len(np.setxor1d(a, b))
        if jaccard_join.overlap_links(a, b):
            assert differ * 9 <= len(a) + len(b)
