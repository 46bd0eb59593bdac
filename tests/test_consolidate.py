import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaflow.functions.text import word_tokens
from qaflow.operators import consolidate as CO
from tests.fixtures import contexts_df, meta, plain

# formatted lengths 4, 8 and 11: with the line end each gains one
ROWS = [plain("p", "tea", 1), plain("q", "saffron", 2), plain("r", "cinnamon s", 3)]


def _arr(spark, rows, strategy, limit, counter=None):
    df = contexts_df(spark, [("e", rows)])
    kw = {} if counter is None else {"token_counter": counter}
    r = df.select(CO.consolidate_array(F.col("contexts"), strategy, limit, **kw).alias("r")).first().r
    return [(c.doc_id, c.text) for c in r.contexts], r.error


def _long(spark, rows, strategy, limit):
    df = contexts_df(spark, [("e", rows)]).select("event_id", F.inline("contexts"))
    out = CO.consolidate_long(df, strategy, limit).orderBy("pos").collect()
    return [(r.doc_id, r.text) for r in out], (out[0].error if out else None)


@pytest.mark.parametrize("form", [_arr, _long])
@pytest.mark.parametrize("limit", [23, 400])
def test_all_fit(spark, form, limit):
    assert form(spark, ROWS, "simple", limit) == ([("p", "tea\n"), ("q", "saffron\n"), ("r", "cinnamon s\n")], None)


@pytest.mark.parametrize("form", [_arr, _long])
@pytest.mark.parametrize("limit", [0, 3, 11])
def test_an_overflow_before_the_last_is_an_error(spark, form, limit):
    got, err = form(spark, ROWS, "simple", limit)
    assert err == f"token_limit={limit} Documents: (i='p' length=4),(i='q' length=8),(i='r' length=11)"
    # in retrieval order; those that were placed are formatted
    assert got == [("p", "tea\n" if limit >= 4 else "tea"), ("q", "saffron"), ("r", "cinnamon s")]


@pytest.mark.parametrize("form", [_arr, _long])
@pytest.mark.parametrize("limit", [12, 22])
def test_only_the_last_is_dropped(spark, form, limit):
    assert form(spark, ROWS, "simple", limit) == ([("p", "tea\n"), ("q", "saffron\n")], None)


@pytest.mark.parametrize("form", [_arr, _long])
def test_a_lone_long_one_gives_empty(spark, form):
    assert form(spark, ROWS[2:], "simple", 10) == ([], None)


@pytest.mark.parametrize("form", [_arr, _long])
def test_metadata_header(spark, form):
    rows = [meta("p", "tea", 1, "Leaves", "example.org/a"), plain("q", "saffron", 2)]
    got, _ = form(spark, rows, "unsorted", 400)
    assert got == [("p", "[title: 'Leaves', url: 'example.org/a']\ntea\n"), ("q", "saffron\n")]


@pytest.mark.parametrize("form", [_arr, _long])
def test_score_weighted(spark, form):
    rows = [plain(d, "mint", k + 1, x) for k, (d, x) in enumerate([("p", 0.25), ("q", 0.75), ("r", 0.25), ("s", 0.5)])]
    got, _ = form(spark, rows, "score_weighted", 400)
    assert [d for d, _ in got] == ["q", "s", "p", "r"]  # equal scores keep the retrieval order


def _by_prefix_sums(rows, strategy, limit):
    """The rule without a loop: the first position whose running length exceeds the limit decides."""
    text = {c[0]: f"[title: '{c[4]}', url: '{c[5]}']\n{c[2]}\n" if c[6] else f"{c[2]}\n" for c in rows}  # by rank
    by = {"score_weighted": lambda c: -c[3], "simple": lambda c: len(text[c[0]])}.get(strategy, lambda c: 0)
    order = sorted(rows, key=by)
    over = np.flatnonzero(np.cumsum([len(text[c[0]]) for c in order]) > limit)
    first = int(over[0]) if len(over) else len(order)
    placed = {c[0] for c in order[:first]}
    if first < len(order) - 1:
        return [(c[1], text[c[0]] if c[0] in placed else c[2]) for c in rows], True
    return [(c[1], text[c[0]]) for c in order[:first]], False


def test_random_groups_match_prefix_sums(spark):
    rnd = random.Random(7)
    cases = []
    for g in range(150):
        n = rnd.randint(1, 5)
        rows = []
        for r in range(n):
            text = "w" * rnd.randint(1, 40)
            score = float(rnd.choice([0.1, 0.5, 0.5, 0.9]))
            rows.append(meta(f"d{r}", text, r + 1, "t", "u", score) if rnd.random() < 0.5
                        else plain(f"d{r}", text, r + 1, score))
        cases.append((f"e{g}", rows, rnd.choice(["simple", "score_weighted", "other"]), rnd.randint(5, 90)))
    for strategy in ["simple", "score_weighted", "other"]:
        sub = [c for c in cases if c[2] == strategy]
        for limit in sorted({c[3] for c in sub})[:6]:
            grp = [c for c in sub if c[3] == limit]
            df = contexts_df(spark, [(e, rows) for e, rows, _, _ in grp])
            res = {r.event_id: r.r for r in
                   df.select("event_id", CO.consolidate_array(F.col("contexts"), strategy, limit).alias("r")).collect()}
            for e, rows, _, _ in grp:
                exp, is_err = _by_prefix_sums(rows, strategy, limit)
                got = [(c.doc_id, c.text) for c in res[e].contexts]
                assert got == exp, (e, strategy, limit)
                assert (res[e].error is not None) == is_err


def test_word_counter(spark):
    got, err = _arr(spark, [plain("a", "one two three", 1), plain("b", "four five", 2)], "unsorted", 4, word_tokens)
    assert got == [("a", "one two three\n")] and err is None
