"""The random field against enumeration; nested, long and broken pages."""

import itertools
import math
import random
import time

import pytest

from qaflow.llm import html_crf


def weighted(rng, n):
    found = [["1", *rng.sample(["x", "y", "z", "u"], rng.randint(0, 3))] for _ in range(n)]
    field = html_crf.Field()
    field.w = {f: rng.uniform(-2, 2) for f in ("1", "x", "y", "z")}
    field.pair = [[rng.uniform(-1, 1) for _ in "ab"] for _ in "ab"]
    return field, found


def energy(field, found, labels):
    return sum(s for s, y in zip(field.scores(found), labels, strict=True) if y) + sum(field.pair[a][b] for a, b in itertools.pairwise(labels))


def test_viterbi_equals_enumeration():
    rng = random.Random(1)
    for n in range(1, 9):
        field, found = weighted(rng, n)
        best = max(itertools.product((0, 1), repeat=n), key=lambda ys: energy(field, found, ys))
        assert field.decode(found) == list(best)


def test_gradient_equals_enumeration():
    rng, rate = random.Random(2), 1e-3
    for n in range(1, 8):
        field, found = weighted(rng, n)
        labels = [rng.randint(0, 1) for _ in range(n)]
        all_ys = list(itertools.product((0, 1), repeat=n))
        weights = [math.exp(energy(field, found, ys)) for ys in all_ys]
        z = sum(weights)
        want = {f: 0.0 for f in ("1", "x", "y", "z", "u")}
        for i, fs in enumerate(found):
            p = sum(w for w, ys in zip(weights, all_ys, strict=True) if ys[i]) / z
            for f in fs:
                want[f] += labels[i] - p
        pairs = [[sum((labels[i - 1] == a and labels[i] == b) - sum(w for w, ys in zip(weights, all_ys, strict=True) if ys[i - 1] == a and ys[i] == b) / z for i in range(1, n)) for b in (0, 1)] for a in (0, 1)]
        before, pair = dict(field.w), [row[:] for row in field.pair]
        field.step(found, labels, rate)
        for f, g in want.items():
            uses = sum(f in fs for fs in found)
            assert field.w.get(f, 0.0) == pytest.approx(before.get(f, 0.0) + rate * g, abs=rate * 1e-3 * 3 * uses + 1e-9)
        for a in (0, 1):
            for b in (0, 1):
                assert field.pair[a][b] == pytest.approx(pair[a][b] + rate * max(-2.0, min(2.0, pairs[a][b])), abs=1e-9)


def test_page_scores_equal_those_of_all_features():
    rng = random.Random(3)
    field = html_crf.Field()
    for _ in range(50):
        page, _ = html_crf.labelled_page(rng)
        got = html_crf.blocks(page)
        found = html_crf.found_in(got)
        for fs in found:
            for f in fs:
                field.w.setdefault(f, rng.uniform(-1, 1))
        assert field.page_scores(got) == pytest.approx(field.scores(found))


def test_broken_quotes_leave_the_text_clean():
    texts = lambda page: [b[1] for b in html_crf.blocks(page)]
    assert texts('<p>One.</p><p title="abc>Two.') == ["One.", "Two."]
    assert texts('<p title="abc>Two.</p><p class="x">Three.</p>') == ["Two.", "Three."]
    assert texts("<p title=it's>It's here.</p><p>And 'there'.</p>") == ["It's here.", "And 'there'."]
    assert texts('<a href="?a=">one</a> <a title="x > y" href=\'?b=\'>two</a>') == ["one two"]
    assert texts("<p title='a>b<c'>Four.</p><script data-x=\"a>b\">no</script><script x=\"a>no</script>Five.") == ["Four.", "Five."]
    assert texts("<p " + '=""' * 5000) == []


def test_end_tags_close_what_is_open():
    inside = lambda page: [(b[1], sorted(b[0].features()) if b[0] else []) for b in html_crf.blocks(page)]
    assert inside('<div class="nav x">a<p>b</span>c</div>d') == [("a", ["a:div", "aside", "w:nav", "w:x"]), ("bc", ["a:div", "a:p", "aside", "w:nav", "w:x"]), ("d", [])]
    # an inline end tag does not reach beyond a container; the same class further in adds nothing and takes nothing away
    assert inside("<b>a<div class=k>b</b>c<div class=k>d</div>e</div></b>f") == [("a", ["a:b"]), ("bc", ["a:b", "a:div", "w:k"]), ("d", ["a:b", "a:div", "w:k"]), ("e", ["a:b", "a:div", "w:k"]), ("f", [])]


@pytest.mark.parametrize("make", [
    lambda n: "<div>a b c" * n,
    lambda n: "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>a b" for i in range(n)),
    lambda n: "<b>" * n + "</x>" * n,
    lambda n: "<a><div>" + "<b>" * n + "</a>" * n,
    lambda n: "<p title=\"x>a" * n,
    lambda n: "<p title='x=\"y>a" * n,
])
def test_time_is_linear(make):
    field = html_crf.Field()

    def seconds(n):
        page, best = make(n), 9.0
        for _ in range(3):
            begin = time.process_time()
            html_crf.main_text(page, field)
            best = min(best, time.process_time() - begin)
        return best

    assert seconds(32_000) < 3 * seconds(16_000) + 0.1
