"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text without a block-level tag between them; inline tags join, ``br`` is white
space, comments, scripts, styles and their like have no text. Each block has features of its ancestors (tags, words of
their class, id and role) and of its text (length, link share, end). The field has two labels, article and other, a
weight for each feature and for each pair of neighbouring labels; it is trained by stochastic gradient on the log
likelihood (forward-backward) and decoded by Viterbi.

Training pages: pages made by :func:`labelled_page` from templates with every kind of block, whose labels are known,
and at most ``SAMPLE`` real pages (smallest id hash) in which an ``article`` element exists; there a block counts as
article inside it, unless an ancestor is one of ``ASIDE``. Training sees no label at extraction time.

Defined cases: a null, empty or text-free html gives an empty text; broken markup is read as browsers would roughly do
(unknown end tags are ignored, open elements end with their parent, controls and objects also where a section starts,
a cut-off tag is text-free); repeated rows give
equal rows; null ids and urls are passed through; empty tables give empty results; other columns are dropped. Work and
memory of an extraction are linear in the page, however long or deeply nested it is.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import or_empty, small_batches

SAMPLE, MADE, EPOCHS, RATE, SEED = 200, 500, 6, 0.1, 7
#: Their content is no markup: all up to the end tag is skipped, but a self-closed tag skips only itself.
RAW = "script|style|textarea"
#: Their text is left out until they or their parent end.
HIDDEN = frozenset("noscript template svg iframe object select option button".split())
#: What stands in a tag. A quote counts after ``=`` only; one that is never closed is a plain character, and so is one
#: whose value would hold a ``>`` and end in ``=``: it ran on to the opening quote of a later tag.
INSIDE = r"""(?:[^>"'=]|=\s*+(?:"[^">]*"|"[^"]*+(?<!=)"|'[^'>]*'|'[^']*+(?<!=)')|[="'])*+"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<({RAW})(?:/>|(?=[\s/>]){INSIDE}(?:(?<=[\s"']/)>|(?<![\s"']/)>.*?(?:</\1(?=[\s/>])[^>]*(?:>|$)|$)))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({INSIDE})(?:>|$)""", re.S | re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del br input".split())
#: A start tag ends an open element of these names (up to the nearest list, table or other container).
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
CLOSES["p"] = ("svg", "p")
CLOSES |= dict.fromkeys("address blockquote div dl fieldset figure form h1 h2 h3 h4 h5 h6 hr ol pre table ul".split(), ("svg", "p"))
CLOSES |= dict.fromkeys("article aside footer header main nav section".split(), ("svg", "option", "select", "button", "object", "p"))  # none of these holds a section
WALLS = frozenset("article aside blockquote body dl div footer foreignobject form header html main nav ol section table template ul td th".split())
ASIDE = frozenset(
    "nav menu navbar header footer aside sidebar form ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search "
    "comment comments respond reply discussion disqus reactions related recommended share sharing social breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer".split()
)


class Element:
    """An open element; ``fresh`` are those of its features that no element around it has."""

    __slots__ = ("tag", "around", "fresh", "score")

    def __init__(self, tag: str, around: Element | None, fresh: list[str]):
        self.tag, self.around, self.fresh, self.score = tag, around, fresh, None

    def features(self) -> set[str]:
        out, at = set(), self
        while at:
            out.update(at.fresh)
            at = at.around
        return out


class Block:
    __slots__ = ("within", "parts", "linked")

    def __init__(self, within: Element | None):
        self.within, self.parts, self.linked = within, [], 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


class Stack:
    """The open elements, with the places of each tag and of each feature: a tag is found, opened and closed without a look at the others."""

    def __init__(self):
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.covers: list[int] = []
        self.seen: set[str] = set()

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        own = dict.fromkeys(f"w:{w}" for w in words)
        if tag not in ("html", "body"):
            own[f"a:{tag}"] = None
        if tag in ASIDE or not ASIDE.isdisjoint(words):
            own["aside"] = None
        fresh = [f for f in own if f not in self.seen]
        self.seen.update(fresh)
        at = len(self.open)
        self.places.setdefault(tag, []).append(at)
        if tag in WALLS:
            self.walls.append(at)
        if tag in HIDDEN:
            self.covers.append(at)
        self.open.append(Element(tag, self.open[-1] if self.open else None, fresh))

    def close(self, tag: str, inside_walls: bool, uncovered: bool = False) -> bool:
        """End the innermost element of this tag, with all in it, if no wall (no hidden element) stands before it."""
        places = self.places.get(tag)
        if not places or inside_walls and self.walls and self.walls[-1] > places[-1] or uncovered and self.covers and self.covers[-1] > places[-1]:
            return False
        stop = places[-1]
        while len(self.open) > stop:
            e = self.open.pop()
            self.places[e.tag].pop()
            self.seen.difference_update(e.fresh)
            if e.tag in WALLS:
                self.walls.pop()
            if e.tag in HIDDEN:
                self.covers.pop()
        return True


def blocks(page: str) -> list[tuple[Element | None, str, float]]:
    """``(innermost element, text, share of the text inside links)``."""
    stack = Stack()
    out: list[Block] = []
    now: Block | None = None
    hidden = 0  # depth of the outermost hidden element
    at = 0

    def add(piece: str) -> None:
        nonlocal now
        if hidden:
            return
        if now is None:
            if not piece.strip():
                return
            now = Block(stack.open[-1] if stack.open else None)
            out.append(now)
        now.parts.append(piece)
        if stack.places.get("a"):
            now.linked += len(piece)

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" and now is not None and not hidden:
            now.parts.append(" ")
        was = hidden
        if m[2]:
            stack.close(tag, tag in INLINE)
        elif tag not in VOID:
            for name in CLOSES.get(tag, ()):
                stack.close(name, True, name == "p")
        if hidden > len(stack.open):
            hidden = 0
        if not m[2] and tag not in VOID and not m[4].endswith("/"):
            words: tuple[str, ...] = ()
            if "=" in m[4]:
                words = tuple(w for a in ATTRIBUTE.finditer(m[4]) for w in re.findall(r"[a-z]+", (a[2] or a[3] or a[4] or "").lower()))
            stack.push(tag, words)
            if not hidden and tag in HIDDEN:
                hidden = len(stack.open)
        if tag not in INLINE and tag not in HIDDEN and not (was and hidden):
            now = None
    if at < len(page):
        add(page[at:])
    got = []
    for b in out:
        if text := b.text():
            got.append((b.within, text, min(1.0, b.linked / max(1, sum(map(len, b.parts))))))
    return got


def features(within: Element | None, text: str, linked: float, place: int, last: int) -> list[str]:
    """What a block has beside the features of the elements around it."""
    out = ["1", f"t:{within.tag if within else ''}"]
    n = len(text)
    out.append("n:" + ("1" if n < 15 else "2" if n < 40 else "3" if n < 100 else "4" if n < 250 else "5"))
    out.append("l:" + ("0" if linked < 0.1 else "1" if linked < 0.6 else "2"))
    if text[-1] in ".!?…\"”»":
        out.append("stop")
    if "©" in text:
        out.append("copy")
    if place == 0:
        out.append("first")
    if place == last:
        out.append("last")
    return out


class Field:
    """Weights of the features for the label *article*, and of neighbouring labels."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.pair = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, found: list[list[str]]) -> list[float]:
        w = self.w
        return [sum([w.get(f, 0.0) for f in fs]) for fs in found]

    def page_scores(self, got: list[tuple[Element | None, str, float]]) -> list[float]:
        """The scores of a page's blocks; those of the elements around them are added up once for each element."""
        w, out = self.w, []
        for i, b in enumerate(got):
            todo, at = [], b[0]
            while at and at.score is None:
                todo.append(at)
                at = at.around
            total = at.score if at else 0.0
            for e in reversed(todo):
                total = e.score = total + sum([w.get(f, 0.0) for f in e.fresh])
            out.append(total + sum([w.get(f, 0.0) for f in features(*b, i, len(got) - 1)]))
        return out

    def step(self, found: list[list[str]], labels: list[int], rate: float) -> None:
        """One gradient step of the log likelihood of a page."""
        s, n = self.scores(found), len(found)
        both = lambda a, b: max(a, b) + log(1 + exp(-abs(a - b)))
        fwd, bwd = [(0.0, s[0])], [(0.0, 0.0)]
        for x in s[1:]:
            a, b = fwd[-1]
            fwd.append((both(a + self.pair[0][0], b + self.pair[1][0]), x + both(a + self.pair[0][1], b + self.pair[1][1])))
        for x in reversed(s[1:]):
            a, b = bwd[-1]
            bwd.append((both(self.pair[0][0] + a, self.pair[0][1] + x + b), both(self.pair[1][0] + a, self.pair[1][1] + x + b)))
        bwd.reverse()
        z = both(*fwd[-1])
        grad = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(n):
            p = exp(fwd[i][1] + bwd[i][1] - z)
            for f in found[i]:
                self.w[f] = self.w.get(f, 0.0) * (1 - rate * 1e-3) + rate * (labels[i] - p)
            if i:
                for a in (0, 1):
                    for b in (0, 1):
                        grad[a][b] += (labels[i - 1] == a and labels[i] == b) - exp(fwd[i - 1][a] + self.pair[a][b] + (s[i] if b else 0.0) + bwd[i][b] - z)
        for a in (0, 1):
            for b in (0, 1):
                self.pair[a][b] += rate * max(-2.0, min(2.0, grad[a][b]))

    def decode(self, found: list[list[str]]) -> list[int]:
        return self.viterbi(self.scores(found))

    def viterbi(self, s: list[float]) -> list[int]:
        if not s:
            return []
        p = self.pair
        a, b, back = 0.0, s[0], []
        for x in s[1:]:
            back.append((int(b + p[1][0] > a + p[0][0]), int(b + p[1][1] > a + p[0][1])))
            a, b = max(a + p[0][0], b + p[1][0]), x + max(a + p[0][1], b + p[1][1])
        labels = [int(b > a)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]


def found_in(got: list[tuple[Element | None, str, float]]) -> list[list[str]]:
    """All features of each block, for training."""
    return [sorted({*features(*b, i, len(got) - 1), *(b[0].features() if b[0] else ())}) for i, b in enumerate(got)]


# ------------------------------------------------------------------------------ training pages


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A made page; 1 for each of its blocks that belongs to the article."""
    labels: list[int] = []
    word = lambda: "".join(rng.choice(("ta", "ri", "on", "el", "mu", "sch", "é", "ko")) for _ in range(rng.randint(1, 4)))

    def say(y: int, low: int, high: int, stop: bool = True) -> str:
        labels.append(y)
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + ("." if stop and rng.random() < 0.9 else "")

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{say(0, 1, 3, False)}</a></li>' for i in range(n)) + "</ul>"

    def boxed(name: str, body, tag: str = "div") -> str:
        kind = rng.choice(("class", "id", "class"))
        return f'<{tag} {kind}="{name}">{body()}</{tag}>'

    aside_words = sorted(ASIDE - {"nav", "header", "footer", "aside", "form"})

    def clutter() -> str:
        kind = rng.random()
        para = lambda: f"<p>{say(0, 3, 40)}</p>"
        if kind < 0.15:
            return boxed(rng.choice(("menu", "navbar", "top-menu")), lambda: links(rng.randint(2, 7)), rng.choice(("nav", "div")))
        if kind < 0.3:
            return f"<aside{rng.choice(('', ' class=sidebar'))}><h3>{say(0, 1, 4, False)}</h3>{rng.choice((para, lambda: links(3)))()}</aside>"
        if kind < 0.4:
            return f'<form action="/s"><label>{say(0, 1, 4, False)}</label><input name="q"><p>{say(0, 2, 12)}</p></form>'
        if kind < 0.5:
            return f"<section class=comments><h3>{say(0, 1, 3, False)}</h3>" + "".join(f'<div class="comment"><p>{say(0, 4, 60)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>"
        body = rng.choice((para, para, lambda: say(0, 3, 30), lambda: links(3), lambda: f"<h4>{say(0, 1, 4, False)}</h4><p>{say(0, 3, 40)}</p>"))
        return boxed(rng.choice(aside_words) + rng.choice(("", "", "-box", "-list", "s")), body, rng.choice(("div", "div", "section", "p", "ul") if body is para else ("div", "div", "section")))

    def article() -> str:
        parts = [f"<h1>{say(1, 2, 9, False)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.08:
                parts.append(f"<h2>{say(1, 1, 6, False)}</h2>")
            elif kind < 0.14:
                parts.append("<ul>" + "".join(f"<li>{say(1, 1, 14)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.18:
                parts.append(f"<blockquote>{say(1, 3, 30)}</blockquote>")
            elif kind < 0.21:
                parts.append(f'<figure><img src="x"><figcaption>{say(1, 2, 12)}</figcaption></figure>')
            elif kind < 0.3:
                parts.append(clutter())
            elif kind < 0.4:
                parts.append(f"<p><b>{say(1, 1, 30)}<br>")
            else:
                parts.append(f"<p>{say(1, 1, 90)}</p>")
        return "".join(parts)

    top = f"<title>{say(0, 2, 8, False)}</title>"
    out = [f"<!DOCTYPE html><html><head>{top}<style>p{{}}</style><script>var a='<p>';</script></head><body>"]
    if rng.random() < 0.5:
        out.append(f"<header{rng.choice(('', ' class=site-header'))}><div>{say(0, 1, 5, False)}</div>{links(2) if rng.random() < 0.5 else ''}</header>")
    if rng.random() < 0.8:
        out.append(f"<nav>{links(rng.randint(2, 7))}</nav>")
    out += [clutter() for _ in range(rng.randint(0, 2))]
    tag = rng.choice(('article', 'article', 'article', 'main', 'div class="content"', 'div id="main-content"', 'div class="post entry-content"', 'div class="article-body"', 'section class="story"', 'div role="main"', 'article class="post"'))
    out.append(f"<{tag}>{article()}</{tag.split()[0]}>")
    out += [clutter() for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.9:
        out.append(f"<footer>&copy; {say(0, 2, 14)}</footer>")
    return "".join(out) + "</body></html>", labels


def train(pages: DataFrame, sample: int = SAMPLE, made: int = MADE) -> Field:
    rng = random.Random(SEED)
    cases = []
    for _ in range(made):
        page, labels = labelled_page(rng)
        got = blocks(page)
        if len(got) == len(labels):
            cases.append((found_in(got), labels))
    some = pages.filter(F.col("html").rlike("(?i)<article") & F.col("page_id").isNotNull()).select("page_id", F.xxhash64("page_id").alias("h"))
    some = some.orderBy("h", "page_id").limit(sample).select("page_id").distinct()
    for (page,) in sorted(tuple(r) for r in pages.select("html", "page_id").filter("html IS NOT NULL").join(F.broadcast(some), "page_id").select("html").limit(2 * sample).collect()):
        got = blocks(page)
        around = [e.features() if e else set() for e, _, _ in got]
        inside = ["a:article" in fs and "aside" not in fs for fs in around]
        if any(inside):
            cases.append((found_in(got), [int(x) for x in inside]))
    field = Field()
    for epoch in range(EPOCHS):
        rng.shuffle(cases)
        for found, labels in cases:
            field.step(found, labels, RATE / (1 + epoch))
    return field


def main_text(page: str | None, field: Field) -> str:
    got = blocks(page or "")
    return " ".join(text for (_, text, _), y in zip(got, field.viterbi(field.page_scores(got)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    spark = pages.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(field or train(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for batch in batches:
            texts = [main_text(p.as_py(), f) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", or_empty("html").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
