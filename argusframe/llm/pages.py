"""Main text of web pages with a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks: text between the borders of block elements. Each is described
by the tags, classes and ids of its ancestors and by its text; neighbours are tied by learned
transitions, one set for blocks of one parent and one for others. Viterbi decoding keeps the
blocks of the article.

Pages that mark their article are labelled by that mark. The field is trained on a bounded sample
of them, and on the same texts laid out in other ways, so that it does not depend on one mark.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled pages of the sample, the longest of them in characters, layouts made of each, and how much
#: more a page counts as it was found.
SAMPLE, LONGEST, LAYOUTS, FOUND = 150, 1 << 14, 5, 4
EPOCHS, RATE, DECAY = 120, 0.4, 3e-4

# ---------------------------------------------------------------- blocks of a page
# Fixed values of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Their content is no text of the page.
RAW_TAGS = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
MUTED_TAGS = frozenset("button datalist select svg template".split())
#: An open element of the first kinds ends where one of them starts, unless one of the others is between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())

_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW_TAGS}


@dataclass
class Block:
    """Text of a leaf block, its innermost block element (see Page.nodes), and the share of it in links."""

    node: int
    text: str
    linked: float


@dataclass
class Page:
    """Leaf blocks; nodes: of each block element its parent and its own marks, parents first."""

    blocks: list[Block] = field(default_factory=list)
    nodes: list[tuple[int, tuple[str, ...]]] = field(default_factory=lambda: [(-1, ())])


@lru_cache(1 << 14)
def marks(tag: str, attributes: str) -> tuple[str, ...]:
    """Features of an element: its tag, and the words of its class, id and role."""
    out = [] if tag in ("html", "body", "div") else [f"tag {tag}"]
    for m in _MARKS.finditer(attributes):
        for word in _TOKEN.findall(m[1] or m[2] or m[3] or ""):
            word = word.lower()
            out.append(f"is {word}")
            if len(word) > 4:
                out.append(f"like {word[:4]}")
    return tuple(dict.fromkeys(out))


class _Walk:
    """Open block elements while a page is read from front to back."""

    def __init__(self) -> None:
        self.page = Page()
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, muted
        self.count: dict[str, int] = {}
        self.pieces: list[tuple[str, bool]] = []
        self.link = False

    def flush(self) -> None:
        if self.pieces and not self.open[-1][2]:
            text = " ".join("".join(t for t, _ in self.pieces).split())
            if text:
                linked = sum(len(t) for t, inside in self.pieces if inside)
                self.page.blocks.append(Block(self.open[-1][1], text, linked / sum(len(t) for t, _ in self.pieces)))
        self.pieces = []

    def pop(self, upto: int) -> None:
        while len(self.open) > upto:
            tag, _, _ = self.open.pop()
            self.count[tag] -= 1

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append((" ", self.link))
        elif tag == "a":
            self.link = True
        elif tag in BLOCK_TAGS or tag in MUTED_TAGS:
            self.flush()
            if tag in BLOCK_TAGS and self.open[-1][0] == "p":
                self.pop(len(self.open) - 1)
            ends, borders = IMPLIED.get(tag, ((), ()))
            if any(self.count.get(t) for t in ends):
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i][0] in ends:
                        self.pop(i)
                        break
                    if self.open[i][0] in borders:
                        break
            if tag in VOID_TAGS:
                return
            self.page.nodes.append((self.open[-1][1], marks(tag, attributes)))
            self.open.append((tag, len(self.page.nodes) - 1, self.open[-1][2] or tag in MUTED_TAGS))
            self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        elif tag in BLOCK_TAGS or tag in MUTED_TAGS:
            self.flush()
            if not self.count.get(tag):
                return
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == tag:
                    self.pop(i)
                    break
                if self.open[i][0] in TABLE_PARTS and tag not in TABLE_PARTS:
                    break


def read(source: str) -> Page:
    """Leaf blocks of a page in order; time grows with its length, whatever is broken in it."""
    walk = _Walk()
    at, n, quoted = 0, len(source), True
    while at < n:
        less = source.find("<", at)
        if less < 0:
            less = n
        if less > at:
            walk.pieces.append((html.unescape(source[at:less]), walk.link))
        if less == n:
            break
        name = _NAME.match(source, less)
        if name is None:
            if source.startswith("<!--", less):
                short = next((s for s in ("<!-->", "<!--->") if source.startswith(s, less)), None)
                end = less + len(short) - 1 if short else source.find("-->", less + 4) + 2
                at = end + 1 if end > less else n
            elif source.startswith(("<!", "<?", "</"), less):
                end = source.find(">", less)
                at = end + 1 if end >= 0 else n
            else:
                walk.pieces.append(("<", walk.link))
                at = less + 1
            continue
        rest = _REST.match(source, name.end()) if quoted else None
        if rest is None:
            quoted = False  # a quote that never ends: from here on tags end at the next >
            end = source.find(">", name.end())
            if end < 0:
                break
        else:
            end = rest.end() - 1
        tag = name[1].lower()
        at = end + 1
        if source[less + 1] == "/":
            walk.end(tag)
        elif tag in RAW_TAGS:
            close = _END[tag].search(source, at)
            if close is None:
                break
            at = close.start()
        else:
            walk.start(tag, source[name.end() : end])
    walk.flush()
    return walk.page


# ---------------------------------------------------------------- features and the field


def landmarks(page: Page) -> list[bool]:
    """Of each element whether it is inside of one that stands for the article by its tag."""
    out: list[bool] = []
    for parent, own in page.nodes:
        out.append(parent >= 0 and out[parent] or "tag article" in own or "tag main" in own)
    return out


def text_features(page: Page, i: int, inside: list[bool]) -> list[str]:
    """What a block's text and place say about it; inside: landmarks of the page."""
    b = page.blocks[i]
    words = b.text.count(" ") + 1
    size, linked = min(words.bit_length(), 7), int(b.linked * 3.999)
    own = page.nodes[b.node][1]
    tag = own[0][4:] if own and own[0].startswith("tag ") else "div"
    out = [
        "always", f"words {size}", f"linked {linked}", f"words {size} linked {linked}",
        f"own {tag}", f"own {tag} linked {linked}", f"place {4 * i // len(page.blocks)}",
    ]
    if inside[b.node]:
        out += [f"inside own {tag}", f"inside words {size} linked {linked}"]
    if b.text[-1] in ".!?…。":
        out.append("sentence")
    if b.text[0] in "©®" or "©" in b.text[:40]:
        out.append("rights")
    if not any(c.isalpha() for c in b.text[:64]):
        out.append("no letter")
    return out


@dataclass
class Field:
    """Weights of features for the article (against the rest), and scores of transitions.

    transition[same parent][label before][label].
    """

    weights: dict[str, float]
    transition: np.ndarray


def alike(page: Page) -> list[int]:
    """Of each block whether the one before has the same parent element."""
    parent = [page.nodes[b.node][0] for b in page.blocks]
    return [0, *(int(a == b) for a, b in zip(parent, parent[1:], strict=False))][: len(parent)]


def emissions(page: Page, model: Field) -> list[float]:
    """Score of every block for the article. What ancestors add is summed once for each element."""
    get = model.weights.get
    carried: list[float] = []
    for parent, own in page.nodes:
        carried.append((carried[parent] if parent >= 0 else 0.0) + sum(get(m, 0.0) for m in own))
    inside = landmarks(page)
    return [
        carried[b.node] + sum(get(x, 0.0) for x in text_features(page, i, inside))
        for i, b in enumerate(page.blocks)
    ]


def viterbi(score: list[float], same: list[int], transition: np.ndarray) -> list[int]:
    """Best labels; ties: rest."""
    if not score:
        return []
    t = transition.tolist()
    rest, main = 0.0, score[0]
    back = []
    for s, k in zip(score[1:], same[1:], strict=True):
        (rr, rm), (mr, mm) = t[k]
        a, b, c, d = rest + rr, main + mr, rest + rm, main + mm
        back.append((int(b > a), int(d > c)))
        rest, main = max(a, b), max(c, d) + s
    label = int(main > rest)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def ancestry(page: Page, node: int) -> list[str]:
    out: list[str] = []
    while node >= 0:
        node, own = page.nodes[node]
        out += own
    return out


def expectations(
    score: np.ndarray, same: np.ndarray, size: np.ndarray, transition: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded pages (page, place).

    Returns log-partition sums, the chance of each block to be of the article, and expected
    transitions in the shape of `transition`.
    """
    pages, longest = score.shape
    both = np.stack((np.zeros_like(score), score), 2)
    forward = np.zeros((pages, longest, 2))
    forward[:, 0] = both[:, 0]
    for t in range(1, longest):
        step = forward[:, t - 1, :, None] + transition[same[:, t]]
        forward[:, t] = np.logaddexp(step[:, 0], step[:, 1]) + both[:, t]
    backward = np.zeros((pages, longest, 2))
    for t in range(longest - 2, -1, -1):
        step = transition[same[:, t + 1]] + (both[:, t + 1] + backward[:, t + 1])[:, None]
        new = np.logaddexp(step[:, :, 0], step[:, :, 1])
        backward[:, t] = np.where((t + 1 < size)[:, None], new, 0)
    last = forward[np.arange(pages), size - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    moves = np.zeros_like(transition)
    for t in range(1, longest):
        live = t < size
        joint = forward[live, t - 1, :, None] + transition[same[live, t]] + (both[live, t] + backward[live, t])[:, None]
        np.add.at(moves, same[live, t], np.exp(joint - total[live, None, None]))
    return total, chance, moves


def train(pages: list[tuple[Page, list[int]]]) -> Field:
    """Maximum likelihood with adaptive steps; labels: 1 for blocks of the article."""
    pages = [(p, y) for p, y in pages if p.blocks]
    if not pages:
        return Field({}, np.zeros((2, 2, 2)))
    index: dict[str, int] = {}
    rows, start = [], []
    for page, _ in pages:
        inside = landmarks(page)
        for i, b in enumerate(page.blocks):
            start.append(len(rows))
            found = text_features(page, i, inside) + ancestry(page, b.node)
            rows += [index.setdefault(x, len(index)) for x in found]
    rows, start = np.array(rows), np.array(start)
    size = np.array([len(p.blocks) for p, _ in pages])
    page_of = np.repeat(np.arange(len(pages)), size)
    place = np.arange(len(page_of)) - np.repeat(np.cumsum(size) - size, size)
    shape = (len(pages), int(size.max()))
    label, same = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    label[page_of, place] = np.concatenate([y for _, y in pages])
    same[page_of, place] = np.concatenate([alike(p) for p, _ in pages])
    later = place > 0
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (same[page_of, place][later], label[page_of, place - 1][later], label[page_of, place][later]), 1)
    block = np.repeat(np.arange(len(start)), np.diff(start, append=len(rows)))
    w, t = np.zeros(len(index)), np.zeros((2, 2, 2))
    square_w, square_t = np.full(len(index), 1e-8), np.full((2, 2, 2), 1e-8)
    score = np.zeros(shape)
    for _ in range(EPOCHS):
        score[page_of, place] = np.add.reduceat(w[rows], start)
        _, chance, moves = expectations(score, same, size, t)
        error = (chance - label)[page_of, place]
        g = np.bincount(rows, error[block], len(index)) / len(pages) + DECAY * w
        square_w += g * g
        w -= RATE * g / np.sqrt(square_w)
        g = (moves - seen) / len(pages) + DECAY * t
        square_t += g * g
        t -= RATE * g / np.sqrt(square_t)
    return Field({x: float(w[i]) for x, i in index.items()}, t)


# ---------------------------------------------------------------- labelled pages

#: Words of classes and ids by what their element holds; also how layouts name their parts.
PARTS = {
    "main": "content article post entry story text body main page",
    "header": "header masthead topbar branding banner logo",
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs tabs toc",
    "notice": "notice cookie cookies consent alert gdpr message warning popup modal",
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion commercial",
    "side": "sidebar aside widget rail related recommended popular trending latest tags",
    "form": "newsletter subscribe signup search login form contact",
    "comments": "comments comment replies reply discussion responses disqus thread",
    "share": "share social follow buttons tools",
    "footer": "footer copyright legal bottom colophon credits imprint",
}
_FOREIGN = frozenset(w for k, v in PARTS.items() if k != "main" for w in v.split())
_TAGS = {
    "header": "header", "nav": "nav", "side": "aside", "form": "form", "comments": "section", "footer": "footer",
}
_PHRASES = {
    "header": ["Daily News", "Home of the best stories"],
    "nav": ["Home", "About us", "Contact", "News", "Sport", "Archive", "Next page", "More"],
    "notice": ["We use cookies to improve this site.", "Please accept our terms.", "Accept all", "Enable scripts to go on."],
    "ad": ["Advertisement", "Buy now and save 20%!", "Sponsored content"],
    "side": ["Related articles", "Most read", "Popular posts", "Tags"],
    "form": ["Sign up for our newsletter", "Your e-mail address", "Search", "Log in"],
    "comments": ["Comments", "3 comments", "Leave a reply", "Great article, thanks!", "I do not agree.", "Anna wrote on Monday:"],
    "share": ["Share this", "Tweet", "Print", "Follow us"],
    "footer": ["All rights reserved.", "Terms of use", "Privacy", "© 2024 Example"],
}


def labels(page: Page) -> list[int] | None:
    """Labels of a page that marks its article with an element; None if it does not."""
    inside, foreign = landmarks(page), [False]
    for n, (parent, own) in enumerate(page.nodes[1:], 1):
        bad = any(f"is {w}" in own for w in _FOREIGN) or any(f"tag {t}" in own for t in ("nav", "aside", "form", "footer"))
        foreign.append(inside[n] and (foreign[parent] or bad))
    out = [int(inside[b.node] and not foreign[b.node]) for b in page.blocks]
    return out if any(out) else None


def _layout(rng: random.Random, main: list[tuple[str, str]], other: list[str]) -> tuple[str, list[int]]:
    """A page that holds the article `main` of (tag, text) amid other parts, and the labels of its blocks."""
    out: list[str] = []
    y: list[int] = []

    def name(part: str) -> str:
        kind = rng.random()
        if kind < 0.25:
            return ""
        word = rng.choice(PARTS[part].split())
        if kind < 0.45:
            word = "".join(rng.choices("bcdfghjkmpqrtvwxz", k=rng.randint(2, 6)))
        join = rng.choice(["{}", "{}", "site-{}", "{}-wrap", "{}_box", "block-{}", "{}Inner", "{}-1"])
        return f' {rng.choice(["class", "class", "id"])}="{join.format(word)}"'

    def put(tag: str, text: str, label: int, linked: bool = False) -> None:
        body = html.escape(text)
        if linked:
            body = f'<a href="/{len(y)}">{body}</a>'
        elif label and rng.random() < 0.2 and " " in text:
            head, tail = text.split(" ", 1)
            body = f'<a href="/{len(y)}">{html.escape(head)}</a> {html.escape(tail)}'
        elif rng.random() < 0.2:
            body = f"<b>{body}</b>"
        out.append(f"<{tag}>{body}</{tag}>")
        y.append(label)

    def part(kind: str) -> None:
        tag = _TAGS.get(kind, "div") if rng.random() < 0.45 else "div"
        out.append(f"<{tag}{name(kind)}>")
        prose = kind in ("comments", "ad", "notice", "side", "footer")
        if kind in ("comments", "side", "form", "share") and rng.random() < 0.5:
            put(rng.choice(["h2", "h3", "h4"]), rng.choice(_PHRASES[kind]), 0)
        for _ in range(rng.randint(1, 6) if kind in ("nav", "comments", "side", "share") else rng.randint(1, 2)):
            text = rng.choice(other) if other and prose and rng.random() < 0.7 else rng.choice(_PHRASES[kind])
            if kind == "comments" and main and rng.random() < 0.5:
                text = rng.choice(main)[1]
            if kind == "footer" and rng.random() < 0.5:
                text = "© " + text
            inner = "li" if kind in ("nav", "share") else rng.choice(["p", "div", "li"])
            wrap = f"<div{name(kind)}>" if kind == "comments" and rng.random() < 0.6 else None
            if wrap:
                out.append(wrap)
            put(inner, text, 0, kind in ("nav", "share") or kind in ("side", "footer") and rng.random() < 0.5)
            if wrap:
                out.append("</div>")
        out.append(f"</{tag}>")

    before = [k for k in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < 0.55]
    after = [k for k in ("share", "ad", "side", "comments", "form", "nav", "notice", "footer") if rng.random() < 0.5]
    within = [k for k in ("ad", "share", "side", "form", "nav", "comments") if rng.random() < 0.2]
    rng.shuffle(before)
    for kind in before:
        part(kind)
    if rng.random() < 0.3:  # articles have short paragraphs too
        first = rng.randrange(len(main))
        main = [(t, " ".join(x.split()[: rng.randint(1, 4)]) if i >= first else x) for i, (t, x) in enumerate(main)]
    tag = rng.choice(["article", "main", "div", "div", "div", "section"])
    out.append(f"<{tag}{name('main')}>" + ("<div>" if rng.random() < 0.2 else ""))
    cut = {rng.randint(1, max(1, len(main))): k for k in within}
    for i, (inner, text) in enumerate(main):
        if i in cut:
            part(cut[i])
        put(inner if rng.random() < 0.8 else rng.choice(["p", "div", "blockquote", "h2", "h3", "li", "pre", "td"]), text, 1)
    if len(main) in cut:
        part(cut[len(main)])
    out.append(f"</{tag}>")
    for kind in after:
        part(kind)
    return "".join(out), y


def labelled(sources: list[str]) -> list[tuple[Page, list[int]]]:
    """Labelled pages from a sample: those that mark their article, and layouts of their texts."""
    rng = random.Random(11)
    out: list[tuple[Page, list[int]]] = []
    short: list[str] = []
    articles: list[list[tuple[str, str]]] = []
    for source in sources:
        page = read(source)
        y = labels(page)
        if y is not None:
            out += [(page, y)] * FOUND
        main = []
        for i, b in enumerate(page.blocks):
            if y[i] if y is not None else b.text.count(" ") >= 8:
                tags = [m[4:] for m in page.nodes[b.node][1] if m.startswith("tag ")]
                main.append((tags[0] if tags and tags[0] in ("p", "h1", "h2", "h3", "li", "blockquote", "pre") else "p", b.text))
            else:
                short.append(b.text)
        if main:
            articles.append(main)
    if not articles:
        articles = [[("h1", "A story"), ("p", "It was a long day, and nobody came home before night."), ("p", "Then rain fell.")]]
    for _ in range(LAYOUTS):
        for main in articles:
            source, y = _layout(rng, main, short)
            out.append((read(source), y))
    return out


def fit(pages: DataFrame) -> Field:
    """The field trained on SAMPLE different pages of at most LONGEST characters, least in hash, and their layouts."""
    short = pages.where(F.length("html") <= LONGEST).select("html", F.xxhash64("page_id", "html").alias("h"))
    hashes = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    # copies of a page are one page of the sample, so no more than SAMPLE come to the driver
    rows = short.where(F.col("h") <= max(hashes, default=0)).dropDuplicates(["h"]).orderBy("h").collect()
    return train(labelled([r["html"] for r in rows]))


def main_text(source: str, model: Field) -> str:
    page = read(source)
    kept = viterbi(emissions(page, model), alike(page), model.transition)
    return "\n".join(b.text for b, y in zip(page.blocks, kept, strict=True) if y)


def _extract(batches: Iterator[pa.RecordBatch], model: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("html")
        texts = [main_text(x or "", model) for x in batch.column(at).to_pylist()]
        keep = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [*(batch.schema.names[i] for i in keep), "text", "n_chars"],
        )


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): the article of every page, blocks joined by line breaks.

    Null, empty or textless html: empty text. Null page_id or url: extracted all the same. Repeated
    rows: each is extracted. Broken markup: unclosed elements end with their parents, an unclosed
    comment, script or tag at the end is dropped. Ties between labels: not of the article. Empty
    table: no rows. Other columns are not looked at. model: trained on the pages if none.
    """
    model = fit(pages) if model is None else model
    ids = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {ids['page_id']}, url {ids['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(partial(_extract, model=model), schema)
