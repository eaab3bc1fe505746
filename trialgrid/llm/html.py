"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with
the chain of elements it stands in. Every block has features of its ancestors
(tags, and words of their class, id and role) and of its text (length, links,
punctuation, place). The field labels the blocks of a page as content or
boilerplate in one pass of Viterbi; the content blocks, joined by a space, are
the page's main text.

Training: pages of a bounded sample (`sample_pages`, by a hash of the id) are
labelled by their own markup: inside `article` or `main` and outside any element
whose tag or class names furniture is content, the rest is not. Since real pages
carry furniture of more kinds than one table may show, each training page also
gets blocks of `FURNITURE` in random places, labelled as boilerplate, and a part of
the pages lose their `article` tags, so that text features carry weight too. The
weights maximise the conditional likelihood (forward-backward, AdaGrad).

Scripts, styles, comments and other elements that never render as text are no
blocks. Pages may leave elements open: a closing tag closes the innermost open
element of its name, if any.

Defined cases: null and empty html give an empty text; a page without content
blocks gives an empty text; very long pages are decoded whole; repeated rows are
extracted alike; an empty table gives no rows; without any training page all
blocks inside `article` or `main` are content.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.llm.common import pick

#: Elements of HTML by their role in layout.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr "
                   # formulas and drawings: their text is rendered where it stands
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot "
                   "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics object "
                   "svg circle clippath defs ellipse foreignobject g image line lineargradient marker mask path pattern "
                   "polygon polyline radialgradient rect stop symbol text textpath tspan use".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "noscript", "template", "head", "title", "iframe", "canvas",
          "select", "textarea", "button", "annotation", "annotation-xml", "desc", "metadata")
#: Elements that don't end the block they stand in.
FLOWING = INLINE | VOID - {"hr"} | frozenset(HIDDEN)
RAW = frozenset("script style textarea title iframe noscript".split())
SELF_CLOSING = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()),
                "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()),
                "th": frozenset("td th".split()), "option": frozenset("option".split())}
LIST_EDGES = frozenset("ul ol dl table article section div main body aside nav form".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                   "h6 header hr main menu nav ol p pre section table ul".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
FURNITURE_WORDS = frozenset("ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies "
                            "consent copyright disqus feedback footer form gdpr header login masthead menu modal nav "
                            "navbar navigation newsletter notice pagination popup promo promoted related replies reply "
                            "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
CONTENT_TAGS = frozenset("article main".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.!?…。]")


NOWHERE = (frozenset(), False, False)


@dataclass
class Block:
    text: str
    linked: int  # code points inside links
    tags: frozenset  # the block elements it stands in
    content: bool  # whether one of them is a content element
    furniture: bool  # whether one of them is furniture by its tag or the words of its class, id or role


def _cut_raw(page: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    return end.start() if end else len(page)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    # (tag, then what holds for all that stand in it: block tags, content, furniture)
    stack: list[tuple] = []
    open_tags: Counter = Counter()
    parts, linked, links, hidden, at = [], 0, 0, 0, 0
    page = page or ""

    def close_block():
        nonlocal parts, linked
        text = SPACES.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(text, linked, *(stack[-1][1:] if stack else NOWHERE)))
        parts, linked = [], 0

    def put(raw: str):
        nonlocal linked
        if raw and not hidden:
            text = entities.unescape(raw)
            parts.append(text)
            if links:
                linked += len(text.strip())

    def pop():
        nonlocal links, hidden
        if stack[-1][0] not in FLOWING:
            close_block()
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        links -= tag == "a"
        hidden -= tag in HIDDEN

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag not in FLOWING and not hidden:
                close_block()
            continue
        if tag in ENDS_P and open_tags["p"]:
            depth = len(stack) - 1
            while stack[depth][0] != "p" and stack[depth][0] not in LIST_EDGES:
                depth -= 1
            if stack[depth][0] == "p":
                while len(stack) > depth:
                    pop()
        closes = SELF_CLOSING.get(tag)
        if closes and any(open_tags[c] for c in closes):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in LIST_EDGES:
                    break
                if stack[i][0] in closes:
                    while len(stack) > i:
                        pop()
                    break
        if tag not in FLOWING and not hidden:
            close_block()
        if tag in VOID or m[3].endswith("/") and tag not in RAW:
            if tag == "br" and not hidden:
                parts.append(" ")
            continue
        names = frozenset(w for _, value in ATTRIBUTE.findall(m[3]) for w in NAME.findall(value.lower())) if m[3] else frozenset()
        tags, content, furniture = stack[-1][1:] if stack else NOWHERE
        if tag not in INLINE:
            tags = tags if tag in tags else tags | {tag}
            content = content or tag in CONTENT_TAGS
            furniture = furniture or tag in FURNITURE_TAGS or bool(names & FURNITURE_WORDS)
        stack.append((tag, tags, content, furniture))
        open_tags[tag] += 1
        links += tag == "a"
        hidden += tag in HIDDEN
        if tag in RAW:
            end = _cut_raw(page, tag, at)
            put(page[at:end])
            at = end
    close_block()
    return out


def _size(n: float, steps: tuple) -> int:
    return sum(n >= s for s in steps)


def _shape(b: Block, side: str = "") -> list[str]:
    """Features of a block's text: length, links, sentences, case."""
    n = b.text.count(" ") + 1
    ends = "." if b.text[-1] in ".!?…。:;" else "-"
    return [f"{side}len{_size(n, (2, 4, 8, 15, 30, 60))}", f"{side}link{_size(b.linked / len(b.text), (.01, .3, .6, .95))}",
            f"{side}stops{_size(len(PUNCTUATION.findall(b.text)), (1, 2, 4))}", f"{side}ends{ends}"]


def features(page_blocks: list[Block], marked: bool = True) -> list[list[str]]:
    """Feature names per block: its text and its neighbours', its ancestors, and
    (`marked`) whether a content element or furniture is among them."""
    shapes = [_shape(b) for b in page_blocks]
    out = []
    for i, b in enumerate(page_blocks):
        own = ["bias", *shapes[i], "first" if i == 0 else "last" if i == len(page_blocks) - 1 else "inner"]
        own += [f"before-{f}" for f in (shapes[i - 1] if i else ["none"])]
        own += [f"after-{f}" for f in (shapes[i + 1] if i + 1 < len(shapes) else ["none"])]
        if "©" in b.text or "all rights" in b.text.lower():
            own.append("copyright")
        if marked:
            own += {f"tag:{tag}" for tag in b.tags}
            own.append("content" if b.content else "loose")
        else:
            own += {f"tag:{tag}" for tag in b.tags if tag not in CONTENT_TAGS}
            own.append("unmarked")
        if b.furniture:
            own.append("furniture")
        out.append(own)
    return out


class Field:
    """Weights of a linear-chain field with two labels (0 boilerplate, 1 content)."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.emit[[k for f in row if (k := get(f)) is not None]].sum(axis=0) for row in rows]).reshape(-1, 2)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not rows:
            return []
        s, (m00, m01), (m10, m11) = self.scores(rows).tolist(), *self.move.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            back.append((0 if a + m00 >= b + m10 else 1, 0 if a + m01 >= b + m11 else 1))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        labels = [0 if a >= b else 1]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def marginals(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label marginals, expected transitions, and the log partition function."""
    n = len(scores)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = scores[0]
    for t in range(1, n):
        ahead[t] = scores[t] + np.logaddexp(ahead[t - 1, 0] + move[0], ahead[t - 1, 1] + move[1])
    for t in range(n - 2, -1, -1):
        nxt = behind[t + 1] + scores[t + 1]
        behind[t] = np.logaddexp(move[:, 0] + nxt[0], move[:, 1] + nxt[1])
    z = np.logaddexp(*ahead[-1])
    pairs = np.zeros((2, 2))
    if n > 1:
        pairs = np.exp(ahead[:-1, :, None] + move + (scores[1:] + behind[1:])[:, None, :] - z).sum(axis=0)
    return np.exp(ahead + behind - z), pairs, float(z)


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 4, rate: float = 0.3, penalty: float = 1e-4) -> Field:
    """Conditional likelihood by AdaGrad over the pages (features, labels)."""
    index: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index))
    field = Field(index, np.zeros((len(index), 2)), np.zeros((2, 2)))
    power, power_move = np.full_like(field.emit, 1e-8), np.full((2, 2), 1e-8)
    order = random.Random(7)
    numbered = [([[index[f] for f in row] for row in rows], np.array(labels)) for rows, labels in pages if rows]
    for _ in range(epochs):
        order.shuffle(numbered)
        for rows, labels in numbered:
            scores = np.array([field.emit[r].sum(axis=0) for r in rows])
            node, pairs, _ = marginals(scores, field.move)
            gap = np.eye(2)[labels] - node
            gradient = np.zeros_like(field.emit)
            for r, g in zip(rows, gap, strict=True):
                gradient[r] += g
            gradient -= penalty * field.emit
            power += gradient ** 2
            field.emit += rate * gradient / np.sqrt(power)
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            gradient = seen - pairs - penalty * field.move
            power_move += gradient ** 2
            field.move += rate * gradient / np.sqrt(power_move)
    return field


#: Wrappers of blocks that training pages get besides their own, and short texts for them.
FURNITURE = ("<nav><ul><li><a href='/'>{}</a></li><li><a href='/'>{}</a></li></ul></nav>", "<header><div>{}</div><p>{}</p></header>",
             "<footer><p>{}</p><div>&copy; {}</div></footer>", "<aside><h3>{}</h3><p>{}</p></aside>",
             "<div class='sidebar'><p>{}</p><a href='/'>{}</a></div>", "<div class='cookie-notice'><p>{}</p><button>{}</button></div>",
             "<div class='ad'>{}</div><div class='advert'><a href='/'>{}</a></div>",
             "<form action='/'><label>{}</label><input type='text'><p>{}</p></form>",
             "<section id='comments' class='comments'><div class='comment'><p>{}</p></div><div class='comment'><p>{}</p></div></section>",
             "<div class='newsletter'><p>{}</p></div><div class='related'><a href='/'>{}</a></div>")
#: The share of training pages whose content elements the field doesn't get to see, as on pages without any.
HELD_OUT = 0.6
MARKED = r"(?i)<(article|main)[\s>/]"


def training_page(page: str, seed: int) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page with more furniture put in front of, after or inside its content."""
    rng = random.Random(seed)
    words = [w for b in blocks(page) for w in b.text.split(" ")] or ["x"]

    def some():
        at = rng.randrange(len(words))
        return entities.escape(" ".join(words[at:at + rng.choice((1, 2, 4, 12, 40))]), quote=False)

    spots = [m.end() for m in re.finditer(r"(?i)</p>|</h1>|<body[^>]*>|</article>|</main>", page)] or [len(page)]
    for at in sorted(rng.sample(spots, min(len(spots), rng.randrange(4))), reverse=True):
        page = page[:at] + rng.choice(FURNITURE).format(some(), some()) + page[at:]
    page_blocks = blocks(page)
    labels = [int(b.content and not b.furniture) for b in page_blocks]
    return features(page_blocks, marked=rng.random() >= HELD_OUT), labels


def marked_page(page_blocks: list[Block]) -> bool:
    """Whether a content element holds any of the page's text."""
    return any(b.content for b in page_blocks)


def train(pages: DataFrame, sample_pages: int = 600, id_col: str = "page_id", html_col: str = "html") -> Field:
    """A field from a sample of about `sample_pages` pages, whole, chosen by a
    hash of their ids among those that mark their content: a page without a
    content element doesn't say what its content is."""
    rows = pick(pages, page_id=id_col, html=html_col).where(F.col("html").rlike(MARKED))
    n = rows.count()
    drawn = F.pmod(F.xxhash64(F.lit("page"), F.col("page_id")), F.lit(1 << 30)) < min(1.0, sample_pages / max(1, n)) * (1 << 30)
    sample = sorted(((r.page_id is None, r.page_id or 0, r.html) for r in rows.where(drawn).collect()), key=str)
    return fit([training_page(page, seed) for seed, (_, _, page) in enumerate(sample)])


def main_text(page: str | None, field: Field) -> str:
    page_blocks = blocks(page)
    if not field.index:
        labels = [int(b.content) for b in page_blocks]
    else:
        labels = field.decode(features(page_blocks, marked_page(page_blocks)))
    return " ".join(b.text for b, label in zip(page_blocks, labels, strict=True) if label)


def extract(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("bigint"), "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(field)  # a few hundred weights

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, shared.value) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(texts, "page_id bigint, url string, text string, n_chars bigint")
