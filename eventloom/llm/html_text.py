"""Main text of web pages by minimum-cut labelling.

A page's text is cut into blocks at block-level tags. A classifier scores each block (what it stands in, class and id
names, share of link text, length, closing punctuation); positive scores are capacities from the source (content), negative
ones to the sink (boilerplate). Blocks next to each other on the page, and blocks next to each other under one parent, are
joined by smoothness edges that weaken with their distance in the tree. The minimum cut is the labelling of least cost; the
content blocks are the text. Blocks whose score outweighs all their edges keep their sign in some minimum cut, so they are
contracted into the terminals first and max-flow runs on the rest.

Names count by whole class tokens ("sidebar", "post-comments", but not "with-sidebar", "tag-news" or "post-header"). What
stands round the article can't condemn it: a form, or an element that is named like boilerplate, is neutral when it holds
most of the text of article and main elements (also within them), or, on a page without those, most of all text. Nav, footer and aside always
count, and so do reader comments.

Broken markup: an end tag that never comes doesn't take the rest of the page away (but for script and style, as in
browsers); empty svg, math, iframe and object elements may close themselves; a link ends with the block it began in.

Null html: an empty text. Repeated rows and ids: a row each. Pages are handled whole, one by one, at any length, in time
proportional to it (steps in the tree beyond FAR count as FAR). Empty tables give no rows. Other columns are ignored by
main_texts().
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|([^<]+|<)", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>()")
NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Kinds of HTML elements, and words that class and id names use for them.
RAW = frozenset("script style textarea title noscript template iframe object svg math".split())
DROPPED = frozenset("head script style textarea title noscript template iframe object svg math select button canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: These are outside whatever they hold.
ALWAYS = frozenset("nav footer aside menu dialog".split())
COMMENTS = re.compile(r"comments?|commentlist|replies|reply|disqus")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GOOD = frozenset("article content entry story post main body text".split())
BAD = re.compile(
    r"ads?|advert\w*|sponsor\w*|banners?|promo\w*|sidebar|side|comments?|commentlist|replies|reply|disqus|cookies?|consent|gdpr|notices?|alerts?|menu|nav\w*|breadcrumbs?|footer|header|masthead|related|recommended|share|sharing|social|popup|modal|overlay|newsletter|subscribe|signup|login|search|widgets?|tags?|tagcloud|pagination|pager|legal|copyright|disclaimer|complementary|contentinfo|navigation"
)
NEGATED = frozenset("no not with without has have hide hidden show is layout page body".split())
TAXONOMY = frozenset("tag category type status format post author hentry".split())
OF_ARTICLE = frozenset("post entry article content story main text".split())
TOP = frozenset("header masthead".split())
#: Behind a word for boilerplate these name a part of the page; other words (share-price, alert-system) name a topic.
PARTS = frozenset(
    "area bar block body box btn button buttons card cards carousel cell center col column container content cta footer form frame grid group head header heading holder icon icons image img inline inner item items label left link links list logo message more nav outer overlay panel panels posts articles stories news pages placeholder popup right row section sections slider slot space strip tab table tabs text this tile title toggle top tower unit units us video view window wrap wrapper zone bottom main middle leaderboard rectangle skyscraper".split()
)
CLOSES_P = BLOCK - {"html", "head", "body"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
EMPTY = frozenset("svg math iframe object".split())

ADJACENT, SIBLING, FAR = 1.0, 0.8, 64


def names_kind(names: str, tag: str, inside: bool = False) -> tuple[bool, bool, bool]:
    """(like boilerplate, like an article, like comments) of class, id and role names, token by token. inside: of an article,
    where a token's last part has to name a part of a page too."""
    bad = good = remarks = False
    for token in names.lower().split():
        parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"side-?bar", "sidebar", token)) if x]
        if not parts or parts[0] in NEGATED and len(parts) > 1:
            continue
        hits = [x for x in (parts[0], parts[-1]) if BAD.fullmatch(x)]
        if len(parts) > 1 and parts[0] in TAXONOMY and parts[0] != "post" and parts[-1] not in ("cloud", "list", "links", "widget"):
            hits = []
        if parts[0] in OF_ARTICLE or tag in HEADINGS:  # a heading of the article, not the page's
            hits = [x for x in hits if x not in TOP]
        last = next((x for x in reversed(parts) if not x.isdigit()), "")
        if inside and len(parts) > 1 and last not in PARTS and not BAD.fullmatch(last):
            hits = []
        if tag in ("article", "main"):
            hits = [x for x in hits if x.startswith(("comment", "repl"))] if parts[-1] not in ("open", "closed") else []
        bad, remarks = bad or bool(hits), remarks or any(COMMENTS.fullmatch(x) for x in hits)
        good = good or parts[0] in GOOD or parts[-1] in GOOD
    return bad, good, remarks


class Node:
    __slots__ = ("tag", "parent", "depth", "block", "bad", "good", "remarks", "article", "chars", "core", "bias")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block: Node = self if tag in BLOCK or parent is None else parent.block
        self.bad = self.good = self.remarks = False
        if attributes and "=" in attributes and tag not in ("html", "body"):
            names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes))
            if names:
                self.bad, self.good, self.remarks = names_kind(names, tag, bool(parent and parent.article))
        self.article = tag in ("article", "main") and not self.bad or bool(parent and parent.article)
        #: Characters of text in it, and those of them in article and main elements; what it adds up to for its text.
        self.chars, self.core, self.bias = 0, 0, 0.0

    def own(self, total: int, core: int) -> float:
        """What this element by itself adds to the bias of what is in it."""
        if self.tag in ALWAYS or self.remarks:
            return -8.0
        if self.bad or self.tag in OUTSIDE or self.tag == "header" and not self.article:
            held = self.chars if self.article else self.core
            around = held * 2 > core if core else self.chars * 2 > total
            return 0.0 if around and self.tag not in ("article", "main") else -8.0
        return (3.0 if self.tag in ("article", "main") else 0.0) + (1.5 if self.good else 0.0)


def set_biases(found: list[Block]) -> None:
    """Counts each element's text and sums biases up from the root."""
    seen: dict[int, Node] = {}
    for b in found:
        b.node.chars += len(b.text)
        x: Node | None = b.node
        while x is not None and id(x) not in seen:
            seen[id(x)] = x
            x = x.parent
    ordered = sorted(seen.values(), key=lambda x: -x.depth)
    for x in ordered:
        if x.tag in ("article", "main") and not x.bad:
            x.core = x.chars
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.core += x.core
    if ordered:
        root = ordered[-1]
        for x in reversed(ordered):
            x.bias = (x.parent.bias if x.parent is not None else 0.0) + x.own(root.chars, root.core)


class Block:
    __slots__ = ("text", "node", "links", "cost")

    def __init__(self, text: str, node: Node, links: int):
        self.text, self.node, self.links, self.cost = text, node, links, 0.0


def score(b: Block) -> float:
    """Above 0: content."""
    n = len(b.text)
    s = b.node.bias - 0.6 + min(n, 400) / 200
    if b.links * 2 > n:
        s -= 2.5
    if b.text[-1:] in ".!?:;…。！？":
        s += 0.7
    if b.node.tag == "p":
        s += 0.8
    elif b.node.tag in ("h1", "h2", "h3", "blockquote", "pre"):
        s += 0.5
    elif b.node.tag in ("li", "dt", "dd", "td", "th"):
        s -= 0.3
    return s


def blocks(page: str) -> list[Block]:
    """Text blocks with their places in the tree, scored; script, style and the like are dropped with what is in them."""
    root = Node("#root", None, "")
    stack, out, parts, links, in_link = [root], [], [], 0, False
    opened: dict[str, int] = {}
    dropped, last_gt = 0, page.rfind(">")
    last_close: dict[str, int] = {}

    def closes_after(tag: str, at: int) -> bool:
        if tag not in last_close:
            last = -1
            for m in re.finditer(rf"</{tag}(?![A-Za-z0-9:-])", page, re.I):
                last = m.start()
            last_close[tag] = last
        return last_close[tag] >= at

    def flush():
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1].block, links))
            parts.clear()
        links = 0

    def cut(i: int) -> None:
        """Closes the elements from place i on."""
        nonlocal dropped
        for x in stack[i:]:
            opened[x.tag] -= 1
            dropped -= x.tag in DROPPED
        del stack[i:]

    def say(text: str) -> None:
        nonlocal links
        if not dropped:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            links += len(text) if in_link else 0

    at, end = 0, len(page)
    while at < end:
        if at > last_gt:  # no tag ends behind this: what looks like one goes with the rest
            cutoff = re.compile(r"<(?=[A-Za-z/!?])").search(page, at)
            say(page[at : cutoff.start() if cutoff else end])
            break
        m = TOKEN.match(page, at)
        if m[4] == "<" and (loose := LOOSE.match(page, at)):  # an attribute's quotation never ends
            m = loose
        at = m.end()
        if m[4]:
            say(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a" or tag in BLOCK:
                in_link = False
            if tag in BLOCK:
                flush()
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut(i)
            continue
        if tag in BLOCK:
            flush()
        if tag == "br":
            say(" ")
        if tag in VOID or tag in EMPTY and m[3].rstrip().endswith("/"):
            continue
        if tag in RAW:
            if closes_after(tag, at):
                at = re.compile(rf"</{tag}(?![A-Za-z0-9:-])[^>]*>?", re.I).search(page, at).end()
            elif tag in ("script", "style"):
                break
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag == "a":
            in_link = True
        closed = SELF_CLOSING.get(tag, ())
        if (tag in CLOSES_P and opened.get("p")) or any(opened.get(x) for x in closed):
            for i in range(len(stack) - 1, 0, -1):
                t = stack[i].tag
                if t == "p" or t in closed:
                    cut(i)
                    break
                if t in BLOCK:
                    break
        if tag in DROPPED and not closes_after(tag, at) and tag != "head":
            continue
        node = Node(tag, stack[-1], m[3])
        opened[tag] = opened.get(tag, 0) + 1
        dropped += tag in DROPPED
        if tag == "body" and opened.get("head"):  # a head that was never closed ends here
            cut(next(i for i, x in enumerate(stack) if x.tag == "head"))
            node = Node(tag, stack[-1], m[3])
        stack.append(node)
    flush()
    set_biases(out)
    for b in out:
        b.cost = score(b)
    return out


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges."""
    out, last_under = [], {}
    for i, b in enumerate(found):
        if i:
            a, c, steps = found[i - 1].node, b.node, 0
            while a is not c and a is not None and c is not None and steps < FAR:
                if a.depth >= c.depth:
                    a = a.parent
                else:
                    c = c.parent
                steps += 1
            out.append((i - 1, i, ADJACENT / (1 + max(0, steps - 2))))
        parent = b.node.parent
        j = last_under.get(id(parent))
        if j is not None and parent is not None:
            out.append((j, i, SIBLING))
        last_under[id(parent)] = i
    return out


def minimum_cut(costs: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node is on the source's side of a minimum cut (the smallest source side)."""
    n = len(costs)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in pairs:
        near[a].append((b, w))
        near[b].append((a, w))
    label: list[bool | None] = [None] * n
    cost = list(costs)
    open_ = [sum(w for _, w in x) for x in near]
    todo = deque(range(n))
    while todo:  # nodes that outweigh their edges to open neighbours are settled, and pull those
        i = todo.popleft()
        if label[i] is None and abs(cost[i]) >= open_[i] and (cost[i] != 0 or open_[i] == 0):
            label[i] = cost[i] > 0
            for j, w in near[i]:
                if label[j] is None:
                    cost[j] += w if label[i] else -w
                    open_[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow(rest, cost, near, label), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _flow(rest: list[int], cost: list[float], near, label) -> list[bool]:
    """Max-flow by shortest augmenting levels (Dinic) among the nodes left open."""
    at = {i: k for k, i in enumerate(rest)}
    n, s, t = len(rest) + 2, len(rest), len(rest) + 1
    to: list[int] = []
    room: list[float] = []
    graph: list[list[int]] = [[] for _ in range(n)]

    def add(a, b, w, back):
        graph[a].append(len(to))
        to.append(b)
        room.append(w)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in rest:
        if cost[i] > 0:
            add(s, at[i], cost[i], 0.0)
        elif cost[i] < 0:
            add(at[i], t, -cost[i], 0.0)
        for j, w in near[i]:
            if i < j and label[j] is None:
                add(at[i], at[j], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * n
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(len(rest))]
        nxt = [0] * n
        while True:
            path, a = [], s
            while a != t:
                while nxt[a] < len(graph[a]):
                    e = graph[a][nxt[a]]
                    if room[e] > tiny and level[to[e]] == level[a] + 1:
                        break
                    nxt[a] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    a = to[e ^ 1]
                    nxt[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if a != t:
                break
            least = min(room[e] for e in path)
            for e in path:
                room[e] -= least
                room[e ^ 1] += least


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    side = minimum_cut([b.cost for b in found], edges(found))
    return "\n".join(b.text for b, content in zip(found, side, strict=True) if content)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(C.tidy(run), "page_id long, url string, text string, n_chars long")
