"""Main text of web pages by minimum cut.

A page is cut into blocks of text at its block tags. A logistic classifier reads the text of a block (length, links, ends
of sentences, capitals, kind of tag); the names and classes of its ancestors add or take a fixed amount. That cost is
the capacity from the source (content) or to the sink (boilerplate). Blocks that follow each other, and more so the
nearer they are in the tree, are joined by smoothness edges. The maximum flow leaves the cheapest labelling of all blocks
of the page at once, so that a short paragraph among long ones stays and a long notice among links goes.

The classifier learns from the blocks of at most ``pages`` pages whose ancestors say by themselves what they are.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.words import text_batches

PAGES = 2000
ADJACENT, NEAREST = 0.5, 1.0
INSIDE, OUTSIDE = 4.0, -6.0
TEXT_LIMIT = 3.0
FEATURES = 9
DEFAULT = np.array([-1.0, 1.0, -4.0, 1.5, -0.5, 1.0, 0.3, -0.5, 0.0])  # used where no page tells what its blocks are

# Kinds of tags, and the names by which pages mark their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object select textarea button title head canvas audio video".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
BAD_WORDS = frozenset("""nav navbar navigation menu footer masthead topbar header sidebar side aside ad ads adv advert advertisement
advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
subscribe subscription signup login search comment comments commentlist reply replies disqus respond discussion share sharing social related
recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar copyright legal disclaimer skip contentinfo complementary""".split())
GOOD_WORDS = frozenset("article articlebody content main post entry story maincontent posttext".split())
_OF_THE_BODY = BLOCKS - {"html", "body"} | {"a", "img"}
_CLOSES_P = BLOCKS - {"html", "body"}
_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^"'>]|"[^"]*"|'[^']*')*+)>
|<[/!?A-Za-z][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""", re.S | re.X)
# what such an element holds is no markup but text up to its closing tag
TEXT_ONLY = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title")}
ATTR = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# elements that hold no element of their own kind: one that opens before the last was closed shows that the last never will be
_LONE = frozenset("select button noscript iframe title textarea audio video canvas template".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_STATES = frozenset("has no not with without is".split())  # a class "has-sidebar" tells of another part, not of its own
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)")
_FORM_END = re.compile(r"</form(?=[\s/>])", re.I)


class Block:
    __slots__ = ("text", "linked", "tag", "cue", "path")

    def __init__(self, text: str, linked: int, tag: str, cue: int, path: tuple[int, ...]):
        self.text, self.linked, self.tag, self.cue, self.path = text, linked, tag, cue, path


def is_hidden(attrs: str) -> bool:
    """Whether an element isn't shown: by its ``hidden`` attribute, its style, or a class of that very name."""
    low = attrs.lower()
    if "hidden" not in low and "none" not in low:
        return False
    if _BARE_HIDDEN.search(_QUOTED.sub("", low)):
        return True
    for m in ATTR.finditer(low):
        value = m[2] or m[3] or m[4] or ""
        if (m[1] == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or m[1] == "aria-hidden" and value.strip() == "true"
                or m[1] == "class" and "hidden" in value.split()):
            return True
    return False


def cue_of(tag: str, attrs: str, above: tuple[int, bool, bool], wide: bool = False) -> tuple[int, bool, bool]:
    """(cue, shut, within): what the names of an element and its ancestors say (-1, 0, 1), whether a tag has shut the part out
    for good, and whether it lies within an article. A form that is ``wide`` holds most of the page and says nothing by its tag."""
    cue, shut, within = above
    if wide:
        return (-1 if shut else cue), shut, within
    if tag in BAD_TAGS or tag == "header" and not within:
        return -1, True, within
    if tag in GOOD_TAGS:
        cue, within = 1, True
    if attrs:
        names, low = [], attrs.lower()
        if "class" in low or "id" in low or "role" in low:
            for m in ATTR.finditer(attrs):
                if m[1].lower() in ("class", "id", "role", "itemprop"):
                    for name in (m[2] or m[3] or m[4] or "").split():
                        parts = re.split(r"[^a-z0-9]+", _CAMEL.sub(" ", name).lower())
                        names += parts if parts[0] not in _STATES else []
        if not BAD_WORDS.isdisjoint(names) and tag not in ("body", "html"):
            cue = -1
        elif not GOOD_WORDS.isdisjoint(names) and tag not in ("body", "html") and cue >= 0:
            cue = 1
        if tag not in ("body", "html") and is_hidden(attrs):
            return -1, True, within
    return (-1 if shut else cue), shut, within


def tokens(page: str) -> Iterator[re.Match]:
    """Matches of ``TOKEN``, without what stands in elements of ``TEXT_ONLY``; one that is never closed is read on as markup."""
    at, open_ended = 0, set()
    while at >= 0:
        start, at = at, -1
        for m in TOKEN.finditer(page, start):
            yield m
            tag = m["tag"] and m["tag"].lower()
            if tag in TEXT_ONLY and tag not in open_ended and not m["close"] and not m["attrs"].endswith("/"):
                end = TEXT_ONLY[tag].search(page, m.end())
                if end:
                    at = end.start()
                    break
                open_ended.add(tag)


def blocks_of(page: str) -> list[Block]:
    """Blocks with words, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, bool, bool], int]] = [("", (0, False, False), 0)]
    parts: list[str] = []
    linked = links = serial = 0
    skip = mute = ""
    muted = form_end = 0
    never: set[str] = set()  # kinds of elements that are not closed in the rest of the page

    def is_closed(tag: str, at: int) -> bool:
        if tag in never:
            return False
        end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
        if end is None:
            never.add(tag)
            return False
        return tag not in _LONE or re.compile(rf"<{tag}(?=[\s/>])", re.I).search(page, at, end.start()) is None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                out.append(Block(text, linked, top[0], top[1][0], tuple(s[2] for s in stack)))
            parts.clear()
        linked = 0

    def pop_to(n: int) -> None:
        flush()
        del stack[n:]

    for m in tokens(page):
        text, tag = m["text"], m["tag"]
        if skip == "head" and tag and not m["close"] and tag.lower() in _OF_THE_BODY:
            skip = ""  # the tags between may be left out
        if skip:
            if tag and (tag.lower() == skip and m["close"] or skip == "head" and tag.lower() == "body" and not m["close"]):
                skip = ""
                if not m["close"]:
                    stack.append(("body", stack[-1][1], 0))
            elif skip in ("script", "style", "svg", "noscript") or not tag:
                continue
            continue
        if mute and tag and (tag.lower() == mute or tag.lower() in BLOCKS):
            # a hidden inline element ends with its closing tag, or where a block begins or ends
            muted = 0 if tag.lower() != mute else muted - 1 if m["close"] else muted + 1
            mute = mute if muted else ""
        if text is not None:
            if mute:
                continue
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if not tag:
            continue
        tag, closes = tag.lower(), bool(m["close"])
        if tag in RAW:
            if not closes and not m["attrs"].endswith("/") and (tag in ("head", "script", "style") or is_closed(tag, m.end())):
                skip = tag
                if tag in ("head", "title", "select", "textarea", "button"):
                    flush()
        elif tag == "br" or tag in VOID:
            parts.append(" ")
            if tag == "hr":
                flush()
        elif tag == "a":
            links = 0 if closes else 1
        elif tag in BLOCKS:
            links = 0
            if closes:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if at:
                    pop_to(at)
                else:
                    flush()
                continue
            flush()
            if tag == "form" and any(x[0] == "form" for x in stack):
                continue  # forms don't nest: the tag of an inner one has no effect
            if tag in _CLOSES_P and stack[-1][0] == "p":
                stack.pop()
            if tag in _SAME:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in _SAME[tag]:
                        break
                    if stack[i][0] == tag or tag in ("dt", "dd", "td", "th") and stack[i][0] in ("dt", "dd", "td", "th"):
                        del stack[i:]
                        break
            serial += 1
            if tag == "form" and form_end <= m.end():
                closing = _FORM_END.search(page, m.end())
                form_end = closing.start() if closing else len(page)
            wide = tag == "form" and 2 * (form_end - m.end()) > len(page)
            stack.append((tag, cue_of(tag, m["attrs"], stack[-1][1], wide), serial))
        elif not mute and m["attrs"] and not closes and is_hidden(m["attrs"]) and is_closed(tag, m.end()):
            mute, muted = tag, 1
    flush()
    return out


def text_features(b: Block) -> list[float]:
    words = b.text.split()
    n, size = len(words), len(b.text)
    marks = sum(b.text.count(c) for c in ".!?;,")
    return [1.0, min(np.log1p(n), 5) / 2, min(b.linked / size, 1.0), min(2 * marks / n, 1.0),
            sum(w[0].isupper() for w in words) / n, float(b.tag == "p"), float(b.tag in ("h1", "h2", "h3", "h4", "blockquote", "pre")),
            float(b.tag in ("li", "td", "th", "option", "dt", "dd")), float("©" in b.text)]


# ------------------------------------------------------------------ the cut

def costs(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """Cost of calling a block boilerplate less that of calling it content."""
    text = np.clip(np.array([text_features(b) for b in blocks]) @ weights, -TEXT_LIMIT, TEXT_LIMIT)
    return text + np.array([INSIDE if b.cue > 0 else OUTSIDE if b.cue < 0 else 0.0 for b in blocks])


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other, and between neighbours of the same parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            above = blocks[i - 1].path
            shared = next((k for k, (x, y) in enumerate(zip(above, b.path, strict=False)) if x != y), min(len(above), len(b.path)))
            apart = len(above) + len(b.path) - 2 * shared
            edges[i - 1, i] = ADJACENT + NEAREST / (1 + apart)
        parent = b.path[-2] if len(b.path) > 1 else 0
        if parent in last and last[parent] != i - 1:
            edges[last[parent], i] = edges.get((last[parent], i), 0.0) + NEAREST / 3
        last[parent] = i
    return [(i, j, w) for (i, j), w in edges.items()]


def cut(cost: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the blocks on the source's side of the minimum cut.

    Blocks whose own cost outweighs all their edges are settled at once, and their edges become costs of the others;
    this doesn't change the optimum. The rest goes through the maximum flow.
    """
    n = len(cost)
    own, near = cost.tolist(), [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(own[i]) >= sum(near[i].values()):
            side[i] = own[i] > 0
            for j, w in near[i].items():
                own[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        for i, s in zip(rest, flow_side([own[i] for i in rest], [(at[i], at[j], w) for i in rest for j, w in near[i].items() if i < j]), strict=True):
            side[i] = s
    return np.array(side, bool)


def flow_side(own: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocks that the source still reaches after Dinic's maximum flow."""
    n = len(own)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(i: int, j: int, there: float, back: float) -> None:
        heads[i].append(len(to))
        to.append(j)
        room.append(there)
        heads[j].append(len(to))
        to.append(i)
        room.append(back)

    for i, u in enumerate(own):
        if u > 0:
            join(source, i, u, 0.0)
        elif u < 0:
            join(i, sink, -u, 0.0)
    for i, j, w in edges:
        join(i, j, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in heads[i]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        arc = [0] * (n + 2)
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                i = to[path[full] ^ 1]
                del path[full:]
            while arc[i] < len(heads[i]):
                e = heads[i][arc[i]]
                if room[e] > 1e-9 and level[to[e]] == level[i] + 1:
                    break
                arc[i] += 1
            if arc[i] < len(heads[i]):
                path.append(heads[i][arc[i]])
                i = to[path[-1]]
            elif path:
                i = to[path.pop() ^ 1]
                arc[i] += 1
            else:
                break


def main_text(page: str, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    stay = cut(costs(blocks, weights), smoothness(blocks))
    return " ".join(b.text for b, s in zip(blocks, stay.tolist(), strict=True) if s)


# ------------------------------------------------------------------ on Spark

def fit_classifier(x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.5) -> np.ndarray:
    weights = np.zeros(x.shape[1])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights += rate * (x.T @ (share * (y - p)) - 1e-3 * weights)
    return weights


def learn_classifier(pages: DataFrame, bound: int = PAGES) -> np.ndarray:
    text_batches(pages.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, y, x = [], [], []
            for i, page in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                for block in blocks_of(page):
                    if block.cue:
                        ids.append(i)
                        y.append(int(block.cue > 0))
                        x.append(np.array(text_features(block), np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y, pa.int32()), pa.array(x, pa.binary())], ["page_id", "y", "x"])

    some = pages.where(F.col("page_id").isNotNull() & F.col("html").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "html")
    ids = some.select("page_id", F.xxhash64("page_id").alias("h")).distinct().orderBy("h").limit(bound)
    rows = some.join(F.broadcast(ids.select("page_id")), "page_id").mapInArrow(features, "page_id long, y int, x binary").collect()
    rows = sorted((r.page_id, r.y, bytes(r.x)) for r in rows)
    if len({y for _, y, _ in rows}) < 2:
        return DEFAULT
    return fit_classifier(np.stack([np.frombuffer(x, np.float32) for *_, x in rows]).astype(float), np.array([y for _, y, _ in rows], float))


def main_texts(pages: DataFrame, bound: int = PAGES) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html, any more columns).

    Null or empty html gives an empty text. Pages may end anywhere: what is open at the end is closed. Each page is
    read by itself, so repeated rows get equal texts and an empty table gives no rows. Where no page says by its
    names what its parts are, the classifier has fixed weights.
    """
    weights = learn_classifier(pages, bound)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page or "", weights) for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(
        extracted, "page_id long, url string, text string, n_chars long")
