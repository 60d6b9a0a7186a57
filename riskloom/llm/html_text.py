"""Main text of web pages by wrapper induction.

The pages of a host share a template, or several: pages are grouped by the containers and classes that they
use, groups of few pages by the containers alone, and what is left goes to the host's largest group.  The page of
median size is the seed of its group; every page of the group is aligned with it by simple tree matching over block
elements, and what the seed lacks is added to its wrapper below the node where it hangs: a text that makes up most of
what hangs there is template too.  Counted over all pages, a seed node whose text
stays the same is template, and one whose text varies is a slot, where pages of the same visible text count once; the slot that holds most of the
varying text is where the host keeps its content.  A page's text is what is aligned with the host's slot,
without the own text of template nodes; article and main elements narrow it only where they hold nearly all of it.
Where the host has too few pages, or the page nothing at the slot, these elements are taken if they hold most of the
page, else the page.  Menus, footers,
adverts, forms, notices and comments are left out by their elements and by the words of class, id and role.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ship, small_side, stored

#: A seed node is template if one text stands on half of at least so many pages, or texts are few for the pages.
FEW_PAGES, SAME_SHARE = 3, 0.5
MANY_PAGES, DISTINCT_SHARE = 20, 0.2
#: With fewer different pages a shape joins the next larger group.
GROUP_PAGES = 5
#: The slot is the deepest node with blocks inside that holds this share of a host's varying text.
SLOT_SHARE = 0.9
#: Without a slot, article and main elements are believed if they hold this share of the text.
TAG_SHARE = 0.5
#: Children of two nodes are aligned in plain lists up to so many pairs, beyond in arrays.
PLAIN_CELLS = 400
#: Cells of an alignment whose choices are held at once; of a larger one, single rows are kept and the choices between them made again.
HELD_CELLS = 200_000_000
#: Wrappers up to so many characters together are offered for broadcast.
WRAPPER_CHARS = 4_000_000

# Element names of HTML and words that sites use for what is not content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template svg select annotation".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math maction menclose mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics object audio video".split()
)
DROPPED = set("nav footer aside form button fieldset dialog menu canvas head input datalist".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_WORDS = set(
    """nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr banner notice notices alert advert adverts advertisement
    advertisements advertising ad ads adsense sponsor sponsored sponsors promo promotion promoted comment comments commentlist respond reply replies discussion disqus share sharing social
    related recommended newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar skip masthead""".split()
)
HEADER_WORDS = set("header topbar".split())
#: Words that may stand beside those above in a class or id; one with any other word names a subject.
HELPERS = set(
    """area article articles bar block body bottom box button buttons col column container content count feed first form global group head header holder icon icons inline inner
    item items last left link links list main media module outer page panel post posts primary region right row secondary section site slot stories text the thread title top unit wrap wrapper zone""".split()
)
#: An id made of these alone may name a chapter of the text.
SUBJECTS = set("alert discussion notice notices promotion related reply respond share sharing social".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text, whose ids come from what they say.
TEXTS = HEADINGS | set("p li dt dd td th tr blockquote pre figure figcaption caption".split())
#: What an opening element closes: open elements of these names, up to the nearest of the names behind.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
MAIN = ("article", "main")
SHAPES = r"(?i)<(div|section|main|article|table|td|center|dl|h1)\b"
CLASSES = r"(?i)<(?:div|section|main|article|table|td)\b[^>]*?\sclass\s*=\s*[\"']?([^\"'>]+)"

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>
    |<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>
    |<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|\b(hidden)\b""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
BLANK = re.compile(r"\s+")


@lru_cache(maxsize=4096)
def named(element: str, key: str, value: str) -> object:
    """Whether a class or id says that an element is no content: one of its names holds a listed word and no word of a subject.

    Headings are never left out for their names, nor running text for its ids.
    """
    found: object = False
    if element in HEADINGS or key == "id" and element in TEXTS:
        return found
    for name in value.split():
        words = {w.lower() for w in WORD.findall(name) if not w.isdigit()}
        if words - DROPPED_WORDS - HELPERS - HEADER_WORDS or key == "id" and words <= SUBJECTS:
            continue
        if words & DROPPED_WORDS:
            return True
        if words & HEADER_WORDS:
            found = "header"
    return found


class Page:
    """The block elements of a page: parallel lists by node in page order, and the events that make up the page.

    An event is a text, the number of a node that opens, or ~number of one that closes.
    """

    def __init__(self, source: str):
        self.tags, self.labels, self.parents, self.depths, self.dropped, self.inline = ["#page"], ["#page"], [-1], [0], [False], [False]
        self.events: list[int | str] = [0]
        self.children: list[list[int]] = [[]]
        stack = [0]
        at, end = 0, len(source)
        while at < end:
            token = TOKEN.search(source, at)
            text = source[at : token.start() if token else end]
            if text:
                self.events.append(text)
            if not token:
                break
            at = token.end()
            closing, name, rest = token[1] or token[4], token[2] or token[5], token[3] or token[6] or ""
            if not name:
                continue
            name = name.lower()
            if closing:
                self._close(stack, name)
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*+>|\Z", re.I).search(source, at)
                at = stop.end() if not rest.endswith("/") else at
                continue
            if name == "br":
                self.events.append(" ")
            drops, label = self._judge(name, rest)
            if name in VOID or name in INLINE and not drops:
                continue
            if name not in INLINE:
                self._make_room(stack, name)
            node = len(self.tags)
            self.tags.append(name)
            self.labels.append(label)
            self.parents.append(stack[-1])
            self.children.append([])
            self.children[stack[-1]].append(node)
            self.depths.append(len(stack))
            self.dropped.append(drops and not (drops == "header" and self._in_main(stack)))
            self.inline.append(name in INLINE)
            self.events.append(node)
            if rest.endswith("/"):
                self.events.append(~node)
            else:
                stack.append(node)
        while stack:
            self.events.append(~stack.pop())

    def _in_main(self, stack: list[int]) -> bool:
        return any(self.tags[n] in MAIN for n in stack)

    @staticmethod
    def _judge(name: str, rest: str) -> tuple[object, str]:
        """Whether an element is left out with all it holds, and its label for the alignment."""
        drops: object = name in DROPPED
        names = ""
        if name == "header":
            drops = "header"
        if "=" in rest or "hidden" in rest:
            for key, *values, flag in ATTRIBUTE.findall(rest):
                value, key = values[0] or values[1] or values[2], key.lower()
                if key in ("class", "id") and name not in ("html", "body", *MAIN):
                    drops = drops if drops is True else named(name, key, value) or drops
                    if key == "class":
                        names = value
                elif key == "role":
                    drops = drops or value.lower() in DROPPED_ROLES
                elif flag or key == "style" and "display:none" in value.replace(" ", "").lower() or key == "aria-hidden" and value == "true":
                    drops = True
        return drops, f"{name}.{names}" if names else name

    def _close(self, stack: list[int], name: str) -> None:
        if name in INLINE and not self.inline[stack[-1]]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == name:
                while len(stack) > k:
                    self.events.append(~stack.pop())
                return

    def _make_room(self, stack: list[int], name: str) -> None:
        while len(stack) > 1 and (self.tags[stack[-1]] == "p" or self.inline[stack[-1]]):
            self.events.append(~stack.pop())
        if name in CLOSES:
            closes, upto = CLOSES[name]
            for k in range(len(stack) - 1, 0, -1):
                if self.tags[stack[k]] in upto:
                    return
                if self.tags[stack[k]] in closes:
                    while len(stack) > k:
                        self.events.append(~stack.pop())
                    return

    def shapes(self, known: dict | None = None) -> tuple[list[int], dict]:
        """A number for every node, equal where whole subtrees have equal labels, and the numbers' names; known has those of another page."""
        known, own, out = known or {}, {}, [0] * len(self.tags)
        for node in range(len(self.tags) - 1, -1, -1):
            name = (self.labels[node], *(out[c] for c in self.children[node]))
            number = known.get(name)
            out[node] = own.setdefault(name, len(known) + len(own)) if number is None else number
        return out, own

    def wholes(self) -> list[int]:
        """The number of nodes of every subtree; nodes are in page order, so a subtree's are consecutive."""
        out = [1] * len(self.tags)
        for node in range(len(self.tags) - 1, 0, -1):
            out[self.parents[node]] += out[node]
        return out

    def own_texts(self) -> dict[int, str]:
        """The text that stands directly in each node."""
        texts: dict[int, list[str]] = {}
        stack: list[int] = []
        for event in self.events:
            if isinstance(event, str):
                texts.setdefault(stack[-1], []).append(event)
            elif event >= 0:
                stack.append(event)
            else:
                stack.pop()
        clean = {node: squeeze("".join(parts)) for node, parts in texts.items()}
        return {node: text for node, text in clean.items() if text}

    def hidden(self) -> list[bool]:
        """Whether a node or one around it is left out."""
        out: list[bool] = []
        for node, drops in enumerate(self.dropped):
            out.append(bool(drops) or node > 0 and out[self.parents[node]])
        return out

    def blocks(self, container: int, without: set[int]) -> list[str]:
        """Texts of the blocks in a container, in page order, but for the own text of nodes in `without`."""
        out, parts, skipped, inside = [], [], 0, False
        stack: list[int] = []

        def end_block() -> None:
            text = squeeze("".join(parts))
            parts.clear()
            if text:
                out.append(text)

        for event in self.events:
            if isinstance(event, str):
                if inside and not skipped and stack[-1] not in without:
                    parts.append(event)
                continue
            node = event if event >= 0 else ~event
            opens = event >= 0
            if opens:
                stack.append(node)
            else:
                stack.pop()
            if node == container:
                inside = opens
                end_block()
            elif inside and (skipped or self.dropped[node]):
                if self.dropped[node]:
                    skipped += 1 if opens else -1
                if not self.inline[node] and not (skipped and not opens):
                    end_block()
            elif inside:
                if not self.inline[node]:
                    end_block()
        return out

    def marked(self, container: int, hidden: list[bool]) -> list[int]:
        """The outermost article and main elements below a container, but for those left out."""
        out, todo = [], list(reversed(self.children[container]))
        while todo:
            node = todo.pop()
            if hidden[node]:
                continue
            if self.tags[node] in MAIN:
                out.append(node)
            else:
                todo += reversed(self.children[node])
        return out


def squeeze(text: str) -> str:
    return BLANK.sub(" ", html.unescape(text)).strip()


class Alignment:
    """Simple tree matching of page b with page a: equal labels, parents matched and order kept, as many nodes as can be.

    Subtrees are compared once for each pair of different shapes, equal ones are matched whole, and equal children at
    both ends of a list are matched before the rest is aligned.  There is no limit to the pairs: time and memory grow with
    the pairs of different shapes that hold elements and meet under one label, so at most with the product of the pages.
    """

    def __init__(self, a: Page, b: Page, shapes: tuple[list[int], dict], wholes: list[int]):
        self.a, self.b, self.whole, self.x_shape = a, b, wholes, shapes[0]
        self.y_shape = b.shapes(shapes[1])[0]
        self.sizes: dict[int, dict[int, int]] = {}

    def ends(self, x: int, y: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        """Equal children at the beginnings and ends, matched, and the children between."""
        xs, ys, sx, sy = self.a.children[x], self.b.children[y], self.x_shape, self.y_shape
        low, high_x, high_y = 0, len(xs), len(ys)
        while low < min(high_x, high_y) and sx[xs[low]] == sy[ys[low]]:
            low += 1
        while high_x > low and high_y > low and sx[xs[high_x - 1]] == sy[ys[high_y - 1]]:
            high_x, high_y = high_x - 1, high_y - 1
        return [*zip(xs[:low], ys[:low]), *zip(xs[high_x:], ys[high_y:])], xs[low:high_x], ys[low:high_y]

    def shape_pairs(self, xs: list[int], ys: list[int]) -> Iterator[tuple[int, int]]:
        """A pair of nodes for every pair of different shapes under one label, where both hold elements."""
        by_x = {self.x_shape[x]: x for x in xs if self.a.children[x]}
        by_y = {self.y_shape[y]: y for y in ys if self.b.children[y]}
        named: dict[str, list[int]] = {}
        for y in by_y.values():
            named.setdefault(self.b.labels[y], []).append(y)
        for shape, x in by_x.items():
            yield from ((x, y) for y in named.get(self.a.labels[x], ()) if shape != self.y_shape[y])

    def size(self, x: int, y: int) -> int:
        """Nodes matched in two subtrees that have been settled; of others, only those without elements have equal labels."""
        if self.a.labels[x] != self.b.labels[y]:
            return 0
        shape = self.x_shape[x]
        return self.whole[x] if shape == self.y_shape[y] else self.sizes.get(shape, {}).get(self.y_shape[y], 1)

    def settle(self) -> None:
        """The sizes of all pairs of shapes that meet below the roots, the lower ones first."""

        def opened(x: int, y: int) -> tuple:
            same, xs, ys = self.ends(x, y)
            return x, y, same, xs, ys, self.shape_pairs(xs, ys)

        todo = [opened(0, 0)] if self.x_shape[0] != self.y_shape[0] else []
        while todo:
            x, y, same, xs, ys, below = todo[-1]
            lower = next((p for p in below if self.y_shape[p[1]] not in self.sizes.get(self.x_shape[p[0]], ())), None)
            if lower:
                todo.append(opened(*lower))
                continue
            self.sizes.setdefault(self.x_shape[x], {})[self.y_shape[y]] = 1 + sum(self.whole[c] for c, _ in same) + self.most(xs, ys)
            todo.pop()

    def rows(self, xs: list[int], ys: list[int]) -> Callable[[np.ndarray, int], np.ndarray]:
        """A function from the sums that the first i children reach with each number of ys to those of one more child."""
        y_kinds, y_at, y_kind = np.unique([self.y_shape[y] for y in ys], return_index=True, return_inverse=True)
        known: dict[int, np.ndarray] = {}

        def after(last: np.ndarray, i: int) -> np.ndarray:
            shape = self.x_shape[xs[i]]
            if shape not in known:
                known[shape] = np.array([self.size(xs[i], ys[j]) for j in y_at], dtype=np.int32)
            row = last.copy()
            np.maximum(row[1:], last[:-1] + known[shape][y_kind], out=row[1:])
            return np.maximum.accumulate(row)

        return after

    def most(self, xs: list[int], ys: list[int]) -> int:
        """The sum of sizes that an alignment of these children reaches."""
        if not xs or not ys:
            return 0
        if len(xs) * len(ys) > PLAIN_CELLS:
            after, sums = self.rows(xs, ys), np.zeros(len(ys) + 1, dtype=np.int64)
            for i in range(len(xs)):
                sums = after(sums, i)
            return int(sums[-1])
        labels, shapes, last = [self.b.labels[y] for y in ys], [self.y_shape[y] for y in ys], [0] * (len(ys) + 1)
        for x in xs:
            label, shape, top, row = self.a.labels[x], self.x_shape[x], 0, [0]
            sizes = self.sizes.get(shape, {})
            for j, other in enumerate(shapes):
                if labels[j] == label:
                    top = max(top, last[j] + (self.whole[x] if other == shape else sizes.get(other, 1)))
                if last[j + 1] > top:
                    top = last[j + 1]
                row.append(top)
            last = row
        return last[-1]

    def aligned(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """Pairs of children in order whose sizes add up to the most."""
        if not xs or not ys:
            return []
        if len(xs) * len(ys) <= PLAIN_CELLS:
            return self.aligned_plainly(xs, ys)
        after = self.rows(xs, ys)
        step = max(1, HELD_CELLS // len(ys))
        last = np.zeros(len(ys) + 1, dtype=np.int64)
        starts = [last]
        for i in range((len(xs) - 1) // step * step):
            last = after(last, i)
            if (i + 1) % step == 0:
                starts.append(last)
        bit = lambda bits, k: bits[k >> 3] >> (7 - (k & 7)) & 1
        out, i, j = [], len(xs), len(ys)
        while starts and j:
            first, last, ups, lefts = (len(starts) - 1) * step, starts.pop(), [], []
            for k in range(first, i):
                row = after(last, k)
                ups.append(np.packbits(row == last))
                lefts.append(np.packbits(row[1:] == row[:-1]))
                last = row
            while i > first and j:
                if bit(ups[i - 1 - first], j):
                    i -= 1
                elif bit(lefts[i - 1 - first], j - 1):
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((xs[i], ys[j]))
        return out

    def aligned_plainly(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        rows = [[0] * (len(ys) + 1)]
        for x in xs:
            last, row = rows[-1], [0]
            for j, y in enumerate(ys):
                row.append(max(last[j + 1], row[-1], last[j] + self.size(x, y)))
            rows.append(row)
        out, i, j = [], len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[i], ys[j]))
        return out

    def pairs(self) -> dict[int, int]:
        """Nodes of b by node of a."""
        if self.a.labels[0] != self.b.labels[0]:
            return {}
        self.settle()
        out, todo = {}, [(0, 0)]
        while todo:
            x, y = todo.pop()
            if self.x_shape[x] == self.y_shape[y]:
                out.update(zip(range(x, x + self.whole[x]), range(y, y + self.whole[x])))
                continue
            out[x] = y
            same, xs, ys = self.ends(x, y)
            todo += same
            todo += self.aligned(xs, ys)
        return out


def matched(a: Page, b: Page) -> dict[int, int]:
    """Simple tree matching: nodes of b by node of a; what is known of the seed a is kept with it."""
    if not hasattr(a, "known"):
        a.known = a.shapes(), a.wholes()
    return Alignment(a, b, *a.known).pairs()


@lru_cache(maxsize=256)
def seed_page(source: str) -> Page:
    return Page(source)


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def added(page: Page, pairs: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each node without a seed node: the seed node that it hangs below and a hash of the labels in between."""
    seeds, out, paths = {y: x for x, y in pairs.items()}, {}, {}
    for node in range(1, len(page.tags)):
        if node not in seeds:
            parent = page.parents[node]
            anchor, path = (seeds[parent], "") if parent in seeds else paths[parent]
            paths[node] = anchor, path = anchor, f"{digest(path + '/' + page.labels[node])}"
            out[node] = anchor, int(path)
    return out


def slot_texts(page: Page, seed: Page) -> list[tuple[int, int, int, int]]:
    """Node, path, hash of a text and its length for each text of a page: path 0 at the seed node that it matches, else below it."""
    texts, hidden, pairs = page.own_texts(), page.hidden(), matched(seed, page)
    found = [(x, 0, digest(texts[y]), len(texts[y])) for x, y in pairs.items() if y in texts and not hidden[y]]
    for y, (anchor, path) in added(page, pairs).items():
        if y in texts and not hidden[y]:
            found.append((anchor, path, digest(texts[y]), len(texts[y])))
    return found


def content_slot(seed: Page, varying: dict[int, int]) -> int:
    """The deepest seed node with blocks inside that holds SLOT_SHARE of the varying characters."""
    below = [varying.get(n, 0) for n in range(len(seed.tags))]
    for node in range(len(seed.tags) - 1, 0, -1):
        below[seed.parents[node]] += below[node]
    slot, share = 0, SLOT_SHARE * below[0]
    while share and (deeper := [c for c in seed.children[slot] if below[c] >= share and seed.children[c]]):
        slot = deeper[0]
    return slot


def main_text(page: Page, seed: Page | None, template: set[int], varying: dict[int, int], common: frozenset = frozenset()) -> str:
    """The blocks of the main text, each on a line; common has (node, path, hash) of template texts that the seed lacks."""
    hidden = page.hidden()
    size = lambda blocks: sum(map(len, blocks))
    container, without, share = 0, set(), TAG_SHARE
    if seed is not None and varying:
        pairs = matched(seed, page)
        without = {pairs[n] for n in template if n in pairs}
        if common:
            texts = page.own_texts()
            without |= {y for y, place in added(page, pairs).items() if y in texts and (*place, digest(texts[y])) in common}
        slot = pairs.get(content_slot(seed, varying), 0)
        if slot and not hidden[slot]:
            container, share = slot, SLOT_SHARE
    blocks = page.blocks(container, without)
    if not blocks and without:
        without = set()
        blocks = page.blocks(container, without)
    nodes = [container]
    while any(page.tags[n] != "article" for n in nodes):
        inner = [m for n in nodes for m in ([n] if page.tags[n] == "article" else page.marked(n, hidden) or [n])]
        found = [text for n in inner for text in page.blocks(n, without)]
        if inner == nodes or size(found) < share * size(blocks):
            break
        nodes, blocks = inner, found
    return "\n".join(blocks)


def host(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def shaped(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host, and hashes of the containers that a page uses: with their classes (fine), without (coarse)."""
    tags = F.transform(F.regexp_extract_all("html", F.lit(SHAPES), F.lit(1)), F.lower)
    classes = F.regexp_extract_all("html", F.lit(CLASSES), F.lit(1))
    some = F.coalesce(F.array_sort(F.array_distinct(tags)), F.array().cast("array<string>"))
    named = F.coalesce(F.array_sort(F.array_distinct(classes)), F.array().cast("array<string>"))
    return pages.select("page_id", "url", "html", host("url").alias("host"), F.xxhash64(some, named).alias("fine"), F.xxhash64(some).alias("coarse"))


def groups(seen: DataFrame) -> DataFrame:
    """The group of every host, fine and coarse; seen has a row per different page."""
    shapes = stored(seen.groupBy("host", "fine", "coarse").agg(F.count("*").alias("n")), "shapes")
    few = shapes.filter(F.col("n") < GROUP_PAGES).groupBy("host", "coarse").agg(F.sum("n").alias("alike"))
    level = F.when(F.col("n") >= GROUP_PAGES, 2).when(F.col("alike") >= GROUP_PAGES, 1).otherwise(0)
    named = shapes.join(few, ["host", "coarse"], "left").withColumn("level", level)
    value = F.when(F.col("level") == 2, F.col("fine")).when(F.col("level") == 1, F.col("coarse")).otherwise(F.lit(0))
    named = stored(named.withColumn("group", F.xxhash64("level", value)), "named")
    sizes = named.groupBy("host", "level", "group").agg(F.sum("n").alias("n"))
    largest = sizes.filter("level > 0").groupBy("host").agg(F.max(F.struct("n", "group")).alias("largest"))
    rest = sizes.filter((F.col("level") == 0) & (F.col("n") < GROUP_PAGES)).join(largest, "host").select("host", F.col("largest.group").alias("other"), F.lit(0).alias("level"))
    return named.join(rest, ["host", "level"], "left").select("host", "fine", "coarse", F.coalesce("other", "group").alias("group"))


def seeds(hosted: DataFrame) -> DataFrame:
    """The group of every host, fine and coarse, with the group's page of median size."""
    marked = hosted.filter(F.contains("html", F.lit("<")))
    seen = stored(marked.select("host", "fine", "coarse", F.length("html").alias("n"), F.xxhash64("html").alias("h")).distinct(), "seen")
    named = stored(groups(seen), "groups")
    grouped = seen.join(small_side(named), ["host", "fine", "coarse"])
    middle = grouped.groupBy("host", "group").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n)").cast("int").alias("n"))
    first = stored(grouped.join(small_side(stored(middle, "medians")), ["host", "group", "n"]).groupBy("host", "group", "n").agg(F.min("h").alias("h")), "chosen")
    chosen = small_side(first.select(F.col("host").alias("seed_host"), F.col("group").alias("seed_group"), F.col("n").alias("seed_n"), "h"))
    same = (F.col("host") == F.col("seed_host")) & (F.length("html") == F.col("seed_n")) & (F.xxhash64("html") == F.col("h"))
    pages = marked.join(chosen, same).groupBy("seed_host", "seed_group").agg(F.min("html").alias("seed"))
    return named.join(pages, (F.col("host") == F.col("seed_host")) & (F.col("group") == F.col("seed_group"))).select("host", "fine", "coarse", "group", "seed")


def wrapped(hosted: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Pages with the wrapper of their group; it is offered for broadcast only if all wrappers are small together."""
    chars = wrappers.agg(F.coalesce(F.sum(F.length("seed")), F.lit(0))).first()[0]
    return hosted.join(F.broadcast(wrappers) if chars <= WRAPPER_CHARS else wrappers, ["host", "fine", "coarse"], "left")


def induced(hosted: DataFrame) -> DataFrame:
    """host, fine, coarse, seed, `stats` (node, pages, distinct texts, pages of the commonest text, characters) and `common` (node, path, text) of every group."""
    ship(__name__)
    chosen = stored(seeds(hosted), "seeds")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, group, source, seed in zip(*(batch.column(c).to_pylist() for c in ("host", "group", "html", "seed"))):
                if source and seed:
                    found = slot_texts(Page(source), seed_page(seed))
                    page = digest(" ".join(map(str, sorted(x[2] for x in found))))
                    rows += [(name, group, page, *x) for x in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["host", "group", "page", "node", "path", "text", "chars"])

    pages = wrapped(hosted, chosen).select("host", "group", "html", "seed")
    once = pages.mapInArrow(work, "host string, group long, page long, node long, path long, text long, chars long").distinct()
    place = ["host", "group", "node", "path"]
    texts = stored(once.groupBy(*place, "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")), "texts")
    nodes = texts.filter("path = 0").groupBy("host", "group", "node").agg(F.sum("n").alias("pages"), F.count("*").alias("texts"), F.max("n").alias("top"), F.sum("chars").alias("chars"))
    below = texts.filter((F.col("path") != 0) & (F.col("n") < FEW_PAGES)).groupBy("host", "group", "node").agg(F.sum("chars").alias("chars"))
    zero = F.lit(0).cast("long")
    nodes = nodes.unionByName(below.withColumns({"pages": zero, "texts": zero, "top": zero}))
    stats = nodes.groupBy("host", "group").agg(F.collect_list(F.array("node", "pages", "texts", "top", "chars")).alias("stats"))
    often = texts.filter((F.col("path") != 0) & (F.col("n") >= FEW_PAGES)).select(*place, "text", F.col("n").alias("times"))
    every = texts.filter("path != 0").groupBy(*place).agg(F.sum("n").alias("n"))
    same = often.join(every, place).filter(F.col("times") >= SAME_SHARE * F.col("n"))
    common = same.groupBy("host", "group").agg(F.collect_list(F.array("node", "path", "text")).alias("common"))
    learnt = stats.join(common, ["host", "group"], "left")
    return stored(chosen.join(learnt, ["host", "group"], "left").select("host", "fine", "coarse", "seed", "stats", "common"), "wrappers")


def is_template(pages: int, texts: int, top: int) -> bool:
    return pages >= FEW_PAGES and top >= SAME_SHARE * pages or pages >= MANY_PAGES and texts <= DISTINCT_SHARE * pages


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    pages needs page_id, url and html; other columns are ignored.  A null or empty html gives an empty text.
    Pages whose url has no host are one host.  Repeated rows give repeated rows; an empty table gives none.
    """
    ship(__name__)
    hosted = shaped(pages)

    def text(source: str | None, seed: str | None, stats: list | None, common: list | None) -> str:
        if not source:
            return ""
        stats = stats or ()
        template = {n for n, pages, texts, top, _ in stats if is_template(pages, texts, top)}
        varying: dict[int, int] = {}
        for n, pages, _, _, chars in stats:
            if n not in template or not pages:
                varying[n] = varying.get(n, 0) + chars
        if max((pages for _, pages, *_ in stats), default=0) < FEW_PAGES:
            varying = {}
        return main_text(Page(source), seed_page(seed) if seed else None, template, varying, frozenset(map(tuple, common or ())))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("html", "seed", "stats", "common")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    kind = dict(pages.dtypes)["page_id"]
    ready = wrapped(hosted, induced(hosted)).select("page_id", "url", "html", "seed", "stats", "common")
    return ready.mapInArrow(work, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
