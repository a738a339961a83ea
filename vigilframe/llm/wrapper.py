"""Main-text extraction by wrapper induction over all pages of a host.

Each page becomes a small tree of its elements (runs of like siblings fold into one node). The distinct
trees of a host are merged by simple tree matching into its wrapper, and every distinct page is aligned
with it: per node Spark sums how many pages have it, how much text and how much of that in links, and
how many pages have each text there. From these the host's nodes are judged once: texts that nearly all
pages of a node have are template; the slots of the element that holds the varying text are content;
slots beside it are adverts, notices and menus, whatever they are called. What HTML or class words say
of an element is a prior of its node: `article` and `main` are taken for that element, `nav`, `footer`,
`ad-slot` and the like for none. A page gives the blocks that lie in its host's content nodes.

Trees are flat lists [[parent, tag, words]] in preorder of their first elements and all walks are loops,
so the depth of a page does not matter.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, durable
from .url_filter import parts

#: Trees that one task merges at once; a host with more of them is merged in rounds.
MERGED = 64
#: Share of a host's text that an element needs to be looked into, and that a slot beside the story needs, of the story's, to stay.
MOST, BESIDE = 0.7, 0.25

# Fixed values of HTML: elements without content, elements that end an open <p>, elements with raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe svg math".split())
#: Elements that hold menus, notices, forms and the like, never the article.
ASIDE_TAGS = frozenset("head nav header footer aside menu dialog button select object canvas audio video".split()) | RAW
#: Words of class, id or role that mark such elements, those of comments, and words that go with them.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer form header login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related search share sharing shares sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
WITH_THEM = frozenset(
    "area articles bar block body bottom box buttons container content group holder inner item items left link links list main outer page panel posts primary right row secondary section site slot text thread top unit wrap wrapper zone".split()
)
CONTENT_TAGS = frozenset("article main".split())
#: Elements that say nothing of what they hold, and those that hold the sentences of a story.
PLAIN, TELLING = frozenset("div section".split()), frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Kinds of `Node.aside`.
CONTENT, MARKED, COMMENT, ASIDE = range(4)

_ATTRIBUTES = r"""(?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "aside", "worst")

    def __init__(self, tag: str, words: str = "", aside: int = CONTENT, parent: Node | None = None):
        self.tag, self.words, self.aside, self.parent = tag, words, aside, parent
        self.worst = max(aside, parent.worst) if parent else aside  # of it and all elements around it
        self.children: list[Node | str] = []


@lru_cache(maxsize=4096)
def _marks(tag: str, attributes: str) -> tuple[str, int]:
    """(class, id and role words without digits, what they or the tag say that the element is).

    A name counts if it is made of such words alone: `ad-slot` and `site-header` do, `with-sidebar`,
    `comments-open` and `social-issues` do not.
    """
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    names = [_WORD.findall(n) for key in ("class", "id", "role") for n in found.get(key, "").lower().split()]
    kind = CONTENT
    if tag in ASIDE_TAGS:
        kind = ASIDE
    elif tag not in ("html", "body"):
        telling = [n for n in names if n and all(w in ASIDE_WORDS or w in COMMENT_WORDS or w in WITH_THEM for w in n)]
        if any(w in COMMENT_WORDS for n in telling for w in n):
            kind = COMMENT
        elif tag == "form" or any(w in ASIDE_WORDS for n in telling for w in n):
            kind = MARKED
    return ".".join(sorted({w for n in names for w in n})), kind


def parse(page: str | None) -> Node:
    """A forgiving tree: unknown end tags are dropped, <p> and <li> end where the next block begins.

    A class word never makes an article, or an element around one, aside, nor does a form around one;
    words of comments do, as long as another article is left.
    """
    root = Node("#root")
    stack, text = [root], page or ""
    opened: Counter = Counter()
    unclosed: set[str] = set()
    named: list[Node] = []
    at = 0

    def shut(names, stops) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                opened.subtract(n.tag for n in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    while m := _TOKEN.search(text, at):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            shut((tag,), () if tag in BLOCKS else BLOCKS)
            continue
        alone = (m[3] or "").endswith("/")
        if tag in RAW and not alone:
            end = None if tag in unclosed else _CLOSE[tag].search(text, at)
            if end:
                at = end.end()
            else:
                unclosed.add(tag)
                if tag in ("script", "style"):
                    at = len(text)
            stack[-1].children.append(" ")
            continue
        if tag in BLOCKS:
            shut(("p",), ("article", "div", "section", "main", "td", "li", "body"))
            if tag == "li":
                shut(("li",), ("ul", "ol", "menu"))
            elif tag in ("dd", "dt"):
                shut(("dd", "dt"), ("dl",))
            elif tag in ("td", "th", "tr"):
                shut(("td", "th") if tag != "tr" else ("tr",), ("table",))
            elif tag == "body":
                shut(("head",), ())
        words, kind = _marks(tag, m[3] or "")
        node = Node(tag, words, kind, stack[-1])
        stack[-1].children.append(node)
        if tag in CONTENT_TAGS:
            named.append(node)
        if tag not in VOID and not alone:
            stack.append(node)
            opened[tag] += 1
    if at < len(text):
        stack[-1].children.append(text[at:])

    seen = {id(root)}
    for most in (MARKED, COMMENT):
        for node in (n for n in named if n.worst <= most):
            while id(node) not in seen:
                seen.add(id(node))
                node.aside, node = CONTENT, node.parent
        if len(seen) > 1:
            break
    return root


# --- folded trees: [[parent, kind of element, words], ...] of the elements that may hold text


class Block(NamedTuple):
    node: int  # of the folded tree
    text: str
    linked: int  # characters of it in links


def clean(text: str) -> str:
    """Character references decoded, white space one space, trimmed."""
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def _shape(node: Node) -> str:
    """What a node of the folded tree is: the tag, `+` for a plain element that holds blocks, and what it is taken for."""
    holds = node.tag in PLAIN and any(not isinstance(c, str) and c.tag in BLOCKS for c in node.children)
    return node.tag + "+" * holds + (f"!{node.aside}" if node.aside else "")


def blocks(root: Node) -> tuple[list, list[Block]]:
    """(folded tree, blocks below `root` in page order). Text of inline elements belongs to the block around them."""
    tree, known = [[-1, root.tag, root.words]], {}
    out: list[Block] = []
    inline: list[tuple[str, bool]] = []

    def flush(at: int) -> None:
        if inline:
            if text := clean("".join(t for t, _ in inline)):
                out.append(Block(at, text, sum(len(t.strip()) for t, linked in inline if linked)))
            inline.clear()

    stack = [(iter(root.children), 0, False, True)]  # children, folded node, in a link, is a block
    while stack:
        children, at, linked, block = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
            if block:
                flush(at)
        elif isinstance(c, str):
            inline.append((c, linked))
        elif c.tag in VOID:
            if c.tag in BLOCKS:
                flush(at)
            elif c.tag == "br":
                inline.append((" ", linked))
        elif c.tag in BLOCKS or c.tag in CONTENT_TAGS or c.aside != CONTENT:
            flush(at)
            key = (at, _shape(c), c.words)
            if key not in known:
                known[key] = len(tree)
                tree.append([at, *key[1:]])
            stack.append((iter(c.children), known[key], linked or c.tag == "a", True))
        else:
            stack.append((iter(c.children), at, linked or c.tag == "a", False))
    return tree, out


@lru_cache(maxsize=8192)
def _set(words: str) -> frozenset:
    return frozenset(words.split("."))


def _children(tree: list) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in tree]
    for i, (parent, _, _) in enumerate(tree):
        if parent >= 0:
            out[parent].append(i)
    return out


def tree_matching(a: list, b: list) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching of folded trees: per pair of nodes that may match (size of the best
    order-preserving match, the matched children).

    Nodes of one tag may match if their words are equal or share one; equal ones count more.
    """
    below, beside = _children(a), _children(b)
    done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    stack = [(0, 0)]
    while stack:
        i, j = stack[-1]
        x, y = below[i], beside[j]
        like = [(p, q) for p in x for q in y if a[p][1] == b[q][1] and (a[p][2] == b[q][2] or not _set(a[p][2]).isdisjoint(_set(b[q][2])))]
        if missing := [pair for pair in like if pair not in done]:
            stack.extend(missing)
            continue
        stack.pop()
        if (i, j) in done:
            continue
        value = {(p, q): 2 * done[p, q][0] + (a[p][2] == b[q][2]) for p, q in like}
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for m, p in enumerate(x):
            for n, q in enumerate(y):
                best[m + 1][n + 1] = max(best[m][n + 1], best[m + 1][n], best[m][n] + value.get((p, q), 0))
        m, n, matched = len(x), len(y), []
        while m and n:
            if best[m][n] == best[m - 1][n]:
                m -= 1
            elif best[m][n] == best[m][n - 1]:
                n -= 1
            else:
                m, n = m - 1, n - 1
                matched.append((x[m], y[n]))
        done[i, j] = best[-1][-1] // 2 + 1, matched[::-1]
    return done


def merge(a: list, b: list) -> list:
    """Both trees in one: matched nodes once, the others in their order between them."""
    matching = tree_matching(a, b)
    below, beside = _children(a), _children(b)
    out = []
    stack: list[tuple[int | None, int | None, int]] = [(0, 0, -1)]  # a node of either, its place in the merged tree
    while stack:
        i, j, parent = stack.pop()
        out.append([parent, *(a[i] if i is not None else b[j])[1:]])
        here, children = len(out) - 1, []
        if i is not None and j is not None:
            left, right = iter(below[i]), iter(beside[j])
            for p, q in [*matching[i, j][1], (None, None)]:
                children += [(x, None, here) for x in iter(lambda: next(left, None), p)]  # noqa: B023
                children += [(None, y, here) for y in iter(lambda: next(right, None), q)]  # noqa: B023
                if p is not None:
                    children.append((p, q, here))
        elif i is not None:
            children = [(x, None, here) for x in below[i]]
        else:
            children = [(None, y, here) for y in beside[j]]
        stack.extend(reversed(children))
    return out


def align(tree: list, page: list) -> list[int]:
    """Per node of the page's tree the number of the wrapper's node that it matches, -1 if none."""
    matching, out, stack = tree_matching(tree, page), [-1] * len(page), [(0, 0)]
    while stack:
        i, j = stack.pop()
        out[j] = i
        stack.extend(matching[i, j][1])
    return out


class Aligner:
    """Alignments of trees with wrappers, both as JSON; pages of one structure align alike."""

    def __init__(self):
        self.held: dict[tuple[str, str], list[int]] = {}

    def __call__(self, tree: str, page: str) -> list[int]:
        if (tree, page) not in self.held:
            if len(self.held) > 2000:
                self.held.clear()
            self.held[tree, page] = align(json.loads(tree), json.loads(page))
        return list(self.held[tree, page])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _hosted(df: DataFrame, small: DataFrame, size: DataFrame) -> DataFrame:
    """Rows of `df` with what `small` has of their host, broadcast if `size` (of one number) allows."""
    return df.join(F.broadcast(small) if (size.first()[0] or 0) <= BROADCAST_BYTES else small, "__vf_host", "left")


def decide(tree: list, stats: dict[int, tuple[int, int]]) -> tuple[list[int], list[int]]:
    """The nodes that hold the story of a wrapper's pages: inside `article` and `main`, and without these.

    `stats` has per node the characters of its varying texts over all pages, and those of them in links.
    Without an article the story is what the element holds that one comes to by going down from the root
    as long as one child has MOST of the text, no sentence stands beside it, and no other child has
    sentences; slots elsewhere stay if they have BESIDE as much text. In the story's element, links that
    stand before its first sentence are a menu. Elements that are marked by class words count only
    where nothing else has text.
    """
    below = _children(tree)
    tag = [re.match(r"[^+!]*", t)[0] for _, t, _ in tree]
    worst, inside = [0] * len(tree), [False] * len(tree)
    for i, (parent, shape, _) in enumerate(tree):  # parents come first
        worst[i] = max(int(shape.partition("!")[2] or 0), worst[parent] if parent >= 0 else 0)
        inside[i] = tag[i] in CONTENT_TAGS or parent >= 0 and inside[parent]
    plain = [max(0, chars - linked) for chars, linked in (stats.get(i, (0, 0)) for i in range(len(tree)))]
    most = next((m for m in (MARKED, COMMENT) if any(plain[i] for i in range(len(tree)) if worst[i] < m)), MARKED)
    good = [w < most for w in worst]
    total, telling = [0] * len(tree), [False] * len(tree)
    for i in reversed(range(len(tree))):
        if good[i] and not inside[i]:
            total[i] += plain[i]
            telling[i] |= tag[i] in TELLING and plain[i] > 0
            if tree[i][0] >= 0:
                total[tree[i][0]] += total[i]
                telling[tree[i][0]] |= telling[i]
    at = 0
    while True:
        children = [c for c in below[at] if good[c] and not inside[c]]
        best = max(children, key=lambda c: (total[c], -c), default=None)
        if best is None or not total[best] or total[best] < MOST * total[at] or tag[best] in TELLING or any(telling[c] for c in children if c != best):
            break
        at = best
    under = [False] * len(tree)
    for i, (parent, _, _) in enumerate(tree):
        under[i] = i == at or parent >= 0 and under[parent]
    begins = next((i for i in range(len(tree)) if under[i] and good[i] and not inside[i] and tag[i] in TELLING and plain[i]), 0)
    menu = [under[i] and i < begins and 10 * stats.get(i, (0, 0))[1] >= 9 * stats.get(i, (0, 0))[0] > 0 for i in range(len(tree))]
    other = [i for i in range(len(tree)) if good[i] and not inside[i] and not menu[i] and (under[i] or plain[i] >= BESIDE * total[at] > 0)]
    return [i for i in range(len(tree)) if good[i] and inside[i]], other


def induce(pages: DataFrame) -> DataFrame:
    """(__vf_host, rules) of pages (__vf_host, html): a host's wrapper, its content nodes and the template texts by node, as JSON.

    A text is template of a node if 0.9 of the distinct pages that have the node, and they are three at
    least, have it there. Equal pages of a host count once, so that copies do not turn content into
    template. Pages are parsed where they lie; trees, sizes and hashes of texts travel. A host's nodes
    are judged from one row a node.
    """

    def read(batches):
        for batch in batches:
            hosts, digests, trees, found = [], [], [], {k: [] for k in ("nodes", "texts", "chars", "linked")}
            for host, page in zip(batch.column("__vf_host").to_pylist(), batch.column("html").to_pylist()):
                if page:
                    tree, own = blocks(parse(page))
                    hosts.append(host), trees.append(json.dumps(tree))
                    digests.append(hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    for k, values in (("nodes", [b.node for b in own]), ("texts", [_hash(b.text) for b in own]), ("chars", [len(b.text) for b in own]), ("linked", [min(b.linked, len(b.text)) for b in own])):
                        found[k].append(values)
            types = {"nodes": pa.int32(), "texts": pa.int64(), "chars": pa.int32(), "linked": pa.int32()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(trees, pa.string()), *(pa.array(found[k], pa.list_(t)) for k, t in types.items())],
                ["__vf_host", "digest", "page", *types],
            )

    read_ = pages.mapInArrow(read, "__vf_host string, digest binary, page string, nodes array<int>, texts array<long>, chars array<int>, linked array<int>")
    distinct = durable(read_.groupBy("__vf_host", "digest").agg(F.first(F.struct("page", "nodes", "texts", "chars", "linked")).alias("x")).select("__vf_host", "x.*"))

    def merged(table: pa.Table) -> pa.Table:
        tree = None
        for page in map(json.loads, sorted(table.column("tree").to_pylist(), key=lambda t: (-len(t), t))):
            tree = page if tree is None else merge(tree, page)
        return pa.table({"__vf_host": pa.array([table.column("__vf_host")[0].as_py()], pa.string()), "tree": pa.array([json.dumps(tree)], pa.string())})

    trees = distinct.select("__vf_host", F.col("page").alias("tree")).distinct()
    while True:
        parts_ = trees.groupBy("__vf_host").agg(F.ceil(F.count("*") / MERGED).alias("parts"))
        dealt = trees.join(parts_, "__vf_host").withColumn("part", F.pmod(F.xxhash64("tree"), F.col("parts")))
        trees = durable(dealt.groupBy("__vf_host", "part").applyInArrow(merged, "__vf_host string, tree string"))
        if trees.groupBy("__vf_host").count().where("count > 1").isEmpty():
            break

    def place(batches):
        aligned = Aligner()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree", "page", "nodes", "texts", "chars", "linked")]
            rows = []
            for host, tree, page, *found in zip(batch.column("__vf_host").to_pylist(), *columns):
                at = aligned(tree, page)
                sums: dict[int, list[int]] = {n: [0, 0] for n in at if n >= 0}
                texts: dict[tuple[int, int], list[int]] = {}
                for n, text, chars, linked in zip(*found):
                    if at[n] >= 0:
                        for each in (sums[at[n]], texts.setdefault((at[n], text), [0, 0])):
                            each[0] += chars
                            each[1] += linked
                rows += [(host, n, None, *x) for n, x in sums.items()]
                rows += [(host, n, text, *x) for (n, text), x in texts.items()]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["__vf_host", "node", "text", "chars", "linked"])

    size = trees.agg(F.sum(F.length("tree") + F.length("__vf_host") + 64))
    placed = _hosted(distinct, trees, size).mapInArrow(place, "__vf_host string, node int, text long, chars long, linked long")
    sums = placed.groupBy("__vf_host", "node", "text").agg(F.count("*").alias("k"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    counts = durable(sums.where("text is null or k >= 3"))
    n = counts.where("text is null").select("__vf_host", "node", F.col("k").alias("n"))
    constant = counts.where("text is not null").join(n, ["__vf_host", "node"]).where("10 * k >= 9 * n").select("__vf_host", "node", "text", "chars", "linked")
    nodes = counts.where("text is null").select("__vf_host", "node", F.lit(None).cast("long").alias("text"), "chars", "linked").unionByName(constant)

    def judged(key, found: pa.Table, trees: pa.Table) -> pa.Table:
        if not len(trees):
            return pa.table({"__vf_host": pa.array([], pa.string()), "rules": pa.array([], pa.string())})
        tree = trees.column("tree")[0].as_py()
        stats: dict[int, list[int]] = {}
        drop = []
        for node, text, chars, linked in zip(*(found.column(c).to_pylist() for c in ("node", "text", "chars", "linked"))):
            own, sign = stats.setdefault(node, [0, 0]), 1 if text is None else -1
            own[0] += sign * chars
            own[1] += sign * linked
            if text is not None:
                drop.append([node, text])
        first, other = decide(json.loads(tree), {k: tuple(v) for k, v in stats.items()})
        rules = json.dumps({"tree": tree, "first": first, "other": other, "drop": sorted(drop)})
        return pa.table({"__vf_host": pa.array([key[0].as_py()], pa.string()), "rules": pa.array([rules], pa.string())})

    return durable(nodes.groupBy("__vf_host").cogroup(trees.groupBy("__vf_host")).applyInArrow(judged, "__vf_host string, rules string"))


# --- extraction


class Rules:
    """A host's wrapper as `induce` gives it, read once a worker."""

    def __init__(self, text: str):
        given = json.loads(text)
        self.tree, self.first, self.other = given["tree"], frozenset(given["first"]), frozenset(given["other"])
        self.drop: dict[int, set[int]] = {}  # hashes of template texts by node
        for node, text in given["drop"]:
            self.drop.setdefault(node, set()).add(text)


def extract(page: str | None, rules: Rules | None, aligned: Aligner) -> str:
    """The main text of a page: its blocks in the wrapper's content nodes; "" if there are none.

    Those of articles come first; a page without text in these has the others. A page all of whose
    content is template (its host has little else) keeps it. Without a wrapper all text is content.
    """
    own, found = blocks(parse(page))
    if rules is None:
        return " ".join(b.text for b in found)
    at = aligned(rules.tree, json.dumps(own))
    for i, n in enumerate(at):  # what the alignment left out belongs to the element around it, unless it tells otherwise
        if n < 0 and own[i][0] >= 0 and "!" not in own[i][1]:
            at[i] = at[own[i][0]]
    for nodes in (rules.first, rules.other):
        mine = [b for b in found if at[b.node] in nodes]
        if varying := [b for b in mine if at[b.node] not in rules.drop or _hash(b.text) not in rules.drop[at[b.node]]]:
            return " ".join(b.text for b in varying)
        if mine and nodes is rules.first:
            break
    return " ".join(b.text for b in mine)


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """Add `text`, the main text of each whole page ("" if none).

    Wrappers and templates come from all pages of a host (see induce). They are broadcast if their
    measured size allows, else joined by host, where a hot host is split as a skewed join key; pages are
    never gathered by host. Null or empty html gives "". A null url, or one without `://`, belongs to
    the host "". Repeated rows repeat; an empty table stays empty. A column named like the output is
    replaced, all others are kept.
    """
    keep = [c for c in pages.columns if c != text]
    keyed = pages.select(*keep).withColumn("__vf_host", parts(F.col(url))[0])
    wrappers = induce(keyed.select("__vf_host", F.col(html).alias("html"))).withColumnsRenamed({"rules": "__vf_rules"})
    size = wrappers.agg(F.sum(F.length("__vf_rules") + F.length("__vf_host") + 64))
    joined = _hosted(keyed, wrappers, size).select(*keep, "__vf_rules")
    schema = T.StructType([*(joined.schema[c] for c in keep), T.StructField(text, T.StringType())])

    def run(batches):
        held: dict[str | None, Rules | None] = {}
        aligned = Aligner()
        for batch in batches:
            out = []
            for page, rules in zip(*(batch.column(c).to_pylist() for c in (html, "__vf_rules"))):
                if rules not in held:
                    if len(held) > 500:
                        held.clear()
                    held[rules] = Rules(rules) if rules else None
                out.append(extract(page, held[rules], aligned))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], [*keep, text])

    return joined.mapInArrow(run, schema)
