"""Main text of web pages with wrappers inferred per host.

The pages of a host come from a few templates. Each page becomes a tree of its tags; equal neighbours fold
into one repeated node. Aligning two trees keeps what both have, makes what one lacks optional, and turns
texts that differ into slots: a union-free regular expression of tags, (..)+, (..)? and slots. Pages of one
shape align in any order, and shapes in the order of their digests, so every page takes part, no task holds
more than some wrappers of one host, and the outcome is that of any other dealing of the pages. A wrapper
tells where the host's article is; what is extracted are the blocks of text there, without the texts that
the template has and the parts that tags, roles and names mark as something else.
"""

import html as html_lib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sphaera.llm.common import staged, with_arrow_columns
from sphaera.llm.urlfilter import host_of

RAW = "script|style|noscript|template|textarea|iframe|svg|annotation-xml|annotation|object|canvas|audio|video|select|xmp"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var "
    # Formulas: their texts are words of the line that they stand in.
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
#: Elements that are never part of an article.
SKIP_TAGS = frozenset("head title nav footer aside form button dialog menu fieldset".split())
#: Those of them that some frameworks put around a whole page.
FORMS = frozenset(("form", "fieldset"))
#: Words in class, id or role that name such parts.
SKIP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social share "
    "sharing related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination "
    "pager footer masthead comment comments commentlist discussion disqus respond reply replies widget toolbar "
    "contentinfo complementary search dialog paywall".split()
)
#: Words that make a compound say how a container is laid out.
LAYOUT_NAMES = frozenset("no not has have with without is show hide hidden wrap wrapper container layout content main".split())
ARTICLE_NAMES = frozenset("main article articlebody".split())
#: A text is part of the template if at least so many pages of its host all have it at its place.
TEMPLATE_PAGES = 3
#: A node with more children, neighbours of one signature counted once, or deeper than this, is not aligned further.
MAX_KIDS, MAX_DEPTH = 200, 100
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    """An element, or a text where ``tag`` is "#"."""

    __slots__ = ("tag", "names", "skip", "named", "form", "article", "children", "text", "parent", "seen")

    def __init__(self, tag: str, names: str = "", skip: bool = False, article: bool = False, text: str = ""):
        self.tag, self.names, self.skip, self.article, self.text = tag, names, skip, article, text
        #: Skipped by a class, id or role alone.
        self.named = False
        #: Skipped as a form alone.
        self.form = False
        self.children: list[Node] = []
        self.parent: Node | None = None
        self.seen = False

    @property
    def sig(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag

    def add(self, child: "Node") -> None:
        child.parent = self
        self.children.append(child)


def walk(root: Node, into) -> Iterator[tuple[bool, Node]]:
    """The nodes below root in page order, (True, node) where one opens and, if into(node) let the walk descend,
    (False, node) where it closes. Pages may be deep, so there is no recursion."""
    stack = [(root, iter(root.children))]
    while stack:
        node, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if stack:
                yield False, node
            continue
        yield True, child
        if into(child):
            stack.append((child, iter(child.children)))


def parse(page: str | None) -> Node:
    """The tree of a page; end tags that match nothing are ignored and missing ones supplied. The time is
    that of the page's length, however deep or wide it is."""
    root = Node("root")
    #: Each open element with the place of the nearest one, itself included, that is not inline.
    stack = [(root, 0)]
    places: dict[str, list[int]] = {}
    articles = 0

    def close(i: int) -> None:
        nonlocal articles
        for node, _ in stack[i:]:
            places[node.tag].pop()
            articles -= node.article
        del stack[i:]

    for m in _TOKEN.finditer(page or ""):
        text = m["text"]
        if text is not None:
            stack[-1][0].add(Node("#", text=text))
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        block = stack[-1][1]
        if m["end"]:
            # The end of an inline element does not reach beyond the block that it stands in.
            at = places.get(tag)
            if at and (tag not in INLINE or at[-1] > block):
                close(at[-1])
            continue
        if tag in VOID:
            stack[-1][0].add(Node("#", text=" ") if tag in ("br", "wbr") else Node(tag))
            continue
        names, skip, article, named, hidden = "", tag in SKIP_TAGS, tag in ("article", "main"), False, False
        if m["attrs"] and ("=" in m["attrs"] or "hidden" in m["attrs"]):
            for key, *values in _ATTR.findall(m["attrs"]):
                key, value = key.lower(), "".join(values).lower()
                if key in ("class", "id", "role"):
                    named = named or tag not in ("html", "body") and any(map(_skip_name, value.split()))
                    names = f"{names} {_DIGITS.sub('0', value)}".strip()
                if key in ("role", "itemprop") and value in ARTICLE_NAMES:
                    article = True
                if key == "hidden" or key == "aria-hidden" and value == "true":
                    skip = hidden = True
        if tag not in INLINE and block:
            # A block ends an open paragraph, an item the item before it.
            open_tag = stack[block][0].tag
            if open_tag == "p" or open_tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(block)
        if tag == "header" and not articles:
            skip = True
        node = Node(tag, names, skip or named, article)
        node.named, node.form = named and not skip, tag in FORMS and not hidden
        stack[-1][0].add(node)
        places.setdefault(tag, []).append(len(stack))
        articles += article
        stack.append((node, stack[-1][1] if tag in INLINE else len(stack)))
    _open_forms(root)
    _rescue(root)
    return root


def _open_forms(root: Node) -> None:
    """A form that holds a marked article, or paragraphs with at least half of the page's text, is a container."""
    inside = lambda c: not c.skip or c.named or c.form
    size = lambda node: sum(len(clean(c.text)) for opens, c in walk(node, inside) if opens and c.tag == "#")
    whole = None
    for form in [c for opens, c in walk(root, inside) if opens and c.form]:
        holds = any(opens and c.article and inside(c) for opens, c in walk(form, inside))
        if not holds:
            whole = size(root) if whole is None else whole
            said = sum(size(c) for opens, c in walk(form, lambda c: inside(c) and c.tag != "p") if opens and c.tag == "p" and inside(c))
            holds = said > 0 and 2 * said >= whole
        if holds:
            form.skip, form.form = form.named, False


def _skip_name(token: str) -> bool:
    """Whether a class, id or role names a part that is no article, alone or as the noun of a compound:
    "sidebar" and "user-comments", but not "content-sidebar-wrap", "comments-open" or "no-sidebar"."""
    words = _NAME.findall(token)
    return bool(words) and words[-1] in SKIP_NAMES and not LAYOUT_NAMES.intersection(words)


def _kept(node: Node) -> bool:
    return not node.skip


def _says(node: Node) -> bool:
    return node.tag == "#" and clean(node.text) != ""


def _rescue(root: Node) -> None:
    """A page whose only article, or only text, lies in parts skipped by name keeps those parts."""
    for test in (lambda c: c.article, _says):
        if any(opens and not c.skip and test(c) for opens, c in walk(root, _kept)):
            continue
        soft = lambda c: not c.skip or c.named
        for c in [c for opens, c in walk(root, soft) if opens and soft(c) and test(c)]:
            while c is not None and not c.seen:
                c.seen, c.skip = True, c.skip and not c.named
                c = c.parent
        for _, c in walk(root, lambda c: c.seen):
            c.seen = False
        root.seen = False


def clean(text: str) -> str:
    return _SPACE.sub(" ", html_lib.unescape(text)).strip()


# A wrapper node is a list: signature, repeated, optional, pages, constant (digest of a text, or None for a
# slot), characters of slot text below, article, children (None where they are too many or too deep to align).
SIG, REP, OPT, PAGES, CONST, CHARS, ARTICLE, KIDS = range(8)


def _chars(node: Node) -> int:
    return sum(len(clean(c.text)) for opens, c in walk(node, _kept) if opens and c.tag == "#")


def fold(node: Node, depth: int = 0) -> list:
    """One page's tree as a wrapper: blocks only, equal neighbours folded into one repeated node."""
    if depth >= MAX_DEPTH:
        return [node.sig, False, False, 1, None, _chars(node), node.article, None]
    kids: list[list] | None = []
    chars = 0
    for c in node.children:
        if c.tag == "#":
            value = clean(c.text)
            if not value:
                continue
            new = ["#", False, False, 1, xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")), len(value), False, []]
        elif c.skip or c.tag in VOID:
            continue
        elif c.tag in INLINE:
            inner = _chars(c)
            if not inner:
                continue
            new = ["#", False, False, 1, None, inner, False, []]
        else:
            new = fold(c, depth + 1)
        chars += new[CHARS]
        if kids is None:
            continue
        if kids and kids[-1][SIG] == new[SIG]:
            kids[-1] = align(kids[-1], new, same_page=True)
            kids[-1][REP] = True
        else:
            kids.append(new)
        if len(kids) > MAX_KIDS:
            kids = None
    return [node.sig, False, False, 1, None, chars, node.article, kids]


def align(a: list, b: list, same_page: bool = False) -> list:
    """The least wrapper that covers both; a and b have one signature."""
    pages = a[PAGES] if same_page else a[PAGES] + b[PAGES]
    const = a[CONST] if a[CONST] == b[CONST] else None
    kids = None if a[KIDS] is None or b[KIDS] is None else _align_all(a[KIDS], b[KIDS], same_page)
    if kids is not None and len(kids) > MAX_KIDS:
        kids = None
    return [a[SIG], a[REP] or b[REP], a[OPT] or b[OPT], pages, const, a[CHARS] + b[CHARS], a[ARTICLE] or b[ARTICLE], kids]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, early ones of a first; time and space are the product of
    the lengths, of which MAX_KIDS is the most."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _align_all(a: list[list], b: list[list], same_page: bool) -> list[list]:
    mine, theirs = [x[SIG] for x in a], [x[SIG] for x in b]
    if mine == theirs:
        return [align(x, y, same_page) for x, y in zip(a, b)]
    out: list[list] = []

    def add(node, optional):
        if optional:
            node = [*node[:OPT], True, *node[OPT + 1 :]]
        if out and out[-1][SIG] == node[SIG]:
            node = align(out[-1], node, True)
            node[REP] = True
            out[-1] = node
        else:
            out.append(node)

    # What both have stays; the rest becomes optional.
    i = j = 0
    for p, q in [*common_subsequence(mine, theirs), (len(a), len(b))]:
        for x in a[i:p] + b[j:q]:
            add(x, True)
        if p < len(a):
            add(align(a[p], b[q], same_page), False)
        i, j = p + 1, q + 1
    return out


def shape(w: list) -> str:
    """The signatures of a wrapper. Wrappers of one shape align node by node, in any order with one result."""
    kids = "-" if w[KIDS] is None else "".join(map(shape, w[KIDS]))
    return f"<{w[SIG]}{kids}>"


def merge(wrappers: list[list]) -> list:
    """The wrapper that covers all, whatever order they come in: those of one shape first, then shape by shape."""
    by_shape: dict[str, list] = {}
    for w in wrappers:
        key = shape(w)
        by_shape[key] = align(by_shape[key], w) if key in by_shape else w
    first, *rest = (by_shape[k] for k in sorted(by_shape))
    for w in rest:
        first = align(first, w)
    return first


def expression(w: list) -> str:
    """A wrapper as a regular expression over tags, for people to read."""
    if w[SIG] == "#":
        body = "#text" if w[CONST] is not None else "#slot"
    else:
        body = f"<{w[SIG]}>{'..' if w[KIDS] is None else ' '.join(map(expression, w[KIDS]))}</>"
    return f"({body}){'+' if w[REP] else ''}{'?' if w[OPT] else ''}" if w[REP] or w[OPT] else body


def _path_to(target: list, path: list[list]) -> list[list]:
    """path with the signature of a child, which of its siblings of that signature it is, and how many they are."""
    siblings, node = target
    same = [k for k in siblings if k[SIG] == node[SIG]]
    return [*path, [node[SIG], next(i for i, k in enumerate(same) if k is node), len(same)]]


def region(wrapper: list) -> list[list]:
    """The path to the lowest node that holds all text that differs between pages. Each step is a signature,
    which of the node's children of that signature it is, and how many of them there are."""
    path, node = [], wrapper
    while True:
        varied = [k for k in node[KIDS] or [] if _varied(k)]
        if len(varied) != 1 or varied[0][SIG] == "#" or varied[0][REP]:
            return path
        path, node = _path_to([node[KIDS], varied[0]], path), varied[0]


def marked_region(wrapper: list) -> list[list]:
    """The path to the one marked article of a wrapper, the inmost of nested ones; empty if there are several."""
    path: list[list] = []
    found: list[list] = []
    node = wrapper
    while True:
        holds = [k for k in node[KIDS] or [] if _has_article(k)]
        if not holds:
            return found
        if len(holds) != 1 or holds[0][REP]:
            return [] if node[SIG].split(".")[0] == "main" or not found else found
        path, node = _path_to([node[KIDS], holds[0]], path), holds[0]
        # An article inside a main element is the narrower choice; inside an article it is part of it.
        if node[ARTICLE]:
            found = path
            if node[SIG].split(".")[0] != "main":
                return found


def _has_article(w: list) -> bool:
    return w[ARTICLE] or any(map(_has_article, w[KIDS] or []))


def _varied(w: list) -> int:
    if w[SIG] == "#":
        return w[CHARS] if w[CONST] is None or w[PAGES] < TEMPLATE_PAGES else 0
    return w[CHARS] if w[KIDS] is None else sum(map(_varied, w[KIDS]))


def constants(wrapper: list) -> set[int]:
    """Digests of the texts that every page without a marked article has at their place. Within marked articles
    nothing is left out: a heading that all of them have is theirs."""
    out: set[int] = set()

    def look(w):
        if w[SIG] == "#" and w[CONST] is not None and not w[REP] and w[PAGES] >= max(TEMPLATE_PAGES, wrapper[PAGES]):
            out.add(w[CONST])
        for k in w[KIDS] or []:
            look(k)

    look(wrapper)
    return out


def _blocks(root: Node) -> list[list[str]]:
    """The texts of each block below a node."""
    out: list[list[str]] = [[]]
    for opens, c in walk(root, lambda c: c.tag != "#" and not c.skip and c.tag not in VOID):
        if c.tag == "#":
            out[-1].append(c.text)
        elif c.tag not in INLINE and (c.tag not in VOID or c.tag == "hr"):
            out.append([])
    return out


def _marked(node: Node) -> list[Node]:
    """The outermost marked articles below a node."""
    return [c for opens, c in walk(node, lambda c: not c.skip and not c.article) if opens and c.article and not c.skip]


def articles(root: Node) -> list[Node]:
    """The marked articles of a page. One inside a main element is the narrower choice."""
    return [x for n in _marked(root) for x in (n.tag == "main" and _marked(n) or [n])]


def _step(node: Node, sig: str, at: int, of: int) -> Node | None:
    """The child that a step of a path means; None if the page has another number of them, so that it is
    not known which."""
    runs: list[list[Node]] = []
    last = None
    for c in node.children:
        if c.tag == "#" and not clean(c.text) or c.tag != "#" and (c.skip or c.tag in VOID):
            continue
        if c.tag in INLINE and not _chars(c):
            continue
        mine = "#" if c.tag in INLINE else c.sig
        if mine == sig and last == sig:
            runs[-1].append(c)
        elif mine == sig:
            runs.append([c])
        last = mine
    return runs[at][0] if len(runs) == of and len(runs[at]) == 1 else None


def extract(page: str | None, rule: "Rule | None" = None) -> str:
    """The text of a page's article: one line a block, white space in a block made one space.

    The wrapper's path names the region. Where a page has no such path, its marked articles are the region, or else
    the lowest node of the path that it has. Pages without a marked article go without the texts that their wrapper
    has on all pages; of a marked article, nothing goes because other pages have it too.
    """
    root = parse(page)
    marked = articles(root)
    path, drop = (rule.marked if marked else rule.plain) if rule else ([], frozenset())
    node, whole = root, bool(path)
    for step in path:
        inner = _step(node, *step)
        if inner is None:
            whole = False
            break
        node = inner
    found = marked if marked and not whole else [node]
    lines = []
    for node in found:
        for b in _blocks(node):
            line = clean("".join(b))
            if line and not (drop and xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) in drop):
                lines.append(line)
    return "\n".join(lines)


class Rule:
    """What the wrappers of a host say, for pages with a marked article and for others: path, texts to drop."""

    def __init__(self, text: str):
        plain, marked = ([], []), ([], [])
        for is_marked, path, drop in filter(None, map(json.loads, json.loads(text))):
            if is_marked:
                marked = path, drop
            else:
                plain = path, drop
        self.plain, self.marked = ((p, frozenset(d)) for p, d in (plain, marked))

    @staticmethod
    def of(wrapper: list, is_marked: bool) -> str:
        return json.dumps([is_marked, marked_region(wrapper) if is_marked else region(wrapper), [] if is_marked else sorted(constants(wrapper))])


def _infer(batches):
    """One wrapper for each host, kind of page (marked or not) and shape in a batch."""
    for batch in batches:
        found: dict[tuple[str | None, bool, str], list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = parse(page)
            tree = fold(root)
            key = host, bool(articles(root)), shape(tree)
            found[key] = align(found[key], tree) if key in found else tree
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.bool_()),
                pa.array([xxhash.xxh64_intdigest(k[2].encode("utf-8", "surrogatepass")) >> 1 for k in found], pa.int64()), pa.array([json.dumps(w) for w in found.values()], pa.string()),
            ],
            names=["host", "marked", "shape", "wrapper"],
        )


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One wrapper of a group, of which key has host, marked and shape."""
    merged = json.dumps(merge([json.loads(w) for w in table.column("wrapper").to_pylist()]))
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "marked": [key[1].as_py()], "shape": pa.array([key[2].as_py()], pa.int64()), "wrapper": [merged]})


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", salts: int = 32) -> DataFrame:
    """(host, marked, wrapper as JSON) from all pages: one of a host's pages with a marked article and one of
    the others.

    Batches give a wrapper for each shape. Those of one shape merge first, dealt by a salt of the wrapper,
    which no order can change; then shapes of one host in groups of their own digests, then those groups.
    So a host with most of the pages keeps no task busy with all of them, and the result does not depend on
    how the pages are dealt.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    fields = "host string, marked boolean, shape long, wrapper string"
    out = rows.mapInArrow(_infer, fields)
    out = out.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "marked", "shape", "salt").applyInArrow(_merged, fields)
    out = out.withColumn("shape", F.col("shape") % salts).groupBy("host", "marked", "shape").applyInArrow(_merged, fields)
    return out.withColumn("shape", F.lit(0).cast("long")).groupBy("host", "marked", "shape").applyInArrow(_merged, fields).drop("shape")


def _rules(batches):
    for batch in batches:
        out = [Rule.of(json.loads(w), m) for m, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "rule"])


def extract_articles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text, the article of each page, empty if it has none.

    Null html is empty; pages without a host share one wrapper. Repeated rows come back as they came and
    columns named text are replaced; an empty table stays empty. Pages may be of any length, depth and width:
    a node with more than MAX_KIDS different children, or MAX_DEPTH deep, is one slot to its wrapper, and its
    text is extracted whole. Results do not depend on the order of pages: where shapes tie, or regions do, the
    digest of the shape decides, and of several regions with text that differs the node above them is taken.
    """
    rules = staged(infer_wrappers(pages, url, html).mapInArrow(_rules, "host string, rule string"), "rules")
    # Two rules a host at most.
    rules = rules.groupBy(F.col("host").alias("__host")).agg(F.to_json(F.collect_list("rule")).alias("__rule"))
    keyed = pages.withColumn("__key", host_of(F.col(url)))
    joined = keyed.join(rules, keyed["__key"] == rules["__host"], "left").drop("__key", "__host")

    def make():
        known: dict[str, Rule] = {}

        def rule(x):
            if x is not None and x not in known:
                if len(known) > 10_000:
                    known.clear()
                known[x] = Rule(x)
            return known.get(x)

        return lambda htmls, rows: [pa.array([extract(h, rule(r)) for h, r in zip(htmls, rows)], pa.string())]

    return with_arrow_columns(joined, [html, "__rule"], [("text", T.StringType())], make).drop("__rule")
