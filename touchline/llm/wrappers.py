"""Operator 4: main text of web pages by wrapper induction.

Pages of one host come from one template. All of them are parsed to element trees
whose equal siblings are folded, so that an element is named by the labels from
the top to it, and the trees of a host are laid over each other by these names.
An element that holds the same text on all its pages is template; where the text
varies it is a slot, and weighs as much as its different texts have characters.
The wrapper of a host is the path to the deepest element that holds nearly all
varying text outside links and page furniture. Every page of the host is then
aligned with that wrapper: its text are the blocks below the element and those
beside the path to it, in page order, without menus, headers, footers, side
bars, notices, adverts, forms, scripts, styles and comments. The path never goes
below an article or main element; beside it, a list of links alone is a menu.

Which elements beside the path, and which labelled ones below it, are template is
counted over all pages of the host that fit, pages of equal text as one: a text is
template at its path if every page with that path holds it there, that is on
``LEAST_PAGES`` pages and half of them at least. An element is dropped only where
its own text is that text. Below the path, elements without a class or id are
never dropped for being constant, so a passage that many pages quote stays.

Some furniture varies from page to page (reader comments, adverts, related
links), which no alignment can tell, so elements that HTML or a role name as such
are left out as well, and so are those with a class or id that can mean nothing
else (``_SURE``), or elements that hold others and are named just so (share).
Names that are longer or stand on a paragraph (related-work, ``p.comment``) count
only where the structure bears them out: most of the text is links, there are
form controls, or the element is one of several alike. Else they decide nothing
within the content, as little as names that may belong to a part of the article
(``_WEAK``: a header or a notice); there the alignment decides.

A host with one page, or a page that does not fit its wrapper, falls back on the
page's own structure: all its article and main elements, else the whole page.
Texts and elements are counted per batch before the shuffle, no task holds what is
known of a host, and the table of wrappers is broadcast only up to
``SMALL_CHARS`` characters, so a host with a third of all pages is spread like
any other. Parsing, folding and weighing use no recursion and take time in
proportion to a page (times a logarithm), however deep or wide it is: an element
names at most ``LEVELS`` of those around it, and weights climb by as many levels
a round, one round for all but very deep pages.

Defined results: a null html is empty and gives an empty text; a null url counts
as the empty host; null page ids stay null; repeated rows give repeated results;
an empty table gives an empty result; texts of any length are read whole; names
of elements count in any case; an element that nothing closes loses no text (an
unclosed script, style or comment lasts to the end of the page); other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache, reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.arrow import columns, map_batches
from touchline.llm.staging import Stage
from touchline.llm.url_rules import host_of

SAMPLE_PAGES = 8  # a handful, for tests only: the operator reads all pages
LEVELS = 128
ROWS = 10_000  # counts in a batch that is handed on
LEAST_PAGES = 3  # different pages that show a text to be template
SMALL_CHARS = 16 << 20
MOST = 0.9  # share of the varying text that the content element holds; what stands beside it stays as well

# a tag: attributes end at ">" outside the quotes of a value; possessive, so that no quote makes the search start over
_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>")
_LAST = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext object q s samp small span strike strong sub sup td th time tt u var wbr br img input".split())
# elements whose content is no markup; an unclosed script or style lasts to the end of the page, of another one only the tag goes
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "iframe", "textarea", "title", "noembed", "noframes", "xmp")}
_TO_THE_END = ("script", "style")
_DROPPED = set("nav footer aside form button menu dialog input option fieldset select svg template".split())
_EMBEDDED = set("select svg template button option fieldset dialog form".split())  # never left open on purpose
_ROLES = set("banner navigation complementary contentinfo search dialog alertdialog form menu menubar toolbar".split())
# words that are names of page furniture; as a part of a name or on a paragraph only where the structure agrees
_FURNITURE = set(
    "promo promotion nav navigation menu footer aside widget popup modal signup login search form comment reply respond share sharing social related recommended toolbar".split()
)
# words that name nothing else: a whole name anywhere, a part of one on elements that hold others
_SURE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored navbar breadcrumb breadcrumbs sidebar cookie cookies consent gdpr subscribe newsletter comments replies disqus pagination pager".split()
)
_TEXT_LEVEL = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre caption figcaption figure".split())  # hold text rather than elements
_CONTROLS = set("form input button select textarea".split())
# words that name furniture beside the content, but may name a part of it: within the content of aligned pages only a constant text decides
_WEAK = set("header masthead banner side rail notice notices alert overlay discussion".split())
_HEADING = {"header", "masthead"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = set("ul ol dl table tbody thead tfoot div section article main body".split())
_MAIN = ("article", "main")
NEVER, WEAK, ALWAYS = 0, 1, 2  # how surely an element is furniture
IN_DOUBT, IN_DOUBT_INSIDE = 1, 2  # named so by a word of two meanings, elsewhere or in an article


class Node:
    """An element; ``sum`` names the text below it, and is empty where there is none."""

    __slots__ = ("tag", "label", "named", "drop", "kids", "sum", "doubt")

    def __init__(self, tag: str, label: str = "", named: bool = False, drop: int = NEVER, doubt: int = NEVER) -> None:
        self.tag, self.label, self.named, self.drop, self.kids, self.sum, self.doubt = tag, label, named, drop, [], b"", doubt  # doubt: what a name is worth that the structure doesn't bear out


def _element(tag: str, attributes: str, inside: bool) -> tuple[str, str, bool, int, int]:
    """What a node is made of."""
    names = {}
    if attributes:
        for key, *values in _NAME.findall(attributes):
            names.setdefault(key.lower(), next(filter(None, values), ""))
    words = {w for v in names.values() for w in _PART.findall(v.lower())}
    label = tag + "".join(f"#{w}" if k == "id" else f".{w}" for k in ("id", "class") for w in sorted(names.get(k, "").split()))
    drop, doubt = NEVER, NEVER
    if tag in _DROPPED or (tag == "header" and not inside):
        drop = ALWAYS
    elif tag not in ("body", "html", *_MAIN):
        if names.get("role", "").strip().lower() in _ROLES:
            drop = ALWAYS
        elif words & (_SURE | _FURNITURE):
            flat = tag in _TEXT_LEVEL or tag in _INLINE
            whole = {w.lower() for k in ("id", "class") for w in names.get(k, "").split()}
            drop = ALWAYS
            if not (whole & _SURE if flat else words & _SURE or whole & _FURNITURE):
                doubt = IN_DOUBT_INSIDE if inside else IN_DOUBT
        elif words & _WEAK and not (inside and words & _WEAK <= _HEADING):
            drop = WEAK
    return tag, label, bool(names), drop, doubt


_known = lru_cache(maxsize=4096)(_element)  # a template repeats its tags


def _node(tag: str, attributes: str, inside: bool) -> Node:
    return Node(*(_known if len(attributes) <= 200 else _element)(tag, attributes, inside))


def _tokens(html: str):
    """(start, end, closing, tag, attributes) of all markup; tag is empty for what has no element."""
    ends: dict[str, int] = {}  # from here on no end tag of this name follows
    at, limit = 0, html.rfind(">") + 1
    while m := _TAG.search(html, at, limit):
        at = m.end()
        if m[0] == "<!--":
            stop = html.find("-->", m.start() + 2)
            at = len(html) if stop < 0 else stop + 3
            yield m.start(), at, False, "", ""
            continue
        tag, closing = (m[2] or m[5] or "").lower(), bool(m[1] or m[4])
        if tag in _RAW:
            if not closing:
                stop = _RAW[tag].search(html, at) if at < ends.get(tag, len(html) + 1) else None
                if stop:
                    if tag == "xmp":
                        yield m.start(), stop.end(), False, tag, html[at : stop.start()]
                        at = stop.end()
                        continue
                    at = stop.end()
                else:
                    ends.setdefault(tag, at)
                    at = len(html) if tag in _TO_THE_END else at
            tag = ""
        yield m.start(), at, closing, tag, m[3] or m[6] or ""
    rest = html.find("<!--", at)
    last = _LAST.search(html, max(at, html.rfind("<")))
    if rest >= 0 or last:  # what the end of the page cuts off
        yield rest if rest >= 0 else last.start(), len(html), False, "", ""


def parse(html: str) -> Node:
    """The element tree; scripts, styles and comments are left out, text is decoded.

    An embedded element (such as select or svg) that nothing but the end of the page closes holds only itself: its content stays.
    So does that of any furniture left open that holds an article or main element, and that of a form around one."""
    root = Node("")
    stack, at, count, holding = [root], 0, Counter(), set()
    size, linked, controls = [0], [0], [False]  # of each open element: characters of text, those of links, and whether it has form controls

    def settle(n: Node, chars: int, in_links: int, control: bool) -> None:
        """Whether the structure bears out names in doubt: of an element itself, or of children that are alike."""
        if n.doubt and chars and not control and 2 * in_links < chars:
            n.drop = NEVER if n.doubt == IN_DOUBT_INSIDE else WEAK
        named = [k for k in n.kids if isinstance(k, Node) and k.doubt]
        if len(named) > 1:
            alike = Counter(k.label for k in named if k.tag not in _TEXT_LEVEL)
            for k in named:
                if alike[k.label] > 1:
                    k.drop = ALWAYS

    def close(depth: int, whole: bool) -> None:
        for k in range(len(stack) - 1, depth - 1, -1):
            n = stack[k]
            count[n.tag] -= 1
            chars, in_links, control = size.pop(), linked.pop(), controls.pop()
            settle(n, chars, in_links, control)
            if n.drop != ALWAYS or n.doubt:
                size[-1] += chars
                linked[-1] += chars if n.tag == "a" else in_links
            controls[-1] |= control
            holds = id(n) in holding
            if n.drop and ((whole and n.tag in _EMBEDDED) or (holds and (whole or n.tag == "form"))):
                n.drop = NEVER
            if holds or n.tag in _MAIN:
                holding.add(id(stack[k - 1]))
        del stack[depth:]

    for start, end, closing, tag, attributes in _tokens(html):
        if start > at:
            stack[-1].kids.append(text := entities.unescape(html[at:start]))
            size[-1] += len(text.strip())
        at = end
        if tag == "xmp":  # shows its content as it stands
            stack[-1].kids.append(node := Node("xmp"))
            node.kids.append(attributes)
            size[-1] += len(attributes.strip())
            continue
        if not tag or tag in ("html", "head"):
            continue
        if closing:  # an end tag closes up to its element, if that is open
            if count[tag]:
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)
                if tag == "body":
                    close(depth + 1, True)
                close(depth, False)
            continue
        if tag == "br":
            stack[-1].kids.append(" ")
            continue
        shut = _CLOSES.get(tag) or (None if tag in _INLINE else {"p"})
        if shut and any(count[t] for t in shut):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    close(k, False)
                    break
                if stack[k].tag in _HOLDERS:
                    break
        node = _node(tag, attributes, count["article"] + count["main"] > 0)
        stack[-1].kids.append(node)
        if tag in _CONTROLS:
            controls[-1] = True
        if tag not in _VOID and not attributes.endswith("/"):
            stack.append(node)
            size.append(0)
            linked.append(0)
            controls.append(False)
            count[tag] += 1
    if at < len(html):
        stack[-1].kids.append(entities.unescape(html[at:]))
    close(1, True)
    return root


def _digest(*parts: bytes) -> bytes:
    return blake2b(b"\0".join(parts), digest_size=8).digest()


@lru_cache(maxsize=1 << 15)
def _below(above: bytes, label: str) -> bytes:
    """The name of an element of that label below another."""
    return _digest(above, label.encode("utf-8", "surrogatepass"))


def name_texts(root: Node) -> Node:
    """Sets ``sum`` of all elements, from the leaves up; furniture takes no part."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in n.kids if isinstance(k, Node) and k.drop != ALWAYS]
    for n in reversed(order):
        sums = [_digest(" ".join(k.split()).encode("utf-8", "surrogatepass")) if isinstance(k, str) else k.sum for k in n.kids if not isinstance(k, str) or not (not k or k.isspace())]
        sums = [x for x in sums if x]
        n.sum = sums[0] if len(sums) == 1 else _digest(*sums) if sums else b""
    return root


def blocks(node: Node, skip: set[tuple[int, int]] | frozenset = frozenset(), content: frozenset | set = frozenset(), aligned: bool = False) -> list[str]:
    """Texts of the blocks below a node in page order, without furniture and the children in ``skip`` (id of the parent, place).

    What is only weakly named furniture stays inside the ``content`` (ids of nodes) and, on ``aligned`` pages, inside articles."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(text)
            held.clear()

    def kids(n: Node, inside: bool) -> list:
        own = enumerate(n.kids) if skip else ((0, k) for k in n.kids)
        return [(k, inside) for i, k in own if (id(n), i) not in skip][::-1]

    within = lambda n: id(n) in content or (aligned and n.tag in _MAIN)
    todo: list = kids(node, within(node))
    while todo:
        kid, inside = todo.pop()
        if isinstance(kid, str):
            held.append(kid)
            continue
        if kid is None:
            flush()
            continue
        inside = inside or within(kid)
        if kid.drop == ALWAYS or (kid.drop == WEAK and not inside):
            continue
        if kid.tag not in _INLINE:
            flush()
            todo.append((None, inside))
        elif kid.tag in ("td", "th"):
            held.append(" ")
        todo += kids(kid, inside)
    flush()
    return out


class Shape:
    """A tree whose equal siblings are folded into one node, so that a label occurs once among them; ``texts`` stand directly in them."""

    __slots__ = ("label", "kids", "texts", "link")

    def __init__(self, label: str, link: bool) -> None:
        self.label, self.kids, self.texts, self.link = label, {}, [], link

    @property
    def text(self) -> str:
        return " ".join(" ".join(self.texts).split())


def fold(root: Node) -> Shape:
    """The folded tree without page furniture; inline elements without a name count as text."""
    top = Shape(root.label, False)
    todo: list = [(root, top, False, False)]
    while todo:
        n, shape, linked, inside = todo.pop()
        if isinstance(n, str):
            if not linked:
                shape.texts.append(n)
            continue
        if n is not root and not (n.tag in _INLINE and not n.named):
            shape = shape.kids.setdefault(n.label, Shape(n.label, linked))
        for kid in reversed(n.kids):
            if isinstance(kid, str):
                todo.append((kid, shape, linked, inside))
            elif kid.drop == NEVER or (kid.drop == WEAK and inside):
                todo.append((kid, shape, linked or kid.tag == "a", inside or kid.tag in _MAIN))
    return top


def heaviest(places: list[int], weights: list[int]) -> list[int]:
    """The items of the increasing subsequence of ``places`` with the largest sum of ``weights``; trees are laid over each other without it."""
    ends: list[tuple[int, int]] = []  # (place, sum), both growing
    last: list[int] = []
    before = [-1] * len(places)
    for i, (p, w) in enumerate(zip(places, weights)):
        k = bisect_left(ends, (p, -1))
        before[i] = last[k - 1] if k else -1
        total = w + (ends[k - 1][1] if k else 0)
        stop = k
        while stop < len(ends) and ends[stop][1] <= total:
            stop += 1
        if stop > k or k == len(ends) or ends[k][0] > p:
            ends[k:stop], last[k:stop] = [(p, total)], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True) or 1


# what a page tells of an element: its name, key and characters of its text; of the element of a path that it is or stands in: the names
# from its block of ``LEVELS`` levels down to it, the name above that block, label and level
WEIGHED = ("node", "t", "chars", "up", "above", "label", "level")
NO_PATH = ("p", "h1", "h2", "h3", "li", "ul", "ol", "blockquote")


def weigh(root: Node) -> list[tuple]:
    """``WEIGHED`` of all folded elements of a page. Paths go neither into ``NO_PATH`` nor below an article or main element."""
    out: list[tuple] = []
    todo: list = [(fold(root), b"", ((1,), 0, "", 0), False)]
    while todo:
        shape, name, place, closed = todo.pop()
        text = "" if shape.link else shape.text
        out.append((_number(name) if name else 1, _number(_digest(text.encode("utf-8", "surrogatepass"))) if text else 0, len(text), *place))
        up, above, _, level = place
        for label, kid in shape.kids.items():
            below, tag = _below(name, label), label.split(".")[0].split("#")[0]
            if closed or tag in NO_PATH:
                todo.append((kid, below, place, True))
            else:
                new = (level + 1) % LEVELS == 0
                todo.append((kid, below, ((*(() if new else up), _number(below)), up[-1] if new else above, label, level + 1), tag in _MAIN))
    return out


def content_path(roots: list[Node]) -> list[str]:
    """The path of labels to the content element of some pages; ``host_paths`` finds the same for many."""
    texts: dict[int, dict[int, int]] = defaultdict(dict)
    seen: Counter = Counter()
    places: dict[int, tuple] = {}
    for node, t, chars, *place in (row for r in roots for row in weigh(r)):
        texts[node][t] = chars
        seen[node] += 1
        places[node] = place
    mass: Counter = Counter()
    for node, found in texts.items():
        mass[places[node][0][-1]] += 0 if len(found) == 1 < seen[node] else sum(found.values())
    elements = sorted((n for n, p in places.items() if p[0][-1] == n), key=lambda n: -places[n][3])
    for n in elements:
        if n != 1:
            up, above, *_ = places[n]
            mass[up[-2] if len(up) > 1 else above] += mass[n]
    heavy = [n for n in elements if mass[1] and mass[n] >= MOST * mass[1]]
    return [places[n][2] for n in reversed(heavy) if n != 1]


def induce(pages: list[str]) -> dict:
    """The wrapper of some pages: ``path`` of labels to the content element and keys of the ``constant`` texts below it."""
    roots = [parse(p) for p in pages]
    path = content_path(roots)
    n: Counter = Counter()
    for _, keys in {m[0]: m for m in (marks(r, path) for r in roots) if m}.values():
        n.update(keys)
    constant = sorted(t for (p, t), k in n.items() if t and k >= LEAST_PAGES and k == n[p, 0] and 2 * k >= n[0, 0])
    return {"path": path, "constant": constant} if path else {}


def _key(*parts: bytes) -> int:
    return _number(_digest(*parts))


def _menu(node: Node) -> bool:
    """Several links and no text or heading beside them."""
    links, todo = 0, [node]
    while todo:
        for kid in todo.pop().kids:
            if isinstance(kid, str):
                if kid.strip():
                    return False
            elif kid.tag == "a":
                links += 1
            elif kid.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                return False
            elif not kid.drop:
                todo.append(kid)
    return links > 1


def parts(root: Node, path: list[str]) -> tuple[list[Node], set[tuple[int, int]], list[tuple[list[tuple[int, int]], int, int]]]:
    """The content elements, places (as in ``skip``) of the menus beside the path, and what may be template: places and keys of the path and of path and text
    of everything with text beside the path (text and inline elements in a row are one) and of each labelled element below it."""
    name_texts(root)
    nodes, above, menus, out = [root], b"", set(), []
    for label in path:
        inner, below = [], _below(above, label)
        for n in nodes:
            row: list[int] = []
            for i, kid in enumerate([*n.kids, None]):
                if isinstance(kid, str) or (kid and kid.tag in _INLINE and kid.label != label):
                    row.append(i)
                    continue
                if row:
                    line = Node("")
                    line.kids = [n.kids[j] for j in row]
                    if text := "\n".join(blocks(line)):
                        out.append(([(id(n), j) for j in row], _key(above), _key(above, text.encode("utf-8", "surrogatepass"))))
                    row = []
                if kid is None or kid.drop:
                    continue
                if kid.label == label:
                    inner.append(kid)
                elif _menu(kid):
                    menus.add((id(n), i))
                elif kid.sum:
                    here = _below(above, kid.label)
                    out.append(([(id(n), i)], _key(here), _key(here, kid.sum)))
        nodes, above = inner, below
    todo = [(n, above) for n in nodes]
    while todo:
        node, above = todo.pop()
        for i, kid in enumerate(node.kids):
            if isinstance(kid, Node) and kid.drop != ALWAYS:
                here = _below(above, kid.label)
                todo.append((kid, here))
                if kid.named and kid.sum:
                    out.append(([(id(node), i)], _key(here), _key(here, kid.sum)))
    return nodes, menus, out


def marks(root: Node, path: list[str]) -> tuple[int, set[tuple[int, int]]] | None:
    """Key of a page's text and the keys to count for it: 0, 0 for the page, each path with 0 and each path with its texts; None where the page does not fit."""
    if not path:
        return None
    nodes, _, found = parts(root, path)
    sums = [n.sum for n in nodes if n.sum]
    if not sums:
        return None
    keys = {(0, 0)}
    for _, p, t in found:
        keys |= {(p, 0), (p, t)}
    return _key(*sums), keys


def _named(node: Node, tags: tuple[str, ...]) -> list[Node]:
    """The topmost elements of some tags in page order."""
    todo, out = [node], []
    while todo:
        n = todo.pop()
        if n.tag in tags:
            out.append(n)
        else:
            todo += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.drop]
    return out


@lru_cache(maxsize=512)
def _wrapper(data: str) -> tuple[tuple[str, ...], frozenset[int]]:
    w = json.loads(data) if data else {}
    return tuple(w.get("path", ())), frozenset(w.get("constant", ()))


def main_text(html: str | None, wrapper: str | None = None) -> str:
    if not html:
        return ""
    root = parse(html)
    path, constant = _wrapper(wrapper or "")
    if path:
        nodes, menus, found = parts(root, list(path))
        if any(n.sum for n in nodes):
            content = {id(n) for n in nodes if n.tag not in ("", "body")}
            text = "\n".join(blocks(root, menus | {at for places, _, t in found if t in constant for at in places}, content, True))
            if text:
                return text
    for nodes in (_named(root, _MAIN), [root]):
        text = "\n".join(b for n in nodes for b in blocks(n))
        if text:
            return text
    todo = [root]
    while todo:  # a page that is one form
        n = todo.pop()
        n.drop = NEVER if n.tag == "form" else n.drop
        todo += [k for k in n.kids if isinstance(k, Node)]
    return "\n".join(blocks(root))


def _weighed(pages: DataFrame) -> DataFrame:
    """``host``, ``WEIGHED`` and the number of pages ``n``: every element of a host with each of its texts."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int32(), pa.int64())
    names = ["host", *WEIGHED, "n"]

    def handed_on(seen: Counter) -> pa.RecordBatch:
        rows = [(host, *row, n) for (host, row), n in seen.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(types), types)], names)

    def step(batches):
        for batch in batches:
            seen: Counter = Counter()
            for host, html in zip(*columns(batch, "host", "html")):
                if html:
                    seen.update((host, row) for row in weigh(parse(html)))
                if len(seen) >= ROWS:
                    yield handed_on(seen)
                    seen.clear()
            yield handed_on(seen)

    rows = pages.select(host_of(F.coalesce("url", F.lit(""))).alias("host"), "html")
    every = map_batches(rows, step, "host string, node long, t long, chars long, up array<long>, above long, label string, level int, n long")
    return every.groupBy("host", *WEIGHED).agg(F.sum("n").alias("n"))


def host_paths(pages: DataFrame, stage: Stage) -> DataFrame:
    """``host, path`` to the content element, from all pages of each host; hosts without varying text are left out.

    An element's weight goes to all around it in its block of levels; those of a deeper block first climb to the element above it.
    Nearly all of a host's weight is in one child at most, so the heavy elements are a chain from the top."""
    place = ["up", "above", "label", "level"]
    weight = F.when((F.count("*") == 1) & (F.sum("n") > 1), 0).otherwise(F.sum("chars"))
    nodes = stage.write(_weighed(pages).groupBy("host", "node", *place).agg(weight.alias("weight")))
    elements = nodes.filter("node = element_at(up, -1)").select("host", "node", *place)
    block = F.floor(F.col("level") / LEVELS)
    weighty = nodes.filter("weight > 0").select("host", *place, "weight")
    steps: list[DataFrame] = []
    for b in range(nodes.agg(F.coalesce(F.max(block), F.lit(0))).first()[0], 0, -1):
        own = reduce(DataFrame.union, [weighty.filter(block == b), *steps[-1:]])
        steps.append(stage.write(own.groupBy("host", F.col("above").alias("node")).agg(F.sum("weight").alias("weight")).join(elements, ["host", "node"]).select("host", *place, "weight")))
    mass = reduce(DataFrame.union, [weighty, *steps]).select("host", F.explode("up").alias("node"), "weight").groupBy("host", "node").agg(F.sum("weight").alias("mass"))
    mass = stage.write(mass)
    heavy = mass.join(mass.filter("node = 1").select("host", F.col("mass").alias("total")), "host").filter(F.col("mass") >= MOST * F.col("total"))
    chain = heavy.join(elements, ["host", "node"]).filter("level > 0").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("level", "label"))).alias("chain"))
    paths = stage.write(chain.select("host", F.col("chain.label").alias("path")))
    stage.free(nodes, mass, *steps)
    return paths


def _with_host(pages: DataFrame, hosts: DataFrame, size: str) -> DataFrame:
    """``pages`` with what is known of their hosts; ``size`` counts the characters of its rows."""
    chars = hosts.agg(F.coalesce(F.sum(F.expr(size) + F.length("host")), F.lit(0))).first()[0]
    rows = pages.select("page_id", "url", "html", host_of(F.coalesce("url", F.lit(""))).alias("host"))
    return rows.join(F.broadcast(hosts) if chars <= SMALL_CHARS else hosts.hint("merge"), "host", "left")


def host_wrappers(pages: DataFrame, stage: Stage) -> DataFrame:
    """``host, wrapper`` (JSON): the path and the keys of the texts that are template on all pages of the host."""
    paths = host_paths(pages, stage)

    def step(batches):
        for batch in batches:
            out = []
            for host, html, path in zip(*columns(batch, "host", "html", "path")):
                found = marks(parse(html), path) if html and path else None
                if found:
                    out += [(host, p, t, found[0]) for p, t in found[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "p", "t", "page"])

    seen = map_batches(_with_host(pages, paths, "length(array_join(path, ' '))").select("host", "html", "path"), step, "host string, p long, t long, page long")
    n = stage.write(seen.distinct().groupBy("host", "p", "t").count().filter(F.col("count") >= LEAST_PAGES))
    of_path = n.filter("p <> 0 and t = 0").select("host", "p", "count")
    of_host = n.filter("p = 0 and t = 0").select("host", F.col("count").alias("all"))
    fixed = n.filter("t <> 0").join(of_path, ["host", "p", "count"]).join(of_host, "host").filter("2 * count >= all")
    constant = fixed.groupBy("host").agg(F.array_sort(F.collect_set("t")).alias("constant"))
    wrappers = stage.write(paths.join(constant, "host", "left").select("host", F.to_json(F.struct("path", "constant")).alias("wrapper")))
    stage.free(paths, n)
    return wrappers


def extract(pages: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    stage = stage or Stage(pages.sparkSession)
    wrappers = host_wrappers(pages, stage)
    joined = _with_host(pages, wrappers, "length(wrapper)").select("page_id", "url", "html", "wrapper")

    def step(batches):
        for batch in batches:
            texts = [main_text(h, w) for h, w in zip(*columns(batch, "html", "wrapper"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(joined, step, "page_id long, url string, text string, n_chars long")
