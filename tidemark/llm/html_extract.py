"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is read as a stream of tokens, elements with what their class, id and role say, and texts. A host's wrapper is a union-free regular
expression over these: for every element a sequence of its children, each of them plain, optional ``( )?`` or in a repeated group ``( )+``, and a slot for its
text. It starts as the first page and is aligned with one page after the other: what agrees stays, what only one side has becomes optional, and where the same element comes
again or in another order, all from its first place to its last becomes one repeated group (of optional members if there are several). So an element stands once
among its siblings, and a wrapper is bounded by the different paths of elements, however many pages it reads. Beyond ``MOST`` different siblings
their classes are left out, then their names.
Wrappers of parts of a host's pages are aligned in the same way, so each task folds its own pages first, and only wrappers are shuffled, in two rounds by
host and salt: no task gathers pages.

A slot keeps the texts that every page with this element has, and how much text there is. Text that is the same on all of ``TEMPLATE`` or more different pages is the
host's template, all other text is content. The article is found on the wrapper: from the root downward as long as one part holds most of the varying text, to the element whose
own children are the text; what stands before the heading there and is no paragraph, and lists that are all links, are no article. Where the wrapper
has an article or main element with varying text, that is the article. Only then pages are read: a text counts if its slot does and it is
not the template's. If nothing of a page is left that way, its template texts count, then those beside the article too.

Elements that hold menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments by their names or by class, id or role are left out
unless they hold the article or the heading, as a page's outer ``has-sidebar`` does. Pages with the same texts count once, however many copies there are.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

Defined results: null html and pages without a block give the empty text; pages with null or odd urls share the wrapper of the empty host; repeated rows each get their
row; broken markup is read as far as it goes, whole pages at any length; elements nested deeper than ``DEEPEST`` count as parts of the one at that depth.
"""

from __future__ import annotations

import functools
import hashlib
import html
import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.session import durable, fresh
from tidemark.llm.url_rules import host_of

TEMPLATE, MOST, DEEPEST, SALTS, BROADCAST_BYTES = 5, 48, 40, 64, 16 << 20
#: A part that holds so much of an element's varying text is where the article is.
MAJOR = 0.6
#: Elements that hold no article text, and those that do not part blocks.
DROPPED = frozenset("head title nav header footer aside script style noscript template iframe svg math object button select option textarea dialog menu canvas audio video".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
HINTS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|nav\w*|menu|breadcrumbs?|header|masthead|footer|notice|cookies?|consent|gdpr|alert|popup|modal|overlay|comments?|commentlist|replies|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search(?:-?(?:form|box|bar))?|form|widget|pagination|pager|toolbar|complementary|contentinfo|navigation|hidden)(?:$|[\s_-])", re.I)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table figure dl".split())
LISTS = frozenset("ul ol div section table".split())
#: An open paragraph ends where one of these begins.
BLOCKS = frozenset("address article blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|([^<]+|<)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in RAW}
SPACES = re.compile(r"\s+")


DIGITS, NAME = re.compile(r"\d+"), re.compile(r"[^.!#+]*")


class Page:
    """Elements outside of dropped ones: key, parent, children; events: (element, text), or None where a block ends."""

    __slots__ = ("events", "kids", "keys", "links", "main", "parents")

    def __init__(self):
        self.keys, self.parents, self.kids, self.main, self.links, self.events = ["root"], [-1], [[]], [False], [False], []


def read(text: str) -> Page:
    page = Page()
    keys, parents, kids, main, links, events = page.keys, page.parents, page.kids, page.main, page.links, page.events
    hints, holds, filled = [False], [False], [False]  # by element: named as left out, holds the article or a heading, has text of its own
    stack: list[tuple[str, int]] = []  # name and element, -1 within what is dropped
    now, at, n = 0, 0, len(text)
    while at < n:
        m = TOKEN.match(text, at)
        if m is None:
            break
        at = m.end()
        if m[4] is not None:
            if now >= 0:
                events.append((now, m[4]))
                if not filled[now] and m[4].strip():
                    filled[now] = True
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if name not in INLINE and events and events[-1] is not None:
            events.append(None)
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    now = stack[-1][1] if stack else 0
                    break
            continue
        if name in BLOCKS and any(x == "p" for x, _ in stack[-4:]):
            k = max(i for i, (x, _) in enumerate(stack) if x == "p")
            if all(x in INLINE or x == "p" for x, _ in stack[k:]):
                del stack[k:]
                now = stack[-1][1] if stack else 0
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            end = CLOSE[name].search(text, at)
            at = end.end() if end else n
            continue
        if now < 0 or name in DROPPED and not (name == "header" and any(main[e] for _, e in stack)):
            stack.append((name, -1))
            now = -1
            continue
        if len(stack) >= DEEPEST:
            stack.append((name, now))
            continue
        hint = " ".join(x for g in NAMED.findall(m[3]) for x in g if x) if m[3] else ""
        is_main = name in ("article", "main") or hint.lower() == "main"
        mark = name if not hint else name + "." + DIGITS.sub("0", hint.split()[0])
        kids[now].append(len(keys))
        links.append(links[now] or name == "a")
        main.append(is_main or main[now])
        hints.append(not is_main and name not in ("html", "body") and (name == "form" or (bool(hint) and bool(HINTS.search(hint)))))
        parents.append(now)
        now = len(keys)
        keys.append(mark)
        kids.append([])
        holds.append(False)
        filled.append(False)
        stack.append((name, now))
        if is_main or name == "h1":
            e = parents[now]
            while e >= 0 and not holds[e]:
                holds[e] = True
                e = parents[e]
    for e in range(1, len(keys)):  # what an element is made of tells elements of one name apart
        if keys[e] not in INLINE and keys[e] != "p":
            keys[e] += ("!" if hints[e] and not holds[e] else "") + ("#" if filled[e] else "") + ("+" + "h" * holds[e] + "p" * any(_name(keys[k]) in PARAGRAPHS for k in kids[e]) if kids[e] else "")
    return page


@functools.lru_cache(maxsize=1 << 14)
def _name(key: str) -> str:
    return NAME.match(key)[0]


@functools.lru_cache(maxsize=1 << 16)
def sequence(keys: tuple[str, ...]) -> tuple[tuple[tuple[str, ...], bool], ...]:
    """Siblings as items: (members, repeated). A key that comes again folds all between to one repeated group."""
    items: list[tuple[tuple[str, ...], bool]] = []
    for key in keys:
        at = next((i for i, x in enumerate(items) if key in x[0]), -1)
        if at < 0:
            items.append(((key,), False))
        else:
            items[at:] = [(tuple(k for x in items[at:] for k in x[0]), True)]
    return tuple(items)


def align(a: list[tuple[tuple[str, ...], bool]], b) -> list[tuple[tuple[str, ...], bool]]:
    """The least sequence of items that reads what either reads."""
    out, last = list(a), -1
    for members, repeated in b:
        hits = [i for i, x in enumerate(out) if any(k in x[0] for k in members)]
        if not hits:
            last += 1
            out.insert(last, (members, repeated))
            continue
        low, high = min([*hits, last] if hits[0] < last else hits), max([*hits, last] if hits[0] < last else hits)
        old = [k for x in out[low : high + 1] for k in x[0]]
        new = [k for k in members if k not in old]
        group = low < high or bool(new) or repeated or out[low][1]
        out[low : high + 1] = [((*old, *new), group)]
        last = low
    return out


class Node:
    """An element of a wrapper. seen: instances; held: instances of the parent that have it; common: texts that every page with it has
    (None: no page yet); pages: hashes of different pages, all of them if fewer than TEMPLATE; mass, linked: characters, and those in links."""

    __slots__ = ("common", "held", "keep", "key", "kids", "known", "linked", "mass", "order", "pages", "seen")

    def __init__(self, key: str):
        self.key, self.kids, self.order, self.known = key, {}, [], set()
        self.seen = self.held = self.mass = self.linked = 0
        self.common, self.pages, self.keep = None, frozenset(), None

    def __reduce__(self):
        return _node, (self.key, self.seen, self.held, self.mass, self.linked, self.common, self.pages, list(self.kids.values()), self.order)

    def child(self, key: str, make: bool) -> Node | None:
        found = self.kids.get(key)
        if found is None:
            for k, most in ((key, MOST), (_name(key), 2 * MOST), ("*", 2 * MOST + 1)):
                found = self.kids.get(k)
                if found is None and make and len(self.kids) < most:
                    found = self.kids[k] = Node(k)
                if found is not None:
                    break
        return found

    def pattern(self) -> str:
        """The wrapper as an expression."""
        out = []
        for members, repeated in self.order:
            one = [f"({self.kids[k].pattern()})?" if repeated and len(members) > 1 or self.kids[k].held < self.seen and not repeated else self.kids[k].pattern() for k in members]
            out.append(f"({''.join(one)})+" if repeated else one[0])
        return f"<{self.key}>{'#' if self.common is not None else ''}{''.join(out)}</{_name(self.key)}>"


def _node(key, seen, held, mass, linked, common, pages, kids, order) -> Node:
    n = Node(key)
    n.seen, n.held, n.mass, n.linked, n.common, n.pages, n.order = seen, held, mass, linked, common, pages, order
    n.kids = {k.key: k for k in kids}
    return n


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())


def _pages(a: frozenset, b: frozenset) -> frozenset:
    return a if len(a) >= TEMPLATE or b <= a else b if len(b) >= TEMPLATE else a | b


def _places(wrapper: Node, page: Page, make: bool) -> list[Node | None]:
    """The wrapper's element for each element of the page."""
    out: list[Node | None] = [wrapper]
    for e in range(1, len(page.keys)):
        up = out[page.parents[e]]
        out.append(None if up is None else up.child(page.keys[e], make))
    return out


def _own_texts(page: Page) -> dict[int, list[str]]:
    texts: dict[int, list[str]] = {}
    for event in page.events:
        if event is not None and event[1].strip():
            texts.setdefault(event[0], []).append(SPACES.sub(" ", event[1]).strip())
    return texts


def add_page(wrapper: Node, page: Page) -> None:
    """Aligns the wrapper with one page."""
    places, texts = _places(wrapper, page, True), _own_texts(page)
    one = frozenset([_hash("\0".join(x for e in sorted(texts) if not _left_out(page, e) for x in texts[e]))])
    common: dict[int, tuple[Node, set]] = {}
    for e, node in enumerate(places):
        node.seen += 1
        if page.kids[e]:
            keys = [places[k].key for k in page.kids[e]]
            for k in set(keys):
                node.kids[k].held += 1
            keys = tuple(k for i, k in enumerate(keys) if i < 2 or k != keys[i - 1] or k != keys[i - 2])  # twice says repeated
            if keys not in node.known:
                if len(node.known) > 500:
                    node.known.clear()
                node.known.add(keys)
                node.order = align(node.order, sequence(keys))
        if e in texts:
            size = sum(map(len, texts[e]))
            node.mass += size
            node.linked += size if page.links[e] else 0
            common.setdefault(id(node), (node, set()))[1].update(texts[e])
    for node, own in common.values():
        hashes = {(_hash(x), len(x)) for x in own} if node.common is None or node.common else set()
        node.common = hashes if node.common is None else node.common & hashes
        node.pages = _pages(node.pages, one)


def merge(a: Node, b: Node) -> Node:
    """The least wrapper that reads what either reads; a is changed to it."""
    a.seen, a.held, a.mass, a.linked = a.seen + b.seen, a.held + b.held, a.mass + b.mass, a.linked + b.linked
    if b.common is not None:
        a.common = b.common if a.common is None else a.common & b.common
    a.pages = _pages(a.pages, b.pages)
    names = {}
    for key, kid in sorted(b.kids.items()):
        names[key] = merge(a.child(key, True), kid).key
    a.order = align(a.order, sequence(tuple(names[k] for members, repeated in b.order for k in (members * 2 if repeated else members))))
    return a


def _left_out(page: Page, e: int) -> bool:
    while e > 0:
        if "!" in page.keys[e]:
            return True
        e = page.parents[e]
    return False


def _masses(node: Node, found: dict[int, tuple[float, float, bool]]) -> tuple[float, float, bool]:
    """For each element: characters of varying text in it, those in links, whether it has the heading."""
    mass, linked = float(node.mass), float(node.linked)
    if len(node.pages) >= TEMPLATE and node.common:
        mass = max(0.0, mass - node.seen * sum(n for _, n in node.common))
    heading = _name(node.key) == "h1"
    for kid in node.kids.values():
        m, k, h = _masses(kid, found)
        if "!" not in kid.key:
            mass, linked, heading = mass + m, linked + k, heading or h
    found[id(node)] = (mass, min(linked, mass), heading)
    return found[id(node)]


def _is_main(node: Node) -> bool:
    return _name(node.key) in ("article", "main") or ".main" in node.key


def _all(node: Node, value: bool, at: int) -> None:
    node.keep[at] = value
    for kid in node.kids.values():
        _all(kid, value and "!" not in kid.key, at)


def choose(wrapper: Node) -> Node:
    """Marks each element's slot: ``keep`` is (article on pages without an article element, on pages with one)."""
    masses: dict[int, tuple[float, float, bool]] = {}
    _masses(wrapper, masses)
    todo = [wrapper]
    for node in todo:
        node.keep = [False, False]
        todo += node.kids.values()
    # pages with an article element: the outermost ones that have varying text, else all
    tops, todo = [], [wrapper]
    for node in todo:
        if _is_main(node):
            tops.append(node)
        else:
            todo += [k for k in node.kids.values() if "!" not in k.key]
    varying = [x for x in tops if masses[id(x)][0] > 0]
    for node in varying or tops:
        _all(node, True, 1)
    # pages without: down to where the text is
    region = wrapper
    while True:
        kids = [k for k in region.kids.values() if "!" not in k.key and not _is_main(k) and masses[id(k)][0] > 0]
        if not kids or region.mass > 0 and len(region.pages) > 0 and masses[id(region)][0] > sum(masses[id(k)][0] for k in kids):
            break
        best = max(kids, key=lambda k: (masses[id(k)][0], k.key))
        repeated = any(r and best.key in members for members, r in region.order)
        plain = any(_name(k.key) in PARAGRAPHS or _name(k.key) in INLINE for k in kids)
        if plain or repeated or masses[id(best)][0] < MAJOR * sum(masses[id(k)][0] for k in kids) or (masses[id(region)][2] and not masses[id(best)][2]):
            break
        region = best
    _all(region, True, 0)
    heading = next((i for i, (members, _) in enumerate(region.order) if any(masses[id(region.kids[k])][2] and "!" not in k for k in members)), -1)
    for i, (members, _) in enumerate(region.order):
        for k in members:
            kid = region.kids[k]
            mass, linked, _h = masses[id(kid)]
            before = i < heading and _name(k) not in PARAGRAPHS and _name(k) not in INLINE
            menu = _name(k) in LISTS and mass > 0 and linked >= 0.95 * mass
            if before or menu:
                _all(kid, False, 0)
    return wrapper


def decide(wrapper: Node | None, page: Page) -> list[bool]:
    """Which texts of a page, in order, are article text."""
    texts = [event for event in page.events if event is not None]
    out = [not _left_out(page, e) for e, _ in texts] if any("!" in k for k in page.keys) else [True] * len(texts)
    if wrapper is None:
        return out
    says = [bool(x.strip()) for _, x in texts]
    with_main = int(any(page.main[e] and s and o for (e, _), s, o in zip(texts, says, out, strict=True)))
    places, kept = _places(wrapper, page, False), []
    for e in range(len(page.keys)):
        node = places[e]
        kept.append(node.keep[with_main] if node is not None else kept[page.parents[e]])
    template: dict[int, set] = {}

    def is_template(e: int, text: str) -> bool:
        node = places[e]
        if node is None or not node.common or len(node.pages) < TEMPLATE or (with_main and page.main[e]):
            return False
        if id(node) not in template:
            template[id(node)] = {h for h, _ in node.common}
        return _hash(SPACES.sub(" ", text).strip()) in template[id(node)]

    inside = [o and kept[e] for (e, _), o in zip(texts, out, strict=True)]
    varies = [s and not is_template(e, x) for (e, x), s in zip(texts, says, strict=True)]
    for answer in ([a and v for a, v in zip(inside, varies, strict=True)], [a and s for a, s in zip(inside, says, strict=True)], [a and v for a, v in zip(out, varies, strict=True)], out):
        if any(answer):
            return answer
    return out


def assemble(page: Page, keep: list[bool]) -> str:
    """Blocks of the kept texts; inline elements do not part a block, and white space between them stays."""
    blocks, now, t = [], [], 0
    for event in page.events:
        if event is None:
            blocks.append("".join(now))
            now = []
        else:
            if keep[t] or event[1].isspace():
                now.append(event[1])
            t += 1
    blocks.append("".join(now))
    clean = (SPACES.sub(" ", html.unescape(b)).strip() for b in blocks)
    return " ".join(b for b in clean if b)


def _learn(batches):
    """Wrappers of a task's own pages, host by host; hosts are put out when there are many."""
    known: dict[str, Node] = {}

    def out() -> Iterator[pa.RecordBatch]:
        rows = sorted(known.items())
        for i in range(0, len(rows), 1000):
            part = rows[i : i + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in part], pa.string()), pa.array([pickle.dumps(w) for _, w in part], pa.binary())], names=["host", "wrapper"])

    for batch in batches:
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if host not in known:
                known[host] = Node("root")
            add_page(known[host], read(text or ""))
        if len(known) > 5000:
            yield from out()
            known.clear()
    yield from out()


def _merge(table: pa.Table) -> pa.Table:
    total = None
    for w in sorted(table["wrapper"].to_pylist()):
        total = pickle.loads(w) if total is None else merge(total, pickle.loads(w))
    return pa.table({"host": pa.array([table["host"][0].as_py()], pa.string()), "wrapper": pa.array([pickle.dumps(total)], pa.binary())})


def wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of all pages."""
    kind = "host string, wrapper binary"
    rows = pages.select(F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))
    own = rows.mapInArrow(_learn, kind).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = own.groupBy("host", "salt").applyInArrow(lambda t: _merge(t.select(["host", "wrapper"])), kind)
    return some.groupBy("host").applyInArrow(_merge, kind)


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``into`` (underscores are added if that name is taken)."""
    learned = durable(wrappers(pages, url_col=url_col, html_col=html_col))
    size = learned.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    learned = F.broadcast(learned) if size <= BROADCAST_BYTES else learned
    host, wrapper = fresh("host", pages.columns), fresh("wrapper", pages.columns)
    name = fresh(into, pages.columns)
    joined = pages.withColumn(host, F.coalesce(host_of(F.col(url_col)), F.lit(""))).join(learned.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper)), host, "left").select(*pages.columns, wrapper)
    return joined.mapInArrow(_reader(html_col, wrapper, name, pages.columns), T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())]))


def _reader(html_col: str, wrapper: str, name: str, columns: list[str]):
    def run(batches):
        loaded: dict[bytes, Node] = {}
        for batch in batches:
            out = []
            for page, packed in zip(batch.column(html_col).to_pylist(), batch.column(wrapper).to_pylist(), strict=True):
                if packed is not None and packed not in loaded:
                    if len(loaded) > 1000:
                        loaded.clear()
                    loaded[packed] = choose(pickle.loads(packed))
                own = read(page or "")
                out.append(assemble(own, decide(loaded.get(packed), own)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, name])

    return run
