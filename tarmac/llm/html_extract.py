"""Main text of web pages by deducing each host's template from equivalence classes of tokens.

A page is a sequence of tokens: tags with their path, and pieces of text with theirs. Over the pages of a host, tokens
with the same occurrence vector (the same count on every page) form an equivalence class. Vectors are not gathered: two
order-free sums of page hashes stand for each, so a host of any size costs one grouped sum. A class is valid if its tokens
first stand in the same order on every page that has them. Classes nest: the elements around a class's outermost tokens
belong to one other class (or to none, at the root). The valid classes, so nested, are the host's template. Its parts are

* elements that stand once on their pages: the frame between whose tokens the slots lie;
* records, which are classes of an element and elements inside it that repeat together (comments, teasers, link lists);
* texts that stand with the frame: boilerplate.

A slot is what the template leaves. The main slot is named by a tag where there is one (``article``, ``main`` or a role that says
so); else it is the deepest frame element that holds ``MAIN_SHARE`` of the page's slot text. Records in it are left out unless
hardly anything else is there. Menus, headers, footers, sidebars, notices, adverts, forms and comments go by their tag, or by
their name and the template.
"""

from __future__ import annotations

import html as entities
import re

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import join_hot, map_rows, stash, table

MIN_TOKENS = 3
MIN_PAGES = 3
MIN_SHARE = 0.5
BROADCAST_BYTES = 32 << 20
MAIN_SHARE, LEAST_SHARE = 0.7, 0.1
#: Parts of a template.
TEXT, FRAME, RECORD, OTHER = range(4)

# HTML's elements by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre figcaption caption".split())
OUTSIDE = frozenset("head nav header footer aside form script style noscript template iframe textarea title button select option dialog menu object svg canvas label".split())
MAIN = frozenset("article main".split())
OUTSIDE_NAME = re.compile(
    r"(?i)(?:^|[-_ ])(?:ad|ads|advert\w*|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|sidebar\w*|side|breadcrumb\w*|footer|header|cookie\w*|consent|notice\w*|alert\w*|popup|modal|newsletter|subscribe|signup|login|share|social|related|recommend\w*|comment\w*|reply|replies|respond|widget\w*|toolbar|pagination|pager|skip|gdpr)(?:$|[-_ ])"
)
OUTSIDE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

# Elements that repeat in running text, so that they are no records; a list item is one if it is a link.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 tr td th dt dd blockquote pre b i em strong span br code".split())

NAMELESS = frozenset("html body h1 h2 h3 h4 h5 h6".split())  # elements that names never shut

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")


class Node:
    """An open element: its tag and path, what its tag and names say of it, and (after ``settle``) if its text can be main text."""

    __slots__ = ("tag", "path", "parent", "shut", "named", "main", "outside", "token", "frame", "record")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        names = " ".join(attributes.get(k, "") for k in ("class", "id"))
        role = attributes.get("role", "").lower()
        kind = f"{tag}.{SPACE.sub('.', names.strip())}" if names.strip() else tag
        self.tag, self.parent = tag, parent
        self.path = f"{parent.path}/{kind}" if parent else kind
        self.shut = bool(parent and parent.shut) or tag in OUTSIDE or role in OUTSIDE_ROLE or "hidden" in attributes
        self.main = bool(parent and parent.main) or ((tag in MAIN or role in MAIN or role == "article") and not (parent and parent.shut))
        if tag == "header" and parent and parent.main and not parent.shut and role not in OUTSIDE_ROLE and "hidden" not in attributes:
            self.shut = False  # an article's own header holds its headline
        self.named = bool(names and tag not in MAIN and tag not in NAMELESS and OUTSIDE_NAME.search(names))
        self.outside = False
        self.token = token_hash("open", self.path)
        self.frame: Node | None = parent.frame if parent else None  # the nearest element of the template's frame
        self.record = False


def settle(nodes: list[Node], template: dict[int, int]) -> None:
    """Which elements are main and which outside, once all of the page is known (parents come before children).

    A name shuts an element only if the host's template has the element, where the host has a template. It never shuts
    what holds the page's main element or a headline (h1), and sections in the main element only by that evidence.
    """

    def up(node: Node | None):
        while node is not None:
            yield node
            node = node.parent

    roots = [n for n in nodes if n.main and not n.shut and not (n.parent and n.parent.main)]
    clear = [n for n in roots if not any(a.named for a in up(n.parent))]  # not one of a list of teasers, say
    chosen = set(map(id, clear or roots))
    spared = {id(a) for n in roots if id(n) in chosen for a in up(n.parent)}
    spared |= {id(a) for n in nodes if n.tag == "h1" and not n.shut for a in up(n.parent)}
    for n in nodes:
        n.main = bool(n.parent and n.parent.main) or id(n) in chosen
        seen = n.named and n.token in template
        by_name = n.named and id(n) not in spared and (seen or (not template and not (n.tag == "section" and n.main)))
        n.outside = n.shut or by_name or bool(n.parent and n.parent.outside)
        part = template.get(n.token)
        n.frame = n if part == FRAME else (n.parent.frame if n.parent else None)
        n.record = part == RECORD or bool(n.parent and n.parent.record)


def events(page: str | None):
    """Tags and text of a page in order: ("open", node), ("close", node, block?), ("text", node, text), ("break", node)."""
    stack: list[Node] = []
    page = page or ""
    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            yield "text", (stack[-1] if stack else None), page[at:]
            return
        if m.start() > at:
            yield "text", (stack[-1] if stack else None), page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(n.tag == tag for n in stack):
                while True:
                    node = stack.pop()
                    yield "close", node
                    if node.tag == tag:
                        break
            elif tag in BLOCK:
                yield "break", (stack[-1] if stack else None)
            continue
        found = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3].strip("/ \n") else {}
        if re.search(r"(?:^|\s)hidden(?:\s|$|=)", m[3]):
            found["hidden"] = ""
        closes = {"p"} if tag in BLOCK and tag != "br" else set()
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            closes = {"p", tag}
        if closes and any(n.tag in closes for n in stack):
            yield from _close_until(stack, closes, tag)
        node = Node(tag, found, stack[-1] if stack else None)
        if tag in VOID:
            yield "break" if tag in BLOCK else "open", node
            continue
        if m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        yield "open", node
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            yield "close", node
        else:
            stack.append(node)
    while stack:
        yield "close", stack.pop()


def _close_until(stack: list[Node], closes: set[str], tag: str):
    """An opening block ends an open paragraph, and an item the item before it, with the inline elements inside."""
    keep = {"ul", "ol", "table", "dl", "select"} if tag in ("li", "tr", "td", "th", "dt", "dd", "option") else set()
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag in keep:
            return
        if stack[i].tag in closes:
            while len(stack) > i:
                yield "close", stack.pop()
            return
        if stack[i].tag in BLOCK and stack[i].tag not in closes and stack[i].tag not in ("tr", "tbody", "thead", "tfoot"):
            return


def clean(text: str) -> str:
    return SPACE.sub(" ", entities.unescape(text)).strip()


def token_hash(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}") >> 1


def page_tokens(page: str | None) -> dict[int, list]:
    """By token: how often it stands on the page, where first, the token of the element around it, and its kind (text, an
    element of running text, a list item, a link, another element)."""
    out: dict[int, list] = {}
    for at, event in enumerate(events(page)):
        node = event[1]
        if event[0] == "text":
            text = clean(event[2])
            if not text:
                continue
            h, around, kind = token_hash("text", node.path if node else "", text), node.token if node else 0, "text"
        elif event[0] == "open":
            h, around = node.token, node.parent.token if node.parent else 0
            kind = "running" if node.tag in RUNNING else "item" if node.tag == "li" else "link" if node.tag == "a" else "element"
        else:
            continue
        if h in out:
            out[h][0] += 1
        else:
            out[h] = [1, at, around, kind]
    return out


def host_of(url):
    """The host of a url column, lower-case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def host_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template array<struct<token long, part int>>): each host's template by its tokens (see the module).

    Pages with the same content count once. Counting tokens, pages and classes are grouped sums with partial sums before
    each shuffle, and orders are compared by a hash a page, so no host's pages meet in one task. A template is no longer than
    a host's average page holds tokens, twice over.
    """

    def rows(columns):
        for host, page in zip(*columns, strict=True):
            content = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass")) >> 1
            for token, (n, at, around, kind) in page_tokens(page).items():
                yield host, token, content, n, at, around, kind

    schema = "host string, token long, content long, n long, at long, around long, kind string"
    tokens = map_rows(pages.select(host_of(F.col(f"`{url_col}`")), F.col(f"`{html_col}`").cast("string")), schema, rows)
    mark = F.xxhash64("content", "n")
    distinct = stash(tokens.groupBy("host", "token", "content").agg(F.max("n").alias("n"), F.max("at").alias("at"), F.max("around").alias("around"), F.max("kind").alias("kind")), "tokens")
    counted = distinct.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor(mark).alias("xor"), F.sum(F.pmod(mark, F.lit(2147483647))).alias("total"), F.max("n").alias("most"), F.max("around").alias("around"), F.max("kind").alias("kind")
    )
    # Every page opens at least one element or holds a text, but none need stand on all of them: the host's pages are counted apart.
    sizes = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.xxhash64(F.col(f"`{html_col}`").cast("string")).alias("content")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    frequent = counted.where(F.col("pages") >= MIN_PAGES).join(sizes, "host").where(F.col("pages") >= MIN_SHARE * F.col("host_pages"))
    frequent = frequent.withColumn("class", F.xxhash64("pages", "xor", "total"))
    member = F.struct("token", "around", "kind")
    classes = stash(frequent.groupBy("host", "class").agg(F.collect_list(member).alias("members"), F.max("most").alias("most"), F.count_if(F.col("kind") != "text").alias("elements")).where("size(members) > 1"), "classes")
    # Order: a class's tokens must first stand in the same order on all its pages.
    single = classes.select("host", "class", F.explode("members.token").alias("token"))
    placed = distinct.select("host", "token", "content", "at").join(single, ["host", "token"])
    orders = placed.groupBy("host", "class", "content").agg(F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])).alias("order"))
    ordered = orders.groupBy("host", "class").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a = b").select("host", "class")
    # Nesting: what stands around a class's outermost tokens belongs to one class only.
    own = F.col("members.token")
    outer = F.filter("members", lambda m: ~F.array_contains(own, m["around"]))
    valid = classes.join(ordered, ["host", "class"]).withColumn("outer", outer)
    edges = valid.select("host", "class", F.explode("outer.around").alias("token")).join(single.withColumnRenamed("class", "parent"), ["host", "token"], "left")
    nested = edges.groupBy("host", "class").agg(F.count_distinct(F.coalesce("parent", F.lit(0))).alias("parents")).where("parents = 1").select("host", "class")
    nested = valid.join(nested, ["host", "class"])
    has = lambda kind: F.exists("members", lambda m: m["kind"] == kind)
    top = F.get("outer", F.lit(0))["kind"]
    record = (F.col("most") > 1) & (F.col("elements") > 1) & (F.size("outer") == 1) & ((top == "element") | (top.isin("item", "link") & has("link")))
    # A record's outermost element marks the record; the rest of the class lies inside it.
    part = lambda m: F.when(m["kind"] == "text", TEXT).when(record & (m["token"] == F.col("outer")[0]["token"]), RECORD).when(F.col("most") == 1, FRAME).otherwise(OTHER)
    kept = nested.where(record | (F.size("members") >= MIN_TOKENS)).select("host", F.transform("members", lambda m: F.struct(m["token"].alias("token"), part(m).alias("part"))).alias("tokens"))
    return kept.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))


def main_text(page: str | None, template: dict[int, int] | None = None) -> str:
    """The page's main text: its main slot, a line for each block. ``template`` has the part of each of the host's tokens.

    Where no tag names the main slot, it is the deepest element of the template's frame with ``MAIN_SHARE`` of the page's
    slot text, or the whole page without such an element; there texts of the template and records are left out (records
    only if at least ``LEAST_SHARE`` of the text remains, template text unless nothing else stands on the page).
    """
    template = template or {}
    blocks: list[tuple[Node, bool, str]] = []  # element, all of it in the template?, text
    held: list[str] = []
    owner: list[Node | None] = [None]
    repeated = [True]

    def flush():
        text = clean("".join(held))
        held.clear()
        if text and owner[0] is not None:
            blocks.append((owner[0], repeated[0], text))
        owner[0], repeated[0] = None, True

    found = list(events(page))
    nodes: dict[int, Node] = {}
    for _, node, *_ in found:
        if node is not None:
            nodes.setdefault(id(node), node)
    settle(list(nodes.values()), template)
    for event in found:
        kind, node = event[0], event[1]
        if kind == "text":
            if node is None or node.outside:
                continue
            text = clean(event[2])
            known = bool(text) and bool(template) and template.get(token_hash("text", node.path, text)) == TEXT
            if known and not any(part.split(".", 1)[0] in PROSE for part in node.path.split("/")):
                continue
            if text:
                owner[0] = owner[0] or node
                repeated[0] = repeated[0] and known
            held.append(event[2])
        elif kind == "break" or node.tag in BLOCK:
            flush()
    flush()
    if any(node.main for node, _, _ in blocks):
        return "\n".join(text for node, _, text in blocks if node.main)
    own = [b for b in blocks if not b[1]] or blocks
    size = lambda some: sum(len(text) for _, _, text in some)
    single = [b for b in own if not b[0].record]
    if size(single) >= LEAST_SHARE * size(own):
        own = single
    main = main_element(own)
    return "\n".join(text for node, _, text in own if main is None or main in frames(node))


def frames(node: Node | None) -> list[Node]:
    """The frame elements around a node, innermost first."""
    out, node = [], node.frame if node else None
    while node is not None:
        out.append(node)
        node = node.parent.frame if node.parent else None
    return out


def main_element(blocks: list[tuple[Node, bool, str]]) -> Node | None:
    """The deepest frame element that holds ``MAIN_SHARE`` of the text; None without one."""
    held: dict[int, list] = {}
    for node, _, text in blocks:
        around = frames(node)
        for depth, f in zip(range(len(around), 0, -1), around, strict=True):
            held.setdefault(id(f), [0, depth, f])[0] += len(text)
    total = sum(len(text) for _, _, text in blocks)
    enough = [(depth, f) for n, depth, f in held.values() if n >= MAIN_SHARE * total]
    return max(enough, key=lambda x: x[0])[1] if enough else None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per input row.

    Null or empty html gives an empty text; a null url belongs to the host without a name; ids may be null, repeated
    rows are repeated (and count once for templates); an empty table gives no row.
    """
    source = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), host_of(F.col(f"`{url_col}`")).alias("host"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )
    templates = stash(host_templates(pages, url_col, html_col), "templates")
    size = templates.agg(F.coalesce(F.sum(F.length("host") + 12 * F.size("template")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        joined = source.join(F.broadcast(templates), "host", "left")
    else:
        of_host = source.groupBy("host").agg(F.count(F.lit(1)).alias("rows"))
        joined = join_hot(source, stash(of_host.join(templates, "host", "left"), "host-templates"), ["host"], "rows")
    joined = joined.select("page_id", "url", "html", "template")

    def rows(columns):
        last: tuple[list | None, dict[int, int]] = (None, {})
        for page_id, url, page, template in zip(*columns, strict=True):
            if template != last[0]:
                last = (template, {t["token"]: t["part"] for t in template or ()})
            text = main_text(page, last[1])
            yield page_id, url, text, len(text)

    return map_rows(joined, "page_id long, url string, text string, n_chars long", rows)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
