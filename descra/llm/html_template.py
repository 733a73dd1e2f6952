"""Operator 9: main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags and its text blocks, each told apart by the path
of elements it stands in.  A path names an element by tag, class and role: ids,
words with digits and all names of the page's and article's own elements vary
from page to page and stay out of it; an id is part of tokens of its element
alone.  A token's occurrence vector is how often it occurs in
each page of a host; tokens that share one form an equivalence class.  The
vector is never gathered: the sums of both halves of hashes of (page, count), with
the number of pages and of occurrences, identify it (repeated rows add up), so classes come from two
pre-aggregated groupings and a host with a third of all pages is no hot spot.

Classes that are frequent (in at least ``support`` of a host's pages that have
tokens, and in two) are valid where their tokens nest: an element's path holds every class that encloses it.
Together they are the host's template.  What a page has between the template's
tokens are slots: a text block of the template is none, inside an article as
outside.  In addition, slots below furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts) are dropped by tag and name (inside
an article, and by id anywhere, a name counts where the host's pages repeat the
element, or alone where the host has one page; headings have no names), and
where template or page has an article, or else a main element, only slots inside
it count.  A block is of the template if its class is frequent and has three
tokens at least, at every size of host.  Hosts with fewer than ``few`` pages are
deduced together too, for those that have one page alone.

Text: character references decoded, white space in a block one space, trimmed,
blocks in page order joined by a line feed.

Defined results: null or empty html gives an empty text; a page without any
article keeps every slot outside furniture; a page whose blocks are all of the
template is a copy of others and keeps them; a null url has the empty host;
repeated rows are pages of their own; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import html as html_library
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.llm import kit

SUPPORT, FEW, BROADCAST_BYTES = 0.5, 3, 32 << 20
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "annotation", "annotation-xml"))
#: Drawings, and a formula's notes for programs: no text; one that is never closed ends with its start tag.
DRAWN = frozenset(("svg", "canvas", "annotation", "annotation-xml"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the key ends these where they are open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
FURNITURE = frozenset("nav header footer aside form script style noscript template head title button select menu iframe svg textarea dialog canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notices?|alert|popup|modal|newsletter\w*|subscri\w*|"
    r"side-?bar\w*|menus?|nav\w*|breadcrumb\w*|footer\w*|masthead|site-?header|page-?header|header|comments?\w*|repl(?:y|ies)|disqus\w*|share\w*|social\w*|related\w*|"
    r"widgets?|login|signup|search\w*|pagination|toolbar|contentinfo|navigation|complementary|dialog|form)(?:$|[\s_-])",
    re.I,
)
#: Ids that name furniture inside an article, where ids are mostly made from the words of a heading.
IDS = frozenset("ad ads advert breadcrumbs comment comments cookies disqus_thread login modal newsletter pagination popup replies reply share sharing sidebar signup toolbar widgets".split())
#: Headers of texts outside an article, and inside one.
OWN_HEADERS = (re.compile(r"(?<![^\s_-])(?:article|entry|post|section|story|content)[_-]+header(?![^\s_-])", re.I), re.compile(r"(?<![^\s_-])header(?![^\s_-])", re.I))
NOT_NAMED, IF_REPEATED, NAMED = range(3)
#: Elements whose class says what a page is about.
VARYING = frozenset(("html", "body", "main", "article"))
DIGIT = re.compile(r"\d")


def named(tag: str, attributes: list[tuple[str, str]], inside: bool) -> int:
    """Whether an element's class, id or role name furniture: for certain, or if the host's pages repeat it."""
    found = NOT_NAMED
    if tag in HEADINGS or tag in ("html", "body"):
        return found
    for kind, value in attributes:
        if kind == "id":
            if value.lower() in IDS if inside else NAMES.search(value):
                found = max(found, IF_REPEATED)
        elif NAMES.search(OWN_HEADERS[inside].sub("", value)):
            found = max(found, IF_REPEATED if inside else NAMED)
    return found


class Node:
    """An open element: its tag with class, id and role, its path, whether it is furniture, and which paths here are if the host repeats them."""

    __slots__ = ("tag", "path", "own", "furniture", "if_repeated", "main", "main_path")

    def __init__(self, tag: str, attributes: list[tuple[str, str]], above: "Node | None"):
        self.tag = tag
        names = " ".join(f"{kind}={value}" for kind, value in attributes)
        lasting = "" if tag in VARYING else " ".join(f"{kind}={' '.join(words)}" for kind, value in attributes if kind != "id" and (words := [w for w in value.split() if not DIGIT.search(w)]))
        self.path = (above.path if above else "") + "/" + tag + (f"[{lasting}]" if lasting else "")
        #: The path with the element's own id, which only its own tokens have.
        self.own = next((f"{self.path}#{value}" for kind, value in attributes if kind == "id"), "")
        article = tag in ("article", "main") or "role=main" in names
        # The page's headline may stand in a header of the article itself.
        own_header = tag == "header" and above is not None and above.main
        by_name = named(tag, attributes, bool(above and above.main)) if attributes and not article else NOT_NAMED
        self.furniture = bool(above and above.furniture) or (tag in FURNITURE and not own_header) or by_name == NAMED
        self.if_repeated: tuple[str, ...] = (above.if_repeated if above else ()) + ((self.own or self.path,) if by_name == IF_REPEATED else ())
        self.main = (above.main if above else 0) or (2 if tag == "article" else 1 if article else 0)
        self.main_path = above.main_path if above and above.main else self.path if self.main else ""


def walk(html: str) -> Iterator[tuple[str, Node | None, str]]:
    """("<", node, ""), (">", node, ""), ("text", node, text) and ("block", node, "") at bounds of blocks, in page order."""
    stack: list[Node] = []
    at, n = 0, len(html)

    def pop_to(i: int) -> Iterator[tuple[str, Node | None, str]]:
        while len(stack) > i:
            node = stack.pop()
            if node.tag in BLOCK:
                yield "block", node, ""
            yield ">", node, ""

    for m in iter(lambda: TAG.search(html, at), None):
        if m.start() > at:
            yield "text", stack[-1] if stack else None, html[at : m.start()]
        at = max(m.end(), m.start() + 1)
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    yield from pop_to(i)
                    break
            continue
        if tag in BLOCK:
            # A block ends an open paragraph; items and cells end their like.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p" or stack[i].tag in ENDS.get(tag, ()):
                    yield from pop_to(i)
                    break
                if stack[i].tag in ("table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "select"):
                    break
        attributes = [(a[0].lower(), (a[1] or a[2] or a[3]).strip()) for a in ATTRIBUTE.findall(m[3])] if m[3] else []
        node = Node(tag, attributes, stack[-1] if stack else None)
        if tag in BLOCK:
            yield "block", node, ""
        yield "<", node, ""
        if tag == "br":
            yield "text", node, " "
        if tag in VOID or m[3].endswith("/") and (tag not in RAW or tag in DRAWN):
            yield ">", node, ""
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, at)
            at = end.end() if end else at if tag in DRAWN else n
            yield ">", node, ""
        else:
            stack.append(node)
    if at < n:
        yield "text", stack[-1] if stack else None, html[at:]
    yield from pop_to(0)


def clean(parts: list[str]) -> str:
    return " ".join(html_library.unescape("".join(parts)).split())


def blocks(html: str) -> Iterator[tuple[str, Node | None, str]]:
    """As walk, with whole cleaned blocks for text; a block that holds parts of different furniture is cut there."""
    parts: list[str] = []
    of: Node | None = None
    for kind, node, text in walk(html):
        if kind == "text":
            if parts and (of is None) != (node is None):
                pass
            elif parts and of is not None and (of.furniture, of.if_repeated, of.main) != (node.furniture, node.if_repeated, node.main) and "".join(parts).strip():
                if whole := clean(parts):
                    yield "text", of, whole
                parts = []
            if not parts or not "".join(parts).strip():
                of = node
            parts.append(text)
        elif kind == "block":
            if parts and (whole := clean(parts)):
                yield "text", of, whole
            parts = []
        else:
            yield kind, node, ""
    if parts and (whole := clean(parts)):
        yield "text", of, whole


def block_path(node: Node | None) -> str:
    """The path of the block that a node is in."""
    return node.path if node else ""


def page_tokens(html: str) -> Counter[str]:
    """The page's tokens: start and end tags by path, blocks by path and text."""
    found: Counter[str] = Counter()
    for kind, node, text in blocks(html):
        found[f"{kind}{block_path(node)}" + (f" {text}" if kind == "text" else "")] += 1
        if kind != "text" and node.own:
            found[kind + node.own] += 1
    return found


def token_hash(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token.encode()) - (1 << 63)


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token (hash), is_text, vector (a page's share of the signature), n: a row for each token of each page, and one with null is_text for each page that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                host, token, text, vector, count = [], [], [], [], []
                for h, page, markup in zip(*(batch.column(i).slice(a, 256).to_pylist() for i in range(3))):
                    tokens = page_tokens(markup or "")
                    if tokens:
                        host.append(h)
                        token.append(0)
                        text.append(None)
                        vector.append(0)
                        count.append(1)
                    for t, n in tokens.items():
                        host.append(h)
                        token.append(token_hash(t))
                        text.append(t.startswith("text"))
                        vector.append(xxhash.xxh3_64_intdigest(f"{page} {n}".encode()) - (1 << 63))
                        count.append(n)
                yield pa.record_batch([pa.array(host, pa.string()), pa.array(token, pa.int64()), pa.array(text, pa.bool_()), pa.array(vector, pa.int64()), pa.array(count, pa.int64())], names=["host", "token", "is_text", "vector", "n"])

    return pages.select("host", "page", "html").transform(kit.arrow(run, "host string, token long, is_text boolean, vector long, n long"))


def classes(pages: DataFrame, *, support: float = SUPPORT) -> DataFrame:
    """host, pages (that have tokens), class (number of the occurrence vector), token, is_text: the tokens of each host's frequent classes."""
    per_token = occurrences(pages).groupBy("host", "token", "is_text").agg(F.xxhash64(F.sum(F.expr("vector & 4294967295")), F.sum(F.expr("shiftrightunsigned(vector, 32)"))).alias("vector"), F.count("*").alias("pages_with"), F.sum("n").alias("total"))
    # Both sides of the join read one table: what one page alone has, the most, is not in it.
    repeated = kit.written(per_token.where("pages_with >= 2"), "tokens")
    per_host = repeated.where("is_text is null").select("host", F.col("pages_with").alias("pages"))
    frequent = repeated.where("is_text is not null").join(per_host, "host").where(F.col("pages_with") >= F.col("pages") * support)
    return frequent.select("host", "pages", F.xxhash64("vector", "pages_with", "total").alias("class"), "token", "is_text")


def templates(tokens: DataFrame) -> DataFrame:
    """host, pages, tags (token and class of frequent tags), texts (blocks of frequent classes of three tokens or more).

    A host's frequent tokens are at most a page's tokens divided by the support, however many pages there are.
    """
    size = tokens.groupBy("host", "class").agg(F.count("*").alias("size"))
    return tokens.join(size, ["host", "class"]).groupBy("host").agg(
        F.max("pages").alias("pages"),
        F.sort_array(F.collect_list(F.expr("CASE WHEN NOT is_text THEN struct(token, class) END"))).alias("tags"),
        F.sort_array(F.collect_list(F.expr("CASE WHEN is_text AND size >= 3 THEN token END"))).alias("texts"),
    )


class Template:
    """A host's template: the elements whose start and end tags are of one class, and nest in such elements up to the top."""

    def __init__(self, tags: list[dict] | None, texts: list[int] | None, pages: int):
        self.classes = {t["token"]: t["class"] for t in tags or ()}
        self.texts = set(texts or ())
        self.known: dict[str, bool] = {"": True}
        self.pages = pages

    def repeats(self, path: str) -> bool:
        """Whether the host's pages repeat the element; where there are no other pages, nothing speaks against it."""
        return not self.pages or token_hash("<" + path) in self.classes

    def holds(self, path: str) -> bool:
        if path not in self.known:
            if len(self.known) > 100_000:
                self.known = {"": True}
            start = self.classes.get(token_hash("<" + path))
            valid = start is not None and start == self.classes.get(token_hash(">" + path))
            self.known[path] = valid and self.holds(PARENT.sub("", path))
        return self.known[path]


#: The last element of a path, with its class, id and role.
PARENT = re.compile(r"/[^/\[]*(?:\[(?:(?!\]/).)*\])?$", re.S)


def main_text(html: str, template: Template) -> str:
    """The page's slots that count, in order."""
    slots = [(node.main if node else 0, node.main_path if node else "", f"text{block_path(node)} {text}", text) for kind, node, text in blocks(html) if kind == "text" and not (node and (node.furniture or any(map(template.repeats, node.if_repeated))))]
    # The template's own article or main element says which of the two counts; a page that departs from it is judged alone.
    held = [s[0] for s in slots if s[0] and template.holds(s[1])]
    best = max(held or [s[0] for s in slots], default=0)
    inside = [s for s in slots if s[0] >= best]
    own = [s for s in inside if token_hash(s[2]) not in template.texts] if template.texts else inside
    # Blocks that are all of the template are a copied page: copies are no evidence of furniture.
    return "\n".join(s[3] for s in own or inside)


def host_of(url: str = "url"):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def extract(pages: DataFrame, *, support: float = SUPPORT, few: int = FEW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of pages (page_id, url, html)."""
    base = pages.select("page_id", "url", host_of().alias("host"), "html")
    small = base.groupBy("host").agg(F.count("*").alias("host_pages"))
    # One page tells nothing of a template, so it asks the pool of small hosts; two pages tell their own.
    pool = F.lit("*")
    named_hosts = kit.written(small.select("host", F.when(F.col("host_pages") < few, F.array("host", pool)).otherwise(F.array("host")).alias("given"), F.when(F.col("host_pages") < F.least(F.lit(2), F.lit(few)), pool).otherwise(F.col("host")).alias("deduced")), "hosts")
    hosts = named_hosts if not _fits(named_hosts, broadcast_bytes) else F.broadcast(named_hosts)
    keyed = base.join(hosts, "host").select("page_id", "url", "given", "deduced", F.xxhash64("page_id", "url").alias("page"), "html")
    template = kit.written(templates(classes(keyed.select(F.explode("given").alias("host"), "page", "html"), support=support)), "templates")
    found = keyed.withColumnRenamed("deduced", "host").join(F.broadcast(template) if _fits(template, broadcast_bytes) else template, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, min(512, batch.num_rows - a))
                out = []
                for i, (host, markup) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        # The pool of small hosts does not say what one of them repeats.
                        known[host] = Template(part.column(5)[i].as_py(), part.column(6)[i].as_py(), (part.column(4)[i].as_py() or 0) if host != "*" else 0)
                    out.append(main_text(markup or "", known[host]))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return found.select("page_id", "url", "host", "html", "pages", "tags", "texts").transform(kit.arrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"))


def _fits(table: DataFrame, most: int) -> bool:
    """Whether a written table may be broadcast: its rows are counted, with their arrays."""
    sizes = [F.lit(64)] + [F.size(c) * 8 for c, kind in table.dtypes if kind.startswith("array")]
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    return (table.agg(F.sum(total)).first()[0] or 0) <= most


def op9_template_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(kit.read(spark, sf_dir, "pages"))
