"""Main text of web pages by a style tree of each site, with what markup says of an element as a prior."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profileloom.llm.common import cut, hot_hashes, salted_join, stored, text_or_empty

#: A branch goes if its importance, of 0 to 1, is under LEAST. DAMPING: how far presentation counts more, the more styles a node has.
LEAST, DAMPING = 0.1, 0.9
#: Prior of an element by its markup, and how many pages' evidence it is worth: the article itself, and what markup says
#: nothing of. What markup calls noise goes whatever the pages say.
ARTICLE, PLAIN = (1.0, 4.0), (0.5, 1.0)
#: Pages that a worker unpacks at a time, and removed nodes up to which they are broadcast (8 bytes each).
SLICE, BROADCAST_NODES = 200, 1_000_000

#: HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe svg canvas select title head audio video".split())
NOISE = frozenset("nav footer aside form menu button dialog".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words that class and id attributes use for what isn't the article; within it, only names that say so as a whole; and words
#: that go with either.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup menu menus nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer masthead toolbar share sharing social related recommended comments comment commentlist discussion disqus replies reply respond login search pagination pager copyright skip".split())
INNER_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored promo newsletter share sharing social-share share-buttons related related-posts related-articles comments comment-list commentlist comment-section disqus disqus_thread respond cookie-notice cookie-banner breadcrumb breadcrumbs pagination".split())
WITH_NAMES = frozenset("main site page top bottom left right inner outer wrap wrapper container box bar block section area list item items header content primary secondary global post posts article entry form link links button buttons icon icons has is no js the thread".split())

_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r"""[>"']""")
_PART = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_IN_PARAGRAPH = frozenset("td th li article section div blockquote button".split())
_SAME = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",))}


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed) >> 1


def says_noise(name: str) -> bool:
    """Whether a class or id name is a word of NAMES, alone or with words that say nothing of it: main-nav, but not social-studies."""
    parts = [p for p in _PART.split(_DIGITS.sub("", name)) if p]
    return name in NAMES or not NAMES.isdisjoint(parts) and all(p in NAMES or p in WITH_NAMES for p in parts)


class Element:
    """A node of the page: its place in the merged tree of the site, and what its markup says of it."""

    __slots__ = ("article", "children", "core", "depth", "inner", "noise", "parent", "path", "said", "soft", "tag")

    def __init__(self, tag: str, label: str, parent: Element | None, noise: bool = False, soft: bool = False, article: bool = False, site: int = 0, inner: bool = False):
        self.tag, self.parent, self.noise, self.soft, self.article = tag, parent, noise, soft, article
        self.core, self.children, self.said, self.inner = False, [], None, inner
        self.depth = parent.depth + 1 if parent else 0
        # elements of a site with the same labels down to them are one node of its tree
        self.path = _hash(label, parent.path if parent else site)
        if parent:
            parent.children.append(label)

    def judged(self) -> tuple[bool, bool]:
        """(noise, inside): whether markup calls the element or one above noise, and whether it is in the article. Those above are judged first."""
        if self.said is None:
            noise, inside = self.parent.said if self.parent else (False, False)
            # a name or a header says little of an element that holds the article; in the article only names count that are told as a whole
            named = self.inner if inside else self.soft
            inside = inside or self.article
            self.said = noise or not self.core and (self.noise or named), inside
        return self.said


def _tag_end(page: str, at: int, quotes: bool) -> tuple[int, bool]:
    """Place of the > that ends the tag, and whether quotes still count: once they don't pair up, they are plain characters from there on."""
    i = at
    while quotes:
        m = _STOP.search(page, i)
        if m is None:
            quotes = False
        elif m[0] == ">":
            return m.start(), True
        else:
            i = page.find(m[0], m.end()) + 1
            quotes = i > 0
    return page.find(">", at), False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def parse_page(page: str, site: int = 0) -> tuple[list[Element], list[tuple[Element, str]]]:
    """(elements, blocks): the page's elements, and its texts in order with the block element that holds each.

    Character references are decoded and white space squeezed; what is never shown is left out. Time is linear in the
    page, however deep it nests: tags are found by plain searches, elements carry what is known of those above, and the
    open elements of each tag are known by place, so nothing is searched for upwards.
    """
    root = Element("", "", None, site=site)
    elements, blocks, stack, parts = [root], [], [root], []
    # places in the stack: of each tag's open elements, and of the open blocks
    places: dict[str, list[int]] = {}
    open_blocks: list[int] = []
    at, size, quotes = 0, len(page), True

    def flush() -> None:
        line = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if line:
            blocks.append((stack[open_blocks[-1]] if open_blocks else root, line))

    def last(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close_from(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCKS:
                open_blocks.pop()

    def close_open(names: Iterable[str], within: Iterable[str]) -> None:
        k = last(names)
        if k and k >= last(within):
            close_from(k)

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            break
        after = page[begin + 1 : begin + 2]
        if begin > at:
            parts.append(page[at:begin])
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 4) + 3
            if at < 3:
                return _finish(elements, flush, blocks)
            continue
        closing = after == "/"
        name = _NAME.match(page, begin + 2) if closing else _NAME.match(page, begin + 1)
        if name is None and after not in ("!", "?"):
            parts.append("<")
            at = begin + 1
            continue
        if name is None or closing:
            end = page.find(">", begin)
        else:
            end, quotes = _tag_end(page, name.end(), quotes)
        if end < 0:  # a tag without end, and all that follows, is never shown
            return _finish(elements, flush, blocks)
        at = end + 1
        if name is None:
            continue
        tag = name[0].lower()
        if closing:
            if tag in BLOCKS:
                flush()
            k = last((tag,))
            if k and (tag in BLOCKS or not open_blocks or open_blocks[-1] < k):
                close_from(k)
            continue
        attributes = page[name.end() : end]
        empty = attributes.rstrip().endswith("/")
        if tag in RAW and not empty:
            at = _raw_end(page, at, tag)
            continue
        if tag in BLOCKS or tag == "option":
            flush()
            if tag not in ("html", "body"):
                close_open(("p",), _IN_PARAGRAPH)
            if tag in _SAME:
                close_open(*_SAME[tag])
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            stack[-1].children.append(tag)
            continue
        given = _attributes(attributes) if attributes else {}
        names = f"{given.get('class', '')} {given.get('id', '')}".lower().split()
        words = {p for n in names for p in (n, *_PART.split(n))}
        soft = tag not in ("html", "body", "main", "article") and any(map(says_noise, names)) or tag == "header"
        soft = soft or tag == "article" and not words.isdisjoint(("comment", "comments", "reply"))
        inner = soft if tag == "article" else not INNER_NAMES.isdisjoint(names)
        noise = tag in NOISE or given.get("role", "").lower() in ROLES
        article = tag in ("article", "main") and not soft or given.get("role") == "main"
        label = tag + "".join(f".{_DIGITS.sub('0', n)}" for n in sorted(names))
        element = Element(tag, label, stack[-1], noise, soft, article, inner=inner)
        elements.append(element)
        core = element if article else None
        while core is not None and not core.core:
            core.core, core = True, core.parent
        if not empty:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                open_blocks.append(len(stack))
            stack.append(element)
    if at < size:
        parts.append(page[at:])
    return _finish(elements, flush, blocks)


def _finish(elements: list[Element], flush: Callable[[], None], blocks: list) -> tuple[list[Element], list]:
    flush()
    for e in elements:
        e.judged()
    return elements, blocks


def _raw_end(page: str, at: int, tag: str) -> int:
    """Where what follows a raw element's start tag is shown again."""
    if tag in ("script", "style", "textarea", "iframe", "title"):
        end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
        return end.end() if end else len(page)
    end = re.compile(rf"</{tag}\s*>|<body\b" if tag == "head" else rf"</{tag}\s*>", re.I).search(page, at)
    if end is None:
        return len(page)
    return end.end() if end[0][1] == "/" else end.start()


def _host(url: str) -> str:
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() if "://" in url else ""


#: What markup says of a node on a page: nothing, that it is in the article, or that it is noise.
UNSAID, INSIDE, NOISY = 0, 1, 2
_NODES = "array<struct<path:long,up:long,depth:int,style:long,leaf:boolean,prior:int>>"
_BLOCKS = "array<struct<path:long,content:long,prior:int,text:string>>"
_PAGES = f"page_id long, url string, key binary, sign long, nodes {_NODES}, blocks {_BLOCKS}"


def page_nodes(url: str, page: str) -> tuple[bytes, int, list[tuple], list[tuple]]:
    """(key, sign, nodes, blocks) of a page: see parsed_pages."""
    elements, texts = parse_page(page, _hash(_host(url)))
    articles = any(owner.said == (False, True) for owner, _ in texts)
    # a page whose article has no title of its own has it beside the article
    titled = any(owner.said == (False, True) and owner.tag == "h1" for owner, _ in texts)
    title = articles and not titled and next((o for o, _ in texts if o.tag == "h1" and o.said == (False, False)), None) or None
    above = set()
    while title is not None:
        above.add(title)
        title = title.parent

    def prior(e: Element) -> int:
        noise, inside = e.said
        # in a page with an article, text beside it is noise; what holds the article isn't
        return NOISY if noise or articles and not inside and not e.core and e not in above else INSIDE if inside else UNSAID

    nodes: dict[int, tuple] = {}
    for e in elements:
        _, _, _, style, leaf, _ = nodes.get(e.path, (0, 0, 0, 0, True, 0))
        nodes[e.path] = e.path, e.parent.path if e.parent else None, e.depth, _hash("\n".join(e.children), style), leaf and not e.children, prior(e)
    blocks = [(o.path, _hash(text, o.path), NOISY if articles and not o.said[1] and not (o.tag == "h1" and o in above) else prior(o), text) for o, text in texts]
    key = xxhash.xxh3_128_digest(f"{url}\n{page}".encode("utf-8", "replace"))
    return key, _hash("\n".join(text for _, text in texts)), list(nodes.values()), blocks


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, sign, nodes, blocks) for every page, parsed once.

    nodes: path, up (the node above), depth, style (what its elements hold, in order), leaf (whether that is text
    alone) and prior; blocks, in page order: path, content (of path and text), prior and text. Paths are hashes of the
    host and of the labels down to the node. key is equal for equal pages; sign is a hash of all texts, so that pages of a site that say
    the same count as one.
    """

    def lists(rows: list[list[tuple]], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.ListArray:
        ends = [0]
        for r in rows:
            ends.append(ends[-1] + len(r))
        flat = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * len(names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(f, t) for f, t in zip(flat, types, strict=True)], names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, small = pa.int64(), pa.int32()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [page_nodes(u or "", h) for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)]
                nodes = lists([m[2] for m in made], ("path", "up", "depth", "style", "leaf", "prior"), (long, long, small, long, pa.bool_(), small))
                blocks = lists([m[3] for m in made], ("path", "content", "prior", "text"), (long, long, small, pa.string()))
                columns = [part.column("page_id"), part.column("url"), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], long), nodes, blocks]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "key", "sign", "nodes", "blocks"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return rows.mapInArrow(run, _PAGES)


def _entropy(n_log_n: Column, n: Column, pages: Column) -> Column:
    """Entropy, base the number of pages, of counts with the sum n and the sum of n * log(n); 1 for one page."""
    return F.when(pages <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(n.cast("double")) - n_log_n / n) / F.log(pages.cast("double")))))


def _n_log_n(n: str) -> Column:
    return F.col(n) * F.log(F.col(n).cast("double"))


def style_tree(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, up, depth, pages, importance) of element nodes, (content, pages, importance) of content nodes) of all sites' merged pages.

    A content node is a text at an element node. On n of the m pages that have the element, it has importance
    1 - log(n) / log(m): 0 if all pages repeat it, 1 if one has it or if there is one page. An element's presentation
    importance is the entropy, base m, of its styles over pages. Its importance is that of what it holds, the mean of its
    texts and children weighted by text length, damped towards the presentation importance the more styles it has;
    for an element of text alone it is the mean. Importances are composed from the deepest elements up, in rounds that grow with the
    logarithm of the depth. Counts are
    combined before each shuffle, so that a large site is spread over tasks. Sites of one page, which lose nothing, are left out
    while the others can be broadcast (8 bytes each).
    """
    root = F.element_at("nodes", 1)["path"].alias("root")
    sites = cut(parsed.select(root, "sign").distinct().groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"))
    if sites.count() <= BROADCAST_NODES:
        parsed = parsed.withColumn("root", F.element_at("nodes", 1)["path"]).join(F.broadcast(sites), "root", "left_semi")
    seen = parsed.select("sign", F.explode("nodes").alias("n")).groupBy("n.path", "n.up", "n.depth", "sign").agg(F.min("n.style").alias("style"), F.min("n.leaf").alias("leaf"))
    styles = seen.groupBy("path", "up", "depth", "style").agg(F.count("*").alias("k"), F.min("leaf").alias("leaf"))
    nodes = styles.groupBy("path", "up", "depth").agg(F.sum("k").alias("pages"), F.count("*").alias("styles"), F.sum(_n_log_n("k")).alias("kk"), F.min("leaf").alias("leaf"))
    nodes = nodes.select("path", "up", "depth", "pages", "styles", "leaf", _entropy(F.col("kk"), F.col("pages"), F.col("pages")).alias("shape"))
    texts = parsed.select("sign", F.explode("blocks").alias("b")).groupBy("b.path", "b.content", "sign").agg(F.max(F.octet_length("b.text")).alias("size"))
    texts = texts.groupBy("path", "content").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    same = F.when(F.col("pages") <= 1, 1.0).otherwise(1 - F.least(F.lit(1.0), F.log(F.col("n").cast("double")) / F.log(F.col("pages").cast("double"))))
    contents = stored(texts.join(nodes.select("path", "pages"), "path").select("path", "content", "n", "size", "pages", same.alias("importance")))
    weight = (F.col("n") * F.col("size")).cast("double")
    held = contents.groupBy("path").agg(F.sum(weight).alias("weight"), F.sum(weight * F.col("importance")).alias("mass"))
    kept = F.when(F.col("leaf"), 1.0).otherwise(F.pow(F.lit(DAMPING), F.col("styles")))
    nodes = nodes.join(held, "path", "left").na.fill(0.0, ["weight", "mass"]).withColumn("kept", kept).withColumn("form", (1 - F.col("kept")) * F.col("shape"))
    nodes = cut(nodes.select("path", "up", "depth", "pages", "kept", "form", "weight", "mass"))
    sums = summed_up(nodes)
    importance = F.when(F.col("total") > 0, F.col("gained") / F.col("total")).otherwise(F.col("form") + F.col("kept"))
    done = nodes.join(sums, "path").select("path", "up", "depth", "pages", importance.alias("importance"))
    return done, contents.select("content", "pages", "importance")


def summed_up(nodes: DataFrame) -> DataFrame:
    """(path, total, gained) of nodes (path, up, kept, form, weight, mass): the text below each, and that text times its importance.

    With sums over the node's own texts and the branches below it, total = sum of weights and gained = form * total + kept *
    sum of masses. That is linear, so a node passes both on to the one above by two factors, whose products along a way are two
    factors again: each round nodes pass their sums to the node twice as far above, and the rounds grow with the
    logarithm of the depth. A node passes on what nodes nearer than that have given it, so every branch is counted once.
    """
    gained = F.col("form") * F.col("weight") + F.col("kept") * F.col("mass")
    at = nodes.select("path", F.col("weight").alias("total"), gained.alias("gained"), F.col("up").alias("to"))
    # what is passed on to `to` counts there as `turn` times the weight and `share` times the mass
    factors = nodes.select(F.col("path").alias("to"), F.col("form").alias("turn"), F.col("kept").alias("share"))
    moving = at.where(F.col("to").isNotNull())
    at = cut(at.join(salted_join(moving.select("path", "to"), factors, ["to"], hot_hashes(moving, ["to"]), ["path"]).drop("to"), "path", "left"))
    while at.where(F.col("to").isNotNull()).take(1):
        moving = at.where(F.col("to").isNotNull())
        given = moving.groupBy(F.col("to").alias("path")).agg(F.sum("total").alias("more"), F.sum(F.col("turn") * F.col("total") + F.col("share") * F.col("gained")).alias("more_gained"))
        far = at.where(F.col("to").isNotNull()).select(F.col("path").alias("to"), F.col("to").alias("next"), F.col("turn").alias("turn_next"), F.col("share").alias("share_next"))
        ways = salted_join(moving.select("path", "to", "turn", "share"), far, ["to"], hot_hashes(moving, ["to"]), ["path"])
        turn, share = F.col("turn_next") + F.col("share_next") * F.col("turn"), F.col("share_next") * F.col("share")
        ways = ways.select("path", F.col("next").alias("to"), turn.alias("turn"), share.alias("share"))
        sums = at.join(given, "path", "left").na.fill(0.0, ["more", "more_gained"])
        sums = sums.select("path", (F.col("total") + F.col("more")).alias("total"), (F.col("gained") + F.col("more_gained")).alias("gained"))
        at = cut(sums.join(ways, "path", "left"))
    return at.select("path", "total", "gained")


def unimportant(elements: DataFrame, contents: DataFrame) -> DataFrame:
    """(code): nodes to remove, as twice the node's hash and what markup says of it on the page (UNSAID or INSIDE).

    The pages' importance counts as much as there are pages but one, against the prior of the markup.
    """
    rows = elements.select(F.col("path").alias("node"), "pages", "importance").union(contents)
    rows = rows.where("pages > 1").withColumn("said", F.explode(F.array(F.lit(UNSAID), F.lit(INSIDE))))
    more = F.col("pages") - 1
    believed = [(F.lit(prior * worth) + more * F.col("importance")) / (F.lit(worth) + more) for prior, worth in (PLAIN, ARTICLE)]
    low = F.when(F.col("said") == INSIDE, believed[1]).otherwise(believed[0]) < LEAST
    return rows.where(low).select((F.shiftleft("node", 1) + F.col("said")).alias("code"))


def _code(node: int, prior: int) -> int:
    code = 2 * node + prior
    return code - (1 << 64) if code >= 1 << 63 else code


def kept_text(nodes: list[dict], blocks: list[dict], removed: frozenset[int] | set[int]) -> str:
    """The page's blocks, one to a line, without the branches and texts that are noise or in `removed`."""
    lost: dict[int | None, bool] = {None: False}
    for n in sorted(nodes, key=lambda n: n["depth"]):
        lost[n["path"]] = lost.get(n["up"], False) or n["prior"] == NOISY or _code(n["path"], n["prior"]) in removed
    return "\n".join(b["text"] for b in blocks if b["prior"] != NOISY and not lost[b["path"]] and _code(b["content"], b["prior"]) not in removed)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of `pages`: the article's blocks in page order, one to a line.

    Branches and texts go whose importance is under LEAST. The pages of a site say how important they are: what most of
    them repeat isn't, and neither is a branch that mostly holds such text. What markup says is the prior: an article
    needs many more pages against it; and menus, headers, footers, sidebars, forms, notices, adverts, comments and what
    stands beside the article of a page that has one go whatever the pages say, but for its title if the article has none. A header or
    name that holds the article itself doesn't count, and within it only names that say so as a whole do (INNER_NAMES). Hidden text is text.

    A null url belongs to the site without a host, null html gives empty text; ids may be null. Equal pages count once and get equal
    texts; pages may be of any length; an empty table gives no rows; columns other than page_id, url and html aren't read. Pages are
    parsed once and written to the shared folder. Removed nodes are broadcast up to BROADCAST_NODES, 8 bytes each; beyond, they are joined by node.
    """
    parsed = stored(parsed_pages(pages))
    low = cut(unimportant(*style_tree(parsed)))
    if low.count() <= BROADCAST_NODES:
        codes = np.unique(np.array([r.code for r in low.collect()], np.int64))
        every = parsed.sparkSession.sparkContext.broadcast(codes)
        rows = parsed.select("page_id", "url", "nodes", "blocks", F.lit(None).cast("array<long>").alias("low"))
    else:
        every = None
        code = lambda node, said: F.shiftleft(node, 1) + said
        on_page = F.concat(F.transform("nodes", lambda n: code(n["path"], n["prior"])), F.transform("blocks", lambda b: code(b["content"], b["prior"])))
        uses = parsed.select("key", F.explode(F.array_distinct(on_page)).alias("code"))
        found = salted_join(uses, low.distinct(), ["code"], hot_hashes(uses, ["code"]), ["key"]).groupBy("key").agg(F.collect_set("code").alias("low"))
        rows = parsed.join(found, "key", "left").select("page_id", "url", "nodes", "blocks", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = [part.column(c).to_pylist() for c in ("nodes", "blocks", "low")]
                if every:  # of a million sorted numbers, those that the pages at hand have
                    here = np.array([_code(n[c], n["prior"]) for pages, c in ((lists[0], "path"), (lists[1], "content")) for page in pages for n in page], np.int64)
                    found = set(np.intersect1d(here, every.value).tolist())
                for nodes, blocks, own in zip(*lists, strict=True):
                    out.append(kept_text(nodes, blocks, found if every else set(own or ())))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    rows = rows.mapInArrow(run, "page_id long, url string, text string")
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
