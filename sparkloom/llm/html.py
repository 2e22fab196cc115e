"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: elements, named by the path of open elements they stand in, and whole text
blocks, named by path and text. Tokens of a host that occur equally often on each of its pages share an
occurrence vector and form an equivalence class; vectors are compared by sums of page hashes, so a class
forms by aggregation alone however many pages a host has. Classes found on enough pages are valid; they
nest along the paths of their elements into the host's template. Elements that are once on a page are its
skeleton: what lies between them are slots. Blocks that recur on the host's pages are the template's own text.

The article's slots are chosen once for a host, from the text of all its pages: a slot counts by the text that is
the pages' own, outside links; a declared article is one signal among these. Extraction walks a page once
more, takes those slots, and leaves out the template's own text and the parts named as menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import stored

#: Fixed values of HTML: elements without content, with raw content, and those that stand in running text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = frozenset(("article", "main", "body", "table", "ul", "ol", "dl"))
#: Elements that are a part of an article, not its container.
PARTS = frozenset("p ul ol li dl dd dt table thead tbody tfoot tr td th blockquote pre section figure figcaption details h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements, roles and words of class or id that name what is not the article. The first words
#: do so anywhere, the others only outside a declared article.
APART = frozenset("head nav footer aside form button select dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
APART_ANYWHERE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter "
    "subscribe subscription signup sidebar sidebars nav navbar navigation breadcrumb breadcrumbs pagination comment comments disqus "
    "share sharing social related recommended recommendations".split()
)
APART_OUTSIDE = APART_ANYWHERE | frozenset(
    "banner notice notices notification popup modal overlay login menu menus navigations pager toc footer header masthead topbar "
    "toolbar respond reply replies widget widgets form search skip".split()
)
#: Words that, beside one of the others, make up a name of a part of the page and not of a subject.
FRAME_WORDS = frozenset(
    "area bar bars block body bottom box btn button buttons card cards col column container content desktop entry fixed global icon icons inner "
    "item items label large left link links list main media mobile outer overlay page panel post posts primary region right row secondary "
    "section site slot small sticky text title top unit wrap wrapper zone".split()
)
#: What a declared article can be after all.
APART_ARTICLE = frozenset("ad ads advert adverts advertisement comment comments disqus promo sponsor sponsored".split())
MAIN_WORDS = frozenset(("articlebody", "article-body", "article__body", "post-content", "entry-content", "article-content", "story-body"))

# a quote opens a value only right after an equals sign; what is read is not read again
_markup = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?:>|\Z)", re.S)
_attribute = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_joints = re.compile(r"[-_]+")
DEEP = 4000  # characters of a path; elements further down are told from each other no more


def names_a_part(token: str, words: frozenset) -> bool:
    """Whether a word of a class or id is one of ``words``, or several words, one of these among them, that all name parts of pages."""
    if token in words:
        return True
    parts = [p for p in _joints.split(token) if p]
    return any(p in words for p in parts) and all(p in APART_OUTSIDE or p in FRAME_WORDS or p.isdigit() for p in parts)


def describe(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """The element's name with its classes, whether it is apart from the article, whether even inside it, and whether it is the article.

    Of an attribute named twice the first counts; words inside values are no names. A class or id counts as a whole, so that
    one that names a subject (``category-social``, ``related-work``) says nothing; a declared article is not judged by such words
    unless it is a comment or an advert.
    """
    found: dict[str, str] = {}
    for m in _attribute.finditer(attributes) if attributes.strip() else ():
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    classes = " ".join(sorted(f"{found.get('class', '')} {found.get('id', '')}".split()))
    names = classes.split() if tag not in ("html", "body", "main") else []
    article = tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articlebody" or bool(set(classes.split()) & MAIN_WORDS)
    always = tag in APART or tag in RAW or found.get("role") in APART_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    always = always or any(names_a_part(n, APART_ARTICLE if article else APART_ANYWHERE) for n in names)
    apart = always or tag == "header" or not article and any(names_a_part(n, APART_OUTSIDE) for n in names)
    return f"{tag}.{classes.replace(' ', '.')}" if classes else tag, apart, always, article and not (apart and tag != "main")


class Block:
    """A run of text: its words, path, the path of its container, and where it stands.

    ``part``: in a paragraph, heading, list, table or quotation; ``linked``: in a link alone.
    """

    __slots__ = ("text", "path", "container", "apart", "article", "part", "linked")

    def __init__(self, text: str, path: str, container: str, apart: bool, article: bool, part: bool, linked: bool):
        self.text, self.path, self.container, self.apart = text, path, container, apart
        self.article, self.part, self.linked = article, part, linked


def parse(page: str, known: dict | None = None) -> tuple[Counter, list[Block]]:
    """How often each element path occurs, and the text blocks in page order."""
    known = {} if known is None else known
    elements: Counter = Counter()
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool, bool, dict]] = []  # tag, path, apart, article, in a header, children by name
    run: list[str] = []
    top: dict[str, int] = {}
    plain = False  # whether the run has text outside links
    opened: Counter = Counter()  # open elements by tag
    barriers = [0]  # and of those that bar a way up
    apart_at: list[int] = []  # where elements stand that are apart by what they are

    def flush() -> None:
        nonlocal plain
        text, linked = " ".join(entities.unescape("".join(run)).split()), not plain
        run.clear()
        plain = False
        if text:
            at = len(stack)
            while at and stack[at - 1][0] in INLINE:
                at -= 1
            tag, path, apart, article, head, _ = stack[at - 1] if at else ("", "", False, False, False, top)
            heading = tag in HEADINGS
            container = stack[at - 2][1] if at > 1 and (heading or tag in ("p", "li", "pre", "blockquote", "dd", "dt", "td")) else path
            blocks.append(Block(text, path, container, apart or head and not heading, article, tag in PARTS, linked))

    def pop(to: int) -> None:
        if any(e[0] not in INLINE for e in stack[to:]):
            flush()
        for e in stack[to:]:
            opened[e[0]] -= 1
            barriers[0] -= e[0] in BARRIER
        del stack[to:]
        while apart_at and apart_at[-1] >= to:
            apart_at.pop()

    at, end = 0, len(page)
    while at < end:
        m = _markup.search(page, at)
        if m is None:
            run.append(page[at:])
            plain = True
            break
        if m.start() > at:
            run.append(page[at : m.start()])
            plain = plain or not opened["a"] and not page[at : m.start()].isspace()
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            held = barriers[0] and tag not in BARRIER and tag != "html"
            if not opened[tag]:
                if tag not in INLINE and not held:
                    flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if held and stack[i][0] in BARRIER:
                    break
            continue
        if tag == "br" or tag == "wbr":
            run.append(" " * (tag == "br"))
            continue
        key = (tag, m[3])
        if (about := known.get(key)) is None:
            if len(known) > 50_000:
                known.clear()
            about = known[key] = describe(tag, m[3])
        name, apart, always, article = about
        if tag in CLOSES_P and opened["p"]:
            pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
        ends = [t for t in SELF_CLOSING.get(tag, ()) if opened[t]]
        for i in range(len(stack) - 1, -1, -1) if ends else ():
            if stack[i][0] in ends:
                pop(i)
                break
            if stack[i][0] in BARRIER:
                break
        if tag in ("body", "article", "main"):  # what should have been closed before
            for i in apart_at[:50]:
                e = stack[i]
                if (tag == "body" or not (i and stack[i - 1][3])) and "comment" not in e[1]:
                    pop(i)
                    break
        if tag not in INLINE:
            flush()
        _, above, inside, around, headed, children = stack[-1] if stack else ("", "", False, False, False, top)
        if tag not in PARTS and tag not in INLINE:  # containers of one name are told apart by their order
            children[name] = children.get(name, 0) + 1
            name = f"{name}[{children[name]}]" if children[name] > 1 else name
        path = f"{above}>{name}" if len(above) < DEEP else above
        if path is not above:
            elements[path] += 1
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        head = headed or tag == "header" and around
        opened[tag] += 1
        barriers[0] += tag in BARRIER
        stack.append((tag, path, inside or (always if around else apart), around or article and not inside, head, {}))
        if tag in APART and stack[-1][2]:
            apart_at.append(len(stack) - 1)
    flush()
    return elements, blocks


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def block_key(block: Block) -> int:
    return _key(f"{block.path}|{block.text}")


SUMS = ("chars", "own", "declared", "parts")  # code points of a path's text: all, outside links, in a declared article, in paragraphs and their like


def _sums(blocks: list[Block]) -> dict[str, list[int]]:
    """The four sums by container, over the blocks that are not apart."""
    sums: dict[str, list[int]] = {}
    for b in blocks:
        if not b.apart:
            n, own = len(b.text), 0 if b.linked else len(b.text)
            for i, x in enumerate((n, own, own * b.article, own * b.part)):
                sums.setdefault(b.container, [0, 0, 0, 0])[i] += x
    return sums


def page_tokens(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``(host, token, path, is_text, declared_text, count, page, ...SUMS)`` of each distinct token of each page.

    The path of a text is that of its container; its sums are those of all its occurrences.
    """
    names = ["host", "token", "path", "is_text", "count", "page", *SUMS]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64()] + [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            out: list[tuple] = []
            for host, page, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                elements, blocks = parse(raw or "", known)
                sums = _sums(blocks)
                elements.setdefault("", 1)  # what stands in no element
                out += [(host, _key(path), path, False, n, page, *sums.get(path, (0, 0, 0, 0))) for path, n in elements.items()]
                texts: dict[int, list[Block]] = {}
                for b in blocks:
                    if not b.apart:
                        texts.setdefault(block_key(b), []).append(b)
                for token, same in texts.items():
                    out.append((host, token, same[0].container, True, len(same), page, *_sums(same)[same[0].container]))
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    page = F.xxhash64(F.monotonically_increasing_id())
    rows = pages.select(host_of(F.col(url_col)).alias("host"), page.alias("page"), F.col(html_col).alias("html"))
    schema = "host string, token bigint, path string, is_text boolean, count int, page bigint, " + ", ".join(f"{c} bigint" for c in SUMS)
    return rows.mapInArrow(run, schema)


def deduce_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """The valid equivalence classes of each host: ``(host, pages, class, parent, support, once, paths, texts)``.

    ``support``: pages that have the class's tokens; valid from ``least_share`` of the host's pages on. ``once``: its
    tokens are once on each page. ``paths``: its elements; ``texts``: its text tokens, known only on hosts of
    ``least_pages`` pages or more. ``parent``: the class of the element around its outermost one, null at the top.
    """
    return nested_classes(valid_tokens(*host_tokens(pages, url_col, html_col), least_share, least_pages))


def host_tokens(pages: DataFrame, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """Each host's tokens with their occurrence vectors and sums, and ``(host, pages)``.

    Equal pages of a host count as one. Tokens are summed per host before anything is grouped.
    """
    marked = pages.select(html_col, url_col, host_of(F.col(url_col)).alias("_host"), F.xxhash64(html_col).alias("_mark"))
    marked = marked.dropDuplicates(["_host", "_mark"])
    page = F.xxhash64("page", "count")
    tokens = page_tokens(marked, url_col, html_col).groupBy("host", "token").agg(
        F.max("path").alias("path"), F.first("is_text").alias("is_text"), F.count("*").alias("support"), F.sum("count").alias("total"),
        F.sum(page.bitwiseAND(F.lit(0x7FFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned(page, 33)).alias("high"),
        *[F.sum(c).alias(c) for c in SUMS],
    )
    # a text on a single page is no template's: only its path's sums are of use
    tokens = stored(tokens.where("not is_text or support > 1"), "tokens")
    return tokens, tokens.where("not is_text and path = ''").select("host", F.col("support").alias("pages"))


def valid_tokens(tokens: DataFrame, hosts: DataFrame, least_share: float, least_pages: int) -> DataFrame:
    enough = (F.col("support") >= least_share * F.col("pages")) & (~F.col("is_text") | (F.col("pages") >= least_pages))
    valid = tokens.join(hosts, "host").where(enough)
    return stored(valid.withColumn("class", F.xxhash64("low", "high", "support", "total")), "valid")


def nested_classes(valid: DataFrame) -> DataFrame:
    elements = valid.where("not is_text and path <> ''")
    classes = valid.where("path <> '' or is_text").groupBy("host", "pages", "class").agg(
        F.max("support").alias("support"), F.bool_and((F.col("total") == F.col("support")) & (F.col("support") == F.col("pages"))).alias("once"),
        F.array_sort(F.collect_list(F.when(~F.col("is_text"), F.col("path")))).alias("paths"),
        F.array_sort(F.collect_list(F.when(F.col("is_text"), F.col("token")))).alias("texts"),
    )
    outer = F.array_min(F.transform("paths", lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    above = classes.withColumn("around", F.regexp_replace(outer, ">[^>]*$", ""))
    owner = elements.select(F.col("host").alias("owner_host"), F.col("path").alias("owner_path"), F.col("class").alias("parent"))
    joined = above.join(owner, (F.col("host") == F.col("owner_host")) & (F.col("around") == F.col("owner_path")), "left")
    return joined.select("host", "pages", "class", "parent", "support", "once", "paths", "texts")


def _slotted(rows: DataFrame, skeleton: DataFrame) -> DataFrame:
    """``rows`` with ``slot``, the innermost element of their host's skeleton at or above their ``path``; the empty path is in every skeleton."""
    steps = F.split("path", ">")
    ways = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), ">"))
    paths = rows.select("host", "path").distinct()
    above = paths.select("host", "path", F.explode(ways).alias("up")).join(skeleton.select("host", F.col("path").alias("up")), ["host", "up"])
    slots = above.groupBy("host", "path").agg(F.max_by("up", F.length("up")).alias("slot"))
    return rows.join(slots, ["host", "path"])


def article_slots(slots: list[tuple[str, int, int, int]]) -> list[str]:
    """Of ``(slot, own, declared, parts)``, sums over all pages of a host, the slots that are the article's.

    Where articles are declared, the slots that mostly lie in them. Else the slot with most own text, those in its container,
    and those elsewhere with paragraphs or half as much text: an article may stand in several containers.
    """
    there = [s for s in slots if s[1] > 0]
    if not there:
        return []
    declared = [s for s, own, inside, _ in there if 2 * inside > own]
    total = sum(x[1] for x in there)
    mixed = [s for s, own, inside, _ in there if 0 < 2 * inside <= own]
    if declared or mixed and 2 * sum(x[2] for x in there) > total:
        return declared + mixed
    best, most, _, in_parts = max(there, key=lambda x: (x[1], x[0]))
    if 2 * in_parts < most:  # loose text: blocks of one article may each be a container
        above, tag = best.rpartition(">")[0], _tag(best)
        beside = sum(own for s, own, _, parts in there if s != best and s.rpartition(">")[0] == above and _tag(s) == tag and 2 * parts < own)
        if 2 * beside >= most:
            best = above
    while best and _tag(best) in PARTS:
        best = best.rpartition(">")[0]
    return [s for s, own, _, parts in there if s == best or s.startswith(f"{best}>") or 2 * parts >= own or 2 * own >= most]


def _tag(path: str) -> str:
    return re.split(r"[.\[]", path.rpartition(">")[2], maxsplit=1)[0]


def host_templates(pages: DataFrame, url_col: str, html_col: str, least_share: float = 0.5, least_pages: int = 3, skeleton_share: float = 0.8) -> DataFrame:
    """``(host, skeleton, kept, texts)``: tokens of the skeleton, of the article's slots, and of the template's own texts.

    ``skeleton``: elements once a page on ``skeleton_share`` of the host's pages or more. A text on ``least_share`` of them, and on ``least_pages``, is the
    template's own if its slot has no other text, or if its class is less than a third of the slot's text; in a
    declared article it must be on ``skeleton_share`` of five pages or more.
    """
    tokens, hosts = host_tokens(pages, url_col, html_col)
    valid = valid_tokens(tokens, hosts, least_share, least_pages)
    skeleton = valid.where((~F.col("is_text")) & ((F.col("path") == "") | (F.col("total") == F.col("support")) & (F.col("support") >= skeleton_share * F.col("pages"))))
    skeleton = stored(skeleton.select("host", "path", "token"), "skeleton")
    of_paths = stored(_slotted(tokens.where("not is_text and chars > 0").select("host", "path", *SUMS), skeleton), "slotted")
    per_slot = of_paths.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in SUMS])

    same = _slotted(valid.where("is_text").select("host", "path", "class", "token", "support", "pages", *SUMS), skeleton)
    whole = same.groupBy("host", "slot").agg(F.sum("chars").alias("recurring"))
    by_class = same.groupBy("host", "slot", "class").agg(F.sum("chars").alias("class_chars"))
    told = same.join(by_class, ["host", "slot", "class"]).join(whole, ["host", "slot"]).join(per_slot.select("host", "slot", F.col("chars").alias("slot_chars")), ["host", "slot"])
    constant = F.col("recurring") >= F.col("slot_chars")
    small = 3 * F.col("class_chars") / F.col("support") < F.col("slot_chars") / F.col("pages")
    wide = (F.col("support") >= skeleton_share * F.col("pages")) & (F.col("pages") >= 5)
    told = told.where(F.col("support") >= least_pages)
    texts = stored(told.where(F.when(F.col("declared") > 0, small & wide).otherwise(constant | small)).select("host", "slot", "token", *SUMS), "texts")

    left = per_slot.unionByName(texts.select("host", "slot", *[(-F.col(c)).alias(c) for c in SUMS])).groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in SUMS])
    listed = left.groupBy("host").agg(F.collect_list(F.struct("slot", "own", "declared", "parts")).alias("slots"))  # not more than a page has elements

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[_key(s) for s in article_slots([tuple(x.values()) for x in own])] for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int64()))], ["host", "kept"])

    kept = listed.mapInArrow(choose, "host string, kept array<bigint>")
    once = skeleton.groupBy("host").agg(F.collect_list("token").alias("skeleton"))
    own = texts.groupBy("host").agg(F.collect_list("token").alias("texts"))
    return stored(once.join(kept, "host", "left").join(own, "host", "left").select("host", "skeleton", "kept", "texts"), "templates")


def main_text(page: str, skeleton: set[int], own_text: set[int], kept: set[int] = frozenset(), known: dict | None = None) -> str:
    """The article of one page, given its host's skeleton elements, the template's text tokens and the article's slots.

    A page without text in these slots is looked at by itself, in the same way; so is one without any text of its own.
    """
    _, blocks = parse(page, known)
    there = [b for b in blocks if not b.apart]
    there = [b for b in there if block_key(b) not in own_text] or there
    at: dict[str, str] = {}

    def slot(path: str) -> str:
        if path not in at:
            up = path
            while up and _key(up) not in skeleton:
                up = up.rpartition(">")[0]
            at[path] = up
        return at[path]

    chosen = {s for s in map(slot, {b.container for b in there}) if _key(s) in kept}
    if not any(slot(b.container) in chosen for b in there):
        sums: dict[str, list[int]] = {}
        for path, (_, *rest) in _sums(there).items():
            sums[slot(path)] = [a + b for a, b in zip(sums.get(slot(path), (0, 0, 0)), rest)]
        chosen = set(article_slots([(s, *x) for s, x in sums.items()]))
    take = [slot(b.container) in chosen for b in there]
    if any(t and b.article for t, b in zip(take, there)):  # a slot may be wider than the article in it
        return "\n\n".join(b.text for t, b in zip(take, there) if t and b.article)
    first = take.index(True) if any(take) else 0
    return "\n\n".join(b.text for i, b in enumerate(there) if take[i] or i < first and _tag(b.path) == "h1")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text)`` of each row: the main text, blocks joined by an empty line.

    Character references are decoded, white space inside a block is one space. Null and empty pages, and
    pages without an article, have empty text. Rows are never dropped, repeated rows give repeated
    results; pages without a host share one template. Other columns are ignored; an empty table gives none.
    """
    templates = host_templates(pages, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        sets: dict = {}
        for batch in batches:
            out = []
            for host, raw, *template in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = [set(x or ()) for x in template]
                skeleton, kept, texts = sets[host]
                out.append(main_text(raw or "", skeleton, texts, kept, known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], [id_col, url_col, "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    joined = rows.join(templates, "host", "left").select("id", "url", "host", "html", "skeleton", "kept", "texts")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string")


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
