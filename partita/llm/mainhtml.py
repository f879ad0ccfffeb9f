"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: openings of structural elements, told apart by their path of names, classes and ids (digits aside),
and blocks of text.  Over the pages of a host, tokens with the same occurrence vector (how often on each page) form an
equivalence class.  A class of elements on enough pages is valid if its elements come in one order on all its pages and always in one
gap between the elements of the page's root class, in which it is nested; text of the same vector as a valid class is part
of the template.  The template's elements cut every page of the host into slots: what lies in an element after
the last template element opened in it.  Evidence over all pages of the host then says which slots hold the article: how much
text they hold, how much of it stands in links, how much it varies from page to page, and element names as one mark among
others.  The article is the element that most of the evidence descends to; its slots are extracted whole.

Occurrence vectors are compared as sums of page hashes and slots are summed up, which are map-side aggregates: no task ever holds
the pages of a host.  Pages with the same article text, and repeated rows, count as one page: copies of an article do
not make it template.  Hosts with too few pages for a template, and pages without the host's article element, are judged by element
names and furniture words alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

#: An element of the template stands on at least this many pages of its host, and on this share of them; alone in its class, once on a page of half of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.1
ALONE_SHARE = 0.5
#: The article's element holds this share of what its parent holds; marks of names count so many times; a menu has this share of its text in links.
DESCEND = 0.5
MARKED = 4.0
MENU = 0.8
#: An element with a mark of furniture is furniture up to this share of the article; a slot whose pages have so few different texts is, too.
SMALL = 0.25
CONSTANT = 0.1

#: Element names of the HTML standard by their use here, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form button fieldset menu dialog object audio video canvas map head".split())
HEADS = frozenset("header".split())
ARTICLES = frozenset("article main".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay menu nav navbar navigation topnav breadcrumb breadcrumbs sidebar aside widget widgets footer comment comments "
    "disqus replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search "
    "pagination pager toolbar".split()
)
HEAD_WORDS = frozenset("header masthead".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split()
)
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's name and attributes say of it.
PLAIN, ARTICLE, HEADING, FURNISHED, BODY, TEXT = range(6)

_PARTS = re.compile(
    r"""<!--(?:.*?--!?>|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I | re.S)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


class Part(NamedTuple):
    """A token of a page: the opening of an element, or a block of text."""

    token: int
    up: int  # the place of the enclosing element among the page's parts; -1 if there is none
    mark: int
    text: str  # empty for elements
    links: int  # how many of the text's characters stand in links, white space aside as it is
    wanted: bool  # by names alone, not in page furniture
    inside: bool  # in an article or the main element


class _Open(NamedTuple):
    name: str
    at: int
    token: int
    wanted: bool
    inside: bool


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(key.lower(), "".join(values).lower()) for key, *values in _ATTRIBUTE.findall(text)] if text and not text.isspace() else []


def _is_furniture(name: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    """By its name, role or hidden state, or by a class or id all of whose words name furniture.

    The words of headings, and of sections inside an article, are taken for the subject.
    """
    if name in FURNITURE or (name in HEADS and not inside):
        return True
    if name in ("html", "body") or (name in ARTICLES and not (inside and name == "article")):
        return False
    for key, value in attributes:
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.strip() in ROLES):
            return True
        if key in ("class", "id") and name not in HEADINGS and not (inside and name == "section"):
            for token in value.split():
                words = set(_WORD.findall(token))
                if words and words <= (WORDS if inside else WORDS | HEAD_WORDS):
                    return True
    return False


def _number(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _under(token: int, what: bytes) -> int:
    return _number(token.to_bytes(8, "little", signed=True) + what)


def parse(page: str | None) -> list[Part]:
    """The openings of structural elements and the blocks of text, in page order.

    An element is known by the number of its path, so nested elements cost a number each, however deep.
    """
    stack, parts, text = [_Open("", -1, 0, True, False)], [], []
    depth: Counter = Counter()  # how many elements of a name are open
    raw, linked, linked_chars = None, 0, 0

    def flush() -> None:
        nonlocal linked_chars
        if text:
            words = html.unescape("".join(text)).split()
            text.clear()
            if words:
                top, block = stack[-1], " ".join(words)
                parts.append(Part(_under(top.token, b"\0" + block.encode("utf-8", "replace")), top.at, TEXT, block, min(linked_chars, len(block)), top.wanted, top.inside))
        linked_chars = 0

    def pop_to(names: tuple, stops: frozenset = frozenset()) -> None:
        if not any(depth[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                flush()
                for o in stack[k:]:
                    depth[o.name] -= 1
                del stack[k:]
                return
            if stack[k].name in stops:
                return

    for m in _PARTS.finditer(page or ""):
        name = m[2] or m[5]
        if raw is not None:
            if name and (m[1] or m[4]) and name.lower() == raw:
                raw = None
            elif not name or raw in ("script", "style", "textarea", "title", "xmp"):
                # a raw element ends at its own end tag only, which may hide in what looks like a tag or text
                end = re.search(rf"</{raw}[\s/>]", m[0], re.I)
                raw = None if end else raw
            continue
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
                linked_chars += len(m[0]) if linked else 0
            elif m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:-3]))
            continue
        name, closing = name.lower(), m[1] or m[4]
        source = m[3] or m[6] or ""
        attributes = [] if closing else _attributes(source)
        if name == "a":
            linked = 0 if closing else 1
        if name in INLINE and not (not closing and attributes and _is_furniture(name, attributes, stack[-1].inside)):
            if not (closing and depth[name]):
                continue
        if name in RAW:
            if not closing and not source.rstrip().endswith("/"):
                raw = name
            text.append(" ") if name not in INLINE else None
            continue
        if closing:
            flush() if name in CLOSES_P or name in ITEMS else None
            pop_to((name,))
            continue
        if name in VOID:
            text.append(" ") if name in ("br", "hr") else None
            if name == "hr":
                flush()
            continue
        flush()
        if name in CLOSES_P:
            pop_to(("p",), frozenset(("article", "main", "section", "div", "td", "body", "li")))
        if name in ITEMS:
            pop_to(ITEMS[name], SCOPES)
        up = stack[-1]
        furniture = _is_furniture(name, attributes, up.inside)
        mark = FURNISHED if furniture else ARTICLE if name in ARTICLES else HEADING if name in HEADINGS else BODY if name in ("html", "body") else PLAIN
        kind = " ".join(sorted(k + "=" + _DIGITS.sub("", v) for k, v in attributes if k in ("class", "id"))) if attributes else ""
        token = _under(up.token, f"{name} {mark} {kind}".encode("utf-8", "replace"))
        wanted = up.wanted and not furniture
        stack.append(_Open(name, len(parts), token, wanted, up.inside or (wanted and name in ARTICLES)))
        depth[name] += 1
        parts.append(Part(token, up.at, mark, "", 0, wanted, up.inside))
    flush()
    return parts


def _by_names(parts: list[Part]) -> list[Part]:
    """The blocks that are not in page furniture; of those, the ones in an article or the main element if there are any."""
    wanted = [b for b in parts if b.mark == TEXT and b.wanted]
    return [b for b in wanted if b.inside] or wanted


class Template(NamedTuple):
    """A host's template: its elements, its texts, the element that holds the article (0: the page), what of it is extracted, and slots that are not."""

    elements: frozenset
    texts: frozenset
    article: int
    good: frozenset
    bad_slots: frozenset


def slot_of(owner: int, last: int) -> int:
    """The number of the slot of an element after the last template element opened in it."""
    return _under(owner, last.to_bytes(8, "little", signed=True))


def slots(parts: list[tuple], elements) -> list[tuple[int, int, bool]]:
    """For every part that is a text: (place, slot, template element around it, whether furniture lies between).

    ``parts``: (token, up, mark) of a page.
    """
    own: list[int] = []  # the place of the nearest template element, -1 for the page itself
    between: list[bool] = []
    last: dict[int, int] = {}
    out = []
    for k, (token, up, mark) in enumerate(parts):
        around, shut = (own[up], between[up]) if up >= 0 else (-1, False)
        if mark == TEXT:
            owner = parts[around][0] if around >= 0 else 0
            out.append((k, slot_of(owner, last.get(around, 0)), owner, shut))
            own.append(around)
            between.append(shut)
        elif token in elements:
            last[around] = token
            own.append(k)
            between.append(False)
        else:
            own.append(around)
            between.append(shut or mark == FURNISHED)
    return out


def _extracted(parts: list[Part], template: Template | None) -> list[Part]:
    if template is None or (template.article and not any(p.token == template.article for p in parts if p.mark != TEXT)):
        return _by_names(parts)
    found = slots([p[:3] for p in parts], template.elements)
    return [parts[k] for k, slot, owner, shut in found if not shut and owner in template.good and slot not in template.bad_slots and parts[k].token not in template.texts]


def extract(page: str | None, template: Template | None = None) -> str:
    """The page's main text, given its host's template; without one, by names alone."""
    return " ".join(b.text for b in _extracted(parse(page), template))


PAGE = "host string, page long, row long, content long, token array<long>, up array<int>, mark array<tinyint>, chars array<int>, links array<int>, often array<int>"


def _parsed(pages: DataFrame) -> DataFrame:
    """One row per page with its tokens; ``often`` counts a token at its first place and is 0 at later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *(pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int8(), pa.int32(), pa.int32(), pa.int32()))]
        names = [c.split()[0] for c in PAGE.split(", ")]
        for b in batches:
            rows = []
            for t in b.column(3):
                parts = parse(t.as_py())
                content = _number("\0".join(p.text for p in _by_names(parts)).encode("utf-8", "replace"))
                counts, often = Counter(p.token for p in parts), []
                for p in parts:
                    often.append(counts.pop(p.token, 0))
                rows.append((content, [p.token for p in parts], [p.up for p in parts], [p.mark for p in parts], [len(p.text) for p in parts], [p.links for p in parts], often))
            if rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return pages.select("host", "page", F.monotonically_increasing_id().alias("row"), "html").mapInArrow(run, PAGE)


def classes(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, class, pages, vector, members): the equivalence classes of elements on enough pages, members (token) by their mean place.

    ``pages`` as ``_parsed`` gives them, one row per page of a host that counts.
    """
    of = pages.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    every = pages.select("host", "page", F.posexplode(F.arrays_zip("token", "mark", "often")).alias("place", "t"))
    every = every.where((F.col("t.mark") != TEXT) & (F.col("t.often") > 0))
    seen = every.groupBy("host", F.col("t.token").alias("token")).agg(_vector("t.often"), F.count(F.lit(1)).alias("pages"), F.avg("place").alias("place"), F.max("t.often").alias("most"))
    seen = seen.where(F.col("pages") >= least_pages).join(of, "host").where(F.col("pages") >= least_share * F.col("of"))
    # a token stands on a share of the host's pages, so a host has a bounded number of times an average page's elements here
    made = seen.groupBy("host", "vector").agg(F.max("pages").alias("pages"), F.max("of").alias("of"), F.max("most").alias("most"), F.array_sort(F.collect_list(F.struct("place", "token"))).alias("members"))
    large = (F.size("members") > 1) | ((F.col("most") == 1) & (F.col("pages") >= ALONE_SHARE * F.col("of")))
    return made.where(large).select("host", F.xxhash64("host", "vector").alias("class"), "pages", "vector", F.col("members.token").alias("members"))


def _vector(often: str) -> F.Column:
    return F.sum(F.xxhash64("page", often).cast("decimal(38,0)")).alias("vector")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and class: whether its elements are out of order or in several gaps of the page's root class, and the gap."""
    for b in batches:
        out = []
        for host, tokens, often, made in zip(b["host"].to_pylist(), b["token"].to_pylist(), b["often"].to_pylist(), b["classes"].to_pylist(), strict=True):
            place = {t: k for k, (t, n) in enumerate(zip(tokens, often, strict=True)) if n}
            here = [(c, at) for c in made if (at := [place[t] for t in c["members"] if t in place])]
            root = max(here, key=lambda c: (c[0]["pages"], len(c[0]["members"]), c[0]["class"]))[1] if here else []
            for c, at in here:
                ends = [sum(r < p for r in root) for p in (min(at), max(at))]
                wrong = at != sorted(at) or (at is not root and ends[0] != ends[1])
                out.append((host, c["class"], int(wrong), -1 if at is root else ends[0]))
        if out:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["host", "class", "wrong", "gap"])


def valid_classes(pages: DataFrame, made: DataFrame) -> DataFrame:
    """The classes that come in one order, and in one gap of the root class, on all their pages."""
    by_host = made.groupBy("host").agg(F.collect_list(F.struct("class", "pages", "members")).alias("classes"))
    checked = pages.select("host", "token", "often").join(by_host, "host").mapInArrow(_checked, "host string, class long, wrong int, gap int")
    valid = checked.groupBy("host", "class").agg(F.sum("wrong").alias("wrong"), F.min("gap").alias("lo"), F.max("gap").alias("hi"))
    return made.join(valid.where("wrong = 0 and lo = hi").select("host", "class"), ["host", "class"], "left_semi")


SLOT = "host string, slot long, owner long, up long, mark tinyint, text long, chars long, links long"


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every page holds in the slots of its template elements; each element's first slot comes too, if empty."""
    for b in batches:
        out = []
        for host, elements, *page in zip(*(b[c].to_pylist() for c in ("host", "elements", "token", "up", "mark", "chars", "links")), strict=True):
            known, parts = set(elements), list(zip(*page[:3], strict=True))
            up_of, marks, held = {0: 0}, {0: PLAIN}, {}
            around: list[int] = []  # the nearest template element's token
            for token, up, mark in parts:
                here = around[up] if up >= 0 else 0
                if mark != TEXT and token in known:
                    up_of[token], marks[token] = here, mark
                    held[slot_of(token, 0)] = [token, [], 0, 0]
                    here = token
                around.append(here)
            for k, slot, owner, shut in slots(parts, known):
                if not shut:
                    s = held.setdefault(slot, [owner, [], 0, 0])
                    s[1].append(parts[k][0])
                    s[2] += page[3][k]
                    s[3] += page[4][k]
            for slot, (owner, texts, chars, links) in held.items():
                out.append((host, slot, owner, up_of[owner], marks[owner], _number(b"".join(t.to_bytes(8, "little", signed=True) for t in texts)), chars, links))
        if out:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in SLOT.split(", ")])


def choose(found: list[dict]) -> tuple[int, list[int], list[int]] | None:
    """The element that holds the article, the elements extracted in it, and their slots that are not; None without evidence.

    ``found``: the host's slots as (slot, owner, up, mark, chars, links, pages, texts), summed over its pages; ``pages`` have text in the slot,
    and ``texts`` are different.
    """
    up, mark, down = {}, {0: PLAIN}, {}
    for s in found:
        up[s["owner"]], mark[s["owner"]] = s["up"], s["mark"]
    up.pop(0, None)
    for e, parent in up.items():
        down.setdefault(parent, []).append(e)
    order, k = [0], 0
    while k < len(order):
        order += sorted(down.get(order[k], []))
        k += 1

    def varies(s: dict) -> float:
        return 1.0 if s["pages"] < LEAST_PAGES else (s["texts"] - 1) / (s["pages"] - 1)

    weight, chars, links, heads = (dict.fromkeys(order, 0.0) for _ in range(4))
    for s in found:
        factor = {ARTICLE: MARKED, FURNISHED: 1 / MARKED}.get(s["mark"], 1.0)
        weight[s["owner"]] += factor * varies(s) * max(0, s["chars"] - 2 * s["links"])
        chars[s["owner"]] += s["chars"]
        links[s["owner"]] += s["links"]
    for e in reversed(order):
        heads[e] += mark[e] == HEADING
        if e:
            for sums in (weight, chars, links, heads):
                sums[up[e]] += sums[e]
    if not weight[0]:
        return None
    here, path = 0, [0]
    while mark[here] != ARTICLE and down.get(here):
        # a mark of the name counts for the whole element
        gain = {e: weight[e] * {ARTICLE: MARKED, FURNISHED: 1 / MARKED}.get(mark[e], 1.0) for e in down[here]}
        best = max(sorted(gain), key=gain.__getitem__)
        rest = weight[here] - sum(weight[e] for e in down[here]) + sum(gain.values())
        if gain[best] < DESCEND * rest or mark[best] == HEADING:
            break
        here = best
        path.append(here)
    if mark[here] != ARTICLE:  # a title beside the text belongs to it
        while here and not heads[here] and heads[up[here]] and mark[up[here]] != BODY:
            here = up[here]
    good, todo = [], [here]
    while todo:
        e = todo.pop()
        if e != here and mark[e] != HEADING:
            menu = chars[e] > 0 and links[e] >= MENU * chars[e]
            if menu or (mark[e] == FURNISHED and weight[e] * MARKED <= SMALL * weight[here]):
                continue
        good.append(e)
        todo += down.get(e, [])
    kept = set(good)
    bad = [s["slot"] for s in found if s["owner"] in kept and mark[s["owner"]] in (PLAIN, BODY) and mark[here] != ARTICLE and s["chars"] and (s["links"] >= MENU * s["chars"] or varies(s) < CONSTANT)]
    return here, good, bad


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(host, *got) for host, found in zip(b["host"].to_pylist(), b["found"].to_pylist(), strict=True) if (got := choose(found))]
        if out:
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), longs, longs), strict=True)], ["host", "article", "good", "bad_slots"])


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, elements, texts, article, good, bad_slots): the template of each host that has one; see ``Template``.

    ``pages``: (host string, page long, html string); ``page`` tells the pages of a host apart.  Of the pages of a host that
    have the same text in their articles, and of repeated rows, one counts.
    """
    every = scratch.write(_parsed(pages.where("host <> ''")), "every")
    one = every.groupBy("host", "content").agg(F.min(F.struct("page", "row")).alias("one")).select("one.row")
    once = scratch.write(every.join(scratch.write(one, "one"), "row", "left_semi").drop("content", "row"), "pages")
    scratch.drop("every", "one")
    valid = scratch.write(valid_classes(once, scratch.write(classes(once), "classes")), "valid")
    texts = once.select("host", "page", F.explode(F.arrays_zip("token", "mark", "often")).alias("t")).where((F.col("t.mark") == TEXT) & (F.col("t.often") > 0))
    texts = texts.groupBy("host", F.col("t.token").alias("token")).agg(_vector("t.often"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES)
    texts = texts.join(valid.select("host", "vector"), ["host", "vector"], "left_semi").groupBy("host").agg(F.collect_list("token").alias("texts"))
    elements = valid.select("host", F.explode("members").alias("token")).groupBy("host").agg(F.collect_list("token").alias("elements"))
    elements = scratch.write(elements, "elements")
    held = once.select("host", "token", "up", "mark", "chars", "links").join(elements, "host").mapInArrow(_slots, SLOT)
    # pages that hold the same in a slot are summed up first, so that different texts can be counted
    same = held.groupBy("host", "slot", "owner", "up", "mark", "text").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum((F.col("chars") > 0).cast("long")).alias("pages"))
    summed = same.groupBy("host", "slot", "owner", "up", "mark").agg(
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("pages").alias("pages"), F.sum((F.col("pages") > 0).cast("long")).alias("texts")
    )
    found = summed.groupBy("host").agg(F.collect_list(F.struct("slot", "owner", "up", "mark", "chars", "links", "pages", "texts")).alias("found"))
    chosen = found.mapInArrow(_chosen, "host string, article long, good array<long>, bad_slots array<long>")
    return elements.join(chosen, "host").join(texts, "host", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of ``pages``.

    A null html is an empty page; a page without main text gives an empty string.  Pages without a host in their url
    are judged alone, by names; so are those of hosts with fewer than ``LEAST_PAGES`` pages.  Repeated rows are pages of their
    own result each, but count as one page of the host, as pages with the same article text do; null ids are kept.  Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    made = scratch.write(templates(rows.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html"), scratch), "templates")
    scratch.drop("pages", "classes", "valid", "elements")
    joined = rows.join(made, "host", "left").select("page_id", "url", "html", "host", "elements", "texts", "article", "good", "bad_slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template | None] = {}
        for b in batches:
            texts = []
            for k, (page, name) in enumerate(zip(b["html"], b["host"].to_pylist(), strict=True)):
                if name not in known:
                    if len(known) > 256:  # pages may come in any order of hosts
                        known.clear()
                    article = b["article"][k].as_py()
                    sets = [frozenset(b[c][k].as_py() or ()) for c in ("elements", "texts", "good", "bad_slots")]
                    known[name] = None if article is None else Template(sets[0], sets[1], article, sets[2], sets[3])
                texts.append(extract(page.as_py(), known[name]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op7_main_text": op7_main_text}
ORACLES: dict[str, str] = {}
