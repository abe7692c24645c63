"""HTML extraction by templates that are deduced from equivalence classes of tokens.

The pages of a host are token streams: an element is the token of its path (tags with
their classes, from the root), a text block the token of its path and text. How often a
token stands on each page is its occurrence vector; tokens of a host with equal vectors
are an equivalence class (vectors are compared by sums over pages of hashes of page and
count, so no vector is ever collected).

A class counts if it is frequent: on MIN_PAGES pages at least, its elements on BRANCH of the
pages that have the parent element (so types of pages have templates of their own), its
texts on SUPPORT of those that have their element (within an article element on INSIDE of
INSIDE_PAGES or more: passages that articles share aren't template); if its texts are the
smaller part of its pages' text (copies of a page are no template); if its tokens stand in
one order on all its pages; and if it nests: between two tokens of any class that stands
once on a page lies all of it or nothing. The classes that are left are the host's
template; what lies between their tokens are the slots.

From a page the template's texts go, wherever they stand. The main slot is the article (or
main) element if there is one, else the smallest template element that holds most of the
text left in the slots; articles beside it in the same element belong to it. From it go the
elements that HTML, or a class or their id as a whole, name as menus, asides, forms,
adverts and so on; such names never take a page's only article away.

Cases: null counts as empty html, which gives the empty text; a host that is unknown
(null url) is a host of its own; a host with few pages has no template and is judged by
its page alone; broken markup is closed as browsers do, and a tag that never ends is text
with all that follows (one pass over any markup); rows that repeat count as pages of
their own and get equal texts, whatever their page_id is (a page that repeats often has
the larger part of its text in one class, and keeps it); html of any length is parsed
whole, one page at a time; an empty table gives no rows; columns other than page_id, url
and html are not read, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, as_bytes, by_bytes, map_arrow, ship, written
from .link_trust import host_and_path

SUPPORT, MIN_PAGES, BRANCH = 0.5, 3, 0.1
INSIDE, INSIDE_PAGES = 0.8, 8
SHARED = 0.5  # of its pages' text, for the texts of a class
#: Tokens of all templates that may be broadcast (17 bytes each); else pages are joined to them.
SMALL = 2_000_000
MOST = 0.6  # of a page's slot text, for the main slot of a page without article

# Fixed values of HTML: how elements nest, and names that sites give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|xmp|noembed|noframes|svg|math|object|canvas|select|option|datalist"
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"html", "head", "body", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article main section div td th".split())
NOISE_TAGS = frozenset("nav aside form footer button dialog menu head label input fieldset audio video".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login sidebar sidenav side menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer masthead comment comments commentlist respond reply replies disqus share sharing social related recommended popup modal overlay widget toc skip hidden".split())
#: Parts of a name that say where something stands, or that it has or lacks something.
PLACE_WORDS = frozenset("area bar block body box container content group inner item items left links list main outer right row section slot unit wrap wrapper zone".split())
STATE_WORDS = frozenset("has hide is no non not show with without".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar toolbar".split())
OPENED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW.split("|")}
#: One attribute: its name, and its value in quotes or without. A quote that nothing closes
#: is a sign of a name, so that no scan for its end is made twice.
ATTR = re.compile(r"[\s/]*+([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
PARTS = re.compile(r"[-_]+")
GAP = re.compile(r"[\s/=]*+")


def markup(html: str):
    """(begin, end, what): what is None for a comment and the like, the text of a CDATA
    section, or (closes, tag, attributes). Elements whose content isn't text are one piece with
    it. A tag that finds no end is text, and so is all that follows it: one pass, whatever
    the markup."""
    at, last = 0, html.rfind(">")
    while 0 <= (i := html.find("<", at)):
        if i < last and (m := OPENED.match(html, i)):
            k, found = m.end(), []
            if html[k] != ">":
                while a := ATTR.match(html, k):
                    k = GAP.match(html, a.end()).end()
                    found.append((a[1].lower(), a[2] or a[3] or a[4] or ""))
                k = GAP.match(html, k).end()
                if k >= len(html):
                    return
            tag, at = m[2].lower(), k + 1
            if tag in ENDS and not m[1]:
                end = ENDS[tag].search(html, at)
                stop = html.find(">", end.end()) if end else -1
                at = stop + 1 if stop >= 0 else len(html)
                yield i, at, None
            else:
                yield i, at, (m[1], tag, found)
        elif html.startswith("<!--", i):
            n = html.find("-->", i + 4)
            at = n + 3 if n >= 0 else len(html)
            yield i, at, None
        elif html.startswith("<![CDATA[", i):
            n = html.find("]]>", i + 9)
            at = n + 3 if n >= 0 else len(html)
            yield i, at, html[i + 9:n if n >= 0 else None]
        elif i > last:
            return
        elif html.startswith(("<!", "<?"), i):
            at = html.find(">", i) + 1
            yield i, at, None
        else:
            at = i + 1


class Page:
    """elements: (parent, tag, path hash, noise, article); blocks: (element, raw text)."""

    def __init__(self, html: str):
        self.elements: list[tuple] = [(-1, "", 0, False, False)]
        self.blocks: list[tuple[int, str]] = []
        stack, held, at = [0], [], 0
        named, owns = set(), [False]  # noise by name; by tag, role or being hidden
        aside = {}  # what was held when inline noise began

        def flush():
            if held:
                text = "".join(held)
                held.clear()
                if not text.isspace():
                    self.blocks.append((owner[-1], text))

        owner = [0]  # the open elements that begin blocks, or noise

        def close_tags(tags, stop) -> None:
            for n in range(len(stack) - 1, 0, -1):
                tag = self.elements[stack[n]][1]
                if tag in tags:
                    return close_all(n)
                if tag in stop:
                    return None

        def close_all(n: int) -> None:
            for e in reversed(stack[n:]):
                if owner[-1] == e:
                    flush()
                    owner.pop()
                    held.extend(aside.pop(e, ()))
            del stack[n:]

        for begin, end, what in markup(html):
            if begin > at:
                held.append(html[at:begin])
            at = end
            if what is None:
                continue
            if isinstance(what, str):
                held.append(what)
                continue
            closes, tag, attributes = what
            if closes:
                for n in range(len(stack) - 1, 0, -1):
                    if self.elements[stack[n]][1] == tag:
                        close_all(n)
                        break
                    if tag not in BLOCK and self.elements[stack[n]][1] in BLOCK:
                        break  # an inline element's end doesn't close a block
                continue
            if tag == "br":
                held.append("\n")
                continue
            block = tag in BLOCK
            if block:
                flush()
                if tag in ENDS_P:
                    close_tags(("p",), SCOPE - {"p"})
                if tag in SAME:
                    close_tags(SAME[tag], SCOPE - set(SAME[tag]))
            if tag in VOID:
                continue
            parent = stack[-1]
            _, _, path, noise, article = self.elements[parent]
            own, classes = tag in NOISE_TAGS, ""
            is_article = tag == "article" or tag == "main"
            names: list[str] = []
            for name, value in attributes:
                if name == "class" or name == "id":
                    value = unescape(value).lower()
                    classes += "." + value
                    names += value.split()
                elif name == "role":
                    own |= value.lower() in NOISE_ROLES
                    is_article |= value.lower() in ("main", "article")
                elif name == "itemprop":
                    is_article |= value.lower() == "articlebody"
                elif name == "hidden" or name == "aria-hidden":
                    own |= name == "hidden" or value.lower() == "true"
            if tag == "header" and not article:
                own = True
            by_name = not own and tag not in ("html", "body") and any(map(names_noise, names))
            owns.append(own)
            if by_name:
                named.add(len(self.elements))
                own = True
            noise = noise or own
            path = zlib.crc32(f"{tag}{classes}".encode(), path)
            self.elements.append((parent, tag, path, noise, is_article or article))
            e = len(self.elements) - 1
            stack.append(e)
            if block:
                flush()
            elif own:  # the text around it is one block
                aside[e] = held[:]
                held.clear()
            if block or own:
                owner.append(e)
        if at < len(html):
            held.append(html[at:])
        close_all(1)
        flush()
        if named:
            self._keep_article(named, owns)

    def _keep_article(self, named: set[int], own: list[bool]) -> None:
        """Names of classes don't take a page's only article away: where no article is left,
        those of the longest one and of what is around it don't count."""
        el, sizes = self.elements, Counter()
        for e, t in self.blocks:
            if el[e][4]:
                if not el[e][3]:
                    return
                while el[el[e][0]][4]:
                    e = el[e][0]
                sizes[e] += len(t)
        if not sizes:
            return
        top, over = max(sizes, key=lambda x: (sizes[x], -x)), set()
        e = top
        while e > 0:
            over.add(e)
            e = el[e][0]
        if not over & named:
            return
        for e in range(1, len(el)):
            parent, tag, path, _, article = el[e]
            el[e] = (parent, tag, path, el[parent][3] or own[e] or e in named and e not in over, article)

    def is_top_article(self, e: int) -> bool:
        parent, _, _, noise, article = self.elements[e]
        return article and not noise and not self.elements[parent][4]


@functools.lru_cache(100_000)
def names_noise(name: str) -> bool:
    """Whether a class or id as a whole, or what its parts come down to at the end, is a word for
    noise: reader-comments and ad-slot, not has-comments, side-effects or overflow-hidden."""
    if name in NOISE_WORDS:
        return True
    parts = PARTS.split(name)
    while len(parts) > 1 and parts[-1] in PLACE_WORDS:
        parts.pop()
    return parts[0] not in STATE_WORDS and parts[-1] in NOISE_WORDS and parts[-1] != "hidden"


def clean(text: str) -> str:
    return " ".join(unescape(text).split())


def block_token(path: int, text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"), path) | 1 << 32


class Template:
    """tokens of a host's classes, sorted; of each its class and whether it stands once on a page."""

    def __init__(self, tokens=(), classes=(), once=()):
        order = np.argsort(np.asarray(tokens, np.int64), kind="stable")
        self.of = dict(zip(np.asarray(tokens, np.int64)[order].tolist(), np.asarray(classes, np.int64)[order].tolist()))
        self.once = {c for c, o in zip(classes, once) if o} - {c for c, o in zip(classes, once) if not o}

    def __contains__(self, token: int) -> bool:
        return token in self.of


def tokens_of(page: Page) -> list[tuple[int, int, int, bool]]:
    """The page's tokens in their order: token, the token it needs (its parent's path, or a
    text's element), length of text, and whether it is a text within an article."""
    el, out, at = page.elements, [], 1
    for e, raw in page.blocks:
        while at <= e:
            out.append((el[at][2], el[el[at][0]][2], 0, False))
            at += 1
        t = clean(raw)
        if t:
            out.append((block_token(el[e][2], t), el[e][2], len(t), el[e][4]))
    out += [(el[k][2], el[el[k][0]][2], 0, False) for k in range(at, len(el))]
    return out


def _mix(page: int, n: int) -> int:
    return zlib.crc32(b"%d %d" % (page, n)) << 31 ^ zlib.crc32(b"%d.%d" % (n, page))


OCCURRENCES = "host string, token bigint, needs bigint, pages bigint, most int, chars bigint, inside boolean, page_chars bigint, high bigint, low bigint"


def _occurrences(batches):
    """For each token of a few hundred pages: on how many it stands and how often at most, the
    length of its text and of its pages' text, and the sums of its vector."""
    for b in by_bytes(batches, "html", 4 << 20):
        found: dict = {}
        for host, html in zip(b.column("host").to_pylist(), as_bytes(b.column("html"))):
            tokens = tokens_of(Page(html.decode("utf-8", "replace")))
            page, total = zlib.crc32(html) << 32 | zlib.crc32(html, 7), sum(t[2] for t in tokens)
            count = Counter(t[0] for t in tokens)
            for token, needs, chars, inside in {t[0]: t for t in tokens}.values():
                n = count[token]
                v = _mix(page, n)
                was = found.get((host, token))
                if was is None:
                    found[host, token] = [needs, 1, n, chars, inside, total, v >> 32, v & 0xFFFFFFFF]
                else:
                    was[1] += 1
                    was[2] = max(was[2], n)
                    was[5] += total
                    was[6] += v >> 32
                    was[7] += v & 0xFFFFFFFF
            root = found.setdefault((host, 0), [0, 0, 1, 0, False, 0, 0, 0])
            root[1] += 1
        cols = [*zip(*((*k, *v) for k, v in found.items()))] or [()] * 10
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in OCCURRENCES.split(", ")])


def candidates(pages: DataFrame) -> DataFrame:
    """host, class, token, once: the frequent classes, not yet tested on pages. Tokens of too
    few pages go before anything is gathered by host."""
    sums = [F.sum(c).alias(c) for c in ("pages", "page_chars", "high", "low")]
    rows = map_arrow(pages.select("host", "html"), _occurrences, OCCURRENCES)
    tokens = rows.groupBy("host", "token").agg(*sums, F.max("most").alias("most"), *(F.first(c).alias(c) for c in ("needs", "chars", "inside")))
    frequent = written(pages.sparkSession, tokens.where(F.col("pages") >= MIN_PAGES), "tokens")
    over = frequent.select("host", F.col("token").alias("needs"), F.col("pages").alias("_all"))
    share = F.col("pages") / F.col("_all")
    enough = F.when(F.col("chars") == 0, share >= BRANCH).when(F.col("inside"), (share >= INSIDE) & (F.col("pages") >= INSIDE_PAGES)).otherwise(share >= SUPPORT)
    common = frequent.where("token <> 0").join(over, ["host", "needs"]).where(enough)
    name = F.xxhash64("pages", "high", "low").alias("class")
    common = common.select("host", "token", "pages", "chars", "page_chars", (F.col("most") == 1).alias("once"), name)
    # Elements have no text of their own, so a class is judged by its texts.
    known = common.groupBy("host", "class").agg(F.sum("chars").alias("_own"), (F.first("page_chars") / F.first("pages")).alias("_page")).where(F.col("_own") <= SHARED * F.col("_page"))
    return common.join(known, ["host", "class"], "left_semi").select("host", "class", "token", "once")


def tested(page: Page, template: Template) -> list[tuple[int, int, bool]]:
    """Each class on this page: a hash of its tokens' order, and whether it nests."""
    first: dict = {}
    last: dict = {}
    order: dict = {}
    at: dict = {}
    for k, (token, *_) in enumerate(tokens_of(page)):
        c = template.of.get(token)
        if c is None:
            continue
        if token not in order:
            order[token] = c
        first.setdefault(c, k)
        last[c] = k
        if c in template.once:
            at.setdefault(c, []).append(k)
    hashes: dict = {}
    for token, c in order.items():
        hashes[c] = zlib.crc32(b"%d" % token, hashes.get(c, 0))
    frames = {a: np.array(places) for a, places in at.items()}
    out = []
    for c, h in hashes.items():
        # All of c lies in one slot of each frame, or around it: no token of c in between.
        nests = all(a == c or np.searchsorted(x, first[c]) == np.searchsorted(x, last[c]) or c in frames and np.searchsorted(frames[c], x[0]) == np.searchsorted(frames[c], x[-1]) for a, x in frames.items())
        out.append((c, h, nests))
    return out


def _with_templates(rows: DataFrame, found: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(batch, a template for each row) over rows(host, html, ...). found(host, class, token,
    once) is broadcast up to SMALL tokens; else each host's stand under SALTS salts."""
    if found.count() <= SMALL:
        by_host: dict = {}
        for r in found.groupBy("host").agg(*(F.collect_list(c).alias(c) for c in ("token", "class", "once"))).toLocalIterator():
            by_host[r["host"]] = (np.array(r["token"], np.int64), np.array(r["class"], np.int64), np.array(r["once"], bool))
        sent = rows.sparkSession.sparkContext.broadcast(by_host)

        def run(batches):
            known: dict = {}

            def get(h):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = Template(*(x.tolist() for x in sent.value.get(h, ())))
                return known[h]

            for b in by_bytes(batches, "html", 4 << 20):
                yield work(b, [get(h) for h in b.column("host").to_pylist()])

        return map_arrow(rows, run, schema)

    def run_joined(batches):
        for b in by_bytes(batches, "html", 4 << 20):
            yield work(b, [Template(t or (), c or (), o or ()) for t, c, o in zip(*(b.column(x).to_pylist() for x in ("_token", "_class", "_once")))])

    many = found.groupBy("host").agg(*(F.collect_list(c).alias(f"_{c}") for c in ("token", "class", "once"))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    return map_arrow(salted.join(many, ["host", "_salt"], "left").drop("_salt"), run_joined, schema)


def templates(pages: DataFrame) -> DataFrame:
    """host, class, token, once of the valid classes of each host."""
    spark = pages.sparkSession
    found = written(spark, candidates(pages), "classes")

    def work(b, known):
        seen: dict = {}
        for host, html, template in zip(b.column("host").to_pylist(), as_bytes(b.column("html")), known):
            if template.of:
                for c, h, nests in tested(Page(html.decode("utf-8", "replace")), template):
                    low, high, ok = seen.get((host, c), (h, h, True))
                    seen[host, c] = min(low, h), max(high, h), ok and nests
        cols = [*zip(*((*k, *v) for k, v in seen.items()))] or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["host", "class", "low", "high", "nests"])

    shown = _with_templates(pages.select("host", "html"), found, work, "host string, class bigint, low bigint, high bigint, nests boolean")
    valid = shown.groupBy("host", "class").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("nests").alias("nests")).where("low = high and nests").select("host", "class")
    return written(spark, found.join(valid, ["host", "class"], "left_semi").select("host", "class", "token", "once"), "templates")


def main_text(page: Page, template: Template) -> str:
    el = page.elements
    found = [(e, t) for e, raw in page.blocks if not el[e][3] and (t := clean(raw)) and block_token(el[e][2], t) not in template]
    mass: Counter = Counter()
    tops: Counter = Counter()
    for e, t in found:
        if el[e][4]:
            x = e
            while el[el[x][0]][4]:
                x = el[x][0]
            tops[x] += len(t)
    if tops:
        # The longest article, and those beside it in the same element.
        top = max(tops, key=lambda x: (tops[x], -x))
        beside = {x for x in tops if el[x][0] == el[top][0]}
    else:
        for e, t in found:
            while e >= 0:
                mass[e] += len(t)
                e = el[e][0]
        total = mass[0]
        inner = [x for x in mass if mass[x] >= MOST * total and (x == 0 or not template.of or el[x][2] in template)]
        top = max(inner, key=lambda x: (-mass[x], x), default=0) if not inner else min(inner, key=lambda x: (mass[x], -x))
        if el[top][1] in ("p", "h1", "h2", "h3", "li", "td"):
            top = max(el[top][0], 0)
        beside = {top}

    first = min(beside)

    def inside(e: int) -> bool:
        while e > first and e not in beside:
            e = el[e][0]
        return e in beside

    return "\n".join(t for e, t in found if inside(e))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    ship(pages.sparkSession)
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))

    def work(b, known):
        texts = [main_text(Page(x.decode("utf-8", "replace")), t) for x, t in zip(as_bytes(b.column("html")), known)]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return _with_templates(rows, templates(rows), work, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars bigint")
