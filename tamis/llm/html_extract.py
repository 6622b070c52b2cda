"""Main text of web pages by equivalence-class template deduction.

1. Every page is cut into tokens: its containers, told apart by their path of tags and classes, and its text
   blocks, told apart by path and text. A token's occurrence vector over the pages of a host is folded into two
   numbers, sums of hashes of (page, count), so hosts of any size aggregate partition by partition. A page is known
   by its html: repeated rows add the same to every token and change no equality.
2. Tokens of a host with equal vectors are one equivalence class; those on ``SUPPORT`` of the host's pages are valid.
   The class of the page itself is the backbone. Classes nest by position: a text whose class is that of a container
   around it, however far out, is there wherever that container is, so it is a fixed part of its template. The other
   texts fill the template's slots. That needs ``LEAST_PAGES`` different pages: fewer don't tell template from text.
   Nor does a host whose pages are copies, with over ``COPIES`` of the text of articles in fixed texts, or over
   ``PLAIN_COPIES`` of all text where they have no articles.
3. The slots to extract are the outermost valid ``article`` or ``main`` containers, or else the deepest container
   of the backbone with ``SHARE`` of the text. Pages are joined with their host's template (one row a host) and the
   blocks in its slots are extracted but for the fixed ones. Containers that are never article (menus, forms,
   scripts, comments, ...) are passed over by tag, or by a class, id or role that says only that, unless they hold
   most of the page's text and the page has no article. Headings and paragraphs are passed over by an advert's name only, and
   sections in an article not by their id. A page without the host's slots is read by itself in the same way.

Null html gives empty text; a null url or one without a host makes pages of one nameless host; a null page_id is
kept. Repeated rows get equal results. Unclosed and misnested tags are closed as browsers close paragraphs and
lists, elements nested deeper than ``MOST_DEPTH`` become siblings, and a tag that no > ends is text; a page of any length
is read whole, in time proportional to it. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.arrays import lean
from tamis.llm.common import settle, stored, table

SUPPORT = 0.5
SHARE = 0.8
COPIES = 0.5
PLAIN_COPIES = 0.9
LEAST_PAGES = 4

_RAW = "script|style|noscript|template|iframe|textarea|svg|title"
_REST = r"""<!--.*?(?:-->|\Z)|<(%s)\b%s>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)(%s)>|<[/!?]%s>|[^<]+|<"""
_QUOTED, _BARE = r"""(?:"[^"]*"|'[^']*'|[^'">])*+""", r"[^<>]*+"
#: The second is for what follows a tag that no > ends: there a tag ends at the next < or >, so nothing is looked through again and again.
_TOKEN, _AFTER_UNENDED = re.compile(_REST % (_RAW, _QUOTED, _QUOTED, "[^>]*+"), re.S | re.I), re.compile(_REST % (_RAW, _BARE, _BARE, _BARE), re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")

INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("head button select menu dialog object canvas audio video".split())
#: these go too, unless they are left open around, or wrap, most of a page that has no article
BESIDE = set("nav footer aside form header".split())
SECTIONS = set("body article main section div td".split())
NAMED = set("ad ads adv adbox adslot adsense advert adverts advertisement advertisements advertising banner commentlist sponsor sponsored promo promotion cookie cookies consent notice notices alert comment comments reply replies disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended subscribe newsletter popup modal widget toolbar pagination pager login signup search".split())
NAMED_ARTICLES = set("ad ads advert advertisement sponsored promo comment comments reply replies related".split())
#: names that go for paragraphs, too
NAMED_ADVERTS = set("ad ads adv adbox adslot advert adverts advertisement advertisements advertising sponsored".split())
#: words that say nothing beside a name of NAMED: comment-list, ad-slot
NEUTRAL = set("area bar big block body bottom box btn button buttons col column container icon icons inner item items large left link links list main outer page post reader right section site slot small thread top unit user users wide wrap wrapper x".split())
#: headings and paragraphs are dropped by no other name
TOLD = set("h1 h2 h3 h4 h5 h6 p blockquote pre figure figcaption".split())
#: a start tag closes an open element of these names, up to the boundaries
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"p": {"article", "main", "section", "div", "td", "li", "body", "blockquote"}, "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for a in _ATTRIBUTE.finditer(text):
        out.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
    return out


def _named(attributes: dict[str, str], kinds: tuple[str, ...], known: set[str]) -> bool:
    """Whether some class, id or role consists of known names, and not just has one among other words."""
    for kind in kinds:
        for token in attributes.get(kind, "").lower().split():
            words = set(_WORD.findall(token))
            if words & known and words <= known | NEUTRAL:
                return True
    return False


#: Elements that may be open at once; deeper ones become siblings, as in browsers.
MOST_DEPTH = 512
#: Characters of class names that a path shows; longer ones are named by a digest.
SHOWN_NAMES = 64


def tokens(html: str) -> Iterator[re.Match]:
    """Tags, comments, unshown elements and texts in order, each looked at once. A tag that no > ends is text."""
    at, rule = 0, _TOKEN
    while at < len(html):
        m = rule.match(html, at)
        at = m.end()
        if m[0] == "<" and (html[at : at + 1].isalpha() or html[at : at + 1] in ("/", "!", "?")):
            rule = _AFTER_UNENDED
        yield m


def _label(names: list[str]) -> str:
    """What tells containers of one tag apart in a path: all their class names."""
    shown = "".join(f".{n}" for n in names)
    return shown if len(shown) <= SHOWN_NAMES else f"{'.main' if 'main' in names else ''}.{_key(shown) & (1 << 64) - 1:016x}"


def _text_key(path: str, text: str) -> int:
    return _key(f"{path}\0{text}")


class _Open:
    __slots__ = ("tag", "path", "never", "article", "named")

    def __init__(self, tag: str, path: str, never: bool, article: bool, named: tuple[int, ...]):
        self.tag, self.path, self.never, self.article, self.named = tag, path, never, article, named


def read_page(html: str) -> tuple[list[str], list[tuple[tuple[str, ...], bool, str]]]:
    """(paths of the section containers that were opened, text blocks as (paths of the containers around, in an article, text)).

    What is in an element with a name of NAMED goes, unless that element has more than ``SHARE`` of the page's text;
    so does what is in an element of BESIDE, unless it has as much of it and the page has no article.
    """
    root = _Open("", "", False, False, ())
    stack, opened, blocks, parts, names_open, beside = [root], [], [], [], 0, set()
    sections: dict[str, tuple[str, ...]] = {}  # of each path the containers along it, which many blocks share

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and not stack[-1].never:
                top = stack[-1]
                if top.path not in sections:
                    sections[top.path] = tuple(x.path for x in stack if x.tag in SECTIONS)
                blocks.append((top.named, sections[top.path], top.article, text))

    for m in tokens(html):
        tag = m[3]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                if not stack[-1].never:
                    parts.append(unescape(s) if "&" in s else s)
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if inline and stack[i].tag not in INLINE:
                    break
            continue
        if tag in VOID or m[4].endswith("/") and tag not in SECTIONS:
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in BOUNDS[tag]:
                    break
        if len(stack) > MOST_DEPTH:
            flush()
            stack.pop()
        top = stack[-1]
        own = _attributes(m[4]) if m[4] else {}
        names = [w for kind, value in own.items() if kind in ("class", "id", "role") for w in _WORD.findall(value.lower())]
        article = top.article or tag in ("article", "main") or "main" in names
        never, around = top.never, top.named
        if tag in ("article", "main"):  # an unclosed advert or menu before the article doesn't hide it
            if not top.article:
                never, around = False, ()
            named = bool(names) and _named(own, ("class", "id", "role"), NAMED_ARTICLES)
        else:
            never = never or tag in NEVER
            # in an article the id of a section is where links lead to
            named = tag in BESIDE and not (tag == "header" and top.article)
            if named:
                beside.add(names_open + 1)
            known = NAMED_ADVERTS if tag in TOLD else NAMED
            named = named or bool(names) and tag not in ("html", "body") and _named(own, ("class", "role") if top.article and tag == "section" else ("class", "id", "role"), known)
        never = never or "hidden" in own or bool("style" in own and _NOT_SHOWN.search(own["style"]))
        if named:
            names_open += 1
            around = (*around, names_open)
        path = top.path if inline else f"{top.path}/{tag}{_label(names)}"
        stack.append(_Open(tag, path, never, article, around))
        if tag in SECTIONS and not never:
            opened.append((around, path))
    flush()
    chars, total, told = [0] * (names_open + 1), 0, any(article and not beside & set(around) for around, _, article, _ in blocks)
    everything = sum(len(text) for *_, text in blocks)
    for around, _, _, text in blocks:
        total += 0 if beside & set(around) else len(text)
        for i in around:
            chars[i] += len(text)
    kept = [n > SHARE * everything and not told if i in beside else n > SHARE * (total or everything) for i, n in enumerate(chars)]
    return [path for around, path in opened if all(kept[i] for i in around)], [(paths, article, text) for around, paths, article, text in blocks if all(kept[i] for i in around)]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for page, host, html in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "html")), strict=True):
            opened, blocks = read_page(html or "")
            counts, chars = {"": 1}, {"": 0}
            for path in opened:
                counts[path] = counts.get(path, 0) + 1
            texts: dict[tuple[str, str, bool], int] = {}
            held: dict[int, list] = {}
            for paths, _, text in blocks:
                held.setdefault(id(paths), [paths, 0])[1] += len(text)
            for paths, n in held.values():
                for path in ("", *paths):
                    chars[path] = chars.get(path, 0) + n
            for paths, article, text in blocks:
                k = (paths[-1] if paths else "", text, article)
                texts[k] = texts.get(k, 0) + 1
            found = [(path, False, None, n, chars.get(path, 0)) for path, n in counts.items()] + [(p, a, _text_key(p, t), n, n * len(t)) for (p, t, a), n in texts.items()]
            found.append(("", True, None, 1, sum(len(t) for _, a, t in blocks if a)))  # all text in articles
            for path, article, text, n, c in found:
                row = seen.setdefault((host, path, article, text), [0, 0, 0, 0])
                v = _key(f"{page}:{n}")
                row[0] += v & 0xFFFFFFFF
                row[1] += v >> 32 & 0xFFFFFFFF
                row[2] += 1
                row[3] += c
        keys, rows = list(seen), list(seen.values())
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], names=["host", "path", "article", "text_key", "low", "high", "pages", "chars"])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host.alias("host"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("page"))


def enclosing(path: Column) -> Column:
    """The paths of the containers around, the page's own first."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))


def templates(pages: DataFrame) -> DataFrame:
    """One row a host: (host, slots: paths of the containers to extract, boilerplate: keys of the fixed texts in them)."""
    settle(pages.sparkSession)
    tokens = pages.select("page", "host", "html").mapInArrow(lean(_tokens), "host string, path string, article boolean, text_key bigint, low bigint, high bigint, pages bigint, chars bigint")
    tokens = tokens.groupBy("host", "path", "article", "text_key").agg(*(F.sum(c).alias(c) for c in ("low", "high", "pages", "chars")))
    tokens = tokens.withColumn("vector", F.struct("low", "high"))
    tokens = stored(tokens.where("text_key is null or pages > 1"), "html-tokens")
    different = pages.groupBy("host").agg(F.count_distinct("page").alias("different"))
    told = tokens.where("path = '' and text_key is null and article").select("host", F.col("chars").alias("told_chars"))
    roots = tokens.where("path = '' and text_key is null and not article").select("host", F.col("vector").alias("backbone"), F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    roots = stored(roots.join(different, "host").join(told, "host"), "html-hosts")
    valid = stored(tokens.join(roots, "host").where(F.col("pages") >= SUPPORT * F.col("all_pages")), "html-classes")
    containers = valid.where("text_key is null and not article")
    # slots
    last = F.element_at(F.split("path", "/"), -1)
    named = last.rlike(r"^(article|main)(\.|$)") | last.rlike(r"\.main(\.|$)")
    depth = F.size(F.split("path", "/"))
    open_ = containers.where((F.col("path") != "") & (named | ((F.col("vector") == F.col("backbone")) & (F.col("chars") >= SHARE * F.col("all_chars")))))
    open_ = open_.select("host", "path", F.when(named, depth).otherwise(10_000 - depth).alias("rank"))
    slots = open_.groupBy("host", "rank").agg(F.collect_set("path").alias("slots")).groupBy("host").agg(F.min(F.struct("rank", F.array_sort("slots").alias("slots")))["slots"].alias("slots"))
    # fixed texts: their class is that of a container around them
    texts = valid.where((F.col("different") >= LEAST_PAGES) & F.col("text_key").isNotNull())
    around = texts.select("host", "text_key", "article", "vector", "chars", "told_chars", "all_chars", F.explode(enclosing(F.col("path"))).alias("path"))
    fixed = around.join(containers.select("host", "path", "vector"), ["host", "path", "vector"], "left_semi").select("host", "text_key", "article", "chars", "told_chars", "all_chars").distinct()
    fixed = fixed.groupBy("host", "article").agg(F.collect_list("text_key").alias("keys"), F.sum("chars").alias("chars"), F.first("told_chars").alias("told_chars"), F.first("all_chars").alias("all_chars"))
    fixed = fixed.where(F.col("chars") <= F.when(F.col("article"), COPIES * F.col("told_chars")).when(F.col("told_chars") == 0, PLAIN_COPIES * F.col("all_chars")).otherwise(F.col("all_chars")))
    fixed = fixed.groupBy("host").agg(F.flatten(F.collect_list("keys")).alias("boilerplate"))
    return slots.join(fixed, "host", "full").select("host", F.coalesce("slots", F.array().cast("array<string>")).alias("slots"), "boilerplate")


def _article(html: str, slots: list[str], boilerplate: set[int]) -> str:
    _, blocks = read_page(html)
    inside = [b for b in blocks if not set(slots).isdisjoint(b[0])]
    if not inside:  # the page lacks its host's slots
        inside = [b for b in blocks if b[1]] or blocks
    return "\n\n".join(text for paths, _, text in inside if not boilerplate or _text_key(paths[-1] if paths else "", text) not in boilerplate)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "slots", "boilerplate")), strict=True)
        texts = [_article(h or "", s or [], set(b or ())) for h, s, b in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), batch.column("slots")], names=["page_id", "url", "text", "slots"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, slots) of every page."""
    pages = with_host(pages)
    rows = pages.join(stored(templates(pages), "html-templates"), "host", "left")
    return rows.select("page_id", "url", "html", "slots", "boilerplate").mapInArrow(lean(_extract), "page_id bigint, url string, text string, slots array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), F.array_join("slots", " ").alias("slots"))
