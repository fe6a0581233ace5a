"""Main text of web pages by template deduction from equivalence classes (operator 3).

Pages of one host are filled into templates.  A page's tokens are its elements, told apart by their path (tags, names and the
number among like siblings), and its text blocks with their path of tags and names; tokens with the same occurrence vector over
a host's pages form an equivalence class.  A class is large and frequent if it has two tokens or more and is on at least half of the
host's pages (and on three); it is valid if its place in the page nests with, or is disjoint from, those of more frequent classes.
The valid classes nested into each other are the host's template, and what is not template text is a slot.

The main slot is found by descending the template's elements from the root: into the one that holds ``SHARE`` or more of the host's slot
text (characters outside links and template text, summed over its pages), until there is none, or at ``article`` or ``main``.
A page's text is all of its main slot, be it repeated or not; if that is the whole page, template text is left out.  Markup and names
only break ties: a page with ``article`` or ``main`` is read there, and a host without such a slot (fewer than three pages, or none
alike) is read inside an element named as content, else everywhere but in blocks that are mostly links.  Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments inside are told by tag, role or class: a whole class name, or
its last part, is one of a list, with nothing but parts that name a box behind it.

Copies of a page make no template: pages of a host whose article is the same before template text is left out count as
one, by the page with the least hash of its html, so repeated rows and copies with other menus or adverts keep their text.

Occurrence vectors are never gathered: each is an exclusive or of page hashes, combined before the shuffle, so a host with a third of
all pages costs no more than its distinct tokens.  The hashes of copies and the templates are sent to all tasks only if they take at most
``BROADCAST`` bytes; else pages are joined to them by host.

Null and empty html give an empty text; a null url is a host of its own name "".  Repeated rows each give a row.
White space is what str.split takes for it; character references are decoded once.  Paths are hashes, so elements may be nested to any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b, md5
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.rows import bounded, cut, read
from quillon.llm.urlfilter import host_of

BROADCAST = 8 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|template|xmp|noembed|noframes)\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>.*?(?:</\1\s*>|\Z)|<([!?])[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|[^<]++|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav header footer aside form button select option dialog menu svg math object audio video canvas head map fieldset datalist".split())
_OUT_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_OUT_NAME = (
    "ads?|adsbygoogle|adsense|adbox|adslot|adunit|adv|adverts?|advertise(?:ment|ments|ing)|advertorial|sponsor|sponsored|promo|promotion|banner|cookies?|cookiebar|cookiebanner|consent|gdpr|notices?|notification|alert|announcement|disclaimer|toast|"
    "newsletter|subscribe|subscription|signup|paywall|sidebar|aside|rail|nav|navbar|navigation|topnav|subnav|sidenav|topbar|sitemap|toc|menus?|breadcrumbs?|footer|masthead|comments?|commentlist|discussion|replies|responses|disqus|respond|"
    "share|sharing|related|recommended|recommendations|popup|modal|overlay|widget|toolbar|pagination|pager|skip-link|copyright|outbrain|taboola"
)
#: Names that tell of boilerplate only as the whole of a class or id, a box part aside.
_OUT_ALONE = "header|side|social|search|login"
_BOX = "bar|block|bottom|box|button|buttons|container|content|form|group|icons|inner|item|items|left|link|links|list|outer|panel|right|section|top|unit|area|slot|wrap|wrapper|widget"
_OUT_CLASS = re.compile(rf"(?:(?:site|page|top|main|global)[-_])?(?:{_OUT_ALONE})(?:[-_](?:{_BOX})|[-_]?\d+)*|(?!(?:has|with|no|without|is)[-_])(?:.*[-_])?(?:{_OUT_NAME})(?:[-_](?:{_BOX}|{_OUT_NAME})|[-_]?\d+)*", re.I)
_COMMENT_CLASS = re.compile(r"(?:comment|comments|reply|ad|ads|advert\w*|sponsored|related|teaser)(?:[-_].*|\d*)", re.I)
_CONTENT_CLASS = re.compile(r"(?:main|page|article|post|entry|story|text|body)?[-_]?(?:content|article|post|entry|story)[-_]?(?:body|text|main|area|wrapper|inner)?|(?:article|post|entry|story)[-_]?(?:body|text|main)", re.I)
_MAIN_CLASS = re.compile(r"(?:main|text|body)[-_]?(?:area|column|text|inner)?", re.I)
#: Regions: an element named as the main part, one named as content, article or main.
_NAMED, _CONTENT, _ARTICLE = 1, 2, 3
#: Elements that end when one of their kind (or the named ones) begins.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = frozenset("ul ol dl table body article main div section".split())


def _names(attributes: str) -> tuple[str, str, bool]:
    """(role, class names and id, whether hidden)."""
    role, names, hidden = "", [], False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            role = value.lower()
        elif key in ("class", "id"):
            names += value.split()
        elif key == "hidden":
            hidden = value.lower() != "until-found"
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            hidden |= "display:none" in value.replace(" ", "").lower()
    return role, " ".join(names), hidden


#: Elements that a slot may be; kinds of tokens.
_BOXES = frozenset("html body div section td tr tbody table center span ul ol li dl dd".split())
_TEXT, _BOXED, _MARKED, _OTHER = 0, 1, 2, 3
#: The part of a host's slot text that an element must hold to be descended into.
SHARE = 0.6


def _hash(*parts: str | int) -> int:
    """A signed number of 64 bits."""
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Page:
    """A parsed page: its text blocks and elements, in page order.

    ``blocks``: (element, text, region, out, share of link characters, place).  Region is 3 inside article or main, 2 or 1 inside an
    element named as content or as the main part, else 0; ``out`` is boilerplate by name.
    ``elements``: (parent's number, kind, place, tag and names, number among like siblings); the first is the page itself.  Places
    count elements and blocks together.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int, bool, float, int]] = []
        self.elements: list[tuple[int, int, int, str, int]] = [(0, _BOXED, 0, "", 0)]
        self._parse(html)

    @cached_property
    def tokens(self) -> list[int]:
        """Each element's token: its path with numbers among like siblings."""
        made = [0]
        for parent, _, _, name, nth in self.elements[1:]:
            made.append(_hash("e", made[parent], name, nth))
        return made

    @cached_property
    def paths(self) -> list[int]:
        """Each element's path of tags and names."""
        made = [0]
        for parent, _, _, name, _ in self.elements[1:]:
            made.append(_hash("p", made[parent], name))
        return made

    def _parse(self, html: str) -> None:
        found, elements = self.blocks, self.elements
        # tag, region, out, element, like children so far
        stack: list[tuple[str, int, bool, int, dict[str, int]]] = [("", 0, False, 0, {})]
        run: list[str] = []
        links = inside = 0

        def flush():
            nonlocal links
            if run:
                text = " ".join("".join(run).split())
                if text:
                    _, region, out, element, _ = stack[-1]
                    found.append((element, text, region, out, links / max(1, len(text)), len(found) + len(elements)))
                run.clear()
            links = 0

        for m in _TOKEN.finditer(html):
            tag = m[4]
            if tag is None:
                raw = m[0]
                if m[1] or m[2] or raw.startswith("<!--"):
                    if m[1] and m[1].lower() not in ("script", "style", "template"):
                        flush()
                    continue
                text = unescape(raw) if "&" in raw else raw
                run.append(text)
                if inside:
                    links += len(text.strip())
                continue
            tag = tag.lower()
            if m[3]:  # an end tag
                if tag == "a":
                    inside = max(0, inside - 1)
                if tag not in _INLINE:
                    flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if tag in _INLINE and i < len(stack) - 1:
                            break
                        flush() if stack[-1][2] != stack[i - 1][2] else None
                        del stack[i:]
                        break
                    if tag not in ("html", "body", "article", "main") and stack[i][0] in ("article", "main", "body"):
                        break
                continue
            if tag == "a":
                inside = 1
            attributes = m[5]
            if tag in _INLINE and stack[-1][0] == tag:  # inside an inline element that is left out: its end is not the outer one's
                stack.append(stack[-1])
                continue
            if tag in _INLINE and not attributes:
                continue
            role, names, hidden = _names(attributes) if attributes.strip(" /") else ("", "", False)
            if tag in _VOID:
                if tag not in _INLINE:
                    flush()
                continue
            named = names.split()
            marked = tag in ("article", "main") or role in ("main", "article")
            if marked:
                bad = hidden or any(_COMMENT_CLASS.fullmatch(x) for x in named)
            elif tag in ("html", "body"):
                bad = False
            else:
                bad = hidden or tag in _OUT or role in _OUT_ROLE or any(_OUT_CLASS.fullmatch(x) for x in named)
            if tag in _INLINE:
                if bad and not attributes.rstrip().endswith("/"):
                    flush()
                    stack.append((tag, stack[-1][1], True, *stack[-1][3:]))
                continue
            flush()
            if tag in _CLOSES or tag != "p":
                ends = _CLOSES.get(tag, ())
                while len(stack) > 1:
                    top = stack[-1][0]
                    if top == "p" or top in ends or top in _INLINE:
                        stack.pop()
                    else:
                        break
            elif stack[-1][0] == "p":
                stack.pop()
            if attributes.rstrip().endswith("/") and tag in ("svg", "path", "use"):
                continue
            _, region, out, parent, like = stack[-1]
            name = f"{tag}.{'.'.join(named)}"
            nth = like[name] = like.get(name, 0) + 1
            if marked:
                region = _ARTICLE
            elif named and region < _CONTENT and tag in ("div", "section", "td"):
                if any(_CONTENT_CLASS.fullmatch(x) for x in named):
                    region = _CONTENT
                elif any(_MAIN_CLASS.fullmatch(x) for x in named):
                    region = _NAMED
            kind = _MARKED if marked else _BOXED if tag in _BOXES else _OTHER
            elements.append((parent, kind, len(found) + len(elements), name, nth))
            stack.append((tag, region, out or bad, len(elements) - 1, {}))
        flush()

    def occurring(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(token, token of the element around, kind, slot characters in it, place) of all elements and blocks but the page itself."""
        mass = [0] * len(self.elements)
        for element, text, _, out, links, place in self.blocks:
            size = 0 if out or links > 0.5 else len(text)
            mass[element] += size
            yield _place(self.paths[element], text), self.tokens[element], _TEXT, size, place
        for i in range(len(self.elements) - 1, 0, -1):
            parent, kind, place, _, _ = self.elements[i]
            mass[parent] += mass[i]
            yield self.tokens[i], self.tokens[parent], kind, mass[i], place

    def within(self, token: int) -> list[bool]:
        """Whether each element lies in the one with the token."""
        held = [False] * len(self.elements)
        for i, own in enumerate(self.tokens):
            held[i] = own == token or held[self.elements[i][0]]
        return held


def _place(path: int, text: str) -> int:
    return _hash("x", path, text)


def _distinct(pages: DataFrame) -> DataFrame:
    """(host, twin, main, n): the rows of each html (by its hash, twin), and the hash of its article before template text is left out."""
    schema = "host string, twin binary, main binary, n long"

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, bytes], list] = {}
            for host, twin, html in zip(batch.column("host").to_pylist(), batch.column("twin").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if (host, twin) in seen:
                    seen[host, twin][1] += 1
                else:
                    seen[host, twin] = [md5(article(html).encode("utf-8", "surrogatepass")).digest(), 1]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([t for _, t in seen], pa.binary()), pa.array([m for m, _ in seen.values()], pa.binary()), pa.array([n for _, n in seen.values()], pa.int64())], names=["host", "twin", "main", "n"])

    return pages.select("host", "twin", "html").mapInArrow(run, schema).groupBy("host", "twin", "main").agg(F.sum("n").alias("n"))


def occurrences(pages: DataFrame, copies: DataFrame) -> DataFrame:
    """(host, token, support, vector, place, mass, around, kind): each token's pages, the fingerprint of its occurrence vector, its mean
    place, the slot characters in it, the element around it and its kind.

    ``pages`` has host, twin (the hash of html) and html; ``copies`` (host, twin, stands) those that share their article with
    other rows, and whether they stand for all of them.
    """
    schema = "host string, token long, copy binary, support long, vector long, place double, mass long, around long, kind int"
    pages = pages.select("host", "twin", "html")
    size = copies.agg(F.sum(100 + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST:
        shared = pages.sparkSession.sparkContext.broadcast({(h, bytes(t)): s for h, t, s in copies.toLocalIterator()})
    else:
        shared = None
        pages = pages.join(copies, ["host", "twin"], "left").where("stands is null or stands")

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, int, bytes | None], list] = {}
            done: set[tuple[str, bytes]] = set()
            marks = batch.column("stands").to_pylist() if shared is None else None
            for i, (host, twin, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("twin").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                stands = shared.value.get((host, twin)) if marks is None else marks[i]
                if stands is False or (host, twin) in done:
                    continue
                if stands:
                    done.add((host, twin))
                page = Page(html or "")
                n = len(page.elements) + len(page.blocks)
                tokens: dict[int, list] = {}
                for token, around, kind, mass, place in page.occurring():
                    t = tokens.setdefault(token, [0, place / n, 0, around, kind])
                    t[0] += 1
                    t[2] += mass
                for token, (count, place, mass, around, kind) in tokens.items():
                    s = seen.setdefault((host, token, twin if stands else None), [0, 0, 0.0, 0, around, kind])
                    s[0] += 1
                    s[1] ^= _hash(twin.hex(), count)
                    s[2] += place
                    s[3] += mass
            keys, values = list(seen), list(seen.values())
            arrays = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))]
            arrays += [pa.array([v[i] for v in values], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "token", "copy", "support", "vector", "place", "mass", "around", "kind"])

    made = pages.mapInArrow(run, schema)
    # A page that stands for its copies may come from several tasks, with the same values.
    whole = F.col("copy").isNull()
    sums = (F.when(whole, F.sum(c)).otherwise(F.max(c)).alias(c) for c in ("support", "place", "mass"))
    kept = F.max("around").alias("around"), F.max("kind").alias("kind")
    once = made.groupBy("host", "token", "copy").agg(*sums, F.when(whole, F.bit_xor("vector")).otherwise(F.max("vector")).alias("vector"), *kept)
    return once.groupBy("host", "token").agg(F.sum("support").alias("support"), F.bit_xor("vector").alias("vector"), (F.sum("place") / F.sum("support")).alias("place"), F.sum("mass").alias("mass"), *kept)


def _classes(rows: pd.DataFrame) -> list[tuple]:
    """The valid classes of one host's frequent tokens: (- support, - tokens, first place, last place, tokens)."""
    classes = []
    for (support, _), c in rows.groupby(["support", "vector"], sort=False):
        if len(c) >= 2:
            classes.append((-int(support), -len(c), float(c["place"].min()), float(c["place"].max()), sorted(c["token"].tolist())))
    kept: list[tuple] = []
    for c in sorted(classes):
        if all(c[2] >= k[2] and c[3] <= k[3] or c[2] <= k[2] and c[3] >= k[3] or c[3] < k[2] or c[2] > k[3] for k in kept):
            kept.append(c)
    return kept


def _nested(rows: pd.DataFrame) -> pd.DataFrame:
    """The template of one host from its frequent tokens: the texts of valid classes, and the main slot."""
    valid = {t for c in _classes(rows) for t in c[4]}
    kind, mass, around = ({t: int(v) for t, v in zip(rows["token"], rows[c], strict=True)} for c in ("kind", "mass", "around"))
    texts = sorted(t for t in valid if kind[t] == _TEXT)
    for t in texts:  # what is template text fills no slot
        at = around[t]
        while at in mass:
            mass[at] -= mass[t]
            at = around[at]
    below: dict[int, list[int]] = {}
    for t in valid:
        if kind[t] in (_BOXED, _MARKED):
            below.setdefault(around[t], []).append(t)
    main = 0
    have = sum(mass[t] for t in kind if kind[t] != _TEXT and around[t] == 0)
    while have > 0 and kind.get(main) != _MARKED:
        best = max(below.get(main, ()), key=lambda t: (mass[t], kind[t] == _MARKED, t), default=None)
        if best is None or mass[best] < SHARE * have:
            break
        main, have = best, mass[best]
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "tokens": [texts], "main": [main]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens, main): the text tokens of each host's template, and the token of its main slot (0: the page).

    ``pages`` has host and html; pages with the same article count as one.
    """
    pages = pages.select("host", "html", F.unhex(F.md5(F.coalesce(F.col("html"), F.lit("")))).alias("twin"))
    each = cut(_distinct(pages))
    mains = each.groupBy("host", "main").agg(F.min("twin").alias("first"), F.sum("n").alias("n"))
    copies = cut(each.select("host", "main", "twin").join(mains.where("n > 1"), ["host", "main"]).select("host", "twin", (F.col("twin") == F.col("first")).alias("stands")))
    whole = mains.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = occurrences(pages, copies).where("support >= 3").join(whole, "host").where("2 * support >= pages")
    return frequent.groupBy("host").applyInPandas(_nested, "host string, tokens array<long>, main long")


def article(html: str | None, template: frozenset[int] = frozenset(), main: int = 0) -> str:
    """The main text of a page, given its host's template and main slot."""
    page = Page(html or "")
    usable = [b for b in page.blocks if not b[3]]
    region = max((b[2] for b in usable), default=0)
    held = page.within(main) if main and region < _ARTICLE else ()
    if not any(held[b[0]] for b in usable if held):
        held = ()
    kept = []
    for element, text, where, _, links, _ in usable:
        if not held[element] if held else where < region or where == 0 and links > 0.5:
            continue
        if not held and not region and template and _place(page.paths[element], text) in template:
            continue
        kept.append(text)
    return " ".join(kept)


def extract(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, text) of every row."""
    spark = df.sparkSession
    bounded(spark)
    pages = df.select(host_of(F.col(url)).alias("host"), F.col(page).alias("page"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    made = cut(templates(pages))
    size = made.agg(F.sum(128 + F.octet_length("host") + 60 * F.size("tokens"))).first()[0] or 0
    schema = T.StructType([T.StructField("page", df.schema[page].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    if size <= BROADCAST:
        shared = spark.sparkContext.broadcast({h: (frozenset(t), m) for h, t, m in made.toLocalIterator()})
    else:
        shared = None
        pages = pages.join(made, "host", "left").select("host", "page", "url", "html", "tokens", "main")
    none = (frozenset(), 0)

    def run(batches):
        for batch in batches:
            texts, seen = [], {}
            hosts, htmls = batch.column("host").to_pylist(), batch.column("html").to_pylist()
            for i, (host, source) in enumerate(zip(hosts, htmls, strict=True)):
                if shared is not None:
                    template = shared.value.get(host, none)
                else:
                    if host not in seen:
                        seen[host] = frozenset(batch.column("tokens")[i].as_py() or ()), batch.column("main")[i].as_py() or 0
                    template = seen[host]
                texts.append(article(source, *template))
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(texts, pa.string())], names=["page", "url", "text"])

    return pages.mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, as the module says.

    Null and empty html give an empty text; null ids and urls stay null; rows with one id and repeated rows each give a row, and
    copies make no template; whole pages are read, whatever their length; an empty table gives no rows; other columns aren't read.
    """
    made = extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return made.select(F.col("page").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: For pages whose article is marked and has nothing but text, headings and breaks in it, with references to & and quotes, as the given ones.
OP3_SQL = f"""
WITH a AS (SELECT page_id, url, regexp_replace(replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<b>', ''), '<[^>]*>', ' ', 'g') AS x FROM pages),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '{_WHITE}', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""
