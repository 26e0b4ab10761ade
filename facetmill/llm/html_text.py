"""Main text of web pages by the distribution of text over lines.

Markup is stripped in one pass over the page, in time that grows with its length alone: a quote counts only after an equals
sign, a quote that nothing closes ends at the next white space or `>`, and after a tag that has no end outside its quotes
every tag ends at its first `>`. Every block element and line break starts a line, inline elements do not, raw elements
(scripts, styles) and comments vanish, character references are decoded.

A line weighs its text's length. It weighs nothing in a menu, header, footer, sidebar, notice, advert, form or reader
comment: by element, role, or a class or id that names one. A name counts if it is such a word ("comments"), or if such a
word stands with words for places and boxes only ("ad-slot", "siteFooter"), so neither "side-effects" nor "no-sidebar"
does; ids of headings, which repeat the heading, do not count. This holds inside a marked article as outside. Lines that
are mostly links, and lines with a copyright sign, weigh nothing where no article is marked; inside a marked article three
or more lines in succession that are nothing but short links are a menu.

Where a page marks its article (article, main, or these roles) other lines weigh nothing, and the mark is trusted: any
weight is a surge. Of a main with an article in it that holds half of its text or more, the article counts alone.
Elsewhere weights are summed over sliding windows of `width` lines. The distribution surges at the first window of at
least `surge` characters and dives where a window is empty; what lies between is a region. The text runs from the first to
the last region that holds at least `share` of the text of the largest one, whatever divides these; small regions before
and after (terms, notices, imprints) and lines without a surge are no main text.

Null or empty html gives an empty text. White space inside a block becomes one space; blocks join by one space. Rows are
independent, repeated rows get equal results, columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as html_lib
import re

from pyspark.sql import DataFrame

from .common import small_batches

_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_DROP_TAGS = frozenset("nav header footer aside form button dialog menu head audio video noscript template svg math select object canvas".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words that, as a class or id or with words of boxes, name what is not main text.
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos banner banners cookie cookies consent gdpr popup modal"
    " overlay sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer footers header headers masthead topbar comment comments commentlist"
    " disqus newsletter newsletters subscribe subscription signup signin login pagination pager toolbar share sharing social related recommended recommendations".split()
)
#: Further names that count as a whole.
_DROP_NAMES = frozenset(
    "notice notices alert alerts side foot head replies reply respond discussion search widget widgets promotion promotions search-form search-box search-bar searchform widget-area"
    " site-notice skip-link skip-links".split()
)
#: Words of places and boxes.
_BOX_WORDS = frozenset(
    "area article articles bar bars block blocks body bottom box boxes btn button buttons card cards center col column container content contents entry fixed form forms foot"
    " global google group head holder home icon icons inline inner item items js layout left link links list lists main middle mobile module notice outer page panel panels post posts"
    " primary region right root row secondary section sections site slot slots small sticky stories story strip tab tabs text thread title tools top tree unit units user users"
    " widget widgets wrap wrapper zone".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*+)|[!?/])")
#: The rest of a tag whose quotes all follow an equals sign and are closed before the first `>`.
_PLAIN = re.compile(r"(?:[^\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?=[^\s\"'])))*+")
_NAME, _VALUE, _GAP = re.compile(r"=?[^\s/>=]*+"), re.compile(r"[^\s>]*+"), re.compile(r"[\s/]*+")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+[^\s>]*))", re.I)
_LONG_REFERENCE = re.compile(r"&#(?:[xX]0*([0-9a-fA-F]+)|0*([0-9]+));?")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def decoded(text: str) -> str:
    """Character references replaced; numbers of any length."""
    if "&" not in text:
        return text
    return html_lib.unescape(_LONG_REFERENCE.sub(lambda m: m[0] if len(m[1] or m[2] or "") < 9 else "�", text) if "&#" in text else text)


def drops(names: str) -> bool:
    """Whether a class or id attribute names what is not main text."""
    for name in names.split():
        low = name.lower()
        if low in _DROP_NAMES or low in _DROP_WORDS:
            return True
        parts = [p.lower() for p in _PARTS.findall(name)]
        if any(p in _DROP_WORDS for p in parts) and all(len(p) == 1 or p.isdigit() or p in _DROP_WORDS or p in _BOX_WORDS for p in parts):
            return True
    return False


class Scanner:
    """Text and tags of a page in order: next() gives (text before, end mark, tag, attributes), tag "" at the end."""

    def __init__(self, page: str):
        self.page, self.at, self.loose, self.unclosed = page, 0, False, set()

    def next(self) -> tuple[str, str, str, str]:
        page, start, said = self.page, self.at, []
        while m := _OPEN.search(page, self.at):
            tag = (m[2] or "").lower()
            if tag:
                said.append(page[start : m.start()])
                begin = m.end()
                end = self._tag_end(begin)
                if end < 0:
                    self.at = len(page)
                    return "".join(said) + page[m.start() :], "", "", ""
                self.at = end + 1
                attributes = page[begin:end]
                if tag in _RAW and not m[1]:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, self.at)
                    after = page.find(">", close.end()) if close else -1
                    self.at = start = after + 1 if after >= 0 else len(page)
                    return "".join(said), "", tag, attributes
                return "".join(said), m[1], tag, attributes
            comment = m[0] == "<!--"
            end = page.find("-->" if comment else ">", m.start() + 2)
            if end < 0 and not comment:
                break
            said.append(page[start : m.start()])
            self.at = start = len(page) if end < 0 else end + (3 if comment else 1)
        said.append(page[start:])
        self.at = len(page)
        return "".join(said), "", "", ""

    def _tag_end(self, at: int) -> int:
        """The place of the `>` that ends a tag; -1 if there is none."""
        page = self.page
        first = page.find(">", at)
        if first < 0 or self.loose or _PLAIN.fullmatch(page, at, first):
            return first
        while at < len(page):
            at = _GAP.match(page, at).end()
            if page[at : at + 1] == ">":
                return at
            at = _NAME.match(page, at).end()
            gap = _GAP.match(page, at).end() if page[at : at + 1].isspace() else at
            if page[gap : gap + 1] != "=":
                continue
            at = gap + 1
            while page[at : at + 1].isspace():
                at += 1
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote not in self.unclosed:
                close = page.find(quote, at + 1)
                if close >= 0:
                    at = close + 1
                    continue
                self.unclosed.add(quote)
            at = _VALUE.match(page, at).end()
        self.loose = True
        return first


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters inside links, dropped, mark) of each line with text, in page order; mark: 2 in an article, 1 in a main only."""
    lines, text, links = [], [], []
    stack: list[tuple[str, bool, int, int]] = []  # element, whether it drops, its mark, inline elements on top before it
    opened: dict[str, int] = {}
    marks = [0, 0, 0]
    dropping = inline = 0

    def close() -> None:
        if text:
            line = _SPACES.sub(" ", decoded("".join(text))).strip(" ")
            if line:
                lines.append((line, len(_SPACES.sub(" ", decoded("".join(links))).strip(" ")) if links else 0, dropping > 0, 2 if marks[2] else 1 if marks[1] else 0))
            text.clear()
            links.clear()

    def pop_to(tag: str) -> None:
        nonlocal dropping, inline
        while stack:
            name, drop, mark, inline = stack.pop()
            dropping -= drop
            marks[mark] -= 1
            opened[name] -= 1
            if name == tag:
                return

    scan = Scanner(page)
    while True:
        part, end, tag, attributes = scan.next()
        if part:
            text.append(part)
            if opened.get("a"):
                links.append(part)
        if not tag:
            break
        if tag not in _INLINE:
            close()
        if end:
            if opened.get(tag):
                pop_to(tag)
            continue
        if tag in _VOID or tag in _RAW or attributes.endswith("/") and tag not in ("a", "p", "div", "span"):
            continue
        if tag not in _INLINE and len(stack) > inline and stack[-1 - inline][0] == "p":
            pop_to("p")  # a block ends a paragraph and what is inline in it
        if tag == "li" and stack and stack[-1][0] == "li":
            pop_to("li")
        named = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)} if "=" in attributes else {}
        role = named.get("role", "").lower()
        drop = tag in _DROP_TAGS or role in _DROP_ROLES
        if not drop and named and tag not in ("html", "body"):
            drop = drops(named.get("class", "")) or tag not in _HEADINGS and drops(named.get("id", ""))
        mark = 0 if drop else 2 if tag == "article" or role == "article" else 1 if tag == "main" or role == "main" else 0
        stack.append((tag, drop, mark, inline))
        opened[tag] = opened.get(tag, 0) + 1
        inline = inline + 1 if tag in _INLINE else 0
        dropping += drop
        marks[mark] += 1
    close()
    return lines


def window_sums(weights: list[int], width: int) -> list[int]:
    """Sum of the weights of the `width` lines from each line on."""
    total, sums = 0, [0] * len(weights)
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + width] if i + width < len(weights) else 0)
        sums[i] = total
    return sums


def regions(weights: list[int], width: int, surge: int) -> list[tuple[int, int]]:
    """Stretches of lines from a surge to the next dive."""
    found, start = [], None
    for i, s in enumerate(window_sums(weights, width)):
        if start is None and s >= surge:
            start = i
        elif start is not None and not s:
            found.append((start, i))
            start = None
    return found if start is None else [*found, (start, len(weights))]


def _menus(lines: list[tuple[str, int, bool, int]], least: int = 3, short: int = 80) -> list[bool]:
    """Which lines belong to a succession of lines that are nothing but short links."""
    only = [n >= len(t) and len(t) <= short for t, n, _, _ in lines]
    out, at = [False] * len(lines), 0
    while at < len(lines):
        end = at
        while end < len(lines) and only[end]:
            end += 1
        if end - at >= least:
            out[at:end] = [True] * (end - at)
        at = max(end, at + 1)
    return out


def main_text(page: str | None, width: int = 3, surge: int = 80, share: float = 0.15) -> str:
    """The text between the surge and dive points of a page."""
    if not page:
        return ""
    lines = lines_of(page)
    inside = [sum(len(t) for t, _, drop, m in lines if m == mark and not drop) for mark in range(3)]
    if inside[1] or inside[2]:
        least, surge = 2 if inside[2] >= inside[1] else 1, 1
        weights = [0 if drop or mark < least or menu else len(t) for (t, _, drop, mark), menu in zip(lines, _menus(lines))]
        share = 0.0
    else:
        weights = [0 if drop or 2 * n > len(t) or "©" in t else len(t) for t, n, drop, _ in lines]
    found = regions(weights, width, surge)
    if not found:
        found = [(0, len(lines))]
    sizes = [sum(weights[a:z]) for a, z in found]
    kept = [r for r, size in zip(found, sizes) if size >= share * max(sizes)]
    a, z = kept[0][0], kept[-1][1]
    return " ".join(t for (t, *_), w in zip(lines[a:z], weights[a:z]) if w)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
