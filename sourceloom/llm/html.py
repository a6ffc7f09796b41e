"""Main text of web pages by tree scoring.

A page becomes a tree of elements; menus, headers, footers, sidebars, notices, adverts, forms, scripts and
reader comments are recognised by element or by the names in class, id and role, and taken out; a name counts as a
whole (``share-buttons`` is taken out, ``share-price`` is not).  Every
paragraph passes points for its length and its commas to its parent and, by half, to its grandparent.  An
element's points are discounted by its share of link text.  The element with most points is the container;
the article or main element around it, if any, replaces it.  Its siblings are kept with it when they score near it
or hold prose, lists, tables or headings with few links, whatever element they are; and where a wrapper around it
holds such prose elsewhere, the wrapper's children are kept alike, up to the body.  All text blocks of what is kept
come out in page order.

Rows: null html is empty, without text the result is empty; unclosed, crossed and cut-off markup is read as
browsers do (an element ends where its parent does); pages of any length are read whole; an empty table gives
an empty result; extra columns do not matter.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import batches, text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes xmp template".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead tr ul""".split())
PARAGRAPHS = frozenset("p pre td blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("""head nav footer aside form script style noscript iframe button select input textarea template svg canvas object
embed menu dialog audio video map datalist fieldset label title header""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id values that mark what is not the article.
SIDE = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner
breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices
alert popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation pager pagination paging sidebar
sidebars aside rail widget widgets footer foot header masthead topbar toolbar share sharing social related recommended recommendations
outbrain taboola search searchbox skip skiplink form tags taglist copyright legal disclaimer adsbygoogle""".split())
#: Words that a name of such an element may have beside them; numbers and single letters too.
NEUTRAL = frozenset("""area bar bars block blocks box boxes btn button buttons card cards col column container content group holder icon icons
inner inline item items js left link links list module outer page panel primary region right row secondary section site slot small
sticky sub thread top bottom unit user users view web wp wrap wrapper global mobile desktop field input label title""".split())
#: A name of these words (and neutral ones) marks the article: it is not taken out for other names beside it.
MAIN = frozenset("article main content body post entry story text".split())
#: Names of these words are taken out even so.
STRONG = frozenset("comment comments sidebar ad ads".split())
#: Low-link blocks that belong to prose beside them without being prose.
COMPANIONS = frozenset("ul ol dl table blockquote pre figure h1 h2 h3 h4 h5 h6 p".split())
#: An open element of the key ends when one of the values starts.
_ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot", "thead"},
             "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
_SCOPE = frozenset("table td th ul ol dl div section article main body".split())

# A quote opens a value only right after the equals sign; elsewhere it is a character like others.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                     r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*+)>"
                     r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z0-9]+")


class Page:
    """Elements in page order (parent before child) and the texts between their tags."""

    def __init__(self, html: str):
        self.tags, self.parents, self.side = ["#root"], [-1], [False]
        self.items: list[tuple[int, str | None]] = []        # (element, text), or (element, None) at a block's edge
        stack, at, end = [0], 0, len(html)
        while at < end:
            found = _MARKUP.search(html, at)
            self._text(stack[-1], html[at:found.start() if found else end])
            if not found:
                break
            at = found.end()
            closing, tag, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
            if tag is None or (at == end and found[0][-1:] != ">"):
                continue
            tag = tag.lower()
            if closing:
                self._close(stack, tag)
                continue
            if tag == "br":
                self._text(stack[-1], " ")
                continue
            element = self._open(stack, tag, rest)
            if tag in RAW:
                after = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = after.end() if after else end
            elif tag not in VOID and not rest.endswith("/"):
                stack.append(element)
            elif rest.endswith("/") and tag not in VOID:
                stack.append(element)

    def _text(self, element: int, raw: str) -> None:
        if raw:
            self.items.append((element, unescape(raw) if "&" in raw else raw))

    def _open(self, stack: list[int], tag: str, rest: str) -> int:
        if tag in _ENDS_P:
            self._end_open(stack, "p")
        for open_tag, enders in _ENDED_BY.items():
            if tag in enders:
                self._end_open(stack, open_tag)
        parent = stack[-1]
        self.tags.append(tag)
        self.parents.append(parent)
        self.side.append(self.side[parent] or self._is_side(parent, tag, rest))
        if tag in BLOCKS:
            self.items.append((len(self.tags) - 1, None))
        return len(self.tags) - 1

    def _end_open(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            own = self.tags[stack[k]]
            if own == tag:
                self.items.append((stack[k], None))
                del stack[k:]
                return
            if own in _SCOPE:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                if tag in BLOCKS or any(self.tags[e] in BLOCKS for e in stack[k:]):
                    self.items.append((stack[k], None))
                del stack[k:]
                return

    def _is_side(self, parent: int, tag: str, rest: str) -> bool:
        if tag in ("html", "body", "article", "main"):
            names = self._attributes(rest) if tag == "article" and rest else {}
            return any(self._names_side(set(_WORDS.findall(n.lower()))) for v in ("class", "id") for n in names.get(v, "").split())
        if tag == "header":                                     # an article's own header may hold its title
            return not any(self.tags[e] in ("article", "main") for e in self._up(parent))
        if tag in NEVER:
            return True
        if not rest:
            return False
        names, marks = self._attributes(rest), []
        if ("hidden" in names and names["hidden"].lower() != "false" or names.get("aria-hidden", "").strip().lower() == "true"
                or _UNSEEN.search(names.get("style", ""))):
            return True
        if set(_WORDS.findall(names.get("role", "").lower())) & ROLES:
            return True
        for value in (names.get("class", ""), names.get("id", "")):
            for name in value.split():
                words = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
                marks.append({w for w in words if len(w) > 1 and not w.isdigit()})
        protected = any(w & MAIN and w <= MAIN | NEUTRAL for w in marks)
        return any(self._names_side(w) and (not protected or w & STRONG) for w in marks)

    @staticmethod
    def _names_side(words: set[str]) -> bool:
        """Whether a name consists of side words; an article's own header and footer names do not count."""
        found = words & SIDE
        return bool(found) and words <= SIDE | NEUTRAL | MAIN and not (words & MAIN - {"content", "text"} and found <= {"header", "head", "masthead"})

    @staticmethod
    def _attributes(rest: str) -> dict[str, str]:
        """Attributes as browsers read them: names without case, the first of equal names counts."""
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(rest):
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            found.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
        return found

    def _up(self, element: int) -> Iterator[int]:
        while element > 0:
            yield element
            element = self.parents[element]

    def kept(self) -> list[bool]:
        """Which elements belong to the main text."""
        count = len(self.tags)
        chars, links, commas, points = [0] * count, [0] * count, [0] * count, [0.0] * count
        in_link = [False] * count
        for e in range(1, count):
            in_link[e] = in_link[self.parents[e]] or self.tags[e] == "a"
        for e, text in self.items:
            if text is not None and not self.side[e]:
                size = len(text) if text.isprintable() and "  " not in text else len(" ".join(text.split()))
                if size:
                    chars[e] += size
                    commas[e] += text.count(",") + text.count("،") + text.count("，") + text.count("、")
                    links[e] += size if in_link[e] else 0
        own_chars, own_links = chars[:], links[:]
        for e in range(count - 1, 0, -1):
            up = self.parents[e]
            chars[up] += chars[e]
            links[up] += links[e]
            commas[up] += commas[e]
        for e in range(1, count):
            # A paragraph, or text that stands in a block without one.
            own = self.tags[e] in PARAGRAPHS or (self.tags[e] in BLOCKS and own_chars[e] - own_links[e] >= 80)
            if own and chars[e] and not self.side[e]:
                worth = (1 + commas[e] + min(chars[e] / 100, 3)) * (1 - links[e] / chars[e])
                holder = self.parents[e] if self.tags[e] in PARAGRAPHS else e
                points[holder] += worth
                if self.parents[holder] >= 0:
                    points[self.parents[holder]] += worth / 2
        density = [links[e] / chars[e] if chars[e] else 0.0 for e in range(count)]
        scores = [points[e] * (1 - density[e]) for e in range(count)]
        best = max(range(count), key=lambda e: (scores[e], -e))
        if scores[best] <= 0:
            # No prose at all: what is left of the page counts.
            return [not self.side[e] for e in range(count)]
        around = [e for e in self._up(best) if self.tags[e] in ("article", "main")]
        if around:
            best = around[-1] if self.tags[around[-1]] == "article" else around[0]
        chosen = {best}
        children: list[list[int]] = [[] for _ in range(count)]
        prose = [points[e] > 0 and density[e] < 0.33 for e in range(count)]          # holds low-link prose
        for e in range(count - 1, 0, -1):
            children[self.parents[e]].append(e)
            prose[self.parents[e]] |= prose[e] and not self.side[self.parents[e]]
        if around:
            for e in children[self.parents[best]]:
                if e != best and not self.side[e] and self.tags[e] == self.tags[best] and scores[e] >= 0.2 * scores[best]:
                    chosen.add(e)
        else:
            self._keep_around(best, chosen, children, chars, density, prose, scores)
        inside = [False] * count
        for e in range(count):
            inside[e] = (e in chosen or (e > 0 and inside[self.parents[e]])) and not self.side[e]
        return inside

    def _keep_around(self, best: int, chosen: set[int], children: list[list[int]], chars: list[int], density: list[float],
                     prose: list[bool], scores: list[float]) -> None:
        """Siblings of the container, and of the wrappers around it that hold prose elsewhere."""
        node = best
        while (up := self.parents[node]) >= 0:
            beside = [e for e in children[up] if e != node and not self.side[e] and chars[e]]
            low = [e for e in beside if density[e] < 0.33 and (prose[e] or self.tags[e] in COMPANIONS) or self.tags[e] in HEADINGS
                   or node == best and scores[e] >= 0.2 * scores[best]]
            if node == best or self.tags[up] not in ("#root", "html", "body") and any(prose[e] for e in low):
                chosen.update(low)
            node = up

    def text(self) -> str:
        inside = self.kept()
        blocks, parts = [], []
        for e, text in self.items:
            if text is None:
                if parts:
                    blocks.append(" ".join("".join(parts).split()))
                    parts = []
            elif inside[e]:
                parts.append(text)
        if parts:
            blocks.append(" ".join("".join(parts).split()))
        return "\n\n".join(b for b in blocks if b)


def main_text(html: str) -> str:
    return Page(html).text() if html else ""


def _extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(parts):
        texts = [main_text(h) for h in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()),
                                          pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                        text_of(pages, "html").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
