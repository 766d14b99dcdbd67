"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Elements that are boilerplate by their tag, role, class or id are left
out. The first pass scores each block by stop-word density, length and link density, with a prior for blocks of an
article that holds its part of the page's dense text, and decides those with clear scores; short ones outside of articles
stay ambiguous. The second lets each ambiguous block inherit the labels of its nearest decided neighbours.

Defined results: a null or empty page, and one of boilerplate only, has an empty text of 0 characters; repeated rows are
each extracted for themselves; an empty table gives an empty result; other columns are ignored, whatever their names.
Unclosed comments and scripts run to the end of the page, unclosed elements to the end of what encloses them, and a tag
that never ends is the page's end. Time is linear in the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from .shared import Lists, fields, kind, map_rows, named, text_or_empty

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: The rest of a tag without angle brackets in its quotes: nearly all are so, and no try reads beyond the next bracket.
REST = re.compile(r"""(?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+>""")
SPECIAL = re.compile(r"[>\"']")
ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
# Elements by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("head nav footer aside form button select option input label svg canvas object audio video map menu dialog math".split())
SCOPE = frozenset(("article", "main"))
#: Each start tag ends these open elements, if they are open within the nearest of the second set.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
# Words of class and id names that mark boilerplate.
MARKS = frozenset(
    """ad ads adbox advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager
    sidebar sidebars widget widgets related recommended recommendations share sharing social comment comments disqus reply replies respond discussion footer header
    masthead topbar toolbar search form skip copyright disclaimer""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# Frequent words of English, French, German and Spanish.
STOP = frozenset(
    """the of and to in a is that for it as was with be by on not he his are this at from have or an they which you were her she there been their has will would
    le la les de des du et en un une que est pour qui dans sur pas au avec il elle ce par plus sont se ne aux mais ou
    der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es werden aus er hat dass sie nach bei einer um am sind noch wie
    el los las y del que por con su para como más pero sus este ya o porque esta entre cuando muy sin sobre también me hasta hay""".split()
)
SHORT, MAX_LINKS, LOW, HIGH = 70, 0.35, 0.10, 0.30
#: Scores from which a block is text, and up to which it is none.
GOOD, BAD = 1.0, -0.5
#: Articles with less of a page's dense text are teasers.
LEAST_DENSE = 0.3


def _boilerplate(name: str, attrs: str, scoped: bool) -> bool:
    if name in DROP or name == "header" and not scoped:
        return True
    if not attrs or name in SCOPE or name in ("html", "body"):
        return False
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id"):
            marks = MARKS.intersection(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            if marks - {"header"} or marks and not scoped:
                return True
    return False


class TagEnds:
    """Where tags end: at the first ``>`` outside of quotes, or the first of all if a quote is never closed.

    Each quote's partner, and with it the end of all tags that come by it, is looked up once, whatever number of tags do."""

    def __init__(self, page: str):
        self.page, self.known = page, {}
        self.first, self.last = -1, max(map(page.rfind, ">\"'"))
        self.plain = -1

    def __call__(self, at: int) -> int:
        """For positions in rising order; -1 if there is no ``>`` any more."""
        page, path = self.page, []
        if self.plain < at:
            self.plain = page.find(">", at)
            if self.plain < 0:
                self.plain = len(page)
        if self.plain == len(page):
            return -1
        if self.first < at:
            self.first = SPECIAL.search(page, at).start()
        p, out = self.first, -1
        while True:
            if p in self.known:
                out = self.known[p]
                break
            path.append(p)
            if page[p] == ">":
                out = p
                break
            q = page.find(page[p], p + 1)
            if q < 0 or q >= self.last:
                break
            p = SPECIAL.search(page, q + 1).start()
        for p in path:
            self.known[p] = out
        return out if out >= 0 else self.plain


def blocks(page: str) -> list[tuple[str, float, bool]]:
    """(text, share of its characters in links, whether in an article) of each block outside boilerplate, in page order."""
    found: list[tuple[str, float, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate so far, in an article
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the elements of a name are
    outer: list[int] = []  # and those of block level
    parts: list[str] = []
    linked, in_link, breaks, at, look, size = 0, 0, 0, 0, 0, len(page)
    end_of = TagEnds(page)

    def flush() -> None:
        nonlocal linked, breaks
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, min(1.0, linked / len(text)), stack[-1][2] if stack else False))
            parts.clear()
        linked = breaks = 0

    def say(raw: str) -> None:
        nonlocal linked, breaks
        if raw and not (stack and stack[-1][1]):
            parts.append(raw)
            if in_link:
                linked += len(raw.strip())
            if breaks and not raw.isspace():
                breaks = 0

    def close(i: int) -> None:
        while len(stack) > i:
            name = stack.pop()[0]
            places[name].pop()
            if name in BLOCK:
                outer.pop()

    def last(names: tuple[str, ...]) -> int:
        return max((places[x][-1] for x in names if places[x]), default=-1)

    while at < size:
        start = page.find("<", look)
        if start < 0:
            say(page[at:])
            break
        if page.startswith("<!--", start):
            say(page[at:start])
            end = page.find("-->", start + 4)
            at = look = end + 3 if end >= 0 else size
            continue
        tag = NAME.match(page, start + 1)
        if not tag and page[start + 1 : start + 2] not in ("!", "?"):
            look = start + 1  # a character of the text
            continue
        if tag:
            rest = REST.match(page, tag.end())
            end = rest.end() - 1 if rest else end_of(tag.end())
        else:
            end = page.find(">", start)
        say(page[at:start])
        if end < 0:
            break
        at = look = end + 1
        if not tag:
            continue
        name, attrs = tag[2].lower(), page[tag.end() : end]
        if tag[1]:
            if name in BLOCK:
                flush()
            if name == "a":
                in_link = 0
            i = last((name,))
            if i >= 0 and (name in BLOCK or not outer or outer[-1] < i):
                close(i)
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                say("\n")
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*/?>", re.I).search(page, at)
            at = look = end.end() if end else size
            continue
        if name in BLOCK:
            flush()
            if outer and stack[outer[-1]][0] == "p":
                close(outer[-1])  # a block ends an open paragraph and what is open in it
            if name in ENDS:
                ended, within = map(last, ENDS[name])
                if ended > within:
                    close(ended)
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        dropped, scoped = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name == "a" and not dropped:
            in_link = 1
        places[name].append(len(stack))
        if name in BLOCK:
            outer.append(len(stack))
        stack.append((name, dropped or _boilerplate(name, attrs, scoped), scoped or name in SCOPE and not dropped))
    flush()
    return found


def _stops(text: str) -> float:
    words = text.split()
    return sum(w.lower().strip(".,;:!?()\"'") in STOP for w in words) / max(1, len(words))


def _holds_text(found: list[tuple[str, float, bool]], stops: list[float]) -> bool:
    """Whether the page's articles hold enough of its dense text, or of its longer blocks if none has stop-words, to be its main text."""
    long = [(len(text), scoped, s) for (text, links, scoped), s in zip(found, stops) if links <= MAX_LINKS and len(text) >= SHORT]
    dense = [x for x in long if x[2] >= LOW] or long
    return sum(n for n, scoped, _ in dense if scoped) >= LEAST_DENSE * sum(n for n, *_ in dense)


def score(text: str, links: float, stops: float, prior: float) -> float:
    """How much a block looks like text: stop-word density and length against links, on top of what its place says."""
    dense = min(1.0, (stops - LOW) / (HIGH - LOW)) if stops >= LOW else 2 * (stops - LOW) / LOW
    length = max(-1.0, min(1.5, math.log2(len(text) / SHORT)))
    return dense + length + prior - 8 * max(0.0, links - MAX_LINKS)


def classify(found: list[tuple[str, float, bool]]) -> list[bool]:
    """True for blocks of the main text."""
    density = [_stops(text) for text, *_ in found]
    has_scope = any(x[2] for x in found) and _holds_text(found, density)
    inside = [has_scope and scoped for *_, scoped in found]
    scores = [score(text, links, stops, 2.0 * own) for (text, links, _), stops, own in zip(found, density, inside)]
    labels: list[bool | None] = []
    for (text, links, _), own, x in zip(found, inside, scores):
        short = len(text) < SHORT
        if links > MAX_LINKS and not own or x <= BAD and (links > MAX_LINKS or not short):
            labels.append(False)
        else:
            labels.append(True if x >= GOOD and (own or not short) else None)
    if all(x is None for x in labels) and not has_scope:  # nothing to inherit
        return [True] * len(found)
    near: list[list[bool]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[bool, bool] = {}  # the nearest decided label, in and outside of articles
        for i in order:
            if labels[i] is not None:
                last[inside[i]] = labels[i]
            elif inside[i] in last:
                near[i].append(last[inside[i]])
    votes = (sum(1 if y else -1 for y in ys) + (1.0 if own else -0.5) + max(-0.4, min(0.4, x)) for ys, own, x in zip(near, inside, scores))
    return [vote > 0 if x is None else x for x, vote in zip(labels, votes)]


def extract(page: str) -> str:
    found = blocks(page)
    return "\n\n".join(x[0] for x, kept in zip(found, classify(found)) if kept)


def _extract(rows: Lists) -> dict[str, list]:
    texts = [extract(x) for x in rows["_html"]]
    return {"text": texts, "n_chars": [len(x) for x in texts]}


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page. No shuffle: each page stands alone."""
    read = pages.select(named(id_col).alias("page_id"), named(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("_html"))
    return map_rows(read, _extract, fields(("page_id", kind(pages, id_col)), "url string, text string, n_chars long"))
