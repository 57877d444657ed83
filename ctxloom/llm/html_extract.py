"""HTML main text by two-pass block rules.

A page is cut at block-level tags. First pass: each block gets its word count, stop-word density and link density, and is
`good`, `bad` or undecided by these, inside a marked main region (article, main, or a class or id that says so) as outside:

  links over LINKS_HIGH of the characters: bad; inside a marked region a single link decides nothing
  LONG_WORDS words or more:                good with a stop-word density of STOP_LOW or more
  SHORT_WORDS words or more:               good with a stop-word density of STOP_HIGH or more
  all others:                              undecided (short, or without the stop words that prose has)

Tags and names are one more feature, and decide only what densities can't tell, as adverts and notices can be prose: menus, page headers,
footers, sidebars, notices, adverts, forms, reader comments and hidden elements (by tag, role, class or id) are bad, and so
is what lies outside the marked region of a page that has one. A class or id says so only if all its words do
(`cookie-notice`, `related-posts`; not `legal-history`). Scripts, styles and other unseen elements give no block.

Second pass: undecided blocks inherit the label of the nearest decided block of the same region (on a tie the
earlier one, for a heading the later one, in a marked region a good one); in a region without a decided block, that of the
region (good in a marked one), else of the nearest decided block of the page, else good.

Whole pages are read in time in proportion to their size, whatever their markup; nothing is capped. A tag whose quotes do not close ends at its first `>`; a page that breaks off
inside a tag loses that tag alone. Character references are decoded once, white space inside a block becomes one space,
blocks are trimmed and joined in page order by one space. Null or empty html: empty text. Repeated rows give equal
rows; extra columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, map_slices

SHORT_WORDS, LONG_WORDS = 8, 25
STOP_LOW, STOP_HIGH, LINKS_HIGH = 0.12, 0.25, 0.4

# Elements and names.
UNSEEN = "script style noscript template textarea select option button svg math iframe object canvas audio video map head title datalist".split()
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
REGIONS = "article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol search section table ul span p".split()
BAD_TAGS = "nav aside footer form menu dialog search".split()
BAD_NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner sidebar rail widget widgets "
    "menu nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar footer copyright legal cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login form search share sharing social related recommended recommendations "
    "comment comments commentlist replies reply respond disqus discussion skip toolbar"
).split()
COMMENT_NAMES = "comment comments commentlist replies reply respond disqus discussion related recommended recommendations".split()
#: Words that go with a bad name without changing what it says.
WITH_NAMES = (
    "box block list wrap wrapper container section area bar panel inner outer item items post posts article articles page site main top bottom left right upper lower "
    "header head title body content text link links icon icons button buttons group row col column module unit slot zone holder layout global primary secondary "
    "mobile desktop sticky fixed user reader thread policy message center x by first last small large big full js wp fb id the and to us"
).split()
MAIN_NAMES = "article articlebody content main maincontent post postcontent entry entrycontent story storybody bodytext".split()
BAD_ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split()
STOP_WORDS = frozenset((
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nicht noch oder sich sie sind und von war wie wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il je la le les leur mais ne nous on ont ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "al como con de del el ella en era es esta este ha la las le lo los más me no nos o para pero por que se ser si sin su sus también un una y ya"
).split())

_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=/\"'>]+)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"</?([a-zA-Z][^\s/><]*)")
_INSIDE = re.compile(r"[^>\"']*")
_LONG_NUMBER = re.compile(r"&#(?:\d{9,}|[xX][0-9a-fA-F]{9,});?")
_UNSEEN, _BLOCKS, _VOID, _REGIONS = map(frozenset, (UNSEEN, BLOCKS, VOID, REGIONS))
_BAD_TAGS, _BAD, _COMMENT, _MAIN, _ROLES, _WITH = map(frozenset, (BAD_TAGS, BAD_NAMES, COMMENT_NAMES, MAIN_NAMES, BAD_ROLES, WITH_NAMES))
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in UNSEEN}


class _Page:
    """The tags of a page. What is not found once is not looked for again, so a page is read in proportion to its size."""

    def __init__(self, page: str):
        self.page = page
        self.over: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where `what` begins at or after `at`; -1 if nowhere."""
        found = -1 if what in self.over else self.page.find(what, at)
        if found < 0:
            self.over.add(what)
        return found

    def close(self, tag: str, at: int) -> int:
        """The end of the next closing tag of an unseen element; -1 without one."""
        end = None if f"</{tag}" in self.over else _END[tag].search(self.page, at)
        if end is None:
            self.over.add(f"</{tag}")
            return -1
        found = self.find(">", end.end())
        return found + 1 if found >= 0 else len(self.page)

    def tag_end(self, at: int) -> int:
        """The place of the `>` that ends a tag whose inside begins at `at`; -1 if the page ends before it."""
        page, first = self.page, self.find(">", at)
        if first < 0:
            return -1
        while True:
            stop = _INSIDE.match(page, at).end()
            if stop >= len(page):
                return first
            if page[stop] == ">":
                return stop
            quote = page[stop]
            if page[at:stop].rstrip()[-1:] != "=":  # a quote elsewhere is a letter like others
                at = stop + 1
                continue
            end = self.find(quote, stop + 1)
            if end < 0 or page[end + 1:end + 2] not in (" ", "\t", "\n", "\r", "\f", "/", ">"):
                return first if first > stop else page.find(">", stop)
            at = end + 1

    def __iter__(self):
        """(text before, tag in lower case or "" for comments and the like, closing, attributes, place behind)."""
        page, at, text = self.page, 0, 0
        while (lt := self.find("<", at)) >= 0:
            behind = None
            if page.startswith("<!--", lt):
                end = self.find("-->", lt + 4)
                behind, found = (end + 3 if end >= 0 else len(page)), ("", False, "")
            elif page.startswith("<![CDATA[", lt):
                end = self.find("]]>", lt + 9)
                behind, found = (end + 3 if end >= 0 else len(page)), ("", False, "")
            elif page[lt + 1:lt + 2] in ("!", "?"):
                end = self.find(">", lt)
                behind, found = (end + 1 if end >= 0 else len(page)), ("", False, "")
            elif m := _TAG.match(page, lt):
                end = self.tag_end(m.end())
                if end >= 0:
                    behind, found = end + 1, (m[1].lower(), page[lt + 1] == "/", page[m.end():end])
                elif m[1].lower() in _KNOWN:
                    behind, found = len(page), ("", False, "")
            if behind is None:
                at = lt + 1
                continue
            at = (yield page[text:lt], *found, behind) or behind
            text = at
        yield page[text:], "", False, "", len(page)


_INLINE = "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
_KNOWN = frozenset([*UNSEEN, *BLOCKS, *VOID, *_INLINE])


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond every code point are the replacement character."""
    return _html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


class _Region:
    """An open element: whether it is boilerplate (1: structure, 2: comments and the like, 3: hidden) and in a main region."""

    __slots__ = ("bad", "main", "number", "tag")

    def __init__(self, tag: str, bad: int, main: bool, number: int):
        self.tag, self.bad, self.main, self.number = tag, bad, main, number


def _said(name: str) -> set[str]:
    """The bad names in a class or id that says nothing else."""
    words = {w.lower() for w in _NAME.findall(name) if not w.isdigit()}
    return words & _BAD if words <= _BAD | _WITH else set()


def _region(tag: str, raw: str, parent: _Region, number: int) -> _Region:
    bad, main = parent.bad, parent.main
    attributes = {}
    if raw and raw.strip():
        for name, value, alone in _ATTRIBUTE.findall(raw):
            attributes[(name or alone).lower()] = value.strip("\"'")
    if attributes:
        said = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        names = {w for x in said.split() for w in _said(x)}
        whole = {re.sub(r"[^a-z]", "", x.lower()) for x in said.split()}
        style = attributes.get("style", "").replace(" ", "").lower()
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            bad = max(bad, 3)
        if tag not in ("body", "html"):
            starts = tag in ("article", "main") or whole & _MAIN or attributes.get("role") in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
            if names & _COMMENT:
                bad = max(bad, 2)
            elif starts and bad < 2:
                bad, main = 0, True
            elif names & _BAD or attributes.get("role", "").lower() in _ROLES or ("header" in whole and not main):
                bad = max(bad, 1)
    if tag in ("article", "main") and bad < 2:
        bad, main = 0, True
    elif tag in _BAD_TAGS or (tag == "header" and not main):
        bad = max(bad, 1)
    return _Region(tag, bad, main, number)


def blocks(page: str | None) -> list[dict]:
    """The page's text blocks in order, with their measures, region and label (after both passes)."""
    out: list[dict] = []
    stack = [_Region("", 0, False, 0)]
    opened: Counter = Counter()
    text: list[str] = []
    linked: list[str] = []
    links = in_link = numbers = 0
    marked = False

    def flush(heading: bool = False) -> None:
        nonlocal links
        if text:
            words = unescaped("".join(text)).split()
            if words:
                top = stack[-1]
                letters = _WORD.findall(" ".join(words).lower())
                n, chars = len(letters), sum(map(len, words))
                out.append({
                    "text": " ".join(words), "words": len(words), "region": top.number, "main": top.main, "bad": top.bad,
                    "stops": sum(w in STOP_WORDS for w in letters) / n if n else 0.0, "n_links": links,
                    "heading": heading, "links": min(1.0, sum(len(x) for s in linked for x in unescaped(s).split()) / chars),
                })
            text.clear()
        linked.clear()
        links = in_link

    def leave(at: int) -> None:
        opened.subtract([r.tag for r in stack[at:]])
        del stack[at:]

    tokens = iter(tags := _Page(page or ""))
    got = next(tokens)
    while got is not None:
        said, tag, closing, raw, behind = got
        if said:
            text.append(said)
            if in_link:
                linked.append(said)
        back = None
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
            links += in_link
        if tag in _UNSEEN:
            if not closing and not raw.endswith("/") and tag != "head":
                end = tags.close(tag, behind)
                back = end if end >= 0 else len(tags.page) if tag in ("script", "style", "textarea", "title") else None
        elif tag:
            if tag in _BLOCKS:
                flush(closing and tag in HEADINGS)
            if tag in _REGIONS and tag not in _VOID or opened["p"] and tag in _BLOCKS:
                if closing:
                    for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                        if stack[i].tag == tag:
                            leave(i)
                            break
                        if tag in ("span", "p") and stack[i].tag not in ("span", "p"):
                            break
                else:
                    for i in range(len(stack) - 1, 0, -1) if opened["p"] and tag in _BLOCKS else ():  # an open p ends where a block begins
                        if stack[i].tag == "p":
                            leave(i)
                            break
                        if stack[i].tag != "span":
                            break
                    if tag in _REGIONS and tag not in _VOID:
                        parent = stack[-1]
                        if tag in ("article", "main") or raw:
                            region = _region(tag, raw, parent, parent.number)
                        elif tag in _BAD_TAGS or tag == "header":
                            region = _region(tag, "", parent, parent.number)
                        else:
                            region = _Region(tag, parent.bad, parent.main, parent.number)
                        if (region.bad, region.main) != (parent.bad, parent.main):
                            numbers += 1
                            region.number = numbers
                            if tag == "span":
                                flush()
                        marked |= region.main and not region.bad
                        if not raw.endswith("/") or tag in ("p", "div", "span"):
                            stack.append(region)
                            opened[tag] += 1
        try:
            got = tokens.send(back)
        except StopIteration:
            got = None
    flush()
    for b in out:
        b["label"] = "bad" if b["bad"] or (marked and not b["main"]) else _first_pass(b)
    _second_pass(out)
    return out


def _first_pass(b: dict) -> str:
    """The label of a block's own length, stop-word density and link density, or "" for an undecided one."""
    if b["links"] > LINKS_HIGH:
        return "" if b["main"] and b["n_links"] < 2 else "bad"
    least = STOP_LOW if b["words"] >= LONG_WORDS else STOP_HIGH if b["words"] >= SHORT_WORDS else 2.0
    return "good" if b["stops"] >= least else ""


def _second_pass(out: list[dict]) -> None:
    decided = [i for i, b in enumerate(out) if b["label"]]
    regions: dict[int, list[int]] = {}
    for i in decided:
        regions.setdefault(out[i]["region"], []).append(i)
    labels = [b["label"] for b in out]
    before: dict[int, int] = {}
    after: dict[int, int] = {}
    nearest: list[tuple[int | None, int | None]] = [(None, None)] * len(out)
    for i, b in enumerate(out):
        if labels[i]:
            before[b["region"]] = before[-1] = i
        else:
            nearest[i] = (before.get(b["region"]), None)
    for i in range(len(out) - 1, -1, -1):
        b = out[i]
        if labels[i]:
            after[b["region"]] = after[-1] = i
        else:
            nearest[i] = (nearest[i][0], after.get(b["region"]))
    last = None
    following = [None] * len(out)
    for i in range(len(out) - 1, -1, -1):
        following[i] = last
        if labels[i]:
            last = i
    last = None
    for i, b in enumerate(out):
        if labels[i]:
            last = i
            continue
        near = [j for j in nearest[i] if j is not None]
        if not near and b["main"]:
            b["label"] = "good"
            continue
        near = near or [j for j in (last, following[i]) if j is not None]
        b["label"] = labels[min(near, key=lambda j: (abs(j - i), b["main"] and labels[j] != "good", -j if b["heading"] else j))] if near else "good"


def main_text(page: str | None) -> str:
    return " ".join(b["text"] for b in blocks(page) if b["label"] == "good")


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars."""
    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(p) for p in column_of(batch, "html").to_pylist()]
        return {"page_id": column_of(batch, "page_id"), "url": column_of(batch, "url"), "text": texts, "n_chars": [len(t) for t in texts]}

    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return map_slices(pages, run, f"{', '.join(kinds)}, text string, n_chars long", column="html")


def extract_blocks(pages: DataFrame) -> DataFrame:
    """Every block with its measures and label: page_id, block, text, words, stop_density, link_density, label."""
    def run(batch: pa.RecordBatch) -> dict:
        rows = [(i, k, b) for i, p in zip(column_of(batch, "page_id").to_pylist(), column_of(batch, "html").to_pylist(), strict=True) for k, b in enumerate(blocks(p))]
        return {
            "page_id": [r[0] for r in rows], "block": [r[1] for r in rows], "text": [r[2]["text"] for r in rows], "words": [r[2]["words"] for r in rows],
            "stop_density": [r[2]["stops"] for r in rows], "link_density": [r[2]["links"] for r in rows], "label": [r[2]["label"] for r in rows],
        }

    pages = pages.select("page_id", F.col("html").cast("string").alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return map_slices(pages, run, f"page_id {kind}, block int, text string, words int, stop_density double, link_density double, label string", column="html")
