"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by
length, link density and stop-word density, and leaves short or unclear ones open; in
the second an open block takes the label of the nearest decided neighbours.

What encloses a block limits this. Elements that by their tag or role are no article (menus, forms, footers) are bad.
So are elements with such a name, since comments and notices read like prose; but names only speak
against a block as long as others are left: if none is, the passes run again without them. Article containers
vouch for what they hold, and blocks outside them are bad, unless prose outside is more than twice as long, as around teasers.

The scan is linear in the page: a tag ends at the first ">" outside quotes, and from a tag on that never
ends that way, tags end at the first ">".
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SHORT, LONG = 70, 200
LINKS_MOST, STOP_LOW, STOP_HIGH = 0.33, 0.2, 0.3

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be by for from has have he in is it its not of on or that the their they this to was were which will with you
    au aux avec ce ces cette dans de des du elle en est et il la le les mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une
    aber als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind so und von vor war wie wird zu zum zur
    al como con del desde el ella en entre era es esta este fue ha hay la las lo los más no o para pero por que se sin sobre su sus un una y""".split()
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select datalist".split())
#: Of these, what a page never closes holds the rest of it; any other is then an element like others.
_SWALLOW = frozenset("script style textarea title".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption head button legend optgroup option".split()
)
_SPACE = frozenset("br td th img input".split())
_AWAY = frozenset("nav footer aside form button menu dialog fieldset legend search".split())
_CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

# Parts of class and id names of what is not the article.
_AWAY_NAMES = frozenset(
    """ad ads adv advert advertisement advertising adsense adslot adbox adunit sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert warning
    nav navbar navigation menu menus submenu topbar toolbar breadcrumb breadcrumbs pager pagination sidebar sidebars aside rail widget widgets footer foot colophon masthead
    comment comments commentlist disqus respond responses reply replies discussion share sharing social related recommended recommendations newsletter subscribe subscription signup
    login popup modal overlay copyright skip paywall form search user users reader readers guest guests visitor visitors""".split()
)
_HEAD_NAMES = frozenset("header head masthead topbar".split())
_CONTENT_NAMES = frozenset("article content entry post story main maincontent articlebody postbody".split())
# Words in front of a name that say what the element has beside it, not what it is.
_BESIDE = frozenset("has have with without no not is show hide hides enable disable left right".split())

_OPENING = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*+")
_REST = re.compile(r"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>""")
_ATTR = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")


@dataclass
class Block:
    """links: characters within links. zone: 'away', 'content' or ''. named: in an element with a name of what is no article. part: which content container it is in, tagged: one by tag or role."""

    text: str
    links: int
    zone: str
    named: bool
    part: int
    heading: bool
    tagged: bool = False
    label: str = ""
    open_as: str = ""


@dataclass
class _Open:
    name: str
    away: bool = False
    named: bool = False
    content: bool = False
    tagged: bool = False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)} if raw.strip("/ \t\r\n") else {}


def _told(names: str) -> list[set[str]]:
    """The parts of each class or id name; a name that begins or goes on with "has" and the like tells only of what is in front of that."""
    out = []
    for name in names.split():
        parts = [p.lower() for p in _CAMEL.split(name) if p]
        cut = next((k for k, p in enumerate(parts) if p in _BESIDE), len(parts))
        out.append(set(parts[:cut]))
    return out


def _opened(name: str, raw: str, in_content: bool) -> _Open:
    if name in ("body", "html"):
        return _Open(name)
    given = _attributes(raw)
    told = [t for k in ("class", "id") if given.get(k) for t in _told(given[k])]
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
    away = name in _AWAY or role in _AWAY_ROLES or hidden or (name == "header" and not in_content)
    tagged = name in ("article", "main") or role in ("main", "article")
    # of several names, one that is wholly of content outweighs others; within one name it doesn't, as in "comment-content"
    content = tagged or (name in ("div", "section", "td") and any(t & _CONTENT_NAMES and not t & _AWAY_NAMES for t in told))
    named = not content and any(t & _AWAY_NAMES or (not in_content and name != "head" and t & _HEAD_NAMES) for t in told)
    return _Open(name, away, named, content and not away, tagged and not away)


# whatever stands behind the name, as browsers take it
_SHUT = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in _RAW}


def _tags(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text in front, tag name, whether it closes, attributes) along the page; the last one has no name. Raw elements come without what they hold."""
    at, quoted, unshut = 0, True, set()
    while m := _OPENING.search(page, at):
        text, start = page[at : m.start()], m.start()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            yield text, "", False, ""
            if end < 0:
                return
            at = end + 3
            continue
        name = _NAME.match(page, m.end() - 1) if m[0][-1] not in "!?" else None
        rest = _REST.match(page, name.end()) if name and quoted else None
        quoted = quoted and (not name or rest is not None)
        end = rest.end() if rest else page.find(">", name.end() if name else m.end()) + 1
        if not end:
            # a tag that the page ends in
            yield text, "", False, ""
            return
        at = end
        if not name:
            yield text, "", False, ""
            continue
        tag, raw, closing = name[0].lower(), page[name.end() : end - 1], page[start + 1] == "/"
        yield text, tag, closing, raw
        if tag in _RAW and not closing and not raw.rstrip().endswith("/"):
            shut = None if tag in unshut else _SHUT[tag].search(page, at)
            if shut:
                at = shut.end()
            elif tag in _SWALLOW:
                return
            else:
                unshut.add(tag)
    yield page[at:], "", False, ""


def blocks(page: str | None) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    held: list[str] = []
    linked = away = named = content = tagged = parts = in_link = 0
    heading = False
    open_: list[_Open] = []
    names: Counter = Counter()

    def pop() -> None:
        nonlocal away, named, content, tagged
        gone = open_.pop()
        names[gone.name] -= 1
        away -= gone.away
        named -= gone.named
        content -= gone.content
        tagged -= gone.tagged

    def cut() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                zone = "away" if away else "content" if content else ""
                out.append(Block(text, linked, zone, named > 0, parts if content else 0, heading, tagged > 0))
        held, linked = [], 0

    for text, name, closing, raw in _tags(page or ""):
        if text:
            text = html.unescape(text)
            held.append(text)
            if in_link:
                linked += len(" ".join(text.split()))
        if not name or name in _RAW:
            continue
        if name in _SPACE:
            held.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name in _BLOCK:
            cut()
            in_link = 0
            if name[0] == "h" and name[1:].isdigit():
                heading = not closing
        if name in _VOID:
            continue
        if closing:
            while names[name]:
                last = open_[-1]
                if last.away or last.named or last.content:
                    cut()
                pop()
                if last.name == name:
                    break
        elif name in _BLOCK or name == "a" or raw.strip():
            if name in _BLOCK:
                while open_ and open_[-1].name in _CLOSED_BY_BLOCK:
                    pop()
            new = _opened(name, raw, content > 0)
            marks = new.away or new.named or new.content
            if marks:
                cut()
            if new.content and not content:
                parts += 1
            if not raw.rstrip().endswith("/") and (name in _BLOCK or marks):
                open_.append(new)
                names[name] += 1
                away += new.away
                named += new.named
                content += new.content
                tagged += new.tagged
    cut()
    return out


def _stop_share(text: str) -> float:
    found = re.findall(r"[^\W\d_]+", text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def _reads_like_prose(b: Block) -> bool:
    return len(b.text) >= SHORT and b.links <= LINKS_MOST * len(b.text) and _stop_share(b.text) >= STOP_LOW


def _first_pass(found: list[Block], by_name: bool) -> bool:
    """Labels what is clear; returns whether containers hold the article."""
    left = [b for b in found if b.zone != "away" and not (by_name and b.named)]
    inside = sum(len(b.text) for b in left if b.zone == "content")
    outside = sum(len(b.text) for b in left if not b.zone and _reads_like_prose(b)) if inside else 0
    # a tag says what its element is; a mere name must also hold most of the prose
    contained = inside > 0 and outside <= (2 if any(b.tagged for b in left) else 1) * inside
    for b in found:
        n = len(b.text)
        share = b.links / n
        if b.zone == "away" or (by_name and b.named):
            b.label = "bad"
        elif contained and b.zone == "content":
            if share <= LINKS_MOST and (n >= SHORT or _stop_share(b.text) >= STOP_LOW):
                b.label = "good"
            else:
                b.open_as = "linked" if share > LINKS_MOST else "short"
        elif contained or share > LINKS_MOST or ("©" in b.text and n < LONG):
            b.label = "bad"
        elif n < SHORT:
            b.open_as = "linked" if b.links else "short"
        else:
            stop = _stop_share(b.text)
            if stop >= STOP_HIGH and n > LONG:
                b.label = "good"
            elif stop >= STOP_LOW or n > LONG:
                b.open_as = "near"
            else:
                b.label = "bad"
    return contained


def _second_pass(found: list[Block], by_name: bool, contained: bool) -> None:
    """Gives open blocks the label of their nearest decided neighbours, of those in the same container."""
    part = [b.part if contained else 0 for b in found]
    # what is set into a container says nothing of its neighbours
    firm = {k for k, b in enumerate(found) if b.label and not (part[k] and (b.zone == "away" or (by_name and b.named)))}
    before: list[tuple[int, Block] | None] = []
    after: list[tuple[int, Block] | None] = [None] * len(found)
    last: dict[int, tuple[int, Block]] = {}
    for k, b in enumerate(found):
        before.append(last.get(part[k]))
        if k in firm:
            last[part[k]] = (k, b)
    last = {}
    for k in range(len(found) - 1, -1, -1):
        after[k] = last.get(part[k])
        if k in firm:
            last[part[k]] = (k, found[k])
    for k, b in enumerate(found):
        if b.label:
            continue
        one, two = before[k], after[k]
        sides = [x for x in (one, two) if x]
        if not sides:
            # nothing near is decided: an article's own blocks stay, loose ones stay if they read like prose
            b.label = "good" if part[k] or b.open_as == "near" else "bad"
        elif len({x[1].label for x in sides}) == 1:
            b.label = sides[0][1].label if b.open_as != "near" or sides[0][1].label == "good" else "good" if len(sides) == 1 else "bad"
        else:
            near = min(sides, key=lambda x: abs(x[0] - k))
            tie = abs(one[0] - k) == abs(two[0] - k)
            b.label = ("good" if b.open_as == "near" or b.heading and two[1].label == "good" else "bad") if tie else near[1].label
            if b.heading and two[1].label == "good" and two[0] - k <= 2:
                b.label = "good"


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; empty if there is none."""
    found = blocks(page)
    for by_name in (True, False):
        _second_pass(found, by_name, _first_pass(found, by_name))
        if any(b.label == "good" for b in found) or not any(b.named for b in found):
            break
        for b in found:
            b.label = b.open_as = ""
    return "\n".join(b.text for b in found if b.label == "good")


def extract_main_text(pages: DataFrame, html_col: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its code points added.

    A null or empty page has the empty text; markup that is never closed ends with the page.
    Rows are independent: repeated rows come out alike, empty tables empty. Columns of ``pages``
    are carried; those named as the new ones are replaced.
    """
    pages = pages.select(*[c for c in pages.columns if c not in (text, n_chars)])
    at, width = pages.columns.index(html_col), len(pages.columns)
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(pages.schema.fields)]).add(f"c{width}", "string").add(f"c{width + 1}", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(p.as_py()) for p in batch.column(at)]
            arrays = [batch.column(k) for k in range(width)] + [pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])

    return pages.mapInArrow(run, schema).toDF(*pages.columns, text, n_chars)
