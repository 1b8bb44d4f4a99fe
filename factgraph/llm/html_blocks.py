"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  First pass: a block with many
characters in links, or inside an element that is furniture by its tag or its
class (a whole token; one on a wrapper of the page's text doesn't count), is bad; a long block with many stop words is good; what is short, or
has some stop words, stays undecided.  Where most text in long blocks has few stop
words, the page is in another language, or is no prose: such blocks are then
judged by their length alone.  On other pages a block with few of them, such as
code, is good between two good ones and bad elsewhere.  Second pass: a block
with some stop words is good beside a good one; any other takes the verdict of
the nearest decided block, where at equal distance a bad one wins, except over
a heading before a good one.  On a page without any good block all undecided
ones are good.  An ``article`` or ``main`` element is taken as the author's own
mark: undecided blocks in it look for neighbours in it only, and are good when
none is decided.

Nulls and empty pages give an empty text.  Pages are read whole.  Broken
markup is read as far as it goes: unclosed elements end with their parents, a
lone ``<`` is text.  Repeated rows give a row each; a null ``page_id`` or
``url`` stays null.  Other columns are not read.
"""

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LONG = 140                   # characters of a long block
SHORT = 70                   # below, a block outside of an article is undecided whatever it holds
MAX_LINKS = 0.35             # share of characters in links
LOW_STOPS, HIGH_STOPS = 0.12, 0.28

# Frequent words of English, German, French and Spanish
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or our she that the "
    "their there they this to was we were which who will with you "
    "als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für haben hat ich ihr im ist "
    "mit nach nicht oder sein sich sie sind so über um und von war wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour "
    "que qui sa se ses son sont sur un une vous "
    "al como con del e el ella en era es esta este ha la las lo los más me no o para pero por que se si sin sobre su "
    "sus también un una y ya".split())

DROPPED = ("script", "style", "template", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "audio",
           "video", "title", "textarea")
FURNITURE = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "fieldset"}
MAIN = {"article", "main"}
# elements that are kept on the stack of open ones
NESTING = FURNITURE | MAIN | {"header", "div", "section", "ul", "ol", "dl", "table", "figure", "details", "blockquote",
                              "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          # formulas are read as they stand in their sentence
          "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mstyle", "mpadded", "mphantom", "merror",
          "menclose", "mfenced", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover",
          "mmultiscripts", "mprescripts", "none", "mtable", "mtr", "mtd"}
# Whole tokens of a class or an id, with what commonly stands before and behind
HINTS = re.compile(
    r"(?:(?:site|page|global|top|bottom|left|right|primary|secondary|main|mobile|cookie|social|footer|header|nav|user)-)*"
    r"(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|sidebar\w*|side-bar|menu\w*|nav|navbar\w*|navigation|breadcrumbs?|"
    r"footer\w*|header|masthead|cookies?|consent|notices?|alerts?|popup\w*|modal|newsletters?|subscribe|subscription|signup|"
    r"share|sharing|social|related|recommended|login|search|pagination|pager|widgets?|toolbar|skip-link|copyright|disclaimer)"
    r"(?:-(?:wrap|wrapper|container|box|area|list|bar|section|block|inner|menu|nav|links?|items?|banner|notice|form|buttons?|"
    r"icons?|widgets?|posts?|articles?|overlay|consent|text|top|bottom|left|right|primary|secondary|\d+))*")
# what readers write is never the page's own text
REPLIES = re.compile(r"(?:post-)?(?:comments?|commentlist|respond|replies|disqus)(?:-(?:wrap|wrapper|container|box|area|list|"
                     r"section|block|inner|form|body|thread|\d+))*")
STATES = re.compile(r"(?:has|no|with|without|is|not|js)-.*|.*-(?:open|closed|enabled|disabled|active|inactive|visible)")
ROLES = re.compile(r"role\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|menu|form)\b", re.I)
NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef]")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(DROPPED) + r")(?=[\s/>])[^>]*+(?:(?<=/)>|>.*?(?:</\1\s*+>|\Z))|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S | re.I)


def furniture(tag: str, attributes: str, in_main: bool) -> str:
    """``hard`` by tag, role or readers' words, ``soft`` by a class or id only, else empty."""
    if tag in FURNITURE or tag == "header" and not in_main:
        return "hard"
    if not attributes:
        return ""
    if tag not in MAIN and (ROLES.search(attributes) or HIDDEN.search(attributes)):
        return "hard"
    soft = False
    for name in (n for names in NAMES.findall(attributes) for n in "".join(names).lower().replace("_", "-").split()):
        if STATES.fullmatch(name):
            continue
        if REPLIES.fullmatch(name):
            return "hard"
        soft = soft or HINTS.fullmatch(name) is not None and not (in_main and (tag == "header" or name.endswith("header")))
    return "soft" if soft else ""


class Block:
    """Text between two block-level tags, and where it stands."""
    __slots__ = ("text", "length", "extent", "linked", "bad", "hint", "outer", "main", "heading", "verdict", "stops")

    def __init__(self, text: str, linked: int, bad: bool, hint: int, outer: int, main: int, heading: bool):
        self.text, self.length, self.extent, self.linked, self.bad, self.main = text, len(text), extent(text), linked, bad, main
        # number of the innermost element around it with a hint, and of the innermost one around its article; 0: none
        self.hint, self.outer, self.heading, self.verdict, self.stops = hint, outer, heading, None, None


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a page in order; ``main`` is the number of the article they are in, 0 outside.

    Elements with a hint are numbered as they begin; the second list names for each the one around it, 0 for none.
    Time and memory grow with the page, however deep its elements are nested.
    """
    found: list[Block] = []
    parts: list[str] = []
    linked = links = 0
    # (tag, inside furniture, article, innermost element with a hint, and the one around the article)
    stack: list[tuple[str, bool, int, int, int]] = []
    open_tags: dict[str, int] = {}
    around = [0]
    bad, main, mains, hint, outer, last_br = False, 0, 0, 0, 0, False
    block_bad = heading = False
    block_hint = 0

    def close():
        nonlocal linked, block_bad, block_hint, heading
        raw = "".join(parts)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            found.append(Block(text, linked, bad or block_bad, block_hint or hint, outer, main, heading))
        parts.clear()
        linked, block_bad, block_hint, heading = 0, False, 0, False

    at = 0
    for m in TAG.finditer(page):
        text = page[at:m.start()]
        at = m.end()
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())
            if last_br and text.strip():
                last_br = False
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[2] else 1
            elif tag == "img":
                parts.append(" ")
            continue
        if tag == "br":
            if last_br:
                close()
            parts.append(" ")
            last_br = True
            continue
        close()
        links, last_br = 0, False
        if m[2]:
            if open_tags.get(tag):
                while True:
                    ended = stack.pop()[0]
                    open_tags[ended] -= 1
                    if ended == tag:
                        break
                bad, main, hint, outer = stack[-1][1:] if stack else (False, 0, 0, 0)
            continue
        attributes = m[4].rstrip(">")
        kind = furniture(tag, attributes, main > 0)
        own = kind == "hard" or tag == "head"
        own_hint = 0
        if kind == "soft":
            own_hint = len(around)
            around.append(hint)
        if tag in NESTING and not attributes.endswith("/"):
            if tag in MAIN and not main and not bad and not kind:
                mains += 1
                main, outer = mains, hint
            bad, hint = bad or own, own_hint or hint
            stack.append((tag, bad, main, hint, outer))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        else:
            block_bad, block_hint, heading = own, own_hint, tag in HEADINGS
    if page[at:]:
        parts.append(page[at:])
    close()
    return found, around


def extent(text: str) -> int:
    """Characters, where one of a script without spaces counts as three."""
    return len(text) if text.isascii() else len(text) + 2 * len(WIDE.findall(text))


def stop_share(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]#*$%&|<>-").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def settle_hints(page: list[Block], around: list[int]) -> None:
    """Blocks under a class hint are bad, unless it proves to be on a wrapper of the page's text.

    That is so when most text of good long blocks is below, or an article
    that stands for the page: all of that text, and no article outside of hints.
    Where such an article has text of its own, only hints in it can prove so.
    """
    if len(around) == 1:
        return
    long = [b for b in page if not b.bad and b.extent >= LONG and b.linked <= MAX_LINKS * b.length]
    for b in long:
        b.stops = stop_share(b.text)
    good = [b for b in long if b.stops >= HIGH_STOPS]
    few = [b for b in long if b.stops < LOW_STOPS]
    if sum(b.extent for b in few) > sum(b.extent for b in long) / 2:
        good = long
    if any(b.main and not b.hint for b in good):
        good = [b for b in good if b.main and not b.outer]
    total, held = sum(b.extent for b in good), [0] * len(around)
    for b in good:
        held[b.hint] += b.extent
    # an element begins after the one around it, so sums go up from the last to the first
    for hint in range(len(around) - 1, 0, -1):
        if around[hint]:
            held[around[hint]] += held[hint]
    wrapper = [2 * n > total for n in held]
    if not any(b.main and not b.outer for b in page):
        seen = set()
        for hint in {b.outer for b in page if b.main}:
            while hint and hint not in seen:
                seen.add(hint)
                hint = around[hint]
        for hint in seen:
            wrapper[hint] = wrapper[hint] or held[hint] == total
    wrapper[0] = True
    for hint in range(1, len(around)):
        wrapper[hint] = wrapper[hint] and wrapper[around[hint]]
    for b in page:
        b.bad = b.bad or not wrapper[b.hint]


def classify(page: list[Block], around: list[int]) -> None:
    """Sets every block's verdict to True (good) or False (bad)."""
    nearly, few = set(), set()
    settle_hints(page, around)
    for i, b in enumerate(page):
        if b.bad or b.linked > MAX_LINKS * b.length:
            b.verdict = False
        elif b.extent < SHORT:
            continue
        else:
            if b.stops is None:
                b.stops = stop_share(b.text)
            if b.stops >= HIGH_STOPS and (b.extent >= LONG or b.main):
                b.verdict = True
            elif b.stops >= LOW_STOPS:
                nearly.add(i)
            elif not b.main:
                few.add(i)
    weight = lambda places: sum(page[i].extent for i in places)
    if weight(few) > weight(i for i, b in enumerate(page) if b.verdict or i in nearly):
        for i in few:
            if page[i].extent >= LONG:
                page[i].verdict = True
            else:
                nearly.add(i)
        few = set()

    def nearest(places) -> list[tuple[int, bool, int]]:
        """For each block, the nearest decided one before it in this direction."""
        out, seen = {}, None
        for i in places:
            b = page[i]
            out[i] = (seen if seen and seen[2] == b.main else None) if b.main else seen
            if b.verdict is not None:
                seen = (i, b.verdict, b.main)
            elif b.main and seen and seen[2] != b.main:
                seen = None
        return out

    # furniture inside an article is passed over, so that it doesn't colour its neighbours
    inner = [i for i, b in enumerate(page) if not (b.main and b.verdict is False)]

    def settle(choose) -> None:
        before, after = nearest(inner), nearest(inner[::-1])
        settled = {i: choose(i, before[i], after[i]) for i in inner if page[i].verdict is None}
        for i, verdict in settled.items():
            page[i].verdict = verdict

    def long_one(i, left, right):
        """A nearly good block needs one good neighbour; short ones wait."""
        if i not in nearly:
            return None
        if left is None and right is None:
            return True
        return any(x is not None and x[1] for x in (left, right)) or None

    def between(i, left, right):
        """A block with few stop words needs good ones on both sides."""
        return bool(left and right and left[1] and right[1]) if i in few else None

    def short_one(i, left, right):
        if left is None and right is None:
            return True
        if left is None or right is None:
            return (left or right)[1]
        if left[1] != right[1] and i - left[0] == right[0] - i:
            return page[i].heading and right[1]
        return left[1] if i - left[0] < right[0] - i else right[1]

    settle(long_one)
    settle(between)
    if not any(b.verdict or b.main and b.verdict is None for b in page):
        for b in page:
            b.verdict = b.verdict is None
    settle(short_one)


def main_text(page: str | None) -> str:
    found, around = blocks(page or "")
    classify(found, around)
    return "\n".join(b.text for b in found if b.verdict)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars bigint")
