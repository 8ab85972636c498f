"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. A block knows its text, how much of it is in links, and which marks the
parts carry that it lies in. The first pass puts every block of every page into one class by three measures: a block
of many links is bad; a short one is open; of the others, one whose stop words are as dense as in running text is good if it
is long and near to good if not, one of fewer stop words is near, one of hardly any is bad. Scripts without spaces have
a density of their own, that of their function characters, and their characters count for more. Where no block of a
page reaches the density of running text, its language isn't in the lists, and length and links decide alone.

The second pass decides the rest from neighbours: near blocks are good beside a good one or where no block is good, open
blocks take the label of their nearest decided neighbours, and a heading is good before a good block.

Marks, which are tags, roles and words of class and id, are priors that move a class, weighed against the text:
- what says it is a menu, footer, sidebar, notice, advert or form is bad, unless the page marks no article elsewhere and
  the part has more than half of the page's long running text: then the mark is no longer believed.
- comments read like the article, so no measure tells them, but they follow something: what is named after them is
  believed if running text or a part of the article comes before it. What begins the page's text is the article,
  in a part whose class says that it may be commented on. The whole page and an article's own tag are never comments.
- vaguer words (promotion, header, tags and such) make open and near blocks bad; long running text stays good.
- an article mark is believed if the marked parts have at least half of the page's running text. Then what is
  outside of them is bad but for a heading just before them; inside, near blocks are good, those of few stop words are
  open, and open ones are bad only between bad ones, since a whole article may be short.

Defined cases: null or empty html gives an empty text; unclosed or stray tags end with what holds them; character
references are decoded; a null page_id or url is kept; repeated rows each get their row; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

#: Frequent function words of languages that pages come in.
STOP_WORDS = frozenset(
    # English
    "a all an and are as at be but by can for from had has have he her his i if in is it its not of on or our she so that the their there they this to was we were what when which who will with would you "
    # German
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für ich ihr im ist mit nach nicht noch oder sich sie sind so um und uns von vor war wie wir wird zu zum zur "
    # French
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    # Spanish
    "al como con del el en era es esta este ha las lo los más me mi muy no nos para pero por se si sin su sus también un una y "
    # Italian, Portuguese
    "che da dei della di è gli il non per sono come ao com da do dos em e foi mais não o os pela uma".split()
)
#: Function characters and words of scripts without spaces.
FUNCTION_MARKS = re.compile("[的了是在和有不这這我他们們就也都与與为為而及之于於以被把]|[ぁ-ん]|ที่|และ|ของ|ใน|การ|เป็น|ได้|ให้|ว่า|ไม่|จะ|มี")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")

#: Tags that start a block, those without content of their own, and those whose content is never text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button datalist head title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Marks of what isn't of the article: tags, roles, and words of a class or id, clear ones and vague ones.
OUTSIDE = frozenset("nav footer aside form menu dialog search header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_word = lambda words: re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.IGNORECASE)
CLEAR_NAMES = _word(
    r"ads?|advert\w*|adbox|adsense|sponsor\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|crumbs?|masthead|topbar|footer|sidebar|aside|related|recommend\w*|social|share|sharing|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|searchform|pagination|pager"
)
VAGUE_NAMES = _word(r"banner|promo\w*|header|foot|side|rail|widgets?|form|search\w*|copyright|legal|disclaimer|skip|toolbar|tags|byline|meta")
COMMENT_NAMES = _word(r"comments?|commentlist|replies|reply|disqus|respond")
HEADER_NAMES = re.compile(r"(?<![a-z])(?:header|headline|masthead|title)(?![a-z])", re.IGNORECASE)
ARTICLE_NAMES = _word(r"article|articlebody|post|entry|story|main|content|maincontent")

#: What counts as short and as long, in characters; shares of stop words; shares of linked text.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.25
LINKS, LINKS_INSIDE = 0.33, 0.8
#: Characters of other scripts that one without spaces counts for, and how dense its function characters count.
UNSPACED_SIZE, UNSPACED_STOPS = 3, 3.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*+(?:>|$)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<broken>[^>]*+)>)",
    re.DOTALL,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: Tags that an opening one of the same kind closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article aside body div footer form header main nav section table td th ul ol dl blockquote html".split())


class Block:
    """away: the outermost part that says it isn't of the article, talk: the innermost that says it is comments; 0 for none."""

    __slots__ = ("away", "first", "heading", "inside", "label", "linked", "parts", "talk", "text", "vague")

    def __init__(self, away: int = 0, talk: int = 0, vague: bool = False, inside: bool = False, heading: bool = False):
        self.parts, self.linked, self.away, self.talk, self.vague, self.inside, self.heading = [], 0, away, talk, vague, inside, heading

    def close(self) -> bool:
        self.text = _SPACE.sub(" ", unescape("".join(self.parts))).strip()
        return bool(self.text)


def blocks(html: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool, bool, bool]] = []  # tag, and what held before it: away, talk, vague, inside, linked
    away, talk, vague, inside, linked, n_parts = 0, 0, False, False, False, 0
    opened: Counter[str] = Counter()  # the tags of the stack, so that it isn't searched for what it doesn't hold
    endless: set[str] = set()  # tags of which no end is left on the page
    block = Block()
    at, n = 0, len(html)

    def text(raw: str) -> None:
        block.parts.append(raw)
        if linked:
            block.linked += len(_SPACE.sub(" ", unescape(raw)).strip())

    def turn(heading: bool = False) -> None:
        nonlocal block
        if block.close():
            out.append(block)
        block = Block(away, talk, vague, inside, heading)

    def cut(k: int) -> None:
        nonlocal away, talk, vague, inside, linked
        away, talk, vague, inside, linked = stack[k][1:]
        for tag, *_ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                text(m["cdata"].replace("&", "&amp;"))
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["broken"] or ""
        if not m["end"]:
            if tag in SILENT:
                if not attrs.endswith("/"):
                    close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
                    # an unclosed one ends with its page; head and title end where the body starts
                    if close is None:
                        endless.add(tag)
                        if tag in ("head", "title") and "body" not in endless:
                            close = re.compile(r"(?=<body\b)", re.IGNORECASE).search(html, at)
                            if close is None:
                                endless.add("body")
                    at = close.end() if close else (at if tag in ("head", "title") else n)
                if tag in BLOCK:
                    turn()
                continue
            if tag == "br":
                block.parts.append(" ")
                continue
            if tag in VOID:
                if tag in BLOCK:
                    turn()
                continue
            if tag in _CLOSES or tag in BLOCK:
                closes = _CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
                for k in range(len(stack) - 1, -1, -1) if any(opened[x] for x in closes) else ():
                    if stack[k][0] in closes:
                        cut(k)
                        break
                    if stack[k][0] in _SCOPE:
                        break
            stack.append((tag, away, talk, vague, inside, linked))
            opened[tag] += 1
            names = {a.lower(): (v or "").strip("\"'") for a, v in _ATTR.findall(attrs)}
            named = f"{names.get('class', '')} {names.get('id', '')}"
            hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
            if tag in BLOCK:
                role, own = names.get("role", "").lower(), tag in ("html", "body", "article", "main")
                comments = not own and bool(COMMENT_NAMES.search(named))
                article = tag in ("article", "main") or role in ("main", "article") or names.get("itemprop") == "articleBody" or bool(ARTICLE_NAMES.search(named))
                if inside:
                    named = HEADER_NAMES.sub(" ", named)
                whole = own or article
                says_away = hidden or (tag in OUTSIDE and not (tag == "header" and inside)) or role in ROLES or (not whole and bool(CLEAR_NAMES.search(named)))
                if comments:
                    n_parts += 1
                    talk = n_parts
                elif says_away and not away:
                    n_parts += 1
                    away = n_parts
                vague = vague or (not whole and bool(VAGUE_NAMES.search(named)))
                inside = inside or article
                turn(tag in HEADINGS)
            elif names and (hidden or CLEAR_NAMES.search(named)) and tag in ("span", "a", "ins"):
                if not away:
                    n_parts += 1
                    away = n_parts
                turn()
            if tag == "a":
                linked = True
        else:
            if opened[tag]:
                was = away
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                if tag in BLOCK or was != away:
                    turn()
            elif tag == "p":
                turn()
    turn()
    return out


def measures(b: Block) -> tuple[int, float, float]:
    """Size in characters, share of linked text and density of stop words."""
    text = b.text
    unspaced = len(_UNSPACED.findall(text))
    if 2 * unspaced > len(text):
        return len(text) + (UNSPACED_SIZE - 1) * unspaced, b.linked / len(text), min(1.0, UNSPACED_STOPS * sum(map(len, FUNCTION_MARKS.findall(text))) / unspaced)
    words = _WORD.findall(text.lower())
    return len(text), b.linked / len(text), sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(size: int, links: float, stops: float) -> str:
    """The class of a block by its measures alone: good, near (to good), open or bad."""
    if links > LINKS:
        return "bad"
    if size < LENGTH_LOW:
        return "open"
    if stops >= STOPS_HIGH:
        return "good" if size > LENGTH_HIGH else "near"
    return "near" if stops >= STOPS_LOW else "bad"


def _neighbours(labels: list[str]) -> list[tuple[tuple[str, int], tuple[str, int]]]:
    """For each block the label and distance of the decided ones before and after it."""
    far = len(labels) + 1
    sides = []
    for step in (1, -1):
        last, at, side = "", -far, []
        order = range(len(labels))[::step]
        for k in order:
            side.append((last, abs(k - at) if last else far))
            if labels[k] in ("good", "bad"):
                last, at = labels[k], k
        sides.append(side[::step])
    return list(zip(*sides, strict=True))


def _comments(found: list[Block]) -> set[int]:
    """The parts that are comments: those before which there is running text, or something of the article."""
    seen: dict[int, bool] = {}
    begun = False
    for b in found:
        if not seen.setdefault(b.talk, b.talk > 0 and begun) and not b.away:
            begun = begun or b.first in ("good", "near") or (b.inside and not b.vague and not b.heading)
    return {talk for talk, is_so in seen.items() if is_so}


def _believed(found: list[Block], sizes: list[int]) -> tuple[set[int], bool]:
    """The marked parts that aren't believed to be outside the article, and whether the article's mark is; found: no comments."""
    running, inside, held = 0, 0, {}
    long, article = 0, any(b.inside and not b.away for b in found)
    for b, size in zip(found, sizes, strict=True):
        if b.first == "good":
            long += size
            held[b.away] = held.get(b.away, 0) + size
    doubted = {part for part, size in held.items() if part and 2 * size > long and not article}
    for b, size in zip(found, sizes, strict=True):
        if b.first in ("good", "near") and (not b.away or b.away in doubted):
            running += size
            inside += size if b.inside else 0
    return doubted, any(b.inside and (not b.away or b.away in doubted) for b in found) and 2 * inside >= running


def second_pass(found: list[Block], labels: list[str]) -> list[str]:
    """Labels with every near and open one decided by its neighbours."""
    labels, some = list(labels), "good" in labels
    for k, (before, after) in [(k, x) for k, x in enumerate(_neighbours(labels)) if labels[k] == "near"]:
        labels[k] = "good" if not some or "good" in (before[0], after[0]) else "bad"
    out = []
    for b, label, (before, after) in zip(found, labels, _neighbours(labels), strict=True):
        if label == "open":
            label = after[0] if b.heading and after[0] == "good" else min(before, after, key=lambda x: x[1])[0] or "bad"
        out.append(label)
    return out


def _within(found: list[Block], labels: list[str]) -> list[str]:
    """The second pass among the blocks of a believed article: open ones are bad only between bad ones."""
    labels = ["good" if x == "near" else x for x in labels]
    pairs = zip(found, labels, _neighbours(labels), strict=True)
    return [("bad" if before[0] == after[0] == "bad" and not b.heading else "good") if x == "open" else x for b, x, (before, after) in pairs]


def classified(found: list[Block]) -> list[Block]:
    """The blocks with `first`, their class by measures alone, and `label`, good or bad."""
    measured = [measures(b) for b in found]
    # a language that no list knows: length and links decide alone
    known = any(size >= LENGTH_LOW and links <= LINKS and stops >= STOPS_LOW for size, links, stops in measured)
    for b, (size, links, stops) in zip(found, measured, strict=True):
        b.first = first_pass(size, links, stops if known else 1.0)
    comments = _comments(found)
    others = [k for k, b in enumerate(found) if b.talk not in comments]
    doubted, article = _believed([found[k] for k in others], [measured[k][0] for k in others])
    labels = []
    for b, (size, links, _) in zip(found, measured, strict=True):
        if b.talk in comments or (b.away and b.away not in doubted):
            label = "bad"
        elif article:
            # a heading may be one link, and a paragraph may have many; a short block of nothing else is a menu
            linky = links > LINKS_INSIDE and size < LENGTH_HIGH and not b.heading
            label = "bad" if not b.inside or linky else "open" if b.first == "bad" else b.first
        else:
            label = "bad" if "\xa9" in b.text and size < LENGTH_HIGH else b.first
        if b.vague and label in ("open", "near") and not b.away:
            label = "bad"
        labels.append(label)
    if article:
        at = [k for k, b in enumerate(found) if b.inside]
        for k, label in zip(at, _within([found[k] for k in at], [labels[k] for k in at]), strict=True):
            labels[k] = label
        for k, b in enumerate(found[:-1]):
            if b.heading and b.first == "open" and not (b.away or b.vague or b.inside or b.talk in comments) and found[k + 1].inside and labels[k + 1] == "good":
                labels[k] = "good"
    else:
        labels = second_pass(found, labels)
    for b, label in zip(found, labels, strict=True):
        b.label = label
    return found


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    return "\n".join(b.text for b in classified(blocks(html or "")) if b.label == "good")


def extracted(pages: DataFrame) -> DataFrame:
    """The columns of pages but html, with text and n_chars, its code points."""
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col("html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
