"""Main text of web pages by two passes of block rules.

A page is cut into blocks. The first pass labels a block by its place (menus, footers, adverts and the like are never
content), by its link density, its length and its stop-word density; what is too short to tell stays open. In the
second pass an open block takes the label of the nearest decided block in its part of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from .common import slices
from .quality_rules import STOP_WORDS

#: Blocks with a greater share of their characters in links are menus.
LINK_DENSITY = 0.5
#: A block of so many words and such a share of stop words is content.
LONG_WORDS, STOP_DENSITY = 8, 0.12

#: Elements whose text is never content.
CHROME = frozenset("nav footer aside form script style noscript template svg iframe button select option textarea dialog menu head title object canvas".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run on within a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Words in a class, id or role that mark a part of the page as not content.
CHROME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|masthead|toolbar|"
    r"cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|search\w*|share|sharing|social\w*|"
    r"comments?|commentlist|disqus\w*|repl(?:y|ies)|respond|reader-comments?|related\w*|recommend\w*|widget\w*|pagination|pager|complementary|contentinfo|navigation|hidden)(?=$|[\s_-])", re.I)
#: Whole names that also mark a part of an article as not of its text, alone or as the first or last part of a compound.
CERTAIN_NAME = re.compile(
    r"(?:[\w-]*[_-])?(?:ads?|advert\w*|adsense|sponsor\w*|promo|banner|newsletter|subscribe|signup|share|sharing|social|comments?|commentlist|disqus|repl(?:y|ies)|respond|"
    r"sidebar|related|cookies?|consent|notice|popup|modal|breadcrumbs?|pagination|nav|menu|navigation|complementary|contentinfo|search|footer|hidden|widget)(?:[_-](?:box|bar|block|list|section|area|form|wrap|wrapper|container|links|buttons?|posts?|articles|thread|slot|unit|\d+))?", re.I)
HEADING = re.compile(r"h[1-6]")
#: Names that tell what a part goes with, not what it is; and those of a site's header outside of the article.
STATE_NAME = re.compile(r"(?:has|with|without|no|js|is)-", re.I)
HEADER_NAME = re.compile(r"(?:(?:site|page|top|global|main)[_-]?)?header|top-?bar", re.I)
MAIN = frozenset(["article", "main"])
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<end>/)?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(?=/?[A-Za-z])[^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Scripts written without spaces; two of their letters count as a word.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
#: An article or main element that holds less than this share of the page's content is taken for a card or teaser.
REGION_SHARE = 0.25
STOPS = frozenset(STOP_WORDS)
WORD = re.compile(r"\w+")


class Block(NamedTuple):
    text: str
    link_chars: int
    chrome: bool
    part: int
    main: bool
    heading: bool
    para: bool = False


def _not_content(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in CHROME or tag == "header" and not in_main:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    # The first of attributes of one name counts.
    own: dict[str, str] = {}
    for name, *value in ATTRIBUTE.findall(attrs):
        own.setdefault(name.lower(), "".join(value))
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or NO_DISPLAY.search(own.get("style", "")):
        return True
    if tag in MAIN:
        return False
    # Ids of headings and of parts of an article are anchors named by their titles.
    used = ("class", "role") if in_main or HEADING.fullmatch(tag) else ("class", "role", "id")
    names = [n for key in used for n in own.get(key, "").split() if not STATE_NAME.match(n)]
    if in_main:
        return any(CERTAIN_NAME.fullmatch(n) for n in names) or own.get("id", "").lower() in ("comments", "respond", "disqus_thread")
    return any(CHROME_NAME.search(n) or HEADER_NAME.fullmatch(n) for n in names)


def _length(text: str) -> int:
    """Words of a text; two letters of a script without spaces count as one."""
    letters = len(UNSPACED.findall(text))
    return len(WORD.findall(text)) if not letters else len(WORD.findall(UNSPACED.sub(" ", text))) + letters // 2


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in order. ``part`` numbers the stretches between changes of the enclosing region."""
    blocks: list[Block] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, not content, main, link
    # Places of the stack's block elements, how many of each name are open, and the open inline elements above each of them.
    places: list[int] = []
    opened: Counter[str] = Counter()
    above: list[Counter[str]] = [Counter()]
    linked = part = 0
    heading = False

    def flush() -> None:
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            chrome = bool(stack) and stack[-1][1]
            blocks.append(Block(text, linked, chrome, part, bool(stack) and stack[-1][2], heading,
                                bool(places) and stack[places[-1]][0] == "p"))
        pieces.clear()
        linked, heading = 0, False

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            pieces.append(raw)
            if stack and stack[-1][3]:
                linked += len(raw.strip())

    def close(depth: int) -> None:
        nonlocal part
        was = stack[-1][1:3]
        now = stack[depth - 1][1:3] if depth else (False, False)
        if was != now:
            flush()
            part += 1
        for tag, *_ in reversed(stack[depth:]):
            if tag in INLINE:
                above[-1][tag] -= 1
            else:
                above.pop()
                places.pop()
                opened[tag] -= 1
        del stack[depth:]

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at: m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                say(m["cdata"].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if m["end"]:
            # An inline end tag does not close the region around it. Only what will be closed is walked over.
            if above[-1][tag] if tag in INLINE else opened[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in VOID or m["attrs"].endswith("/") and tag not in INLINE and tag not in ("p", "div"):
            continue
        if tag not in INLINE:
            if places and (stack[places[-1]][0] == "p" or stack[places[-1]][0] == tag == "li"):
                close(places[-1])
        _, chrome, main, link = stack[-1] if stack else ("", False, False, False)
        now = chrome or _not_content(tag, m["attrs"], main), main or tag in MAIN
        if now != (chrome, main):
            flush()
            part += 1
        if tag in INLINE:
            above[-1][tag] += 1
        else:
            places.append(len(stack))
            opened[tag] += 1
            above.append(Counter())
        stack.append((tag, *now, link or tag == "a"))
        heading = heading or HEADING.fullmatch(tag) is not None
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return blocks


def first_pass(block: Block) -> bool | None:
    """True for content, False for other text, None for what is too short or too odd to tell."""
    if block.chrome:
        return False
    if block.link_chars > LINK_DENSITY * len(block.text):
        # A paragraph of an article may be one link; it goes by its neighbours.
        return None if block.main and block.para else False
    words = WORD.findall(block.text.lower())
    if len(words) >= LONG_WORDS and sum(w in STOPS for w in words) >= STOP_DENSITY * len(words):
        return True
    return None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided block, in blocks, of the same part; of two as near, content
    wins. Blocks of an article's region without any decided block are content; elsewhere they are if they are headings
    or longer than a menu entry."""
    n = len(blocks)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for order, into in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for k in order:
            if last is not None and blocks[last[0]].part != blocks[k].part:
                last = None
            into[k] = last
            if labels[k] is not None:
                last = (k, labels[k])
    out = []
    for k, label in enumerate(labels):
        if label is None:
            near = sorted((abs(x[0] - k), not x[1]) for x in (before[k], after[k]) if x is not None)
            label = not near[0][1] if near else blocks[k].main or blocks[k].heading or _length(blocks[k].text) >= LONG_WORDS
        out.append(label)
    return out


def main_text(page: str) -> str:
    """The content blocks of a page, joined by a space. Where the page's article or main elements hold
    ``REGION_SHARE`` of the content, blocks outside of them are left out."""
    blocks = page_blocks(page)
    labels = second_pass(blocks, [first_pass(b) for b in blocks])
    held = sum(len(b.text) for b, label in zip(blocks, labels) if label and b.main)
    inside = held > 0 and held >= REGION_SHARE * sum(len(b.text) for b, label in zip(blocks, labels) if label)
    return " ".join(b.text for b, label in zip(blocks, labels) if label and (b.main or not inside))


def extract_text(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``df`` without ``page`` and with ``out``, the main text, and ``n_chars``, its number of code points.

    Null and empty pages, and pages without content, give an empty text. Rows stay as they are, repeated ones too; columns
    named like a result are replaced. Pages are worked on whole, one at a time, without a shuffle; an empty table
    gives an empty result.
    """
    rest = [c for c in df.columns if c not in (page, out, "n_chars")]
    chosen = df.select(*[f"`{c}`" for c in rest], df[f"`{page}`"].alias("__page"))
    schema = StructType([df.schema[c] for c in rest]).add(out, StringType(), False).add("n_chars", LongType(), False)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__page"):
                texts = [main_text(x) if x else "" for x in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))],
                    names=[*rest, out, "n_chars"])

    return chosen.mapInArrow(run, schema)
