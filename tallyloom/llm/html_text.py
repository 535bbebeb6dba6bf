"""Main text of web pages by line-block distribution.

Markup is stripped so that every block of the page is one line. Each line has a weight, the length of
its text; menus, notices, link lists and the like have none. The weights are summed over sliding
windows of lines. Where the sum rises from nothing is a surge point, where it falls back to nothing a
dive point, and the text between is kept, provided that the sum in between reaches a threshold. An
article or main section only changes the weights: text inside counts more, text beside it less.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and name parts of HTML pages.
RAW = {"script", "style", "noscript", "textarea", "title", "iframe"}
EMBEDDED = {"svg", "object", "template"}
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button", "select"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn",
    "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
SECTIONS = {"article", "main"}
BOXES = {"div", "section", "ul", "ol", "dl", "p", "table", "span"}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|"
    r"newsletter|subscribe|sidebar|side-?bar|nav\w*|menu|breadcrumbs?|header|footer|comments?|replies|"
    r"disqus|share|social|related|recommend\w*|widget|toolbar)(?:$|[\s_-])",
    re.IGNORECASE,
)
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


@dataclass
class Tag:
    """A tag, or with an empty name a comment or a raw element with its content."""

    begin: int
    end: int
    name: str
    closing: bool
    attributes: str

    @property
    def closed(self) -> bool:
        return self.attributes.rstrip().endswith("/")


def tags_of(page: str) -> tuple[list[Tag], dict[int, int]]:
    """The tags of a page, and for each opening one that may be left out the number of its end tag."""
    tags: list[Tag] = []
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    at = 0
    while found := TAG.search(page, at):
        at = found.end()
        tag = Tag(found.start(), at, (found[2] or "").lower(), found[1] == "/", found[3] or "")
        if tag.name in RAW and not tag.closing and not (tag.closed and opened.get("svg")):
            close = re.compile(rf"</{re.escape(tag.name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = tag.end = close.end() if close else len(page)
            tag.name = ""
        elif tag.name in LEFT_OUT or tag.name in BOXES or tag.name in EMBEDDED:
            same = opened.setdefault(tag.name, [])
            if tag.closing and same:
                ends[same.pop()] = len(tags)
            elif not tag.closing and not tag.closed:
                same.append(len(tags))
        tags.append(tag)
    return tags, ends


def _after(page: str, tags: list[Tag], ends: dict[int, int], number: int) -> tuple[int, int]:
    """The first tag behind a left-out element, and the place in the page from which text counts again.

    A paragraph ends before the next block. An element that is never closed ends before an article or
    main section or the body.
    """
    name = tags[number].name
    if number in ends and name != "p":
        return ends[number] + 1, tags[ends[number]].end
    for place in range(number + 1, len(tags)):
        tag = tags[place]
        if name == "p" and tag.name == "p" and tag.closing:
            return place + 1, tag.end
        if name == "p":
            ended = tag.name not in INLINE and tag.name not in EMBEDDED and tag.name != ""
        else:
            ended = not tag.closing and (tag.name in SECTIONS or tag.name == "body")
        if ended:
            return place, tag.begin
    return len(tags), len(page)


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """The lines of a page: text, whether it is mostly links, whether it lies in a section.

    Tags that only wrap blocks make no lines; a block without text makes an empty one outside sections.
    """
    lines: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    linked = 0
    sections = 0
    in_link = False
    opened = ""  # the block that has begun with nothing in it so far
    tags, ends = tags_of(page)

    def finish(empty_block: bool = False) -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text or empty_block and not sections:
            lines.append((text, linked * 2 >= len(text), sections > 0))
        parts, linked = [], 0

    at, number = 0, 0
    while number < len(tags):
        tag = tags[number]
        if tag.begin > at:
            parts.append(page[at : tag.begin])
            linked += (tag.begin - at) * in_link
        at = tag.end
        name = tag.name
        if not name:
            number += 1
            continue
        if not tag.closing and (
            name in LEFT_OUT or name in EMBEDDED or name in BOXES and _noisy(tag.attributes)
        ):
            if tag.closed:
                number += 1
                continue
            if name not in EMBEDDED:
                finish()
                opened = ""
            number, at = _after(page, tags, ends, number)
            continue
        if name == "a":
            in_link = not tag.closing
        if name == "br":
            parts.append(" ")
        elif name not in INLINE:
            finish(tag.closing and opened == name)
            opened = "" if tag.closing or tag.closed else name
            if name in SECTIONS and not (tag.closed and not tag.closing):
                sections = max(0, sections + (-1 if tag.closing else 1))
        number += 1
    if at < len(page):
        parts.append(page[at:])
        linked += (len(page) - at) * in_link
    finish()
    return lines


def weights_of(
    lines: list[tuple[str, bool, bool]], window: int, section: float
) -> tuple[list[str], list[float]]:
    """The texts of lines and their weights.

    A line that is mostly links has no weight and no text, except in a section where fewer than
    `window` such lines follow each other. Text in a section counts `section` times; beside one it is
    divided by that. Where a section with text begins or ends, there are `window` empty lines.
    """
    has_sections = any(text and inside for text, _, inside in lines)
    texts: list[str] = []
    weights: list[float] = []
    before = None
    for (links, inside), run in groupby(lines, key=lambda line: (line[1], line[2])):
        own = [text for text, _, _ in run]
        if before is not None and before != inside:
            texts.extend([""] * window)
            weights.extend([0] * window)
        before = inside
        counts = not links or inside and len(own) < window
        factor = section if inside else 1 / section if has_sections else 1
        texts.extend(own if counts else [""] * len(own))
        weights.extend(len(text) * factor if counts else 0 for text in own)
    return texts, weights


def _noisy(attributes: str) -> bool:
    return bool(attributes) and any(
        NOISE.search(a or b or c or "") for a, b, c in NAMES.findall(attributes)
    )


def main_text(page: str | None, window: int = 3, threshold: int = 80, section: float = 4) -> str:
    """The text between surge and dive points, its blocks joined by a line break; null is empty.

    A region whose window sums stay below `threshold` is kept only where no region reaches it, the
    largest one then.
    """
    lines, weights = weights_of(lines_of(page or ""), window, section)
    sums = [sum(weights[max(0, end - window) : end]) for end in range(1, len(weights) + 1)]
    regions = []  # (peak, surge, dive)
    surge = None
    for place, total in enumerate([*sums, 0]):
        if total and surge is None:
            surge = place
        elif not total and surge is not None:
            regions.append((max(sums[surge:place]), surge, place))
            surge = None
    kept = [r for r in regions if r[0] >= threshold] or sorted(regions)[-1:]
    return "\n".join(
        lines[place] for _, first, end in kept for place in range(first, end) if lines[place]
    )


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Repeated rows and null ids keep their rows."""
    out = "page_id bigint, url string, text string, n_chars bigint"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(text) for text in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")
    )
    return narrow.mapInArrow(extract, out)
