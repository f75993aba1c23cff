"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags and doubled line breaks; scripts,
styles, titles and comments hold no text. The first pass labels each block by
itself: many link characters, a copyright sign or few stop words make it bad, a
block that is not short is good if it is rich in stop words, or long and of
middling density, and the others (short blocks without links, and those of
middling length and density) stay ambiguous. In the
second pass an ambiguous block takes the label of the nearest decided block;
at equal distance the one that follows decides, since headings belong to what
they introduce. Where a page has no decided block, those that reach the lower
density are good. The text is the good blocks, a line for each.

Defined results: null or empty html gives an empty text and no blocks. Pages
without tags are one block. A tag that doesn't close is text; an unclosed
script or comment lasts to the end. Repeated rows are treated alike, null ids
stay, and pages of any length are read whole in linear time. Other columns pass
through; one named like a new column stays under a free name, such as _text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, texts, with_columns

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|title|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+[^<>]*)>"
    r"|<[!?][^<>]*>",
    re.S | re.I,
)
_WORD = re.compile(r"[^\W\d_]+")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been before but by can could did do does for from had has have he her his how i if in into is it its just like more most my no not of on one only or other our out over said she so some such than that the their them then there these they this those through to under up was we were what when where which while who will with would you your
    aber alle als also am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für hat hatte haben ich ihr im in ist ja kann kein man mehr mit nach nicht noch nur oder ohne sein seine sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eu il ils je la le les leur lui mais même ne nos nous on ont ou où par pas plus pour qu que qui sa se ses son sont sur un une vous été être
    al como con cuando de del desde donde el ella en entre era es esta este fue ha hasta la las le lo los me mi muy más ni no nos o para pero por porque que se sin sobre son su sus también te tiene un una y ya""".split()
)


@dataclass(frozen=True)
class Rules:
    """Lengths are characters; densities are shares of words (stop words) or characters (links)."""

    short: int = 70
    long: int = 200
    low: float = 0.15
    high: float = 0.20
    links: float = 0.2


RULES = Rules()


def blocks(html: str) -> list[tuple[str, int]]:
    """(text with white space made single blanks, characters of it within links) of every block that has text."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    linked, depth, breaks, at = 0, 0, 0, 0

    def close() -> None:
        nonlocal linked, breaks
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, min(linked, len(text))))
        parts.clear()
        linked = breaks = 0

    def take(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                breaks = 0
                if depth:
                    linked += len(" ".join(text.split()))

    for m in _PIECE.finditer(html):
        take(html[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            depth = 0 if m.group(2) else 1
        elif tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
        elif tag in BLOCKS:
            close()
            depth = 0
    take(html[at:])
    close()
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0


def alone(text: str, linked: int, density: float, rules: Rules = RULES) -> bool | None:
    """Label of a block by itself; None if ambiguous."""
    n = len(text)
    if linked > rules.links * n or "©" in text:
        return False
    if n < rules.short:
        return False if linked else None
    if density < rules.low:
        return False
    return True if density >= rules.high or n > rules.long else None


def labels(page: list[tuple[str, int]], rules: Rules = RULES) -> list[bool]:
    """Whether each block is good."""
    density = [stop_density(text) for text, _ in page]
    first = [alone(text, linked, d, rules) for (text, linked), d in zip(page, density)]
    n = len(first)
    before, after = [-1] * n, [n] * n  # nearest decided block on each side
    for i in range(1, n):
        before[i] = i - 1 if first[i - 1] is not None else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if first[i + 1] is not None else after[i + 1]
    out = []
    for i, label in enumerate(first):
        if label is None:
            b, a = before[i], after[i]
            if b < 0 and a == n:
                label = density[i] >= rules.low
            else:
                label = first[a] if b < 0 or a < n and a - i <= i - b else first[b]
        out.append(bool(label))
    return out


def main_text(html: str | None, rules: Rules = RULES) -> tuple[str, int, int]:
    """(text, blocks, good blocks) of a page."""
    page = blocks(html or "")
    good = [text for (text, _), label in zip(page, labels(page, rules)) if label]
    return "\n".join(good), len(page), len(good)


def extracted(pages: DataFrame, html_col: str = "html", name: str = "text", rules: Rules = RULES) -> DataFrame:
    """*pages* without the html, with its main text as *name* and the numbers of its blocks and good blocks."""

    @F.arrow_udf("struct<text: string, blocks: int, good: int>")
    def extract(html: pa.Array) -> pa.Array:
        got = [main_text(h, rules) for h in texts(html)]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["text", "blocks", "good"])

    bounded(pages)
    held = fresh(pages, "__extracted")
    got = pages.withColumn(held, extract.asNondeterministic()(F.col(f"`{html_col}`")))
    new = {name: "text", "n_blocks": "blocks", "n_good": "good"}
    return with_columns(got, {k: F.col(held)[v] for k, v in new.items()}, drop=[held, html_col])
