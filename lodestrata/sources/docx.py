"""Heading-structured sections of DOCX files, with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

DOCUMENT, STYLES = "word/document.xml", "word/styles.xml"


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _value(element: ElementTree.Element, name: str = "val") -> str:
    return next((v for k, v in element.attrib.items() if _local(k) == name), "")


def _number(text: str, otherwise: int) -> int:
    return int(text) if re.fullmatch(r"[+-]?\d+", text := text.strip(), re.A) else otherwise


def style_level(outline: int, name: str) -> int:
    """Heading level of a style, 0 for none: its outline level from 0, or the number in its name."""
    if outline >= 0:
        return outline + 1
    name = name.strip().lower()
    level = _number(name[8:], 0) if name.startswith("heading ") else 0
    return max(level, 0)


def style_levels(xml: bytes) -> dict[str, int]:
    """Levels by style id, as far as the part can be read."""
    levels: dict[str, int] = {}
    style, name, outline = "", "", -1
    try:
        for event, e in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
            kind = _local(e.tag)
            if event == "start" and kind == "style":
                style, name, outline = _value(e, "styleId"), "", -1
            elif event == "start" and kind == "name":
                name = _value(e)
            elif event == "start" and kind == "outlineLvl":
                outline = _number(_value(e), -1)
            elif event == "end" and kind == "style" and style and (level := style_level(outline, name)):
                levels[style] = level
    except ElementTree.ParseError:
        pass
    return levels


def paragraphs(xml: bytes, levels: dict[str, int]) -> list[tuple[int, str]]:
    """(heading level or 0, text) of the paragraphs; one inside another starts the outer one afresh."""
    out = []
    text, style, outline = [], "", -1
    for event, e in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
        kind = _local(e.tag)
        if event == "start":
            if kind == "p":
                text, style, outline = [], "", -1
            elif kind == "pStyle":
                style = _value(e)
            elif kind == "outlineLvl":
                outline = _number(_value(e), -1)
            elif kind == "tab":
                text.append(" ")
        elif kind == "t":
            text.append(e.text or "")
        elif kind == "p":
            out.append((outline + 1 if outline >= 0 else levels.get(style, 0), "".join(text).strip()))
            e.clear()
    return out


def sections(content: bytes) -> list[tuple[list[str], str]]:
    """(heading path, body); ValueError for what isn't a readable DOCX file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            if DOCUMENT not in names:
                raise ValueError(f"no {DOCUMENT}")
            levels = style_levels(z.read(STYLES)) if STYLES in names else {}
            found = paragraphs(z.read(DOCUMENT), levels)
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise ValueError(f"not a DOCX file: {e}") from e
    out: list[tuple[list[str], str]] = []
    stack: list[tuple[int, str]] = []
    body: list[str] = []

    def flush() -> None:
        if body:
            out.append(([t for _, t in stack], "\n\n".join(body)))
            body.clear()

    for level, text in found:
        if not text:
            continue
        if level:
            flush()
            stack = [s for s in stack if s[0] < level] + [(level, text)]
        else:
            body.append(text)
    flush()
    return out
