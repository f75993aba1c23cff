"""Heading-structured sections of Markdown, by a scanner of lines.

ATX and setext headings count, also within quotes and lists; what looks like a
heading within a fence, indented code or an HTML block doesn't.
"""

from __future__ import annotations

import re

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_CONTAINER = re.compile(r" {0,3}(?:>[ ]?|(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$))")
_RAW = re.compile(r" {0,3}<(script|pre|style|textarea)(?=[\s>]|$)", re.I)
_COMMENT = re.compile(r" {0,3}<!--")
_HTML = re.compile(r" {0,3}</?(?:address|article|aside|blockquote|body|center|details|dialog|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|option|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?=[\s/>]|$)", re.I)


def _inner(line: str) -> tuple[str, bool]:
    """What is left of a line without quote and list marks, and whether it had any."""
    had = False
    while (m := _CONTAINER.match(line)) and not _BREAK.match(line):
        line, had = line[m.end() :], True
    return line, had


def headings(lines: list[str]) -> list[tuple[int, int]]:
    """(level, line) of the headings in order; of a setext heading it is the line of the text."""
    out: list[tuple[int, int]] = []
    fence, until, paragraph = "", None, None  # open fence; what ends an HTML block; first line of an open paragraph
    for i, raw in enumerate(lines):
        line, nested = _inner(raw)
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if until is not None:
            if (until == "" and not line.strip()) or (until and until in line.lower()):
                until = None
            continue
        if not line.strip():
            paragraph = None
            continue
        m = _FENCE.match(line)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], None
            continue
        if m := _RAW.match(line):
            end = f"</{m[1].lower()}>"
            until, paragraph = (None if end in line.lower() else end), None
            continue
        if _COMMENT.match(line):
            until, paragraph = (None if "-->" in line else "-->"), None
            continue
        if _HTML.match(line):
            until, paragraph = "", None
            continue
        if m := _ATX.match(line):
            out.append((len(m[1]), i))
            paragraph = None
            continue
        if paragraph is not None and not nested and (m := _SETEXT.match(line)):
            out.append((1 if m[1][0] == "=" else 2, paragraph))
            paragraph = None
            continue
        if _BREAK.match(line):
            paragraph = None
            continue
        if paragraph is None and not re.match(r"(?: {4}|\t)", line):
            paragraph = i
    return out


def _text(line: str) -> str:
    return line.lstrip("#").strip(" \t#")


def sections(source: str) -> list[tuple[list[str], str]]:
    """(heading path, body) of each section with a body; *source* is normalized."""
    lines = source.split("\n")
    marks = headings(lines)
    out = []
    ends = [line for _, line in marks[1:]] + [len(lines)]
    if head := "\n".join(lines[: marks[0][1]] if marks else lines).strip():
        out.append(([], head))
    stack: list[tuple[int, str]] = []
    for (level, line), end in zip(marks, ends):
        stack = [e for e in stack if e[0] < level] + [(level, _text(lines[line]))]
        if body := "\n".join(lines[line + 1 : end]).strip():
            out.append(([t for _, t in stack], body))
    return out
