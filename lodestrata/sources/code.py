"""Definition sections of source code, by a small lexer of its own.

Comments and strings are blanked out first, so that a brace or a keyword in them
counts for nothing; definitions are then found by pattern. In languages with
braces a section starts at every function, titled by the classes around it; in
Python at every class and function, nested by indentation; Ruby and SQL files
are one section.
"""

from __future__ import annotations

import re
from bisect import bisect_right

BRACE = frozenset(".go .js .ts .jsx .tsx .java .php .rs .c .h .cpp .hpp .cs .sh".split())
INDENT = frozenset([".py"])
FLAT = frozenset([".rb", ".sql"])
EXTENSIONS = BRACE | INDENT | FLAT

Sections = list[tuple[list[str], str]]

_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_FULL = r"'(?:\\.|[^'\\\n])*'"
_CHAR = r"'(?:\\[^\n]+?|[^'\\\n])'"
_TICKS = r"`(?:\\.|[^`\\])*`"
_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_HIDDEN = {
    ".py": r"'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|#[^\n]*|" + _QUOTED + "|" + _FULL,
    ".sh": r"(?<![\w$])#[^\n]*|" + _QUOTED + r"|'[^']*'",
    ".php": _SLASHES + r"|\#(?!\[)[^\n]*|" + _QUOTED + "|" + _FULL,
    ".go": _SLASHES + r"|`[^`]*`|" + _QUOTED + "|" + _CHAR,
    **{e: _SLASHES + "|" + _TICKS + "|" + _QUOTED + "|" + _FULL for e in (".js", ".ts", ".jsx", ".tsx")},
    **{e: _SLASHES + "|" + _QUOTED + "|" + _CHAR for e in (".java", ".rs", ".c", ".h", ".cpp", ".hpp", ".cs")},
}
_NAME = r"[A-Za-z_$][\w$]*"
_EVENT = re.compile(
    rf"(?P<open>\{{)|(?P<close>\}})|(?P<end>;)"
    rf"|\b(?:class|interface|struct|enum|trait|impl|record)\s+(?:<[^>\n]*>\s*)?(?P<type>{_NAME})"
    rf"|\b(?:func|function|fn)\b\s*&?\s*(?:\([^()\n]*\)\s*)?(?P<func>{_NAME})\s*[(<\[]"
    rf"|(?P<call>~?{_NAME})\s*\("
)
_NOT_NAMES = frozenset("if for while switch catch return new else do try throw sizeof typeof await yield foreach using lock synchronized match when until select defer go assert super this echo print include require isset unset list array function func fn and or not in case elif fi done then".split())
_BEFORE = re.compile(r"[\w>\]*&~:]\s*$")
_DEF = re.compile(rf"^[ \t]*(?:async[ \t]+)?(?P<kind>def|class)[ \t]+(?P<name>{_NAME})", re.M)
_ATTACHED = tuple("@ # * -- // /* */ ''' \"\"\"".split())


def blanked(source: str, extension: str) -> str:
    """The source with comments and strings made blanks; lines and offsets stay."""
    pattern = _HIDDEN.get(extension)
    blank = lambda m: "\n".join(" " * len(x) for x in m[0].split("\n"))
    return re.sub(pattern, blank, source, flags=re.S) if pattern else source


class LineIndex:
    """Lines of a text by offset, from 0."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1


def _closing(text: str, at: int) -> int:
    """Offset after the parenthesis that closes the one at *at*; -1 if none does."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if not depth:
                return i + 1
    return -1


def brace_marks(text: str, extension: str) -> list[tuple[int, list[str]]]:
    """(line, path) of the functions."""
    marks: list[tuple[int, list[str]]] = []
    classes: list[tuple[str, int]] = []
    depth, pending, body, entering = 0, "", None, False  # body: depth of the function around, if any
    index = LineIndex(text)
    for m in _EVENT.finditer(text):
        if m["open"]:
            depth += 1
            if pending:
                classes.append((pending, depth))
                pending = ""
            elif entering and body is None:
                body = depth
            entering = False
        elif m["close"]:
            if body == depth:
                body = None
            depth -= 1
            while classes and classes[-1][1] > depth:
                classes.pop()
        elif m["end"]:
            pending, entering = "", False
        elif m["type"]:
            if body is None:
                pending = f"class {m['type']}"
        else:
            name = m["func"] or m["call"]
            if m["call"]:
                if body is not None or entering or name in _NOT_NAMES:
                    continue
                end = _closing(text, m.end() - 1)
                if end < 0:
                    continue
                after = re.compile(r"[\w\s:<>,*&\[\]?|.\\-]*").match(text, end).end()
                if text[after : after + 1] != "{":
                    continue
                before = text[max(0, m.start() - 80) : m.start()]
                start = before.rstrip(" \t")[-1:] in ("", "\n", ";", "{", "}")
                if not (_BEFORE.search(before) or start and (classes or extension == ".sh")) or before.rstrip().endswith((" new", "return", "=")):
                    continue
            at = m.start("func") if m["func"] else m.start("call")
            marks.append((index.line(at), [c for c, _ in classes] + [f"{name}()"]))
            entering = True
    return marks


def indent_marks(text: str) -> list[tuple[int, list[str]]]:
    """(line, path) of classes and functions, nested by smaller indentation."""
    marks, stack, index = [], [], LineIndex(text)
    for m in _DEF.finditer(text):
        indent = len(m[0]) - len(m[0].lstrip(" \t"))
        title = f"class {m['name']}" if m["kind"] == "class" else f"{m['name']}()"
        stack = [s for s in stack if s[0] < indent]
        marks.append((index.line(m.start("kind")), [t for _, t in stack] + [title]))
        stack.append((indent, title))
    return marks


def from_marks(source: str, marks: list[tuple[int, list[str]]]) -> Sections:
    """Sections that start at the marks, with the comments, decorators and blank lines above them."""
    if not marks:
        return [([], source)] if source.strip() else []
    lines = source.split("\n")
    starts, floor = [], 0
    for line, _ in marks:
        start = max(line, floor)
        while start > floor and line >= floor and (not (above := lines[start - 1].strip()) or above.startswith(_ATTACHED)):
            start -= 1
        starts.append(start)
        floor = start + 1
    head = "\n".join(lines[: starts[0]])
    out: Sections = [([], head)] if head.strip() else []
    for (_, path), a, b in zip(marks, starts, starts[1:] + [len(lines)]):
        out.append((path, "\n".join(lines[a:b])))
    return out


def sections(source: str, extension: str) -> Sections:
    """(path of titles, body) of a normalized source."""
    extension = extension.lower()
    if extension in BRACE:
        return from_marks(source, brace_marks(blanked(source, extension), extension))
    if extension in INDENT:
        return from_marks(source, indent_marks(blanked(source, extension)))
    return from_marks(source, [])
