"""Text functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a regex class body that Java and RE2 both read.
WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters one by one, for the functions that trim without a pattern.
WS_CHARACTERS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Characters of a token on average.
AVERAGE_TOKEN = 4
MINIFIED_LINE = 5000
BANNER_LINES = 8
BANNERS = "@generated|auto-?generated|code generated|do not edit"
MINIFIED_NAME = r"[.-]min\.|\.bundle\."


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with *value* computed once, since higher-order functions don't share subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(c: Column) -> Column:
    """Without white space of any script at both ends. Only the ends are looked at: as a pattern it would test every character."""
    return F.btrim(c, F.lit(WS_CHARACTERS))


def trim_blank_lines(c: Column) -> Column:
    """Without blank lines at both ends; the indentation of the others stays."""
    left, right = F.ltrim(c, F.lit(WS_CHARACTERS)), F.rtrim(c, F.lit(WS_CHARACTERS))
    indent = F.substring_index(F.left(c, F.length(c) - F.length(left)), "\n", -1)
    rest = F.substring_index(F.right(c, F.length(c) - F.length(right)), "\n", 1)
    return F.when(left == "", "").otherwise(F.concat(indent, trim(c), rest))


def normalize_text(c: Column) -> Column:
    """One byte-order mark less, line feeds only, at most one blank line in a row, none at the ends."""
    c = let(c, lambda v: F.when(F.startswith(v, F.lit("\ufeff")), F.right(v, F.length(v) - 1)).otherwise(v))
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = let(c, lambda v: F.when(F.contains(v, F.lit("\n\n\n")), F.regexp_replace(v, r"\n{3,}", "\n\n")).otherwise(v))
    return let(c, trim_blank_lines)


def token_count(c: Column, average: int = AVERAGE_TOKEN) -> Column:
    """Estimated tokens: characters by the average length, rounded up."""
    average = average if average > 0 else AVERAGE_TOKEN
    return F.ceil(F.length(c) / average).cast("int")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def nonempty(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def split_sentences(c: Column) -> Column:
    """Cut at white space that follows a full stop, exclamation or question mark."""
    return nonempty(F.split(c, r"(?<=[.!?])[\t\n\f\r ]+", -1))


def nonempty_lines(c: Column) -> Column:
    return nonempty(F.split(c, "\n", -1))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def split_paragraphs(c: Column) -> Column:
    return nonempty(F.split(c, "\n[ \t]*\n", -1))


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def tail_text(c: Column, characters: int) -> Column:
    """The last words within *characters*: what follows the first white space of that tail; all, trimmed, of a text that isn't longer."""
    tail = F.regexp_replace(F.expr("''") if characters <= 0 else F.substring(c, -characters, characters), rf"^[^{WS}]+", "")
    return F.when(F.length(c) <= characters, trim(c)).otherwise(trim(tail))


def join_overlap(overlap: Column, part: Column) -> Column:
    return F.when(overlap == "", part).otherwise(F.concat(overlap, F.lit("\n\n"), part))


def hard_window(c: Column, characters: Column | int) -> Column:
    """Consecutive pieces of a number of characters; the whole if that isn't positive, none of an empty text."""
    size = F.lit(characters) if isinstance(characters, int) else characters
    count = F.ceil(F.length(c) / F.greatest(size, F.lit(1))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(c, i * size + 1, size))
    none = F.array().cast("array<string>")
    return F.when(size <= 0, F.array(c)).when(F.length(c) == 0, none).otherwise(pieces)


def base_name(path: Column) -> Column:
    stripped = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", "").when(stripped == "", "/").otherwise(F.substring_index(stripped, "/", -1))


def extension(path: Column) -> Column:
    """The last extension in lower case, with its dot."""
    return F.lower(F.regexp_extract(base_name(path), r"\.[^.]*\z", 0))


def file_title(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*\z", "")


def section_title(path: Column, fallback: Column) -> Column:
    return F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(fallback)


def dehyphenate(c: Column) -> Column:
    """Words that a hyphen breaks over two lines made whole."""
    return F.regexp_replace(c, r"(\p{L})-\n(\p{Ll})", "$1$2")


def round_font(c: Column) -> Column:
    """To the nearest half, halves away from zero."""
    return F.round(c * 2) / 2


def is_fence(line: Column) -> Column:
    return trim(line).rlike("^(```|~~~)")


def heading_text(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, "^#+", ""), r"^[ \t#]+|[ \t#]+\z", "")


def leading_indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^[ \t]*", 0))


def is_minified(c: Column) -> Column:
    return (F.length(c) > MINIFIED_LINE) & F.exists(lines(c), lambda x: F.length(x) > MINIFIED_LINE)


def is_generated(c: Column) -> Column:
    """Whether one of the first lines holds a generator's banner."""
    return F.substring_index(c, "\n", BANNER_LINES).rlike(f"(?i){BANNERS}")


def has_minified_name(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(MINIFIED_NAME)


def push_headings(marks: Column) -> Column:
    """The heading path at each of *marks* (array of level, text): entries of the same or a deeper level give way."""
    entry = "struct<level:int,text:string>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.array().cast("array<array<string>>").alias("paths"))

    def step(acc: Column, mark: Column) -> Column:
        mark = F.struct(mark["level"].cast("int").alias("level"), mark["text"].alias("text"))
        stack = F.concat(F.filter(acc["stack"], lambda e: e["level"] < mark["level"]), F.array(mark))
        return let(stack, lambda s: F.struct(s.alias("stack"), F.concat(acc["paths"], F.array(F.transform(s, lambda e: e["text"]))).alias("paths")))

    return F.aggregate(marks, start, step, lambda acc: acc["paths"])
