"""Packing parts into chunks of a token budget, and chunk rows of documents.

A fold over the parts' token counts finds where chunks begin; the texts are then
joined once. Everything stays in the JVM and within the row, so no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Split = Callable[[Column, Column], Column]

MAX_TOKENS, OVERLAP = 350, 50
CODE_TOKENS, CODE_OVERLAP = 400, 40
LEAST_BODY = 32
PART_SEPARATOR = "\n\n"


def chunk_starts(tokens: Column, budget: Column) -> Column:
    """Indexes from 0 of the parts that begin a chunk; a part beyond the budget is a chunk of its own."""
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("used"), F.array().cast("array<int>").alias("starts"))

    def step(acc: Column, t: Column) -> Column:
        alone = t > budget
        new = alone | (acc["used"] < 0) | (acc["used"] + t > budget)
        used = F.when(alone, -1).when(new, t).otherwise(acc["used"] + t)
        starts = F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"])
        return F.struct((acc["i"] + 1).alias("i"), used.cast("int").alias("used"), starts.alias("starts"))

    return F.aggregate(tokens, start, step, lambda acc: acc["starts"])


def with_overlap(chunks: Column, overlap: int, average: int = T.AVERAGE_TOKEN) -> Column:
    """Each chunk but the first after the last words of the one before it."""
    if overlap <= 0:
        return chunks
    join = lambda all_of: F.transform(all_of, lambda x, i: F.when(i == 0, x).otherwise(T.join_overlap(T.tail_text(F.get(all_of, i - 1), overlap * average), x)))
    return T.let(chunks, join)


def pack(parts: Column, separator: str, budget: Column | int, overlap: int, oversized: Split, average: int = T.AVERAGE_TOKEN) -> Column:
    """Greedily joined parts: chunks of *budget* tokens, by the parts' counts alone. *oversized* splits a part that
    exceeds the budget; its pieces aren't joined with others. Overlap comes last."""
    limit = F.lit(budget) if isinstance(budget, int) else budget

    def render(p: Column) -> Column:
        tokens = F.transform(p, lambda x: T.token_count(x, average))

        def texts(t: Column) -> Column:
            def each(starts: Column) -> Column:
                def one(s: Column, k: Column) -> Column:
                    end = F.coalesce(F.get(starts, k + 1), F.size(p))
                    joined = F.array(F.array_join(F.slice(p, s + 1, end - s), separator))
                    return F.when(F.get(t, s) > limit, oversized(F.get(p, s), limit)).otherwise(joined)

                return F.flatten(F.transform(starts, one))

            return T.let(chunk_starts(t, limit), each)

        return T.let(tokens, texts)

    return with_overlap(T.let(parts, render), overlap, average)


def windows(part: Column, budget: Column) -> Column:
    return T.hard_window(part, budget * T.AVERAGE_TOKEN)


def prose(part: Column, budget: Column) -> Column:
    """An oversized part of prose: sentences, or windows of a sentence that is too long itself."""
    return pack(T.split_sentences(part), " ", budget, 0, windows)


def fenced_or_prose(part: Column, budget: Column) -> Column:
    """An oversized part of Markdown: the lines of a fence, or prose."""
    by_lines = pack(T.nonempty_lines(part), "\n", budget, 0, windows)
    return F.when(T.is_fence(T.first_line(part)), by_lines).otherwise(prose(part, budget))


def code_lines(part: Column, budget: Column) -> Column:
    """An oversized definition: its lines, overlapping once more by themselves."""
    return pack(T.lines(part), "\n", budget, CODE_OVERLAP, windows)


def markdown_parts(body: Column) -> Column:
    """Paragraphs of a Markdown body; a fence is kept whole, blank lines and all."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.array().cast("array<string>").alias("now"), F.lit(False).alias("fence"))
    flush = lambda acc: F.concat(acc["parts"], F.array(F.array_join(acc["now"], "\n")))

    def step(acc: Column, line: Column) -> Column:
        fence = T.is_fence(line)
        ends = ~fence & ~acc["fence"] & (T.trim(line) == "")
        empty = F.array().cast("array<string>")
        return F.struct(
            F.when(ends, flush(acc)).otherwise(acc["parts"]).alias("parts"),
            F.when(ends, empty).otherwise(F.concat(acc["now"], F.array(line))).alias("now"),
            F.when(fence, ~acc["fence"]).otherwise(acc["fence"]).alias("fence"),
        )

    return T.nonempty(F.aggregate(T.lines(body), start, step, flush))


#: Strategy: (parts of a body, splitter of an oversized part, tokens, overlap).
STRATEGIES: dict[str, tuple[Callable[[Column], Column], Split, int, int]] = {
    "plain": (T.split_paragraphs, prose, MAX_TOKENS, OVERLAP),
    "docx": (T.split_paragraphs, prose, MAX_TOKENS, OVERLAP),
    "pdf": (T.split_paragraphs, prose, MAX_TOKENS, OVERLAP),
    "markdown": (markdown_parts, fenced_or_prose, MAX_TOKENS, OVERLAP),
    "code": (lambda body: F.array(body), code_lines, CODE_TOKENS, CODE_OVERLAP),
}


def section_chunks(sections: Column, fallback: Column, strategy: str) -> Column:
    """(title, text) of the chunks of *sections* (array of path, body); a title takes its tokens from the budget."""
    parts, oversized, most, overlap = STRATEGIES[strategy]

    def one(section: Column) -> Column:
        def titled(title: Column) -> Column:
            budget = F.greatest(F.lit(LEAST_BODY), F.lit(most) - T.token_count(title))
            bodies = T.let(budget, lambda b: pack(parts(section["body"]), PART_SEPARATOR, b, overlap, oversized))
            return F.transform(bodies, lambda x: F.struct(title.alias("title"), x.alias("text")))

        return T.let(T.section_title(section["path"], fallback), titled)

    return F.flatten(F.transform(sections, one))


def chunk_rows(parts: Column) -> Column:
    """Chunk structs of (title, text) *parts*: index, title, text, tokens, offsets and hash, in order."""
    zero = F.array(F.lit(0))
    ends = F.aggregate(F.transform(parts, lambda p: F.length(p["text"])), zero, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return T.let(
        ends,
        lambda e: F.transform(
            parts,
            lambda p, i: F.struct(
                i.alias("chunk_index"),
                p["title"].alias("title"),
                p["text"].alias("text"),
                T.token_count(p["text"]).alias("token_count"),
                F.get(e, i).alias("start_offset"),
                F.get(e, i + 1).alias("end_offset"),
                T.content_hash(F.concat(p["title"], F.lit("\n"), p["text"])).alias("content_hash"),
            ),
        ),
    )


def chunked(documents: DataFrame, sections: Column, fallback: Column, strategy: str, keys: list[str]) -> DataFrame:
    """A row for each chunk of each document, with the document's *keys*."""
    rows = T.let(section_chunks(sections, fallback, strategy), chunk_rows)
    return documents.select(*keys, F.explode(rows).alias("chunk")).select(*keys, "chunk.*")


def chunk_plain_text(documents: DataFrame, text_col: str, title: Column, keys: list[str]) -> DataFrame:
    """Chunks of plain texts: one section each, without a heading path."""
    section = F.struct(F.array().cast("array<string>").alias("path"), T.normalize_text(F.col(text_col)).alias("body"))
    return chunked(documents, F.array(section), title, "plain", keys)
