"""DuckDB expressions for the oracle: the text functions and the chunker, written anew for SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from ..functions.text import WS

_names = count()


def let(value: str, body: Callable[[str], str]) -> str:
    v = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def each(values: str, body: Callable[[str], str]) -> str:
    v = f"x{next(_names)}"
    return f"list_transform({values}, lambda {v}: {body(v)})"


def each_at(values: str, body: Callable[[str, str], str]) -> str:
    v, i = f"x{next(_names)}", f"i{next(_names)}"
    return f"list_transform({values}, lambda {v}, {i}: {body(v, i)})"


def keep(values: str, body: Callable[[str], str]) -> str:
    v = f"x{next(_names)}"
    return f"list_filter({values}, lambda {v}: {body(v)})"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


def normalize(x: str) -> str:
    plain = rf"regexp_replace(replace(replace(regexp_replace({x}, '^\x{{FEFF}}', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return let(plain, lambda v: rf"CASE WHEN {trim(v)} = '' THEN '' ELSE regexp_replace(regexp_replace({v}, '\n[{WS}]*\z', ''), '^[{WS}]*\n', '') END")


def tokens(x: str) -> str:
    return f"((length({x}) + 3) // 4)::INT"


def nonempty(parts: str) -> str:
    return keep(each(parts, trim), lambda v: f"{v} <> ''")


def sentences(x: str) -> str:
    return nonempty(rf"string_split(regexp_replace({x}, '([.!?])[\t\n\f\r ]+', '\1' || chr(1), 'g'), chr(1))")


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def paragraphs(x: str) -> str:
    return nonempty(rf"string_split_regex({x}, '\n[ \t]*\n')")


def tail(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {trim(x)} ELSE {trim(f'''regexp_replace(right({x}, {n}), '^[^{WS}]+', '')''')} END"


def windows(x: str, n: str) -> str:
    return let(x, lambda v: let(n, lambda k: f"list_transform(range(0, (length({v}) + {k} - 1) // {k}), lambda j: substring({v}, (j * {k} + 1)::INT, ({k})::INT))"))


def starts(counts: str, budget: str) -> str:
    new = f"(t > {budget} OR acc.used < 0 OR acc.used + t > {budget})"
    step = f"{{'i': acc.i + 1, 'used': CASE WHEN t > {budget} THEN -1 WHEN {new} THEN t ELSE acc.used + t END, 'starts': CASE WHEN {new} THEN acc.starts || [acc.i] ELSE acc.starts END}}"
    return f"list_reduce({counts}, lambda acc, t: {step}, {{'i': 0, 'used': -1, 'starts': []::INT[]}}).starts"


def overlapped(chunks: str, overlap: int) -> str:
    if overlap <= 0:
        return chunks

    def one(all_of: str) -> Callable[[str, str], str]:
        return lambda x, i: f"CASE WHEN {i} = 1 THEN {x} ELSE {let(tail(f'{all_of}[{i} - 1]', overlap * 4), lambda o: f'CASE WHEN {o} = chr(0) THEN {x} WHEN length({o}) = 0 THEN {x} ELSE {o} || chr(10) || chr(10) || {x} END')} END"

    return let(chunks, lambda c: each_at(c, one(c)))


def pack(parts: str, separator: str, budget: str, overlap: int, oversized: Callable[[str, str], str]) -> str:
    def render(p: str) -> str:
        def by_count(t: str) -> str:
            def all_of(s: str) -> str:
                def one(x: str, k: str) -> str:
                    end = f"coalesce({s}[{k} + 1], len({p}))"
                    return f"CASE WHEN {t}[{x} + 1] > {budget} THEN {oversized(f'{p}[{x} + 1]', budget)} ELSE [array_to_string({p}[{x} + 1:{end}], {separator})] END"

                return f"flatten({each_at(s, one)})"

            return let(starts(t, budget), all_of)

        return let(each(p, tokens), by_count)

    return overlapped(let(parts, render), overlap)


def hard(x: str, budget: str) -> str:
    return windows(x, f"({budget} * 4)")


def prose(x: str, budget: str) -> str:
    return pack(sentences(x), "' '", budget, 0, hard)


def unit(x: str) -> str:
    """A vector of doubles at unit length."""
    return let(f"{x}::DOUBLE[]", lambda v: let(f"sqrt(list_dot_product({v}, {v}))", lambda n: f"CASE WHEN {n} = 0 THEN {v} ELSE {each(v, lambda y: f'{y} / {n}')} END"))
