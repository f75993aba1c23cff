"""PII by a semi-Markov conditional random field.

A text is cut into atoms (runs of letters and digits, runs of white space, single
other characters) around its digits and at signs, with the groups of capitals that an
account number may have between or after them; a region ends where other words or
an empty line stand, which are part of no entity. White space inside an entity may
be of any width and hold a line break. In such a region the model
scores whole candidate segments (of up to MAX_ATOMS atoms, or with one at sign and
up to MAX_EMAIL characters of an address) by features of the
whole span (its structure, its check digits, its length, what stands beside
it) for each type, and transitions between types; a dynamic program over the
segment ends finds the best joint choice of boundaries and types.

The weights are fitted by conditional likelihood on generated sentences of a
fixed seed, when the operator is called; nothing is downloaded.

Defined results: a null text stays null and has no entities; an empty text stays
empty. Offsets count characters. A region's program is linear in its length and holds
the last KEEP atoms and the entities, so very long texts are ones like any other.
Repeated rows are treated alike, null ids too. Other columns pass through; one named
like the entities stays under a free name, _entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, texts, with_columns

TYPES = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN")
#: All patterns but that of addresses end well before it: the longest IBAN in groups has 17 atoms.
MAX_ATOMS = 24
MAX_EMAIL = 254
#: Atoms that a region's program takes at a time, and those before them that a segment among them can reach:
#: an address has at most MAX_EMAIL characters on either side of its sign.
BLOCK, KEEP = 4096, 512
_ATOM = re.compile(r"[^\W_]+|\s+|.", re.S)
_HINT = re.compile(r"[0-9@]+")
_GAP = re.compile(r"\s+")
_EMAIL = re.compile(r"[^\W_](?:[\w.+%-]*[\w])?@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_PHONE = re.compile(r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_CARD = re.compile(r"\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
_IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN_WIDE = re.compile(_IBAN.pattern.replace(" ?", r"\s*"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "@.-_/:+=\"'" else "other"


def span_features(text: str, start: int, end: int) -> list[str]:
    """Names of the features that the span text[start:end] has."""
    s = text[start:end]
    gaps = [g for g in _GAP.findall(s) if g != " "]
    s = _GAP.sub(" ", s)
    n = sum(c.isdigit() for c in s)
    out = ["bias", "digits:any" if "@" in s else f"digits:{min(n, 20)}" if n < 12 else f"digits:{'12' if n == 12 else '13-16' if n <= 16 else '17-19' if n <= 19 else '20+'}"]
    before, after = text[start - 1 : start], text[end : end + 1]
    out += [f"before:{_side(before)}", f"after:{_side(after)}"]
    if after and after in ".-@_+" and text[end + 1 : end + 2].isalnum():
        out.append("goes on")
    if before and before in ".-@_+" and text[start - 2 : start - 1].isalnum():
        out.append("went on")
    if gaps:
        out.append("wide" if len(gaps) == 1 else "wide more")
    if "@" in s:
        out.append("at")
    if s[0] in "+(":
        out.append(f"first:{s[0]}")
    seps = {c for c in s if not c.isalnum()}
    out.append("seps:" + "".join(sorted(c if c in " .-()+@_" else "?" for c in seps))[:8])
    if any(c.isalpha() for c in s):
        out.append("letters")
    if _EMAIL.fullmatch(s):
        out.append("email")
    elif _IP.fullmatch(s):
        out.append("ip" if all(int(x) < 256 for x in s.split(".")) else "ip no")
    elif _SSN.fullmatch(s):
        out.append("ssn")
    elif s.isascii():
        if _CARD.fullmatch(s):
            out.append("card")
            if luhn(re.sub(r"\D", "", s)):
                out.append("luhn")
        if _PHONE.fullmatch(s) and 7 <= n <= 15:
            out.append("phone")
        if _IBAN.fullmatch(s):
            out.append("iban")
            if _iban(s):
                out.append("iban sum")
    return out


def regions(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of words that hold a digit or an at sign or are part of what may be an IBAN, with no empty line between them."""
    ibans = (m.span() for at in _IBAN_START.finditer(text) if (m := _IBAN_WIDE.match(text, at.start())))
    first = last = 0
    n = len(text)
    for a, b in merge((m.span() for m in _HINT.finditer(text)), ibans):
        if b <= last:
            continue
        a = max(a, last)
        while a > last and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        gap = text[last:a]
        if not last or gap.strip() or gap.count("\n") > 1:
            if last:
                yield first, last
            first = a
        last = b
    if last:
        yield first, last


def candidates(text: str, atoms: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first atom, atom after the last) of the segments that may be entities: those around an at sign, and others of
    digits, capitals and the signs of numbers, without any small letter."""
    kinds = ["w" if text[a].isalnum() else " " if text[a].isspace() else text[a] for a, _ in atoms]
    plain = [text[a:b].isupper() or text[a:b].isdecimal() if k == "w" else k in " .-+()" for (a, b), k in zip(atoms, kinds)]
    digits = [0, *accumulate(sum(map(str.isdigit, text[a:b])) if k == "w" else 0 for (a, b), k in zip(atoms, kinds))]
    space, dots = ([0, *accumulate(k == c for k in kinds)] for c in " .")
    out = []
    for i, k in enumerate(kinds):
        if k not in "w+(" or not plain[i]:
            continue
        for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1):
            if not plain[j - 1] or space[j] - space[i] > 8:
                break
            if kinds[j - 1] == "w" and (digits[j] - digits[i] >= 7 or (dots[j] - dots[i] == 3 and digits[j] > digits[i])):
                out.append((i, j))
    for at in (i for i, k in enumerate(kinds) if k == "@"):
        first, last = at, at + 1
        while first and kinds[first - 1] in "w._+%-" and atoms[at][0] - atoms[first - 1][0] < MAX_EMAIL:
            first -= 1
        while last < len(kinds) and kinds[last] in "w._-" and atoms[last][1] - atoms[at][0] < MAX_EMAIL:
            last += 1
        ends = [j for j in range(at + 2, last + 1) if kinds[j - 1] == "w"]
        for i in range(first, at):
            if kinds[i] == "w":
                out += [(i, j) for j in ends if atoms[j - 1][1] - atoms[i][0] <= MAX_EMAIL]
    return sorted(out)


def cut(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _ATOM.finditer(text, start, end))


# ---- fitting -------------------------------------------------------------

_WORDS = "the of and for with ref order page call at from is was on due see room file year total von der und de la pour los con est via key id mail".split()


def _entity(rng: np.random.Generator, kind: str) -> str:
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    if kind == "EMAIL":
        local = pick(word(), f"{word()}.{word()}", f"{word()}.{d(2)}", f"{word()}_{d(3)}", f"{word()}+{word()}", f"é{word()}.{d(2)}")
        host = pick(f"{word()}.com", f"mail{d(1)}.{word()}.com", f"{word()}.co.uk", f"{word()}-{word()}.org")
        if rng.random() < 0.3:  # machine-made and dotted ones
            hexa = lambda n: "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, n))
            many = lambda least, signs: "".join(pick(word(), d(2), hexa(4)) + pick(*signs) for _ in range(rng.integers(least, 6)))
            local = pick(hexa(int(rng.integers(8, 41))), f"{word()}+{hexa(20)}", f"{many(1, '._-+')}{word()}", f"{many(1, '._-+')}{d(4)}", f"{hexa(8)}-{hexa(4)}-4{hexa(3)}-{hexa(12)}")
            host = pick(host, f"{many(1, '.-')}{host}")
        out = f"{local}@{host}"
        return out.upper() if rng.random() < 0.15 else out
    if kind == "IP":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == "PHONE":
        return pick(f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}")
    if kind == "CARD":
        s = pick(d(16), d(16), d(15), " ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4)))
        if rng.random() < 0.5:  # with the right check digit
            s = next(t for c in "0123456789" if luhn(re.sub(r"\D", "", t := s[:-1] + c)))
        return s
    if kind == "SSN":
        return f"{d(3)}-{d(2)}-{d(4)}"
    caps = lambda n: "".join(chr(65 + c) for c in rng.integers(0, 26, n))
    land, bban = pick(("DE", d(18)), ("FR", d(23)), ("ES", d(20)), ("GB", caps(4) + d(14)), ("NL", caps(4) + d(10)), ("IE", caps(4) + d(14)), ("MT", caps(4) + d(5) + caps(3) + d(15)), ("SC", caps(4) + d(20) + caps(3)), (caps(2), d(int(rng.integers(4, 6)) * 4)))
    check = 98 - int("".join(str(int(c, 36)) for c in bban + land + "00")) % 97
    s = f"{land}{check:02d}{bban}"
    return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))


def _decoy(rng: np.random.Generator) -> str:
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexa = lambda n: "".join("0123456789abcdef"[c] for c in rng.integers(0, 16, n))
    pick = lambda *x: x[rng.integers(len(x))]
    caps = lambda n: "".join(chr(65 + c) for c in rng.integers(0, 26, n))
    if rng.random() < 0.15:  # a column or a row of a table
        n, gap = int(rng.integers(2, 5)), pick("\n", "   ", "\t")
        return gap.join(d(n) for _ in range(rng.integers(2, 6)))
    return pick(f"{caps(2)}{d(2)} {caps(4)} {d(4)}", f"{caps(4)} {d(4)} {caps(3)} {d(4)}", f"{caps(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(2)}", d(4), d(6), f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)},{d(3)},{d(3)}.{d(2)}", f"{d(3)}.{300 + int(d(2))}.{d(1)}.{d(1)}", f'token = "{hexa(40)}"', f"id{d(8)}", f"{d(9)}", f"{d(11)}x", f"@{hexa(5)}", f"a @ {d(2)}", f"{d(24)}", f"{d(2)}/{d(2)}/{d(4)}", f"{hexa(8)}-{hexa(4)}-4{hexa(3)}-{hexa(12)}", f"{d(1)}.{d(2)}.{d(1)}.{d(2)}.{d(1)}", f"{d(4)}-{d(4)}", f"§{d(3)}.{d(1)}")


def generated(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with their entities."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.integers(2, 5)):
            roll = rng.random()
            piece, kind = (_WORDS[rng.integers(len(_WORDS))], "") if roll < 0.25 else (_decoy(rng), "") if roll < 0.5 else ("", TYPES[rng.integers(len(TYPES))])
            if text:
                text += " " if rng.random() < 0.9 else "  | "
            if kind:
                text += ("", "", "", "(", '"', "<")[rng.integers(6)]
                piece = _entity(rng, kind)
                blanks = [i for i, c in enumerate(piece) if c == " "]
                if blanks and rng.random() < 0.15:  # wrapped, or set wide
                    i = blanks[rng.integers(len(blanks))]
                    piece = piece[:i] + ("\n", "   ", "\n  ")[rng.integers(3)] + piece[i + 1 :]
                gold.append((len(text), len(text) + len(piece), kind))
                text += piece + ("", "", "", ".", ",", "!!", "%%%", '"')[rng.integers(8)]
            else:
                text += piece
        out.append((text, gold))
    return out


class Model:
    """Weights by feature name, one for each type, and the transitions between 'none' and the types."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.sums: dict[tuple[str, ...], np.ndarray] = {}

    def score(self, text: str, start: int, end: int) -> np.ndarray:
        found = tuple(span_features(text, start, end))
        got = self.sums.get(found)
        if got is None:
            if len(self.sums) > 20_000:
                self.sums.clear()
            got = self.sums[found] = self.weights[[self.names[f] for f in found if f in self.names]].sum(axis=0)
        return got

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, str]]:
        """The best segmentation of a region: its entities in order."""
        source, atoms, k = cut(text, start, end), [], len(TYPES) + 1
        # For each of the last places, by type of what ends there: the best score, and its entities as (those before, the last).
        best: list[np.ndarray] = [np.where(np.arange(k) == 0, 0.0, -np.inf)]
        path: list[list[tuple | None]] = [[None] * k]
        while new := list(islice(source, BLOCK)):
            old = len(atoms)
            atoms += new
            by_end: dict[int, list[tuple[int, np.ndarray]]] = {}
            enter: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by place: the best score of a segment of each type that starts there, and the type before
            for i, j in candidates(text, atoms):
                if j > old:
                    by_end.setdefault(j, []).append((i, self.score(text, atoms[i][0], atoms[j - 1][1])))
            for p in range(old + 1, len(atoms) + 1):
                come = best[p - 1] + self.moves[:, 0]
                u = int(come.argmax())
                top, ways = np.full(k, -np.inf), [None] * k
                top[0], ways[0] = come[u], path[p - 1][u]
                for i, score in by_end.get(p, ()):
                    if i not in enter:
                        come = best[i][:, None] + self.moves[:, 1:]
                        u = come.argmax(axis=0)
                        enter[i] = come[u, range(k - 1)], u
                    come, u = enter[i]
                    got = come + score
                    for t in np.flatnonzero(got > top[1:]):
                        top[t + 1], ways[t + 1] = got[t], (path[i][u[t]], (atoms[i][0], atoms[p - 1][1], TYPES[t]))
                best.append(top)
                path.append(ways)
            del atoms[:-KEEP], best[: -KEEP - 1], path[: -KEEP - 1]
        out, way = [], path[-1][int(best[-1].argmax())]
        while way:
            way, entity = way
            out.append(entity)
        return out[::-1]

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        return [e for a, b in regions(text or "") for e in self.decode(text, a, b)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@lru_cache(maxsize=2)
def fitted(sentences: int = 500, steps: int = 60, seed: int = 7, l2: float = 1e-3, rate: float = 0.2) -> Model:
    """The model of maximum conditional likelihood on generated sentences, by Adam."""
    rows, gold_rows, moves_gold = [], [], np.zeros((len(TYPES) + 1,) * 2)
    k, regions_ = len(TYPES) + 1, []
    for text, gold in generated(sentences, seed):
        for a, b in regions(text):
            atoms = list(cut(text, a, b))
            n = len(regions_)
            regions_.append(len(atoms))
            first, last = {s: i for i, (s, _) in enumerate(atoms)}, {e: i + 1 for i, (_, e) in enumerate(atoms)}
            spans = {(first[s], last[e]): TYPES.index(t) + 1 for s, e, t in gold if s in first and e in last}
            for i, j in candidates(text, atoms):
                rows.append((n, i, j, span_features(text, atoms[i][0], atoms[j - 1][1])))
                gold_rows.append(spans.get((i, j), 0))
            p = t = 0
            while p < len(atoms):
                j, u = next(((j, u) for (i, j), u in spans.items() if i == p), (p + 1, 0))
                moves_gold[t, u] += 1
                p, t = j, u
    names = {f: i for i, f in enumerate(sorted({f for *_, fs in rows for f in fs}))}
    x = np.zeros((len(rows), len(names)), np.float32)
    for r, (*_, fs) in enumerate(rows):
        x[r, [names[f] for f in fs]] = 1
    n, i, j = (np.array([r[c] for r in rows]) for c in range(3))
    size, count = max(regions_), len(regions_)
    ends = np.array(regions_)
    gold = np.zeros((len(rows), k - 1), np.float32)
    at = np.flatnonzero(np.array(gold_rows))
    gold[at, np.array(gold_rows)[at] - 1] = 1
    w, moves = np.zeros((len(names), k - 1)), np.zeros((k, k))
    m, v = np.zeros(w.size + moves.size), np.zeros(w.size + moves.size)
    by_start, by_end = ([np.flatnonzero(c == p) for p in range(size + 1)] for c in (i, j))
    for step in range(1, steps + 1):
        score = x @ w
        alpha = np.full((count, size + 1, k), -np.inf)
        come = np.full((count, size + 1, k), -np.inf)
        alpha[:, 0, 0] = 0
        come[:, 0] = _lse(alpha[:, 0, :, None] + moves, 1)
        for p in range(1, size + 1):
            alpha[:, p, 0] = come[:, p - 1, 0]
            r = by_end[p]
            np.logaddexp.at(alpha[:, p, 1:], n[r], come[n[r], i[r], 1:] + score[r])
            come[:, p] = _lse(alpha[:, p, :, None] + moves, 1)
        z = _lse(alpha[np.arange(count), ends], 1)
        beta = np.full((count, size + 1, k), -np.inf)
        start = np.full((count, size + 1, k), -np.inf)  # of a segment of each type that starts there
        beta[np.arange(count), ends] = 0
        for p in range(size - 1, -1, -1):
            start[:, p, 0] = beta[:, p + 1, 0]
            r = by_start[p]
            np.logaddexp.at(start[:, p, 1:], n[r], beta[n[r], j[r], 1:] + score[r])
            inner = _lse(moves[None] + start[:, p, None, :], 2)
            beta[:, p] = np.where((p < ends)[:, None], inner, beta[:, p])
        marginal = np.exp(come[n, i, 1:] + score + beta[n, j, 1:] - z[n, None])
        pair = np.exp(alpha[:, :-1, :, None] + moves + start[:, :-1, None, :] - z[:, None, None, None])
        pair[~(np.arange(size)[None] < ends[:, None])] = 0
        grad = np.append((x.T @ (marginal - gold) / count + l2 * w).ravel(), ((pair.sum(axis=(0, 1)) - moves_gold) / count + l2 * moves).ravel())
        grad[w.size] = 0  # a step from none to none scores 0, else atoms outside would outweigh any long entity
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, moves = w - move[: w.size].reshape(w.shape), moves - move[w.size :].reshape(moves.shape)
    return Model(names, w, moves)


def masked(text: str, entities: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in entities:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", entities_name: str | None = "entities", length_col: str | None = None, model: Model | None = None) -> DataFrame:
    """*docs* with every entity in the text replaced by its type in brackets.

    *entities_name* adds an array of (start, end, type) in the original text, or nothing if None.
    *length_col*, if given, is set to the new length where the text changed.
    """
    model = model or fitted()

    @F.arrow_udf("struct<text: string, entities: array<struct<start: int, end: int, type: string>>>")
    def find(text: pa.Array) -> pa.Array:
        new, all_found = [], []
        for t in texts(text):
            found = model.find(t) if t else []
            new.append(masked(t, found) if found else None)
            all_found.append([{"start": a, "end": b, "type": k} for a, b, k in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(all_found, kind)], names=["text", "entities"])

    bounded(docs)
    held = fresh(docs, "__pii")
    text = F.col(f"`{text_col}`")
    # Only texts with a digit or an at sign leave the JVM.
    got = docs.withColumn(held, find.asNondeterministic()(F.when(text.rlike("[0-9@]"), text)))
    new = F.col(held)["text"]
    changed = {text_col: F.coalesce(new, text)}
    if length_col:
        changed[length_col] = F.when(new.isNotNull(), F.length(new)).otherwise(F.col(f"`{length_col}`")).cast(docs.schema[length_col].dataType)
    got = got.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns], F.col(held)["entities"].alias(held))
    return with_columns(got, {entities_name: F.col(held)} if entities_name else {}, drop=[held])
