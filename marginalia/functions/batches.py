"""Markup and units of a whole Arrow batch at once, by array operations over all its characters.

The expressions of ``markup``, ``text`` and ``spans`` say what is right for any row. Here the plain rows are
read, which are nearly all; a row that needs a closer look comes back as null, and the caller takes the
expression for it. Such rows have an escape, faulty markup, an insert right behind a bracket, or a
character that engines of another Unicode version may take for a letter or not.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.schemas import TAGS

#: So many characters are looked at together: their arrays stay small.
CHUNK = 1 << 18
MARK, WORD, SPACE, UNSURE = range(4)
BEYOND = 1 << 16
#: Signs and pictures, none of them a letter or a number in any version.
PICTURES = (0x1F300, 0x1FAFF)
UNIT = re.compile(r"[^\W\d_]+?(?=n't(?!\w))|n't|\w+|[^\w\s]")
BREAK = re.compile(r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
ODD_SPACE = re.compile(r"[^\S \n]")
NUMBER = r"(0|[1-9][0-9]{0,17})"
#: A line edit as it is printed, or a line that is surely none.
LINE = re.compile(rf"^(?:{NUMBER} {NUMBER} (\S+)(?: (\S(?:.*\S)?))?|[A-Za-z].*|)$", re.M)
TAG_SET = frozenset(TAGS)


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each character of the first plane, and of all beyond it.

    Unsure is a letter or number younger than Unicode 3.2, and what is not assigned yet.
    """
    old = unicodedata.ucd_3_2_0.category
    kinds = np.full(BEYOND + 1, MARK, np.uint8)
    for i in range(BEYOND):
        c = chr(i)
        known = c == "_" or c.isalnum()
        if c.isspace():
            kinds[i] = SPACE
        elif (known or unicodedata.category(c) == "Cn") and old(c) == "Cn":
            kinds[i] = UNSURE
        elif known:
            kinds[i] = WORD
    kinds[BEYOND] = UNSURE
    return kinds


@functools.cache
def unsure_pattern(most: int = 24) -> str:
    """A pattern that finds all unsure characters, and rarely used sure ones: it spares the longest ranges without one."""
    unsure = np.concatenate([[-1], np.flatnonzero(_kinds() == UNSURE)])
    ranges = sorted(zip((unsure[1:] - unsure[:-1]).tolist(), (unsure[:-1] + 1).tolist(), (unsure[1:] - 1).tolist()))[-most:]
    spared = [*[(a, b) for _, a, b in ranges if a], PICTURES]
    return rf"[^\x00-\x{{{unsure[1] - 1:x}}}](?<![" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spared) + "])"


def characters(rows: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All rows as one string, its characters as numbers, and where each row begins; the end last."""
    whole = "".join(rows)
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) for x in rows], out=starts[1:])
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _row_of(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts, at, "right") - 1


def unit_begins(c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where units begin, the kind of each character, and the rows that hold an unsure one."""
    kinds = _kinds()[np.minimum(c, BEYOND)]
    beyond = np.flatnonzero(c >= BEYOND)
    if len(beyond):
        kinds[beyond[(c[beyond] >= PICTURES[0]) & (c[beyond] <= PICTURES[1])]] = MARK
    word = kinds == WORD
    inner = np.zeros(len(c), bool)
    inner[1:] = word[1:] & word[:-1]
    inner[starts[:-1][starts[:-1] < len(c)]] = False
    begins = (kinds != SPACE) & ~inner
    marks = np.flatnonzero(c[1:-1] == ord("'")) + 1
    marks = marks[(c[marks - 1] == ord("n")) & (c[marks + 1] == ord("t"))]
    for r in np.unique(_row_of(starts, marks)).tolist():
        a, b = starts[r], starts[r + 1]
        begins[a:b] = False
        begins[[a + m.start() for m in UNIT.finditer(c[a:b].tobytes().decode("utf-32-le", "surrogatepass"))]] = True
    unsure = np.zeros(len(starts) - 1, bool)
    unsure[_row_of(starts, np.flatnonzero(kinds == UNSURE))] = True
    return begins, kinds, unsure


def _before(flags: np.ndarray) -> np.ndarray:
    """How many are set before each place, and before the end."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def unit_counts(rows: list[str]) -> tuple[list[int], list[bool]]:
    """Units of each row, and which rows need a closer look."""
    _, c, starts = characters(rows)
    begins, _, unsure = unit_begins(c, starts)
    return np.diff(_before(begins)[starts]).tolist(), unsure.tolist()


@dataclass
class Edits:
    """Numbered edits of some rows: ``bounds`` has where those of each row begin, and the end."""

    bounds: list[int]
    start: list[int]
    end: list[int]
    tag: list[str]
    replacement: list[str]
    closer: list[bool]


def numbered(rows: list[str]) -> Edits:
    """The edits of marked-up rows over 1-based units of the text they show."""
    whole, c, starts = characters(rows)
    n, closer = len(c), np.zeros(len(rows), bool)

    def first(char: str, after: np.ndarray) -> np.ndarray:
        places = np.flatnonzero(c == ord(char))
        return np.append(places, n)[np.searchsorted(places, after)]

    opened = np.flatnonzero(c == ord("["))
    row = _row_of(starts, opened)
    limit = np.minimum(np.append(opened[1:], n), starts[row + 1])
    middle = first(">", opened)
    colon, closed = first(":", middle), first("]", opened)
    insert = middle == opened + 1
    fault = ~((middle < colon) & (colon < closed) & (closed < limit)) | (insert & (colon == middle + 1))
    ahead = np.where(opened > starts[row], c[np.maximum(opened, 1) - 1], ord(" "))
    fault |= insert & (ahead == ord("]"))
    closer[row[fault]] = True
    closer[_row_of(starts, np.flatnonzero(c == ord("\\")))] = True
    good = ~closer[row]
    opened, row, middle, colon, closed, insert, ahead = (x[good] for x in (opened, row, middle, colon, closed, insert, ahead))

    # A blank behind an insert goes with it, as does the one before an insert that ends the row.
    behind = closed + 1
    follows = behind < starts[row + 1]
    swallowed = behind[insert & (ahead == ord(" ")) & follows & (c[np.minimum(behind, n - 1)] == ord(" "))]
    ending = insert & ~follows & (ahead == ord(" ")) & (opened > starts[row])
    gone = opened[ending] - 1
    closer[row[ending][np.isin(gone, swallowed)]] = True
    step = np.zeros(n + 2, np.int8)
    for a, b in ((opened, opened + 1), (middle, behind), (swallowed, swallowed + 1)):
        step[a] += 1
        step[b] -= 1
    keep = np.cumsum(step[:n], dtype=np.int8) <= 0
    keep[gone] = False

    place = _before(keep)
    lines = place[starts]
    begins, kinds, unsure = unit_begins(c[keep], lines)
    closer |= unsure
    good = ~closer[row]
    opened, row, middle, colon, closed, insert = (x[good] for x in (opened, row, middle, colon, closed, insert))
    count = _before(begins)
    low, high, base = place[opened + 1], place[middle], count[lines[row]]
    before, until = count[low] - base, count[high] - base
    inner = np.append((kinds != SPACE) & ~begins, False)
    inside = (low < lines[row + 1]) & inner[low]
    begin = np.where(inside & ~insert, before, before + 1)
    end = np.where(insert, before + 1, np.where(until > 0, until + 1, begin))

    tags = [whole[a:b] for a, b in zip((colon + 1).tolist(), closed.tolist())]
    odd = [i for i, t in enumerate(tags) if t not in TAG_SET]
    closer[row[odd]] = True
    return Edits(
        np.searchsorted(row, np.arange(len(rows) + 1)).tolist(),
        begin.tolist(),
        end.tolist(),
        tags,
        [whole[a:b] for a, b in zip((middle + 1).tolist(), colon.tolist())],
        closer.tolist(),
    )


def chunks(*columns: pa.Array) -> Iterator[tuple[list[str | None], ...]]:
    """The rows of string columns, so many at a time that the first column has about ``CHUNK`` characters."""
    sizes = np.cumsum([len(x or "") for x in columns[0].to_pylist()])
    cuts = np.unique(np.append(np.searchsorted(sizes, np.arange(CHUNK, sizes[-1] if len(sizes) else 0, CHUNK)), len(columns[0])))
    a = 0
    for b in cuts.tolist():
        if b > a:
            yield tuple(x.slice(a, b - a).to_pylist() for x in columns)
            a = b


def _marked(texts: list[str | None], corrections: list[str]) -> tuple[list[str | None], Edits]:
    """For each row OK, or NULL, or none where its edits count; and the edits of those rows."""
    signals: list[str | None] = []
    for text, c in zip(texts, corrections):
        if c == "null":
            signals.append("NULL")
        elif "[" not in c or (text is not None and text.strip() == c):
            signals.append("OK")
        else:
            signals.append(None)
    return signals, numbered(["" if s else c for s, c in zip(signals, corrections)])


@F.arrow_udf(T.StringType())
def printed_edits(text: pa.Array, correction: pa.Array) -> pa.Array:
    """Line edits of marked-up corrections; ``OK`` for none, ``NULL`` for a missing one, null for a closer look."""
    out: list[str | None] = []
    for corrections, texts in chunks(correction, text):
        signals, e = _marked(texts, ["null" if c is None else c.strip() for c in corrections])
        lines = [
            f"{a} {b} {t} {r}".strip() if a == b else f"{a} {b} {t} {r}" if r else f"{a} {b} {t}"
            for a, b, t, r in zip(e.start, e.end, e.tag, e.replacement)
        ]
        for i, s in enumerate(signals):
            out.append(s or (None if e.closer[i] else "\n".join(lines[e.bounds[i] : e.bounds[i + 1]])))
    return pa.array(out, pa.string())


Span = tuple[str, str, str, str]


def _read(output: str) -> tuple[str | None, list[Span]] | None:
    """Signal and spans of printed line edits, or none for a closer look."""
    if output in ("OK", ""):
        return "OK", []
    if output == "NULL":
        return "NULL", []
    found = LINE.findall(output)
    if len(found) != output.count("\n") + 1 or ODD_SPACE.search(output):
        return None
    spans = [s for s in found if s[0]]
    return (None, spans) if spans else ("NULL", [])


def _valid(spans: list[Span], top: int) -> bool:
    """Are spans in bounds and in order, with known tags?"""
    before = -1
    for a, b, tag, _ in spans:
        start, end = int(a), int(b)
        if not (max(1, before) <= start <= end <= top and tag in TAG_SET):
            return False
        before = end
    return True


def _counts(pred: tuple[str | None, list[Span]], gold: tuple[str | None, list[Span]], top: int) -> dict[str, int | bool]:
    pf, gf = set(pred[1]), set(gold[1])
    ps, gs = {s[:2] for s in pf}, {s[:2] for s in gf}
    return {
        "pf": len(pf), "gf": len(gf), "ps": len(ps), "gs": len(gs), "f_both": len(pf & gf), "s_both": len(ps & gs),
        "p_clean": pred[0] == "OK", "g_clean": gold[0] == "OK", "valid": _valid(pred[1], top),
    }


_SIZES, _FLAGS = ("pf", "gf", "ps", "gs", "f_both", "s_both"), ("p_clean", "g_clean", "valid")
_COUNTS = pa.struct([(x, pa.int32()) for x in _SIZES] + [(x, pa.bool_()) for x in _FLAGS])


@F.arrow_udf(
    T.StructType([T.StructField(x, T.IntegerType()) for x in _SIZES] + [T.StructField(x, T.BooleanType()) for x in _FLAGS])
)
def span_counts(text: pa.Array, prediction: pa.Array, reference: pa.Array) -> pa.Array:
    """Sizes of both sets of line edits of a row and of what they share; null for a closer look.

    Nothing is null. The reference is markup where it has brackets, else lines.
    """
    out: list[dict | None] = []
    for rows in chunks(text, prediction, reference):
        texts, predictions, references = ([x.strip() for x in side] for side in rows)
        units, unsure = unit_counts(texts)
        marked = ["[" in x and "]" in x for x in references]
        signals, e = _marked(texts, [x if m else "" for x, m in zip(references, marked)])
        starts, ends = list(map(str, e.start)), list(map(str, e.end))
        torn = [BREAK.search(r) is not None for r in e.replacement]
        spans = list(zip(starts, ends, e.tag, [r.strip() for r in e.replacement]))
        for i, p in enumerate(map(_read, predictions)):
            a, b = e.bounds[i], e.bounds[i + 1]
            g = _read(references[i]) if not marked[i] else None if e.closer[i] or any(torn[a:b]) else (signals[i], spans[a:b])
            out.append(None if p is None or g is None or unsure[i] else _counts(p, g, units[i] + 1))
    return pa.array(out, _COUNTS)
