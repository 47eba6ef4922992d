"""Wikitables as header and rows, spans filled in."""

from __future__ import annotations

import re
from functools import lru_cache

from cinegrain.markup.core import KEPT, SHORT

# Fixed value: wider spans count as this.
MOST_SPAN = 100
_ATTRIBUTES = re.compile(r"^((?:[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s|]+)\s*)+)\|(?!\|)\s*")
# First words of header cells.
HEADER_WORDS = ("year", "title", "award", "film", "work", "show", "serial", "name")


def find_tables(text: str) -> list[str]:
    """Whole tables in order; one within another belongs to the outer one."""
    out, depth, start = [], 0, 0
    for m in _TABLE_SIGN.finditer(text) if "{|" in text else ():
        if m[1] == "{|":
            start = m.start() if not depth else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(text[start : m.end()])
    if depth:
        out.append(text[start:])
    return out


_TABLE_SIGN = re.compile(r"^[ \t:]*(\{\||\|\})", re.MULTILINE)


@lru_cache(KEPT)
def header_key(cell: str) -> str:
    """A header cell without marks, in lower case and without a plural ending."""
    text = re.sub(r"\{\{[^{}]*\}\}|<[^>]*>|'{2,}|\([^)]*\)|\[\[(?:[^\]|]*\|)?|\]\]", " ", cell).lower()
    text = re.sub(r"\s+", " ", text).strip()
    return text[:-1] if len(text) > 4 and text.endswith("s") else text


_HEAD_CUT = re.compile(r"!!|\|\|")


def _cells(line: str) -> list[tuple[str, int, int]]:
    line = line.lstrip()
    body = line[1:].lstrip() if line[:1] in ("!", "|") else line
    cells = map(str.strip, _HEAD_CUT.split(body) if line[:1] == "!" else body.split("||"))
    return [(c, 1, 1) if "=" not in c or "|" not in c else _kept_spanned(c) if len(c) <= SHORT else _spanned(c) for c in cells]


def _spanned(cell: str) -> tuple[str, int, int]:
    """The text of a cell without its attributes, and the rows and columns that it spans."""
    m = _ATTRIBUTES.match(cell)
    span = lambda name: min(MOST_SPAN, max(1, int(s[1]))) if m and (s := re.search(rf"{name}\s*=\s*[\"']?(\d+)", m[1], re.IGNORECASE)) else 1
    return cell[m.end() :].strip() if m else cell, span("rowspan"), span("colspan")


_kept_spanned = lru_cache(KEPT)(_spanned)


def read_table(table: str, merge_bullets: bool = False) -> dict:
    """(header, rows): cells of a row or column span stand in every place they cover; empty cells keep their place.

    The first row with two cells or more, one of which starts with a header word, is the header. Of a cell that spans
    columns only the first column is carried down.
    """
    blocks: list[list[str]] = [[]]
    for line in table.split("\n"):
        start = line.lstrip()[:2]
        if start == "|-":
            blocks.append([])
        elif start in ("{|", "|}", "|+"):
            continue
        elif start[:1] in ("!", "|") and start:
            blocks[-1].append(line)
        elif merge_bullets and blocks[-1] and start and start[0] in "*#":
            blocks[-1][-1] += "\n" + line
    header, rows = None, []
    carry: dict[int, tuple[str, int]] = {}
    for block in blocks:
        cells = [c for line in block for c in _cells(line)]
        if not cells:
            continue
        if header is None and not rows and len(cells) >= 2 and any(header_key(c[0]).startswith(HEADER_WORDS) for c in cells):
            header = [header_key(c[0]) for c in cells]
            continue
        if all(c[1] == c[2] == 1 for c in cells):
            led = 0
            while led in carry:
                led += 1
            if led == len(carry):  # only columns before the row's own are carried down, or none
                rows.append([*(carry[k][0] for k in range(led)), *(c[0] for c in cells)])
                carry = {k: (t, left - 1) for k, (t, left) in carry.items() if left > 1}
                continue
        row: list[str] = []
        pending = dict(carry)
        carry.clear()
        new: dict[int, tuple[str, int]] = {}
        for text, down, across in cells:
            while len(row) in pending:
                t, left = pending.pop(len(row))
                if left > 1:
                    new[len(row)] = (t, left - 1)
                row.append(t)
            for k in range(across):
                if k == 0 and down > 1:
                    new[len(row)] = (text, down - 1)
                row.append(text)
        while len(row) in pending:
            t, left = pending.pop(len(row))
            if left > 1:
                new[len(row)] = (t, left - 1)
            row.append(t)
        carry.update(new)
        rows.append(row)
    return {"header": header, "rows": rows}
