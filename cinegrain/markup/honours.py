"""Awards of a page: rows of tables, lines of honours lists, and award names in the prose around them."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from cinegrain.markup.core import KEPT, lead_markup, plain, sections, wiki_links
from cinegrain.markup.tables import find_tables, read_table

# Words by which sections, award names, nouns, categories and headings are told.
_SECTION = re.compile(r"accolad|award|honou?r|recogni", re.IGNORECASE)
_NAME = re.compile(r"award|honou?r|prize|medal|padam|padma|national film|filmfare|siima|iifa|screen|stardust|zee cine|nandi|karnataka state|kerala state|tamil nadu state|national|festival", re.IGNORECASE)
_NOUN = re.compile(r"\b(?:awards?|honou?rs?|honorary|doctorate|prizes?|medals?|festivals?|samman|puraskaram?|fellowship)\b", re.IGNORECASE)
_CATEGORY = re.compile(r"^(?:best|special|jury|lifetime|life time|runner|grand prix|silver|gold|second|versatile|upcoming|outstanding)", re.IGNORECASE)
_GENERIC = re.compile(r"\b(?:awards?|accolades?|honou?rs?|nominations?|recognitions?|and|other|list|of|received|films?|television|tv|series|cinema|for|the)\b", re.IGNORECASE)
_HEADER = {
    "year": "year", "award": "award", "awardshow": "award", "awardshistory": "award", "award ceremony": "award", "ceremony": "award", "festival": "award", "category": "category", "categorie": "category", "work": "work", "nominated work": "work",
    "film": "work", "title": "work", "show": "work", "serie": "work", "series": "work", "nominee": "recipients", "nominees": "recipients", "recipient": "recipients", "recipients": "recipients", "artist": "recipients", "result": "result", "outcome": "result",
}
_AWARDS_TABLE = re.compile(r"\{\{\s*awards table[^}]*\}\}", re.IGNORECASE)
_YEARS = re.compile(r"\d{4}(?:\s*[–—-]\s*\d{0,4})?")


class Award(NamedTuple):
    year: str | None = None
    award: str | None = None
    awardwikititle: str | None = None
    category: str | None = None
    work: str | None = None
    workwikititle: str | None = None
    recipients: str | None = None
    result: str = ""

    @property
    def key(self) -> tuple:
        return self.year, self.award, self.category, self.work

    @property
    def is_label(self) -> bool:
        """Nothing but a name."""
        return not (self.year or self.category or self.work or self.recipients or self.result)


def _flat(raw: str) -> str:
    return re.sub(r"\s+", " ", plain(raw)).replace("''", "").strip()


@lru_cache(KEPT)
def is_generic(name: str) -> bool:
    """A name of general words only, which names no ceremony."""
    return not re.sub(r"\W|_", "", _GENERIC.sub("", name))


@lru_cache(KEPT)
def ceremony_of(heading: str) -> tuple[str, str | None] | None:
    """(name, article) of the ceremony that a heading or a definition names."""
    name = _flat(heading).rstrip(": ")
    if not name or not _NAME.search(name) or is_generic(name):
        return None
    return name, next((k["target"] for k in wiki_links(heading)), None)


def _of_category(link: dict) -> bool:
    return bool(re.search(r"\baward for\b", link["target"], re.IGNORECASE))


def result_of(raw: str) -> str | None:
    """won or nominated, of a template or a word at the start; None if a cell says neither."""
    mark = re.search(r"\{\{\s*(won|w|nominated|nom|n)\s*[|}]", raw, re.IGNORECASE)
    word = mark[1].lower() if mark else (re.match(r"\W*(won|nominat)", plain(raw), re.IGNORECASE) or [None, ""])[1].lower()
    return {"w": "won", "n": "nominated"}.get(word[:1])


# --- tables ----------------------------------------------------------------------------------------------------------
_BULLET, _NOMINATED = re.compile(r"\n\s*\*"), re.compile(r"\bnominat", re.IGNORECASE)


def _expanded(cells: list[str]) -> list[list[str]]:
    """A row for each bullet of the first cell that holds a list, and one for the text before it."""
    at = next((i for i, c in enumerate(cells) if _BULLET.search(c)), None)
    if at is not None:
        lines = [x.strip() for x in cells[at].split("\n") if x.strip()]
        entries = [x.lstrip("*# ") for i, x in enumerate(lines) if x[0] in "*#" or i == 0]
        return [[*cells[:at], e, *cells[at + 1 :]] for e in entries if e] or [cells]
    return [cells]


def _unlisted(cell: str) -> str:
    """A cell without the signs of a list before it."""
    return re.sub(r"^\s*[*#]+\s*", "", cell) if "*" in cell or "#" in cell else cell


def _read_row(cells: tuple[str, ...], fields: tuple[str | None, ...]) -> tuple[Award, bool]:
    """What a row's own cells say, each read by its column, or by its looks where the row doesn't fit the header; and
    whether the category came from a link to an award's category."""
    got: dict[str, str | None] = {}
    linked = False
    for raw, field in zip(cells, fields):
        text = _flat(raw)
        links = wiki_links(raw)
        article = links[0]["target"] if links else None
        looks_year = bool(_YEARS.fullmatch(text))
        if looks_year and "year" not in got and field in ("year", None):
            got["year"] = text
            continue
        result = result_of(raw)
        if result and (field in ("result", None) or "result" not in got):
            got["result"] = result
            continue
        if not text:
            continue
        category_link = bool(links) and _of_category(links[0])
        names_award = field == "award" or (field is None and "award" not in got and bool(_NAME.search(raw)))
        if names_award and not category_link:
            if looks_year:  # an edition: its year, and the ceremony its link leads to
                got.setdefault("year", text)
                if article and not _YEARS.fullmatch(article):
                    got |= {"award": article, "awardwikititle": article}
            else:
                got |= {"award": text, "awardwikititle": article}
        elif category_link and "category" not in got:
            got["category"], linked = text, True
        elif field in ("category", "recipients"):
            got[field] = text
        elif field in ("work", None):
            if field == "work" or (article and "work" not in got):
                got |= {"work": text, "workwikititle": article}
            else:
                free = next((k for k in ("category", "work", "award") if k not in got), None)
                if free:
                    got[free] = text
    return Award(**{**got, "result": got.get("result") or ""}), linked


@lru_cache(KEPT)
def _own(cells: tuple[str, ...], header: tuple[str | None, ...]) -> tuple[Award, bool, bool] | None:
    """What a row says by itself: its fields, whether the category is a link's and whether a cell says nominated; None if it is blank."""
    cells = tuple(map(_unlisted, cells))
    if not any(map(str.strip, cells)):
        return None
    return *_read_row(cells, header if len(header) == len(cells) else (None,) * len(cells)), any(map(_NOMINATED.search, cells))


def _of_table(table: str, ceremony: tuple[str, str | None] | None) -> list[Award]:
    view = read_table(table, merge_bullets=True)
    header = tuple(_HEADER.get(h) for h in view["header"] or [])
    lists = "*" in table and _BULLET.search(table)
    out: list[Award] = []
    last = Award()
    for cells in (v for row in view["rows"] for v in _expanded(row)) if lists else view["rows"]:
        if (own := _own(tuple(cells), header)) is None:
            continue
        (year, award, article, category, work, workarticle, recipients, result), linked, nominated = own
        # What a row leaves open is that of the row before: cells of several rows say it once.
        carried = not award and bool(last.award)
        if carried:
            award, article = last.award, last.awardwikititle
        if not work and last.work and (carried or "work" in header):
            work, workarticle = last.work, last.workwikititle
        if not year and (award or work or category):
            year = last.year
        result = result or last.result
        # What is carried on; a category and recipients are not.
        last = Award(year or last.year, award or last.award, article if award else last.awardwikititle, None, work or last.work, workarticle if work else last.workwikititle, None, result)
        if not (year or category or work or recipients or result):
            continue
        if not award and ceremony:
            award, article = ceremony
        if not award and linked:
            award, category = category, None
        if not award:
            continue
        if not result and "result" not in header:  # a list of honours: won unless it says otherwise
            result = "nominated" if nominated else "won"
            award = re.sub(r"\s*\(\s*nominated\s*\)\s*$", "", award, flags=re.IGNORECASE)
        out.append(Award(year, award, article, category, work, workarticle, recipients, result))
    return out


# --- lists -----------------------------------------------------------------------------------------------------------
def work_in(raw: str) -> tuple[str, str | None] | None:
    """(title, article) of the work in a line: what is italic, or what follows "for" in a link or in quotation marks."""
    link = r"\[\[(?P<a>[^\]|\[]+)(?:\|(?P<b>[^\]\[]*))?\]\]"
    for pattern in (rf"''\s*{link}\s*''", rf"(?=\[\[[^\]|]+\|''[^']+''\]\]){link}", r"''(?P<b>.{2,}?)''", rf"\bfor\s+{link}", r"\bfor\s+'(?P<b>[^']+)'"):
        if m := re.search(pattern, raw):
            found = m.groupdict()
            title = (found.get("b") or found.get("a") or "").replace("''", "").strip()
            if title:
                return title, (found.get("a") or "").strip() or None
    return None


def _line(raw: str, detail: bool) -> Award | None:
    """What a line says; None where it is prose. ``detail`` lines, below another bullet, say the category."""
    text = re.sub(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>|\[\[(?:File|Image|Media):[^\]]*\]\]", "", raw, flags=re.IGNORECASE | re.DOTALL)
    text = re.sub(r"\s+", " ", text.strip().lstrip(":#* ")).strip().rstrip(".").strip()
    if not text or text[0].islower() or re.search(r"\b(?:he|she|they)\s+(?:was|were|is|are|received|accepted|served|has|have)\b", text, re.IGNORECASE):
        return None
    links = wiki_links(text)
    edition = next((k for k in links if _YEARS.fullmatch(k["label"])), None)
    category_link = next((k for k in links if _of_category(k)), None)
    ceremony = next((k for k in links if k not in (edition, category_link) and _NAME.search(k["target"]) and not _of_category(k)), None)
    lead = re.match(r"(?:in\s+)?(\d{4})(?=[\s–—:,-])", text, re.IGNORECASE)
    year = lead[1] if lead else re.search(r"\d{4}", edition["label"])[0] if edition else None
    clean = lambda k: k["label"].replace("''", "").strip() if k else None
    award, category = clean(ceremony), clean(category_link)
    work, article = work_in(text) or (None, None)
    if work and (work == award or (ceremony and article == ceremony["target"])):
        work = article = None
    # The words left, by which category, award and year are told where no link says them.
    rest = re.sub(r"^(?:in\s+)?\d{4}\s*[–—:,-]?\s*", "", _flat(text), flags=re.IGNORECASE) if lead else _flat(text)
    bracket = re.search(r"\(([^()]*)\)\s*$", rest)
    if bracket:
        inner = bracket[1].strip()
        if re.fullmatch(r"\d{4}", inner):
            year = year or inner
        elif _CATEGORY.match(inner):
            category = category or inner
        rest = rest[: bracket.start()].strip()
    for said in filter(None, (work, award, category)):
        rest = rest.replace(said, " ", 1)
    result = "nominated" if re.search(r"\bnominat|\{\{\s*n(?:om)?\s*[|}]", text, re.IGNORECASE) else "won"
    if detail:
        category = category or re.sub(r"\W*(?:nominated|won|winner)\W*$", "", rest, flags=re.IGNORECASE).strip(" ,–—-") or None
    else:
        pieces = [p.strip() for p in re.split(r"\s*[–—:,]\s*|\s+-\s+", rest) if p.strip()]
        if not award:
            piece = next((p for p in pieces if _NOUN.search(p) and not _CATEGORY.match(p)), "")
            if own := re.search(r",?\s*(?:in\s+)?(\d{4})$", piece):
                year, piece = year or own[1], piece[: own.start()]
            piece = re.split(r"\s+(?:by|at)\s+", piece)[0].strip(" ()")
            award = piece if piece and not re.match(r"(?:first|second|third|joint|shared|special)\b", piece, re.IGNORECASE) else None
        if not category and (piece := next((p for p in pieces if _CATEGORY.match(p)), None)):
            category = re.sub(r"\s+(?:at|by|for|in|from)$", "", piece, flags=re.IGNORECASE)
        if not year and (own := re.search(r"(?:^|[\s,(])(\d{4})\W*$", rest)):
            year = own[1]
    found = Award(year, award, ceremony["target"] if ceremony else None, category, work, article, None, result)
    return found if year or award or category or work else None


def _of_lists(body: str, ceremony: tuple[str, str | None] | None) -> list[Award]:
    out: list[Award] = []
    about = Award()  # what definitions above say
    parent: Award | None = None
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    for i, line in enumerate(lines):
        bold = re.match(r"'''\s*(\[\[[^\]]+\]\])\s*'''", line)
        if line[0] == ";" or bold:
            parent = None
            if named := ceremony_of(bold[1] if bold else line[1:]):
                about = about._replace(award=named[0], awardwikititle=named[1])
            elif work := work_in(line[1:]):
                about = about._replace(work=work[0], workwikititle=work[1])
            continue
        depth = len(line) - len(line.lstrip("*"))
        if not depth and not re.match(r"\d{4}\s*[–—:-]", line):
            continue
        own = _line(line, depth > 1)
        if own is None:
            continue
        heads = depth == 1 and own.award and not own.category and not own.work and i + 1 < len(lines) and lines[i + 1].startswith("**")
        if heads:
            parent = own
            continue
        if not own.award:
            source = about if about.award else parent if depth > 1 and parent else Award()
            if not source.award and ceremony:
                source = Award(award=ceremony[0], awardwikititle=ceremony[1])
            own = own._replace(award=source.award, awardwikititle=source.awardwikititle)
        if not own.award:
            continue
        if not own.year and depth > 1 and parent:
            own = own._replace(year=parent.year)
        if not own.work and about.work:
            own = own._replace(work=about.work, workwikititle=about.workwikititle)
        if depth == 1:
            parent = own
        out.append(own)
    return out


def _of_prose(body: str) -> list[Award]:
    """Names of awards linked in prose, with nothing else known."""
    out = []
    for line in body.split("\n"):
        if re.match(r"\s*[!|{;*]", line):
            continue
        for k in wiki_links(line):
            if _NAME.search(k["target"]) and not _of_category(k) and not re.match(r"list of awards", k["target"], re.IGNORECASE):
                name = k["target"] if _YEARS.fullmatch(k["label"]) else k["label"]
                if not name[0].islower():
                    out.append(Award(award=name, awardwikititle=k["target"]))
    return out


def awards(text: str | None, whole: bool = False, most: int | None = None) -> list[dict]:
    """(year, award, awardwikititle, category, work, workwikititle, recipients, result) of a page's awards.

    Sections count whose title, or a section's above them, is on awards; of a page that is a list of awards (``whole``)
    all do, its lead too. The nearest heading that names a ceremony is the award of rows that name none. Tables come
    first in a section, then list lines, then names in prose, which are left out if a fuller row names the award. The
    first row of a year, award, category and work counts. ``most`` is a report's limit; without it all come out.
    """
    found: dict[tuple, Award] = {}
    above: list[tuple[int, bool, tuple[str, str | None] | None]] = []
    own = sections(text)
    if whole and (head := lead_markup(text).strip()):
        own = [{"title": "", "level": 2, "body": head}, *own]
    for s in own:
        while above and above[-1][0] >= s["level"]:
            above.pop()
        inside = whole or bool(_SECTION.search(s["title"])) or (bool(above) and above[-1][1])
        ceremony = ceremony_of(s["title"]) or (above[-1][2] if above else None)
        above.append((s["level"], inside, ceremony))
        if not inside:
            continue
        body = _AWARDS_TABLE.sub('{| class="wikitable"', s["body"]) if "{{" in s["body"] else s["body"]
        rows: list[Award] = []
        for table in find_tables(body):
            rows += _of_table(table, ceremony)
            body = body.replace(table, "")
        if body.strip():
            rows += _of_lists(body, ceremony) + ([] if whole else _of_prose(body))
        for row in rows:
            if not is_generic(row.award):
                found.setdefault(row.key, row)
    full = {a.award.lower() for a in found.values() if not a.is_label}
    return [a._asdict() for a in found.values() if not a.is_label or a.award.lower() not in full][:most]
