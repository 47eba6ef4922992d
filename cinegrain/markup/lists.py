"""Cast, crew, episodes, tracks, filmographies, discographies, awards and other lists of a page."""

from __future__ import annotations

import re
from functools import lru_cache

from cinegrain.markup.core import KEPT, list_items, plain, sections, templates, wiki_links
from cinegrain.markup.honours import awards  # noqa: F401
from cinegrain.markup.tables import find_tables, read_table

# Labels of crew fields; others are their words with capitals.
ROLE_LABELS = {
    "director": "Director", "creator": "Creator", "producer": "Producer", "executive_producer": "Executive producer", "writer": "Writer", "screenwriter": "Writer", "story": "Writer", "starring": "Cast", "cast": "Cast", "music": "Music", "composer": "Composer",
    "theme_music_composer": "Music", "cinematography": "Cinematographer", "editor": "Editor", "choreographer": "Choreographer", "lyricist": "Lyricist", "singer": "Singer", "production_designer": "Production designer", "art_director": "Art director",
    "costume_designer": "Costume designer", "makeup_artist": "Makeup artist", "stunt_coordinator": "Stunt coordinator", "action_director": "Action director", "dialogue": "Writer", "screenplay": "Writer", "based_on": "Based on", "narrator": "Narrator", "presenter": "Presenter",
}
# Targets of crew fields that are no persons: languages, countries, channels and services, studios.
NON_PERSONS = {
    "hindi", "tamil", "telugu", "kannada", "malayalam", "marathi", "bengali", "punjabi", "gujarati", "odia", "oriya", "assamese", "english", "urdu", "bhojpuri", "tulu", "sanskrit", "maithili", "rajasthani", "haryanvi", "konkani", "nepali",
    "tamil language", "telugu language", "kannada language", "malayalam language", "marathi language", "hindi language", "india", "pakistan", "south korea",
    "netflix", "amazon prime video", "prime video", "disney+", "disney+ hotstar", "hotstar", "jiohotstar", "sonyliv", "sony liv", "zee5", "zee telugu", "mx player", "altbalaji", "aha (streaming service)", "aha", "aha video", "manoramamax",
    "stage (streaming service)", "sun nxt", "colors (tv channel)", "starplus", "star plus", "zee tv", "sony entertainment television", "sony sab", "sab tv", "sun tv", "star maa", "etv telugu", "colors marathi", "zee marathi", "star jalsha",
    "colors kannada", "star vijay", "vijay tv", "asianet", "sun tv (india)", "jawan (streaming service)",
    "yash raj films", "t-series", "red chillies entertainment", "dharma productions", "viacom18 studios", "jio studios", "roy kapur films", "eros international", "zeal entertainment", "indian rupee", "₹",
}
_NO_PERSON = re.compile(r"^(?:file|image|media|category|wikipedia|wp|template|portal|help|special|draft|module|user|wikt|wiktionary|commons|list of|index of|table of|timeline of|glossary of|outline of)|^\d|:(?!\s)", re.IGNORECASE)


def is_person_like(title: str | None) -> bool:
    """Whether a link's target may be a person's article."""
    text = (title or "").strip().replace("_", " ")
    return bool(text) and not _NO_PERSON.search(text) and text.lower() not in NON_PERSONS


def role_label(field: str) -> str:
    key = field.strip().lower()
    return ROLE_LABELS.get(key) or re.sub(r"\b\w", lambda m: m[0].upper(), key.replace("_", " "))


def _scope(text: str, wanted: re.Pattern) -> list[dict]:
    """The first section whose title matches, and the deeper ones after it."""
    found, out = None, []
    for s in sections(text):
        if found is None:
            if wanted.search(s["title"]):
                found = s["level"]
                out.append(s)
        elif s["level"] > found:
            out.append(s)
        else:
            break
    return out


def cast(text: str | None) -> list[dict]:
    """(name, wikititle, role) of the cast section's bullets; deeper bullets add to the role before."""
    out: list[dict] = []
    for s in _scope(text or "", re.compile(r"^(?:voice )?cast\b", re.IGNORECASE)):
        for line in s["body"].split("\n"):
            m = re.match(r"\s*(\*+)\s*(.+)", line)
            if not m:
                continue
            if len(m[1]) > 1:
                if out:
                    out[-1]["role"] = f"{out[-1]['role']} {plain(m[2])}".strip()
                continue
            link = re.match(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\](.*)", m[2], re.DOTALL)
            if link:
                name, target, rest = plain(link[2] or link[1]), link[1].strip(), plain(link[3])
            else:
                name, _, rest = plain(m[2]).partition(" as ")
                target = None
                rest = f"as {rest}" if rest else ""
            role = re.sub(r"^(?:as\b|[-–—:,])\s*", "", rest.strip()).strip()
            role = re.sub(r"[\s\-–—:,]+$", "", role)
            if name.strip():
                out.append({"name": re.sub(r"[\s\-–—:,]+$", "", name.strip()), "wikititle": target, "role": role})
    return out


def person_links(box: dict[str, str] | None, members: list[dict], fields: list[str] | None = None) -> list[dict]:
    """(target, label, role): links of the infobox ``fields`` (all crew fields without), then of the cast.

    Targets that can't be persons are left out; the first role of a target counts.
    """
    out: dict[str, dict] = {}
    for field in ROLE_LABELS if fields is None else fields:
        for link in wiki_links((box or {}).get(field)):
            if is_person_like(link["target"]):
                out.setdefault(link["target"], {**link, "role": role_label(field)})
    for m in members:
        if is_person_like(m["wikititle"]):
            out.setdefault(m["wikititle"], {"target": m["wikititle"], "label": m["name"], "role": "Cast"})
    return list(out.values())


def _column(header: list[str] | None, *names: str) -> int | None:
    return next((i for n in names for i, h in enumerate(header or []) if n in h), None)


def _trim(text: str) -> str:
    return plain(text).strip().strip('"“”').strip()


def episodes(text: str | None) -> list[dict]:
    """(number, title, director, writer, airdate, summary, season): templates, then tables, per season heading.

    Table rows need an all-digit number. Without any such section, templates anywhere count. The first of a season's
    number and title counts.
    """
    out: dict[tuple, dict] = {}

    def add(season, **row):
        out.setdefault((season or 1, row["number"], row["title"]), {**row, "season": season})

    def of_templates(body, season):
        n = 0
        for t in templates(body, r"^episode list"):
            p, n = t["params"], n + 1
            add(season, number=p.get("episodenumber2") or p.get("episodenumber") or "", title=_trim(p.get("title", "")), director=plain(p.get("directedby")) or None, writer=plain(p.get("writtenby")) or None, airdate=plain(p.get("originalairdate")) or None, summary=plain(p.get("shortsummary")) or None)
        return n

    for s in sections(text):
        m = re.search(r"(?:season|series)\s+(\d+)", s["title"], re.IGNORECASE)
        if not (m or re.search("episode", s["title"], re.IGNORECASE)):
            continue
        season = int(m[1]) if m else None
        if of_templates(s["body"], season):
            continue
        for table in find_tables(s["body"]):
            view = read_table(table)
            h = view["header"]
            at = {"number": _column(h, "no", "episode", "#"), "title": _column(h, "title"), "director": _column(h, "direct"), "writer": _column(h, "writ"), "airdate": _column(h, "date"), "summary": _column(h, "summary", "synopsis")}
            for row in view["rows"]:
                got = {k: plain(row[i]) if i is not None and i < len(row) else None for k, i in at.items()}
                if got["number"] and re.fullmatch(r"\d+", got["number"], re.ASCII):
                    add(season, **{**got, "title": _trim(got["title"] or "")})
    if not out:
        of_templates(text or "", None)
    return list(out.values())


def soundtrack(text: str | None) -> dict:
    """(title, composer, tracks): track-listing templates, else tables, else numbered lines of the soundtrack section."""
    text = text or ""
    scope = _scope(text, re.compile(r"soundtrack|\bmusic\b|track listing|songs", re.IGNORECASE))
    body = "\n".join(s["body"] for s in scope) if scope else text
    listings = templates(body, r"^track ?listing") or templates(text, r"^track ?listing")
    tracks, composer = [], None
    for t in listings:
        p = t["params"]
        composer = composer or plain(p.get("all_music")) or None
        for n in sorted({int(m[1]) for k in p if (m := re.fullmatch(r"(?:title|track|song)?(\d+)", k))}):
            title = next((p[k] for k in (f"title{n}", f"track{n}", f"song{n}", str(n)) if p.get(k)), "")
            if title:
                pick = lambda *keys: next((plain(p[k]) for k in keys if p.get(k)), None)  # noqa: B023, E731
                tracks.append({"number": str(n), "title": _trim(title), "singers": pick(f"singer{n}", f"singers{n}", f"note{n}", f"vocal{n}"), "lyrics": pick(f"lyrics{n}", f"lyricist{n}", "all_lyrics"), "length": pick(f"length{n}")})
    if not tracks:
        for table in find_tables(body):
            view = read_table(table)
            h = view["header"]
            at = {"number": _column(h, "no", "#"), "title": _column(h, "title", "song", "track", "name"), "singers": _column(h, "singer", "artist", "vocal"), "lyrics": _column(h, "lyric", "writer"), "length": _column(h, "length", "duration")}
            if at["title"] is None:
                continue
            for row in view["rows"]:
                got = {k: plain(row[i]) if i is not None and i < len(row) else None for k, i in at.items()}
                if got["title"]:
                    number = re.sub(r"\D", "", got["number"] or "")
                    tracks.append({**got, "title": _trim(got["title"]), "number": number or str(len(tracks) + 1)})
    if not tracks:
        for m in re.finditer(r"^#\s*(.+)$", body, re.MULTILINE):
            title, _, rest = plain(m[1]).partition(" – ") if " – " in plain(m[1]) else plain(m[1]).partition(" - ")
            tracks.append({"number": str(len(tracks) + 1), "title": _trim(title), "singers": rest or None, "lyrics": None, "length": None})
    if composer is None and scope:
        line = next((x for x in plain(scope[0]["body"]).split("\n") if "compos" in x.lower()), None)
        composer = line
    return {"title": scope[0]["title"] if scope else None, "composer": composer, "tracks": tracks}


# Words of a heading that say the medium.
_TELEVISION = re.compile(r"television|\btv\b|serial|web series|streaming")
_FILM = re.compile(r"filmograph|\bfilms?\b|\bmovies\b|as\s+(?:an?\s+)?(?:actor|actress|director|producer|writer)")
# Sections of works, targets and titles that are none, and the columns of their tables.
_WORKS = re.compile(r"filmograph|\bfilms?\b|\bmovies\b|television|videography|notable works|music videos|web series|^as\s+(?:an?\s+)?(?:actor|actress|director|producer|writer|host|singer|artist|dancer|composer|playback)", re.IGNORECASE)
_NO_WORK = re.compile(r"^(?:\+\s*)?(?:list of|index of|awards?|accolades?|nominations?|19\d\d|20\d\d|category|wikipedia|template|the following|filmography|discography|bibliography|references|external links)", re.IGNORECASE)
_PUBLISHERS = {
    "the times of india", "hindustan times", "the indian express", "india today", "deccan herald", "deccan chronicle", "the hindu", "ndtv", "cnn-news18", "zee news", "bollywood hungama", "rediff", "dna india", "firstpost", "the free press journal", "mid-day",
    "youtube", "netflix", "amazon prime video", "disney+ hotstar", "jiocinema", "sonyliv", "mx player", "zee5", "aha (streaming service)", "sun nxt", "imdb", "rotten tomatoes", "cinema of india", "indian cinema", "bollywood", "tollywood", "kollywood", "mollywood",
    "sandalwood", "playback singing", "playback singer", "feature film", "short film", "soundtrack album", "filmfare award", "filmfare awards", "filmfare ott award", "filmfare ott awards", "national film award", "national film awards", "siima award", "siima awards",
    "iifa award", "iifa awards", "screen award", "screen awards", "stardust award", "stardust awards", "zee cine award", "zee cine awards", "nandi award", "nandi awards",
}
_LANGUAGES = re.compile(r"^(?:hindi|punjabi|tamil|telugu|kannada|malayalam|bengali|marathi|gujarati|english|urdu|assamese|odia|tulu|meitei)(?: (?:language|cinema))?$", re.IGNORECASE)
_NO_TITLE = re.compile(
    r"^(?:languages?|reviews?|year|title|roles?|notes?|ref\.?|refs|result|award|category|work|film|show|serial|network|channel|director|producer|rank|no\.|#|references?|\d{4}"
    r"|filming|filmed|released?|tba|announced|pre-?production|post-?production|production|delayed|upcoming|completed|scheduled|unreleased)$",
    re.IGNORECASE,
)
_YEARISH = re.compile(r"^(?:\d{4}(?:\s*[–—-]\s*(?:\d{0,4}|present))?|TBA|TBD|forthcoming|upcoming)$", re.IGNORECASE)
_FIELDS = {
    "year": "year", "title": "title", "film": "title", "movie": "title", "name": "title", "show": "title", "serial": "title", "serie": "title", "series": "title", "work": "title", "role": "role", "played": "role", "played as": "role", "played a": "role", "character": "role", "portrayed": "role",
    "note": "notes", "notes": "notes", "language": "notes", "director": "notes", "platform": "notes", "channel": "notes", "network": "notes", "music": "notes",
}


def is_work(target: str) -> bool:
    """Whether a link's target or a title may be a work: no list, publisher, service, award or language."""
    return not (_NO_WORK.match(target) or target.lower() in _PUBLISHERS or _LANGUAGES.match(target))


@lru_cache(KEPT)
def _work_cell(raw: str) -> tuple[str, str | None, bool]:
    """(title, target, whether it may be a work) of a cell."""
    title = _trim(raw)
    target = next((k["target"] for k in wiki_links(raw)), None)
    return title, target, bool(raw.strip()) and not _NO_TITLE.match(title) and is_work(target or title)


@lru_cache(KEPT)
def _is_year(raw: str) -> bool:
    return bool(_YEARISH.match(plain(raw)))


@lru_cache(KEPT)
def _role(raw: str | None) -> str:
    role = re.sub(r"\s*\(\s*\)", "", plain(raw)).strip()
    return "" if role == "TBA" else role


def filmography(text: str | None, most: int | None = None) -> list[dict]:
    """(heading, medium, year, title, wikititle, role, notes) of works in filmography sections, in order.

    A heading opens a block; deeper ones continue it, a matching deeper one starts a section of its own. Rows map by
    header where the cells fit it, else by position; a missing year is that of the row before in the table. Words of
    headers and states are no titles. Links outside tables are works without year. The first of a section's work
    counts; ``most`` is the report's limit over all sections.
    """
    out, seen, level, heading = [], set(), None, None
    for s in sections(text):
        if _WORKS.search(s["title"]) and not re.search("discograph", s["title"], re.IGNORECASE):
            level, heading = s["level"], s["title"]
        elif level is None or s["level"] <= level:
            level = None
            continue
        name = heading.lower()
        medium = "television" if _TELEVISION.search(name) else "film" if _FILM.search(name) else "other"
        body = s["body"]

        def add(year, title, target, role=None, notes=None, work=None):
            title = _trim(title) if work is None else title
            key = (heading, target or title)  # noqa: B023
            if len(title) < 2 and not target or key in seen or not (work or not _NO_TITLE.match(title) and is_work(target or title)):
                return
            seen.add(key)
            out.append({"heading": heading, "medium": medium, "year": year, "title": title, "wikititle": target, "role": role or None, "notes": notes or None})  # noqa: B023

        for table in find_tables(body):
            view, last = read_table(table), None
            keys = [_FIELDS.get(h) for h in view["header"] or []]
            for row in view["rows"]:
                filled = [c for c in row if c.strip()]
                got: dict[str, str] = {}
                if keys and len(filled) == len(keys):
                    for k, c in zip(keys, filled):
                        if k == "notes":
                            got[k] = "; ".join(filter(None, (got.get(k), plain(c))))
                        elif k:
                            got.setdefault(k, c)
                else:
                    rest = list(filled)
                    at = next((i for i, c in enumerate(rest) if _is_year(c)), None)
                    if at is not None:
                        got["year"] = rest.pop(at)
                    if rest:
                        got["title"] = rest.pop(0)
                    if rest:
                        got["role"] = rest.pop(0)
                    if rest:
                        got["notes"] = "; ".join(plain(c) for c in rest)
                title = got.get("title", "")
                year = plain(got["year"]) if got.get("year") else None
                if year is None and title.strip():
                    year = last
                last = year or last
                name, target, work = _work_cell(title)
                if work:
                    add(year, name, target, _role(got.get("role")), plain(got.get("notes")), work)
                else:  # a header, or no work: those linked beside it are
                    for link in wiki_links(" ".join(filled)):
                        add(year, link["label"], link["target"])
            body = body.replace(table, "")
        for link in wiki_links(body):
            add(None, link["label"], link["target"])
    return out[:most]


def discography(text: str | None, most: int | None = None) -> list[dict]:
    """(heading, year, film, song, singers, writers) of song tables: rows whose cells fit a header with a song column."""
    out = []
    for s in sections(text):
        for table in find_tables(s["body"]):
            view = read_table(table)
            h = view["header"]
            song = _column(h, "song", "track")
            if song is None:
                continue
            at = {"year": _column(h, "year"), "film": _column(h, "film", "album", "movie"), "singers": _column(h, "singer", "artist", "co-singer"), "writers": _column(h, "writer", "lyric")}
            for row in view["rows"]:
                if len(row) != len(h):
                    continue
                name = _trim(row[song])
                if len(name) < 2 or name.lower() in ("song", "songs", "track", "title"):
                    continue
                out.append({"heading": s["title"], "song": name, **{k: plain(row[i]) or None if i is not None else None for k, i in at.items()}})
    return out[:most]


# What the page is called that a {{Main}} pointer names for a subject.
SUBPAGES = {"filmography": "filmograph|discography|videography", "discography": "discography", "awards": "^list of awards", "episodes": "episodes", "soundtrack": "soundtrack|songs"}


def subpage(text: str | None, subject: str) -> str | None:
    """The page that a {{Main}} pointer names for a subject such as filmography or awards."""
    for t in templates(text or "", r"^main\s*(?:list|article)?$"):
        target = re.sub(r"<[^>]+>", "", t["params"].get("1", "")).strip()
        if re.search(SUBPAGES.get(subject, subject), target, re.IGNORECASE):
            return target
    return None


def award_totals(box: dict[str, str] | None) -> dict:
    """(wins, nominations, ceremonies) that an awards infobox states; numbering may have gaps, no number is 0."""
    box = box or {}
    number = lambda v: int(re.sub(r"\D", "", v or "") or 0)
    found = []
    for n in sorted({int(m[1]) for k in box if (m := re.fullmatch(r"award(\d+)", k))}):
        found.append({"award": plain(box[f"award{n}"]), "wins": number(box.get(f"award{n}w")), "nominations": number(box.get(f"award{n}n"))})
    return {"wins": number(box.get("wins")), "nominations": number(box.get("nominations")), "ceremonies": found}


def bio_sections(text: str | None, most: int | None = None, least: int = 40) -> list[dict]:
    """(heading, text) of the early and the personal life."""
    out = []
    for s in sections(text):
        kind = "Early life" if re.match(r"early (?:life|years)|(?:life|background) and (?:education|family)", s["title"], re.IGNORECASE) else "Personal life" if re.match(r"personal life", s["title"], re.IGNORECASE) else None
        body = plain(s["body"])
        if kind and len(body) >= least:
            out.append({"heading": kind, "text": body[:most]})
    return out


def title_page(kind: str, title: str, wikitext: str | None) -> dict:
    """The main fields of a work's page."""
    from cinegrain.markup.core import infobox, plot_section

    box = infobox(wikitext) or {}
    first = lambda *keys: next((v for k in keys if (v := list_items(box.get(k)))), [])
    return {
        "kind": kind, "title": title, "directedby": first("director"), "producedby": list(dict.fromkeys(list_items(box.get("producer")) + list_items(box.get("executive_producer")))),
        "writtenby": list(dict.fromkeys(list_items(box.get("writer")) + list_items(box.get("screenplay")) + list_items(box.get("story")))), "starring": first("starring"), "musicby": first("music", "composer"),
        "studio": first("studio", "production_companies", "company"), "language": ", ".join(first("language")), "runtime": plain(box.get("runtime")) or None, "budget": plain(box.get("budget")) or None,
        "plot": plain(plot_section(wikitext)) or None, "n_references": len(re.findall(r"<ref", wikitext or "")),
    }


