"""Templates, parameters, lists, sections, links and plain text."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote

# Templates that stand for a sign, and the entities that are resolved.
SIGNS = {"inr": "₹", "usd": "US$", "indian rupee": "₹", "₹": "₹", "tba": "TBA", "tabletba": "TBA"}
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&rsquo;": "’", "&lsquo;": "‘", "&middot;": "·"}
PIPE_LISTS = {"ubl", "unbulleted list", "hlist"}
BULLET_LISTS = {"plainlist", "plain list", "flatlist", "bulleted list"}
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def template_end(text: str, start: int) -> int:
    """The place after the braces that close those at ``start``; -1 if they don't."""
    depth = 0
    for m in re.compile(r"\{\{|\}\}").finditer(text, start):
        depth += 1 if m[0] == "{{" else -1
        if not depth:
            return m.end()
    return -1


def top_level(text: str, sign: str = "|") -> list[str]:
    """The text cut at a sign that stands outside templates and links."""
    parts, depth, at = [], 0, 0
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|" + re.escape(sign), text):
        if m[0] in ("{{", "[["):
            depth += 1
        elif m[0] in ("}}", "]]"):
            depth = max(0, depth - 1)
        elif not depth:
            parts.append(text[at : m.start()])
            at = m.end()
    return [*parts, text[at:]]


def parameters(body: str) -> dict[str, str]:
    """Parameters by lower-case name; unnamed ones are numbered, blank ones use no number, the last of a name wins."""
    out: dict[str, str] = {}
    number = 0
    for part in top_level(body):
        named = re.match(r"\s*([^=\[\]{}<>|]*?)\s*=(.*)\Z", part, re.DOTALL)
        if named and named[1]:
            if re.fullmatch(r"\d+", named[1]):
                number = max(number, int(named[1]))
            out[named[1].lower()] = named[2].strip()
        elif part.strip():
            number += 1
            out[str(number)] = part.strip()
    return out


def templates(text: str, name: str) -> list[dict]:
    """Templates whose name matches the pattern, nested ones too, in order; reading ends at the first unclosed one."""
    out, at, pattern = [], 0, re.compile(name, re.IGNORECASE)
    while (at := text.find("{{", at)) >= 0:
        end = template_end(text, at)
        if end < 0:
            break
        head, _, body = text[at + 2 : end - 2].partition("|")
        if pattern.search(head.strip()):
            out.append({"name": head.strip(), "params": parameters(body), "start": at, "end": end})
        at += 2
    return out


def infobox(text: str | None) -> dict[str, str] | None:
    """The parameters of the first infobox; None without one or if it is unclosed or empty."""
    m = re.search(r"\{\{\s*infobox\s", text or "", re.IGNORECASE)
    if not m or (end := template_end(text, m.start())) < 0:
        return None
    return parameters(text[m.start() + 2 : end - 2].partition("|")[2]) or None


def _template_text(m: re.Match) -> str:
    head, *args = m[1].split("|")
    name, args = re.sub(r"\s+", " ", head.strip().lower()), [a.strip() for a in args]
    if name in ("inr", "usd") and len(args) == 1:
        return SIGNS[name] + args[0]
    if not args:
        return SIGNS.get(name, "")
    if name in ("ill", "small", "nowrap", "nobr", "no wrap", "pending film", "pending series"):
        return args[0]
    if name in ("lang", "langx") and len(args) > 1:
        return args[1]
    return ""


_INNERMOST = re.compile(r"\{\{([^{}]*)\}\}")
_COMMENT, _REFERENCE, _CLOSED_REFERENCE = re.compile(r"<!--.*?-->", re.DOTALL), re.compile(r"<ref[^>]*>.*?</ref>", re.DOTALL | re.IGNORECASE), re.compile(r"<ref[^>]*/>", re.IGNORECASE)
_FILE, _LINK, _OUTSIDE = re.compile(r"\[\[(?:File|Image|Media):[^\]]*\]\]", re.IGNORECASE), re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]"), re.compile(r"\[(?:https?:)?//[^\s\]]+[ \t]*([^\]]*)\]")
_MARKS = [(marks, re.compile(rf"{marks}(?!')(.+?)(?<!'){marks}")) for marks in ("'''''", "'''", "''")]
_BREAK, _TAG, _ENTITY, _BRACKETS = re.compile(r"<br\s*/?>", re.IGNORECASE), re.compile(r"</?[a-zA-Z][^>]*>"), re.compile("|".join(ENTITIES)), re.compile(r"\{\{|\}\}|\[\[|\]\]")
_HEAD_LINE, _BLANKS = re.compile(r"\s*={2,}\s*(.+?)\s*={2,}\s*\Z"), re.compile(r"[ \t]+")
#: Texts up to this length, such as cells, names and headings, are kept with what was read in them; and how many of them.
SHORT, KEPT = 200, 1 << 15


def plain(raw: str | None) -> str:
    """Wiki markup as text: wrapped lines join to paragraphs, headings stand alone. The order of the steps is the
    contract; a paired reference is removed before self-closing ones, so it may swallow what lies between them."""
    return _plain(raw or "") if len(raw or "") > SHORT else _kept_plain(raw or "")


def _plain(text: str) -> str:
    # A step is only taken where the text has the sign that it looks for.
    if "<" in text:
        text = _CLOSED_REFERENCE.sub("", _REFERENCE.sub("", _COMMENT.sub("", text)))
    if "[[" in text:
        text = _FILE.sub("", text)
    n = "{{" in text
    while n:  # each round resolves the innermost braces, of which there are ever fewer
        text, n = _INNERMOST.subn(_template_text, text)
    if "[" in text:
        text = _LINK.sub(lambda m: (m[2] or "").strip() or m[1].strip(), text)
        text = _OUTSIDE.sub(r"\1", text)
    for marks, pattern in _MARKS:
        if marks in text:
            text = pattern.sub(r"\1", text)
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "&" in text:
        text = _ENTITY.sub(lambda m: ENTITIES[m[0]], text)
    if "{{" in text or "}}" in text or "[[" in text or "]]" in text:
        text = _BRACKETS.sub("", text)
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        head = _HEAD_LINE.match(line) if "==" in line else None
        line = head[1] if head else line
        if "\t" in line or "  " in line:
            line = _BLANKS.sub(" ", line)
        line = line.strip()
        if head:
            out += [[line], []]
        elif line:
            out[-1].append(line)
        else:
            out.append([])
    return "\n".join(" ".join(p) for p in out if p).strip()


_kept_plain = lru_cache(KEPT)(_plain)


def list_items(raw: str | None) -> list[str]:
    """The values of a field: of a list template at its start, else parted by line breaks. Commas never part."""
    value = (raw or "").strip()
    parts = re.split(r"<br\s*/?>", value, flags=re.IGNORECASE)
    if value.startswith("{{") and (end := template_end(value, 0)) > 0:
        name, _, body = value[2 : end - 2].partition("|")
        if name.strip().lower() in PIPE_LISTS:
            parts = top_level(body)
        elif name.strip().lower() in BULLET_LISTS:
            parts = re.split(r"^\s*\*\s*", body, flags=re.MULTILINE)
    return [t for p in parts if (t := re.sub(r"\s*\n\s*", " ", plain(p)).strip())]


_HEADING = re.compile(r"^(={2,6})\s*(.+?)\s*=+\s*$", re.MULTILINE)


def sections(text: str | None) -> list[dict]:
    """(title, level, body) of each section; the lead is none."""
    text = text or ""
    heads = list(_HEADING.finditer(text)) if "==" in text else []
    ends = [h.start() for h in heads[1:]] + [len(text)]
    return [{"title": plain(h[2]), "level": len(h[1]), "body": text[h.end() : e].strip("\n")} for h, e in zip(heads, ends)]


# Titles of plot sections, the preferred first.
PLOT_TITLES = ("plot", "plots", "premise", "synopsis", "synopses", "plot summary", "plot synopsis", "story")


def plot_section(text: str | None) -> str | None:
    """The body of the section with the most preferred plot title."""
    own = {}
    for s in sections(text):
        if s["body"].strip():
            own.setdefault(s["title"].strip().lower(), s["body"])
    return next((own[t] for t in PLOT_TITLES if t in own), None)


# Sections that are shown elsewhere or only lead on.
NO_ARTICLE = re.compile(
    r"^(?:references?|external links?|see also|notes?|citations?|further reading|bibliography|sources?|footnotes?|gallery|trivia|plots?|plot (?:summary|synopsis)|premise|synops(?:is|es)|story|cast(?: and (?:characters|crew))?|main cast|principal cast"
    r"|recurring|guest|cameo appearances|voice cast|episodes?|series overview|season \d+|soundtracks?|music|music \(album\)|songs?|soundtrack album|marketing|promotion|\d+)$",
    re.IGNORECASE,
)


def article_sections(text: str | None, least: int = 60) -> list[dict]:
    """(title, text) of the sections with prose of their own, without list signs; texts shorter than ``least`` are none."""
    out = []
    for s in sections(text):
        title = s["title"].strip()
        body = "" if NO_ARTICLE.match(title) else re.sub(r"^[#*:;]+\s*", "", plain(s["body"]), flags=re.MULTILINE).strip()
        if len(body) >= least:
            out.append({"title": title[:1].upper() + title[1:], "text": body})
    return out


# Facts of a person's infobox and their labels.
PERSON_FACTS = {
    "birth_name": "Birth name", "birth_date": "Born", "birth_place": "Birthplace", "death_date": "Died", "death_place": "Place of death", "occupation": "Occupation", "years_active": "Years active", "nationality": "Nationality",
    "citizenship": "Citizenship", "spouses": "Spouse(s)", "partner": "Partner(s)", "children": "Children", "parents": "Parents", "relatives": "Relatives", "alma_mater": "Alma mater", "education": "Education", "awards": "Awards",
    "known_for": "Known for", "height": "Height", "home_town": "Home town", "other_names": "Other names", "genres": "Genres", "instruments": "Instruments", "labels": "Labels", "notable_works": "Notable works",
}


def person_facts(text: str | None) -> list[dict]:
    """(label, value) of the facts an infobox states, in their fixed order; dates are read out."""
    box = infobox(text) or {}
    said = ((label, date_text(box[key]) if key.endswith("_date") else ", ".join(list_items(box[key]))) for key, label in PERSON_FACTS.items() if box.get(key))
    return [{"label": label, "value": value} for label, value in said if value]


_NAMESPACE = re.compile(r"^\s*:?(?:file|image|media|category|wikipedia|template|portal|help|special|draft|module|user|wikt|wiktionary|commons)\s*:", re.IGNORECASE)


def wiki_links(text: str | None) -> list[dict]:
    """(target, label) of links to articles in order, the first of each target."""
    if not text or "[[" not in text:
        return []
    return [{"target": t, "label": x} for t, x in (_links(text) if len(text) > SHORT else _kept_links(text))]


def _links(text: str) -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for m in _LINK.finditer(text):
        target = m[1].partition("#")[0].strip()
        if target and target not in out and not _NAMESPACE.match(target):
            out[target] = plain(m[2] or m[1]).strip() or target
    return list(out.items())


_kept_links = lru_cache(KEPT)(_links)


def lead_markup(text: str | None) -> str:
    """What stands before the first heading, as it is."""
    m = _HEADING.search(text or "")
    return (text or "")[: m.start()] if m else text or ""


def lead(text: str | None) -> str:
    """The text before the first heading."""
    return plain(lead_markup(text))


def date_text(raw: str | None) -> str:
    """A birth or death date template as "31 May 1984"; other values as text."""
    m = re.search(r"\{\{\s*(?:birth date and age|birth date|death date and age|death date|bda|dda)\s*\|([^{}]*)\}\}", raw or "", re.IGNORECASE)
    if m:
        n = [int(p) for p in map(str.strip, m[1].split("|")) if re.fullmatch(r"\d{1,4}", p, re.ASCII)]
        if len(n) >= 3 and 1 <= n[1] <= 12 and 1 <= n[2] <= 31:
            return f"{n[2]} {MONTH_NAMES[n[1] - 1]} {n[0]}"
    return re.sub(r"\s+", " ", plain(raw)).strip()


# Link templates in the order they are read, with label, address and the parameters that may fill it.
LINK_TEMPLATES = [
    (r"netflix (?:title|show)", "Netflix", "https://www.netflix.com/title/{}", ("1", "id")),
    (r"instagram", "Instagram", "https://www.instagram.com/{}", ("1", "user", "username")),
    (r"twitter|x", "X (Twitter)", "https://twitter.com/{}", ("1", "user", "username")),
    (r"facebook", "Facebook", "https://www.facebook.com/{}", ("1", "user", "username")),
    (r"youtube", "YouTube", "https://www.youtube.com/{}", ("1", "channel")),
    (r"youtube channel", "YouTube", "https://www.youtube.com/channel/{}", ("1",)),
    (r"rotten tomatoes", "Rotten Tomatoes", "https://www.rottentomatoes.com/m/{}", ("1", "id")),
    (r"spotify artist", "Spotify", "https://open.spotify.com/artist/{}", ("1",)),
    (r"bollywood hungama person|bh person", "Bollywood Hungama", "https://www.bollywoodhungama.com/person/{}/", ("1",)),
    (r"bollywood hungama (?:movie|film)", "Bollywood Hungama", "https://www.bollywoodhungama.com/movie/{}/", ("1",)),
    (r"rotten tomatoes person", "Rotten Tomatoes", "https://www.rottentomatoes.com/celebrity/{}", ("1", "id")),
    (r"wikiquote", "Wikiquote", "https://en.wikiquote.org/wiki/{}", ("1",)),
]
HANDLES = ("Instagram", "X (Twitter)", "YouTube")  # an @ before a name isn't part of the address


def _filled(template: dict, label: str, address: str, keys: tuple[str, ...]) -> str | None:
    value = next((v for k in keys if (v := template["params"].get(k))), None)
    if value is None or (label == "YouTube" and re.match(r"https?:", value)):
        return value
    if label == "Wikiquote":
        value = quote(value.replace(" ", "_"), safe="!'()*~")
    return address.format(value.removeprefix("@") if label in HANDLES else value)


def external_links(text: str | None) -> dict:
    """(imdbid, official, links): the digits of the IMDb id, the official address, and labelled addresses.

    Links come from templates, their addresses built from the ids, then from URL templates, then from bullets with an
    outside link; the first of an address counts, and the official one is not among them.
    """
    text = text or ""
    imdb = re.search(r"\{\{\s*imdb\s*(?:title|name)\s*\|[^}]*?(?:id\s*=\s*)?(?:tt|nm)?(\d{5,10})", text, re.IGNORECASE)
    official = re.search(r"\{\{\s*official(?:\s+website|\s+url)?\s*\|\s*(?:(?:url|1)\s*=\s*)?(https?://[^\s|}]+)", text, re.IGNORECASE)
    found: dict[str, str] = {}
    for name, label, address, keys in LINK_TEMPLATES:
        for t in templates(text, f"^(?:{name})$"):
            if url := _filled(t, label, address, keys):
                found.setdefault(url, label)
    host = lambda url: re.sub(r"^(?:https?:)?//(?:www\.)?", "", url)
    for t in templates(text, "^url$"):
        url = next((t["params"][k] for k in ("1", "id", "url") if k in t["params"]), "")
        if re.match(r"https?://", url, re.IGNORECASE):
            found.setdefault(url, plain(t["params"].get("2")) or host(url).split("/")[0])
    for line in re.findall(r"^[ \t]*\*[ \t]*(.+)$", text, re.MULTILINE):
        if m := re.search(r"\[((?:https?:)?//[^\s\]]+)(?:[ \t]+([^\]]*))?\]", line):
            label = re.sub(r"[|*]", "", plain(line.replace(m[0], m[2] or "", 1))).strip()
            found.setdefault(m[1], label or re.sub("^https?://", "", m[1]))
    if official:
        found.pop(official[1], None)
    return {"imdbid": imdb[1] if imdb else None, "official": official[1] if official else None, "links": [{"label": label, "url": url} for url, label in found.items()]}


def references(text: str | None) -> list[dict]:
    """(label, url, source, date) of references in order; a use of a name takes its first definition, however late."""
    pattern = re.compile(r"<ref\b([^<>]*?)/\s*>|<ref\b([^<>]*)>(.*?)</ref\s*>", re.DOTALL | re.IGNORECASE)
    name_of = lambda s: (m[1] or m[2] or m[3]).strip().lower() if (m := re.search(r"name\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s/>]+))", s or "", re.IGNORECASE)) else None
    found = list(pattern.finditer(text or ""))
    defined: dict[str, str] = {}
    for m in found:
        if m[3] and m[3].strip() and (n := name_of(m[2])):
            defined.setdefault(n, m[3])
    out: dict[str, dict] = {}
    for m in found:
        body = (m[3] or "").strip() or defined.get(name_of(m[1] or m[2]) or "", "")
        if not body:
            continue
        cites = templates(body, r"^cit(?:e|ation)")
        if cites:
            p = cites[0]["params"]
            url = p.get("url")
            label = plain(p.get("title") or p.get("chapter") or "") or re.sub(r"^\w+://(?:www\.)?([^/]+).*", r"\1", url or "", flags=re.DOTALL)
            entry = {"label": label, "url": url, "source": plain(p.get("website") or p.get("work") or p.get("newspaper") or p.get("publisher") or "") or None, "date": p.get("date")}
        else:
            bare = re.search(r"\[?((?:https?:)?//[^\s\]]+)\s*([^\]]*)\]?", body)
            url = bare[1] if bare else None
            label = plain(bare[2]) if bare and bare[2].strip() else re.sub(r"^(?:\w+:)?//(?:www\.)?([^/]+).*", r"\1", url, flags=re.DOTALL) if url else plain(body)
            entry = {"label": label, "url": url, "source": None, "date": None}
        if entry["label"]:
            out.setdefault(entry["url"] or f"{entry['label']}|{entry['source']}", entry)
    return list(out.values())


def linked_html(text: str | None, known: dict[str, str]) -> str:
    """Text with anchors to known pages, everything else escaped; links to namespaces and sections vanish."""
    held: list[tuple[str, str]] = []

    def hold(m: re.Match) -> str:
        if _NAMESPACE.match(m[1]) or m[1].startswith("#"):
            return ""
        held.append((m[1].strip(), plain(m[2] or m[1])))
        return f"\x02{len(held) - 1}\x03"

    def escape(s: str) -> str:
        for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            s = s.replace(sign, code)
        return s

    body = escape(plain(re.sub(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]", hold, text or "")))

    def anchor(m: re.Match) -> str:
        target, label = held[int(m[1])]
        url = known.get(target)
        return f'<a href="{escape(url)}">{escape(label)}</a>' if url else escape(label)

    body = re.sub("\x02(\\d+)\x03", anchor, body)
    return "\n".join(t for line in body.split("\n") if (t := line.strip()))
