"""The kept structure of marked-up text: headings, list items, code and formulas as plain text.

One left-to-right pass sets aside code, formulas, comments and references, since each protects what lies in it from the
others; templates, tables and file links are then dropped, and what is left is read line by line. Wiki markup may hold
HTML; free text is first told to be wiki, HTML, Markdown or LaTeX by its signs, since one sign (such as a leading
number sign) means different things in them.
"""

from __future__ import annotations

import html
import re
import unicodedata

# Private-use signs around the number of something set aside, and before a block made from HTML.
_A, _Z, _H, _I = "\ue100", "\ue101", "\ue102", "\ue103"
_PRIVATE = re.compile("[\ue100-\ue1ff]")
_TOKEN = re.compile(f"{_A}(\\d+){_Z}")

_COMMON = [
    ("comment", r"^(?:<!--.*?-->[ \t]*)+|<!--.*?(?:-->|\Z)"),  # one at a line's start leaves no blank before the rest
    ("ref", r"<ref\b[^<>]*/\s*>|<ref\b[^<>]*>.*?(?:</ref\s*>|\Z)|<references\b[^<>]*/?>"),
    ("code", r"<(?P<tag>pre|source|syntaxhighlight)\b[^<>]*>(?P<code>.*?)</(?P=tag)\s*>"),
    ("plain", r"<nowiki\s*>(?P<plain>.*?)</nowiki\s*>|<nowiki\s*/>"),
    ("formula", r"<math\b[^<>]*>(?P<math>.*?)</math\s*>|<span\s+class=[\"']?math[^<>]*>\s*(?P<span>.*?)\s*</span>"),
    ("note", r"<sup\b[^<>]*\breference\b[^<>]*>.*?</sup\s*>"),
]
_INDENTED = [("indented", r"(?:\A|^[ \t]*\n)(?P<ind>(?: {4}|\t)(?!\s*(?:[-*+]|\d+[.)])\s)[^\n]*\S[^\n]*(?:\n(?: {4}|\t)[^\n]*)*)")]
_FENCES = [("fence", r"^(?P<indent> {0,3})(?P<fence>```+|~~~+)[^\n`]*\n(?P<fenced>.*?)(?:^ {0,3}(?P=fence)[`~]*[ \t]*$|\Z)")]
_TEX = [
    ("texcode", r"\\begin\{(?P<env>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(?P<verbatim>.*?)\\end\{(?P=env)\}"),
    ("texmath", r"\\begin\{(?P<menv>equation|align|displaymath|gather|multline|eqnarray|math)(?P<star>\*?)\}(?P<tex>.*?)\\end\{(?P=menv)(?P=star)\}"),
]
_DELIMITED = [("delimited", r"\\\((?P<round>.*?)\\\)|\\\[(?P<square>.*?)\\\]")]
_DOLLARS = [("dollars", r"(?<![\\$])\$\$(?P<double>.+?)\$\$|(?<![\\$\w])\$(?P<single>(?![\s$])(?:[^$\n\\]|\\.)*?(?<![\s\\]))\$(?![\d$\w])")]


def _scanner(parts: list[tuple[str, str]]) -> re.Pattern:
    return re.compile("|".join(f"(?P<is_{n}>{p})" for n, p in parts), re.DOTALL | re.IGNORECASE | re.MULTILINE)


_SCANNERS = {
    "wiki": _scanner(_COMMON),
    "html": _scanner(_COMMON + _DELIMITED),
    "markdown": _scanner(_FENCES + _INDENTED + _COMMON + _DELIMITED + _DOLLARS),
    "latex": _scanner(_TEX + _COMMON + _DELIMITED + _DOLLARS),
}
_INNER = ("ind", "code", "math", "span", "fenced", "verbatim", "tex", "round", "square", "double", "single")

_SIGNS = {
    "wiki": re.compile(r"\[\[|\{\{|''|<ref\b|__[A-Z]+__|^=+[^=\n]+=+\s*$|^\{\||<(?:source|syntaxhighlight|nowiki)\b|\[https?://[^\]\s]+ ", re.MULTILINE),
    "html": re.compile(r"<(?:p|a|sup|td|div)\b[^<>]*>|<span class=|<pre[^<>]*><code|</(?:p|a)>"),
    "markdown": re.compile(r"\]\([^()\s]*\)|\[\^\w+\]|^(?:```|~~~)|\*\*\w[^*\n]*\*\*|^#{1,6} .*|^\|[ -]*-{3}|(?<!\w)[*_]\w[^*_\n]*\w[*_](?!\w)|^\s*(?:[-+]|\d+[.)])\s+\S|^[^\n]+\n(?:-{3,}|={3,})\s*$|^\$\$|^ {4}\S", re.MULTILINE),
    "latex": re.compile(r"\\(?:begin|end|item|href|textbf|textit|emph|cite|footnote|section|subsection|subsubsection|paragraph|chapter|texttt|url|ref|label)\b|\\[&#_$%']|\{\\it\b"),
}
_CODE = re.compile(r"<(pre|source|syntaxhighlight)\b.*?</\1\s*>|^(```|~~~).*?^\2|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\3\}|<!--.*?-->", re.DOTALL | re.MULTILINE)


def dialect(text: str) -> str:
    """The markup that a free text uses: wiki, html, markdown, latex or plain."""
    bare = _CODE.sub(lambda m: "" if m[0].startswith("<!") else f"\n{m[0][:6]}\n", text)
    n = {k: len(p.findall(bare)) for k, p in _SIGNS.items()}
    if re.search(r"\\begin\{(?:verbatim|lstlisting)\}", text):
        n["latex"] += 2
    if n["wiki"] and n["markdown"] and not re.search(r"\]\(|\[\^|\*\*\w[^*\n]*\*\*|^(?:```|~~~)|^\s*(?:[-+]|\d+[.)])\s", bare, re.MULTILINE):
        n["markdown"] = 0  # leading number signs are then wiki items
    lone = re.findall(r"^#+ *\S.*$", bare, re.MULTILINE)
    if len(lone) > 1 and n["markdown"] == sum(bool(re.match(r"#{1,6} ", x)) for x in lone) and all(x.startswith("#") and not x.startswith("###") for x in lone):
        n["markdown"] = 0
        n["wiki"] += 1
    best = max(("latex", "markdown", "wiki", "html"), key=lambda k: n[k])
    if n[best] == 0:
        if re.search(r"<(?:li|h[1-6]|pre|math)\b", text, re.IGNORECASE):
            return "wiki"
        return "wiki" if re.search(r"^(?:[*#]+ *\S| \S)", text, re.MULTILINE) else "plain"
    return best


_TEMPLATE = re.compile(r"^\{\{(?:[^{}]|\{(?!\{)|\}(?!\}))*\}\}[ \t]*|\{\{(?:[^{}]|\{(?!\{)|\}(?!\}))*\}\}", re.MULTILINE)
_TABLE = re.compile(r"^[ \t:]*\{\|(?:(?!^[ \t:]*\{\|).)*?(?:^[ \t]*\|\}|\Z)", re.DOTALL | re.MULTILINE)
_HTML_TABLE = re.compile(r"<table\b(?:(?!<table\b).)*?(?:</table\s*>|\Z)", re.DOTALL | re.IGNORECASE)
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_HIDDEN_LINK = re.compile(r"\s*(?:file|image|media|category)\s*:", re.IGNORECASE)
_URL = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]+[ \t]*([^\[\]]*)\]")
_TAG = re.compile(r"<br\b[^<>]*>|</?(?:p|div|ul|ol|dl|dd|dt|table|tr|td|th|blockquote|center|section)\b[^<>]*>|(</?[A-Za-z][^<>]*>)", re.IGNORECASE)
_HEADING = re.compile(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", re.DOTALL | re.IGNORECASE)
_LI = re.compile(r"<li\b[^<>]*>(.*?)(?=<li\b|</li\s*>|</?[uo]l\b|\n[ \t]*\n|<h[1-6]\b|\Z)", re.DOTALL | re.IGNORECASE)
_BLOCK = re.compile(r"</li\s*>|</?[uo]l\b[^<>]*>", re.IGNORECASE)
_SWITCH = re.compile(r"__[A-Z]{3,}__")
_QUOTES = re.compile(r"'{2,}")
_SPACE = re.compile(r"[\s\xa0\u2007\u200b\u202f\ufeff]+")
_WIKI_HEADING = re.compile(r"^(={1,6})(.+?)\1\s*$")
_WIKI_ITEM = re.compile(r"^([*#:;]*[*#])\s*(.*)$")
_MD_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_MD_HEADING = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_MD_RULE = re.compile(r"^ {0,3}(?:=+|-{2,})[ \t]*$")
_MD_BAR = re.compile(r"^\s*\|.*\|\s*$")
_TEX_HEADING = re.compile(r"^\s*\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{")
_TEX_ITEM = re.compile(r"^\s*\\item\b\s*(?:\[[^\]]*\])?\s*(.*)$")
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c"}


def _collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def _strip_tex(text: str) -> str:
    """LaTeX inline markup as plain text: notes and citations go, labels and arguments stay."""
    old = None
    while text != old:  # every change takes a backslash or a brace away
        old = text
        text = re.sub(r"\\(?:cite[a-z]*|footnote|label|ref|index|includegraphics|vspace|hspace)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", text)
        text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"\{\\(?:it|bf|em|tt|sc|sl|rm|sf|itshape|bfseries|small|large)\b\s*([^{}]*)\}", r"\1", text)
        text = re.sub(r"\\(['`^\"~=.])\{?(\\?[A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m[2].lstrip("\\") + _ACCENTS[m[1]]), text)
        text = re.sub(r"\\([cv])\{([A-Za-z])\}", lambda m: unicodedata.normalize("NFC", m[2] + _ACCENTS[m[1]]), text)
        text = re.sub(r"\\textbackslash(?:\{\})?", lambda m: "\ue1f0", text)
        text = re.sub(r"\\(?:text[a-z]{2}|emph|underline|mbox|url|textrm|texttt|enquote)\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"(?<!\\)~", " ", text).replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”")
    text = text.replace("\\ldots", "…").replace("\\\\", " ")
    text = re.sub(r"\\([&%$#_{}~^])(?:\{\})?", r"\1", text)
    return text.replace("\ue1f0", "\\")


def _strip_markdown(text: str) -> str:
    """Markdown inline markup as plain text; signs within words stay."""
    text = re.sub(r"\[\^[^\]\s]+\]", "", text)
    text = re.sub(r"!\[[^\]]*\]\([^()]*(?:\([^()]*\)[^()]*)*\)", "", text)
    text = re.sub(r"\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)", r"\1", text)
    text = re.sub(r"<(https?://[^<>\s]+)>", r"\1", text)
    for mark in (r"\*\*\*", r"\*\*", r"\*"):
        text = re.sub(rf"(?<![\\*]){mark}(?=[^\s*])((?:[^*]|\\\*)*?[^\s*\\]){mark}(?!\*)", r"\1", text)
    for mark in ("___", "__", "_"):
        text = re.sub(rf"(?<![\\\w]){mark}(?=[^\s_])(.*?[^\s_\\]){mark}(?!\w)", r"\1", text)
    text = re.sub(r"~~(?=\S)(.*?\S)~~", r"\1", text)
    text = re.sub(r"(`+)(.+?)\1", r"\2", text)
    return re.sub(r"\\([\\`*_{}\[\]()#+.!|>~-])", r"\1", text)


def elements(text: str | None, kind: str | None = None) -> list[tuple[str, str]]:
    """(kind, content) of each heading, item, code and formula in order of appearance.

    ``kind`` is the markup ("wiki" for wikitext); None tells it from the text. A null or empty text has no elements,
    and an unclosed mark ends with the text. An element without content is none.
    """
    if not text:
        return []
    text = _PRIVATE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    kind = kind or dialect(text)
    if kind == "plain":
        return []
    held: list[tuple[str, str]] = []

    def hold(what: str, content: str) -> str:
        held.append((what, _collapse(content)))
        return f"{_A}{len(held) - 1}{_Z}"

    def scan(m: re.Match) -> str:
        groups = m.groupdict()
        if groups.get("plain") is not None:
            return hold("text", html.unescape(groups["plain"]))
        inner = next((groups[g] for g in _INNER if groups.get(g) is not None), None)
        if inner is None:
            return ""
        if any(groups.get(g) is not None for g in ("ind", "code", "fenced", "verbatim")):
            if groups.get("code") is not None:
                inner = html.unescape(re.sub(r"\A\s*<code\b[^<>]*>|</code\s*>\s*\Z", "", inner, flags=re.IGNORECASE))
            return hold("code", inner) if groups.get("ind") is None else "\n" + hold("code", inner)
        if groups.get("span") is not None or groups.get("math") is not None:
            inner = re.sub(r"\A\s*(?:\\\(|\\\[|\${1,2})|(?:\\\)|\\\]|\${1,2})\s*\Z", "", inner)
        if kind != "latex":
            inner = html.unescape(inner)
        return hold("formula", inner)

    text = _SCANNERS[kind].sub(scan, text)
    n = 1  # each round takes what is innermost, until nothing is left; every hit shortens the text or ends a mark
    while n:
        text, n = _TEMPLATE.subn("", text)
    n = 1
    while n:
        text, n = _TABLE.subn("", text)
        text, m = _HTML_TABLE.subn("\n", text)
        n += m
    n = 1
    while n:
        text, n = _LINK.subn(lambda m: "" if _HIDDEN_LINK.match(m[1]) else (m[1].partition("|")[2] or m[1].lstrip(":")), text)
    text = _HEADING.sub(lambda m: f"\n{_H}" + m[2].replace("\n", " ") + "\n", text)
    text = _BLOCK.sub("\n", _LI.sub(lambda m: f"\n{_I}" + m[1].replace("\n", " ") + "\n", text))

    def source(content: str) -> str:
        return _TOKEN.sub(lambda m: held[int(m[1])][1], content)

    def inline(content: str) -> str:
        content = _TAG.sub(lambda m: "" if m[1] else " ", _URL.sub(r"\1", content))
        if kind in ("wiki", "html"):
            content = _SWITCH.sub("", _QUOTES.sub("", content))
        elif kind == "markdown":
            content = _strip_markdown(content)
        elif kind == "latex":
            content = _strip_tex(content)
        return _collapse(source(html.unescape(content) if kind != "latex" else content))

    out: list[tuple[str, str]] = []

    def emit(what: str, content: str) -> None:
        if content:
            out.append((what, content))

    def held_in(line: str) -> None:
        for m in _TOKEN.finditer(line):
            if held[int(m[1])][0] != "text":
                emit(*held[int(m[1])])

    indented: list[str] = []

    def flush() -> None:
        if indented:
            emit("code", _collapse(html.unescape("\n".join(indented))))
            indented.clear()

    lines = text.split("\n")
    listing, last_blank, skip = False, True, False
    for i, line in enumerate(lines):
        if skip:
            skip = False
            continue
        blank = not line.strip()
        if kind == "wiki" and line[:1] == " " and not blank and not _TOKEN.search(line):
            indented.append(line)
            continue
        flush()
        held_in(line)
        if blank:
            last_blank = True
            continue
        if line.startswith(_H):
            emit("heading", inline(line[1:]))
            listing = False
        elif line.startswith(_I):
            emit("item", inline(line[1:]))
        elif kind in ("wiki", "html"):
            if m := _WIKI_HEADING.match(line):
                emit("heading", inline(m[2]))
            elif kind == "wiki" and (m := _WIKI_ITEM.match(line)):
                emit("item", inline(m[2]))
        elif kind == "markdown":
            if _MD_BAR.match(line):
                listing = False
            elif m := _MD_HEADING.match(line):
                emit("heading", inline(m[1] or ""))
                listing = False
            elif (m := _MD_ITEM.match(line)) and (listing or len(m[1]) < 4):
                emit("item", inline(m[2]))
                listing = True
            elif i + 1 < len(lines) and _MD_RULE.match(lines[i + 1]) and last_blank and not _TOKEN.fullmatch(line.strip()):
                emit("heading", inline(line))
                listing, skip = False, True
            elif not line.startswith(" "):
                listing = False
        elif kind == "latex":
            if m := _TEX_HEADING.match(line):
                depth, end = 1, m.end()
                while end < len(line) and depth:
                    depth += {"{": 1, "}": -1}.get(line[end], 0)
                    end += 1
                emit("heading", inline(line[m.end() : end - (depth == 0)]))
            elif m := _TEX_ITEM.match(line):
                emit("item", inline(m[1]))
        last_blank = False
    flush()
    return out
