"""Several values packed in one field: infer a source's separators, then one row per value with its position."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinegrain.session import cut, small

# Signs and words that may part values; each is a candidate that a source's values accept or not.
CANDIDATES = {
    "newline": r"\s*\n\s*",
    "tab": r"\s*\t\s*",
    "semicolon": r"\s*[;；]\s*",
    "comma": r"\s*[,，،]\s*",
    "ideographic comma": r"\s*、\s*",
    "slash": r"\s*/\s*",
    "bar": r"\s*\|\s*",
    "dot": r"\s*[·•‧∙]\s*",
    "ampersand": r"\s*&\s*",
    "plus": r"\s*\+\s*",
    "dash": r"\s+[–—-]\s+",
    "hyphen": r"-",
    "number": r"(?:(?<=\s)|\A)\d{1,3}[.)]\s+",
    "and": r"\s+and\s+|(?<![^\s,;/|&+·•])and\s+",
    "with": r"\s+(?:with|w/)\s+",
    "featuring": r"\s*[(\[]?\b(?:featuring|feat\.?|ft\.?)\s+",
    "full stop": r"\.\s+",
}
_SEPARATOR = re.compile("|".join(f"(?P<c{i}>{p})" for i, p in enumerate(CANDIDATES.values())), re.IGNORECASE)
_NAMES = list(CANDIDATES)

# What stands for no value.
PLACEHOLDERS = frozenset("n/a na tba tbd tbc none nil null unknown uncredited various ? ?? - -- – — … ... . * n.a. not known to be announced to be determined".split() + ["not known", "to be announced", "to be determined", "not available", "not applicable"])

# Lead-ins before a list of names.
_LEAD_IN = re.compile(
    r"\A\s*(?:(?:sung|performed|written|composed|lyrics|lyrics and music|words|music|vocals|produced|directed|sung and written)\s+by\b\s*:?"
    r"|(?:singers?|vocals?|vocalists?|artists?|performers?|writers?|lyrics?|lyricists?|composers?|words|music|performed|sung|starring|cast|directors?|producers?|studios?|languages?)\s*(?:\(s\))?\s*:)\s*",
    re.IGNORECASE,
)

_LISTS = frozenset(["plainlist", "plain list", "ubl", "unbulleted list", "hlist", "flatlist", "flat list", "bulleted list", "cslist", "comma separated entries", "unbulleted", "ubil", "ordered list", "collapsible list"])
_FIRST_ARGUMENT = frozenset(["nowrap", "nobr", "small", "ill", "interlanguage link", "smaller", "nobold", "noitalic", "big", "sortname", "no wrap"])
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.DOTALL)
_REFERENCE = re.compile(r"<ref\b[^>]*/\s*>|<ref\b[^>]*>.*?(?:</ref\s*>|\Z)", re.DOTALL | re.IGNORECASE)
_BREAK = re.compile(r"<br\b[^>]*>", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_TEMPLATE = re.compile(r"\{\{((?:[^{}]|\{(?!\{)|\}(?!\}))*)\}\}")
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_URL = re.compile(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]")
_BULLET = re.compile(r"^[ \t]*[*#:]+[ \t]*", re.MULTILINE)
# Private-use signs: a link's label is one value, whatever signs it holds.
_OPEN, _SHUT = "\ue100", "\ue101"


def _template(m: re.Match) -> str:
    name, *parts = re.split(r"\|(?![^\[]*\]\])", m[1])
    name = name.strip().lower().replace("_", " ")
    values = [p for p in parts if not re.match(r"\s*[A-Za-z_]+\s*=", p)]
    if name in _LISTS:
        return "\n" + "\n".join(v.strip() for v in values) + "\n"
    if name in _FIRST_ARGUMENT:
        return values[0] if values else ""
    if name in ("lang", "langx", "transl"):
        return values[1] if len(values) > 1 else ""
    return ""


def visible(raw: str) -> str:
    """A raw value without comments, references, tags and templates; list items on lines, labels of links marked."""
    text = _REFERENCE.sub("", _COMMENT.sub("", raw))
    text = _TAG.sub("", _BREAK.sub("\n", text))
    n = 1
    while n:  # the innermost templates of each round; there are ever fewer braces
        text, n = _TEMPLATE.subn(_template, text)
    text = _LINK.sub(lambda m: _OPEN + m[1].rpartition("|")[2].strip() + _SHUT, text)
    text = _URL.sub(r"\1", text)
    text = re.sub(r"'{2,5}", "", text)
    return html.unescape(_BULLET.sub("\n", text)).replace("\xa0", " ")


def acts_pattern(acts: Iterable[str]) -> re.Pattern | None:
    """A pattern for names that are one value as a whole, longest first."""
    names = sorted({a for a in acts if a}, key=lambda a: (-len(a), a))
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)") if names else None


_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‟": "”"}
_REMARK = re.compile(r"[(\[](?!\s*(?:feat|ft)\b)", re.IGNORECASE)
_CLOSER = {"(": ")", "[": "]"}
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]*")
_NOTHING = re.compile(r"n/a\b", re.IGNORECASE)


def _quoted(text: str, at: int) -> int | None:
    """The place after a quotation that begins at ``at``, doubled quotation marks inside; None if it doesn't end."""
    shut, i = _QUOTES[text[at]], at + 1
    while (i := text.find(shut, i)) >= 0:
        if shut == '"' and text[i + 1 : i + 2] == '"':
            i += 2
            continue
        return i + 1
    return None


def atoms(raw: str, acts: re.Pattern | None) -> list[tuple[str, str, str]]:
    """(candidate before it, separator text, piece) of every piece between candidates that stand outside quotations,
    brackets, links and acts."""
    text = visible(raw)
    if (m := _LEAD_IN.match(text)) and m.end() < len(text):
        text = text[m.end() :]
    whole = {m.start(): m.end() for m in acts.finditer(text)} if acts else {}
    out, piece, before, sep, at, opened = [], [], "", "", 0, False
    blank, looked = True, 0  # whether the piece has only white space yet, and how much of it was looked at
    while at < len(text):
        c = text[at]
        if blank and looked < len(piece):
            blank, looked = not any(p.strip() for p in piece[looked:]), len(piece)
        if at in whole:
            piece.append(text[at : whole[at]])
            at = whole[at]
        elif blank and (m := _NOTHING.match(text, at)):
            piece.append(m[0])
            at = m.end()
        elif c == _OPEN:
            end = text.find(_SHUT, at)
            piece.append(text[at + 1 : end])
            at = end + 1
        elif c in _QUOTES and blank and (end := _quoted(text, at)):
            piece.append(_bare(text[at + 1 : end - 1].replace('""', '"')))
            at = end
        elif c in _CLOSER and _REMARK.match(text, at):
            end = text.find(_CLOSER[c], at)
            end = len(text) if end < 0 else end + 1
            piece.append(text[at:end])
            at = end
        elif m := _SEPARATOR.match(text, at):
            out.append((before, sep, "".join(piece)))
            piece, before, sep = [], _NAMES[m.lastindex - 1], m[0]
            blank, looked = True, 0
            opened = opened or "(" in m[0] or "[" in m[0]
            at = m.end()
        elif c in ")]" and opened:
            at, opened = at + 1, False
        else:  # no candidate begins within a word
            end = _WORD.match(text, at + 1).end() if c.isalpha() else at + 1
            piece.append(text[at:end])
            at = end
    out.append((before, sep, "".join(piece)))
    return out


def _bare(text: str) -> str:
    return text.replace(_OPEN, "").replace(_SHUT, "")


def neat(piece: str) -> str:
    """A value without the signs around it; empty for a placeholder."""
    value = _SPACES.sub(" ", _bare(piece)).strip()
    while len(value) > 1 and value[0] in _QUOTES and value[-1] == _QUOTES[value[0]] and value.count(value[0]) <= 2:
        value = value[1:-1].strip()
    value = value.strip(" ,;/|·•、&+")
    return "" if value.lower() in PLACEHOLDERS else value


@lru_cache(maxsize=100_000)
def shape(value: str) -> str:
    """The type of a piece: its words by kind, without a remark in brackets or an inner nickname."""
    value = re.sub(r"\([^)]*\)|\"[^\"]*\"", " ", value)
    words = []
    for word in value.split():
        word = re.sub(r"[A-ZÀ-Þ]\.", "I", word)
        word = re.sub(r"[^\W\d_]+", lambda m: "W" if m[0][0].isupper() and len(m[0]) > 1 else "I" if m[0] == "I" or m[0].isupper() else "w" if m[0].islower() else "o", word)
        words.append(re.sub(r"\d+", "9", word))
    return " ".join(words)


_FIELDS = ["before", "sep", "raw", "val", "shape"]
_PIECES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in _FIELDS]))


def split_values(df: DataFrame, source: str, row: str, value: str, acts: Sequence[str] = (), least_share: float = 0.005) -> DataFrame:
    """(source, row, pos BIGINT, val): one row for each value packed in ``value``.

    Every value is cut at all candidate separators outside quotations, brackets, links and ``acts``. Then each source
    scores each candidate over all its rows: piece type regularity is the share of its occurrences with pieces on both
    sides whose shape is one that undivided values of the source have (a share of ``least_share`` at least), against
    that of the piece left whole; piece-count consistency is the share of its occurrences that leave no empty place.
    A candidate is accepted where parting is more regular than not; pieces around the others are joined again.

    The scores are one row per source and candidate; those tables go to all tasks where there are 10,000 sources at
    most, and are joined by shuffle beyond. Everything else is narrow but for the removal of repeated rows. Values are
    parsed once.

    Defined cases: null and empty values and placeholders give no rows; repeated rows count once; ``pos`` counts from
    1 over the values that are left; unclosed quotations and brackets are ordinary signs or end with the value; rows
    with a null key or source are kept under the null key. Names in ``acts`` are at most a few thousand.
    """
    names = sorted({a for a in acts if a})

    def parse(batches):
        pattern = acts_pattern(names)
        for batch in batches:
            seen: dict[str, list[tuple]] = {}  # equal values of a batch are parsed once
            columns, ends = [[] for _ in _FIELDS], [0]
            for raw in batch.column(2).to_pylist():
                if raw not in seen:
                    found = atoms(raw, pattern) if neat(visible(raw)) else ()
                    pieces = [(before, sep, piece, val, shape(val)) for before, sep, piece in found for val in [neat(piece)]]
                    seen[raw] = list(zip(*pieces)) or [()] * len(_FIELDS)
                for column, more in zip(columns, seen[raw]):
                    column.extend(more)
                ends.append(len(columns[0]))
            flat = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["source", "row", "pieces"])

    rows = df.select(F.col(source).alias("source"), F.col(row).alias("row"), F.col(value).alias("value")).filter("value is not null and value <> ''").distinct()
    pieces = cut(rows.mapInArrow(parse, T.StructType([*rows.schema.fields[:2], T.StructField("pieces", _PIECES)])))

    # Shapes of values that no candidate parts; candidates that leave nothing on one side don't part a value.
    filled = F.filter("pieces", lambda p: p["val"] != "")
    single = pieces.select("source", filled.alias("f")).filter("size(f) = 1").groupBy("source", F.col("f")[0]["shape"].alias("shape")).agg(F.count("*").alias("n"))
    totals = single.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("total"))
    common = single.join(totals, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("n") >= F.col("total") * least_share)
    known = common.groupBy(F.col("source").alias("known_of")).agg(F.collect_set("shape").alias("known"))  # at most 1 / least_share shapes

    # Neighbouring pieces: (candidate, left, right), from the second piece on.
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("pieces") - 1),
        lambda i: F.struct(F.get("pieces", i)["before"].alias("cand"), F.get("pieces", i)["sep"].alias("sep"), F.get("pieces", i - 1)["shape"].alias("left"), F.get("pieces", i)["shape"].alias("right")),
    )
    near = pieces.filter("size(pieces) > 1").select("source", F.explode(pairs).alias("p")).groupBy("source", "p.cand", "p.sep", "p.left", "p.right").agg(F.count("*").alias("n"))
    near = near.join(small(known), F.col("source").eqNullSafe(F.col("known_of")), "left")
    regular = lambda s: F.coalesce(F.array_contains("known", s), F.lit(False))
    inner = (F.col("left") != "") & (F.col("right") != "")
    n = F.col("n")
    scores = near.groupBy("source", "cand").agg(
        F.sum(F.when(inner & regular(F.col("left")) & regular(F.col("right")), n).otherwise(0)).alias("parted"),
        F.sum(F.when(inner & regular(F.concat("left", "sep", "right")), n).otherwise(0)).alias("whole"),
        F.sum(F.when(inner, n).otherwise(0)).alias("inner"),
        F.sum(n).alias("seen"),
    )
    regularity = F.col("parted") / F.greatest("inner", F.lit(1))
    consistency = F.col("inner") / F.col("seen")
    accepted = scores.filter((F.col("inner") == 0) | ((regularity * F.sqrt(consistency) > 0.05) & (F.col("parted") > F.col("whole"))))
    accepted = accepted.groupBy(F.col("source").alias("accepted_of")).agg(F.collect_set("cand").alias("accepted"))

    joined = pieces.join(small(accepted), F.col("source").eqNullSafe(F.col("accepted_of")), "left")
    kept = F.coalesce(F.col("accepted"), F.array().cast("array<string>"))

    # Pieces around a candidate that isn't accepted are joined again.
    none = F.array().cast("array<struct<raw:string,val:string>>")

    def step(done, p):
        new = F.struct(p["raw"].alias("raw"), p["val"].alias("val"))
        last = F.element_at(done, -1)
        text = F.concat(last["raw"], p["sep"], p["raw"])
        again = F.struct(text.alias("raw"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("val"))
        return F.when((F.size(done) == 0) | F.array_contains(kept, p["before"]), F.concat(done, F.array(new))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(again)))

    values = F.filter(F.transform(F.aggregate("pieces", none, step), lambda p: p["val"]), lambda v: (v != "") & ~F.lower(v).isin(*sorted(PLACEHOLDERS)))
    out = joined.select("source", "row", F.posexplode(values).alias("at", "val"))
    return out.select(F.col("source").alias(source), F.col("row").alias(row), (F.col("at") + 1).cast("bigint").alias("pos"), "val")
