"""Text columns: normal forms, claims (dates, numbers, obligation words) and digests.

Native expressions are used for white space, punctuation, obligation words and predicates. Unicode normal form, token
extraction with offsets and the FNV digest have no Spark function; they are pandas functions over Arrow batches, and a
query should apply ``nfkc`` once and reuse the column, as Spark evaluates such functions for all rows.

White space means the characters in ``WS``, which Java's ``\\s`` does not cover. Offsets count code points.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, insort
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

#: White space, characters between which a space is kept, obligation words and their classes.
WS_CHARS = r"\t\n\x0B\f\r\x20\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{WS_CHARS}]"
KEEP_BETWEEN = "A-Za-z0-9〇零一二三四五六七八九两"
MODALS = ("严禁", "不得", "禁止", "必须", "应当", "可以", "不应", "宜")
MODAL_CLASS = {
    "可以": "can",
    "宜": "recommend",
    "应": "should",
    "应当": "should",
    "须": "must",
    "必须": "must",
    "不应": "should_not",
    "不得": "must_not",
    "禁止": "prohibit",
    "严禁": "strict_prohibit",
}
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SMALL = {"十": 10, "百": 100, "千": 1000}
LARGE = (("兆", 10**12), ("亿", 10**8), ("万", 10**4))
CURRENCY = {"元": 0, "万元": 4, "百万元": 6, "千万元": 7, "亿元": 8, "百亿元": 10, "千亿元": 11, "万亿元": 12}
COUNTED = "项个次笔家人倍年月日条"
CREDENTIALS = (
    r"(?i)(?:(?<![A-Za-z0-9_])(?:sk|pk)-[A-Za-z0-9_-]{8,}(?![A-Za-z0-9_])|Bearer[\s]+[^\s]+|api[_ -]?key\s*[:=]\s*[^\s]+"
    r"|session[-_ ]?secret|credential\s*[:=])"
)
ARTICLE = rf"^{WS}*(第[〇零一二三四五六七八九十百千万两0-9]+条)"

_SPACE = re.compile(WS)
#: After words were split and joined by single spaces: those that are not between two characters of KEEP_BETWEEN.
_LOOSE = re.compile(f" (?:(?![{KEEP_BETWEEN}])|(?<![{KEEP_BETWEEN}] ))")
#: Every character of WS.
WHITE = "".join(chr(c) for c in range(0x10000) if _SPACE.match(chr(c)))


# -- native expressions ------------------------------------------------------------------------------------------


def squeeze(c: Column) -> Column:
    """Drop white space, but keep one space between two of the characters of ``KEEP_BETWEEN``. ``c`` is in NFKC."""
    # what stands before is asked once a white space is found, not at every character, and a single space stays as it is
    p = f"[{KEEP_BETWEEN}]"
    once = F.regexp_replace(c, f"{WS}(?<={p}{WS})(?:{WS}+|(?<! ))(?={p})", " ")
    return F.regexp_replace(once, f"{WS}(?:(?<!{p}{WS}){WS}*|{WS}*(?!{p}))", "")


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def collapse_ws(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), "^ | $", "")


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def compact(c: Column) -> Column:
    """``squeeze`` without punctuation."""
    return without_punctuation(squeeze(c))


def without_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{P}+", "")


def modal_terms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({'|'.join(MODALS)})"), 1)


def modal_class(c: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in MODAL_CLASS.items() for x in kv))[trim_ws(c)]


def single_modal_contexts(c: Column) -> Column:
    """Every 应 or 须 with its squeezed clause, in order: ``应:before<应>after``. ``c`` is in NFKC."""
    clauses = F.transform(F.split(c, r"[。！？!?；;\r\n]+"), squeeze)
    marks = lambda s: F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1)).isin("应", "须"))
    shown = lambda s, i: F.concat(
        F.substr(s, i, F.lit(1)), F.lit(":"), F.substr(s, F.lit(1), i - 1), F.lit("<"), F.substr(s, i, F.lit(1)), F.lit(">"), F.substr(s, i + 1)
    )
    found = F.flatten(F.transform(clauses, lambda s: F.transform(marks(s), lambda i: shown(s, i))))
    return F.when(c.rlike("[应须]"), found).otherwise(F.array().cast("array<string>"))


def article_of(c: Column) -> Column:
    """The article heading at the start of a unit, or null."""
    return F.nullif(F.regexp_extract(c, ARTICLE, 1), F.lit(""))


def has_credentials(c: Column) -> Column:
    return F.coalesce(c.rlike(CREDENTIALS), F.lit(False))


def in_order(wanted: Column, offered: Column) -> Column:
    """Whether the array ``wanted`` is a subsequence of the array ``offered``."""
    step = lambda at, x: F.when(at < 0, at).otherwise(
        F.when(
            F.array_position(F.slice(offered, at + 1, F.greatest(F.size(offered) - at, F.lit(0))), x) > 0,
            at + F.array_position(F.slice(offered, at + 1, F.greatest(F.size(offered) - at, F.lit(0))), x).cast("int"),
        ).otherwise(F.lit(-1))
    )
    return F.aggregate(wanted, F.lit(0), step) >= 0


def utc_timestamp_valid(c: Column) -> Column:
    return F.coalesce(
        c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z$") & F.try_to_timestamp(c).isNotNull(), F.lit(False)
    )


# -- claims ------------------------------------------------------------------------------------------------------


def numeral(s: str) -> int | None:
    """A Chinese numeral: positional digits, or digits with units up to 兆.

    Read from left to right: a digit waits for its unit; 十, 百 and 千 add to the section below the next large unit; a
    large unit multiplies all that came since the last unit as large."""
    if s and all(c in DIGITS for c in s):
        return int("".join(str(DIGITS[c]) for c in s))
    held: list[tuple[int, int]] = []  # (unit, value), units falling
    section, digit, large = 0, None, dict(LARGE)
    for c in s:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in SMALL:
            section, digit = section + (digit or 1) * SMALL[c], None
        elif c in large:
            value, bare = section + (digit or 0), digit is None and not section
            while held and held[-1][0] < large[c]:
                value, bare = value + held.pop()[1], False
            held.append((large[c], (1 if bare else value) * large[c]))
            section, digit = 0, None
        else:
            return None
    return sum(v for _, v in held) + section + (digit or 0) if s else None


_CN, _CN10 = "[〇零一二三四五六七八九]", "[〇零一二三四五六七八九十]"
_EDGE, _GAP = "(?<![A-Za-z0-9_])", f"{WS}*"
#: The forms of dates, those with more parts first.
DATES = [
    re.compile(x)
    for x in (
        rf"{_EDGE}([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})(?![A-Za-z0-9_])",
        rf"([0-9]{{4}})年{_GAP}([0-9]{{1,2}})月{_GAP}([0-9]{{1,2}})日",
        rf"({_CN}{{4}})年{_GAP}({_CN10}{{1,3}})月{_GAP}({_CN10}{{1,3}})日",
        rf"([0-9]{{4}})年{_GAP}([0-9]{{1,2}})月",
        rf"({_CN}{{4}})年{_GAP}({_CN10}{{1,3}})月",
        rf"{_EDGE}([0-9]{{4}})年",
        rf"({_CN}{{4}})年",
    )
]


def _date(parts: tuple[str, ...]) -> str | None:
    read = [int(p) if p.isascii() else numeral(p) for p in parts]
    if None in read:
        return None
    return "-".join(f"{n:0{4 if k == 0 else 2}d}" for k, n in enumerate(read))


def date_spans(s: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of every form that matches, overlaps included, by start and then by form."""
    found = [(m.start(), k, m.end(), _date(m.groups())) for k, form in enumerate(DATES) for m in form.finditer(s)]
    return [(a, b, t) for a, _, b, t in sorted(found) if t]


class Taken:
    """Spans that do not overlap."""

    def __init__(self):
        self.spans: list[tuple[int, int, str]] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.spans, (end,))
        return not (k and self.spans[k - 1][1] > start)

    def add(self, start: int, end: int, token: str | None) -> None:
        if token and self.free(start, end):
            insort(self.spans, (start, end, token))


_VALUE = r"(?:[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?|[〇零一二三四五六七八九十百千万亿兆两]+%s(?:点[〇零一二三四五六七八九两]+)?)"
_UNITS = [*sorted(CURRENCY, key=lambda u: -CURRENCY[u]), "%", "‰", *COUNTED, "万", "亿"]
#: Ratios, values with units, values after a currency, bare values.
RATIO = re.compile(rf"(百分之|千分之){_GAP}({_VALUE % ''})")
WITH_UNIT = re.compile(rf"({_VALUE % '?'}){_GAP}({'|'.join(_UNITS)})")
AFTER_SIGN = re.compile(rf"(人民币|￥|¥|\$){_GAP}({_VALUE % ''})")
BARE = re.compile(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?")
EXPONENT = {"百分之": -2, "千分之": -3, "%": -2, "‰": -3, "万": 4, "亿": 8} | CURRENCY
SUFFIX = dict.fromkeys(("百分之", "千分之", "%", "‰"), "比例") | dict.fromkeys(CURRENCY, "元") | {"万": "", "亿": ""}


def plain_decimal(value: str, exponent: int = 0) -> str | None:
    """``value`` times ten to ``exponent``, exactly, without needless zeros."""
    value = value.replace(",", "")
    if not value[:1].isascii():
        whole, point, rest = value.partition("点")
        read = numeral(whole)
        if read is None:
            return None
        value = f"{read}.{''.join(str(DIGITS[c]) for c in rest)}" if point else str(read)
    with localcontext() as ctx:
        ctx.prec = len(value) + abs(exponent) + 4
        shown = format(Decimal(value).scaleb(exponent), "f")
    return shown.rstrip("0").rstrip(".") if "." in shown else shown


def number_spans(s: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of numbers, by start; of overlapping ones the kind that comes first in the list above."""
    taken = Taken()

    def token(value: str, unit: str, suffix: str) -> str | None:
        n = plain_decimal(value, EXPONENT.get(unit, 0))
        return None if n is None else n + suffix

    for m in RATIO.finditer(s) if "分之" in s else ():
        taken.add(*m.span(), token(m[2], m[1], SUFFIX[m[1]]))
    for m in WITH_UNIT.finditer(s):
        taken.add(*m.span(), token(m[1], m[2], SUFFIX.get(m[2], m[2])))
    for m in AFTER_SIGN.finditer(s):
        taken.add(*m.span(), token(m[2], "", "美元" if m[1] == "$" else "元"))
    for m in BARE.finditer(s):
        taken.add(*m.span(), token(m[0], "", ""))
    return taken.spans


_MODAL = re.compile("|".join(MODALS))
_SENTENCE = re.compile("[^。！？!?；;\r\n]+")


def sentences(s: str) -> list[str]:
    return [m[0].strip() for m in _SENTENCE.finditer(s) if m[0].strip()]


def modals_in(s: str) -> list[str]:
    return _MODAL.findall(s)


def _typed(token: str) -> str:
    for suffix, kind in (("美元", "AMOUNT:USD"), ("元", "AMOUNT:CNY"), ("比例", "RATIO")):
        if token.endswith(suffix):
            return f"<{kind}:{token[: -len(suffix)]}> "
    if token[-1] in COUNTED:
        return f"<COUNT:{token[-1]}:{token[:-1]}> "
    return f"<NUMBER:{token}> "


def squeezed(s: str) -> str:
    """``squeeze`` of one string."""
    s = re.sub(f"(?<=[{KEEP_BETWEEN}]){WS}+(?=[{KEEP_BETWEEN}])", " ", s)
    return re.sub(f"(?<![{KEEP_BETWEEN}]){WS}+|{WS}+(?![{KEEP_BETWEEN}])", "", s)


def normal_text(s: str) -> str:
    """NFKC and ``squeeze`` of one string. Words are split where they need no search: ``bytes.split`` knows the white space
    of ASCII, ``str.split`` that of ``WS`` but for the characters that are asked for first."""
    if s.isascii():
        return _LOOSE.sub("", b" ".join(s.encode().split()).decode())
    s = unicodedata.normalize("NFKC", s)
    if "\ufeff" in s or "\x85" in s or "\x1c" in s or "\x1d" in s or "\x1e" in s or "\x1f" in s:
        return squeezed(s)
    return _LOOSE.sub("", " ".join(s.split()))


#: What every date, number and obligation word has one of; a set of characters is looked for faster than the forms below.
_MAY_CLAIM = re.compile(f"[0-9{''.join(DIGITS)}{''.join(SMALL)}{''.join(c for c, _ in LARGE)}{''.join(m[0] for m in MODALS)}]")
_DIGIT, _MARKED = re.compile("[0-9]"), re.compile(f"{_MAY_CLAIM.pattern[:-1]}须]")
#: No text without one of these has a date, a number or an obligation word.
_CLAIMS = re.compile(f"[0-9{''.join(DIGITS)}{''.join(SMALL)}{''.join(c for c, _ in LARGE)}]|{'|'.join(MODALS)}")


def protected_spans(s: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, token) of what a statement must keep, by kind: ``date`` with overlaps and ``number`` and
    ``modal`` without, each in order; and ``claim``, the spans that a skeleton replaces and what stands for them. One scan
    finds whether there is anything; most texts end there."""
    if not _MAY_CLAIM.search(s) or not _CLAIMS.search(s):
        return []
    forms = DATES if "年" in s else DATES[:1]
    found = [(m.start(), k, m.end(), _date(m.groups())) for k, form in enumerate(forms) for m in form.finditer(s)]
    dates = Taken()
    for start, _, end, token in sorted(found, key=lambda x: (x[1], x[0])):
        dates.add(start, end, token)
    numbers, modals = number_spans(s), [(m.start(), m.end(), m[0]) for m in _MODAL.finditer(s)]
    marks = [(a, -b, f"<DATE:{t}> ") for a, b, t in dates.spans]
    marks += [(a, -b, _typed(t)) for a, b, t in numbers if dates.free(a, b)]
    marks += [(a, -b, f"<MODAL:{MODAL_CLASS[t]}> ") for a, b, t in modals]
    out = [("date", a, b, t) for a, _, b, t in sorted(found) if t]
    out += [("number", a, b, t) for a, b, t in numbers] + [("modal", a, b, t) for a, b, t in modals]
    at = 0
    for start, end, token in sorted(marks, key=lambda x: x[:2]):
        if start >= at:
            out.append(("claim", start, -end, token))
            at = -end
    return out


def clauses_of_single_modals(s: str) -> list[str]:
    """``single_modal_contexts`` of one string."""
    if "应" not in s and "须" not in s:
        return []
    shown = [squeezed(c) for c in re.split(r"[。！？!?；;\r\n]+", s)]
    return [f"{x}:{c[:i]}<{x}>{c[i + 1 :]}" for c in shown for i, x in enumerate(c) if x in "应须"]


def stands_in(wanted: list[str], offered: list[str]) -> bool:
    """``in_order`` of two lists."""
    rest = iter(offered)
    return all(x in rest for x in wanted)


def claim_skeleton(s: str, spans: list[tuple[str, int, int, str]] | None = None) -> str:
    """``s`` with its dates, numbers and obligation words as typed tokens, squeezed."""
    out, at = [], 0
    for kind, start, end, token in protected_spans(s) if spans is None else spans:
        if kind == "claim":
            out += [s[at:start], token]
            at = end
    return squeezed("".join([*out, s[at:]]))


def normalized_range(text: str, query: str) -> tuple[int, int] | None:
    """Where ``query`` stands in ``text`` once both are normalized: offsets in ``text``, the end exclusive."""
    query = squeezed(unicodedata.normalize("NFKC", query))
    if not query:
        return None
    shown, places = [], []
    words = [(k, unicodedata.normalize("NFKC", c)) for k, c in enumerate(text)]
    solid = [k for k, c in enumerate(text) if not _SPACE.match(c)]
    keep = re.compile(f"[{KEEP_BETWEEN}]")
    for k, c in words:
        if not _SPACE.search(c):  # some marks become a space and a mark; they count as white space
            shown.append(c)
            places += [k] * len(c)
            continue
        left, right = bisect_left(solid, k) - 1, bisect_left(solid, k + 1)
        around = [words[solid[i]][1] for i in (left, right) if 0 <= i < len(solid)]
        if len(around) == 2 and keep.fullmatch(around[0]) and keep.fullmatch(around[1]) and (not shown or shown[-1] != " "):
            shown.append(" ")
            places.append(k)
    at = "".join(shown).find(query)
    return None if at < 0 else (places[at], places[at + len(query) - 1] + 1)


FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _fnv(data: bytes, h: int = FNV_START) -> int:
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a64(data: str) -> str:
    return f"fnv1a64:{_fnv(data.encode('utf-8', 'surrogatepass')):016x}"


def fnv1a64_all(texts: list[str], alone: int = 16) -> list[str]:
    """``fnv1a64`` of many texts, a byte of all of them at a time, the longest first; what is left when no more than
    ``alone`` go on is hashed by itself."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    data, starts = np.frombuffer(b"".join(raw), np.uint8), (np.cumsum(size) - size)[order]
    ascending, h = np.sort(size), np.full(len(raw), FNV_START, np.uint64)
    k = 0
    while (n := len(raw) - int(np.searchsorted(ascending, k, "right"))) > alone:
        h[:n] = (h[:n] ^ data[starts[:n] + k]) * np.uint64(FNV_PRIME)
        k += 1
    for i in range(n):
        h[i] = _fnv(raw[order[i]][k:], int(h[i]))
    out = np.empty_like(h)
    out[order] = h
    return [f"fnv1a64:{x:016x}" for x in out.tolist()]


def _number(token: str) -> str:
    """A JSON number in one form: plain digits without needless zeros, or with an exponent where those would be many."""
    with localcontext() as ctx:
        ctx.prec, ctx.Emax, ctx.Emin = len(token) + 2, 999_999_999, -999_999_999
        value = Decimal(token).normalize()
        if not value:
            return "0"
        return format(value, "f") if -40 <= value.adjusted() <= 40 else str(value)


class _Plain(str):
    """The text of a number, as it is to be written."""


def _shown(x) -> str:
    if isinstance(x, _Plain):
        return x
    if isinstance(x, dict):
        return "{" + ",".join(f"{_quoted(k)}:{_shown(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_shown, x)) + "]"
    return _quoted(x)


_quoted = json.JSONEncoder(ensure_ascii=False).encode


def canonical(s: str) -> str | None:
    """JSON in one form: keys in the order of their characters at every depth, numbers in one form, no white space, no
    needless escapes; of a repeated key the last value counts. Null where the text is no JSON."""
    read = lambda token: _Plain(_number(token))
    try:
        return _shown(json.loads(s, parse_int=read, parse_float=read, parse_constant=_no_constant))
    except (ValueError, RecursionError):
        return None


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_JSON = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_no_constant)
_FENCE = re.compile(rf"^```(?:json)?{WS}*|{WS}*```$", re.IGNORECASE)


def first_json(s: str) -> str | None:
    """The JSON of a response: the whole text without its fence if that is JSON, else the first object or array in it that
    is. An opening bracket whose value does not parse is passed over, and the next one tried."""
    s = _FENCE.sub("", s.strip(WHITE)).strip(WHITE)
    openings = (m.start() for m in re.finditer(r"[{\[]", s))
    for start in (0, *openings) if s else ():
        try:
            _, end = _JSON.raw_decode(s, start)
        except (ValueError, RecursionError):
            continue
        if s[start] in "{[" or end == len(s):  # any other value counts only as the whole
            return s[start:end]
    return None


# -- Arrow functions ---------------------------------------------------------------------------------------------


def _each(function, kind: DataType):
    @pandas_udf(kind)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else function(x))

    return apply


nfkc = _each(lambda s: unicodedata.normalize("NFKC", s), StringType())
TOKEN = StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("token", StringType())


@pandas_udf(StructType().add("tokens", ArrayType(TOKEN)).add("skeleton", StringType()))
def claims(s: pd.Series) -> pd.DataFrame:
    """Of each text, in NFKC, its protected tokens and its skeleton; of a null both are null."""
    tokens, skeletons = [], []
    for x in s:
        spans = None if x is None else protected_spans(x)
        tokens.append(None if x is None else [dict(zip(("kind", "start", "end", "token"), t, strict=True)) for t in spans])
        skeletons.append(None if x is None else claim_skeleton(x, spans))
    return pd.DataFrame({"tokens": tokens, "skeleton": skeletons})


def _nothing_protected(x: str) -> bool:
    return not (_DIGIT if x.isascii() else _MARKED).search(x)


def _kept(statement: str | None, claim_type: str | None, quotes: list[str | None] | None, more: list[str | None] | None) -> tuple:
    own = [] if quotes is None else [q for q in quotes if q is not None]
    evidence = None if quotes is None else "\n".join([*own, *(() if more is None else (x for x in more if x is not None))])
    protected = {"official_explanation": None if quotes is None else "\n".join(own), "human_judgment": ""}.get(claim_type, statement)
    texts = {x: x if x.isascii() else unicodedata.normalize("NFKC", x) for x in {statement, protected, evidence} if x is not None}
    if None not in (statement, protected, evidence) and all(map(_nothing_protected, texts.values())):
        return True, True, True
    texts |= {x: unicodedata.normalize("NFKC", x) for x in own}
    spans = {x: protected_spans(shown) for x, shown in texts.items()}
    skeletons = [claim_skeleton(texts[x], spans[x]) for x in own]
    tokens = lambda x, kind: [t[3] for t in spans.get(x, ()) if t[0] == kind]
    quoted = lambda x: any(claim_skeleton(texts[x], spans[x]) in y for y in skeletons)
    dates = numbers = modal = None
    if protected is not None:
        told, held = ([list(dict.fromkeys(tokens(x, "date"))) for x in (protected, evidence)])
        said, backed = tokens(protected, "number"), tokens(evidence, "number")
        claims = bool(told or said)
        associated = not claims or quoted(protected)
        dates, numbers = associated and stands_in(told, held), associated and stands_in(said, backed)
        if None not in (statement, evidence):
            terms = tokens(statement, "modal")
            modal = (not terms and not claims or quoted(statement)) and terms == tokens(evidence, "modal")
            modal = modal and clauses_of_single_modals(texts[statement]) == clauses_of_single_modals(texts[evidence])
    return modal, dates, numbers


@pandas_udf(StructType().add("modal_kept", BooleanType()).add("dates_kept", BooleanType()).add("numbers_kept", BooleanType()))
def claims_kept(statement: pd.Series, claim_type: pd.Series, quotes: pd.Series, more: pd.Series) -> pd.DataFrame:
    """Whether a statement keeps the obligation words of its evidence, its quotes and then ``more``, and what its claim type
    protects (the statement, the quotes of an explanation, nothing of a judgment) the dates and numbers, with each claim
    standing in a quote in the same words. Equal texts of a row are scanned once."""
    found = [_kept(*row) for row in zip(statement, claim_type, quotes, more, strict=True)]
    return pd.DataFrame(found, columns=["modal_kept", "dates_kept", "numbers_kept"]).astype("boolean")


def _of_kind(tokens: Column, kind: str) -> Column:
    return F.transform(F.filter(tokens, lambda t: t["kind"] == kind), lambda t: t["token"])


def dates_in(tokens: Column) -> Column:
    """Dates among the tokens of ``claims``, each once."""
    return F.array_distinct(_of_kind(tokens, "date"))


def numbers_in(tokens: Column) -> Column:
    return _of_kind(tokens, "number")


def modals_of(tokens: Column) -> Column:
    return _of_kind(tokens, "modal")


def date_tokens(c) -> Column:
    return dates_in(claims(c)["tokens"])


def number_tokens(c) -> Column:
    return numbers_in(claims(c)["tokens"])


def skeleton(c) -> Column:
    return claims(c)["skeleton"]


@udtf(returnType=TOKEN)
class ProtectedTokens:
    """``protected_tokens(text)`` in SQL, for lateral use: a row per token of ``protected_spans``; of a null, none."""

    def eval(self, text: str):
        if text is not None:
            yield from protected_spans(text)


def register_protected_tokens(spark: SparkSession) -> None:
    spark.udtf.register("protected_tokens", ProtectedTokens)


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text, a row per protected token of it in NFKC: kind, start, end and token."""
    return df.select(*(c for c in df.columns if c != text), F.inline(claims(nfkc(text))["tokens"]))


canonical_json = _each(canonical, StringType())


@pandas_udf(StringType())
def digest(s: pd.Series) -> pd.Series:
    there = s.notna()
    out = pd.Series([None] * len(s), dtype=object)
    out[there.to_numpy()] = fnv1a64_all(s[there].tolist())
    return out


def json_digest(c: Column | str) -> Column:
    """SHA-256 of JSON in its one form: equal for values that differ in the order of keys, in white space or in how numbers
    are written; null where the text is no JSON."""
    return F.sha2(canonical_json(c), 256)
json_of = _each(first_json, StringType())


@pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def norm_range(text: pd.Series, query: pd.Series) -> pd.DataFrame:
    found = [None if None in (t, q) else normalized_range(t, q) for t, q in zip(text, query, strict=True)]
    return pd.DataFrame([(None, None) if f is None else f for f in found], columns=["start", "end"]).astype("Int32")


#: NFKC, then ``squeeze``.
normalize = _each(normal_text, StringType())


@pandas_udf(ArrayType(BooleanType()))
def texts_within(content: pd.Series, texts: pd.Series) -> pd.Series:
    """Of each of the ``texts`` of a row whether its ``content`` holds it, once both are normalized; null where one is null."""
    found = []
    for c, held in zip(content, texts, strict=True):
        c = None if c is None else normal_text(c)
        found.append(None if held is None else [None if c is None or t is None else normal_text(t) in c for t in held])
    return pd.Series(found, dtype=object)
