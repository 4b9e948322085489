"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Four base kinds (email, ip, card, phone) are proposed leftmost and without overlap within a kind, and kept if they pass
their check: address parts of at most 255, Luhn's sum, a number of digits. Two kinds are added: account numbers (IBAN,
confirmed by their remainder modulo 97) and secrets (keys in the forms of issuers, private keys, signed tokens, values
that are assigned to a name such as "password", and long hexadecimal strings). A span's score starts at the prior of its
form, rises with each context word of its kind within ``CONTEXT`` characters before it, and falls with each word that
speaks against it, such as "example" or "checksum"; spans of added kinds need ``min_score``. So a hexadecimal string needs
a word such as "token" near it, and a proper account number in an example is none. Base kinds are never dropped for their
score.

Spans are in code points, with the end exclusive. The texts are read once, row by row, without a shuffle, in time that
the length of a text bounds. A text without a digit is searched for addresses and assigned secrets only.

Defined results: a null or empty text has no spans; a very long text is held whole by its task; each repeated row gets its
own result; spans of different kinds may overlap, and of overlapping secrets the first stays, of those with equal starts
the longest; other columns, whatever their names, stay in ``find_spans`` but for one named like its result, and are not
read by ``digests``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret")
CONTEXT = 40

#: Patterns, in which nothing that matches is longer for starting later.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IBAN_END = re.compile(r"(?![A-Za-z0-9])")
#: Letters and digits of an account number by country.
IBAN_SIZES = dict(
    (x[:2], int(x[2:]))
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
        "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
        "LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 "
        "SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
)
#: Forms of secrets, each with its prior score.
SECRETS = (
    (re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:(?!-----END)[^-]|-(?!----END))*+(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"), 1.0),
    (re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), 0.9),
    (re.compile(r"(?<![A-Za-z0-9])gh[opsu]_[A-Za-z0-9]{36,}+"), 0.9),
    (re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+"), 0.9),
    (re.compile(r"(?<![A-Za-z0-9_-])[ps]k[-_](?:live[-_]|test[-_])?[A-Za-z0-9]{20,}+"), 0.9),
    (re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), 0.9),
    (re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])"), 0.3),
)
ASSIGNED = re.compile(r"(?:password|passwd|secret|token|api[_-]?key)[\"']?\s*+[:=]\s*+[\"']?([^\s\"',;]{6,}+)", re.I)
ASSIGNED_PRIOR = 0.2
DIGIT = re.compile("[0-9]")

#: Prior scores, and the words that raise them by 0.3 each, or lower those of added kinds by 0.5 each.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
WORDS = {
    "email": ("mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "secret": ("token", "key", "secret", "password", "passwd"),
}
AGAINST = {"iban": ("example", "sample", "dummy"), "secret": ("example", "sample", "dummy", "checksum", "digest", "commit", "etag")}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``local@domain``, found from each ``@`` outwards: one match holds one ``@``, so this is leftmost."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass their check. What follows in capitals or digits may look like more of the number, so it
    ends where it has as many letters and digits as its country's numbers have, which must be the end of a word."""
    m = IBAN.search(text)
    while m:
        start, at, left = m.start(), m.start() + 2, IBAN_SIZES.get(text[m.start() : m.start() + 2], 0)
        end = start
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        if end > start and not left and IBAN_END.match(text, end) and mod97(text[start:end].replace(" ", "")):
            yield start, end
            at = end
        m = IBAN.search(text, at)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def secrets(text: str, has_digit: bool) -> Iterator[tuple[int, int, float]]:
    """(start, end, prior) of all forms of secrets, those that overlap an earlier one left out."""
    found = []
    if has_digit:
        found += [(*m.span(), prior) for form, prior in SECRETS for m in form.finditer(text)]
    if ":" in text or "=" in text:
        found += [(*m.span(1), ASSIGNED_PRIOR) for m in ASSIGNED.finditer(text) if not m[1].isalpha()]
    last = -1
    for a, b, prior in sorted(found, key=lambda x: (x[0], -x[1], -x[2])):
        if a >= last:
            yield a, b, prior
            last = b


def spans_of(text: str, min_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in BASE and ADDED, then by start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    has_digit = DIGIT.search(text) is not None
    if has_digit:
        if "." in text:
            found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))]
        found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        found += [("iban", a, b) for a, b in ibans(text)]
    scored = [(kind, a, b, PRIOR[kind]) for kind, a, b in found] + [("secret", *x) for x in secrets(text, has_digit)]
    out = []
    for kind, a, b, prior in scored:
        near = text[max(0, a - CONTEXT) : a].lower()
        score = prior + 0.3 * sum(w in near for w in WORDS[kind]) - 0.5 * sum(w in near for w in AGAINST.get(kind, ()))
        if kind in BASE or score >= min_score - 1e-9:
            out.append((kind, a, b, min(1.0, max(0.0, score))))
    return out


def find_spans(docs: DataFrame, text: str = "text", spans: str = "_spans", min_score: float = 0.5) -> DataFrame:
    """``docs`` with the array ``spans`` of (kind, start, end, score)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    names = [c for c in docs.columns if c != spans]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != spans)

    def rows(batches):
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans_of(t.as_py() or "", min_score)]
                for t in batch.column(text)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, kind)], [*names, spans])

    return docs.mapInArrow(rows, f"{schema}, `{spans}` array<struct<kind:string,start:int,end:int,score:double>>")


def mask(docs: DataFrame, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of overlapping spans the first names the kind, and
    all their characters go. Nulls stay null."""
    schema = docs.schema

    def masked(t: str | None) -> str | None:
        if not t or not (found := spans_of(t, min_score)):
            return t
        out, last = [], 0
        for kind, a, b, _ in sorted(found, key=lambda x: (x[1], -x[2])):
            if a >= last:
                out += [t[last:a], f"<{kind.upper()}>"]
            last = max(last, b)
        return "".join([*out, t[last:]])

    def rows(batches):
        for batch in batches:
            new = pa.array([masked(t.as_py()) for t in batch.column(text)], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == text else batch.column(n) for n in schema.names], schema.names)

    return docs.mapInArrow(rows, schema)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of each row of ``docs`` (doc_id, text); the
    scores stand in the order of the spans, with two decimals."""
    df = find_spans(docs.select("doc_id", "text"))
    of = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("_spans", lambda x: x["kind"].isin(*BASE))
    return df.select(
        "doc_id",
        *(F.size(F.filter(F.col("_spans.kind"), F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, of), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("_spans", of), ",").alias("spans"),
        F.array_join(F.transform("_spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"),
    )
