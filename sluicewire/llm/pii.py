"""Personal data: regular expressions propose spans, validators confirm, context adjusts the score.

Base kinds (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping within a
kind, and a proposal that fails its validator is dropped whole. The method then looks again where
such a proposal hid something real (a card number glued to a phone number by a space, say), and
adds IBANs (mod-97) and US social security numbers (only next to a telling word). Base spans
always stay, at whatever score. Patterns run in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, holds, named

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
SPANS_TYPE = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A digit run either reaches the next dot or fails from each of its digits, so only its start counts.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_GROUP = re.compile(r"[0-9]+")
#: Where cards of so many digits are parted; one parted elsewhere counts only near a telling word.
CARD_PARTS = ((range(13, 20), {4, 8, 12, 16}), ((14, 15), {4, 10}), ((19,), {6}))
_PHONE_INSIDE = re.compile(r"\+1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9]{4})")
_IBAN_GROUP = re.compile(r"\x20?[A-Z0-9]{4}")
_IBAN_TAIL = re.compile(r"\x20?[A-Z0-9]{1,3}(?![A-Za-z0-9])")
_IBAN_END = re.compile(r"(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Characters of an IBAN by country, from the ISO 13616 registry.
IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Score before context, and the words within CONTEXT characters that raise or lower it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT = 40
RAISES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social", "security"),
}
LOWERS = {
    "ip": ("version", "release", "section"),
    "card": ("order", "serial", "isbn", "tracking"),
    "phone": ("order", "serial"),
}
#: Added (not base) spans need this score.
LEAST_ADDED = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _cards_inside(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of whole digit groups in a failed proposal that are card numbers; they may overlap.

    All runs parted as cards are count. Of others, near a telling word (which is outside of the
    proposal), the longest from each group on does.
    """
    if sum(c.isdigit() for c in text[start:end]) < 13:
        return
    groups = [(start + m.start(), start + m.end()) for m in _DIGIT_GROUP.finditer(text[start:end])]
    told = _near(text, start, end) & set(RAISES["card"])
    for i, (first, _) in enumerate(groups):
        digits, parts, odd = "", set(), None
        for a, last in groups[i : i + 19]:
            if digits:
                parts.add(len(digits))
            digits += text[a : min(last, a + 20)]
            n = len(digits)
            if n > 19:
                break
            usual = any(n in lengths and parts <= at for lengths, at in CARD_PARTS)
            if n >= 13 and (usual or told) and luhn(digits):
                if usual:
                    yield first, last
                else:
                    odd = last
        if odd and _near(text, first, odd) & told:
            yield first, odd


def _phone_inside(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The phone number at the start of a failed proposal: a North American one, or as many whole groups as one has digits for."""
    if m := _PHONE_INSIDE.match(text, start, end):
        return m.span()
    n, best = 0, None
    for m in _DIGIT_GROUP.finditer(text, start, end):
        n += m.end() - m.start()
        if n > 15:
            break
        if n >= 9:
            best = m.end()
    return (start, best) if best else None


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs in groups of four, spaced or not, from the left; a start without one hides none behind it.

    A word after an IBAN may look like one more group or the last, short one, so an IBAN ends where
    its country's length says. The longest proposal is tried for other lengths, and for countries
    without a known length every group's end, the longest first.
    """
    m = _IBAN_START.search(text)
    while m:
        start, at, ends = m.start(), m.end(), []
        for groups in range(1, 8):
            g = _IBAN_GROUP.match(text, at)
            if not g:
                break
            at = g.end()
            if groups >= 2:
                ends += [x.end() for x in (_IBAN_END.match(text, at), _IBAN_TAIL.match(text, at)) if x]
        n = IBAN_LENGTH.get(text[start : start + 2])
        if n:
            ends = [*ends[-1:], *(e for e in ends if len(text[start:e].replace(" ", "")) == n)]
        end = next((e for e in reversed(ends) if iban_ok(text[start:e])), None)
        if end:
            yield start, end
        m = _IBAN_START.search(text, end or m.end())


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match's local part is the whole run of its characters left of ``@``, back to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        if at >= end:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                yield start, m.end()
                end = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Confirmed base spans by kind and start, and the proposals that failed."""
    good = [("email", s, e) for s, e in _emails(text)]
    bad: list[tuple[str, int, int]] = []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            s = m.group()
            if kind == "ip":
                ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
            else:
                n = len(d := _digits(s))
                ok = 13 <= n <= 19 and luhn(d) if kind == "card" else 9 <= n <= 15
            (good if ok else bad).append((kind, *m.span()))
    return good, bad


def _near(text: str, start: int, end: int) -> set[str]:
    return {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start]) + _WORD.findall(text[end : end + CONTEXT])}


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = _near(text, start, end)
    up, down = near & set(RAISES[kind]), near & set(LOWERS.get(kind, ()))
    return round(min(1.0, max(0.0, BASE_SCORE[kind] + 0.3 * bool(up) - 0.3 * bool(down))), 3)


def find_spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans (kind, start, end, score, base) in code points, ordered by kind as in KINDS, then start."""
    good, bad = base_spans(text)
    out = [(k, s, e, _score(text, k, s, e), True) for k, s, e in good]
    more = [("card", *x) for k, s, e in bad if k == "card" for x in _cards_inside(text, s, e)]
    more += [("phone", *x) for k, s, e in bad if k == "phone" and (x := _phone_inside(text, s, e))]
    more += [("iban", *x) for x in _ibans(text)]
    more += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out += [(k, s, e, p, False) for k, s, e in more if (p := _score(text, k, s, e)) >= LEAST_ADDED]
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _spans_of(texts: pa.Array) -> pa.Array:
    names = ("kind", "start", "end", "score", "base")
    return pa.array([[dict(zip(names, x, strict=True)) for x in find_spans(t.as_py() or "")] for t in texts], _SPANS)


def spans(text: Column) -> Column:
    """The spans of a text column, of every row and its whole text, whatever its length; a null or empty text has none.

    Equal texts have equal spans. Base spans of one kind don't overlap; those of other kinds, and added
    ones, may. Spans that start alike are ordered by their end. An empty table gives no rows.
    """
    return F.arrow_udf(_spans_of, SPANS_TYPE)(text)


def redact_text(text: str | None) -> str | None:
    """Each stretch of overlapping spans becomes the tag of its first, like ``<EMAIL>``."""
    found = sorted(find_spans(text or ""), key=lambda x: (x[1], -x[2]))
    if not found:
        return text
    out, at = [], 0
    for kind, start, end, _, _ in found:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redacted(texts: pa.Array) -> pa.Array:
    holds("pii")
    return pa.array([redact_text(t.as_py()) for t in texts], pa.string())


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``df`` with spans in ``text`` replaced by tags; ``length``, if it is a column, follows the new text.

    Null texts stay null (with their old length), empty ones empty; texts of any length are read
    whole. Rows, repeated ones too, and all other columns, whatever their names, stay as they are. An
    empty table gives no rows.
    """
    out = df.withColumn(text, F.arrow_udf(_redacted, "string")(named(text)))
    if length and length in df.columns:
        out = out.withColumn(length, F.coalesce(F.length(named(text)).cast(df.schema[length].dataType), named(length)))
    return out.select(*map(named, df.columns))


_DIGEST = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _digests(texts: pa.Array) -> pa.Array:
    holds("pii")
    rows = []
    for t in texts:
        found = find_spans(t.as_py() or "")
        base = [x for x in found if x[4]]
        name = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in xs)
        rows.append([*(sum(x[0] == k for x in base) for k in BASE_KINDS), hashlib.sha256(name(base).encode()).hexdigest(), name(found)])
    fields = [c.split() for c in _DIGEST.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, (_, kind) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts cover base spans; ``spans`` lists these and the added ones.

    A row for each document, repeated ones too, of its whole text; null counts as the empty text. Of
    spans that start alike the shorter comes first. Other columns are not read. An empty table gives
    no rows.
    """
    return documents(spark, sf_dir).select("doc_id", F.arrow_udf(_digests, _DIGEST)("text").alias("d")).select("doc_id", "d.*")
