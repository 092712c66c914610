"""Personal data in texts: patterns propose spans, checksums and ranges confirm them, nearby words move the score."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: Kinds found beside the base ones, in the order in which they are listed.
MORE = ("iban", "ssn", "key", "password")
KINDS = BASE + MORE

# The base patterns of the task.  Atomic groups and the look-behind only spare steps in long runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40}|[0-9a-f]{64})\b")
_PASSWORD = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token)\s?[=:]\s?(\S{6,})")
_DIGIT = re.compile(r"[0-9]")
#: Words that raise the score of a kind when they stand within NEAR characters before the span.
CONTEXT = {
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "key": ("key", "secret", "token", "aws", "api", "="),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "mobile"),
    "ip": ("ip", "host", "server", "address"),
    "email": ("mail", "contact", "@"),
    "password": ("user", "login"),
}
#: A span is found when its score reaches TAKEN: base kinds and checksums do so by themselves, the others need context.
START = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3, "key": 0.4, "password": 0.6}
RAISE, TAKEN, NEAR = 0.3, 0.5, 40


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of an IBAN: country and check digits moved to the end, letters as 10 to 35, remainder 1."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str):
    """Leftmost non-overlapping addresses, found from their @ so that long runs without one cost a single look."""
    pos, at = 0, text.find("@")
    while at >= 0:
        run = text[pos:at]
        local = len(run) - len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if local else None
        if m:
            yield at - local, m.end()
        pos = m.end() if m else at + 1
        at = text.find("@", pos)


def base_spans(text: str):
    """(kind number, start, end) of the base kinds; matches that fail their check are dropped."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def more_spans(text: str):
    """Proposals of the other kinds that their checks confirm."""
    if _DIGIT.search(text):
        for m in _IBAN.finditer(text):
            if mod97(m.group()):
                yield 4, m.start(), m.end()
        for m in _SSN.finditer(text):
            area, group, serial = m.groups()
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                yield 5, m.start(), m.end()
        for m in _KEY.finditer(text):
            if _DIGIT.search(m.group()) and not m.group().isdigit():
                yield 6, m.start(), m.end()
    if "=" in text or ":" in text:
        for m in _PASSWORD.finditer(text):
            yield 7, m.start(1), m.end(1)


def score(text: str, kind: int, start: int) -> float:
    name = KINDS[kind]
    near = text[max(0, start - NEAR):start].lower()
    return round(START[name] + RAISE * any(w in near for w in CONTEXT[name]), 2)


def spans_of(text: str):
    """All spans of a text as (start, kind number, end, score) by start, then kind."""
    found = base_spans(text) + list(more_spans(text))
    scored = sorted((a, k, b, score(text, k, a)) for k, a, b in found)
    return [x for x in scored if x[1] < len(BASE) or x[3] >= TAKEN]


def mask(text: str, spans) -> str:
    """The text with each span, overlapping ones together, replaced by the kind of the first: ``<EMAIL>``."""
    out, pos, end = [], 0, -1
    for a, k, b, _ in spans:
        if a >= end:
            if end >= 0:
                pos = end
            out += [text[pos:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join(out) + text[max(pos, end):] if out else text


_FOUND = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_pii(docs: DataFrame, masked: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``pii``: array of kind, start, end (code points, end exclusive),
    score; with ``masked``, ``text`` has the spans replaced.  Null text: no spans, and it stays null.  Rows are worked
    on where they are read: no shuffle; empty tables give none, repeated rows are treated alike, and other columns
    (but one named ``pii``, which is replaced) pass through."""
    rest = docs.drop("pii")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"pii {_FOUND}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = rest.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [spans_of(t) if t else [] for t in texts]
            cols = list(batch.columns)
            if masked:
                cols[at] = pa.array([mask(t, s) if s else t for t, s in zip(texts, found)], pa.string())
            cols.append(pa.array([[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in x] for x in found], kind))
            yield pa.RecordBatch.from_arrays(cols, [*names, "pii"])

    return rest.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, sha-256 of the base spans and all spans as text."""
    def said(col):
        one = F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))
