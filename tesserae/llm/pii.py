"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

The four plain kinds (email, ip, card, phone) are found by the rules of the base; they always stay.
The method adds kinds that need evidence beyond a pattern: IBANs (mod-97), national phone numbers
and national identity numbers (only with a word for them close by), IPv6 addresses (parsed), and
secrets (random-looking keys with a word for them close by, or in a form that marks them).
A span's score starts from its kind's prior, rises with a checksum and with context words within
`window` characters, and spans below `threshold` that are not base spans are left out.

Nulls and empty texts have no spans. Texts are scanned whole; spans that are taken are looked up by
bisection. Positions are code points, ends exclusive. Repeated rows give equal rows.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "local_phone", "ipv6", "secret")
#: Prior of each kind, before checksum and context.
PRIOR = {"email": 0.7, "ip": 0.4, "card": 0.4, "phone": 0.5, "iban": 0.4, "national_id": 0.3, "local_phone": 0.3, "ipv6": 0.4, "secret": 0.3}
#: Base kinds whose matches a checksum has confirmed.
CONFIRMED = frozenset(["card"])
CHECKED, NEAR = 0.4, 0.3
#: Words that speak for a kind when they stand close to a span (fixed values, four languages).
CONTEXT = {
    "email": ("mail", "write", "contact", "correo", "courriel", "schreib"),
    "ip": ("ip", "host", "address", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "téléphone", "teléfono", "handy", "móvil", "fax"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "national_id": ("ssn", "social security", "passport", "sozialversicherung", "ausweis", "sécurité sociale", "dni", "pasaporte"),
    "local_phone": ("phone", "call", "tel", "mobile", "telefon", "téléphone", "teléfono", "handy", "móvil", "fax"),
    "ipv6": ("ip", "host", "address", "server"),
    "secret": ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "access key", "credential", "bearer", "kennwort", "mot de passe", "contraseña"),
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No digit before, possessive first run: the same matches, without trying each digit of a long run.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country (fixed values of the registry).
IBAN_LENGTH = {c: n for n, names in {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT"}.items() for c in names.split()}
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])")
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+")
#: Beginnings of keys whose makers mark them so (fixed values).
MARKED = re.compile(r"AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}$|glpat-[A-Za-z0-9_-]{20}$|sk_live_[A-Za-z0-9]{20,}$")


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.6
    window: int = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def random_looking(key: str) -> bool:
    """Letters and digits, at three bits a character or more."""
    if len(key) > 512 or not any(map(str.isdigit, key)) or not any(map(str.isalpha, key)):
        return False
    return -sum(n / len(key) * math.log2(n / len(key)) for n in Counter(key).values()) >= 3


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans with a right checksum. A match may run on into upper-case words or numbers: of its beginnings that end with a
    word, the one of the country's length comes first, then the match as it is, and without a known length each, longest first."""
    out, at = [], 0
    while m := IBAN.search(text, at):
        start, whole = m.span()
        ends = [whole, *[i for i in range(whole - 1, start, -1) if text[i] == " "]]
        length = {e: e - start - text.count(" ", start, e) for e in ends}
        wanted = IBAN_LENGTH.get(text[start : start + 2])
        tries = ends if wanted is None else [*[e for e in ends if length[e] == wanted], whole]
        end = next((e for e in tries if 15 <= length[e] <= 34 and mod97(text[start:e].replace(" ", ""))), None)
        if end is not None:
            out.append((start, end))
        at = start + 1 if end is None else end
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the base pattern, found from each @ outwards, so that text without one costs nothing."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", m.end())
        else:
            free = max(free, at + 1)
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the four base kinds."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def near(text: str, start: int, end: int, kind: str, window: int) -> bool:
    around = text[max(0, start - window) : start].lower() + " " + text[end : end + window].lower()
    return any(re.search(rf"(?<!\w){re.escape(w)}", around) for w in CONTEXT[kind])


class Taken:
    """Places that spans take up, as intervals apart from each other and in order."""

    def __init__(self, spans) -> None:
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        """Take a place that meets no other."""
        i = bisect.bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def score(text: str, start: int, end: int, kind: str, checked: bool, settings: Settings) -> float:
    return PRIOR[kind] + CHECKED * checked + NEAR * near(text, start, end, kind, settings.window)


def added_spans(text: str, base: list[tuple[int, int, int]], settings: Settings) -> list[tuple[int, int, int, float]]:
    """(start, kind's number, end, score) of further spans, none of which overlaps a base span or an earlier one."""
    # an IBAN may hold a card-like run of digits: it is reported beside the base span
    accounts = ibans(text)
    out = [(s, KINDS.index("iban"), e, score(text, s, e, "iban", True, settings)) for s, e in accounts]
    taken = Taken([*[(s, e) for s, _, e in base], *accounts])

    def offer(m: re.Match, kind: str, checked: bool) -> None:
        start, end = m.span()
        if not taken.meets(start, end) and (value := score(text, start, end, kind, checked, settings)) >= settings.threshold:
            taken.add(start, end)
            out.append((start, KINDS.index(kind), end, value))

    for m in NATIONAL.finditer(text):
        a, b, c = m.group().split("-")
        if a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            offer(m, "national_id", False)
    for m in LOCAL_PHONE.finditer(text):
        offer(m, "local_phone", False)
    for m in SECRET.finditer(text):
        if random_looking(m.group()):
            offer(m, "secret", bool(MARKED.match(m.group())))
    if ":" in text:
        for m in IPV6.finditer(text):
            try:
                ipaddress.IPv6Address(m.group())
            except ValueError:
                continue
            offer(m, "ipv6", m.group().count(":") == 7 or "::" in m.group())
    return out


HAS_DIGIT = re.compile(r"[0-9]")


def spans(text: str, settings: Settings) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """Base spans, and the added ones with scores."""
    if not text or ("@" not in text and ":" not in text and not HAS_DIGIT.search(text)):
        return [], []
    base = base_spans(text)
    return base, added_spans(text, base, settings)


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in sorted(found))


def redact(text: str | None, settings: Settings) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    base, more = spans(text, settings)
    if not base and not more:
        return text
    out, at = [], 0
    for s, k, e in sorted([*base, *[x[:3] for x in more]]):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in BASE] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")] + [T.StructField("n_spans", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def find(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, counts of base kinds, digest of base spans, all spans, their number, and their scores in the same order."""
    settings = settings or Settings()
    schema = T.StructType([docs.schema["doc_id"], *SCHEMA.fields])

    def run(batches):
        for batch in small_batches(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base, more = spans(text or "", settings)
                counts = [sum(k == i for _, k, _ in base) for i in range(len(BASE))]
                rated = sorted([*[(s, k, e, score(text, s, e, KINDS[k], KINDS[k] in CONFIRMED, settings)) for s, k, e in base], *more])
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(rated), len(rated), [x[3] for x in rated]))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.float64())], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs, all columns, with personal data in `text` replaced; n_chars, where there is one, follows."""
    settings = settings or Settings()
    names = docs.columns

    def run(batches):
        for batch in small_batches(batches, "text"):
            texts = [redact(t, settings) for t in batch.column("text").to_pylist()]
            arrays = {n: batch.column(n) for n in names}
            arrays["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in arrays:
                counts = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                arrays["n_chars"] = counts.cast(arrays["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
