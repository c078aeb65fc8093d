"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their score.

Base kinds are email, ip, card and phone, leftmost and not overlapping within a kind; a match that fails its test
is dropped and not tried again. The method adds IBANs (mod 97), US social security numbers, and secrets: keys and
tokens of known forms, private keys, and values that are named as a password, key or token. Every pattern is scanned
in time linear in the text, on runs of characters that can't overlap, so a very long run of digits or letters costs
no more than prose.

A span has a score: its kind's prior, plus ``NEAR`` if one of the kind's context words is among the ``CONTEXT``
characters on either side of it, less ``NEAR`` if a word that speaks against it is. Added kinds must score at least
``LEAST``; base spans stay whatever they score.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows are
repeated; a null id stays; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = 4
CONTEXT = 48
NEAR = 0.2
#: Score that a span of an added kind must reach.
LEAST = 0.5
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.8}
FOR = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social security", "soc sec"),
    "secret": ("key", "token", "secret", "password", "passwd", "credential", "credentials", "auth", "api"),
}
AGAINST = {
    "email": ("example",),
    "ip": ("version", "release", "section"),
    "card": ("order", "isbn", "tracking", "serial"),
    "phone": ("order", "serial"),
    "iban": (),
    "ssn": ("order", "part"),
    "secret": ("example", "placeholder"),
}
#: Length of an IBAN by country, from the public registry; fixed values.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CHAIN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}") for n in set(IBAN_LENGTH.values())}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Forms of secrets that can be told by how they begin; fixed values. Lengths are those that their makers give.
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}|glpat-[A-Za-z0-9_-]{20,255}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,255}|(?:sk|rk|pk)[-_](?:live|test|proj|ant)[-_][A-Za-z0-9_-]{16,255}|sk-[A-Za-z0-9]{20,255}|AIza[A-Za-z0-9_-]{35}|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"
    r"|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,255}|ya29\.[A-Za-z0-9_-]{20,255}|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
)
#: What a text with such a secret, or with a name for one, must hold.
_BEGINS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "sk_", "rk-", "rk_", "pk-", "pk_", "AIza", "SG.", "npm_", "hf_", "ya29.", "eyJ")
_NAMES = ("passw", "pwd", "secret", "key", "token")
_PRIVATE = re.compile(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY(?: BLOCK)?-----")
#: A name for a secret, then = or :, then a value of at least eight characters.
_NAMED = re.compile(r"(?i)(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|access[_-]?token|secret[_-]?key|private[_-]?key|token)[\"']?[ \t]{0,4}(?:=|:)[ \t]{0,4}[\"']?([A-Za-z0-9+/_.!@#$%^&*~-]{8,}+)=*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def small(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def ips(text: str, runs: list[re.Match]) -> Iterator[tuple[int, int]]:
    """Four numbers joined by single dots; from a longer chain the first four, then the next."""
    for run in runs:
        chain: list[re.Match] = []
        for part in _CHAIN.finditer(text, run.start(), run.end()):
            if chain and part.start() != chain[-1].end() + 1:
                chain = []
            chain.append(part)
            if len(chain) == 4:
                if all(small(p[0]) for p in chain):
                    yield chain[0].start(), chain[3].end()
                chain = []


def cards(text: str, first: int) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text, first):
        if found.end() - found.start() >= 12:
            digits = found[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        end = at + 1
        if found:
            run = found[0].rstrip(" ().-")
            if len(run) >= 4:  # a plus, a digit, at least one character between, a digit
                end = at + len(run)
                if 9 <= sum(map(str.isdigit, run)) <= 15:
                    yield at, end
        at = text.find("+", end)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """By the country's own length from each start; on behind an accepted code, else a character further."""
    found = _IBAN.search(text)
    while found:
        start, at, want = found.start(), found.start() + 1, IBAN_LENGTH.get(found[1])
        rest = _IBAN_REST[want].match(text, found.end()) if want else None
        if rest and not text[rest.end() : rest.end() + 1].isalnum() and mod97(text[start : rest.end()].replace(" ", "")):
            at = rest.end()
            yield start, at
        found = _IBAN.search(text, at)


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Keys and tokens by their form; values by the name before them, unless they look like a word."""
    found = [x.span() for x in _SECRET.finditer(text)] if any(x in text for x in _BEGINS) else []
    at = text.find("-----BEGIN ")
    while at >= 0:
        begin = _PRIVATE.match(text, at)
        end = at + 1
        if begin:
            last = text.find("-----END ", begin.end())
            close = text.find("-----", last + 9) if last >= 0 else -1
            end = close + 5 if close >= 0 else begin.end()
            found.append((at, end))
        at = text.find("-----BEGIN ", end)
    low = text.lower() if "=" in text or ":" in text else ""
    for x in _NAMED.finditer(text) if any(x in low for x in _NAMES) else ():
        if not x[1].isalpha() and not x[1].replace(".", "").isdigit():
            found.append((x.start(1), x.end()))
    done = -1
    for a, b in sorted(found):
        if a >= done:
            yield a, b
            done = b


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    found = {x for side in around for x in re.findall(r"[^\W_]+", side)}
    hit = lambda words: any(any(w in side for side in around) if " " in w else w in found for w in words)
    return round(min(1.0, max(0.0, PRIOR[kind] + NEAR * hit(FOR[kind]) - NEAR * hit(AGAINST[kind]))), 4)


def find(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind as listed."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    if "+" in text:
        found += [("phone", *x) for x in phones(text)]
    runs = list(_DOTTED.finditer(text))
    if runs:
        found += [("ip", *x) for x in ips(text, [r for r in runs if "." in r[0]])]
        found += [("card", *x) for x in cards(text, runs[0].start())]
        found += [("iban", *x) for x in ibans(text)]
        found += [("ssn", *x.span()) for x in _SSN.finditer(text)]
    found += [("secret", *x) for x in secrets(text)]
    spans = [Span(kind, a, b, _score(kind, text, a, b)) for kind, a, b in found]
    spans = [x for x in spans if x.kind in KINDS[:BASE] or x.score >= LEAST]
    return sorted(spans, key=lambda x: (x.start, KINDS.index(x.kind), x.end))


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, spans (kind, start, end, score)."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[x._asdict() for x in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def report(spans: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans as text, and their scores in the same order."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:BASE]],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"), *[count(k).alias(f"n_{k}") for k in KINDS[BASE:]],
        F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("max_score"),
    )
