"""Personal data and secrets: patterns propose, checksums validate, context adjusts a score.

Each text is scanned once in Arrow batches, no shuffle. Regular expressions
propose spans; IP parts, Luhn (cards), mod-97 and the country's length (IBAN), digit
counts and the spread of characters (secrets) confirm them; whole words near a span raise its
score. Base kinds (email, ip, card, phone) stay whatever their score, which the result
gives; the added kinds need ``min_score``: an IBAN reaches it by its country's length or a context
word, a national id number or a secret only by a context word, a key of a known form by itself.

Defined results: null and empty texts have no spans; offsets count code points;
repeated rows are scanned alike; overlapping spans of different kinds are all given
(``redact`` merges them); an empty table gives an empty result; other
columns are not read. All patterns run in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.functions.ship import ship
from sentinela.llm.common import documents

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "secret")
BASE_KINDS = KINDS[:4]
MIN_SCORE = 0.7
WINDOW = 48

#: The base patterns, spelled so that a failed start isn't tried
#: again inside the same run of characters.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")

_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
_KNOWN_KEY = re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[A-Za-z0-9]{16,})\Z")
#: IBAN lengths by country (public registry).
IBAN_LENGTH = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}

#: Words near a span that speak for each kind; they count as whole words only.
CONTEXT = {
    "email": ("e-mail", "email", "mail", "contact", "correo", "courriel", "write to"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "telefon", "call", "mobile", "fax", "cell"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social security", "national id", "taxpayer"),
    "secret": ("token", "secret", "key", "apikey", "api_key", "api-key", "access_token", "password", "passwd", "pwd", "bearer", "clave", "passwort"),
}
_WORDS = {kind: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)") for kind, words in CONTEXT.items()}
_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.6, "national_id": 0.4, "secret": 0.4}
_BONUS = 0.3


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    bare = iban.replace(" ", "")
    if not 15 <= len(bare) <= 34:
        return False
    return int("".join(str(int(ch, 36)) for ch in bare[4:] + bare[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        hit = _DOMAIN.match(text, at) if start < at else None
        if hit:
            free = hit.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def spread(value: str) -> bool:
    """Whether a run of characters looks drawn at random: digits among letters, and many different ones."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 10


def find_spans(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start."""
    if not text:
        return []
    out: list[tuple[str, int, int, float]] = []  # the last is what a validator adds to the score
    if "@" in text:
        out += [("email", a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end(), 0) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end(), 0))
        if "+" in text:
            out += [("phone", m.start(), m.end(), 0) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
        for m in _IBAN.finditer(text):
            if mod97(m.group()):
                bare = m.group().replace(" ", "")
                out.append(("iban", m.start(), m.end(), 0.2 * (IBAN_LENGTH.get(bare[:2]) == len(bare))))
        if "-" in text:
            out += [("national_id", m.start(), m.end(), 0) for m in _NATIONAL.finditer(text)]
        for m in _SECRET.finditer(text):
            if spread(m.group()):
                out.append(("secret", m.start(), m.end(), 0.5 * bool(_KNOWN_KEY.match(m.group()))))
    scored = []
    for kind, a, b, more in out:
        # A quote or sign between word and value is no letter, so a word may touch the span's end.
        near = text[max(0, a - WINDOW) : a].lower() + "\n" + text[b : b + WINDOW].lower()
        score = round(min(1.0, _PRIOR[kind] + more + _BONUS * bool(_WORDS[kind].search(near))), 2)
        if kind in BASE_KINDS or score >= min_score:
            scored.append((kind, a, b, score))
    return scored


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, spans array<struct<kind,start,end,score>>."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t.as_py())]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], names=[id_col, "spans"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts with every span replaced by its kind in angle brackets; overlaps merge."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def mask(text: str | None) -> str | None:
        if not text:
            return text
        out, pos = [], 0
        for k, a, b, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
            if a >= pos:
                out += [text[pos:a], f"<{k}>"]
            pos = max(pos, b)
        return "".join([*out, text[pos:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = pa.array([mask(t.as_py()) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), masked], names=[id_col, text_col])

    return src.mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir))
    join = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(join(base).cast("binary"), 256).alias("base_sha256"),
        join("spans").alias("spans"),
        *map(count, KINDS[len(BASE_KINDS) :]),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def brute(text: str | None) -> list[tuple[str, int, int]]:
    """The base contract, literally; for tests."""
    t, out = text or "", []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(_digits(s)) <= 19 and luhn(_digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(_digits(s)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if ok(m.group())]
    return out


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans).encode()).hexdigest()
