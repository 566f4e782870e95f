"""Personal data by anchor expansion.

One Aho-Corasick pass finds what every kind of personal data must hold: an
at-sign, a plus, a digit, a dot between digits, a scheme, or a word announcing
an identifier.  A small parser for the anchor's kind then grows the span to
both sides, within bounds its neighbours set, and validates it.  Each parser
resumes behind its last span, so every character is read a bounded number of
times however long a run is.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnloom.llm.shared import add_from_text

# Kinds in the order of the digests; the later ones are found by cues only.
BASE_KINDS = ("email", "ip", "card", "phone")
CUED_KINDS = ("login", "iban", "account", "ssn")

# Words that announce an identifier, by the kind they announce.
CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "konto": "account",
    "compte": "account",
    "cuenta": "account",
    "ssn": "ssn",
    "social security": "ssn",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s:/@?#]+(?::[^\s/@?#]*)?@[A-Za-z0-9.-]*[A-Za-z0-9]")
_GAP = re.compile(r"(?:[ ]?(?:no|nr|num|number|numero))?[ .:#]{0,3}", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[0-9](?:-?[0-9]){5,16}(?![0-9-])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

Span = tuple[str, int, int]


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) << (i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return len(plain) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int | None:
    """End of the longest run of whole words from ``start`` whose check digits hold."""
    for stop in range(end, start + 14, -1):
        whole = text[stop - 1] != " " and not text[stop : stop + 1].isalnum()
        if whole and _iban(text[start:stop]):
            return stop
    return None


def spans(text: str | None) -> list[Span]:
    """Personal data in a text as (kind, start, end), by kind and start.

    Emails, addresses, cards and phones are the leftmost spans of their
    patterns that do not overlap within the kind; a span that fails validation
    is dropped and not tried again from a later character.  Cued kinds are
    logins behind a scheme, and IBANs (check digits hold), account numbers and
    social security numbers right behind their cue.
    """
    if not text:
        return []
    found: dict[str, list[Span]] = {kind: [] for kind in (*BASE_KINDS, *CUED_KINDS)}
    email_end = chain_end = digits_end = phone_end = login_end = 0
    for last, (kind, length) in _anchors().iter(text):
        at, behind = last + 1 - length, last + 1
        if kind == "digit":
            if at >= chain_end and text[behind : behind + 1] == ".":
                start = at
                while start > chain_end and text[start - 1] in "0123456789":
                    start -= 1
                chain = _CHAIN.match(text, start)
                chain_end = chain.end()
                for quad in _QUAD.finditer(text, start, chain_end):
                    if all(map(_octet, quad.group().split("."))):
                        found["ip"].append(("ip", quad.start(), quad.end()))
            if at >= digits_end:
                run = _DIGITS.match(text, at)
                digits_end = run.end()
                if digits_end - at >= 13:
                    digits = run.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and _luhn(digits):
                        found["card"].append(("card", at, digits_end))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, behind) if start < at else None
            if domain:
                email_end = domain.end()
                found["email"].append(("email", start, email_end))
        elif kind == "plus":
            number = _PHONE.match(text, at) if at >= phone_end else None
            if number:
                phone_end = number.end()
                if 9 <= sum(c.isdigit() for c in number.group()) <= 15:
                    found["phone"].append(("phone", at, phone_end))
        elif kind == "scheme":
            login = _LOGIN.match(text, behind) if at >= login_end and text[at - 1 : at].isalpha() else None
            if login:
                login_end = login.end()
                found["login"].append(("login", behind, login_end))
        elif not (at and text[at - 1].isalnum()):
            start = _GAP.match(text, behind).end()
            number = {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN}[kind].match(text, start)
            end = number and (_iban_end(text, start, number.end()) if kind == "iban" else number.end())
            if end and (not found[kind] or start >= found[kind][-1][2]):
                found[kind].append((kind, start, end))
    return [span for kind in found for span in found[kind]]


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    )
)


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add the spans of personal data in ``text`` as ``out``, an array of (kind, start, end).

    Positions count code points, ``end`` excluded.  Null and empty texts have
    none; rows are independent, so repeated rows repeat and an empty table
    stays empty.  A column already named ``out`` is replaced.
    """

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t)] for t in texts.to_pylist()]
            kinds = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            return [pa.array(rows, pa.list_(kinds))]

        return work

    return add_from_text(df, text, [T.StructField(out, SPANS)], make)


def masked(text: str | None) -> str | None:
    """The text with every span of personal data replaced by its kind in brackets.

    Spans that overlap are replaced together under the kind of the first.
    """
    parts, at = [], 0
    for kind, start, end in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]]) if parts else text


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace personal data in ``text`` by the kinds in brackets; null stays null."""

    def make():
        def work(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([masked(t) for t in texts.to_pylist()], pa.string())]

        return work

    columns = df.columns
    return add_from_text(df, text, [T.StructField(text, T.StringType())], make).select(columns)


def count_of(kind: str, spans_column: str = "pii") -> F.Column:
    return F.size(F.filter(spans_column, lambda s: s["kind"] == kind)).cast("long")


def listed(spans_column: F.Column) -> F.Column:
    """Spans as ``kind:start:end``, joined by commas in their order."""
    return F.concat_ws(",", F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
