"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, cues of identifiers, and the short digit patterns that every
address or number must hold. From an anchor a deterministic parser finds the span's bounds and checks it. A parser reads a
bounded number of characters, or up to a character that the next anchor of its kind is behind, or uses up what it has read
though it holds no span; so a text costs time in proportion to its length.

Base kinds, leftmost and not overlapping within a kind: email, ip, card, phone (see the parsers). Added kinds:
  account  the value after an identifier cue such as ``iban:`` or ``account no.``: 6 to 34 letters and digits, two of
           them digits at least; after ``iban`` the check digits must hold
  secret   the value after ``password``, ``token``, ``api_key`` or ``secret`` and ``=`` or ``:``; 8 characters and a digit at least
  login    user and password before the host of an address with a scheme, ``scheme://user:password@host``
A null text counts as empty and has no span. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from acreframe.llm._shared import mapped, slices

KINDS = ("email", "ip", "card", "phone", "account", "secret", "login")
_DIGITS = frozenset("0123456789")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_LOCAL = _LABEL | frozenset("._%+")
_PHONE = _DIGITS | frozenset(" ().-")
# Cues of identifiers and of secrets, in lower case (fixed values).
ACCOUNT_CUES = ("iban", "account number", "account no", "passport no", "passport number", "customer id", "social security number", "ssn")
SECRET_CUES = ("password", "passwd", "token", "api_key", "apikey", "secret")
_value_account = re.compile(r"[\x20.]{0,2}[:=#]?\x20?([A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){5,40})")
_iban_head = re.compile(r"(?:[\x20-]?[A-Za-z]){2}(?:[\x20-]?[0-9]){2}")
_value_secret = re.compile(r"\x20?[:=]\x20?[\"']?([^\s\"',;]{8,})")
_login = re.compile(r"[^\s/@:]+:[^\s/@]+")
_automata: list = []


def automaton():
    """Anchors of all kinds: pattern -> (kind, length)."""
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", ("email", 1))
        a.add_word("://", ("login", 3))
        for d in "0123456789":
            a.add_word("+" + d, ("phone", 2))
            for e in "0123456789":
                a.add_word(d + "." + e, ("ip", 3))
                for between in ("", " ", "-"):
                    a.add_word(d + between + e, ("card", 2 + len(between)))
        for cue in ACCOUNT_CUES:
            a.add_word(cue, ("account", len(cue)))
        for cue in SECRET_CUES:
            a.add_word(cue, ("secret", len(cue)))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def _run_back(text: str, at: int, least: int, allowed: frozenset) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _run_on(text: str, at: int, allowed: frozenset) -> int:
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    plain = re.sub("[ -]", "", value).upper()
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", plain):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


# A parser gets the text, the anchor's start and the position before which its kind has used the text up. It returns
# (start, end, position used up to, whether the span holds), or None where nothing matches.


def parse_email(text: str, at: int, used: int):
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ around the at-sign."""
    start = _run_back(text, at, used, _LOCAL)
    end = _run_on(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    whole = end
    while end < len(text) and text[end] == ".":
        after = _run_on(text, end + 1, _LABEL)
        if after == end + 1:
            break
        whole = end = after
    dotted = "." in text[at:whole]
    return (start, whole, whole, True) if dotted else None


def parse_ip(text: str, at: int, used: int):
    """Four runs of digits with dots between, each at most 255; the first is the one that ends at the anchor."""
    start = _run_back(text, at, used, _DIGITS)
    end = _run_on(text, at, _DIGITS)
    parts = [text[start:end]]
    while len(parts) < 4 and end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS:
        after = _run_on(text, end + 1, _DIGITS)
        parts.append(text[end + 1 : after])
        end = after
    if len(parts) < 4:
        return None
    return start, end, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def parse_card(text: str, at: int, used: int):
    """Digits with a blank or hyphen between at most; 16 to 19 of them that pass Luhn's test."""
    end, digits = at + 1, 1
    n = len(text)
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
        digits += 1
    if digits < 2:
        return None
    return at, end, end, 16 <= digits <= 19 and luhn("".join(c for c in text[at:end] if c in _DIGITS))


def parse_phone(text: str, at: int, used: int):
    """A plus, then digits with blanks, brackets, dots or hyphens between, a digit last; 8 to 15 digits."""
    end = _run_on(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return at, end, end, 8 <= sum(c in _DIGITS for c in text[at:end]) <= 15


def parse_account(text: str, at: int, used: int, length: int):
    if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    m = _value_account.match(text, at + length)
    if not m:
        return None
    value = m.group(1)
    if text[at : at + length].lower() == "iban":
        if not _iban_head.match(value):
            return None
        words = value.split(" ")
        for k in range(len(words), 0, -1):  # words after the number are not of it
            if iban(" ".join(words[:k])):
                return m.start(1), m.start(1) + len(" ".join(words[:k])), m.end(1), True
        return None
    value = re.match(r"[A-Za-z0-9-]*[0-9][A-Za-z0-9-]*(?:\x20[0-9]+)*", value)
    if not value or not 6 <= len(value.group()) <= 34 or sum(c.isdigit() for c in value.group()) < 2:
        return None
    return m.start(1), m.start(1) + len(value.group()), m.start(1) + len(value.group()), True


def parse_secret(text: str, at: int, used: int, length: int):
    m = _value_secret.match(text, at + length)
    # Cues inside a value without a digit have parts of it for values, so it is used up as a whole.
    return (m.start(1), m.end(1), m.end(1), any(c in _DIGITS for c in m.group(1))) if m else None


def parse_login(text: str, at: int, used: int, length: int):
    m = _login.match(text, at + length)
    if not m:
        return None
    held = text.startswith("@", m.end())
    return (m.start(), m.end(), m.end(), True) if held else None


_BASE = {"email": parse_email, "ip": parse_ip, "card": parse_card, "phone": parse_phone}
_ADDED = {"account": parse_account, "secret": parse_secret, "login": parse_login}


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order of their start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    used = dict.fromkeys(KINDS, 0)
    folded = text.lower()
    if len(folded) != len(text):  # a capital that becomes two characters; fold only those that keep their length
        folded = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for last, (kind, length) in automaton().iter(folded):
        at = last - length + 1
        if at < used[kind]:
            continue
        found = _BASE[kind](text, at, used[kind]) if kind in _BASE else _ADDED[kind](text, at, used[kind], length)
        if found:
            start, end, used[kind], holds = found
            if holds:
                spans[kind].append((start, end))
    return spans


def digest(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def detect(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<kind, start, end, value>>) of each row."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for k, own in find(t).items() for a, b in own] for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=[key, "spans"])

    name = rows.schema[key].dataType.simpleString()
    return mapped(rows.select(key, text), run, f"{key} {name}, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then longest, counts."""
    out, at = [], 0
    for start, end, kind in sorted(((a, b, k) for k, own in find(text).items() for a, b in own), key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def span_digests(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of each row."""
    base = KINDS[:4]

    def run(batches):
        for part in slices(batches):
            found = [find(t or "") for t in part.column(1).to_pylist()]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in base]
            shas = pa.array([hashlib.sha256(digest(f, base).encode()).hexdigest() for f in found], pa.string())
            added = pa.array([sum(len(f[k]) for k in KINDS[4:]) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, shas, pa.array([digest(f) for f in found], pa.string()), added], names=[key, *(f"n_{k}" for k in base), "base_sha256", "spans", "n_added"])

    name = rows.schema[key].dataType.simpleString()
    return mapped(rows.select(key, text), run, f"{key} {name}, " + ", ".join(f"n_{k} bigint" for k in base) + ", base_sha256 string, spans string, n_added bigint")
