"""Personal data by anchors: an Aho-Corasick pass finds cues, local parsers expand and validate them.

Anchors are at-signs, spelled-out at-signs, a plus before a digit, two digits side by side or one
separator apart, schemes and identifier words in any case. The parser of an anchor's kind walks left
and right from it, so a text is read once and only the surroundings of anchors twice.

Kinds of the base: email, ip, card, phone (:data:`BASE`), as leftmost non-overlapping matches.
The method adds spans, never at the cost of a base one: cards and phone numbers that stand
side by side with other numbers (the base drops the whole run), emails with a spelled-out at-sign
("(at)", "[at]", "{at}", or " at " before a domain with spelled-out dots), ``iban`` (checked modulo 97),
``ssn``, ``account`` (a number after a cue such as "IBAN", "account", "acct"), ``url_login``
(user and password after a scheme), ``secret`` (a key after a cue such as "api_key").

Defined cases: a null or empty text has no spans; positions are code points, ends exclusive;
repeated rows are each searched; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pricelode.llm.storage import picked

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "iban", "secret", "ssn", "url_login")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
LABEL = DIGITS | LETTERS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
NUMBER_JOIN = frozenset(" -")

ACCOUNT_CUE = re.compile(r"(?i)(?:account|acct|konto|kontonummer|cuenta|compte|iban)(?:[ ]?(?:no|number|nr|num))?[.:#= ]{1,3}((?:[a-z]{2}(?=[0-9]{2}))?[0-9][0-9 -]{4,32}[0-9])")
SECRET_CUE = re.compile(r"(?i)(?:api[_-]?key|secret(?:[_-]?key)?|access[_-]?token|auth[_-]?token|password|passwd|token)[\"']?\s{0,2}[:=]\s{0,2}[\"']?(?=[A-Za-z0-9_/+=.-]{8})")
SECRET = re.compile(r"[A-Za-z0-9_/+=.-]+")
SPELLED = re.compile(r"(?ia)(?: ?[\[({] ?at ?[\])}] ?[a-z0-9-]+(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[a-z0-9-]+)+| at [a-z0-9-]+(?: dot [a-z0-9-]+)+)")
LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/@:]+:[^\s/@]+@[^\s/]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", "at")
    for a in "0123456789":
        found.add_word("+" + a, "phone")
        for b in "0123456789":
            for gap in ("", " ", "-"):
                found.add_word(a + gap + b, "digits")
            found.add_word(f"{a}.{b}", "ip")
    found.add_word("://", "scheme")
    for opening, closing in ("()", "[]", "{}"):
        for gap in ("", " "):
            found.add_word(f"{opening}{gap}at{gap}{closing}", "spelled")
    found.add_word(" at ", "spelled")
    for cue in ("account", "acct", "konto", "cuenta", "compte", "iban"):
        found.add_word(cue, "account")
    for cue in ("api_key", "api-key", "apikey", "secret", "token", "passw"):
        found.add_word(cue, "secret")
    for cue in ("akia", "ghp_", "sk-"):
        found.add_word(cue, "key")
    found.make_automaton()
    return found


def lowered(t: str) -> str:
    """A lower-cased copy for the automaton, with every character at its place."""
    low = t.lower()
    return low if len(low) == len(t) else re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def email_at(t: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand an at-sign; ``floor`` is the end of the match before."""
    start = at
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end = len(t), at + 1
    while end < n and t[end] in LABEL:
        end += 1
    if end == at + 1:
        return None
    dots = 0
    while end + 1 < n and t[end] == "." and t[end + 1] in LABEL:
        end += 2
        dots += 1
        while end < n and t[end] in LABEL:
            end += 1
    return (start, end) if dots else None


def spelled_at(t: str, end: int) -> tuple[int, int] | None:
    """Expand a spelled-out at-sign whose last character is at ``end``."""
    at = end
    while at > 0 and t[at] not in "([{" and end - at < 5 and not (t[at] == " " and at == end - 3):
        at -= 1
    if at > 0 and t[at] != " " and t[at - 1] == " ":
        at -= 1
    m = SPELLED.match(t, at)
    start = at
    while start > 0 and t[start - 1] in LOCAL:
        start -= 1
    return (start, m.end()) if m and start < at else None


def digits_from(t: str, i: int) -> int:
    n = len(t)
    while i < n and t[i] in DIGITS:
        i += 1
    return i


def ips_at(t: str, dot: int, floor: int) -> tuple[list[tuple[int, int]], int]:
    """All groups of four in the chain of dotted numbers around a dot, and the chain's end."""
    start = dot
    while start > floor and t[start - 1] in DIGITS:
        start -= 1
    cuts, i, n = [], start, len(t)
    while True:
        end = digits_from(t, i)
        cuts.append((i, end))
        if end + 1 < n and t[end] == "." and t[end + 1] in DIGITS:
            i = end + 1
        else:
            break
    found = []
    for k in range(0, len(cuts) - 3, 4):
        four = cuts[k : k + 4]
        if all(int(t[a:b]) <= 255 if b - a < 12 else not t[a:b].lstrip("0")[3:] and int(t[a:b].lstrip("0") or 0) <= 255 for a, b in four):
            found.append((four[0][0], four[3][1]))
    return found, cuts[-1][1]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def number_at(t: str, i: int, floor: int) -> tuple[int, int]:
    """The longest run of digits, each one separator at most from the next, around a digit."""
    start, n = i, len(t)
    while start > floor:
        if t[start - 1] in DIGITS:
            start -= 1
        elif start > floor + 1 and t[start - 1] in NUMBER_JOIN and t[start - 2] in DIGITS:
            start -= 2
        else:
            break
    end = i + 1
    while end < n:
        if t[end] in DIGITS:
            end += 1
        elif end + 1 < n and t[end] in NUMBER_JOIN and t[end + 1] in DIGITS:
            end += 2
        else:
            break
    return start, end


def phone_at(t: str, plus: int) -> tuple[int, int] | None:
    """A plus, a digit, then phone characters up to the last digit, one between them at least."""
    end, n, last = plus + 2, len(t), -1
    while end < n and t[end] in PHONE:
        if t[end] in DIGITS and end > plus + 2:
            last = end + 1
        end += 1
    return (plus, last) if last > 0 else None


def card_valid(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def cards_inside(t: str, start: int, end: int) -> list[tuple[int, int]]:
    """Valid cards among the groups of a longer run, such as two cards side by side."""
    groups = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", t[start:end])]
    found, i = [], 0
    while i < len(groups):
        for j in range(i, min(i + 19, len(groups))):
            if card_valid(t[groups[i][0] : groups[j][1]]):
                found.append((groups[i][0], groups[j][1]))
                i = j
                break
        i += 1
    return found


def phone_inside(t: str, start: int, end: int) -> tuple[int, int] | None:
    """The longest phone number that ends at a space within a run of too many digits."""
    for cut in range(end - 1, start, -1):
        if t[cut] == " " and t[cut - 1] in DIGITS and 8 <= sum(c in DIGITS for c in t[start:cut]) <= 15:
            return start, cut
    return None


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(t: str, cues) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The base kinds' spans, and the number runs that were dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    dropped = []
    mail_end = ip_end = number_end = phone_end = 0
    for end, kind in cues:
        if kind == "at":
            if span := email_at(t, end, mail_end):
                found["email"].append(span)
                mail_end = span[1]
        elif kind == "ip":
            if end > ip_end:
                spans, ip_end = ips_at(t, end - 1, ip_end)
                found["ip"] += spans
        elif kind == "digits":
            if end >= number_end:
                start, number_end = number_at(t, end, number_end)
                if card_valid(t[start:number_end]):
                    found["card"].append((start, number_end))
                elif number_end - start > 16:
                    dropped.append(("card", start, number_end))
        elif kind == "phone" and end > phone_end:
            if span := phone_at(t, end - 1):
                phone_end = span[1]
                if 8 <= sum(c in DIGITS for c in t[span[0] : span[1]]) <= 15:
                    found["phone"].append(span)
                else:
                    dropped.append(("phone", *span))
    return found, dropped


def spans_of(t: str, cues) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The base spans of a text by kind, and all spans by kind, each in order of starts."""
    cues = list(cues)
    if not cues:
        return {}, {}
    base, dropped = base_spans(t, cues)
    every = {k: set(base.get(k, ())) for k in KINDS}
    for kind, start, end in dropped:
        if kind == "card":
            every["card"].update(cards_inside(t, start, end))
        elif span := phone_inside(t, start, end):
            every["phone"].add(span)
    secret_end = 0
    for end, kind in cues:
        if kind == "account":
            # the window bounds the cue and its first digits; the last run of digits is whole
            if (m := ACCOUNT_CUE.search(t, max(0, end - 7), end + 64)) and m.start() <= end:
                every["account"].add((m.start(1), digits_from(t, m.end(1))))
        elif kind == "secret":
            # the window bounds the cue; the value goes on to its end (values within a value share it)
            if (m := SECRET_CUE.search(t, max(0, end - 12), end + 200)) and m.start() <= end:
                if m.end() >= secret_end:
                    secret_end = SECRET.match(t, m.end()).end()
                every["secret"].add((m.end(), secret_end))
        elif kind == "key":
            if m := KEY.match(t, max(0, end - 3)) or KEY.match(t, max(0, end - 2)):
                every["secret"].add(m.span())
        elif kind == "spelled":
            if span := spelled_at(t, end):
                every["email"].add(span)
        elif kind == "scheme":
            start = end - 2
            while start > 0 and (t[start - 1] in LABEL or t[start - 1] in "+."):
                start -= 1
            if m := LOGIN.match(t, start):
                every["url_login"].add(m.span())
        elif kind == "digits":
            if m := SSN.search(t, max(0, end - 8), end + 12):
                every["ssn"].add(m.span())
            if end >= 3 and t[end - 1] in DIGITS and t[end - 2] in LETTERS and t[end - 3] in LETTERS and (m := IBAN.match(t, end - 3)):
                s, e = m.span()
                while e - s >= 15 and not iban_valid(t[s:e]):
                    e -= 1
                if e - s >= 15:
                    every["iban"].add((s, e))
    return base, {k: sorted(v) for k, v in every.items()}


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(found.get(k, ())))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of their spans, and all spans."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = automaton()
        for batch in batches:
            out = []
            for t in batch.column(1):
                t = t.as_py() or ""
                base, every = spans_of(t, cues.iter(lowered(t))) if t else ({}, {})
                counts = [len(base.get(k, ())) for k in BASE]
                out.append((*counts, hashlib.sha256(listed(base, BASE).encode()).hexdigest(), listed(every, KINDS)))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return picked(docs, "doc_id", "text").mapInArrow(task, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
