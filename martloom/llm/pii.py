"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, digits, schemes and identifier cues. Around each
anchor a small parser expands to the left and right and validates what it has: e-mail addresses, IP addresses, card and
phone numbers, addresses with credentials, IBANs and account numbers. Parsers never go back over what they have consumed, so a
text of any length is read once.
"""

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from martloom.llm.common import slices, small_batches, texts

# The kinds in the order of results, and the characters of their parts.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "credentials", "iban", "account")
DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LETTERS | DIGITS | set("._%+-")
PHONE = DIGITS | set(" ().-")
AUTHORITY = LOCAL | set("~!$&'()*,;=:")
CUES = ("account", "acct", "passport", "ssn", "iban", "customer id", "tax id")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def _anchors():
    automaton = ahocorasick.Automaton()
    for word in ("@", "+", "://", *sorted(DIGITS)):
        automaton.add_word(word, (word, word))
    for cue in CUES:
        for word in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            automaton.add_word(word, ("cue", word))
    automaton.make_automaton()
    return automaton


def _run(text: str, at: int, allowed: frozenset) -> int:
    """The end of the run of allowed characters from a place."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _run_back(text: str, at: int, floor: int, allowed: frozenset) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, sign: int, floor: int) -> Span | None:
    start = _run_back(text, sign, floor, LOCAL)
    end = _run(text, sign + 1, LABEL)
    if start == sign or end == sign + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        label = _run(text, end + 1, LABEL)
        if label == end + 1:
            break
        end, labels = label, labels + 1
    return ("email", start, end) if labels > 1 else None


def _dotted(text: str, start: int) -> tuple[list[Span], int]:
    """Groups of four numbers in a chain of numbers and single dots; and the chain's end."""
    parts, at = [], start
    while True:
        end = _run(text, at, DIGITS)
        parts.append((at, end))
        if not (end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS):
            break
        at = end + 1
    found = []
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        if all(len(p := text[a:b].lstrip("0")) < 4 and int(p or "0") <= 255 for a, b in four):
            found.append(("ip", four[0][0], four[3][1]))
    return found, parts[-1][1]


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _card(text: str, start: int) -> tuple[Span | None, int]:
    at, n = start + 1, len(text)
    while at < n:
        if text[at] in DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            at += 2
        else:
            break
    digits = text[start:at].replace(" ", "").replace("-", "") if at - start < 40 else ""
    return (("card", start, at) if 13 <= len(digits) <= 19 and _luhn(digits) else None), at


def _phone(text: str, plus: int) -> Span | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4 or text[end - 1] not in DIGITS:
        return None
    return ("phone", plus, end) if 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15 else None


def _credentials(text: str, colon: int) -> Span | None:
    """scheme://user:secret@host"""
    start = _run_back(text, colon, 0, LETTERS)
    sign = _run(text, colon + 3, AUTHORITY)
    if start == colon or sign == colon + 3 or sign >= len(text) or text[sign] != "@":
        return None
    end = _run(text, sign + 1, LABEL | {"."})
    return ("credentials", start, end) if end > sign + 1 and ":" in text[colon + 3:sign] else None


def _iban_valid(value: str) -> bool:
    if not (15 <= len(value) <= 34 and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _identifier(text: str, cue_end: int) -> Span | None:
    """What a cue names: one run of letters, digits, hyphens and (in IBANs) single spaces, with five digits at least."""
    at = cue_end
    for word in ("", " number", " no.", " no", " nr"):
        if word and text[at:at + len(word)].lower() == word:
            at += len(word)
            break
    gap = at
    while gap < len(text) and gap - at < 4 and text[gap] in " :#=.":
        gap += 1
    if gap == at:
        return None
    end = _run(text, gap, LABEL)
    iban = end
    while iban < len(text) and text[iban] == " " and iban - gap < 42:
        more = _run(text, iban + 1, LETTERS | DIGITS)
        if more == iban + 1 or more - iban > 5:
            break
        iban = more
    if iban - gap <= 44 and _iban_valid(text[gap:iban].replace(" ", "").upper()) and text[gap:iban].isascii():
        return "iban", gap, iban
    value = text[gap:end].rstrip("-")
    return ("account", gap, gap + len(value)) if 5 <= len(value) <= 34 and sum(c in DIGITS for c in value) >= 5 else None


def find_in(text: str) -> list[Span]:
    """All spans by kind, then start; code points, end exclusive."""
    found: list[Span] = []
    after_email = after_dotted = after_card = after_phone = after_account = 0
    for last, (kind, word) in _anchors().iter(text):
        if kind in DIGITS:
            if last >= after_dotted:
                spans, after_dotted = _dotted(text, last)
                found += spans
            if last >= after_card:
                span, after_card = _card(text, last)
                if span:
                    found.append(span)
        elif kind == "@":
            if last >= after_email and (span := _email(text, last, after_email)):
                found.append(span)
                after_email = span[2]
        elif kind == "+":
            if last >= after_phone and (span := _phone(text, last)):
                found.append(span)
                after_phone = span[2]
        elif kind == "://":
            if span := _credentials(text, last - 2):
                found.append(span)
        elif last >= after_account and (span := _identifier(text, last + 1)):
            found.append(span)
            after_account = span[2]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def redact_in(text: str) -> str:
    """Each stretch of overlapping spans replaced by the kind of the one that starts first, in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(find_in(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row.

    Null and empty texts have no spans; spans of different kinds may overlap; repeated rows are searched each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in find_in(t)] for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, SPAN_TYPE)], ["doc_id", "spans"])

    data = texts(df, id_col, text_col)
    kind = data.schema["doc_id"].dataType.simpleString()
    return data.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in the text column replaced by the kind in brackets; a null text stays null."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            clean = [None if t is None else redact_in(t) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))

    return small_batches(df).mapInArrow(run, df.schema)


def span_text(spans: str = "spans", kinds: tuple[str, ...] = KINDS):
    """Column: the spans of the kinds as kind:start:end, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(kind: str, spans: str = "spans"):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
