"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and identifier
cues. At each anchor a deterministic local parser expands to the boundaries of an email address, IP address,
payment card, phone number, link with credentials, IBAN or account number, and validates it (octets at most
255, Luhn, digit counts, IBAN remainder). Every parser is linear in the text.

Base kinds (email, ip, card, phone) are leftmost and do not overlap within a kind; a match that fails its
check is passed over whole. Added kinds: link, iban, account.

Defined cases: a null or empty text has no spans; spans are code points, end exclusive, ordered by kind as
listed in KINDS, then start; rows with the same id are handled one by one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineform.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "link", "iban", "account")
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "cuenta": "account", "compte": "account", "ssn": "account"}
SCHEMES = ("http://", "https://", "ftp://", "ssh://")

SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"[\x20().0-9-]+")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&*+,;=-]+:[A-Za-z0-9._~%!$&*+,;=-]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20(?:no|number|nr))?[.:#]?[\x20:#]{0,3}([0-9](?:-?[0-9]){5,16})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for c in "0123456789":
        automaton.add_word(c, ("digit", 1))
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    for s in SCHEMES:
        automaton.add_word(s, ("scheme", len(s)))
    for cue, kind in CUES.items():
        for form in (cue, cue.upper(), cue.capitalize()):
            automaton.add_word(form, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


def _dotted(text: str, start: int, end: int, out: list) -> None:
    """IP addresses of a run of digits and dots."""
    parts, at = [], start
    for p in text[start:end].split("."):
        parts.append((p, at))
        at += len(p) + 1
    i = 0
    while i + 3 < len(parts):
        four = parts[i : i + 4]
        if all(p for p, _ in four):
            if all(len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p, _ in four):
                out.append(("ip", four[0][1], four[3][1] + len(four[3][0])))
            i += 4
        else:
            i += 1


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text: (kind, start, end)."""
    out: list[tuple[str, int, int]] = []
    email_end = dotted_end = card_end = phone_end = account_end = 0
    for last, (what, n) in anchors().iter(text):
        at = last - n + 1
        if what == "digit":
            if at >= dotted_end:
                dotted_end = _DOTTED.match(text, at).end()
                if dotted_end - at >= 7:
                    _dotted(text, at, dotted_end, out)
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                if card_end - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, card_end))
        elif what == "at":
            left = at
            while left > email_end and _LOCAL.match(text, left - 1):
                left -= 1
            if left < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append(("email", left, email_end))
        elif what == "plus":
            if at >= phone_end and text[at + 1 : at + 2] in set("0123456789") and (m := _PHONE.match(text, at + 2)):
                run = m[0].rstrip(" ().-")
                if len(run) >= 2:
                    phone_end = at + 2 + len(run)
                    if 8 <= 1 + sum(c.isdigit() for c in run) <= 15:
                        out.append(("phone", at, phone_end))
        elif what == "scheme":
            if m := _LOGIN.match(text, last + 1):
                out.append(("link", at, m.end()))
        elif last + 1 > account_end and (m := (_IBAN if what == "iban" else _ACCOUNT).match(text, last + 1)):
            if what == "account" or iban_ok(m[1]):
                out.append((what, m.start(1), m.end(1)))
                account_end = m.end()
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(dict.fromkeys(out), key=lambda s: (order[s[0]], s[1]))


def _find_rows(batches):
    for batch in common.sliced(batches):
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in common.texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(spans, pa.list_(_SPAN))], schema=_ARROW)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of every row. No shuffle."""
    return common.id_and_text(docs, id_col, text_col).mapInArrow(_find_rows, SPANS)


def redact(text: str | None, kinds=KINDS) -> str | None:
    """The text with every found span replaced by its kind in brackets; of overlapping spans the first, and then the longest, counts."""
    if not text:
        return text
    out, at = [], 0
    for k, s, e in sorted((x for x in find(text) if x[0] in kinds), key=lambda x: (x[1], -x[2])):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", kinds=KINDS) -> DataFrame:
    """docs with the personal data of its text column replaced; all other columns stay."""

    i = docs.columns.index(text_col)

    def run(batches):
        for batch in common.sliced(batches, i):
            new = pa.array([redact(t, kinds) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _listed(column):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(_listed(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
