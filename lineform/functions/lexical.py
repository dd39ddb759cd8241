"""Splitting, escaping and trimming as column expressions.

Every legal escape becomes a private-use character of its own, so that later splits see only delimiters that
are not escaped; ``restored`` turns these into the characters that they stand for. Where a text has such a
character itself, it is put as a pair first, and comes back the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKSLASH, PIPE, COMMA, SEPARATOR, STAR, QUOTE, NEWLINE, PAIR = RESERVED = tuple(chr(0xE000 + i) for i in range(8))
_SECOND = tuple(chr(0xF000 + i) for i in range(8))
#: White space of Unicode, for trimming.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: An element that stands for itself, with a mark at most.
PLAIN = r"\A[A-Za-z0-9_.+-]++\*?\z"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), lambda one: f(one)), 0)


def has_reserved(text: Column) -> Column:
    return F.contains(text.cast("binary"), F.lit(b"\xee\x80"))  # how UTF-8 starts U+E000 to U+E03F


def _paired(text: Column) -> Column:
    pairs = F.replace(text, F.lit(PAIR), F.lit(PAIR + _SECOND[7]))
    for c, second in zip(RESERVED[:7], _SECOND, strict=False):
        pairs = F.replace(pairs, F.lit(c), F.lit(PAIR + second))
    return F.when(has_reserved(text), pairs).otherwise(text)


def _unpaired(text: Column) -> Column:
    def opened(t: Column) -> Column:
        plain = t
        for c, second in zip(RESERVED, _SECOND, strict=True):
            plain = F.replace(plain, F.lit(PAIR + second), F.lit(c))
        return F.when(t.contains(PAIR), plain).otherwise(t)

    return bound(text, opened)


def valid_escapes(line: Column, separator: str = ",") -> Column:
    """Whether every backslash starts a legal escape."""
    return ~line.contains("\\") | line.rlike(_legal(separator) + r"\z")


def dangling(line: Column, separator: str = ",") -> Column:
    """Whether the only fault of a line's escapes is a backslash at its end."""
    return line.endswith("\\") & line.rlike(_legal(separator) + r"\\\z")


def _legal(separator: str) -> str:
    return r"\A(?:[^\\]++|\\[|,*" + _quoted(separator) + r'\\"n])*+'


def _quoted(c: str) -> str:
    return "\\" + c if not c.isalnum() else c


def shielded(line: Column, separator: str = ",") -> Column:
    pairs = [("\\\\", BACKSLASH), ("\\|", PIPE), ("\\,", COMMA)]
    if separator != ",":
        pairs.append(("\\" + separator, SEPARATOR))
    plain = _paired(line)
    done = plain
    for old, new in (*pairs, ("\\*", STAR), ('\\"', QUOTE), ("\\n", NEWLINE)):
        done = F.replace(done, F.lit(old), F.lit(new))
    return F.when(line.contains("\\"), done).otherwise(plain)


def restored(text: Column, separator: str = ",") -> Column:
    plain = text  # F.translate takes a map's look-up for every character
    for c, own in zip(RESERVED, ("\\", "|", ",", separator, "*", '"', "\n"), strict=False):
        plain = F.replace(plain, F.lit(c), F.lit(own))
    return F.when(has_reserved(text), _unpaired(plain)).otherwise(text)


def shielded_text(text: Column) -> Column:
    """A restored text as a cell in which nothing is a delimiter."""
    return _paired(text)


def trimmed(text: Column) -> Column:
    """Trimming at the end goes through the whole text, so it is done only where the last byte can be one of white space."""
    last = F.substring(text.cast("binary"), -1, 1)
    return F.when((last > F.lit(b"\x20")) & (last < F.lit(b"\x80")), F.ltrim(text, F.lit(SPACES))).otherwise(F.btrim(text, F.lit(SPACES)))


def is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES)) == ""


def fields_of(shield: Column) -> Column:
    """The trimmed fields of a shielded line; escapes are still shielded."""
    return F.transform(F.split(shield, r"\|", -1), trimmed)


def elements_of(cell: Column, separator: str = ",") -> Column:
    """struct(elements, whole): the elements of a shielded list cell as structs (text, marked), and whether the quotes are right."""
    sep = _quoted(separator)
    pattern = sep + r'(\s*"(?:[^"]|"")*+"\s*\*?\s*(?=' + sep + r"|\z)|[^" + sep + r'"][^' + sep + r"]*|(?=" + sep + r"|\z))"

    def element(x: Column) -> Column:
        def unmarked(text: Column) -> Column:
            marked = text.endswith("*")
            return F.struct(F.when(marked, trimmed(F.substring(text, F.lit(1), F.length(text) - 1))).otherwise(text).alias("bare"), marked.alias("marked"))

        def opened(e: Column) -> Column:
            bare = e["bare"]
            quoted = bare.startswith('"') & bare.endswith('"') & (F.length(bare) >= 2)
            inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
            starred = quoted & inner.endswith("*")  # a marker just before the closing quote
            inner = F.when(starred, F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)
            return F.struct(restored(F.when(quoted, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(bare), separator).alias("text"), (e["marked"] | starred).alias("marked"))

        marked = x.endswith("*")
        plain = F.struct(F.when(marked, F.replace(x, F.lit("*"), F.lit(""))).otherwise(x).alias("text"), marked.alias("marked"))
        return F.when(x.rlike(PLAIN), plain).otherwise(bound(unmarked(trimmed(x)), opened))

    def quoted_cell(c: Column) -> Column:
        led = F.concat(F.lit(separator), c)
        return bound(F.regexp_extract_all(led, F.lit(pattern), F.lit(1)), lambda raw: F.struct(raw.alias("raw"), (F.length(F.array_join(raw, "")) + F.size(raw) == F.length(led)).alias("whole")))

    split = F.when(cell.contains('"'), quoted_cell(cell)).otherwise(F.struct(F.split(cell, sep, -1).alias("raw"), F.lit(True).alias("whole")))
    return bound(split, lambda r: F.struct(F.transform(r["raw"], element).alias("elements"), r["whole"].alias("whole")))


def escaped_scalar(text: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped_element(text: Column, separator: str = ",") -> Column:
    whole = text
    text = F.replace(escaped_scalar(text), F.lit(separator), F.lit("\\" + separator))
    text = F.when(text.endswith("*"), F.concat(F.regexp_replace(text, r"\*$", ""), F.lit("\\*"))).otherwise(text)
    text = F.when(text.startswith('"'), F.concat(F.lit("\\"), text)).otherwise(text)
    text = F.when(text == "", F.lit('""')).otherwise(text)
    return F.when(whole.rlike(r"\A[A-Za-z0-9_]++\z"), whole).otherwise(text) if not separator.isalnum() and separator != "_" else text


def field_count(line: Column) -> Column:
    """Fields of a line by its pipes; escapes are skipped without a check."""
    bare = F.regexp_replace(line, r"\\.", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("|"), F.lit(""))) + 1
