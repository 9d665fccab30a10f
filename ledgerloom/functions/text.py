"""Names, addresses, labels and opinions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def text_map(entries: dict[str, str]) -> Column:
    """A literal map column; look up with :func:`looked_up`."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def looked_up(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(text_map(entries), key)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(c: Column) -> Column:
    """Without white space at both ends; Unicode spaces count."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(stripped(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def province(c: Column) -> Column:
    """The standard name of a province, or null."""
    spellings = {s: name for name, all_ in fixed.PROVINCES.items() for s in all_}
    return looked_up(spellings, stripped(c))


def address_parts(c: Column) -> Column:
    """Struct (sido, sigungu) of the first two words; both null unless the first is a province."""
    words = F.split(stripped(c), r"(?U)\s+")
    sido = province(F.get(words, F.lit(0)))
    return F.struct(sido.alias("sido"), F.when(sido.isNotNull(), F.get(words, F.lit(1))).alias("sigungu"))


def company_name(c: Column) -> Column:
    """A name without legal forms, spaces and parentheses, for matching."""
    for word in fixed.COMPANY_WORDS:
        c = F.replace(c, F.lit(word), F.lit(""))
    return F.translate(c, " ()", "")


def names_align(a: Column, b: Column) -> Column:
    """Whether two normalised names are the same, or one holds the other and isn't twice as long."""
    a, b = company_name(stripped(a)), company_name(stripped(b))
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    same = (a == b) | (F.contains(long, short) & (2 * F.length(short) >= F.length(long)))
    return F.coalesce((a != "") & (b != "") & same, F.lit(False))


def industry_name(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s;()]", "")


def corporate_number(c: Column) -> Column:
    return blank_to_null(F.replace(c, F.lit("-"), F.lit("")))


def _roman_repaired(c: Column) -> Column:
    """Signs that look like a Roman numeral in front are made one, if one comes of it."""

    def repaired(text: Column) -> Column:
        found = F.translate(F.regexp_extract(text, fixed.LOOKALIKE_PREFIX, 1), *fixed.LOOKALIKES)
        made = bound(found, lambda f: F.when(f.isin(fixed.ROMAN), F.concat(f, F.lit("."), F.regexp_replace(text, fixed.LOOKALIKE_PREFIX, ""))).otherwise(text))
        return F.when(text.contains("."), made).otherwise(text)

    return bound(c, repaired)


def has_roman_prefix(c: Column) -> Column:
    return F.coalesce(_roman_repaired(stripped(c)).rlike(fixed.ROMAN_PREFIX), F.lit(False))


def account_label(c: Column) -> Column:
    """A statement's row label without numbering, remarks and blanks."""

    def without(text: Column, *patterns: str) -> Column:
        for pattern in patterns:
            for _ in range(2):
                text = stripped(F.regexp_replace(text, pattern, ""))
        return text

    def without_remarks(text: Column) -> Column:  # each of them ends with a bracket
        remarks = without(text, fixed.PER_SHARE_SUFFIX, fixed.FOOTNOTE_SUFFIX, fixed.FORMULA_SUFFIX)
        return F.when(text.endswith(")") | text.endswith("]"), remarks).otherwise(text)

    c = without(_roman_repaired(stripped(F.coalesce(c, F.lit("")))), fixed.LABEL_PREFIX)
    return F.translate(bound(c, without_remarks), fixed.LABEL_BLANKS, "")


def cross_year_label(c: Column) -> Column:
    """A label that stays the same from year to year: no parentheses, numbering or blanks."""
    c = F.regexp_replace(c, r"\([^)]*\)", "")
    c = F.regexp_replace(c, r"^[0-9IVXivx]+[.)]\s*", "")
    return F.regexp_replace(c, r"(?U)\s", "")


def before_signer(c: Column) -> Column:
    return F.regexp_replace(c, f"(?s)({'|'.join(fixed.SIGNER_WORDS)}).*", "")


def auditor_key(c: Column) -> Column:
    """A key under which spellings of one auditor's name are equal; null without a name."""
    packed = F.regexp_replace(c, r"(?U)\s+", "")
    out = packed
    for suffix in reversed(fixed.AUDITOR_SUFFIXES):  # the first suffix of the list that occurs decides
        at = F.instr(packed, suffix)
        head = F.substring(packed, F.lit(1), at - 1)
        tail = before_signer(F.substring(packed, at + len(suffix), F.length(packed)))
        named = (
            F.when(tail == "", F.concat(head, F.lit(suffix)))
            .when(F.length(head) <= 1, F.concat(tail, F.lit(suffix)))
            .otherwise(F.concat(head, F.lit(suffix), tail))
        )
        out = F.when(at > 0, named).otherwise(out)
    return F.nullif(out, F.lit(""))


def plain_text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")


def audit_opinion(c: Column) -> Column:
    """The kind of opinion that the opening of a report states, or null."""
    opening = F.substring(plain_text(c), 1, fixed.OPINION_WINDOW)
    return reduce(
        lambda rest, kind: F.when(opening.rlike(fixed.OPINIONS[kind]), F.lit(kind)).otherwise(rest),
        reversed(fixed.OPINIONS),
        F.lit(None).cast("string"),
    )


def is_unreliable_opinion(c: Column) -> Column:
    return F.coalesce(reduce(Column.__or__, [F.contains(c, F.lit(k)) for k in fixed.UNRELIABLE_OPINIONS]), F.lit(False))


def without_controls(c: Column) -> Column:
    """Text that a sheet can hold: no control signs."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def sheet_text(c: Column) -> Column:
    return stripped(without_controls(F.coalesce(c, F.lit(""))))


def file_stem(c: Column, fallback: str = "회사명없음") -> Column:
    """A name as part of a file name: forbidden signs replaced, cut at 100, reserved names marked."""
    name = F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")
    name = F.regexp_replace(stripped(name), r"[. ]+$", "")
    name = F.regexp_replace(F.substring(name, 1, 100), r"[. ]+$", "")
    reserved = F.upper(name).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$")
    name = F.when(reserved, F.concat(F.lit("_"), name)).otherwise(name)
    return F.when(name == "", F.lit(fallback)).otherwise(name)


def script_json(c: Column) -> Column:
    """JSON text that may stand inside a script element."""
    for sign, escaped in (("<", "\\u003c"), (" ", "\\u2028"), (" ", "\\u2029")):
        c = F.replace(c, F.lit(sign), F.lit(escaped))
    return c


def masked_keys(c: Column) -> Column:
    """Log lines with the values of API keys masked."""
    return F.regexp_replace(c, r"(crtfc_key|serviceKey)=[^&\s]+", "$1=***REDACTED***")


def says_quota_exceeded(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(low.contains("limited_number_of_service_requests") | low.contains("quota"), F.lit(False))
