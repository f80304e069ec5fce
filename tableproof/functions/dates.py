"""Date grammars as expressions: a token to ISO text, or its day and month fields where their order is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their numbers.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "janv": 1, "janvier": 1, "fevr": 2, "février": 2, "mars": 3, "avr": 4, "avril": 4, "mai": 5, "juin": 6, "juil": 7, "juillet": 7,
    "août": 8, "aout": 8, "sept": 9, "septembre": 9, "octobre": 10, "novembre": 11, "déc": 12, "decembre": 12,
}
#: The grammars.
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"
ISO_DASH = rf"(?U)^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[ T]{CLOCK})?$"
ISO_SLASH = rf"(?U)^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[ T]{CLOCK})?$"
DAY_MONTH = rf"(?U)^(\d{{1,2}})[\s-]+([A-Za-zÀ-ÿ]{{3,}})\.?[\s-]+(\d{{2,4}})(?:[\s,]+{CLOCK})?$"
MONTH_DAY = rf"(?U)^([A-Za-zÀ-ÿ]{{3,}})\.?[\s-]+(\d{{1,2}}),?[\s-]+(\d{{2,4}})(?:[\s,]+{CLOCK})?$"
NUMERIC = rf"(?U)^(\d{{1,2}})([/.\-])(\d{{1,2}})\2(\d{{2,4}})(?:[ T]{CLOCK})?$"
EPOCH = r"(?U)^\d{9,15}$"
EXCEL = r"(?U)^\d{1,7}(?:\.\d+)?$"


def _int(token: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(token, pattern, group), F.lit("")), F.lit("0")).try_cast("int")


def full_year(y: Column) -> Column:
    """Two-digit years below 70 are of this century, the others of the last."""
    return F.when(y >= 100, y).when(y < 70, y + 2000).otherwise(y + 1900)


def iso(y: Column, m: Column, d: Column, hh: Column, mm: Column, ss: Column) -> Column:
    """ISO text of a valid date, with the time unless it is midnight; else null."""
    inside = y.between(1, 9999) & m.between(1, 12) & d.between(1, 31) & (hh <= 23) & (mm <= 59) & (ss <= 59)
    valid = F.when(inside, F.try_make_timestamp(y, m, d, hh, mm, ss)).isNotNull()
    date = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(valid, F.when((hh > 0) | (mm > 0) | (ss > 0), F.concat(date, F.format_string(" %02d:%02d:%02d", hh, mm, ss))).otherwise(date))


def _fields(token: Column, pattern: str, y: int, m: int | Column, d: int, clock: int, century: bool = True) -> Column:
    """struct of a date's numbers, as the pattern's groups hold them."""
    year = _int(token, pattern, y)
    parts = [full_year(year) if century else year, _int(token, pattern, m) if isinstance(m, int) else m, _int(token, pattern, d), *(_int(token, pattern, clock + k) for k in range(3))]
    return F.struct(*[p.alias(n) for p, n in zip(parts, ("y", "m", "d", "hh", "mm", "ss"), strict=True)])


def _iso_fields(fields: Column) -> Column:
    """iso() of a struct, bound to a variable: written out, its copies would outgrow a compiled method."""
    return F.element_at(F.transform(F.array(fields), lambda p: F.when(p.isNotNull(), iso(*(p[n] for n in ("y", "m", "d", "hh", "mm", "ss"))))), 1)


def _month(token: Column, pattern: str, group: int) -> Column:
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    return F.try_element_at(names, F.lower(F.regexp_extract(token, pattern, group)))


def _iso_of(ts: Column) -> Column:
    text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.when(F.year(ts).between(1, 9999), F.when(text.endswith(" 00:00:00"), F.substring(text, 1, 10)).otherwise(text))


def unambiguous(token: Column, allow_epoch_excel: bool = False) -> Column:
    """ISO text of tokens whose grammar fixes the order of their fields; the first grammar that fits decides.

    Epochs and spreadsheet serials are read in the session's zone, which the engine keeps at UTC.
    """
    return F.element_at(F.transform(F.array(token), lambda t: _unambiguous(t, allow_epoch_excel)), 1)


def _unambiguous(token: Column, allow_epoch_excel: bool) -> Column:
    by_day, by_month = _month(token, DAY_MONTH, 2), _month(token, MONTH_DAY, 1)
    found = _iso_fields(
        F.when(token.rlike(ISO_DASH), _fields(token, ISO_DASH, 1, 2, 3, 4, False))
        .when(token.rlike(ISO_SLASH), _fields(token, ISO_SLASH, 1, 2, 3, 4, False))
        .when(token.rlike(DAY_MONTH) & by_day.isNotNull(), _fields(token, DAY_MONTH, 3, by_day, 1, 4))
        .when(token.rlike(MONTH_DAY) & by_month.isNotNull(), _fields(token, MONTH_DAY, 3, by_month, 2, 4))
    )
    if allow_epoch_excel:
        n = token.try_cast("long")
        seconds = F.when(F.length(token) <= 10, n).when(F.length(token) <= 13, F.floor(n / 1000)).otherwise(F.floor(n / 1_000_000))
        days = token.try_cast("double")
        serial = F.when(days.between(1, 2958465), F.timestamp_micros(F.round((days - 25569) * 86_400_000_000).cast("long")))
        dated = token.rlike(ISO_DASH) | token.rlike(ISO_SLASH) | (token.rlike(DAY_MONTH) & by_day.isNotNull()) | (token.rlike(MONTH_DAY) & by_month.isNotNull())
        found = F.when(dated, found).when(token.rlike(EPOCH), _iso_of(F.timestamp_seconds(seconds))).when(token.rlike(EXCEL), _iso_of(serial))
    return found


def is_numeric(token: Column) -> Column:
    """Whether a token is a day, a month and a year in an open order."""
    return token.rlike(NUMERIC)


def first_field(token: Column) -> Column:
    return _int(token, NUMERIC, 1)


def second_field(token: Column) -> Column:
    return _int(token, NUMERIC, 3)


def ordered(token: Column, order: Column) -> Column:
    """ISO text of a numeric token, its fields read as order (DMY or MDY) says; null without an order."""
    def read(t: Column) -> Column:
        first, second = first_field(t), second_field(t)
        month, day = F.when(order == "DMY", second).otherwise(first), F.when(order == "DMY", first).otherwise(second)
        parts = [full_year(_int(t, NUMERIC, 4)), month, day, *(_int(t, NUMERIC, 5 + k) for k in range(3))]
        fields = F.struct(*[p.alias(n) for p, n in zip(parts, ("y", "m", "d", "hh", "mm", "ss"), strict=True)])
        return F.when(order.isNotNull() & is_numeric(t), _iso_fields(fields))

    return F.element_at(F.transform(F.array(token), read), 1)
