"""What a value looks like and what type a column has, as column expressions and aggregates."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings of truth values.
BOOLEANS = ("true", "false", "yes", "no", "0", "1", "t", "f", "y", "n")
# Words in codes made mostly of digits.
ID_WORDS = ("id", "no", "num", "ref", "code")
# Date formats of the type annotator, and the least lengths of their parts where it asks for some.
DATE_FORMATS = [
    ("EEEEE, MM/dd/yyyy", None),
    ("yyyy-MM-dd'T'HH:mm:ss", None),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS", None),
    ("yyyy-MM-dd", (2, 1, 1)),
    ("MM/dd/yyyy HH:mm:ss", None),
    ("MM/dd/yyyy", (1, 1, 2)),
    ("dd/MM/yyyy", (1, 1, 2)),
    ("MM/dd/yy", (1, 1, 2)),
    ("dd/MM/yy", (1, 1, 2)),
    ("dd-MMM-yy", (2, 3, 2)),
    ("MMM-dd", None),
    ("dd-MMM", None),
]
#: What a letter of a format stands for in a pattern; months and weekdays by their English names.
FIELDS = {"y": r"([0-9]{%d,9})", "M": r"([0-9]{%d,9})", "d": r"([0-9]{%d,9})", "H": "([01]?[0-9]|2[0-3])", "m": "([0-5]?[0-9])", "s": "([0-5]?[0-9])", "S": "([0-9]{1,3})", "MMM": "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)", "E": "(mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"}


def in_format(c: Column, form: str, least: tuple[int, ...] | None) -> Column:
    """Whether a text is an existing day written in the format; a day without a year is one of 1970."""
    pieces = [m.group(0) for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", form)]
    pattern, at, k = "", {}, 0
    for x in pieces:
        if not x[0].isalpha():
            pattern += re.escape(x.strip("'"))
            continue
        n = least[k] if least and k < len(least) else 1
        k += 1
        at[x[0]] = k
        field = FIELDS["MMM"] if x == "MMM" else FIELDS[x[0]]
        pattern += field % n if "%d" in field else field
    pattern = f"(?i)^{pattern}$"
    get = lambda letter, other: F.regexp_extract(c, pattern, at[letter]) if letter in at else F.lit(other)
    month = F.lower(F.substring(get("M", "1"), 1, 3))
    if "MMM" in form:
        month = F.coalesce(*[F.when(month == m, F.lit(str(i + 1))) for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))])
    y, m, d = (F.nullif(x, F.lit("")).try_cast("int") for x in (get("y", "1970"), month, get("d", "1")))
    leap = ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))).cast("int")
    days = F.when(m == 2, 28 + leap).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce(c.rlike(pattern) & m.between(1, 12) & (d >= 1) & (d <= days), F.lit(False))


def is_phone(c: Column) -> Column:
    """7 to 15 digits once "-() " are gone."""
    return F.regexp_replace(c, "[-() ]", "").rlike("^[0-9]{7,15}$")


def is_code(c: Column) -> Column:
    """5 to 20 letters, digits, "-" or "_", with both letters and digits, or nearly all digits with a word such as "id"."""
    fits = (F.length(c) >= 5) & (F.length(c) <= 20) & c.rlike(r"^[\p{L}\p{Nd}_-]+$")
    digits = F.length(F.regexp_replace(c, r"[^\p{Nd}]", ""))
    word = F.lower(c).rlike("|".join(ID_WORDS))
    return fits & (((digits > 0.7 * F.length(c)) & word) | (c.rlike(r"\p{L}") & c.rlike(r"\p{Nd}")))


def could_be_date(parts: Column) -> Column:
    """Three numbers that make a date in one of three orders."""
    n = [F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3)]

    def valid(month: Column, day: Column, year: Column) -> Column:
        ok = month.between(1, 12) & (day >= 1) & (year > 0)
        leap = ((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))).cast("int")
        return ok & (day <= F.when(month == 2, 28 + leap).when(month.isin(4, 6, 9, 11), 30).otherwise(31))

    orders = [(0, 1, 2), (1, 0, 2), (2, 1, 0)]
    any_ = F.lit(False)
    for m, d, y in orders:
        any_ = any_ | F.coalesce(valid(n[m], n[d], n[y]), F.lit(False))
    return (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike("^[0-9]{1,9}$")) & any_


def date_like(c: Column) -> Column:
    """Three date parts between "-", "/", "." or blanks, or an ISO time stamp; not a phone number or code."""
    # Most values are ruled out by one pattern before they are split.
    looks = c.rlike(r"^[0-9]{1,9}([-/. ])[0-9]{1,9}\1[0-9]{1,9}$")
    shaped = F.lit(False)
    for sep in ("-", "/", ".", " "):
        shaped = shaped | (c.contains(sep) & could_be_date(F.split(c, "[.]" if sep == "." else sep)))
    stamp = c.contains("T") & c.contains(":") & c.contains("-")
    return F.when(looks | stamp, (shaped | stamp) & ~is_phone(c) & ~is_code(c)).otherwise(False)


def is_integer(c: Column) -> Column:
    """A whole number, but not one of 1000 to 9999, which could be a year."""
    n = F.when(c.rlike(r"^[+-]?[0-9]+$"), c).try_cast("decimal(38,0)")
    return F.coalesce(n.isNotNull() & ~n.between(1000, 9999), F.lit(False))


def is_float(c: Column) -> Column:
    return c.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")


def inferred_type(c: Column, simple: bool = False) -> Column:
    """Aggregate: the type of a column of texts (boolean, integer, float, datetime, string; unknown without rows).

    In order: all truth values; over 80 % phone numbers is string; over 90 %
    integers; over 90 % numbers; any date if over 70 % are neither phone
    numbers nor codes.  simple leaves phone numbers and codes out of account.
    """
    v = F.trim(c)
    v = F.when(v != "", v)
    n = F.count(v)
    share = lambda t: F.avg(F.when(v.isNotNull(), t.cast("int")))
    dates = F.max((date_like(v) if not simple else date_like(v) | is_stamp(v)).cast("int"))
    plain = F.lit(1.0) if simple else share(~is_phone(v) & ~is_code(v))
    phones = F.lit(0.0) if simple else share(is_phone(v))
    ints = share(is_integer(v)) if not simple else share(v.rlike(r"^[+-]?[0-9]+$"))
    return (
        F.when(F.count(c) == 0, "unknown").when(n == 0, "string").when(share(F.lower(v).isin(*BOOLEANS)) == 1, "boolean").when(phones > 0.8, "string")
        .when(ints > 0.9, "integer").when(share(is_float(v)) > 0.9, "float").when((dates == 1) & (plain > 0.7), "datetime").otherwise("string")
    )


def is_stamp(c: Column) -> Column:
    return c.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T].*)?$")


def is_geo(c: Column) -> Column:
    """"(number, number)"."""
    return c.rlike(r"^\(\s*[-+]?[0-9]+([.][0-9]+)?\s*,\s*[-+]?[0-9]+([.][0-9]+)?\s*\)$")


def annotated_type(c: Column) -> Column:
    """Type of one value: integer, long, decimal, geo, date or text; "$" before and "%" after numbers and commas in them do not count."""
    v = F.regexp_replace(F.trim(c), r"^\$|%$", "")
    whole = F.regexp_replace(v, ",", "")
    grouped = v.rlike(r"^[-+]?[0-9]{1,3}(,[0-9]{3})*$") | v.rlike(r"^[-+]?[0-9]+$")
    n = F.when(grouped, whole).try_cast("decimal(38,0)")
    dec = (v.rlike(r"^[-+]?[0-9]*[.][0-9]+$") | v.rlike(r"^[-+]?[0-9]{1,3}(,[0-9]{3})*[.][0-9]+$") | v.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?[eE][-+]?[0-9]+$"))
    # A date has a digit beside a sign, so that most texts are ruled out by one pattern.
    date = v.rlike(r"[0-9][-/]|[-/][0-9]") & functools.reduce(lambda a, b: a | b, [in_format(v, f, least) for f, least in DATE_FORMATS])
    return F.when(n.isNotNull() & n.between(-(2**31), 2**31 - 1), "integer").when(n.isNotNull() & n.between(-(2**63), 2**63 - 1), "long").when(n.isNotNull() | dec, "decimal").when(is_geo(v), "geo").when(date, "date").otherwise("text")


def plain_type(c: Column) -> Column:
    """Type of one value: integer, long, decimal or text."""
    t = F.when(F.trim(c).rlike(r"^[-+]?[0-9]+$"), F.trim(c)).try_cast("decimal(38,0)")
    return F.when(t.between(-(2**31), 2**31 - 1), "integer").when(t.between(-(2**63), 2**63 - 1), "long").when(is_float(F.trim(c)), "decimal").otherwise("text")


# Prefixes of the identifiers of known systems.
ID_FORMATS = [("CUST-", "CUST-###"), ("PROD-", "PROD-A###"), ("ORD-", "ORD-L####"), ("USER-", "USER-####"), ("TXN-", "TXN-M####"), ("ACC-", "ACC-#####"), ("ITEM-", "ITEM-####"), ("SALE-", "SALE-#####")]


def id_format(c: Column) -> Column:
    """Name of an identifier's format; "Empty" for null and blank, "Unknown" otherwise."""
    out = F.when(c.isNull() | (F.trim(c) == ""), "Empty")
    for prefix, name in ID_FORMATS:
        out = out.when(c.startswith(prefix), name)
    return out.when(c.startswith("B0") & (F.length(c) == 10), "ASIN (B0########)").otherwise("Unknown")
