"""Text as column expressions: cleaning, normalising, splitting, shapes.

All functions take and return columns and stay inside generated code.  White
space is blank, tab, line feed, carriage return, form feed and vertical tab.
Null in gives null out unless the function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]+"
# Signs that part a value's pattern.
SEPARATORS = "-_. @+()/:;,|#$%&=?"
# Members of a JSON cell that speak for it.
JSON_KEYS = ("name", "title", "value", "description")


def squeeze(c: Column) -> Column:
    """White space once, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean_text(c: Column) -> Column:
    """Lower case, squeezed; null is "".  A JSON object becomes its telling members, in their own case."""
    s = squeeze(c)
    json = F.regexp_replace(s, "'", '"')
    of = F.from_json(json, "map<string,string>", {"mode": "PERMISSIVE"})
    telling = F.trim(F.array_join(F.filter(F.array(*[F.when(F.map_contains_key(of, F.lit(k)), F.coalesce(of[k], F.lit("None"))) for k in JSON_KEYS]), lambda x: x.isNotNull()), " "))
    is_json = s.startswith("{") & s.endswith("}") & F.try_parse_json(json).isNotNull()
    return F.coalesce(F.when(is_json, telling).otherwise(F.lower(s)), F.lit(""))


def extract_number(c: Column) -> Column:
    """The number in a text: currency signs and commas dropped, "a-b" as the mean of its parts, else the first number; null if none."""
    s = F.regexp_replace(squeeze(c), "[$,%€£¥]", "")
    parts = F.filter(F.transform(F.split(s, "-"), lambda x: F.trim(x)), lambda x: x != "")
    nums = F.transform(parts, lambda x: F.when(x.rlike(r"^[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?$"), x).try_cast("double"))
    whole = s.contains("-") & ~s.startswith("-") & (F.size(nums) > 0) & F.forall(nums, lambda x: x.isNotNull())
    mean = F.aggregate(nums, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(nums) > 0, F.size(nums))
    first = F.regexp_extract(s, r"([-+]?[0-9]*[.]?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1)
    return F.when(whole, mean).otherwise(F.when(first != "", first).try_cast("double"))


def clean_tokens(c: Column) -> Column:
    """a-z, 0-9 and single blanks; "-_./" part words; null is ""."""
    s = F.regexp_replace(F.lower(c), r"[-_./]", " ")
    return F.coalesce(squeeze(F.regexp_replace(s, r"[^a-z0-9 \t\n\r\f\x0B]", "")), F.lit(""))


def term(c: Column) -> Column:
    """Upper case, squeezed: how a value counts as a term."""
    return squeeze(F.upper(c))


def name_tokens(c: Column) -> Column:
    """Lower-case parts of a name between "_-. "."""
    return F.filter(F.split(F.lower(c), r"[_\-. ]+"), lambda x: x != "")


def stem(c: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def name_prefix(c: Column) -> Column:
    """First part of a file's stem."""
    return F.element_at(name_tokens(stem(c)), 1)


def name_suffix(c: Column) -> Column:
    """Last part of a file's stem; null if it has one part only."""
    t = name_tokens(stem(c))
    return F.when(F.size(t) > 1, F.element_at(t, -1))


def sorted_words(c: Column) -> Column:
    """Distinct words of a column name in order, as one text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[_-]", " "), " +"), lambda x: x != ""))), " ")


def plain_words(c: Column) -> Column:
    """Lower case, separators as blanks, punctuation dropped."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), r"[_\-.]", " "), r"[^\p{L}\p{Nd} ]", ""))


def value_shape(c: Column) -> Column:
    """Every sign by its class: D digit, L letter, a separator itself, S other."""
    s = F.regexp_replace(F.regexp_replace(c, r"\p{Nd}", "\u0001"), r"\p{L}", "L")
    return F.translate(F.regexp_replace(s, r"[^\x01L\-_. @+()/:;,|#$%&=?]", "S"), "\u0001", "D")


def run_pattern(c: Column) -> Column:
    """Classes of signs with run lengths: "customer_id" is L8SL2 (L letter, D digit, S one of "_-.", O other)."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Nd}", "\u0001"), r"\p{L}", "L"), r"[_\-.]", "\u0002"), r"[^\x01\x02L]", "O")
    s = F.translate(s, "\u0001\u0002", "DS")
    runs = F.regexp_extract_all(s, F.lit("(L+|D+|S+|O+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.substring(r, 1, 1), F.when(F.length(r) > 1, F.length(r).cast("string")).otherwise(F.lit("")))), "")


def column_name(name: str, position: int = 0) -> str:
    """A column name fit for a table: lower case, words joined by one underscore; "unnamed_column" if nothing is left."""
    import re

    s = re.sub(r"[^\w\s]", "_", name.lower().strip())
    return re.sub(r"_+", "_", re.sub(r"\s+", "_", s)).strip("_") or "unnamed_column"


def byte_size(c: Column) -> Column:
    """Bytes of a size such as "10k", "2M" or "1g"; plain numbers as they are; null if unreadable."""
    m = F.regexp_extract(F.lower(F.trim(c)), r"^([0-9]+)([kmg]?)b?$", 1).try_cast("long")
    u = F.regexp_extract(F.lower(F.trim(c)), r"^([0-9]+)([kmg]?)b?$", 2)
    return m * F.when(u == "k", 1 << 10).when(u == "m", 1 << 20).when(u == "g", 1 << 30).otherwise(1)


def pair_key(a: Column, b: Column) -> Column:
    """One key for a pair in either order."""
    return F.concat_ws("\u0001", F.least(a, b), F.greatest(a, b))
