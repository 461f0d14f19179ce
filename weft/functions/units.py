"""Unit strings and quantities in text.

A unit string ("kgs", "fl oz", "Kilogramm", "m/s2") is segmented by dynamic
programming over three tries: prefixes, roots and exponents.  Every
decomposition has a cost; the prior of the field (how likely a dimension is in
the column at hand) decides between decompositions that spell the same string,
such as ``m`` (metre, or the prefix milli) and ``gr`` (gram, or grain).

Defined results: null, blank or unit-less text gives no quantity; an unknown
unit gives a quantity with dimension ``None`` only if ``keep_unknown`` is set.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from functools import lru_cache

# SI and English prefixes.  name -> (factor, is a symbol)
PREFIXES = {
    "k": (1e3, True), "c": (1e-2, True), "m": (1e-3, True), "d": (1e-1, True), "µ": (1e-6, True), "u": (1e-6, True), "h": (1e2, True),
    "kilo": (1e3, False), "centi": (1e-2, False), "milli": (1e-3, False), "deci": (1e-1, False), "micro": (1e-6, False), "hecto": (1e2, False), "mega": (1e6, False),
}
# Roots.  name -> (canonical unit, dimension, factor to the base unit, is a symbol, takes prefixes, penalty)
ROOTS = {
    "g": ("g", "mass", 1e-3, True, True, 0.0), "gr": ("g", "mass", 1e-3, False, False, 0.2), "gram": ("g", "mass", 1e-3, False, True, 0.0), "gramm": ("g", "mass", 1e-3, False, True, 0.0),
    "gramme": ("g", "mass", 1e-3, False, True, 0.0), "kilo": ("kg", "mass", 1.0, False, False, 0.4), "grain": ("grain", "mass", 6.479891e-5, False, False, 0.0), "t": ("t", "mass", 1e3, True, False, 1.0), "tonne": ("t", "mass", 1e3, False, False, 0.0),
    "lb": ("lb", "mass", 0.45359237, False, False, 0.0), "#": ("lb", "mass", 0.45359237, False, False, 0.2), "pound": ("lb", "mass", 0.45359237, False, False, 0.0), "oz": ("oz", "mass", 0.028349523125, False, False, 0.0), "ounce": ("oz", "mass", 0.028349523125, False, False, 0.0),
    "floz": ("fl oz", "volume", 0.0295735295625, False, False, 0.0), "flounce": ("fl oz", "volume", 0.0295735295625, False, False, 0.0), "fluidounce": ("fl oz", "volume", 0.0295735295625, False, False, 0.0),
    "l": ("l", "volume", 1.0, True, True, 0.0), "liter": ("l", "volume", 1.0, False, True, 0.0), "litre": ("l", "volume", 1.0, False, True, 0.0), "qt": ("qt", "volume", 0.946352946, False, False, 0.0), "quart": ("qt", "volume", 0.946352946, False, False, 0.0),
    "gal": ("gal", "volume", 3.785411784, False, False, 0.0), "gallon": ("gal", "volume", 3.785411784, False, False, 0.0), "pint": ("pt", "volume", 0.473176473, False, False, 0.0),
    "m": ("m", "length", 1.0, True, True, 0.0), "meter": ("m", "length", 1.0, False, True, 0.0), "metre": ("m", "length", 1.0, False, True, 0.0), "in": ("in", "length", 0.0254, False, False, 0.0), "inch": ("in", "length", 0.0254, False, False, 0.0), "inche": ("in", "length", 0.0254, False, False, 0.3),
    '"': ("in", "length", 0.0254, False, False, 0.0), "zoll": ("in", "length", 0.0254, False, False, 0.0), "ft": ("ft", "length", 0.3048, False, False, 0.0), "foot": ("ft", "length", 0.3048, False, False, 0.0), "feet": ("ft", "length", 0.3048, False, False, 0.0), "'": ("ft", "length", 0.3048, False, False, 0.0), "yd": ("yd", "length", 0.9144, False, False, 0.0),
    "w": ("w", "power", 1.0, True, True, 0.0), "watt": ("w", "power", 1.0, False, True, 0.0), "v": ("v", "voltage", 1.0, True, True, 0.0), "volt": ("v", "voltage", 1.0, False, True, 0.0),
    "s": ("s", "time", 1 / 3600, True, True, 0.5), "sec": ("s", "time", 1 / 3600, False, False, 0.0), "second": ("s", "time", 1 / 3600, False, True, 0.0), "min": ("min", "time", 1 / 60, False, False, 0.0), "minute": ("min", "time", 1 / 60, False, False, 0.0), "h": ("h", "time", 1.0, True, False, 0.0), "hr": ("h", "time", 1.0, False, False, 0.0), "hour": ("h", "time", 1.0, False, False, 0.0),
    "dpi": ("dpi", "resolution", 1.0, False, False, 0.0), "kdpi": ("dpi", "resolution", 1e3, False, False, 0.0),
}
# Exponents, and words before a unit that raise it.
EXPONENTS = {"²": 2, "³": 3, "^2": 2, "^3": 3, "2": 2, "3": 3}
RAISERS = {"sq": 2, "square": 2, "cu": 3, "cubic": 3}
#: Prior weight of a dimension where a field has none of its own.
FLAT = 0.1


def trie(words: Iterable[str]) -> dict:
    """Nested dicts; the key "" marks a word's end."""
    top: dict = {}
    for w in words:
        at = top
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = w
    return top


def matches(at: dict, text: str, i: int) -> list[str]:
    """Words of the trie that begin at text[i]."""
    out = []
    while True:
        if "" in at:
            out.append(at[""])
        if i >= len(text) or text[i] not in at:
            return out
        at, i = at[text[i]], i + 1


_PREFIX, _ROOT, _EXP, _RAISE = trie(PREFIXES), trie(ROOTS), trie(EXPONENTS), trie(RAISERS)


def _freeze(prior: Mapping[str, float] | None) -> tuple:
    return tuple(sorted((prior or {}).items()))


@lru_cache(maxsize=200_000)
def _segment(text: str, prior: tuple) -> tuple | None:
    weight = dict(prior)
    best: list[list[tuple]] = [[] for _ in range(len(text) + 1)]
    best[0] = [(0.0, (), 1.0, (), 1)]
    for i in range(len(text)):
        for cost, dims, factor, units, sign in sorted(best[i], key=lambda x: x[0])[:6]:
            if text[i] in "/·*.":
                best[i + 1].append((cost + 0.2, dims, factor, units, -1 if text[i] == "/" else sign))
                if text[i] != ".":
                    continue
            for raised in ["", *matches(_RAISE, text, i)]:
                j = i + len(raised)
                for p in ["", *matches(_PREFIX, text, j)]:
                    for r in matches(_ROOT, text, j + len(p)):
                        unit, dim, f, symbol, takes, penalty = ROOTS[r]
                        if p and not takes:
                            continue
                        k = j + len(p) + len(r)
                        c = 1 + penalty + (0.3 + 1.5 * (PREFIXES[p][1] != symbol) if p else 0) - math.log(weight.get(dim, FLAT))
                        ends = [(k, c, 1)]
                        if not symbol and text[k : k + 1] == "s":
                            ends.append((k + 1, c, 1))
                        elif symbol and text[k : k + 1] == "s":
                            ends.append((k + 1, c + 0.4, 1))
                        for k2, c2, _ in list(ends):
                            ends += [(k2 + len(e), c2 + 0.3, EXPONENTS[e]) for e in matches(_EXP, text, k2)]
                        name = {"kg": "kg"}.get(("k" if PREFIXES.get(p, (1,))[0] == 1e3 else "") + unit, unit) if dim == "mass" else unit
                        for k2, c2, power in ends:
                            power *= RAISERS.get(raised, 1)
                            scale = (f * (PREFIXES[p][0] if p else 1.0)) ** (power * sign)
                            best[k2].append((cost + c2, (*dims, (dim, power * sign)), factor * scale, (*units, name), 1))
    done = [x for x in best[len(text)] if x[1]]
    return min(done, key=lambda x: (x[0], x[3])) if done else None


def segment(unit: str, prior: Mapping[str, float] | None = None) -> tuple[str, str, float] | None:
    """(canonical unit, dimension, factor to the base unit) of a unit string, or None.

    Base units: kg, l, m, w, v, h, dpi.  Compound units have dimensions joined
    by spaces ("length^2").
    """
    return _known(unit or "", _freeze(prior) if prior else ())


@lru_cache(maxsize=200_000)
def _known(unit: str, prior: tuple) -> tuple[str, str, float] | None:
    text = re.sub(r"[\s_-]+", "", unit.lower()).rstrip(".").replace("″", '"').replace("′", "'").replace("”", '"').replace("’", "'").replace("fl.", "fl")
    text = re.sub(r"(?<=[a-z])\.(?=[a-z])", "", text)
    if not text or len(text) > 40:
        return None
    found = _segment(text, prior)
    if found is None:
        return None
    _, dims, factor, units, _ = found
    return " ".join(units), " ".join(d if p == 1 else f"{d}^{p}" for d, p in dims), factor


NUMBER = r"(?:\d{1,3}(?:[ ,.]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d+)?|[.,]\d+)"
_QUANTITY = re.compile(rf"({NUMBER})\s*-?\s*((?:fl\.?\s*oz|fluid ounces?|[a-zµ]+(?:[²³]|\^[23])?(?:/[a-z]+[23²³]?)?|[\"'#″′”’])\.?s?\.?)?", re.I)


_NUMERIC = re.compile(r"[-+]?(\d[\d.,]*|[.,]\d+)")
_GROUPED = re.compile(r"[-+]?[1-9]\d{0,2}(,\d{3})+")


def number(text: str | None, grouped: bool = True) -> float | None:
    """A number written with a point or a comma; None if there is none.

    "1,299" is 1299 if grouped, "0,417" is 0.417 always.
    """
    s = "".join((text or "").split())
    if s.isdigit() and s.isascii():
        return float(s)
    if not _NUMERIC.fullmatch(s):
        return None
    if "," in s and "." in s:
        s = s.replace("," if s.rfind(".") > s.rfind(",") else ".", "").replace(",", ".")
    elif grouped and "," in s and _GROUPED.fullmatch(s):
        s = s.replace(",", "")
    else:
        s = s.replace(",", ".") if s.count(",") == 1 else s.replace(",", "")
    if s.count(".") > 1:
        s = s.replace(".", "")
    try:
        return float(s)
    except ValueError:
        return None


def quantities(text: str | None, prior: Mapping[str, float] | None = None, grouped: bool = True) -> list[tuple[float, str, str | None, float | None]]:
    """(value, unit, dimension, value in base units) of every number in the text, in order.

    A number without a known unit has unit "" and dimension None.
    """
    out = []
    for m in _QUANTITY.finditer(text or ""):
        v = number(m[1], grouped)
        if v is None:
            continue
        u = segment(m[2], prior) if m[2] else None
        out.append((v, u[0], u[1], v * u[2]) if u else (v, "", None, None))
    return out


def weight(text: str | None, prior: Mapping[str, float] | None = None) -> tuple[float, str] | None:
    """(number of the unit, unit) of a weight in text; "lb oz" for pounds and ounces together, "" for a bare number.

    For "lb oz" the number is in pounds.  None if nothing readable is there.
    """
    found = quantities(text, prior or {"mass": 0.95}, grouped=False)
    known = [q for q in found if q[2] == "mass"]
    if len(known) >= 2 and known[0][1] == "lb" and known[1][1] == "oz":
        return known[0][0] + known[1][0] / 16, "lb oz"
    if known:
        return known[0][0], known[0][1]
    if len(found) == 1 and re.fullmatch(r"\s*[-+]?[\d.,]+\s*", text or ""):
        return found[0][0], ""
    return None
