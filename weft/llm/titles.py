"""Normalised tokens of a product title: what is stated of the variant, and the words that name it.

A title is split into
  acc    kind of accessory sold ("case", "part", "lid", "cover"), or ""
  dims   stated numbers as (dimension, value in base units)
  names  stated colours, letter sizes and flavours
  words  all other words, model codes among them (code is the first of these)
Nothing here knows the articles, brands or advertisements of a catalogue: what
a word is worth is learned from the listings (``weights``), and the lexicon
holds public facts of language only; its learned part comes from ``learn``.
Null and empty titles give empty parts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field

from weft.functions.units import number, segment

# Basic colour terms in English, German, French and Spanish, and their usual abbreviations.
COLOURS = {
    "black": ["black", "blk", "schwarz", "noir", "negro"], "white": ["white", "wht", "weiss", "blanc", "blanco"], "red": ["red", "rd", "rot", "rouge", "rojo"], "green": ["green", "grn", "grun", "vert", "verde"],
    "blue": ["blue", "blu", "blau", "bleu", "azul"], "yellow": ["yellow", "yel", "gelb", "jaune", "amarillo"], "brown": ["brown", "brn", "braun", "brun", "marron"], "grey": ["grey", "gray", "gry", "grau", "gris"],
    "orange": ["orange", "orn", "naranja"], "purple": ["purple", "violet", "lila", "morado"], "pink": ["pink", "pnk", "rosa"],
}
# Letter sizes.
SIZES = {"s": ["small", "sm", "s"], "m": ["medium", "med", "m"], "l": ["large", "lg", "l"], "xl": ["xl", "xlarge", "extralarge"], "xxl": ["xxl", "xxlarge"]}
# Shoe sizes, European to US.
SHOES = {"40": 7, "41": 8, "42": 9, "43": 10, "44": 11}
# Words that count pieces, and how many a word stands for.
COUNTS = {"pack": 1, "packs": 1, "pk": 1, "ct": 1, "count": 1, "unit": 1, "units": 1, "er": 1, "piece": 1, "pieces": 1, "pcs": 1, "players": 1, "player": 1, "plyrs": 1, "pages": 1, "page": 1, "pgs": 1, "pp": 1, "sheets": 2, "sheet": 2}
# Function words, and words of sizes and counts that say nothing alone.
STOP = frozenset("a an by of the and with for to up size sz max approx us eu uk er x pack pk ct unit units".split())
#: Units too short to be one after what looks like a model code.
SHORT = frozenset(("t", "m", "l", "s", "h", "dg", "us", "eu", "uk"))
#: Names of units that may be misspelt.
WRITTEN = ("litre", "liter", "quart", "ounce", "pound", "gram", "metre", "meter", "watt", "volt", "hour", "inch")
#: One litre of goods counts as one kilogram, as "oz" may be either.
AXIS = {"volume": "mass"}


@dataclass(frozen=True)
class Lexicon:
    """compounds: pairs of words of which the second is hardly found without the first; stock: words after "for" that only advertise; flavours: words that stand before "flavour"."""

    compounds: frozenset = field(default_factory=frozenset)
    stock: frozenset = field(default_factory=frozenset)
    flavours: frozenset = field(default_factory=frozenset)


def plain(text: str | None) -> str:
    """Lower case without entities, broken UTF-8, accents and repeated blanks."""
    s = text or ""
    if "&" in s:
        s = html.unescape(s)
    if s.isascii():
        return s.lower()
    if "Ã" in s or "ã©" in s or "Â" in s:
        try:
            s = s.replace("ã©", "Ã©").encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            s = s.replace("ã©", "e").replace("Ã©", "e")
    s = unicodedata.normalize("NFKD", s.casefold())
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    return s.replace("’", "'").replace("″", '"')


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    if n == m:
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if n > m else a[i:] == b[i + 1 :]


def shorter(w: str) -> list[str]:
    """A word, and what is left of it without one of its letters."""
    return [w, *[w[:i] + w[i + 1 :] for i in range(len(w))]]


class Near:
    """The words of a list that are near() a word, found by what is left of both without one letter, which such words have in common."""

    def __init__(self, words: list[str]):
        self.words = words
        self.least, self.most = min(map(len, words), default=0) - 1, max(map(len, words), default=-2) + 1
        self.left: dict[str, list[int]] = {}
        for i, v in enumerate(words):
            for d in set(shorter(v)):
                self.left.setdefault(d, []).append(i)

    def find(self, w: str) -> list[int]:
        """Places in the list, in order."""
        if not self.least <= len(w) <= self.most:
            return []
        left = self.left
        some = [i for d in shorter(w) if d in left for i in left[d]]
        return [i for i in sorted(set(some)) if near(w, self.words[i])] if some else some


TOKEN = re.compile(r"[a-z]{2,4}-?[0-9]{3,5}(?![a-z0-9]|[.,][0-9])|[a-z]+(?:'[a-z]+)*|[0-9]+(?:[.,][0-9]+)*|[\"'#%]")
CODE = re.compile(r"[a-z]{2,4}-?[0-9]{3,5}")


class Parser:
    """Splits titles; built once per Python worker.  What a word or a unit means is looked up once."""

    def __init__(self, lex: Lexicon | None = None):
        self.lex = lex or Lexicon()
        self.name = {w: "c:" + k for k, ws in COLOURS.items() for w in ws}
        self.size = {w: "s:" + k for k, ws in SIZES.items() for w in ws}
        self.kinds: dict[str, str] = {}
        self.units: dict[str, tuple | None] = {}
        self.long = Near([w for w in COLOURS if len(w) >= 5])
        self.counts = Near([w for w in COUNTS if len(w) >= 5])
        self.written = Near([w for v in WRITTEN for w in (v, v + "s")])
        self.flavours = sorted(self.lex.flavours)
        self.numbers: dict[str, float] = {}
        self.sized: dict[tuple, tuple] = {}
        self.looks: dict[str, int] = {"": 1, "x": 5}

    def kind(self, w: str) -> str:
        """What a word states: "c:" a colour, "f:" a flavour (also one cut short or misspelt), or ""."""
        hit = self.kinds.get(w)
        if hit is None:
            hit = self.name.get(w, "")
            if not hit and len(w) >= 4:
                for v in self.flavours:
                    if w == v or v.startswith(w) or (len(v) >= 6 and near(w, v)):
                        hit = "f:" + v
                        break
                else:
                    if len(w) >= 5:
                        c = self.long.find(w)
                        hit = self.name[self.long.words[c[0]]] if len(c) == 1 else ""
            if len(self.kinds) < 500_000:
                self.kinds[w] = hit
        return hit

    def unit(self, w: str) -> tuple | None:
        """("n", factor) of a word that counts, (dimension, factor) of a unit, or None."""
        hit = self.units.get(w, self)
        if hit is self:
            hit = ("n", COUNTS[w]) if w in COUNTS else None
            if hit is None and not self.kind(w) and w[0] not in "0123456789":
                u = segment(w)
                hit = (AXIS.get(u[1], u[1]), u[2]) if u and "^" not in u[1] and " " not in u[1] else None
            if hit is None and len(w) >= 4 and not self.kind(w):
                c = self.counts.find(w)
                hit = ("n", COUNTS[self.counts.words[c[0]]]) if c else None
                if hit is None and (c := self.written.find(w)):
                    u = segment(WRITTEN[c[0] // 2])
                    hit = (AXIS.get(u[1], u[1]), u[2])
            if len(self.units) < 500_000:
                self.units[w] = hit
        return hit

    def look(self, t: str) -> int:
        """What has to be done with a token: 0 a word, 1 nothing, 2 a number, 3 a code, 4 "for" or "compatible", 5 perhaps a size, 6 a colour or flavour."""
        if t[0] in "0123456789":
            k = 2
        elif t in "\"'#%":
            k = 1
        elif t[-1] in "0123456789":
            k = 3
        elif t in ("for", "compatible"):
            k = 4
        elif t in self.size or t in ("xx", "extra"):
            k = 5
        else:
            k = 6 if self.kind(t) else 0
        if len(self.looks) < 500_000:
            self.looks[t] = k
        return k

    def parse(self, title: str | None) -> tuple[str, str, list[str], list[tuple], list[str]]:
        """(acc, code, names, dims, words) of a title."""
        toks = TOKEN.findall(plain(title))
        toks.append("")
        words, dims, names = [], [], []
        code = acc = ""
        skip = 0
        ks = [*map(self.looks.get, toks)]
        if None in ks:
            ks = [self.look(t) if k is None else k for t, k in zip(toks, ks)]
        for i, k in enumerate(ks):
            if skip:
                skip -= 1
                continue
            if k == 1:
                continue
            t = toks[i]
            if k == 0:
                words.append(t)
            elif k == 2:
                skip, code = self._number(toks, i, words, dims, code)
            elif k == 3:
                t = t.replace("-", "")
                code = code or t
                words.append(t)
            elif k == 6:
                (words if (t, toks[i + 1]) in self.lex.compounds else names).append(t if (t, toks[i + 1]) in self.lex.compounds else self.kind(t))
            elif k == 4:
                nxt = toks[i + 1]
                if t == "compatible":
                    if nxt != "with":
                        continue
                    skip = 1
                elif nxt in self.lex.stock:
                    continue
                acc = (words[-1].rstrip("s") if words else "") or "with"
            elif k == 5:
                nxt = toks[i + 1]
                if t in ("x", "xx", "extra"):
                    if nxt in ("large", "lg", "l"):
                        names.append("s:xxl" if t == "xx" else "s:xl")
                        skip = 1
                    else:
                        words.append(t)
                elif (t, nxt) in self.lex.compounds or toks[i - 1] == "'":
                    words.append(t)
                else:
                    names.append(self.size[t])
        return acc, code, sorted(set(names)) if len(names) > 1 else names, sorted({self.size_of(d) for d in dims if d[1]}) if dims else dims, [w for w in dict.fromkeys(words) if w not in STOP]

    def size_of(self, d: tuple[str, float]) -> tuple[str, float]:
        """A dimension and its value to five digits."""
        hit = self.sized.get(d)
        if hit is None:
            hit = (d[0], float(f"{d[1]:.5g}"))
            if len(self.sized) < 500_000:
                self.sized[d] = hit
        return hit

    def value(self, t: str) -> float:
        """The number that a token is, thousands not grouped; 0 if it is none."""
        hit = self.numbers.get(t)
        if hit is None:
            hit = number(t, grouped=False) or 0
            if len(self.numbers) < 500_000:
                self.numbers[t] = hit
        return hit

    def _number(self, toks: list[str], i: int, words: list[str], dims: list[tuple], code: str) -> tuple[int, str]:
        """Takes the number at i into dims, or into words as part of a code; (tokens to skip, code)."""
        t, nxt, prev = toks[i], toks[i + 1], toks[i - 1] if i else ""
        last = words[-1] if words else ""
        if prev in ("size", "sz", "us", "eu", "uk"):
            dims.append(("shoe", float(SHOES.get(t, number(t) or 0))))
            return 0, code
        if prev == "of" and i > 1 and toks[i - 2] in ("pack", "set"):
            dims.append(("n", float(number(t) or 0)))
            del words[-2:]
            return 0, code
        v = self.value(t)
        if nxt == "fl" and toks[i + 2][:2] in ("oz", "ou"):
            dims.append(("mass", v * 0.0295735295625))
            return 2, code
        if nxt == "k" and toks[i + 2] == "dpi":
            dims.append(("resolution", v * 1000))
            return 2, code
        if nxt == "%":
            return 1, code
        coded = prev == last and t.isdigit() and not (len(t) == 4 and t[:2] in ("19", "20"))
        if coded and len(t) == 4 and len(last) == 3 and nxt in SHORT and last not in STOP:
            words[-1] = last + t
            return 0, code or words[-1]
        if nxt and nxt not in ("us", "eu", "uk") and not (nxt == "pack" and toks[i + 2] == "of"):
            u = self.unit(nxt)
            if u:
                dims.append((u[0], v * u[1]))
                return 1 + (nxt == "er" and toks[i + 2] == "pack"), code
        if prev == "x":
            dims.append(("n", float(number(t) or 0)))
        elif coded and 3 <= len(t) <= 5 and 2 <= len(last) <= 4:
            words[-1] = last + t
            return 0, code or words[-1]
        return 0, code
