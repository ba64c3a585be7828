"""Text normalisers: functions from a column to a column, chained by name.

All are built-in expressions but nfc, an Arrow UDF that only texts with combining or composed characters reach.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Normalizer = Callable[[Column], Column]

# Encoding repairs, in the order in which they are applied. Some shadow later ones; that is their meaning.
MOJIBAKE = (
    ("â€™", "'"), ("â€\"", "–"), ("â€\"", "—"), ("â€œ", "\""), ("â€", "\""), ("â€¦", "…"),
    ("Ã©", "é"), ("Ã¨", "è"), ("Ã ", "à"), ("Ã¢", "â"), ("Ã®", "î"), ("Ã´", "ô"), ("Ã»", "û"), ("Ã§", "ç"),
)

# The wider table of encoding repairs, in order.
ENCODING = (
    ("Ã¡", "á"), ("Ã ", "à"), ("Ã¢", "â"), ("Ã£", "ã"), ("Ã¤", "ä"), ("Ã¥", "å"), ("Ã¦", "æ"), ("Ã§", "ç"), ("Ã¨", "è"), ("Ã©", "é"), ("Ãª", "ê"), ("Ã«", "ë"),
    ("Ã¬", "ì"), ("Ã\u00ad", "í"), ("Ã®", "î"), ("Ã¯", "ï"), ("Ã°", "ð"), ("Ã±", "ñ"), ("Ã²", "ò"), ("Ã³", "ó"), ("Ã´", "ô"), ("Ãµ", "õ"), ("Ã¶", "ö"), ("Ã¸", "ø"),
    ("Ã¹", "ù"), ("Ãº", "ú"), ("Ã»", "û"), ("Ã¼", "ü"), ("Ã½", "ý"), ("Ã¿", "ÿ"), ("Ã€", "À"), ("Ã", "Á"), ("Ã‚", "Â"), ("Ãƒ", "Ã"), ("Ã„", "Ä"), ("Ã…", "Å"),
    ("â€™", "'"), ("â€˜", "'"), ("â€œ", "\""), ("â€", "\""), ("â€\"", "–"), ("â€¦", "…"), ("Â ", " "), ("Â", ""),
)

# Characters without width, special spaces, Arabic marks and letter forms.
ZERO_WIDTH = "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0xFFFE, 0xFFFF]))
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
TASHKEEL = "".join(map(chr, [*range(0x64B, 0x660), 0x670]))
TATWEEL = "ـ"
ALEF = ("أإآٱٲٳ", "ا")
YEH = ("ىۍېےۓ", "ي")
HEH = ("ةۀۂھ", "ه")
WAW = ("ؤۄۆۇۈۉۊۋ", "و")
QAF_KAF = (("ڨ", "ق"), ("ڧ", "ف"), ("کگڪ", "ك"))
PUNCTUATION = ("،؛؟٪٫٬", ",;?%.,")
DIGITS = ("٠١٢٣٤٥٦٧٨٩", "0123456789")
PREFIXES = ("ال", "وال", "بال", "كال", "فال", "لل")
SUFFIXES = ("ها", "هم", "هن", "ك", "كم", "كن", "نا", "ي", "ه", "ون", "ين", "ات", "ة", "ا")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _replaced(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The rules one after another; texts without any of their characters skip all of them."""
    first = "".join(sorted({a[0] for a, _ in rules}))
    return F.when(text.rlike(f"[{first}]"), reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), rules, text)).otherwise(text)


def fix_mojibake(text: Column) -> Column:
    return _replaced(text, MOJIBAKE)


def fix_encoding(text: Column) -> Column:
    return _replaced(text, ENCODING)


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC. Below U+0300 nothing changes under NFC, so other texts stay in the JVM's column (the UDF sees null there)."""
    needs = text.rlike("[^\\x{0000}-\\x{02FF}]")
    return F.when(needs, _nfc(F.when(needs, text))).otherwise(text)


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\r\t]]", "")


def unicode_chain(text: Column, encoding: bool = True, compose: bool = True, zero_width: bool = True, control: bool = True) -> Column:
    steps = ((encoding, fix_mojibake), (compose, nfc), (zero_width, strip_zero_width), (control, strip_control))
    return reduce(lambda t, s: s[1](t) if s[0] else t, steps, text)


def arabic(text: Column, alef: bool = True, tashkeel: bool = True, tatweel: bool = True, yeh: bool = False, heh: bool = False, waw: bool = False, qaf_kaf: bool = False, punctuation: bool = False, digits: bool = False) -> Column:
    """Letter forms folded and marks removed in one translate: characters without a counterpart go."""
    pairs = [p for on, ps in ((alef, (ALEF,)), (yeh, (YEH,)), (heh, (HEH,)), (waw, (WAW,)), (qaf_kaf, QAF_KAF)) if on for p in ps]
    source, target = "".join(a for a, _ in pairs), "".join(b * len(a) for a, b in pairs)
    for on, (a, b) in ((punctuation, PUNCTUATION), (digits, DIGITS)):
        source, target = (source + a, target + b) if on else (source, target)
    gone = (TASHKEEL if tashkeel else "") + (TATWEEL if tatweel else "")
    return F.translate(text, source + gone, target) if source or gone else text


def arabic_ratio(text: Column) -> Column:
    """Arabic letters among characters that are not white space; 0 where there are none."""
    solid = F.length(F.regexp_replace(text, r"(?U)\s+", ""))
    return F.when(solid > 0, F.regexp_count(text, F.lit(ARABIC_CLASS)) / solid).otherwise(0.0)


ARABIC_CLASS = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"


def contains_arabic(text: Column) -> Column:
    return text.rlike(ARABIC_CLASS)


def light_stem(text: Column) -> Column:
    """Words of at least four characters lose the longest known prefix, then suffix, while two characters stay."""

    def stem(word: Column) -> Column:
        cut = word
        for affixes, rest in ((PREFIXES, lambda w, a: F.substring(w, len(a) + 1, 1 << 30)), (SUFFIXES, lambda w, a: F.left(w, F.length(w) - len(a)))):
            before, fits = cut, (F.startswith if affixes is PREFIXES else F.endswith)
            chosen = before
            for a in sorted(sorted(affixes, key=len), key=len):
                chosen = F.when(fits(before, F.lit(a)) & (F.length(before) >= len(a) + 2), rest(before, a)).otherwise(chosen)
            cut = chosen
        return F.when(F.length(word) < 4, word).otherwise(cut)

    return F.when(strip(text) == "", "").otherwise(F.array_join(F.transform(F.split(strip(text), r"(?U)\s+"), stem), " "))


def whitespace(text: Column, special: bool = True, line_endings: bool = True, newlines: bool = False, most_newlines: int = 2, paragraphs: bool = True, spaces: bool = True, trim: bool = True) -> Column:
    if special:
        text = F.translate(text, SPACES, " " * len(SPACES))
    if line_endings:
        text = F.regexp_replace(text, "\r\n?", "\n")
    if newlines:
        text = F.regexp_replace(text, f"\n{{{most_newlines + 1},}}", "\n" * most_newlines) if paragraphs else F.regexp_replace(text, "\n+", "\n")
    if spaces:
        text = F.regexp_replace(F.regexp_replace(text, r"(?U)[\s&&[^\n]]+", " "), " *\n *", "\n")
    return strip(text) if trim else text


def lines(text: Column, strip_lines: bool = True, drop_empty: bool = False, collapse_empty: bool = True, most_empty: int = 1) -> Column:
    parts = F.split(text, "\n")
    if strip_lines:
        parts = F.transform(parts, strip)
    if drop_empty:
        return F.array_join(F.filter(parts, lambda x: x != ""), "\n")
    joined = F.array_join(parts, "\n")
    if not collapse_empty:
        return joined
    # A run of blank lines at the start or end is one line break shorter than one between lines.
    blank = r"[^\S\n]*" if not strip_lines else ""
    inner = F.regexp_replace(joined, rf"(?U)(\n(?:{blank}\n){{{most_empty}}})(?:{blank}\n)+", "$1")
    return F.regexp_replace(inner, rf"(?U)\A((?:{blank}\n){{{most_empty}}})(?:{blank}\n)+", "$1")


def clean(text: Column, fix_quotes: bool = True) -> Column:
    """NULs dropped, quotes and dashes made plain, runs of blanks collapsed, ends stripped."""
    source, target = "‚„‹›«»–—―‐‑‒", "'\"''\"\"------"
    if fix_quotes:
        source, target = source + "“”‘’", target + "\"\"''"
    return strip(F.regexp_replace(F.translate(text, source + "\x00", target), r"[ \t]+", " "))


@dataclass(frozen=True)
class Chain:
    """Named normalisers in order, each on or off; immutable: each change gives another chain."""

    steps: tuple[tuple[str, Normalizer], ...] = ()
    disabled: frozenset[str] = field(default_factory=frozenset)

    def __call__(self, text: Column) -> Column:
        return reduce(lambda t, s: t if s[0] in self.disabled else s[1](t), self.steps, text)

    def __len__(self) -> int:
        return len(self.steps)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def add(self, name: str, step: Normalizer) -> Chain:
        return replace(self, steps=(*self.steps, (name, step)))

    def insert(self, index: int, name: str, step: Normalizer) -> Chain:
        return replace(self, steps=(*self.steps[:index], (name, step), *self.steps[index:]))

    def remove(self, name: str) -> Chain:
        return replace(self, steps=tuple(s for s in self.steps if s[0] != name))

    def get(self, name: str) -> Normalizer | None:
        return dict(self.steps).get(name)

    def enable(self, name: str) -> Chain:
        return replace(self, disabled=self.disabled - {name})

    def disable(self, name: str) -> Chain:
        return replace(self, disabled=self.disabled | {name})


DEFAULT = Chain((("unicode", unicode_chain), ("arabic", arabic), ("whitespace", whitespace)))
#: Built-in expressions only: the default without NFC.
NATIVE = Chain((("unicode", lambda t: unicode_chain(t, compose=False)), ("arabic", arabic), ("whitespace", whitespace)))
MINIMAL = Chain((("unicode", lambda t: unicode_chain(t, encoding=False)), ("whitespace", whitespace)))
AGGRESSIVE = Chain(
    (
        ("cleaner", clean),
        ("unicode", unicode_chain),
        ("arabic", lambda t: arabic(t, yeh=True, heh=True, punctuation=True, digits=True)),
        ("whitespace", lambda t: whitespace(t, newlines=True)),
    )
)
