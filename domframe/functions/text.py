"""Text functions as Column expressions, one for each scalar of the extraction pipeline."""
from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the text rules: Unicode white space and the zero-width space (fixed values).
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def collapse_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, WS + "+", " ")


def remove_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, WS, "")


def normalize_node_text(c: Column) -> Column:
    return F.trim(collapse_whitespace(c))


def is_blank(c: Column) -> Column:
    return c.rlike("^" + WS + "*$")


def tokens_of(c: Column) -> Column:
    """Space-separated parts, without empty ones."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def basic_tokenize(c: Column) -> Column:
    """Lower-cased tokens: marks stand alone, double quotes go, semicolons, colons and line breaks part words."""
    c = F.regexp_replace(F.lower(c), r"([.,()!?$'])", " $1 ")
    c = F.regexp_replace(F.regexp_replace(c, '"', ""), r"<br />|[;:]", " ")
    return tokens_of(collapse_whitespace(c))


def bert_tokenize(c: Column, split_symbols: bool = False) -> Column:
    """Cleaned, lower-cased tokens without accents, split at punctuation (and symbols on request); ideographs stand alone."""
    c = F.regexp_replace(c, r"[\x00\x{fffd}]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[\t\n\r]", " "), r"[\p{Cc}\p{Cf}]", "")
    c = F.regexp_replace(c, r"([\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2ceaf}\x{2f800}-\x{2fa1f}])", " $1 ")
    c = strip_accents(F.lower(c))
    c = F.regexp_replace(c, r"([!-/:-@\[-`{-~\p{P}" + (r"\p{S}" if split_symbols else "") + "])", " $1 ")
    return tokens_of(F.regexp_replace(c, r"[ \x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{2028}\x{2029}]+", " "))


@lru_cache(1)
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Characters (but Hangul syllables) whose canonical decomposition without marks is one other character, or none; those;
    and the decompositions of several characters."""
    one, base, several = [], [], {}
    for point in [*range(0xC0, 0xAC00), *range(0xF900, 0x10000), *range(0x11000, 0x12000), *range(0x1D100, 0x1D200), *range(0x2F800, 0x2FA20)]:
        c = chr(point)
        if unicodedata.decomposition(c)[:1] in ("", "<"):
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(plain) == 1:
            one.append(c)
            base.append(plain)
        else:
            several[c] = plain
    return "".join(one), "".join(base), several


def _jamo(syllable: Column) -> Column:
    """The conjoining letters of a Hangul syllable, by the arithmetic of Unicode."""
    s = F.ascii(syllable) - 0xAC00
    part = lambda first, n, i: F.element_at(F.array(*[F.lit(chr(first + k)) for k in range(n)]), (i + 1).cast("int"))
    tail = F.when(s % 28 == 0, "").otherwise(part(0x11A7, 28, s % 28))
    return F.concat(part(0x1100, 19, F.floor(s / 588)), part(0x1161, 21, F.floor(s % 588 / 28)), tail)


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without its non-spacing marks. Stays inside generated code; texts without letters beyond
    U+00BF are as they were, and rare scripts take a longer way.

    Spacing marks in other than canonical order keep their order."""
    one, base, several = _decomposed()
    plain = F.regexp_replace(F.translate(c, one, base), r"\p{Mn}", "")
    rare = "".join(several)
    spelled = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    letter = lambda x: F.when(x.between("\uac00", "\ud7a3"), _jamo(x)).otherwise(F.coalesce(spelled[x], x))
    spelt = F.array_join(F.transform(F.split(plain, ""), letter), "")
    return F.when(~c.rlike("[^\x00-\xbf]"), c).when(c.rlike(f"[\uac00-\ud7a3{rare}]"), spelt).otherwise(plain)


def humanize(c: Column) -> Column:
    """Camel case and dashes to spaced lower-case words, the first letter upper."""
    c = F.regexp_replace(F.regexp_replace(c, r"([A-Z\d]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2")
    c = F.regexp_replace(F.lower(F.regexp_replace(c, "-", "_")), "_id$", "")
    c = F.regexp_replace(c, "_", " ")
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def camel_case(c: Column) -> Column:
    """Snake case to camel case: every part after the first begins with a capital."""
    parts = F.split(c, "_")
    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), F.initcap), ""))


def attribute_text(attrs: Column, names: list[str]) -> Column:
    """Non-empty values of the named attributes, joined by a space."""
    return F.array_join(F.filter(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: attrs[n]), lambda v: v.isNotNull() & (v != "")), " ")


def font_family(c: Column) -> Column:
    """First non-empty family, without quotes, lower-cased; else ''."""
    names = F.transform(F.split(c, ","), lambda x: F.lower(F.trim(F.regexp_replace(x, "[\"']", ""))))
    return F.coalesce(F.get(F.filter(names, lambda x: x != ""), F.lit(0)), F.lit(""))


def strip_prefix(c: Column) -> Column:
    return F.regexp_replace(c, "^-webkit-", "")


def slug(c: Column, most: int | None = None) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(out, 1, most), "-+$", "") if most else out


def xpath_tag(c: Column) -> Column:
    """Tag of one XPath element such as /div[2]."""
    return F.regexp_extract(c, r"^/(.*?)(\[(\d+)\])?$", 1)


def natural_key(c: Column) -> Column:
    """Sort key in which runs of digits compare as numbers, of any length: the number of digits, then the digits."""
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    digits = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 10, "0"), digits(x))).otherwise(x)), "")


def duration(seconds: Column) -> Column:
    """[Nd ]HH:MM:SS."""
    s = seconds.cast("bigint")
    days = F.floor(s / 86400)
    clock = F.format_string("%02d:%02d:%02d", F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("d "), clock)).otherwise(clock)


def replace_extension(c: Column, to: str) -> Column:
    return F.regexp_replace(c, r"\.[^./]*$", to)


def add_suffix(c: Column, suffix: str) -> Column:
    """Puts suffix before the extension."""
    return F.concat(F.regexp_replace(c, r"\.[^./]*$", ""), F.lit(suffix), F.regexp_extract(c, r"(\.[^./]*)$", 1))


def escape_path(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")


def int_or(c: Column, default: int) -> Column:
    """The number that c begins with; the default without one, or if it is none of 64 bits."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(default))


def percentage(p: Column) -> Column:
    return F.format_string("%.2f%%", p * 100)
