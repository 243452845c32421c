"""Column functions over names, placeholders and codes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmask.model import PERMISSIVE, STRICT

#: Titles that do not tell persons apart, longer forms before their beginnings.
TITLES = ("sig.ra", "sig.", "sig", "signora", "signor", "dott.ssa", "dott.", "dottore", "dottoressa", "avv.", "avvocato", "ing.", "ingegner", "arch.", "geom.", "rag.", "prof.ssa", "prof.", "on.", "spett.le", "spett.")
#: Months.
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
#: Fixed values of the tax code: what a character counts at odd places (digits, then letters), and its shape.
CF_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
CF_SHAPE = r"[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]"
_TITLE_RUN = "^(?:(?:" + "|".join(t.replace(".", r"\.") for t in TITLES) + r")(?: |\z))+"


def clean_filename(name: Column) -> Column:
    """The name without directories, of either separator."""
    return F.regexp_extract(name, r"([^/\\]*)$", 1)


def masked_filename(name: Column) -> Column:
    """`x.ext` becomes `x-mascherato.txt`."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-mascherato.txt"))


def restored_filename(name: Column) -> Column:
    """`x-mascherato.ext` becomes `x-ripristinato.txt`."""
    return F.concat(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"-mascherato$", ""), F.lit("-ripristinato.txt"))


def placeholder(category: Column, index: Column) -> Column:
    return F.concat(F.lit("["), category, F.lit("_"), index.cast("string"), F.lit("]"))


def placeholder_index(tag: Column) -> Column:
    """The number of a placeholder; null if it is none."""
    return F.regexp_extract(tag, r"^\[[A-Z]+_([0-9]+)\]\z", 1).try_cast("long")


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({STRICT})"), 1)


def altered(text: Column) -> Column:
    """Fragments that look like a placeholder and are none, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({PERMISSIVE})"), 1), lambda x: ~x.rlike(rf"^{STRICT}\z"))


def is_blank(text: Column) -> Column:
    """Empty or white space only (of any alphabet)."""
    return text.rlike(r"(?U)^\s*\z")


def excerpt(text: Column, size: int = 140) -> Column:
    """White space collapsed; up to `size` characters, then an ellipsis; null for blank texts."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(flat == "", None).when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size), F.lit("…")))


@F.pandas_udf(T.StringType())
def _folded(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility form and case folding, which Spark does not have."""
    for series in values:
        yield series.str.normalize("NFKC").str.casefold()


def normalised_name(value: Column, ascii_only: bool = False) -> Column:
    """Key for comparing names: folded, white space collapsed, leading titles dropped as often as they come.

    With `ascii_only` (the caller knows the values) the fold is `lower`, and no Python runs.
    """
    folded = F.lower(value) if ascii_only else _folded(value)
    flat = F.regexp_replace(F.regexp_replace(folded, r"(?U)\s+", " "), "^ +| +$", "")
    return F.regexp_replace(F.regexp_replace(flat, _TITLE_RUN, ""), "^ +| +$", "")


def name_tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, r"[\s,]+"), lambda t: t != "")


def tokens_equivalent(a: Column, b: Column) -> Column:
    """Whether two token arrays may name the same: equal as multisets, or paired in order of `a` with the first free
    token of `b` that is equal or of which one is the other's initial."""

    def pairs(x: Column, y: Column) -> Column:
        bare = lambda t: F.regexp_replace(t, r"\.+$", "")
        left, right = bare(x), bare(y)
        initial = lambda s, t: (F.length(s) == 1) & (F.length(t) > 1) & t.startswith(s)
        return (x == y) | initial(left, right) | initial(right, left)

    def take(free: Column, token: Column) -> Column:
        # `free` holds (place, token); a null array means that some token found no partner.
        fitting = F.filter(free, lambda c: pairs(token, c["t"]))
        rest = F.filter(free, lambda c: c["p"] != fitting[0]["p"])
        return F.when(free.isNull() | (F.size(fitting) == 0), None).otherwise(rest)

    numbered = F.transform(b, lambda t, i: F.struct(i.alias("p"), t.alias("t")))
    greedy = F.aggregate(a, numbered, take).isNotNull()
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & ((F.array_sort(a) == F.array_sort(b)) | greedy)


def _value(char: Column) -> Column:
    """0-9 for digits, 10-35 for capital letters."""
    return F.ascii(char) - F.when(F.ascii(char) < 65, 48).otherwise(55)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def tax_code_valid(value: Column) -> Column:
    """Italian personal tax code: shape with its replacement letters, and the check letter."""
    code = F.upper(F.trim(value))
    odd = F.array(*map(F.lit, CF_ODD))
    even = lambda c: F.when(F.ascii(c) < 65, F.ascii(c) - 48).otherwise(F.ascii(c) - 65)
    parts = F.transform(_chars(F.substring(code, 1, 15)), lambda c, i: F.when(i % 2 == 0, F.element_at(odd, _value(c) + 1)).otherwise(even(c)))
    total = F.aggregate(parts, F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(F.when(code.rlike(rf"^{CF_SHAPE}\z"), F.char(total % 26 + 65) == F.substring(code, 16, 1)).otherwise(False), F.lit(False))


def vat_number_valid(value: Column) -> Column:
    """Italian VAT number: eleven digits, with or without IT, and the check digit."""
    digits = F.regexp_replace(F.upper(F.trim(value)), "^IT", "")
    return F.coalesce(F.when(digits.rlike(r"^[0-9]{11}\z"), F.call_function("luhn_check", digits)).otherwise(False), F.lit(False))


def iban_valid(value: Column) -> Column:
    """Shape, and remainder 1 modulo 97 with the first four characters moved to the end."""
    code = F.upper(F.regexp_replace(value, r"(?U)\s+", ""))
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    step = lambda acc, c: F.when(F.ascii(c) < 65, acc * 10 + _value(c)).otherwise(acc * 100 + _value(c)) % 97
    return F.coalesce(F.when(code.rlike(r"^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}\z"), F.aggregate(_chars(moved), F.lit(0), step) == 1).otherwise(False), F.lit(False))


def date_exists(value: Column) -> Column:
    """Day, month and year (with / - . or the month's name) or ISO, of a day that there was."""
    text = F.lower(F.trim(value))
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    numeric, iso, named = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\z", r"^(\d{4})-(\d{2})-(\d{2})\z", r"^(\d{1,2})\s+([a-z]+)\s+(\d{4})\z"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(named, 2)).cast("string")
    joined = lambda y, m, d: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    day = F.when(text.rlike(numeric), joined(part(numeric, 3), part(numeric, 2), part(numeric, 1))).when(text.rlike(iso), text).when(text.rlike(named), joined(part(named, 3), month, part(named, 1)))
    return F.coalesce(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))


def phone_plausible(value: Column) -> Column:
    """Nine to eleven digits behind the country prefix."""
    digits = F.regexp_replace(F.regexp_replace(value, r"^(?:\+39|0039)", ""), r"[^0-9]", "")
    return F.coalesce(F.length(digits).between(9, 11), F.lit(False))


#: Words that must stand near a VAT number or a telephone number, and characters looked at before it.
CONTEXT = {"PIVA": ("p. iva", "p.iva", "partita iva", "p.i.", "vat"), "TELEFONO": ("tel", "telefono", "cell", "cellulare", "fax", "mobile")}
CONTEXT_WINDOW = 30


def has_context(text: Column, start: Column, value: Column, category: Column) -> Column:
    """Whether a number is announced: a keyword as a whole word before it, or a prefix that says it itself."""
    before = F.lower(text.substr(F.greatest(start - CONTEXT_WINDOW, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_WINDOW))))
    near = lambda kind: before.rlike("(?U)(?<!\\w)(?:" + "|".join(w.replace(".", r"\.") for w in CONTEXT[kind]) + r")(?!\w)")
    own = F.when(category == "PIVA", value.startswith("IT")).when(category == "TELEFONO", value.startswith("+39") | value.rlike(r"^0039(?:\D?\d){9,10}\z"))
    return F.when(category == "PIVA", near("PIVA") | own).when(category == "TELEFONO", near("TELEFONO") | own).otherwise(True)
