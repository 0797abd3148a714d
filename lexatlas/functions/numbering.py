"""Article and division numbers: parsing, normal forms and sort keys, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_number(number: Column) -> Column:
    """Leading digits as an integer, 0 without (2.1.1: 2; 17-H: 17; Único: 0)."""
    return F.coalesce(F.regexp_extract(number, r"^(\d+)", 1).try_cast("int"), F.lit(0))


def parse_number(number: Column) -> Column:
    """(base, suffix in upper case, ordinal in lower case); what doesn't fit has its digits alone."""
    pattern = r"^(?i)(\d+)(o|a)?\.?(?:[\s-]+(.+))?$"
    fits = F.regexp_like(number, F.lit(pattern))
    part = lambda k: F.nullif(F.regexp_extract(number, pattern, k), F.lit(""))
    digits = F.regexp_replace(number, r"\D", "").try_cast("int")
    return F.struct(F.when(fits, part(1).try_cast("int")).otherwise(digits).alias("base"), F.when(fits, F.upper(part(3))).alias("suffix"), F.when(fits, F.lower(part(2))).alias("ordinal"))


def last_number(number: Column) -> Column:
    """The last part of a dotted number (2.1.49: 49); null if it isn't one."""
    return F.element_at(F.split(number, r"[.]"), -1).try_cast("int")


def load_key(number: Column) -> Column:
    """Key under which the loader matches numbers: upper case, hyphens as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.upper(F.replace(number, F.lit("-"), F.lit(" "))), r"\s+", " "))


#: Latin suffixes of article numbers, as they are written.
SUFFIXES = ("Bis", "Ter", "Quáter", "Quintus", "Quinquies", "Sexies")


#: Those of them that may follow a letter or a hyphen, or come before a hyphen and a number.
JOINED_SUFFIXES = "Bis|Ter|Quáter|Quinquies|Sexies"


def canonical(number: Column) -> Column:
    """The validator's form: single spaces, capitalised suffixes, `14-A`, `4o-A Bis`, `29 Bis`, `137 Bis 1`.

    All rules but the first need a space or a suffix, so that most numbers (14, 14-A, 2.1.1) are done after one look.
    """
    spaced = F.trim(F.regexp_replace(number, r"\s+", " "))
    out = spaced
    for s in SUFFIXES:
        out = F.regexp_replace(out, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){s}(?![\p{{L}}\p{{N}}_])", s)
    out = F.regexp_replace(out, rf"(\d+[oa]?) ([A-Z])( (?:{JOINED_SUFFIXES})|$)", "$1-$2$3")
    out = F.regexp_replace(out, rf"-(?={JOINED_SUFFIXES})", " ")
    out = F.regexp_replace(out, rf"({JOINED_SUFFIXES})-(\d)", "$1 $2")
    return F.when(F.regexp_like(spaced, F.lit(rf"(?iu) |{'|'.join(SUFFIXES)}")), out).otherwise(spaced)


def from_outline(name: Column) -> Column:
    """Number of an outline entry: `Artículo_4o_A` is 4o-A, `_29_Bis` 29 Bis, `_32_B_Ter` 32-B Ter."""
    parts = F.filter(F.split(F.regexp_replace(name, r"^Art[ií]culo", ""), "_"), lambda p: p != "")
    joined = F.transform(parts, lambda p, i: F.when(i == 0, p).when(p.isin(*SUFFIXES), F.concat(F.lit(" "), p)).otherwise(F.concat(F.lit("-"), p)))
    return F.array_join(joined, "")


def assemble(base: Column, ordinal: Column, letter: Column, suffix: Column, suffix_number: Column) -> Column:
    """A number from its parts, null where absent: 14, o, A, bis, 2 gives `14o-A Bis 2`."""
    blank = F.lit("")
    return F.concat(base, F.coalesce(F.lower(ordinal), blank), F.coalesce(F.concat(F.lit("-"), F.upper(letter)), blank), F.coalesce(F.concat(F.lit(" "), F.initcap(suffix)), blank), F.coalesce(F.concat(F.lit(" "), suffix_number), blank))


def dotted_key(number: Column) -> Column:
    """Sort key of dotted numbers: an array of integers, parts that aren't numbers as 0; null stays null."""
    return F.transform(F.split(number, r"[.]"), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def article_key(number: Column) -> Column:
    """Sort key (leading integer or 999999, number)."""
    return F.struct(F.coalesce(F.regexp_extract(number, r"^(\d+)", 1).try_cast("int"), F.lit(999999)).alias("first"), number.alias("number"))


def paragraph_class(text: Column) -> Column:
    """(kind, identifier) by how a paragraph begins: `IV.` fraccion, `a)` inciso, `3.` numeral, else texto."""
    found = [("fraccion", r"^([IVXLC]+)\."), ("inciso", r"^([a-z]\))"), ("numeral", r"^(\d+\.)")]
    kind, identifier = F.lit("texto"), F.lit(None).cast("string")
    for name, pattern in reversed(found):
        held = F.regexp_like(text, F.lit(pattern))
        kind = F.when(held, F.lit(name)).otherwise(kind)
        identifier = F.when(held, F.regexp_extract(text, pattern, 1)).otherwise(identifier)
    return F.struct(kind.alias("kind"), identifier.alias("identifier"))


def indent_level(x: Column) -> Column:
    """Level of a paragraph by its left edge."""
    return F.when(x < 95, 0).when(x < 124, 1).when(x < 152, 2).otherwise(3)


def bucket(value: Column, size: int) -> Column:
    """The nearest multiple of size; halves go to the even one."""
    return (F.bround(value / size) * size).cast("int")


#: Spanish month names.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def spanish_date(text: Column) -> Column:
    """`DD-MM-YYYY` or `DD de MES de YYYY` as a date; null if neither, or no such day or month."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, r"(\d{1,2}) de (\p{L}+) de (\d{4})", 2)))
    long_ = F.concat_ws("-", F.regexp_extract(text, r"(\d{1,2}) de (\p{L}+) de (\d{4})", 3), F.lpad(F.nullif(month, F.lit(0)).cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, r"(\d{1,2}) de (\p{L}+) de (\d{4})", 1), 2, "0"))
    short = F.regexp_replace(F.regexp_extract(text, r"(\d{2}-\d{2}-\d{4})", 1), r"(\d{2})-(\d{2})-(\d{4})", "$3-$2-$1")
    return F.coalesce(F.nullif(short, F.lit("")).try_cast("date"), F.when(month > 0, long_.try_cast("date")))


#: Words that may separate law code and number; levels by kind of division.
LEVELS = {"libro": 0, "titulo": 1, "capitulo": 2, "seccion": 3}
SHOWN = {"libro": "Libro", "titulo": "Título", "capitulo": "Capítulo", "seccion": "Sección", "subseccion": "Subsección"}


def level(kind: Column) -> Column:
    out = F.lit(4)
    for k, n in reversed(LEVELS.items()):
        out = F.when(kind == k, n).otherwise(out)
    return out


def shown_kind(kind: Column) -> Column:
    out = kind
    for k, s in SHOWN.items():
        out = F.when(kind == k, s).otherwise(out)
    return out


def place(kind: Column, number: Column) -> Column:
    """`capitulo 3`; null if either is."""
    return F.concat(kind, F.lit(" "), number)


def path_text(kind: Column, number: Column, name: Column) -> Column:
    """`capitulo 3 - Name`, or without the name."""
    return F.concat(kind, F.lit(" "), number, F.coalesce(F.concat(F.lit(" - "), name), F.lit("")))
