"""Column expressions for delimited text cells; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing cell.
MISSING = ("", "NA", "missing")

BLANKS = " \t"
CELL = r',([ \t]*"[^"]*(?:""[^"]*)*"[ \t]*(?=,|$)|[^,]*)'
WHOLE = r"^[+-]?[0-9]+\z"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def split_cells(line: Column) -> Column:
    """The cells of a line as an array; commas inside a quoted cell do not split it."""
    return F.regexp_extract_all(F.concat(F.lit(","), F.coalesce(line, F.lit(""))), F.lit(CELL), F.lit(1))


def clean(cell: Column) -> Column:
    """The cell without outer blanks and without its quotes."""
    bare = F.btrim(cell, F.lit(BLANKS))
    quoted = (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    inner = F.replace(F.substring(bare, 2, F.length(bare) - 2), F.lit('""'), F.lit('"'))
    return F.when(quoted, F.btrim(inner, F.lit(BLANKS))).otherwise(bare)


def column_name(cell: Column) -> Column:
    """A header cell as a name: clean, lower case, inner blanks as underscores."""
    return F.regexp_replace(F.lower(clean(cell)), r"[ \t]+", "_")


def is_missing(cell: Column) -> Column:
    return cell.isNull() | cell.isin(*MISSING)


def tag(cell: Column) -> Column:
    """The alternative of the tagged union that a clean cell falls into."""
    return (
        F.when(is_missing(cell), F.lit("missing"))
        .when(cell.rlike(WHOLE), F.lit("long"))
        .when(cell.rlike(NUMBER), F.lit("double"))
        .when(cell.rlike(DAY), F.lit("date"))
        .otherwise(F.lit("string"))
    )


def _written_out(cell: Column) -> Column:
    """Any number as a plain decimal; powers of ten beyond 40 keep their exponent.  Exact, whatever its length.

    Null where the exponent has more than 18 digits.  It is bound to a lambda, so that its parts are worked out once.
    """
    part = lambda i: F.regexp_extract(cell, r"^([+-]?)([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$", i)
    exponent = F.when(part(4) == "", F.lit(0).cast("bigint")).when(F.length(part(4)) <= 18, part(4).try_cast("bigint"))
    digits = F.ltrim(F.concat(part(2), part(3)), F.lit("0"))
    whole = F.struct(F.when(part(1) == "-", F.lit("-")).otherwise(F.lit("")).alias("sign"), digits.alias("all"), F.rtrim(digits, F.lit("0")).alias("digits"), (exponent - F.length(part(3))).alias("power"))

    def plain(p: Column) -> Column:
        digits, power = p["digits"], p["power"] + F.length(p["all"]) - F.length(p["digits"])
        n = F.length(digits)
        zeros = lambda k: F.repeat(F.lit("0"), k.cast("int"))
        text = (
            F.when(F.abs(power) > 40, F.concat(digits, F.lit("e"), power.cast("string")))
            .when(power >= 0, F.concat(digits, zeros(power)))
            .when(n > -power, F.concat(F.substring(digits, F.lit(1), (n + power).cast("int")), F.lit("."), F.substring(digits, (n + power + 1).cast("int"), n)))
            .otherwise(F.concat(F.lit("0."), zeros(-power - n), digits))
        )
        return F.when(digits == "", F.lit("0")).otherwise(F.concat(p["sign"], text))

    return F.get(F.transform(F.array(whole), plain), 0)


def canonical(cell: Column) -> Column:
    """The canonical form of a clean cell: numbers as plain decimals, other cells as they are, missing ones null."""
    short = F.regexp_replace(cell, r"^(?:\+|(-))?0*", "$1")
    short = F.when(cell.contains("."), F.regexp_replace(short, r"\.?0*$", "")).otherwise(short)
    usual = F.regexp_replace(F.regexp_replace(short, r"^-?$", "0"), r"^(-?)\.", "$10.")
    return (
        F.when(is_missing(cell), F.lit(None).cast("string"))
        .when(~cell.rlike(NUMBER), cell)
        .when((F.length(cell) <= 40) & ~cell.rlike("[eE]"), usual)
        .otherwise(F.coalesce(_written_out(cell), cell))
    )


def comparable(cell: Column) -> Column:
    """A form in which two clean cells are equal if they are the same text, number or both missing."""
    return F.when(is_missing(cell), F.lit("m")).otherwise(F.concat(F.when(cell.rlike(NUMBER), F.lit("n")).otherwise(F.lit("t")), canonical(cell)))
