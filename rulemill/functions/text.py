"""Text and number coercions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACES_SQL = "".join(f"\\u{ord(c):04x}" for c in SPACES)
# Spellings of whole numbers and of any number (single underscores may group digits).
INTEGER_PATTERN = r"^[+-]?\d+(_\d+)*$"
_DIGITS = r"\d+(_\d+)*"
_NUMBER = rf"[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})([eE][+-]?{_DIGITS})?"
NUMBER_PATTERN = rf"^{_NUMBER}$"
NUMBER_OR_INFINITY = rf"^[{SPACES_SQL}]*({_NUMBER}|[+-]?(?i:inf(inity)?))[{SPACES_SQL}]*$"
# Words that stand for an empty cell.
EMPTY_WORDS = ("", "nan", "none", "null")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def strip_cell(c: Column) -> Column:
    """strip of a column, quicker: a text between two visible ASCII characters, as most are, is not searched."""
    def visible(end: Column) -> Column:
        return (end >= "!") & (end <= "~")

    ends = visible(F.substring(c, 1, 1)) & visible(F.substring(c, -1, 1))
    return F.when(ends, c).otherwise(strip(c))


def is_blank(c: Column) -> Column:
    """Null or nothing but white space of any sort."""
    return c.isNull() | (F.ltrim(c, F.lit(SPACES)) == "")


def is_blank_spaces(c: Column) -> Column:
    """Null or nothing but plain spaces, as SQL TRIM sees it."""
    return c.isNull() | (F.trim(c) == "")


def blank_sql(name: str) -> str:
    """is_blank as SQL text."""
    return f"{name} IS NULL OR trim(LEADING '{SPACES_SQL}' FROM {name}) = ''"


def blank_spaces_sql(name: str) -> str:
    """is_blank_spaces as SQL text."""
    return f"{name} IS NULL OR trim({name}) = ''"


def non_empty(c: Column) -> Column:
    """The text, or null when it is empty."""
    return F.nullif(c, F.lit(""))


def number_text(*cols: Column) -> Column:
    """The first text that spells a number, spaces around it removed; not-a-number counts as none."""
    return strip(F.coalesce(*[F.when(c.rlike(NUMBER_OR_INFINITY), c) for c in cols]))


def parse_number(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit("")).try_cast("double")


def to_number(c: Column) -> Column:
    """Text to double; anything that is not wholly a number gives null."""
    return parse_number(number_text(c))


def first_number(*cols: Column) -> Column:
    return parse_number(number_text(*cols))


def is_empty_word(text: Column) -> Column:
    """Whether a stripped text stands for an empty cell."""
    return F.lower(text).isin(*EMPTY_WORDS)


def normalize_optional_text(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(is_empty_word(text), F.lit("")).otherwise(text)


def fixed_decimals(c: Column, digits: int) -> Column:
    """Plain decimal text with a fixed number of digits, rounded on the exact binary value."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def format_value_sql(name: str, is_double: bool) -> str:
    """SQL for display text: doubles with at most three decimals, null as the word blank."""
    shown = rf"regexp_replace(replace(format_number({name}, 3), ',', ''), '\\.?0+$', '')"
    return f"coalesce({shown if is_double else f'CAST({name} AS STRING)'}, 'blank')"


def format_value(name: str, is_double: bool) -> Column:
    return F.expr(format_value_sql(f"`{name}`", is_double))


def percent(c: Column) -> Column:
    return F.round(F.coalesce(c.try_cast("double"), F.lit(0.0)) * 100, 2)


def double_text(c: Column) -> Column:
    """Shortest text of a double: fixed notation from 1e-4 up to 1e16, otherwise an exponent of two digits or more."""
    plain = c.cast("string")
    # the long form stands in a function of its own, so that the code of the usual one stays small enough to be compiled
    return F.when(plain.contains("E"), bound(c, _exponent_text)).otherwise(plain)


def _exponent_text(c: Column) -> Column:
    plain = c.cast("string")
    size = F.abs(c)
    unscaled = F.regexp_replace(c.cast("decimal(38,20)").cast("string"), r"0+$", "")
    fixed = F.when(unscaled.endswith("."), F.concat(unscaled, F.lit("0"))).otherwise(unscaled)
    mantissa = F.regexp_replace(F.split_part(plain, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(plain, F.lit("E"), F.lit(2)).try_cast("int")
    exponent = F.concat(
        F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")),
    )
    return F.when((size >= 1e-4) & (size < 1e16), fixed).otherwise(F.concat(mantissa, F.lit("e"), exponent))
