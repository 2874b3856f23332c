"""Cell-level expressions. Needs nothing but pyspark: exported scripts carry this file's text."""

from pyspark.sql import functions as F

ROW_ID = "_row_id"
ORDINAL = "__ord"

# The characters Python's str.strip() removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# Month names by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
MONTH_START = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"

CLOCK = r"(?:[T\s]\s*(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)\d*\s*([AaPp][Mm])?(?:Z|\+00:?00)?)?$"
MONTH_WORD = (
    r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    r"(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?)\.?"
)
DIGIT_DATE = r"^(\d{1,4})([-/.])(\d{1,2})\2(\d{1,4})" + CLOCK
DAY_WORD = r"^(\d{1,2})(?:st|nd|rd|th)?[\s\-/.,]*" + MONTH_WORD + r"[\s\-/.,]+(\d{4})" + CLOCK
WORD_DAY = r"^" + MONTH_WORD + r"[\s\-/.]*(\d{1,2})(?:st|nd|rd|th)?[\s\-/.,]+(\d{4})" + CLOCK
YEAR_WORD = r"^(\d{4})[\s\-/.]+" + MONTH_WORD + r"[\s\-/.]+(\d{1,2})" + CLOCK


def named(name):
    """Column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def stripped(cell):
    return F.btrim(cell.cast("string"), F.lit(BLANKS))


def norm(cell):
    return F.lower(stripped(cell))


def number(cell):
    """Text to DOUBLE; NULL where the text is not wholly a number."""
    text = cell.cast("string")
    return F.when(text.rlike(NUMBER), F.btrim(text, F.lit(" \t\n\x0b\x0c\r")).try_cast("double"))


def name_tokens(cell):
    """Identifier-style text split into lower-case words."""
    spaced = F.regexp_replace(cell.cast("string"), "([a-z])([A-Z])", "$1 $2")
    return norm(F.regexp_replace(spaced, r"[_\-./]+", " "))


def date_shape(cell):
    return F.regexp_replace(cell.cast("string"), r"\d", "d")


def looks_like_date(cell):
    """A digit, and either a month in words or two date separators."""
    text = cell.cast("string")
    return text.rlike(r"\d") & (text.rlike(r"(?s)[-/.].*[-/.]") | text.rlike(MONTH_START))


def _moment(parts, dayfirst):
    """TIMESTAMP_NTZ from the pieces of one date: year, month, day or a, b, year; then clock and am/pm."""
    first, second, third, clock, half = (F.get(parts, F.lit(i)) for i in range(5))
    a, b, c = (piece.try_cast("int") for piece in (first, second, third))
    compact = F.regexp_replace(first, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day_leads = (b <= 12) if dayfirst else (a > 12)
    year = F.when(F.length(third) == 4, c).when(
        F.length(third) == 2, c + F.when(c < 70, F.lit(2000)).otherwise(F.lit(1900))
    )
    month_word = ((F.instr(F.lit(MONTHS), F.lower(second)) + 3) / 4).cast("int")
    date = (
        F.when(second.isNull() & first.rlike(r"^\d{4}(\d{4})?$"), F.rpad(compact, 10, "-01"))
        .when(F.length(first) == 4, F.concat_ws("-", first, F.when(F.length(second) == 3, month_word).otherwise(b), c))
        .when(F.length(first) <= 2, F.concat_ws(
            "-", F.lpad(year.cast("string"), 4, "0"), F.when(day_leads, b).otherwise(a), F.when(day_leads, a).otherwise(b)
        ))
    )
    moment = F.concat_ws(" ", date, F.nullif(clock, F.lit(""))).try_cast("timestamp_ntz")
    noon = clock.startswith("12:")
    shift = (
        F.when((F.lower(half) == "pm") & ~noon, F.lit(12)).when((F.lower(half) == "am") & noon, F.lit(-12))
        .otherwise(F.lit(0))
    )
    return moment + F.make_dt_interval(F.lit(0), shift)


def parsed_date(cell, dayfirst=False):
    """Each value read on its own; month first unless `dayfirst`, swapped when the month is impossible.

    The pieces are cut out by one replacement and held as a lambda's argument, so they are found once
    per cell however often the rules below look at them.
    """
    text = stripped(cell)
    cut = lambda *groups: "\x1f".join(f"${g}" for g in groups)
    worded = F.regexp_replace(text, DAY_WORD, cut(3, 2, 1, 4, 5))
    worded = F.regexp_replace(worded, WORD_DAY, cut(3, 1, 2, 4, 5))
    worded = F.regexp_replace(worded, YEAR_WORD, cut(1, 2, 3, 4, 5))
    digits = F.regexp_replace(text, DIGIT_DATE, cut(1, 3, 4, 5, 6))
    pieces = F.split(F.when(text.rlike("[A-Za-z]{3}"), worded).otherwise(digits), "\x1f")
    return F.transform(F.array(pieces), lambda parts: _moment(parts, dayfirst))[0]


def hash_prefix(cell):
    return F.substring(F.sha2(cell.cast("string"), 256), 1, 12)


def present(cell, data_type):
    """The cell with floating NaN turned into NULL, so one marker means missing."""
    return F.nanvl(cell, F.lit(None).cast(data_type)) if data_type.typeName() in ("double", "float") else cell
