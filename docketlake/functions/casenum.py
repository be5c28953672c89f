"""Case numbers such as ``T 0664/16``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the case kinds, and the forms of a number (fixed values).
CODES = "GTJDWR"
PARTS = r"([" + CODES + r"])\s*(\d{1,4})\s*/\s*(\d{2,4})"
WHOLE = "(?iu)^" + PARTS + "$"
INLINE = r"(?iu)\b" + PARTS + r"\b"
#: Unicode's white space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def pad4(number: Column) -> Column:
    """At least four digits; longer numbers stay whole."""
    return F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))


def format_case(code: Column, number: Column, year: Column) -> Column:
    return F.concat(code, F.lit(" "), pad4(number), F.lit("/"), F.lpad((year % 100).cast("string"), 2, "0"))


def parse_case(text: Column) -> Column:
    """The canonical case number of a text that is one, else null."""
    t = strip(text)
    part = lambda i: F.regexp_extract(t, WHOLE, i)
    return F.when(t.rlike(WHOLE), format_case(F.upper(part(1)), part(2), F.try_to_number(part(3), F.lit("9999")).cast("int")))


def inline_cases(text: Column) -> Column:
    """Canonical numbers of the case numbers inside a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(INLINE), F.lit(0)), parse_case)
