"""Provisions: codes such as ``EPC2000_Art_123(2)_(2007)`` and typed ones such as ``Rule 103(1)(a)``, in one form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casenum import strip
from .once import let

#: Names of issuers in the data and their form in results (fixed values).
ISSUERS = {
    "epc": "EPC", "vobk": "RPBA", "rpba": "RPBA", "prba": "RPBA", "rbpa": "RPBA", "rpeba": "RPEBA",
    "rpbea": "RPEBA", "vogbk": "RPEBA", "ree": "REE", "pct": "PCT", "rfees": "RFees", "guidelines": "Guidelines",
}
#: A number with its parts, and what may follow it in a code and is dropped (fixed values).
NUMBER = r"(\d+[a-z]*(?:\.\d+)?)\s*((?:\([^)\s]+\))*)"
DROPPED = r"(?:[_\s]*\(\d{4}\))?(?:[_\s]+(?:Sent|Satz)[_\s.]*\d+)?(?:_Protocol_Interpretation)?"
#: A code: issuer, kind and number; the first kind that it names holds, at its last place (fixed value).
CODE = r"(?is)^(?:(.+)_Art_|(?!.+_Art_)(.+)_Rule_|(?!.+_(?:Art|Rule)_)(.+)_R_)" + NUMBER + DROPPED + "$"
#: A typed provision (fixed value).
TYPED = r"(?i)^(Art(?:icle)?|R(?:ule)?)\.?\s*" + NUMBER + r"\s*([A-Za-z][A-Za-z0-9 _]*)?$"
#: What an issuer's name loses: a mark at its start, and years (fixed value).
ERA = r"(?i)^_*blank|[ _]?(?:19|20)\d\d"
LAST_ISSUER = r"\s+(EPC|RPBA|RPEBA|REE|PCT|RFees|Guidelines)$"
#: Separates the parts that a pattern finds; never part of a code.
MARK = "\x01"


def issuer(text: Column) -> Column:
    """An issuer's name without its era, by its usual abbreviation where it has one."""
    known = F.create_map(*[F.lit(x) for pair in ISSUERS.items() for x in pair])
    plain = F.btrim(F.regexp_replace(strip(text), ERA, ""), F.lit(" _"))
    return let(plain, lambda x: F.coalesce(F.try_element_at(known, F.lower(x)), x))


def _composed(kind: Column, number: Column, parts: Column, by: Column) -> Column:
    digits = F.regexp_replace(number, "^0+(?=[0-9])", "")
    return strip(F.concat(kind, F.lit(" "), digits, parts, F.lit(" "), by))


def _parsed(text: Column, pattern: str, groups: str, body: Callable[[Column], Column]) -> Column:
    """body of the groups that the pattern finds in one pass, else the text trimmed."""

    def found(t: Column) -> Column:
        parts = F.split(F.when(~F.contains(t, F.lit(MARK)), F.regexp_replace(t, pattern, groups)), MARK)
        return let(parts, lambda x: F.when(F.size(x) > 1, body(x)).otherwise(t))

    return let(strip(text), found)


def normalise_raw(raw: Column) -> Column:
    """A code in canonical form; text that isn't one stays, trimmed; blank or null is empty."""
    kind = lambda x: F.when(x[0] != "", "Art.").otherwise("R.")
    out = _parsed(raw, CODE, MARK.join(["$1", "$2$3", "$4", "$5"]), lambda x: _composed(kind(x), x[2], x[3], issuer(F.concat(x[0], x[1]))))
    return F.coalesce(out, F.lit(""))


def normalise_typed(text: Column) -> Column:
    """A typed provision in canonical form, of the EPC if it names no issuer; other text stays, trimmed."""
    kind = lambda x: F.when(F.lower(x[0]).startswith("a"), "Art.").otherwise("R.")
    by = lambda x: F.when(x[3] == "", "EPC").otherwise(issuer(x[3]))
    return _parsed(text, TYPED, MARK.join(["$1", "$2", "$3", "$4"]), lambda x: _composed(kind(x), x[1], x[2], by(x)))


def prose_variants(provision: Column) -> Column:
    """How prose writes a provision: without its issuer, rules also spelled out."""
    bare = F.regexp_replace(provision, LAST_ISSUER, "")
    return F.when(bare.startswith("R."), F.array(bare, F.replace(bare, F.lit("R."), F.lit("Rule")))).otherwise(F.array(bare))
