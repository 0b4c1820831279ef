"""Column expressions for the dirty text fields of a listing. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.schemas import DEFAULT_AREA_TYPE, OTHER, READY, UNDER_CONSTRUCTION

# The characters that count as white space, no-break and wide spaces included.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_DIGITS = r"[0-9](?:_?[0-9])*"
_UNSIGNED = rf"(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})"
_DECIMAL = rf"(?U)^[\s\x1c-\x1f]*[+-]?{_UNSIGNED}(?:[eE][+-]?{_DIGITS})?[\s\x1c-\x1f]*$"
_RANGE_SIDE = rf"(\+?{_UNSIGNED}(?:[eE]\+?{_DIGITS})?)"
_RANGE = rf"(?U)^[\s\x1c-\x1f]*{_RANGE_SIDE}[\s\x1c-\x1f]*-[\s\x1c-\x1f]*{_RANGE_SIDE}[\s\x1c-\x1f]*$"
_DIGIT_DOT_RUN = r"([0-9.]+)"
# A letter after something that is neither letter nor space.
_INNER_WORD = r"(?<=[^\p{L} ])(?=\p{L})"
_MARK = "\x01 "

# Unit spellings and their size in square feet, in order of precedence.
AREA_UNITS = [
    (("sq. meter", "sq.meter"), 10.7639),
    (("sq. yard", "sq.yard"), 9.0),
    (("acre",), 43560.0),
    (("guntha",), 1089.0),
    (("perch",), 272.25),
]

# Display labels of the model features.
FEATURE_LABELS = {
    "total_sqft": "Property size",
    "total_rooms": "Total rooms",
    "sqft_per_bhk": "Area per BHK",
    "bath_per_bhk": "Bathrooms per BHK",
    "sqft_per_room": "Area per room",
    "bhk_bath_diff": "BHK/bathroom difference",
    "bhk": "BHK",
    "bath": "Bathrooms",
    "balcony": "Balconies",
}
FEATURE_LABEL_PREFIXES = [
    ("area_type_", "Area type: "),
    ("location_", "Locality: "),
    ("availability_status_", "Availability: "),
]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def _as_double(digits: Column) -> Column:
    return F.replace(digits, F.lit("_"), F.lit("")).try_cast("double")


# Patterns are tested before casting: a failing cast costs far more than a failing match.
def decimal_or_null(c: Column) -> Column:
    """Double for text that is a plain decimal number, else NULL.

    A bare cast would also take Java's ``1200d`` and reject ``1_000``.
    """
    return F.when(c.rlike(_DECIMAL), _as_double(strip(c)))


def parse_count(c: Column) -> Column:
    """First run of digits as an integer: ``4 Bedroom`` gives 4, no digits gives NULL."""
    return F.when(c.rlike("[0-9]"), F.regexp_extract(c, "([0-9]+)", 1).try_cast("int"))


def _leading_number(c: Column) -> Column:
    return F.when(c.rlike("[0-9.]"), F.regexp_extract(c, _DIGIT_DOT_RUN, 1).try_cast("double"))


def _range_midpoint(c: Column) -> Column:
    low, high = (_as_double(F.regexp_extract(c, _RANGE, side)) for side in (1, 2))
    return F.when(F.contains(c, F.lit("-")) & c.rlike(_RANGE), (low + high) / 2.0)


def _unit_factor(c: Column) -> Column:
    lowered = F.lower(c)
    factor = F.lit(None).cast("double")
    for spellings, square_feet in reversed(AREA_UNITS):
        mentions = lowered.contains(spellings[0])
        for other in spellings[1:]:
            mentions = mentions | lowered.contains(other)
        factor = F.when(mentions, F.lit(square_feet)).otherwise(factor)
    return factor


def parse_area(c: Column) -> Column:
    """Area text to square feet: number, ``a - b`` midpoint, number with unit, or first number."""
    in_units = _leading_number(c) * F.coalesce(_unit_factor(c), F.lit(1.0))
    return F.coalesce(decimal_or_null(c), _range_midpoint(c), in_units)


def clean_status(c: Column) -> Column:
    is_ready = F.lower(strip(c)) == READY.lower()
    return F.when(c.isNull() | is_ready, F.lit(READY)).otherwise(F.lit(UNDER_CONSTRUCTION))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters (``o'neil 1st`` -> ``O'Neil 1St``).

    ``initcap`` only starts words after a space, so other word starts get a marked space first.
    """
    marked = F.regexp_replace(c, _INNER_WORD, _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Trim, collapse white space, title-case; NULL stays NULL."""
    return title_case(F.regexp_replace(strip(c), _SPACE_RUN, " "))


def normalize_location(c: Column, missing: str = OTHER) -> Column:
    return normalize_text(F.coalesce(c, F.lit(missing)))


def default_area_type(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(DEFAULT_AREA_TYPE)))


def feature_label(c: Column) -> Column:
    """Readable name of a model slot such as ``cat__location_Yelahanka``."""
    name = F.replace(F.replace(c, F.lit("num__"), F.lit("")), F.lit("cat__"), F.lit(""))
    label = title_case(F.replace(name, F.lit("_"), F.lit(" ")))
    for prefix, text in reversed(FEATURE_LABEL_PREFIXES):
        rest = F.substr(name, F.lit(len(prefix) + 1))
        label = F.when(F.startswith(name, F.lit(prefix)), F.concat(F.lit(text), rest)).otherwise(label)
    known = F.create_map(*[F.lit(x) for pair in FEATURE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), label)
