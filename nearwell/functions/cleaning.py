"""Cleaning scalars for the scraped facility directory."""

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearwell import constants as K


def clean_text(c) -> Column:
    """NULL becomes '', and CR, LF and TAB become a space."""
    return F.translate(F.coalesce(c, F.lit("")), "\n\r\t", "   ")


def strip_control(c) -> Column:
    """Every ASCII control character becomes a space; NULL stays NULL."""
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")


def normalize_type(c) -> Column:
    """Lower-trimmed facility type; 'null' and '' mean missing, one known typo is mended."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("null", ""), None).when(t == "farmacy", "pharmacy").otherwise(t)


def has_known_type(c) -> Column:
    """True unless the type is a word outside the vocabulary (the mark of a shifted row)."""
    t = F.lower(F.trim(c))
    return c.isNull() | t.isin("null", "") | t.isin(*K.FACILITY_TYPES)


def normalize_pin(c) -> Column:
    """Six digits after removing white space, else NULL."""
    pin = F.regexp_replace(c, r"\s", "")
    return F.when(pin.rlike("^[0-9]{6}$"), pin)


def titlecase_region(c) -> Column:
    return F.initcap(F.trim(c))


def json_strings(c) -> Column:
    """A JSON array held in a string, as array<string>; malformed text gives NULL."""
    return F.from_json(c, "array<string>")


def compose_address(name, city, state) -> Column:
    """Geocodable address. Like concat_ws, a NULL part is left out and '' is kept."""
    return F.concat_ws(", ", name, city, state, F.lit("India"))


def compose_search_document(name, specialties, procedure, capability, description) -> Column:
    """The text that is embedded: name, the three JSON term lists and the description."""
    lists = [F.coalesce(F.array_join(json_strings(c), " "), F.lit(""))
             for c in (specialties, procedure, capability)]
    return F.concat_ws(" ", name, *lists, F.coalesce(description, F.lit("")))


def site_url(c) -> Column:
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))


def split_services(c) -> Column:
    """Lower-cased services of a registry row, split at ';'; NULL stays NULL."""
    return F.split(F.lower(c), ";")


def unescape_html(text: Column) -> Column:
    """Character references decoded in one pass: named ones, ``&#39;`` and ``&#x27;``.

    The names are those of HTML 5 that end in a semicolon; unknown ones stay as they are.
    """
    names = {f"&{k}": v for k, v in html5.items() if k.endswith(";")}
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    pattern = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

    def char(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#([0-9]+);$", 1)
        hexes = F.regexp_extract(ref, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        code = F.when(digits != "", F.conv(digits, 10, 16)).when(hexes != "", hexes)
        numeric = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.coalesce(numeric, F.try_element_at(table, ref), ref)

    parts = F.split(text, pattern)
    refs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.flatten(F.zip_with(parts, refs, lambda part, ref: F.array(
        part, F.coalesce(char(ref), F.lit(""))))), "")
