"""Query-message scalars: language-neutral parsing, emergency flags, model replies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearwell import constants as K

# JavaScript's \b is ASCII-only; Java's is not, so the boundary is spelt out.
NOT_AFTER_WORD = "(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = "(?![A-Za-z0-9_])"
NEED_NEAR_PLACE = r"(?i)^\s*(.+?)\s+near\s+(.+?)\s*\z"


def is_ascii(c) -> Column:
    return c.rlike(r"^[\x00-\x7F]*\z")


def extract_pin(c) -> Column:
    """First standalone 6-digit token, else NULL."""
    return F.nullif(
        F.regexp_extract(c, NOT_AFTER_WORD + "([0-9]{6})" + NOT_BEFORE_WORD, 1), F.lit(""))


def need_part(c) -> Column:
    """'<need> near <place>' read by its first split: the need, or NULL."""
    return F.nullif(F.trim(F.regexp_extract(c, NEED_NEAR_PLACE, 1)), F.lit(""))


def place_part(c) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, NEED_NEAR_PLACE, 2)), F.lit(""))


def emergency_flag(c) -> Column:
    """True when the message names an emergency in English or in one of the other languages."""
    english = NOT_AFTER_WORD + "(?:" + "|".join(K.EMERGENCY_WORDS) + ")" + NOT_BEFORE_WORD
    other = "|".join(K.EMERGENCY_PHRASES)
    return c.rlike("(?i)" + english) | c.rlike("(?iu)" + other)


def json_object(reply) -> Column:
    """The span from the first '{' to the last '}' when it is valid JSON, else NULL."""
    span = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(span).isNotNull(), span)


def extract_json_object(reply, schema: str) -> Column:
    """A model reply's JSON object parsed to ``schema``; unusable replies give NULL."""
    span = json_object(reply)
    return F.when(span.isNotNull(), F.from_json(span, schema))


def suspect_evidence(name, txt) -> Column:
    """True for a claim that the facility's apparent kind makes implausible."""
    def any_of(c, words):
        hit = F.lit(False)
        for w in words:
            hit = hit | c.ilike(f"%{w}%")
        return hit
    return any_of(name, K.SUSPECT_NAMES) & any_of(txt, K.SUSPECT_TERMS)
