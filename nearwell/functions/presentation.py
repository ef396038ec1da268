"""Scalars that shape results for display and sharing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearwell import constants as K


def pseudonymize_user(email, salt: str) -> Column:
    """Salted, one-way user key; a missing address is the local development user."""
    who = F.coalesce(email, F.lit("local-dev"))
    digest = F.sha2(F.concat(F.lit(salt + ":"), who), 256)
    return F.concat(F.lit("u_"), F.substring(digest, 1, 32))


def match_label(sim, cut: float = K.RELATED_BELOW) -> Column:
    sim = F.coalesce(sim, F.lit(0.0))
    percent = F.round(sim * 100).cast("int").cast("string")
    return F.concat(percent, F.lit("% "), F.when(sim < cut, "related").otherwise("match"))


def encode_component(c) -> Column:
    """Percent-encoding of a URI component (Spark's url_encode is the form encoding)."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def _plain_number(c) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def directions_url(lat, lng, name, city) -> Column:
    point = F.concat(F.lit(K.DIRECTIONS_TO_POINT), _plain_number(lat), F.lit(","),
                     _plain_number(lng))
    named = F.concat(name, F.lit(", "), F.coalesce(city, F.lit("")))
    return F.when(lat.isNotNull() & lng.isNotNull(), point).otherwise(
        F.concat(F.lit(K.DIRECTIONS_BY_NAME), encode_component(named)))


def share_message(name, city, distance_km, phone, reason, directions) -> Column:
    """A share link holding the non-empty lines of one hit."""
    def given(c):
        return c.isNotNull() & (c != "")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("*"), name, F.lit("*"),
                 F.when(given(city), F.concat(F.lit(" — "), city)).otherwise("")),
        F.format_string("%.1f km away", distance_km),
        F.when(given(phone), F.concat(F.lit("📞 "), phone)),
        F.when(given(reason), F.concat(F.lit("Why: "), reason)),
        F.concat(F.lit("🗺️ Directions: "), directions))
    return F.concat(F.lit(K.SHARE_LINK), encode_component(lines))


def speech_locale(lang) -> Column:
    known = F.create_map(*[F.lit(x) for pair in K.SPEECH_LOCALES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, lang), F.concat(lang, F.lit("-IN")))


def result_summary(n, need, label) -> Column:
    found = F.when(n == 0, "No facilities").when(n == 1, "1 facility").otherwise(
        F.concat(n.cast("string"), F.lit(" facilities")))
    return F.concat(found, F.lit(" found for "), need, F.lit(" near "), label, F.lit("."))
