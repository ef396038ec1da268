"""Query text: need and place, model requests and replies, context, routing, localisation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K
from nearwell.functions.messages import (extract_json_object, is_ascii, json_object, need_part,
                                         place_part)
from nearwell.functions.presentation import result_summary
from nearwell.operators.skew import previous_value

TURNS_PER_PIECE = 1000


def _blank(c) -> Column:
    return F.coalesce(c, F.lit(""))


def _context_columns(df: DataFrame) -> DataFrame:
    """prev_need/prev_place/has_context default to a first message."""
    return df.withColumns({c: F.lit(v).cast(t) for c, v, t in (
        ("prev_need", None, "string"), ("prev_place", None, "string"),
        ("has_context", False, "boolean")) if c not in df.columns})


def parse_need_place(df: DataFrame) -> DataFrame:
    """Add fast, need, place, lang to messages(text[, has_context]).

    Plain-English '<need> near <place>' without context is read here; other rows stay NULL and go
    through :func:`intent_requests` and :func:`intent_merge`.
    """
    df = _context_columns(df)
    text = F.col("text")
    fast = (~F.col("has_context") & is_ascii(text) & need_part(text).isNotNull()
            & place_part(text).isNotNull())
    return df.withColumn("fast", F.coalesce(fast, F.lit(False))).withColumns({
        "need": F.when(F.col("fast"), need_part(text)),
        "place": F.when(F.col("fast"), place_part(text)),
        "lang": F.when(F.col("fast"), "en")})


def context_place_guard(c) -> Column:
    """A previous place is inherited only when it is a name: digits alone (a PIN) become ''."""
    return F.when(F.trim(c).rlike("^[0-9]+$"), "").otherwise(_blank(c))


def intent_requests(parsed: DataFrame) -> DataFrame:
    """(message_id, system, prompt) for the messages that missed the fast path."""
    context = F.when(F.col("has_context"), F.format_string(
        'Context: previous need="%s", previous place="%s".\n', _blank(F.col("prev_need")),
        context_place_guard(F.col("prev_place")))).otherwise("")
    return parsed.filter(~F.col("fast")).select(
        "message_id", F.lit(K.PARSE_PROMPT).alias("system"),
        F.concat(context, F.lit("Message: "), "text").alias("prompt"))


def intent_merge(parsed: DataFrame, replies: DataFrame) -> DataFrame:
    """Fill need, place, lang from replies(message_id, reply).

    Without a usable reply the English pattern is tried on any message, else the whole text is the
    need and the place comes from the context. Lengths count code points.
    """
    obj = extract_json_object(F.col("reply"), "need string, place string, lang string")
    df = parsed.join(replies.select("message_id", "reply"), "message_id", "left").withColumn(
        "_o", obj)
    ok = F.col("_o").isNotNull()
    match = need_part(F.col("text")).isNotNull() & place_part(F.col("text")).isNotNull()

    def cut(c, n):
        return F.substring(F.trim(_blank(c)), 1, n)

    lang = F.coalesce(F.nullif(F.trim("_o.lang"), F.lit("")), F.lit("en"))
    return df.withColumns({
        "need": F.when(F.col("fast"), F.col("need")).when(ok, cut(F.col("_o.need"), K.NEED_CHARS))
        .when(match, need_part(F.col("text"))).otherwise(cut(F.col("text"), K.NEED_CHARS)),
        "place": F.when(F.col("fast"), F.col("place"))
        .when(ok, cut(F.col("_o.place"), K.PLACE_CHARS))
        .when(match, place_part(F.col("text")))
        .otherwise(F.when(F.col("has_context"), context_place_guard(F.col("prev_place")))
                   .otherwise("")),
        "lang": F.when(ok & ~F.col("fast"), F.substring(F.lower(lang), 1, 2)).otherwise("en"),
    }).drop("_o", "reply")


def carry_context(turns: DataFrame) -> DataFrame:
    """Add has_context, prev_need, prev_place: those of the last earlier turn with a need."""
    value = F.when(F.col("parsed_need").isNotNull(), F.struct("parsed_need", "parsed_place"))
    piece = F.floor(F.col("turn_no") / TURNS_PER_PIECE)
    return previous_value(turns, "conversation_id", F.col("turn_no"), piece, value,
                          "_prev").withColumns({
        "has_context": F.col("_prev").isNotNull(),
        "prev_need": F.col("_prev.parsed_need"),
        "prev_place": F.col("_prev.parsed_place")}).drop("_prev")


def inherit_slots(df: DataFrame) -> DataFrame:
    """A message without need or place takes it from the context."""
    return df.withColumns({
        "need": F.coalesce(F.nullif("need", F.lit("")), "prev_need"),
        "place": F.coalesce(F.nullif("place", F.lit("")),
                            F.nullif(context_place_guard(F.col("prev_place")), F.lit("")))})


def route_query(df: DataFrame, chat: bool = False) -> DataFrame:
    """Add route and reply to df(need, place, device_lat, device_lng, lat, label, n_results)."""
    no_need = _blank(F.col("need")) == ""
    no_place = _blank(F.col("place")) == ""
    no_device = F.col("device_lat").isNull() | F.col("device_lng").isNull()
    route = (F.when(no_need | (no_place & no_device), "need_more_info")
             .when(F.col("lat").isNull(), "place_not_found")
             .when(_blank(F.col("n_results").cast("string")).isin("", "0"), "no_results")
             .otherwise("ok"))
    place = _blank(F.col("place"))
    if chat:
        lost = F.concat(F.lit("I couldn't find \""), place, F.lit(
            '". Try a nearby city, a PIN code, or share your location.'))
    else:
        lost = F.concat(F.lit("Couldn't find \""), place, F.lit(
            '". Try a nearby city or a PIN code.'))
    ask = K.ASK_CHAT if chat else K.ASK_SEARCH
    n = F.coalesce(F.col("n_results"), F.lit(0))
    return df.withColumn("route", route).withColumn(
        "reply", F.when(F.col("route") == "need_more_info", ask)
        .when(F.col("route") == "place_not_found", lost)
        .otherwise(result_summary(n, F.col("need"), F.col("label"))))


def localize_requests(answers: DataFrame) -> DataFrame:
    """(query_id, system, prompt) for answers(query_id, lang, summary, reasons) not in English."""
    body = F.to_json(F.struct("summary", "reasons"))
    return answers.filter((F.col("lang") != "en")
                          & ((F.col("summary") != "") | (F.size("reasons") > 0))).select(
        "query_id", F.lit(K.LOCALIZE_PROMPT).alias("system"),
        F.concat(F.lit("target="), "lang", F.lit("  "), body).alias("prompt"))


def localize_merge(answers: DataFrame, replies: DataFrame) -> DataFrame:
    """Translated summary and reasons by position, each falling back to its English text.

    Only non-empty strings count as translations. The English reasons stay as match_reasons_en.
    """
    shape = "summary variant, reasons array<variant>"
    df = answers.join(replies.select("query_id", "reply"), "query_id", "left").withColumn(
        "_o", F.when(F.col("lang") != "en",
                     F.from_json(json_object(F.col("reply")), shape)))

    def text(v):
        return F.when(F.schema_of_variant(v) == "STRING", F.nullif(
            F.try_variant_get(v, "$", "string"), F.lit("")))

    done = F.transform(F.col("reasons"), lambda en, i: F.coalesce(
        text(F.get(F.col("_o.reasons"), i)), en))
    return df.select(
        *[c for c in answers.columns if c not in ("summary", "reasons")],
        F.coalesce(text(F.col("_o.summary")), "summary").alias("summary"),
        done.alias("reasons"), F.col("reasons").alias("match_reasons_en"))


def validate_request(queries: DataFrame, text: str = "need", point_required: bool = True,
                     default_limit: int = 20, check_operator: bool = False,
                     ) -> tuple[DataFrame, DataFrame]:
    """Split raw request rows into (good, bad).

    Parameters arrive as text; good rows carry them typed with defaults filled, bad rows carry the
    names of the offending parameters in ``error``.
    """
    num = {c: F.col(c).try_cast("double") for c in ("radius", "limit", "lat", "lng")}
    radius = F.coalesce(num["radius"], F.when(F.col("radius").isNull(), 50.0))
    limit = F.coalesce(num["limit"], F.when(F.col("limit").isNull(), float(default_limit)))

    def point(c, bound):
        if point_required:
            return num[c].isNotNull()
        return F.col(c).isNull() | F.coalesce(num[c].between(-bound, bound), F.lit(False))

    rules = {
        text: _blank(F.col(text)) != "",
        "lat": point("lat", 90.0), "lng": point("lng", 180.0),
        "radius": F.coalesce(radius.between(*K.RADIUS_RANGE), F.lit(False)),
        "limit": F.coalesce(limit.between(*K.LIMIT_RANGE), F.lit(False)),
    }
    if check_operator:
        rules["operator"] = F.col("operator").isNull() | F.col("operator").isin(*K.OPERATORS)
    error = F.concat_ws(", ", *[F.when(~ok, name) for name, ok in rules.items()])
    checked = queries.withColumn("error", error)
    good = checked.filter("error = ''").withColumns({
        "radius": radius, "limit": limit.cast("int"),
        "lat": num["lat"], "lng": num["lng"]}).drop("error")
    return good, checked.filter("error <> ''")
