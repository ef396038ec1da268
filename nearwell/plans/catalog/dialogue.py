"""Query text: parsing, context, routing, emergency flags, localisation."""

from pyspark.sql import functions as F

from nearwell import constants as K
from nearwell.functions import messages as M
from nearwell.operators import dialogue as OD
from nearwell.operators import geo as OG
from nearwell.plans.catalog.base import query
from nearwell.plans.catalog.geo import ORIGIN

NEAR = "(?i)^\\s*(.+?)\\s+near\\s+(.+?)\\s*$"
FAST = f"""
    p AS (SELECT *, nullif(trim(regexp_extract(text, '{NEAR}', 1)), '') AS n,
        nullif(trim(regexp_extract(text, '{NEAR}', 2)), '') AS pl,
        regexp_full_match(text, '[\\x00-\\x7F]*') AS ascii FROM ctx),
    parsed AS (SELECT *, NOT has_context AND ascii AND n IS NOT NULL AND pl IS NOT NULL AS fast
      FROM p)"""
# every 6th message follows an earlier turn of its user
CTX = """
    ctx AS (SELECT *, event_id % 6 = 0 AS has_context,
      CASE WHEN event_id % 6 = 0 THEN 'dialysis' END AS prev_need,
      CASE WHEN event_id % 12 = 0 THEN ' 800001 ' WHEN event_id % 6 = 0 THEN 'Patna' END
        AS prev_place FROM message)"""


def _ctx(d):
    e = F.col("event_id")
    return d.message.withColumns({
        "has_context": e % 6 == 0, "prev_need": F.when(e % 6 == 0, "dialysis"),
        "prev_place": F.when(e % 12 == 0, " 800001 ").when(e % 6 == 0, "Patna")})


@query("parse_need_place", f"""WITH {CTX}, {FAST}
    SELECT message_id, fast, CASE WHEN fast THEN n END AS need, CASE WHEN fast THEN pl END AS place,
      CASE WHEN fast THEN 'en' END AS lang FROM parsed""", "message")
def parse_need_place(d):
    return OD.parse_need_place(_ctx(d)).select("message_id", "fast", "need", "place", "lang")


GUARDED = "CASE WHEN regexp_full_match(trim(prev_place), '[0-9]+') THEN '' ELSE coalesce(prev_place,'') END"


@query("context_place_guard", f"""WITH {CTX}
    SELECT message_id, {GUARDED} AS place FROM ctx""", "message")
def context_place_guard(d):
    return _ctx(d).select("message_id", OD.context_place_guard(F.col("prev_place")).alias("place"))


@query("intent_requests", f"""WITH {CTX}, {FAST}
    SELECT message_id, CASE WHEN has_context THEN 'Context: previous need="' || coalesce(prev_need,'')
      || '", previous place="' || {GUARDED} || '".' || chr(10) ELSE '' END || 'Message: ' || text
      AS prompt FROM parsed WHERE NOT fast""", "message")
def intent_requests(d):
    return OD.intent_requests(OD.parse_need_place(_ctx(d))).select("message_id", "prompt")


@query("intent_merge", f"""WITH {CTX}, {FAST},
    r AS (SELECT message_id, regexp_extract(reply, '(?s)\\{{.*\\}}', 0) AS span FROM intent_reply),
    j AS (SELECT parsed.*, CASE WHEN json_valid(span) THEN span END AS o FROM parsed
      LEFT JOIN r USING (message_id))
    SELECT message_id,
      CASE WHEN fast THEN n WHEN o IS NOT NULL
             THEN left(trim(coalesce(json_extract_string(o,'$.need'),'')),120)
           WHEN n IS NOT NULL AND pl IS NOT NULL THEN n ELSE left(trim(text),120) END AS need,
      CASE WHEN fast THEN pl WHEN o IS NOT NULL
             THEN left(trim(coalesce(json_extract_string(o,'$.place'),'')),80)
           WHEN n IS NOT NULL AND pl IS NOT NULL THEN pl
           WHEN has_context THEN {GUARDED} ELSE '' END AS place,
      CASE WHEN o IS NOT NULL AND NOT fast THEN left(lower(coalesce(nullif(trim(
        json_extract_string(o,'$.lang')),''),'en')),2) ELSE 'en' END AS lang FROM j""",
       "message intent_reply")
def intent_merge(d):
    return OD.intent_merge(OD.parse_need_place(_ctx(d)), d.intent_reply).select(
        "message_id", "need", "place", "lang")


CARRY = """
    c AS (SELECT t.*, (SELECT max(turn_no) FROM turn u WHERE u.conversation_id=t.conversation_id
        AND u.turn_no < t.turn_no AND u.parsed_need IS NOT NULL) AS at FROM turn t),
    carried AS (SELECT c.conversation_id, c.turn_no, c.parsed_need, c.parsed_place,
        u.turn_no IS NOT NULL AS has_context, u.parsed_need AS prev_need, u.parsed_place AS prev_place
      FROM c LEFT JOIN turn u ON u.conversation_id=c.conversation_id AND u.turn_no=c.at)"""


@query("carry_context", f"""WITH {CARRY}
    SELECT conversation_id, turn_no, has_context, prev_need, prev_place,
      coalesce(nullif(parsed_need,''), prev_need) AS need,
      coalesce(nullif(parsed_place,''), nullif({GUARDED},'')) AS place FROM carried""", "turn")
def carry_context(d):
    turns = OD.carry_context(d.turn).withColumns(
        {"need": F.col("parsed_need"), "place": F.col("parsed_place")})
    return OD.inherit_slots(turns).select(
        "conversation_id", "turn_no", "has_context", "prev_need", "prev_place", "need", "place")


WORDS = "|".join(K.EMERGENCY_WORDS).replace("'", "''")
PHRASES = "|".join(K.EMERGENCY_PHRASES)


@query("emergency_flag", f"""
    SELECT message_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])({WORDS})($|[^A-Za-z0-9_])')
      OR regexp_matches(text, '(?i)({PHRASES})') AS emergency FROM message""", "message")
def emergency_flag(d):
    return d.message.select("message_id", M.emergency_flag(F.col("text")).alias("emergency"))


@query("route_query", f"""WITH {ORIGIN},
    q AS (SELECT *, CASE WHEN cast(message_id AS bigint) % 31 = 0 THEN '' ELSE 'dialysis' END AS need,
      cast(cast(message_id AS bigint) % 3 AS int) AS n FROM origin),
    r AS (SELECT *, CASE WHEN need='' OR (place='' AND device_lat IS NULL) THEN 'need_more_info'
      WHEN lat IS NULL THEN 'place_not_found' WHEN n=0 THEN 'no_results' ELSE 'ok' END AS route FROM q)
    SELECT message_id, route, CASE route
      WHEN 'need_more_info' THEN '{K.ASK_CHAT}'
      WHEN 'place_not_found' THEN 'I couldn''t find "' || place
        || '". Try a nearby city, a PIN code, or share your location.'
      ELSE CASE n WHEN 0 THEN 'No facilities' WHEN 1 THEN '1 facility' ELSE n || ' facilities' END
        || ' found for ' || need || ' near ' || label || '.' END AS reply FROM r""",
       "facility facility_geo asked")
def route_query(d):
    e = F.col("message_id").cast("bigint")
    asked = OG.resolve_origin(d.asked, d.facility, d.facility_geo).withColumns({
        "need": F.when(e % 31 == 0, "").otherwise("dialysis"), "n_results": (e % 3).cast("int")})
    return OD.route_query(asked, chat=True).select("message_id", "route", "reply")


@query("localize_requests", f"""
    SELECT query_id, '{K.LOCALIZE_PROMPT.replace("'", "''")}' AS system,
      'target=' || lang || '  ' || to_json({{'summary': summary, 'reasons': [reason_one, reason_two]}})::varchar
        AS prompt
    FROM answer WHERE lang <> 'en'""", "answer")
def localize_requests(d):
    return OD.localize_requests(d.answer.select(
        "query_id", "lang", "summary", F.array("reason_one", "reason_two").alias("reasons")))


@query("localize_merge", """
    WITH a AS (SELECT *, regexp_extract(reply, '(?s)\\{.*\\}', 0) AS span FROM answer),
    b AS (SELECT *, CASE WHEN lang <> 'en' AND json_valid(span) THEN span END AS o FROM a)
    SELECT query_id, lang,
      CASE WHEN json_type(o, '$.summary')='VARCHAR' AND json_extract_string(o,'$.summary') <> ''
        THEN json_extract_string(o,'$.summary') ELSE summary END AS summary,
      CASE WHEN json_type(o, '$.reasons[0]')='VARCHAR' AND json_extract_string(o,'$.reasons[0]') <> ''
        THEN json_extract_string(o,'$.reasons[0]') ELSE reason_one END AS reason_one,
      CASE WHEN json_type(o, '$.reasons[1]')='VARCHAR' AND json_extract_string(o,'$.reasons[1]') <> ''
        THEN json_extract_string(o,'$.reasons[1]') ELSE reason_two END AS reason_two,
      reason_one AS reason_one_en FROM b""", "answer")
def localize_merge(d):
    answers = d.answer.select("query_id", "lang", "summary",
                              F.array("reason_one", "reason_two").alias("reasons"))
    out = OD.localize_merge(answers, d.answer.select("query_id", "reply"))
    return out.select("query_id", "lang", "summary", F.col("reasons")[0].alias("reason_one"),
                      F.col("reasons")[1].alias("reason_two"),
                      F.col("match_reasons_en")[0].alias("reason_one_en"))
