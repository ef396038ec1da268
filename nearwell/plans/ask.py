"""The batch form of one search request: messages in, evidence-attached answers out."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell import constants as K
from nearwell.functions.messages import emergency_flag
from nearwell.functions.presentation import result_summary, speech_locale
from nearwell.operators import dialogue as OD
from nearwell.operators import evidence as OE
from nearwell.operators import geo as OG
from nearwell.operators import search as OS
from nearwell.session import materialize


def answer_batch(messages: DataFrame, replies: DataFrame, grounding: DataFrame, fac: DataFrame,
                 geo: DataFrame, table: DataFrame, evidence: DataFrame, verification: DataFrame, model: Callable[[], Callable] = OS.hashed_words,
                 radius_km: float = 50.0, limit: int = 20,
                 ) -> tuple[DataFrame, DataFrame]:
    """(answers, hits) for messages(message_id, text, device_lat, device_lng), over the stored search
    ``table`` and ``evidence`` index.

    Messages may have type, operator, radius_km and limit of their own; where a column is missing or
    null, any type and operator and the ``radius_km`` and ``limit`` given here hold.

    ``replies`` and ``grounding`` are the model replies to ``intent_requests`` and
    ``grounding_requests``; both may be empty. answers: one row per message with route, reply,
    origin, language and emergency flag. hits: ranked facilities with their evidence. The ranked
    hits are written once, because evidence, badges and counts all start from them.
    """
    intents = OD.intent_merge(OD.parse_need_place(messages), replies)
    origins = OG.resolve_origin(intents.withColumn("message", F.col("text")), fac, geo)
    origins = materialize(origins, "origins")
    asked = origins.filter("need <> '' AND lat IS NOT NULL")
    vectors = OS.batch_embed(
        asked.select(F.col("message_id").alias("facility_id"), F.col("need").alias("doc")), model)
    def own(name: str, kind: str, default=None):
        have = F.col(name).cast(kind) if name in messages.columns else F.lit(None).cast(kind)
        return F.coalesce(have, F.lit(default).cast(kind)).alias(name)

    asked = asked.drop("type", "operator", "radius_km", "limit").join(messages.select(
        "message_id", own("type", "string"), own("operator", "string"),
        own("radius_km", "double", radius_km), own("limit", "int", limit)), "message_id")
    queries = asked.join(vectors.select(F.col("facility_id").alias("message_id"),
                                        F.col("embedding").alias("qv")), "message_id").select(
        F.col("message_id").alias("query_id"), "need", "qv", "lat", "lng",
        "radius_km", "type", "operator",
        F.least(F.lit(K.MAX_LIMIT), K.OVERFETCH * F.col("limit")).alias("limit"))
    found = OS.search_facilities(queries, table)
    hits = OS.overfetch_floor(found.drop("limit").join(
        asked.select(F.col("message_id").alias("query_id"), "limit"), "query_id")).drop("limit")
    need = asked.select(F.col("message_id").alias("query_id"), "need")
    at = OG.grid_cell(F.col("lat"), F.col("lng"))
    hits = materialize(hits.join(need, "query_id").withColumn("cell", at), "hits")
    lexical = materialize(OE.lexical_evidence(hits, evidence), "lexical")
    grounded = OE.merge_grounding(OE.weak_hits(hits, lexical), grounding)
    shown = OE.verification_badge(OE.evidence_confidence(hits.drop("cell"), lexical, grounded), verification)
    counts = hits.groupBy(F.col("query_id").alias("message_id")).agg(
        F.count("*").cast("int").alias("n_results"))
    answers = OD.route_query(origins.join(counts, "message_id", "left").withColumn(
        "n_results", F.coalesce("n_results", F.lit(0))))
    return answers.select(
        "message_id", "need", "place", "lang", speech_locale(F.col("lang")).alias("speech_locale"),
        emergency_flag(F.col("text")).alias("emergency"), "lat", "lng", "label", "precision",
        "n_results", "route", "reply",
        result_summary(F.col("n_results"), F.col("need"), F.col("label")).alias("summary")), shown


def answer_requests(requests: DataFrame, replies: DataFrame, grounding: DataFrame, fac: DataFrame,
                    geo: DataFrame, table: DataFrame, evidence: DataFrame, verification: DataFrame,
                    **options) -> tuple[DataFrame, DataFrame]:
    """(answers, hits) for raw requests(message_id, text, lat, lng, radius, limit, operator, type), all
    of them text as it arrives.

    Requests with a parameter out of range are not searched: their answer has the route ``invalid``
    and names the parameters in its reply. The others are answered by :func:`answer_batch`, each
    with its own radius, limit, type and operator.
    """
    good, bad = OD.validate_request(requests, "text", point_required=False, default_limit=20,
                                    check_operator=True)
    messages = good.select("message_id", "text", F.col("lat").alias("device_lat"),
                           F.col("lng").alias("device_lng"), F.col("radius").alias("radius_km"), "limit",
                           "operator", "type")
    answers, hits = answer_batch(messages, replies, grounding, fac, geo, table, evidence, verification, **options)
    refused = {"message_id": F.col("message_id"), "emergency": emergency_flag(F.col("text")),
               "n_results": F.lit(0), "route": F.lit("invalid"),
               "reply": F.concat(F.lit("invalid: "), "error")}
    rows = bad.select(*[refused.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in answers.schema])
    return answers.unionByName(rows), hits


def model_requests(messages: DataFrame) -> DataFrame:
    """(message_id, system, prompt) of the messages that the plain "need near place" form doesn't read;
    the replies to these are the ``replies`` of :func:`answer_batch`."""
    return OD.intent_requests(OD.parse_need_place(messages))
