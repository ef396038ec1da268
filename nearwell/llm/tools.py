"""Tool calls and their results: linking, ordering, validation and canonical JSON.

Results are hash-joined to calls by conversation and identifier. Arguments are parsed once as
variants, checked against the tool's parameters, and written with sorted keys. A call may use results
of other calls; its place in the order is a pair (ready, hops): its own turn, or the place
of the latest call it uses and one hop more. Where a log is in order that is the turn itself, found
without any iteration; only calls logged before what they use are moved, round by round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearwell.session import materialize

# Parameter types of a schema and the variant types that they admit.
TYPES = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DECIMAL.*|DOUBLE)$",
         "boolean": r"^BOOLEAN$", "array": r"^ARRAY<.*", "object": r"^OBJECT<.*", "any": r".*"}
KEY = ["conv_id", "call_id"]


def canonical(value: Column) -> Column:
    """A variant as JSON with sorted keys and no blanks."""
    return F.to_json(value)


def tool_table(schemas: DataFrame) -> DataFrame:
    """name, params (map of types) and required, from rows (name, param, type, required).

    Rows with a null name or param are left out; a null type admits anything.
    """
    rows = schemas.where("name IS NOT NULL AND param IS NOT NULL").groupBy("name", "param").agg(
        F.max(F.coalesce("type", F.lit("any"))).alias("type"),
        F.max(F.coalesce("required", F.lit(False))).alias("required"))
    return rows.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("param", "type"))).alias("params"),
        F.array_sort(F.collect_list(F.when(F.col("required"), F.col("param")))).alias("required"))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """The calls with ``arguments`` as canonical JSON (null if they aren't) and sorted ``errors``.

    Errors: ``not_json`` (not one JSON object; repeated keys count), ``unknown_tool``, and per
    parameter ``missing:p``, ``unknown:p`` and ``type:p``. JSON null fits no type but ``any``.
    """
    parsed = F.try_parse_json("arguments")
    is_object = F.schema_of_variant(parsed).startswith("OBJECT<")
    rows = calls.select(*KEY, "turn", "name", F.when(is_object, parsed).alias("value"))
    rows = rows.join(tool_table(schemas), "name", "left")
    rows = rows.withColumn("given", F.transform_values(
        F.col("value").cast("map<string,variant>"), lambda k, v: F.schema_of_variant(v)))
    keys = F.map_keys("given")
    pattern = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))

    def fits(k: Column) -> Column:
        wanted = F.try_element_at(pattern, F.try_element_at("params", k))
        return F.regexp_like(F.try_element_at("given", k), F.coalesce(wanted, F.lit(".*")))

    def tag(name: str, which: Column) -> Column:
        return F.transform(which, lambda p: F.concat(F.lit(f"{name}:"), p))

    per_key = F.concat(
        tag("missing", F.filter("required", lambda p: ~F.array_contains(keys, p))),
        tag("unknown", F.filter(keys, lambda k: ~F.map_contains_key("params", k))),
        tag("type", F.filter(keys, lambda k: F.map_contains_key("params", k) & ~fits(k))))
    errors = F.when(F.col("params").isNull(), F.array(F.lit("unknown_tool"))).when(
        F.col("value").isNull(), F.array(F.lit("not_json"))).otherwise(F.array_sort(per_key))
    return rows.select(*KEY, "turn", "name", canonical(F.col("value")).alias("arguments"), "value",
                       errors.alias("errors"))


def ring_calls(uses: DataFrame, turns: DataFrame) -> DataFrame:
    """Keys of the calls that can't be ordered: in a ring of uses, or using such a call.

    ``uses`` (conv_id, call_id, used) and ``turns`` (conv_id, call_id, turn). A ring holds a use of a
    call that isn't earlier, so only conversations with such a use are searched: uses of calls that
    wait for nothing are taken away, until a round takes none. Rounds are the longest chain there.
    """
    own = uses.join(turns, KEY).join(turns.select(
        "conv_id", F.col("call_id").alias("used"), F.col("turn").alias("used_turn")), ["conv_id", "used"])
    odd = own.where(F.coalesce(F.col("used_turn") >= F.col("turn"), F.lit(True))).select("conv_id").distinct()
    rest = materialize(uses.join(odd, "conv_id", "left_semi"), "rings")
    size = rest.count()
    while size:
        waiting = rest.select("conv_id", F.col("call_id").alias("used")).distinct()
        rest = materialize(rest.join(waiting, ["conv_id", "used"], "left_semi"), "rings")
        size, before = rest.count(), size
        if size == before:
            break
    return rest.select(*KEY).distinct()


def order(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, ready, hops) per call; both null for calls that use each other in a ring,
    and for calls that use one of those.

    ``calls`` has unique keys, turn, and uses: identifiers of calls of the same conversation whose
    results the arguments take up; those that aren't calls are ignored. Sorting by ready, hops, turn
    and call_id is a topological order.
    """
    own_place = F.struct(F.col("turn").alias("ready"), F.lit(0).cast("long").alias("hops"))
    uses = calls.select("conv_id", "call_id", F.explode(F.array_distinct("uses")).alias("used"))
    known = calls.select("conv_id", F.col("call_id").alias("used"))
    uses = materialize(uses.join(known, ["conv_id", "used"]), "uses")
    rings = materialize(ring_calls(uses, calls.select(*KEY, "turn")), "ring-calls")
    places = materialize(calls.select(*KEY, own_place.alias("place")).join(rings, KEY, "left_anti"),
                         "places")
    while True:  # without rings, a place moves no further than the longest chain
        now = places.select("conv_id", F.col("call_id").alias("used"), F.struct(
            F.col("place.ready").alias("ready"), (F.col("place.hops") + 1).alias("hops")).alias("p"))
        least = uses.join(now, ["conv_id", "used"]).groupBy(*KEY).agg(F.max("p").alias("p"))
        moved = materialize(places.join(least, KEY).where(F.col("p") > F.col("place")).select(
            *KEY, "p"), "moved")
        if moved.isEmpty():
            break
        places = materialize(places.join(moved, KEY, "left").select(
            *KEY, F.coalesce("p", "place").alias("place")), "places")
    null = F.lit(None).cast("long")
    return places.select(*KEY, "place.*").union(rings.select(*KEY, null.alias("ready"), null.alias("hops")))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result that has none, with status, place, errors and message.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), uses (call ids). ``results``:
    conv_id, turn, call_id, content. Of calls or results with one identifier the first counts (by
    turn, then by content); the others have status ``duplicate_call`` or ``duplicate_result``. A call
    is ``linked`` or ``unanswered``; a result without a call, or a null identifier, is
    ``orphan_result`` (a call with a null identifier: ``unidentified_call``). ``message`` is the
    canonical JSON of the call and its result; ready and hops order the calls. Other columns are
    ignored; empty tables give no rows.
    """
    calls = calls.select(*KEY, "turn", "name", "arguments", "uses")
    results = results.select(*KEY, "turn", "content")
    named = calls.where("call_id IS NOT NULL AND conv_id IS NOT NULL")
    first = named.groupBy(*KEY).agg(F.min(F.struct("turn", "name", "arguments", F.array_sort(
        F.coalesce("uses", F.array().cast("array<string>"))).alias("uses"))).alias("c"),
        F.count("*").alias("n")).select(*KEY, "c.*", "n")
    first = materialize(first, "calls")
    answer = results.where("call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy(*KEY).agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    checked = validated(first, schemas).join(order(first), KEY)
    linked = checked.join(answer.hint("shuffle_hash"), KEY, "left")
    message = canonical(F.struct(
        F.col("value").alias("arguments"), F.col("call_id").alias("id"), "name",
        F.col("r.content").alias("result")))

    def rows(df: DataFrame, status: Column, **more: Column) -> DataFrame:
        kinds = {"turn": "long", "name": "string", "ready": "long", "hops": "long",
                 "errors": "array<string>", "message": "string"}
        return df.select(*KEY, status.alias("status"), *(
            more.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))

    main = rows(linked, F.when(F.col("r").isNull(), "unanswered").otherwise("linked"),
                turn=F.col("turn"), name=F.col("name"), ready=F.col("ready"), hops=F.col("hops"),
                errors=F.col("errors"), message=message)
    # copies beyond the first, as many rows as there are
    spare = first.where("n > 1").select(*KEY, F.explode(F.sequence(F.lit(2), "n")).alias("_"))
    paired = answer.join(first.select(*KEY, F.lit(True).alias("has")), KEY, "left")
    orphan = F.col("has").isNull()
    again = paired.select(*KEY, "r", "has", F.explode(F.sequence(
        F.lit(1).cast("long"), "n_results")).alias("i")).where((F.col("i") > 1) | orphan)
    return (main.union(rows(spare, F.lit("duplicate_call")))
            .union(rows(again, F.when(orphan & (F.col("i") == 1), "orphan_result")
                        .otherwise("duplicate_result")))
            .union(rows(calls.where("call_id IS NULL OR conv_id IS NULL"),
                        F.lit("unidentified_call"), turn=F.col("turn"), name=F.col("name")))
            .union(rows(results.where("call_id IS NULL OR conv_id IS NULL"),
                        F.lit("orphan_result"), turn=F.col("turn"))))
