"""Embedding, vector scan, hybrid search."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearwell.functions import cleaning as C
from nearwell.functions import vectors as V
from nearwell.operators import geo as OG
from nearwell.operators import search as OS
from nearwell.plans.catalog.base import QV, SEARCH_TABLES, hits_sql, query, slc

TABLES = SEARCH_TABLES + " procedure_term"


def batch_queries(d, limit=None) -> DataFrame:
    """The query batch with its vectors."""
    def add(a, b):
        return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))
    vectors = d.query_parts.select("query_id", add(add(F.col("ea"), F.col("eb")),
                                                   F.col("ec")).alias("qv"))
    return d.search_query.join(vectors, "query_id").withColumn(
        "limit", F.col("lim") if limit is None else limit)


WORDS = r"""
    words AS (SELECT facility_id, unnest(list_filter(regexp_split_to_array(lower(doc),
      '[^\p{L}\p{N}]+'), lambda w: w<>'')) AS w FROM docs),
    slots AS (SELECT facility_id, cast('0x' || substr(md5(w),1,7) AS bigint) % 64 AS slot,
      count(*) AS n FROM words GROUP BY ALL),
    vec AS (SELECT facility_id, cast(sum(n*slot) AS bigint) AS weighted,
      cast(sum(n*n) AS bigint) AS squares, count(*) AS filled FROM slots GROUP BY 1)"""


def _joined(c):
    return (f"coalesce(array_to_string(CASE WHEN json_valid({c}) THEN "
            f"from_json({c}, '[\"VARCHAR\"]') END, ' '), '')")


@query("batch_embed", f"""
    WITH docs AS (SELECT b.c_custkey || '-' || copy || '-' || coalesce(doc_id, -1) AS facility_id, concat_ws(' ', name,
      {_joined('specialties')}, {_joined('procedure')}, {_joined('capability')},
      coalesce(description,''), coalesce(text,'')) AS doc
      FROM bronze_all b LEFT JOIN (SELECT *, doc_id % (SELECT count(*) FROM customer) AS k
      FROM documents) ON k=c_custkey), {WORDS}
    SELECT facility_id, sha256(doc) AS doc_hash, coalesce(filled, 0) AS filled,
      coalesce(weighted, 0) AS weighted, coalesce(squares, 0) AS squares
    FROM docs LEFT JOIN vec USING (facility_id)""", "bronze_all")
def batch_embed(d):
    owners = d.base("customer").agg(F.count("*")).scalar()
    texts = d.base("documents").select("doc_id", (F.col("doc_id") % owners).alias("c_custkey"),
                                       "text")
    rows = d.bronze_all.join(texts, "c_custkey", "left")
    parts = [F.col(c) for c in ("name", "specialties", "procedure", "capability", "description")]
    docs = rows.select(
        F.concat_ws("-", F.col("c_custkey").cast("string"), F.col("copy").cast("string"),
                    F.coalesce("doc_id", F.lit(-1)).cast("string"))
        .alias("facility_id"),
        F.concat_ws(" ", C.compose_search_document(*parts), F.coalesce("text", F.lit("")))
        .alias("doc"))
    # the word counts, read back from the unit vector and the number of words
    words = docs.select("facility_id", F.array_size(F.filter(
        F.split(F.lower("doc"), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("n"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    # the total as a variable of its own: written into the inner function, it is summed for every slot
    counts = F.transform(F.array(total), lambda t: F.transform("embedding", lambda x: F.coalesce(
        F.round(F.try_divide(x.cast("double"), t) * F.col("n")), F.lit(0)).cast("bigint")))[0]
    zero = F.lit(0).cast("bigint")
    n = int(d.spark.conf.get("spark.sql.shuffle.partitions"))
    return OS.batch_embed(docs, partitions=n).join(words, "facility_id").withColumn("c", counts).select(
        "facility_id", "doc_hash",
        F.size(F.filter("c", lambda x: x != 0)).cast("bigint").alias("filled"),
        F.aggregate(F.transform("c", lambda x, i: x * i), zero, lambda s, x: s + x)
        .alias("weighted"),
        F.aggregate("c", zero, lambda s, x: s + x * x).alias("squares"))


@query("cosine_similarity", f"""
    SELECT q.query_id, vec_id, round(list_cosine_similarity({QV}, e.embedding::double[]), 3)
      AS similarity
    FROM embeddings e JOIN query_parts q
      ON cast(q.query_id AS bigint) = e.vec_id % (SELECT count(*) FROM supplier)""",
       "query_parts")
def cosine_similarity(d):
    asked = d.base("supplier").agg(F.count("*")).scalar()
    vec = d.base("embeddings").select("vec_id", "embedding", (F.col("vec_id") % asked)
                                      .alias("s_suppkey"))
    return batch_queries(d).join(vec, "s_suppkey").select("query_id", "vec_id", F.round(
        V.cosine_similarity(F.col("qv"), F.col("embedding")), 3).alias("similarity"))


@query("semantic_scan", f"""
    WITH s AS (SELECT query_id, facility_id,
      round(list_cosine_similarity({QV}, embedding::double[]), 3) AS similarity
      FROM query_parts, facility_vec)
    SELECT query_id, cast(rank AS int) AS rank, facility_id, similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY similarity DESC, facility_id) AS rank FROM s) WHERE rank <= 10""",
       "query_parts facility_vec")
def semantic_scan(d):
    return OS.semantic_scan(batch_queries(d), d.facility_vec, 10)


@query("hybrid_score", """
    SELECT facility_id, round(0.60e0*sim + 0.25e0*(1-dist/50) + 0.10e0*least(1e0,coalesce(beds,0)/200e0)
      + 0.05e0*least(1e0,coalesce(num_doctors,0)/30e0), 4) AS score
    FROM (SELECT *, cast(c_custkey % 997 AS double)/997 AS sim,
                 cast(c_custkey % 491 AS double)/10.3e0 AS dist FROM facility)""", "facility")
def hybrid_score(d):
    f = d.facility.withColumns({"sim": (F.col("c_custkey") % 997).cast("double") / 997,
                                "dist": (F.col("c_custkey") % 491).cast("double") / 10.3})
    return f.select("facility_id", V.hybrid_score(
        F.col("sim"), F.col("dist"), F.lit(50.0), F.col("beds"), F.col("num_doctors"))
        .alias("score"))


@query("type_operator_filter", f"""
    SELECT query_id, facility_id FROM (
      SELECT q.query_id, f.facility_id, q.radius_km, {slc('q.lat', 'q.lng', 'f.lat', 'f.lng')} AS dist
      FROM search_query q JOIN facility f
        ON f.lat BETWEEN q.lat-q.radius_km/111.0 AND q.lat+q.radius_km/111.0
       AND f.lng BETWEEN q.lng-q.radius_km/(111.0*cos(radians(q.lat)))
                     AND q.lng+q.radius_km/(111.0*cos(radians(q.lat)))
      WHERE (type IS NULL OR facility_type=type) AND (operator IS NULL OR operator_type=operator))
    WHERE dist <= radius_km""", "search_query facility")
def type_operator_filter(d):
    wishes = d.search_query.select("query_id", "type", "operator")
    kinds = d.facility.select("facility_id", "facility_type", "operator_type")
    near = OG.radius_search(
        d.search_query.select("query_id", "lat", "lng", "radius_km").join(wishes, "query_id"),
        d.facility.select("facility_id", "lat", "lng").join(kinds, "facility_id"),
        ("type", "operator"), ("facility_type", "operator_type"))
    return OS.type_operator_filter(near).select("query_id", "facility_id")


@query("topk_by_score", f"""WITH {hits_sql()}
    SELECT query_id, rank, facility_id, distance_km, similarity, score FROM hits""",
       SEARCH_TABLES)
def topk_by_score(d):
    return OS.search_pairs(batch_queries(d), d.search_table).drop(
        "limit", "cell")


@query("overfetch_floor", f"""WITH {hits_sql('least(50, 3*lim)')}
    SELECT query_id, cast(r AS int) AS rank, facility_id, similarity, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM hits
      WHERE similarity >= 0.4) WHERE r <= lim""", SEARCH_TABLES)
def overfetch_floor(d):
    q = batch_queries(d, OS.overfetch_limit(F.col("lim")))
    hits = OS.search_pairs(q, d.search_table).drop("limit")
    asked = d.search_query.select("query_id", F.col("lim").alias("limit"))
    return OS.overfetch_floor(hits.join(asked, "query_id")).select(
        "query_id", "rank", "facility_id", "similarity", "score")


FIRST = """
    firsts AS (SELECT facility_id, string_agg(txt, ' • ' ORDER BY txt) AS t FROM (
      SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY txt) AS n FROM procedure_term)
      WHERE n <= 3 GROUP BY 1)"""


@query("default_reason", f"""WITH {FIRST}
    SELECT f.facility_id, coalesce(left(t, 220), name) AS match_reason
    FROM facility f LEFT JOIN firsts USING (facility_id)""", "facility procedure_term")
def default_reason(d):
    return OS.default_reason(d.facility.select("facility_id", "name"), d.procedure_term).select(
        "facility_id", "match_reason")


@query("search_facilities", f"""WITH {hits_sql()}, {FIRST}
    SELECT query_id, rank, h.facility_id, name, facility_type, operator_type, distance_km,
      similarity, score, coalesce(left(t, 220), name) AS match_reason, beds, num_doctors,
      official_phone, official_website, city, state, lat, lng
    FROM hits h LEFT JOIN firsts f ON f.facility_id=h.facility_id""", TABLES)
def search_facilities(d):
    return OS.search_facilities(batch_queries(d), d.search_table)


@query("search_facilities_all_located", f"""WITH {hits_sql(geo=False)}, {FIRST}
    SELECT query_id, rank, h.facility_id, distance_km, similarity, score,
      coalesce(left(t, 220), name) AS match_reason
    FROM hits h LEFT JOIN firsts f ON f.facility_id=h.facility_id""", TABLES)
def search_facilities_all_located(d):
    return OS.search_facilities(
        batch_queries(d), d.search_table, require_geo_valid=False).select("query_id", "rank", "facility_id", "distance_km",
                                        "similarity", "score", "match_reason")
