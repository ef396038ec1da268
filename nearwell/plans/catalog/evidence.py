"""Text similarity, evidence, grounding, badges, facility detail."""

from pyspark.sql import functions as F

from nearwell.functions import messages as M
from nearwell.functions import similarity as S
from nearwell.operators import cleaning as OC
from nearwell.operators import evidence as OE
from nearwell.operators import search as OS
from nearwell.plans.catalog.base import (SEARCH_TABLES, TERM_TABLES, gram_sim, grams, hits_sql,
                                         query, suspect)
from nearwell.plans.catalog.registry import BEST, REGISTRY_TABLES, matched
from nearwell.plans.catalog.search import batch_queries
from nearwell.session import materialize

ALL = SEARCH_TABLES + " " + TERM_TABLES


@query("trigram_similarity", f"""
    WITH g AS (SELECT query_id, {grams('need')} AS a, {grams("'small ring repair'")} AS b
               FROM search_query)
    SELECT query_id, {gram_sim('a', 'b')} AS s FROM g""", "search_query")
def trigram_similarity(d):
    return d.search_query.select("query_id", S.trigram_similarity(
        F.col("need"), F.lit("small ring repair")).alias("s"))


@query("trigram_similarity_documents", f"""
    WITH g AS (SELECT doc_id, {grams('text')} AS a, {grams("lang || ' ' || source")} AS b FROM documents)
    SELECT doc_id, {gram_sim('a', 'b')} AS s FROM g""")
def trigram_similarity_documents(d):
    return d.base("documents").select("doc_id", S.trigram_similarity(
        F.col("text"), F.concat_ws(" ", "lang", "source")).alias("s"))


TERMS = """
    terms AS (SELECT facility_id, 'procedure' AS kind, txt FROM procedure_term
      UNION ALL SELECT facility_id, 'capability', txt FROM capability_term
      UNION ALL SELECT facility_id, 'specialty', txt FROM specialty_term)"""


def all_terms(d):
    return OE.union_terms(d.specialty_term, d.procedure_term, d.capability_term)


@query("union_terms", f"WITH {TERMS} SELECT * FROM terms", TERM_TABLES)
def union_terms(d):
    return all_terms(d)


@query("suspect_evidence_filter", f"""WITH {TERMS}
    SELECT t.* FROM terms t JOIN facility f USING (facility_id)
    WHERE NOT {suspect('f.name', 'txt')}""", "facility " + TERM_TABLES)
def suspect_evidence_filter(d):
    return OE.suspect_evidence_filter(all_terms(d), d.facility)


LEXICAL = f"""{hits_sql()}, {TERMS},
    best AS (SELECT * FROM (
      SELECT query_id, facility_id, kind, txt, s, row_number() OVER (
          PARTITION BY query_id, facility_id ORDER BY s DESC, txt, kind) AS rn
      FROM (SELECT h.query_id, h.facility_id, h.name, kind, txt,
              {gram_sim('gt', 'gq')} AS s
            FROM (SELECT *, {grams('need')} AS gq FROM hits) h
            JOIN (SELECT *, {grams('txt')} AS gt FROM terms WHERE facility_id IN
                  (SELECT facility_id FROM hits)) t ON t.facility_id=h.facility_id)
      WHERE s::double > 0.12 AND NOT {suspect('name', 'txt')}) WHERE rn <= 3),
    lexical AS (SELECT query_id, facility_id, string_agg(txt, ' • ' ORDER BY rn) AS reason
      FROM best GROUP BY ALL)"""
WEAK = f"""{LEXICAL},
    weak AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM lexical l
      WHERE l.query_id=h.query_id AND l.facility_id=h.facility_id))"""


def hits_with_need(d, need=None):
    """The ranked hits, written once: every step of the evidence reads them again."""
    hits = OS.search_pairs(batch_queries(d), d.search_table)
    named = (hits.join(d.search_query.select("query_id", "need"), "query_id")
             .join(d.facility.select("facility_id", "name"), "facility_id"))
    return materialize(named if need is None else named.withColumn("need", need), "hits")


@query("lexical_evidence", f"WITH {LEXICAL} SELECT * FROM lexical", ALL)
def lexical_evidence(d):
    return OE.lexical_evidence(hits_with_need(d), d.evidence_index)


def odd_hits(d):
    """Every other need is unlike any listed term, so that some hits stay weak."""
    return hits_with_need(d, F.when(F.col("query_id").cast("int") % 2 == 0, "zzz qqq").otherwise(F.col("need")))


ODD_WEAK = WEAK.replace(
    "SELECT q.query_id, q.need,",
    "SELECT q.query_id, CASE WHEN s_suppkey % 2 = 0 THEN 'zzz qqq' ELSE q.need END AS need,")


def weak_of(d):
    hits = odd_hits(d)
    return materialize(OE.weak_hits(hits, OE.lexical_evidence(hits, d.evidence_index)), "weak")


@query("weak_hits", f"WITH {ODD_WEAK} SELECT query_id, facility_id, need FROM weak", ALL)
def weak_hits(d):
    return weak_of(d).select("query_id", "facility_id", "need")


CANDIDATES = f"""
    cand AS (SELECT facility_id, cast(rn AS int) AS rn, txt FROM (
      SELECT t.facility_id, txt, row_number() OVER (PARTITION BY t.facility_id
        ORDER BY length(txt), txt) AS rn
      FROM (SELECT DISTINCT facility_id, txt FROM terms) t
      JOIN facility f ON f.facility_id=t.facility_id
      WHERE NOT {suspect('f.name', 'txt')}
        AND t.facility_id IN (SELECT facility_id FROM weak)) WHERE rn <= 12)"""


@query("grounding_candidates", f"WITH {ODD_WEAK}, {CANDIDATES} SELECT * FROM cand", ALL)
def grounding_candidates(d):
    return OE.grounding_candidates(weak_of(d), d.evidence_index)


@query("grounding_requests", f"""WITH {ODD_WEAK}, {CANDIDATES},
    lists AS (SELECT facility_id, '"' || facility_id || '":' ||
        '["' || string_agg(txt, '","' ORDER BY rn) || '"]' AS t FROM cand GROUP BY 1)
    SELECT query_id, 'need="' || need || '"' || chr(10) || '{{' || coalesce(string_agg(t, ','
      ORDER BY facility_id), '') || '}}' AS prompt
    FROM weak LEFT JOIN lists USING (facility_id) GROUP BY query_id, need""", ALL)
def grounding_requests(d):
    weak = weak_of(d)
    cands = OE.grounding_candidates(weak, d.evidence_index)
    return OE.grounding_requests(weak, cands).select("query_id", "prompt")


@query("extract_json_object", """
    WITH s AS (SELECT query_id, regexp_extract(reply, '(?s)\\{.*\\}', 0) AS span FROM answer)
    SELECT query_id, CASE WHEN json_valid(span) THEN json_extract_string(span, '$.summary') END
      AS summary FROM s""", "answer")
def extract_json_object(d):
    obj = M.extract_json_object(F.col("reply"), "summary string, reasons array<string>")
    return d.answer.select("query_id", obj.alias("o")).select("query_id", "o.summary")


GROUNDED = f"""{ODD_WEAK},
    rep AS (SELECT query_id, regexp_extract(reply, '(?s)\\{{.*\\}}', 0) AS span
            FROM grounding_reply),
    svc AS (SELECT w.query_id, w.facility_id, w.need, CASE WHEN json_valid(span) THEN
        list_filter(from_json(json_extract(span, '$."' || w.facility_id || '"'), '["VARCHAR"]'),
          lambda x: x <> '')[1:3] END AS s FROM weak w LEFT JOIN rep USING (query_id)),
    grounded AS (SELECT query_id, facility_id, CASE WHEN len(s) > 0 THEN array_to_string(s, ' • ')
      ELSE 'No specific “' || need || '” service is listed — matched on the facility''s overall profile'
      END AS reason, coalesce(len(s), 0) = 0 AS weak FROM svc)"""


@query("merge_grounding", f"WITH {GROUNDED} SELECT * FROM grounded", ALL + " grounding_reply")
def merge_grounding(d):
    return OE.merge_grounding(weak_of(d), d.grounding_reply)


@query("evidence_confidence", f"""WITH {GROUNDED}
    SELECT h.query_id, h.rank, h.facility_id,
      coalesce(l.reason, g.reason, h.name) AS match_reason,
      CASE WHEN l.reason IS NOT NULL OR NOT coalesce(g.weak, true) THEN 'listed' ELSE 'weak' END
        AS evidence_confidence
    FROM hits h LEFT JOIN lexical l USING (query_id, facility_id)
    LEFT JOIN grounded g USING (query_id, facility_id)""", ALL + " grounding_reply")
def evidence_confidence(d):
    hits = odd_hits(d)
    lexical = materialize(OE.lexical_evidence(hits, d.evidence_index), "lexical")
    grounded = OE.merge_grounding(OE.weak_hits(hits, lexical), d.grounding_reply)
    named = hits.withColumn("match_reason", F.col("name"))
    return OE.evidence_confidence(named, lexical, grounded).select(
        "query_id", "rank", "facility_id", "match_reason", "evidence_confidence")


@query("verification_badge", f"""WITH {BEST}
    SELECT f.facility_id, f.name, m.source IS NOT NULL AS verified, m.source AS verified_source
    FROM facility f LEFT JOIN best m ON m.facility_id=f.facility_id""", REGISTRY_TABLES)
def verification_badge(d):
    return OE.verification_badge(d.facility.select("facility_id", "name"), matched(d))


def _children(d):
    ids = d.bronze_all.withColumn("unique_id", F.col("c_custkey").cast("string"))
    return OC.explode_source_urls(ids), OC.explode_phones(ids)


def _list(table, value="txt"):
    return (f"(SELECT facility_id, string_agg({value}, '|' ORDER BY {value}) AS l "
            f"FROM {table} GROUP BY 1)")


@query("facility_detail", f"""
    WITH raw AS (SELECT cast(c_custkey AS varchar) AS facility_id, officialPhone, phone_numbers,
        source_urls FROM bronze_all),
    urls AS (SELECT DISTINCT facility_id, val FROM (SELECT facility_id,
        unnest(from_json(source_urls, '["VARCHAR"]')) AS val FROM raw) WHERE trim(val) <> ''),
    phones AS (SELECT facility_id, val, bool_or(val=officialPhone) AS o FROM (SELECT facility_id,
        officialPhone, unnest(from_json(phone_numbers, '["VARCHAR"]')) AS val FROM raw)
        WHERE trim(val) <> '' GROUP BY ALL)
    SELECT f.facility_id, f.name, 0 AS part, 1 AS parts, coalesce(s.l,'') AS specialties,
      coalesce(p.l,'') AS procedures, coalesce(c.l,'') AS capabilities, coalesce(u.l,'') AS urls,
      coalesce(h.l,'') AS phones
    FROM facility f LEFT JOIN {_list('specialty_term')} s USING (facility_id)
    LEFT JOIN {_list('procedure_term')} p USING (facility_id)
    LEFT JOIN {_list('capability_term')} c USING (facility_id)
    LEFT JOIN {_list('urls', 'val')} u USING (facility_id)
    LEFT JOIN {_list('phones', "val || '/' || coalesce(cast(o AS varchar), '?')")} h
      USING (facility_id)""", "facility bronze_all " + TERM_TABLES)
def facility_detail(d):
    urls, phones = _children(d)
    out = OE.facility_detail(d.facility, d.specialty_term, d.procedure_term, d.capability_term,
                             urls, phones)

    def text(c):
        return F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)

    phone = F.transform("phones", lambda p: F.concat(
        p["phone"], F.lit("/"), F.coalesce(p["is_official"].cast("string"), F.lit("?"))))
    return out.select("facility_id", "name", "part", "parts", text("specialties"),
                      text("procedures"), text("capabilities"),
                      F.coalesce(F.array_join("source_urls", "|"), F.lit("")).alias("urls"),
                      F.coalesce(F.array_join(phone, "|"), F.lit("")).alias("phones"))
