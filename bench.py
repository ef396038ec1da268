"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data folder, BENCH_CPUS the local threads, BENCH_QUERIES a comma list.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from nearwell.operators.search import search_pairs, semantic_scan  # noqa: E402
from nearwell.plans.catalog import QUERIES  # noqa: E402
from nearwell.plans.catalog.search import batch_queries  # noqa: E402
from nearwell.plans.domain import SHARED, Domain  # noqa: E402
from nearwell.session import materialize  # noqa: E402

HEADLINE = [
    "dedupe_latest", "dedupe_first_seen", "explode_terms", "pin_defanout", "validate_internal",
    "final_geo_valid", "resolve_origin", "radius_search", "batch_embed", "semantic_scan",
    "search_facilities", "overfetch_floor", "lexical_evidence", "evidence_confidence",
    "facility_detail", "blocked_fuzzy_join", "best_match", "parse_registry_text", "carry_context",
    "emergency_flag", "number_turns", "archive_rollup", "upsert_items", "patch_items",
    "usage_rollup", "stream_idle_sessions", "stream_upsert",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    run(fn())
    return round(time.perf_counter() - start, 3)


def vector_scan(d) -> dict:
    """Seconds and vector dimensions per second of the exact scan and the hybrid search for
    batches of 1, 100 and 1000 queries; queries and vectors are read from files."""
    q = materialize(batch_queries(d), "bench-queries")
    vec = materialize(d.facility_vec, "bench-vectors")
    dims = vec.count() * 64
    out = {}
    for n in (1, 100, 1000):
        batch = materialize(q.orderBy("s_suppkey").limit(n), "bench-batch")
        run(semantic_scan(batch, vec, 10))  # warm, as the headline queries are
        have = batch.count()
        sec = timed(lambda: semantic_scan(batch, vec, 10))
        out[f"scan_{n}"] = {"sec": sec, "dims_per_sec": round(dims * have / sec)}
        out[f"hybrid_{n}"] = {"sec": timed(lambda: search_pairs(batch, d.search_table))}
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    d = Domain(spark, sf_dir)
    load = {}
    for name in [*sorted(SHARED), "search_table", "evidence_index"]:  # the load step: directory tables built once
        start = time.perf_counter()
        getattr(d, name).count()
        load[name] = round(time.perf_counter() - start, 3)
    times = {}
    for name in names.split(",") if names else HEADLINE:
        run(QUERIES[name](spark, sf_dir))  # warm the JVM, as a running service is
        times[name] = timed(lambda: QUERIES[name](spark, sf_dir))
    result = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
              "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1],
              "load_sec": load}
    if not names:
        result["vector"] = vector_scan(d)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
