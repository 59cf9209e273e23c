"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is
run to its last row twice in one session: ``queries`` and ``value`` hold the second
times, ``first_run`` the first ones, which include the start of JVM and workers.
"""

from __future__ import annotations

import json
import os
import time

from pairwell.session import local_session
from table_queries import QUERIES

HEADLINES = [
    "hybrid_match",
    "bm25_topk",
    "lsh_topk",
    "skill_jaccard_exact",
    "vector_topk",
    "minhash_signature",
    "hash_embed",
    "corpus_stats",
    "clean_posting",
    "decode_rejects",
    "url_frontier",
    "page_fields",
    "profile_extract",
    "latest_postings",
    "publish_json",
    "stream_enrich",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    first, times = {}, {}
    for run in (first, times):
        for name in HEADLINES:
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            run[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(cores),
                "first_run": first,
            }
        )
    )


if __name__ == "__main__":
    main()
