"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores.
Every query is run to the end of its result (``noop`` sink); planning and the
jobs a query starts by itself are part of its time.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from topicloom.plans.catalogue import QUERIES
from topicloom.session import build_session, release

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "filter_report_dates",
    "describe_columns",
    "drop_incomplete_rows",
    "tokenize_words",
    "tokenize_regex",
    "remove_stopwords",
    "stem_vocabulary",
    "stem_porter2",
    "ngrams",
    "vocab_frame",
    "doc_frequency",
    "vocab_cap",
    "tfidf",
    "tfidf_score_new",
    "string_index",
    "kmeans_fixed_init",
    "silhouette",
    "top_terms",
    "cluster_names",
    "nearest_to_center",
    "kmeans_tfidf",
    "topic_model",
    "landmark_mds",
    "svd_2d",
    "word2vec_vocab",
    "cosine_pairs",
)


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        "bench",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/documents.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for key in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        QUERIES[key](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        print(key, times[key], file=sys.stderr, flush=True)
        release(spark)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
