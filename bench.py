"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS (timed runs after one warm-up, median taken)
come from the environment.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import all_queries  # noqa: E402
from stormlake.session import build_session  # noqa: E402

HEADLINE = (
    "bulletin_scan", "bulletin_parse", "observation_typed", "dedup_latest", "document_table",
    "upsert", "change_feed", "raw_archive", "bulletin_stream", "embed_text", "embedding_sync",
    "similarity_topk", "similarity_ann", "question_parse", "retrieve_range", "retrieve_batch",
    "retrieve_fallback", "context_assembly", "answer_batch", "section_clean",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
        # a few megabytes per table: spread them over the cores
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4m",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed = []
        for _ in range(runs + 1):
            begun = time.perf_counter()
            all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timed.append(time.perf_counter() - begun)
        seconds[name] = round(statistics.median(timed[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
