"""Runs the 43 queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: each once cold and twice warm; reports the better warm time."""

import json
import os
import shutil
import time
from pathlib import Path

from tidemill.plans.clickbench import PLANS, build_query
from tidemill.plans.hits import hits
from tidemill.session import session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session(f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    store = f"/tmp/tidemill-bench-{os.getpid()}/hits.parquet"
    began = time.perf_counter()
    hits(spark, sf_dir).write.mode("overwrite").parquet(store)  # queries read a table, as they would
    convert = time.perf_counter() - began
    table = spark.read.parquet(store)
    cold, warm = {}, {}
    for k in PLANS:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            build_query(table, k).collect()
            took.append(time.perf_counter() - began)
        cold[f"q{k}"], warm[f"q{k}"] = round(took[0], 4), round(min(took[1:]), 4)
    print(json.dumps({"metric": "hits_43_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold, "write_hits_sec": round(convert, 3), "sf": Path(sf_dir).name, "cpus": cpus}))
    spark.stop()
    shutil.rmtree(os.path.dirname(store), ignore_errors=True)


if __name__ == "__main__":
    main()
