"""One JSON line: seconds of the headline queries (median of three warm runs, fully evaluated)."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Queries over the driver's tables; "height_case" is the published workload on 100,000 generated rows.
NAMES = ("customer_profile", "expr_arith", "expr_case_bool", "agg_sum_count_avg", "agg_set_size", "lookup_join_implicit", "unit_bridge", "list_to_dict", "melt_prices")


def height_case(spark, rows=100_000):
    from specloom.plans.mapper import Mapper

    df = spark.range(rows).select(F.concat(F.lit("P:"), F.col("id")).alias("id"), F.struct((150 + F.col("id") % 100).cast("double").alias("value"), F.lit("cm").alias("unit")).alias("height"))
    spec = {"class_derivations": {"Agent": {"populated_from": "Person", "slot_derivations": {"id": None, "height_in_cm": {"expr": "case((height.unit == 'cm', height.value), (height.unit == 'm', height.value * 100))"}}}}}
    return Mapper(spec).transform(df, "Person")


def main():
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from specloom.queries import queries

    known, out = queries(), {}
    for name in (*NAMES, "height_case"):
        runs = []
        for k in range(4):
            began = time.time()
            df = height_case(spark) if name == "height_case" else known[name](spark, SF)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        out[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": SF, "rows_per_sec_height_case": round(100_000 / out["height_case"])}))


if __name__ == "__main__":
    main()
