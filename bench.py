"""Times of the headline runs, as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
Every query runs twice in one session; "queries" holds the second run, "first_run" the first one,
which also pays for starting the JVM's compilers. "value" is the time of fit and compare together.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import Monitor, Settings
from tidemark.operators import categories, curves, quantiles, schema_diff
from tidemark.sources.shared import shared_folder
from tidemark.sources.tables import read_csv

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus", "l_linenumber"]
SETTINGS = Settings(
    numeric_features=NUMERIC,
    categorical_features=CATEGORICAL,
    n_bins=10,
    categorical_top_k=20,
    relative_error=0.05,
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "/tmp/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    reference = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    current = reference.withColumn("l_extendedprice", F.col("l_extendedprice") * 1.3)
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")

    csv = f"{shared_folder(spark)}/bench-lineitem-csv-{time.time_ns()}"
    reference.select(*NUMERIC, *CATEGORICAL).write.csv(csv, header=True)

    fitted = Monitor(SETTINGS, spark)

    def csv_fit() -> None:
        with Monitor(replace(SETTINGS, copy_watched=True), spark) as monitor:
            monitor.fit(read_csv(spark, csv))

    queries = {
        "fit": lambda: fitted.fit(reference),
        "compare": lambda: fitted.compare(current).dataset_summary.collect(),
        "csv_fit": csv_fit,
        "column_quality": lambda: run(schema_diff.column_quality(reference, current)),
        "new_categories": lambda: run(categories.new_categories(reference, current, CATEGORICAL)),
        "exact_quantiles": lambda: run(quantiles.exact_quantiles(reference, NUMERIC, 10)),
        "ks_exact": lambda: run(curves.ks_exact(reference, current, "l_extendedprice")),
        "ecdf": lambda: run(curves.ecdf(orders, "o_totalprice")),
        "density_histogram": lambda: run(curves.density_histogram(reference, "l_extendedprice")),
        "kde_curve": lambda: run(curves.density_curve(reference, "l_extendedprice")),
    }

    def seconds(query) -> float:
        started = time.perf_counter()
        query()
        return round(time.perf_counter() - started, 3)

    first = {name: seconds(query) for name, query in queries.items()}
    second = {name: seconds(query) for name, query in queries.items()}
    print(
        json.dumps(
            {
                "metric": "fit and compare, lineitem, 7 columns",
                "value": round(second["fit"] + second["compare"], 3),
                "unit": "sec",
                "queries": second,
                "first_run": first,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
