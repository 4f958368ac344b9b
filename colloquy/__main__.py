"""``python -m colloquy QUERY FOLDER OUTPUT``: run a query over a folder of tables and write its rows as Parquet."""

import argparse

from pyspark.sql import SparkSession

from . import catalog, ship


def main() -> None:
    p = argparse.ArgumentParser(prog="colloquy", description=__doc__)
    p.add_argument("query", choices=sorted(catalog.QUERIES))
    p.add_argument("folder")
    p.add_argument("output")
    a = p.parse_args()
    spark = SparkSession.builder.appName(f"colloquy-{a.query}").getOrCreate()
    ship(spark)
    catalog.QUERIES[a.query](spark, a.folder).write.mode("overwrite").parquet(a.output)
    spark.stop()


if __name__ == "__main__":
    main()
