"""Benchmark: full recompute with plain DataFrames, then drains after changes of several sizes. Prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluice.plans.model import Join, Node, Reduce, Side, Union
from sluice.queries import LINES, ORDER_LEAF, lineitem, orders
from sluice.runtime.engine import Engine


def nodes() -> list[Node]:
    """Lines to order totals to customer totals; a join of two nodes; a union."""
    totals = Node("line_totals", "l_orderkey long, qty long, cents long", ("l_orderkey",), Reduce("lines", "l_orderkey", {"sum": ["qty", "cents"]}))
    values = Node("order_values", "key string, o_custkey long, cents long", ("key",), Join(Side("o_orderkey"), Side("l_orderkey"), {"left": ["o_custkey"], "right": ["cents"]}, left_over="orders", right_over="line_totals"))
    customers = Node("customers", "o_custkey long, n long, cents long", ("o_custkey",), Reduce("order_values", "o_custkey", {"count": "n", "sum": ["cents"]}))
    flags = Node("flags", "l_returnflag string, l_linestatus string, n long, cents long", ("l_returnflag", "l_linestatus"), Reduce("lines", ["l_returnflag", "l_linestatus"], {"count": "n", "sum": ["cents"]}))
    every = Node("every", "k string, cell string, cents long", ("k",), Union(["customers", "flags"], {"cell": "cell", "cents": "cents"}))
    return [LINES, ORDER_LEAF, totals, values, customers, flags, every]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    root, took, facts = tempfile.mkdtemp(prefix="sluice-bench-"), {}, {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        took[name] = round(time.perf_counter() - began, 2)
        return out

    lines = lineitem(spark, sf_dir)
    lines.write.parquet(f"{root}/lines")
    lines = spark.read.parquet(f"{root}/lines")
    order = orders(spark, sf_dir)

    def plain():
        per = lines.groupBy("l_orderkey").agg(F.sum("cents").alias("cents"), F.sum("qty").alias("qty"))
        values = order.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", per["cents"])
        customers = values.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
        flags = lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
        every = customers.select(F.col("o_custkey").cast("string").alias("k"), "cents").unionByName(flags.select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("k"), "cents"))
        for name, df in (("per", per), ("values", values), ("customers", customers), ("flags", flags), ("every", every)):
            df.write.parquet(f"{root}/plain/{name}")

    timed("plain_recompute_first", plain)
    shutil.rmtree(f"{root}/plain")
    timed("plain_recompute", plain)
    engine = Engine(spark, nodes(), f"{root}/state", trace=0)
    drain = lambda: engine.drain(workers=4)
    timed("leaf_write", lambda: (engine.write("lines", lines), engine.write("orders", order)))
    timed("seed_drain", drain)
    for name, n in (("0.1pct", 1000), ("1pct", 100), ("10pct", 10)):
        touched = lines.where(F.col("l_orderkey") % n == 3).withColumn("cents", F.col("cents") + n)
        timed(f"write_{name}", lambda touched=touched: engine.write("lines", touched))
        report = timed(f"drain_{name}", drain)
        facts[f"changed_{name}"] = {s.cell: s.changed_count for s in report.steps}
    rows = lines.where(F.col("l_orderkey") % 1000 == 3).withColumn("l_linenumber", F.col("l_linenumber")).select([f.name for f in LINES.schema])
    timed("noop_write", lambda: engine.write("lines", engine.table("lines").join(rows.select("l_orderkey").distinct(), "l_orderkey", "left_semi").select(rows.columns)))
    facts["noop_steps"] = len(timed("noop_drain", drain).steps)
    shutil.rmtree(root, ignore_errors=True)
    headline = round(took["seed_drain"] + took["drain_0.1pct"] + took["drain_1pct"] + took["drain_10pct"], 2)
    print(json.dumps({"metric": "seed drain and drains after 0.1, 1 and 10 % of keys", "value": headline, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "facts": facts}))


if __name__ == "__main__":
    main()
