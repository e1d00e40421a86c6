"""Sources and sinks: what is written in one form is read back and summed up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.plans.profiling import rounded
from brindle.sources import tables as src
from brindle.sources.tables import table


def shared(s, purpose):
    root = s.conf.get("spark.checkpoint.dir", None) or f"{s.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{root.rstrip('/')}/brindle-{purpose}-{uuid.uuid4().hex}"


def csv_files(s, d):
    """Two tables as CSV folders named by their table, read back as views."""
    folder = shared(s, "csv")
    for name in ("customer", "nation"):
        src.write_result(table(s, d, name), f"{folder}/{name}.csv")
    found = src.csv_tables(s, folder, ["customer", "nation"])
    return rounded(found["customer"].join(found["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance")), 4)


def csv_names(s, d):
    """Every CSV of a folder, whatever it is called, with its rows and columns."""
    folder = shared(s, "csv")
    for name in ("region", "nation", "supplier"):
        src.write_result(table(s, d, name), f"{folder}/{name}.csv")
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")) for name, df in src.csv_tables(s, folder).items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def log(s, d):
    """Records appended to a JSON log in two goes."""
    path, o = shared(s, "log"), table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    src.append_log(o.where("o_orderkey % 2 = 0"), path)
    src.append_log(o.where("o_orderkey % 2 = 1"), path)
    return rounded(src.read_log(s, path, "o_orderkey long, o_orderstatus string, o_totalprice double").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 4)


def temporary(s, d):
    name = f"kept_{uuid.uuid4().hex}"
    src.materialise(table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n")), name)
    return rounded(s.sql(f"SELECT l_returnflag, sum(quantity) AS quantity, sum(n) AS n FROM {name} GROUP BY 1"), 4)


QUERIES = {
    "src1_csv_tables": (csv_files, "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "src2_csv_names": (
        csv_names,
        """SELECT 'region' AS "table", count(*) AS n_rows, 2 AS n_columns FROM region UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'supplier', count(*), 4 FROM supplier""",
    ),
    "snk2_json_log": (log, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 4) AS total FROM orders GROUP BY 1"),
    "snk3_materialised": (temporary, "SELECT l_returnflag, round(sum(l_quantity), 4) AS quantity, count(*) AS n FROM lineitem GROUP BY 1"),
}
