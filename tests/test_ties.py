"""Rows that only the last bits of doubles part, against the SQL."""

from oracle import rows_of, sql_rows
from pyspark.sql import functions as F

from inkgraph.plans import catalog

SF = "/root/testdata/sf0.1"


def test_agent_lines_half_a_mean_apart(spark, tmp_path):
    """Pages on which a gap is just half the mean height, as copies of sf0.1 with shifted keys have them: the mean is summed in the order of the line."""
    part, supplier = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("part", "supplier"))
    sizes, names = [], []
    for copy, page in ((2, 223), (8, 802), (11, 1123), (17, 1702), (20, 2023), (44, 4415)):
        p, s = part.withColumn("p_partkey", F.col("p_partkey") + 20000 * copy), supplier.withColumn("s_suppkey", F.col("s_suppkey") + 1000 * copy)
        sizes.append(p.where(F.expr(f"p_partkey div 200 = {page}")))
        names.append(s.where(F.expr(f"s_suppkey div 10 = {page}")))
    for name, tables in (("part", sizes), ("supplier", names)):
        whole = tables[0]
        for t in tables[1:]:
            whole = whole.union(t)
        whole.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)
    # a folder per table is read by Spark; DuckDB gets its files
    sql = catalog.SQL["agent_lines"].replace("FROM part)", f"FROM '{sf}/part.parquet/*.parquet')").replace("FROM supplier)", f"FROM '{sf}/supplier.parquet/*.parquet')")
    assert rows_of(catalog.QUERIES["agent_lines"](spark, sf)) == sql_rows(sql, "/nowhere")


def test_stroke_bonds_of_equal_sides(spark, tmp_path):
    """Two pairs of sides in full ink: equally long ones whose lengths differ in the last bit, and one whose middle lies just at the longer's end."""
    part = spark.read.parquet(f"{SF}/part.parquet")
    some = part.where("p_partkey in (1934, 1950)").union(part.withColumn("p_partkey", F.col("p_partkey") + 20000).where("p_partkey in (36234, 36250)"))
    some.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    cells = spark.range(3600).select(F.explode(F.array(*[F.lit(k).cast("long") for k in (1900, 36200)])).alias("l_partkey"), (F.col("id") % 60).cast("double").alias("l_extendedprice"), F.lit(0).cast("long").alias("l_orderkey"), F.expr("cast(id div 60 AS int)").alias("l_linenumber"))
    cells.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    sql = catalog.SQL["stroke_bonds"].replace("FROM part)", f"FROM '{tmp_path}/part.parquet/*.parquet')").replace("FROM lineitem)", f"FROM '{tmp_path}/lineitem.parquet/*.parquet')")
    got = rows_of(catalog.QUERIES["stroke_bonds"](spark, str(tmp_path)))
    assert got == sql_rows(sql, "/nowhere") and len(got[1]) == 2
