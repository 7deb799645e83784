from pyspark.sql import functions as F

from quernel.operators.quality import Rule, frequency_states
from quernel.sources.delimited import Field, parse_lines
from quernel.streaming.profile import keep_states, kept_states

RULES = (Rule("units_sold", low=0, high=20000), Rule("promotion_flag", allowed=(0, 1)))
SALES = "/root/testdata/sf0.001/fmcg_sales.parquet"


def states(df):
    return sorted(map(tuple, df.select("load_id", "column_name", "value", "n").collect()), key=str)


def test_states_of_arriving_loads_add_up(spark, tmp_path):
    sales = spark.read.parquet(SALES).select("load_id", "units_sold", "promotion_flag")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    parts = [sales.where(F.col("load_id") % 3 == i) for i in range(3)]
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        keep_states(spark.readStream.schema(sales.schema).parquet(source), "load_id", RULES, out, checkpoint).awaitTermination()
        so_far = parts[0] if i == 0 else parts[0].union(parts[1]) if i == 1 else sales
        assert states(kept_states(spark, "load_id", out)) == states(frequency_states(so_far, "load_id", RULES))


def test_lines_are_parsed_in_a_stream(spark, tmp_path):
    lines = spark.read.parquet("/root/testdata/sf0.001/brand_lines.parquet")
    lines.write.parquet(str(tmp_path / "in"))
    fields = (Field("brand"), Field("category"), Field("manufacturer", name_like=True), Field("launch_year", "int", 1900, 2024))
    parsed = parse_lines(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")), fields)
    query = parsed.writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("parsed").collect()), key=str) == sorted(map(tuple, parse_lines(lines, fields).collect()), key=str)
