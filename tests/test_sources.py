"""Sources and sinks: typed CSV, null tokens, header repair, year files, gzip."""

import os

from pyspark.sql import functions as F

from provguard.sources import csv as CSV
from provguard.sources import sinks


def test_schema_from_codes():
    st = CSV.schema_from_codes("ccdi", ["a", "b", "c", "d"])
    assert [f.dataType.simpleString() for f in st.fields] == ["string", "string", "double", "bigint"]
    assert len(CSV.schema_from_codes("c", ["a", "b", "c"]).fields) == 3
    m = CSV.schema_from_map({"npi": "character", "n": "integer", "x": "numeric"})
    assert [f.dataType.simpleString() for f in m.fields] == ["string", "bigint", "double"]


def test_snake_names():
    assert CSV.snake_name("L_OrderKey") == "l_order_key"
    assert CSV.snake_name("Date of Suspension") == "date_of_suspension"
    assert CSV.snake_name("A.K.A.(also known as)") == "a_k_a_also_known_as"
    assert CSV.snake_name("Rndrng_NPI") == "rndrng_npi"
    assert CSV.snake_name("discount%") == "discount_percent"
    assert CSV.snake_name("# of claims") == "number_of_claims"
    assert CSV.snake_name("Provider's Name") == "providers_name"
    assert CSV.snake_name("Café 2") == "cafe_2"
    assert CSV.unique_names(["a_b", "a_b", "a_b_2"]) == ["a_b", "a_b_2", "a_b_2_2"]


def test_repair_headers_dedupes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Tax` int, `tax ` int, `Ship Date` int")
    assert CSV.repair_headers(df, "snake").columns == ["tax", "tax_2", "ship_date"]
    assert CSV.repair_headers(df, "lower").columns == ["tax", "tax ", "ship date"]


def test_typed_csv_roundtrip_with_tokens(spark, tmp_base):
    path = os.path.join(tmp_base, "typed")
    df = spark.createDataFrame([("A", "00000000", 1.5), ("B", "", 2.0), ("C", "0", None)],
                               "NAME string, Code string, x double")
    sinks.write_csv(df, path)
    st = CSV.schema_from_codes("ccd", ["NAME", "Code", "x"])
    back = CSV.read_csv(spark, path, schema=st, headers="lower",
                        null_tokens=["00000000", "0", ""])
    assert back.columns == ["name", "code", "x"]
    got = sorted((r.name, r.code, r.x) for r in back.collect())
    assert got == [("A", None, 1.5), ("B", None, 2.0), ("C", None, None)]
    pruned = CSV.read_csv(spark, path, schema=st, columns=["x"], limit=2)
    assert pruned.columns == ["x"] and pruned.count() == 2


def test_year_files_one_scan(spark, tmp_base):
    paths = []
    for y in (2019, 2020, 2021):
        p = os.path.join(tmp_base, f"claims_{y}")
        sinks.write_csv(spark.createDataFrame([(str(y), 1.0)] * (y - 2018), "npi string, v double"), p)
        paths.append(p)
    st = CSV.schema_from_codes("cd", ["npi", "v"])
    df = CSV.read_year_files(spark, paths, st, r"claims_(\d{4})", named="folder")
    got = {r.year: r.n for r in df.groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {2019: 1, 2020: 2, 2021: 3}
    folder = os.path.join(tmp_base, "2023-08-dump")
    os.makedirs(folder)
    for y, n in ((2020, 1), (2021, 2)):  # the year is in the file's name, not the folder's
        with open(os.path.join(folder, f"Medicare_9999_{y}.csv"), "w") as f:
            f.write("npi,v\n" + "1,2.0\n" * n)
    df = CSV.read_year_files(spark, [folder], st)
    assert {r.year: r["count"] for r in df.groupBy("year").count().collect()} == {2020: 1, 2021: 2}


def test_typed_map_persist_and_inferred_scan(spark, tmp_base):
    p = os.path.join(tmp_base, "typed")
    sinks.write_csv(spark.createDataFrame([("007", 1, 1.5, None), ("8", 2, None, "x")], "npi string, n int, v double, t string"), p)
    typed = CSV.read_csv(spark, p, schema=CSV.schema_from_map({"npi": "character", "n": "integer", "v": "numeric", "t": "character"}), persist=True)
    assert typed.is_cached and sorted(map(tuple, typed.collect()), key=str) == [("007", 1, 1.5, None), ("8", 2, None, "x")]
    typed.unpersist()
    guessed = CSV.read_csv(spark, p, infer=True)
    assert [t for _, t in guessed.dtypes] == ["int", "int", "double", "string"]


def test_gzip_and_stack(spark, tmp_base):
    p = os.path.join(tmp_base, "gz")
    df = spark.range(100).selectExpr("cast(id as string) as k", "id * 1.0 as v")
    sinks.write_csv(df, p, compression="gzip")
    assert any(f.endswith(".gz") for f in os.listdir(p))
    back = CSV.read_gzip_csv(spark, p, df.schema, partitions=4)
    assert back.count() == 100 and back.rdd.getNumPartitions() == 4
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2,)], "a int")
    st = CSV.stack_frames({2020: a, 2021: b})
    assert sorted((r.a, r.b, r.year) for r in st.collect()) == [(1, "x", 2020), (2, None, 2021)]


def test_schema_table_and_roundtrip(spark):
    df = spark.createDataFrame([(1, "a")], "n bigint, s string")
    rows = {r.column: r.type for r in CSV.schema_table(spark, df).collect()}
    assert rows == {"n": "bigint", "s": "string"}
    back = sinks.roundtrip_parquet(spark, df, "rt")
    assert back.collect() == df.collect()
    m = sinks.materialise(df, "pg_test_view")
    assert spark.table("pg_test_view").count() == 1
    m.unpersist()
