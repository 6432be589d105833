from concurrent.futures import ThreadPoolExecutor

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scenlens.constants import FOOD_GROUPS, GWP, REGIONS
from scenlens.plans.nutrition import calorie_needs
from scenlens.sinks import chart_table, map_table, report_table, write_report, write_table
from scenlens.sources import (
    Project,
    code_list,
    food_groups,
    gwp,
    policy_caps,
    policy_targets,
    read_csv,
    read_csv_after,
    read_sheets,
    read_wide_years,
    region_map,
    shared_folder,
    with_code_list,
)
from scenlens.sources.project import _index
from tests.helpers import message_of, one, rows, table


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv_with_sentinel_and_byte_order_mark(spark, tmp_path):
    path = write(tmp_path / "a.csv", "iso,year,gini\nabw,2015,#N/A\nafg,2015,29.5\n", "utf-8-sig")
    assert rows(read_csv(spark, path, "iso string, year int, gini double")) == [("abw", 2015, None), ("afg", 2015, 29.5)]


def test_csv_after_preamble(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'free text\nMODEL,X2010,X2015\n"m, 1",1.5,#N/A\nn,2,3\n')
    assert rows(read_csv_after(spark, path, "model string, X2010 double, X2015 double", 1)) == [("m, 1", 1.5, None), ("n", 2.0, 3.0)]


def test_code_list_skips_comment_lines(spark, tmp_path):
    path = write(tmp_path / "c.csv", "# File: x\n# Units: NA\niso,country_name,r3,id\nrom,Romania,EU,12\nrou,Romania,EU,12\n")
    codes = code_list(spark, path)
    assert rows(codes) == [("rom", "Romania", "EU", 12), ("rou", "Romania", "EU", 12)]
    left = table(spark, [("rou", 1), ("zzz", 2)], "iso string, n int")
    assert set(rows(with_code_list(left, codes).select("iso", "country_name"))) == {("rou", "Romania"), ("zzz", None)}


def test_columns_are_found_by_name(spark, tmp_path):
    path = write(tmp_path / "t.csv", "region,year,value,sce,Units\nUSA,2030,5,NDC,Mt\n")
    assert one(policy_targets(spark, path)) == ("NDC", "USA", 2030, "Mt", 5.0)
    with pytest.raises(ValueError, match="lacks"):
        read_csv(spark, path, "region string, nothing int")


@pytest.mark.parametrize("line", ["a,1.234x", "a", "a,1,2"])
def test_bad_lines_fail(spark, tmp_path, line):
    path = write(tmp_path / "b.csv", f"k,v\nx,1\n{line}\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_csv(spark, path, "k string, v double").collect()
    after = write(tmp_path / "c.csv", f"text\nk,v\nx,1\n{line}\n")
    message_of(read_csv_after(spark, after, "k string, v double", 1))


def test_data_line_equal_to_a_front_line_stays(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\nname,v\na,b\nx,1\nname,v\ny,2\n")
    assert rows(read_csv_after(spark, path, "name string, v string", 1)) == [("a", "b"), ("name", "v"), ("x", "1"), ("y", "2")]


def test_front_lines_of_every_file_go(spark, tmp_path):
    for name in ("one", "two"):
        write(tmp_path / f"{name}.txt", f"free text\n\nv,k\n1,{name}\nNA,free text\n")
    got = rows(read_csv_after(spark, str(tmp_path), "k string, v int", 1))
    assert got == [("free text", None), ("free text", None), ("one", 1), ("two", 1)]


def test_targets_with_comma_in_label(spark, tmp_path):
    path = write(tmp_path / "t.csv", '"sce","region","year","Units","value"\n"NDC,date=2023-27-10","A","2020","Mt",-1.5\n')
    assert one(policy_targets(spark, path)) == ("NDC,date=2023-27-10", "A", 2020, "Mt", -1.5)


def test_nested_caps(spark, tmp_path):
    path = write(tmp_path / "caps.xml", """<scenario><world>
      <region name="A"><ghgpolicy name="GHG"><market>A</market>
        <constraint year="2020">5.5</constraint><constraint year="2025">4</constraint></ghgpolicy></region>
      <!-- <region name="C"><ghgpolicy name="GHG"><market>C</market><constraint year="2020">1</constraint></ghgpolicy></region> -->
      <region name="B"><ghgpolicy name="GHG"><market>m</market><constraint year="2050">0</constraint></ghgpolicy></region>
      </world></scenario>""")
    assert rows(policy_caps(spark, path)) == [
        ("A", "A", "GHG", 2020, 5.5), ("A", "A", "GHG", 2025, 4.0), ("B", "m", "GHG", 2050, 0.0)]


def test_wide_years_with_and_without_prefix(spark):
    df = table(spark, [("a", 1.0, None)], "k string, X2020 double, `2025` double")
    assert rows(read_wide_years(df, ["k"])) == [("a", 2020, 1.0), ("a", 2025, None)]


def test_unknown_wide_columns_fail(spark):
    with pytest.raises(ValueError, match="y2030"):
        read_wide_years(table(spark, [("a", 1.0, 2.0)], "k string, `2025` double, y2030 double"), ["k"])


def test_region_without_caps_stays(spark, tmp_path):
    path = write(tmp_path / "caps.xml", """<world><region name="A"><ghgpolicy name="GHG"><market>A</market></ghgpolicy></region>
      <region name="B"><ghgpolicy name="GHG"><market>m</market><constraint year="2050">0</constraint></ghgpolicy></region></world>""")
    assert set(rows(policy_caps(spark, path))) == {("A", "A", "GHG", None, None), ("B", "m", "GHG", 2050, 0.0)}


def test_sheets(spark, tmp_path):
    paths = {"CO2": write(tmp_path / "co2.csv", "r,v\nA,1\n"), "target": write(tmp_path / "t.csv", "r,y\nA,2\n")}
    book = read_sheets(spark, paths, {"CO2": "r string, v double", "target": "r string, y int"})
    assert one(book["CO2"]) == ("A", 1.0) and one(book["target"]) == ("A", 2)


def test_dimensions(spark):
    assert region_map(spark).count() == len(REGIONS) == 32
    assert region_map(spark).select("region_agg").distinct().count() == 18
    assert gwp(spark).count() == len(GWP) == 14
    assert food_groups(spark).count() == len(FOOD_GROUPS) == 21


def test_project_by_parquet(spark, tmp_path):
    root = str(tmp_path / "project")
    first = table(spark, [("s", 2020, 1.0)], "scenario string, year int, value double")
    Project.save(first, root, "food demand")
    Project.save(first.withColumn("value", F.lit(2.0)), root, "food demand")
    Project.save(first.withColumn("scenario", F.lit("t")), root, "CO2 prices (all)")
    prj = Project.from_parquet(spark, root)
    assert prj.names() == ["CO2 prices (all)", "food demand"]
    assert one(prj.query("food demand").select("value")) == 2.0
    assert rows(prj.scenarios()) == [("s",), ("t",)]
    with pytest.raises(KeyError):
        prj.query("nothing")
    with pytest.raises(ValueError):
        prj.query("food demand", "region")


def test_project_tidies_headers(spark):
    raw = table(spark, [("s", "resid_d1", "USA", 2.0)], "scenario string, `model-consumer` string, `cost...3` string, `cost...4` double")
    assert Project({"x": lambda: raw}).query("x", "consumer", "cost_3").columns == ["scenario", "consumer", "cost_3", "cost_4"]


def test_project_by_catalog(spark, tmp_path):
    rows_ = table(spark, [("s", 2020, 1.0)], "scenario string, year int, value double")
    rows_.write.mode("overwrite").option("path", str(tmp_path / "t")).saveAsTable("scenlens_test_query")
    try:
        prj = Project.from_catalog(spark, "default", {"some query": "scenlens_test_query", "absent": "no_such_table"})
        assert prj.names() == ["some query"]
        assert one(prj.query("some query").select("value")) == 1.0
    finally:
        spark.sql("DROP TABLE scenlens_test_query")


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_report_and_table_sinks(spark, tmp_path):
    df = table(spark, [("a", 1.5), ("b", None)], "k string, v double")
    write_report(df, str(tmp_path / "r"), one_file=True)
    (part,) = list((tmp_path / "r").glob("*.csv"))
    assert sorted(part.read_text().splitlines()) == ["a,1.5", "b,NA", "k,v"]
    write_table(df, str(tmp_path / "t"), ["k"])
    assert set(rows(spark.read.parquet(str(tmp_path / "t")).select("k", "v"))) == {("a", 1.5), ("b", None)}


def test_report_table_texts(spark):
    df = table(spark, [("r", 15.4, 62.44, 10.0)], "region string, Baseline double, `%Diff` double, `%Whole` double")
    assert one(report_table(df, {"Baseline": 0}, {"%Diff": 1, "%Whole": 1})) == ("r", 15.0, "62.4%", "10%")


def test_chart_and_map_tables(spark):
    df = table(spark, [("x", "s", 1.0), ("?", "s", 2.0)], "sector string, region string, total double")
    assert set(rows(chart_table(df, {"sector": ("y", "x")}).select("sector", "sector_level"))) == {("x", 2), ("?", None)}
    assert map_table(df, "region", "total", row="sector").columns == ["row", "subRegion", "value"]


def test_calorie_needs_file(spark, tmp_path):
    path = write(tmp_path / "needs.csv", "variable,unit,mder,std,min,max\nPopulation|Male|Aged0-4,kcal/day,1108.5,0,1100,1200\n", "utf-8-sig")
    assert one(calorie_needs(spark, path)) == ("Population|Male|Aged0-4", "kcal/capita/day", 1108.5, 0.0, 1100.0, 1200.0)


def test_front_lines_are_counted_in_every_file_in_one_scan(spark, tmp_path):
    blank = "\n" * 3000
    for i in range(6):
        data = "".join(f"{i},{j}\n" + ("note, kept\n" if j == 5 else "") for j in range(400))
        (tmp_path / f"{i}.csv").write_text(f"{blank if i == 3 else ''}note, kept\n\nk,v\n{data}")
    (tmp_path / "empty.csv").write_text("")
    wanted = sorted([(str(i), str(j)) for i in range(6) for j in range(400)] + [("note", " kept")] * 6)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for split, size in (("134217728", batch), ("4096", batch), ("134217728", "1"), ("3500", "7")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            df = read_csv_after(spark, str(tmp_path), "k string, v string", 1)
            assert sorted(tuple(r) for r in df.collect()) == wanted
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        assert "beyond its first block" in message_of(read_csv_after(spark, str(tmp_path), "k string, v string", 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    (tmp_path / "9.csv").write_text("note\nv,k\n1,2\n")
    assert "header ['v', 'k']" in message_of(read_csv_after(spark, str(tmp_path), "k string, v string", 1))


def test_saves_at_one_time_are_both_listed(spark, tmp_path):
    root = str(tmp_path / "project")
    tables = [table(spark, [("s", 2020, float(i))], "scenario string, year int, value double") for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda df: Project.save(df, root, "food demand"), tables))
    entries = _index(spark, root).collect()
    assert len(entries) == len({e.folder for e in entries}) == 4
    last = max(entries, key=lambda e: (e.version, e.folder)).folder
    kept = one(spark.read.parquet(f"{root}/{last}").select("value"))
    assert one(Project.from_parquet(spark, root).query("food demand").select("value")) == kept
    Project.save(tables[0].withColumn("value", F.lit(9.0)), root, "food demand")
    assert one(Project.from_parquet(spark, root).query("food demand").select("value")) == 9.0
