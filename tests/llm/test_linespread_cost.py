import re

from pyspark.sql import functions as F

from tixspark.llm.linespread import lines_of, normal_line


def test_lines_are_normalised_once(spark):
    docs = spark.createDataFrame([(1, "a  b\nc\t d\n\n \n e "), (2, None)], "doc_id long, text string")
    rows = lines_of(docs, "doc_id")
    assert sorted((r.doc_id, r.at, r.line) for r in rows.collect()) == [(1, 0, "a b"), (1, 1, "c d"), (1, 4, "e")]
    near = rows.join(F.broadcast(rows.select("key").distinct()), "key")
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("regexp_replace" in f or "md5" in f for f in filters)


def test_normal_line_of_odd_white_space(spark):
    lines = ["", " ", "a b", " a b ", "a  b", "a\tb", "\ta", "a\v\fb", "a \r", "\r\na", "a  b", " x", "é  ü", "a\x0bb  ", "a\nb"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").coalesce(1).select(normal_line(F.col("x"))).collect()]
    assert got == [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ") for x in lines]
