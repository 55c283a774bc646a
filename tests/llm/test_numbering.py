"""Gapless numbers against a plain sort."""

from pyspark.sql import functions as F

from polysafe.llm.numbering import numbered


def brute(rows, group):
    out, at = [], {}
    for r in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r)):
        g = r[0] if group else None
        out.append((*r, at.get(g, 0)))
        at[g] = at.get(g, 0) + 1
    return sorted(out, key=repr)


ROWS = [(k % 3, k * 7 % 40, f"t{k % 2}") for k in range(200)] + [(1, None, None)] * 3 + [(1, 5, "t0")] * 9000


def test_by_group_and_over_all(spark):
    df = spark.createDataFrame(ROWS, "g int, v int, t string").repartition(5)
    got = numbered(df, [F.col("v"), F.col("t")], ["g"]).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS, True)
    got = numbered(df, [F.col("g"), F.col("v"), F.col("t")]).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS, False)


def test_descending_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = {r.v: r.place for r in numbered(df, [F.col("v").desc()], name="place").collect()}
    assert got == {v: 999 - v for v in range(1000)}


def test_empty_table(spark):
    df = numbered(spark.createDataFrame([], "g int, v int"), [F.col("v")], ["g"])
    assert df.columns == ["g", "v", "position"] and df.collect() == []
