"""Functions that SQL can call, against the column expressions and operators."""

import pytest
from pyspark.sql import functions as F

from peakloom.functions import scalars, sql
from peakloom.operators import isotopes


def test_scalars_equal_the_expressions(spark):
    sql.register(spark)
    texts = ["PT1.5S", "P1Y2M3DT4H5M6.7S", "PT", "", "x", None, "-PT3M", "12.5e1z", " -7 a", ".5", "+3", "1e400"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("texts_of_test")
    got = spark.sql("SELECT t, xs_seconds(t) AS a, lenient_double(t) AS b, lenient_int(t) AS c FROM texts_of_test")
    want = df.select("t", scalars.duration_seconds(F.col("t")).alias("a"), scalars.lenient_double(F.col("t")).alias("b"), scalars.lenient_int(F.col("t")).alias("c"))
    assert got.collect() == want.collect()
    pairs = spark.range(0, 12).selectExpr("id as n").crossJoin(spark.range(-1, 14).selectExpr("id as k"))
    pairs.createOrReplaceTempView("pairs_of_test")
    got = spark.sql("SELECT n, k, choose(n, k) AS c, binomial(n, k, 0.3D) AS b, int_abs(k - 2.5D) AS i FROM pairs_of_test ORDER BY n, k").collect()
    want = pairs.select("n", "k", scalars.combinations(F.col("n"), F.col("k")).alias("c"), scalars.binomial(F.col("n"), F.col("k"), F.lit(0.3)).alias("b"), scalars.int_abs(F.col("k") - 2.5).alias("i")).orderBy("n", "k").collect()
    assert got == want
    assert "PythonUDF" not in spark._jvm.PythonSQLUtils.explainString(spark.sql("SELECT xs_seconds(t) FROM texts_of_test")._jdf.queryExecution(), "simple")
    assert spark.sql("SELECT flight_seconds(4D, 3D) AS f, ladder_mz(100D, 2L, 2L) AS m, ladder_mz(100D, 2L, 1L) AS n").first() == (6.0, pytest.approx((102.00671 + 1) / 2), pytest.approx(102.00671))


def test_profiles_by_lateral_join(spark):
    sql.register(spark)
    rows = [(1, "PEPTIDE", 1), (2, "AAAAWWWWKKKKRRRRHHHH" * 8, 3), (3, "", 9), (4, "XZ", 2), (5, "MC", 2)]
    df = spark.createDataFrame(rows, "seq_id long, sequence string, charge int")
    df.createOrReplaceTempView("sequences_of_test")
    got = spark.sql("SELECT s.seq_id, p.* FROM sequences_of_test s, LATERAL isotope_profile(s.sequence, s.charge) p").collect()
    want = isotopes.profiles(df, mode=1).collect()
    key = lambda r: (r.seq_id, r.idx)
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(want, key=key)]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (a.mz, a.pct, a.pct_norm) == (pytest.approx(b.mz), pytest.approx(b.pct), pytest.approx(b.pct_norm))
    nulls = spark.sql("SELECT count(*) AS n FROM VALUES (CAST(NULL AS STRING), CAST(NULL AS INT)) v(s, c), LATERAL isotope_profile(s, c)").first()
    assert nulls.n == sum(r.seq_id == 3 for r in want)
