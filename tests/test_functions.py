import lorekiln.functions as L
from pyspark.sql import functions as F


def test_functions_are_columns(spark):
    df = spark.createDataFrame([(" Ala  MA kota. ", -1, 0), (None, 1, 5)], "t string, sign int, mantissa int")
    row = df.select(L.normal_name(F.col("t")), L.surface_tokens(F.col("t")), L.decimal_normal(F.col("sign"), F.col("mantissa")), L.redacted(F.col("t"), "kota"), L.factuality(F.lit(False), F.lit(True))).collect()
    assert tuple(row[0]) == ("ala ma kota.", ["Ala", "MA", "kota"], 1, " Ala  MA [redacted]. ", "Negated")
    assert row[1][0] is None and row[1][2] == 1
    assert all(callable(getattr(L, name)) for name in L.__all__)
