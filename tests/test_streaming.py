from kindred.functions import keys as K, text as T
from kindred.streaming import online
from pyspark.sql import functions as F


def stream(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finished(out, name, mode):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return out.sparkSession.table(name)


def test_scalar_operators_give_the_same_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("Mister  Hyde",), ("hyde mister",), ("Müller",), ("",), (None,)], "value string")
    made = lambda d: d.select("value", T.fingerprint("value").alias("f"), K.cologne("value").alias("c"), K.omission_key("value").alias("o"))
    got = finished(made(stream(spark, df, str(tmp_path / "a"))), "scalars", "append").collect()
    assert sorted(got, key=str) == sorted(made(df).collect(), key=str)


def test_key_counts_and_means_over_several_batches(spark, tmp_path):
    df = spark.createDataFrame([(x, float(i)) for i, x in enumerate("aAbBBc")], "value string, n double")
    read = stream(spark, df, str(tmp_path / "b"))
    counts = finished(online.key_counts(read, F.upper, "value"), "counts", "complete")
    assert {r["key"]: r["n"] for r in counts.collect()} == {"A": 2, "B": 3, "C": 1}
    means = read.groupBy(F.upper("value").alias("k")).agg(*online.mean_state("n"))
    got = {r["k"]: r["total"] / r["n"] for r in finished(means, "means", "complete").collect()}
    assert got == {"A": 0.5, "B": 3.0, "C": 5.0}
