from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and long texts, ties, repeated rows, and a column whose name operators might use.
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "Same text here", "en", "a", 14), (4, "same TEXT here", "de", "a", 14), (4, "same TEXT here", "de", "a", 14),
    (5, "word " * 4000, None, "b", 20000), (6, "É été ß", "fr", "b", 7), (7, "É Été ß", "fr", "b", 7), (8, "   \n\t ", "en", "c", 6), (9, "12 34", "en", "c", 5), (10, "one", None, None, 3),
]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("shard", F.lit(1)).withColumn("part", F.lit("x")).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def tables_at(spark, path, **frames):
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
