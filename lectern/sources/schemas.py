"""Schemas of the stored tables. Reads never infer them."""

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("doc_name", T.StringType()),
        T.StructField("section_title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("chunk_pos", T.IntegerType()),
        T.StructField("doc_chunk_count", T.IntegerType()),
        T.StructField("preview", T.StringType()),
    ]
)
EVAL_CASE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("expected_output", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
    ]
)
TIER = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("multiplier", T.DoubleType())])
AUTHOR = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("pattern", T.StringType()), T.StructField("author", T.StringType())])
EMBEDDING = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
