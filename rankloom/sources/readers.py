"""Readers of rating files: an explicit schema each, nothing inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import release_year, tokens

RATINGS = "user_id string, item_id string, data double, ts long"
# Layouts (separator, header) of the known rating files.
LAYOUTS = {"100k": ("\t", False), "1m": ("::", False), "10m": ("::", False), "20m": (",", True), "hetrec": ("\t", True)}


def _csv(spark: SparkSession, path: str, schema: str, sep: str, header: bool, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).option("encoding", encoding).csv(path, sep=sep, header=header)


def ratings(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(user_id, item_id, data, ts) of a rating file; hetrec files have no single time column."""
    sep, header = LAYOUTS[layout]
    if layout == "hetrec":
        return _csv(spark, path, "user_id string, item_id string, data double", sep, header).withColumn("ts", F.lit(None).cast("long"))
    return _csv(spark, path, RATINGS, sep, header)


def interactions(spark: SparkSession, path: str, sep: str = ",", header: bool = False, timestamp: bool = False, dedup: bool = False) -> DataFrame:
    """Generic interactions, one per user and item if dedup: the latest, or without times that of the highest value."""
    from ..operators.matrix import dedup_latest

    schema = "user_id string, item_id string, data double" + (", ts double" if timestamp else "")
    df = _csv(spark, path, schema, sep, header)
    return dedup_latest(df, ["user_id", "item_id"], "ts" if timestamp else "data", "data") if dedup else df


def movies(spark: SparkSession, path: str, layout: str) -> tuple[DataFrame, DataFrame]:
    """Genres (item_id, feature_id, data) and years (item_id, feature_id, data) of a movie file."""
    sep, header = LAYOUTS[layout]
    df = _csv(spark, path, "item_id string, title string, genres string", sep, header)
    genres = df.select("item_id", F.explode(F.split("genres", r"\|")).alias("feature_id")).where("feature_id <> ''")
    years = df.select("item_id", release_year(F.col("title")).cast("string").alias("feature_id")).where("feature_id is not null")
    return tuple(x.groupBy("item_id", "feature_id").agg(F.count("*").cast("double").alias("data")) for x in (genres, years))


def tags(spark: SparkSession, path: str, layout: str, stop_words: list[str] | None = None) -> DataFrame:
    """(item_id, feature_id, data): how often each token was tagged."""
    from ..functions.stem import ENGLISH_STOP_WORDS, porter_stem

    sep, header = LAYOUTS[layout]
    df = _csv(spark, path, "user_id string, item_id string, tag string, ts string", sep, header, "ISO-8859-1")
    stop = F.array(*[F.lit(w) for w in (ENGLISH_STOP_WORDS if stop_words is None else stop_words)])
    words = df.select("item_id", F.explode(tokens(F.col("tag"))).alias("word")).where(~F.array_contains(stop, F.col("word")))
    stems = words.withColumn("feature_id", porter_stem("word")).where((F.col("feature_id") != "") & ~F.array_contains(stop, F.col("feature_id")))
    return stems.groupBy("item_id", "feature_id").agg(F.count("*").cast("double").alias("data"))


def users(spark: SparkSession, path: str, sep: str = "::") -> DataFrame:
    """(user_id, feature_id, data): name_value tokens of gender, age, occupation and zip code."""
    df = _csv(spark, path, "user_id string, gender string, age_group string, occupation string, zip_code string", sep, False)
    return unpivot_features(df, "user_id", ["gender", "age_group", "occupation", "zip_code"])


def unpivot_features(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    long = df.select(key, *[F.col(c).cast("string") for c in columns]).unpivot(key, columns, "name", "value").where("value is not null")
    return long.select(key, F.concat_ws("_", "name", "value").alias("feature_id"), F.lit(1.0).alias("data"))


def submission(recommendations: DataFrame) -> DataFrame:
    """(user_id, items): one line per user, item ids by rank, joined by blanks."""
    lists = recommendations.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    return lists.select("user_id", F.array_join(F.transform("l", lambda x: x["item_id"].cast("string")), " ").alias("items"))


def feature_lines(interactions_: DataFrame, user_features: DataFrame, item_features: DataFrame) -> DataFrame:
    """(value): 'label 0 n_user n_item id:value ...' lines for an external factorisation trainer."""
    pack = lambda d, k: d.groupBy(k).agg(F.sort_array(F.collect_list(F.struct("feature_id", "data"))).alias("f"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["feature_id"], x["data"])), " ")
    u, i = pack(user_features, "user_id").withColumnRenamed("f", "fu"), pack(item_features, "item_id").withColumnRenamed("f", "fi")
    return interactions_.join(u, "user_id").join(i, "item_id").select(F.concat_ws(" ", "data", F.lit("0"), F.size("fu"), F.size("fi"), text("fu"), text("fi")).alias("value"))
