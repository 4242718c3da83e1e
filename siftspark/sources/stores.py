"""Files, stores and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "id string, question string, start_date string, end_date string, lane string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; broken lines and those without id or question are dropped, the lane falls back
    to that of the folder."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = spark.read.schema(QUESTION).option("mode", "DROPMALFORMED").json(path).withColumn("folder_", folder)
    named = F.when(F.col("folder_") == "questions", "news").otherwise(F.col("folder_"))
    good = (F.coalesce("id", F.lit("")) != "") & (F.trim(F.coalesce("question", F.lit(""))) != "")
    return rows.where(good).select("id", "question", "start_date", "end_date", F.coalesce("lane", named).alias("lane"))


def first_available(readers: list) -> DataFrame:
    """The first reader's table that can be read."""
    failure = None
    for read in readers:
        try:
            return read()
        except AnalysisException as e:  # a path that isn't there
            failure = e
    raise failure


def union_distinct(tables: list[DataFrame], key: str) -> DataFrame:
    """All tables' rows, of each key the first by table."""
    from ..operators.logs import first_wins

    ranked = [t.withColumn("table_", F.lit(k)) for k, t in enumerate(tables)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return first_wins(whole, [key], "table_", *[F.xxhash64(*sorted(c for c in whole.columns if c != "table_"))]).drop("table_")


class Pool:
    """Rows that are loaded again when older than ``seconds``; if that fails, the old ones stay."""

    def __init__(self, load, seconds: float = 4 * 3600):
        self.load, self.seconds, self.at, self.kept = load, seconds, None, None

    def rows(self, now: float) -> DataFrame:
        if self.at is None or now - self.at >= self.seconds:
            try:
                self.kept = self.load()
            except AnalysisException:
                if self.kept is None:
                    raise
            self.at = now
        return self.kept


def save_snapshot(rows: DataFrame, path: str) -> None:
    """The whole state, in place of what was saved before."""
    rows.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """The saved state; no rows where there is none."""
    return first_available([lambda: spark.read.schema(schema).parquet(path), lambda: spark.createDataFrame([], schema)])


def append_scores(scores: DataFrame, path: str) -> None:
    """Adds to a store kept by epoch and kind."""
    scores.write.mode("append").partitionBy("epoch", "kind").parquet(path)


def read_scores(spark: SparkSession, path: str, epoch: str, kind: str) -> DataFrame:
    """One epoch's scores of a kind; only its folder is read."""
    return spark.read.parquet(path).where((F.col("epoch") == epoch) & (F.col("kind") == kind))


def unexpired(rows: DataFrame, written: str, now: Column, seconds: int) -> DataFrame:
    """What a store with an expiry still has; a write renews its whole key."""
    return rows.where(F.col(written) > now - F.make_interval(secs=F.lit(seconds)))


def without_nul(df: DataFrame) -> DataFrame:
    """No NUL characters in any string, nested ones included."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    nested = [f.name for f in df.schema.fields if f.dataType.simpleString() == "array<string>"]
    out = df.withColumns({c: F.translate(F.col(c), "\0", "") for c in strings})
    return out.withColumns({c: F.transform(c, lambda x: F.translate(x, "\0", "")) for c in nested})


def insert_rows(df: DataFrame, path: str) -> int:
    """Appends rows without NUL characters, and returns their number."""
    n = df.count()
    if n:
        without_nul(df).write.mode("append").parquet(path)
    return n


def versioned(path: str, version: str) -> str:
    """A store's folder; another version is another, empty one."""
    return f"{path}/v={version}"


def read_config(spark: SparkSession, path: str, defaults: dict[str, int]) -> DataFrame:
    """A JSON file of whole numbers from 1 to 100; what is missing or outside gets its default."""
    row = first_available([lambda: spark.read.option("multiLine", True).json(path), lambda: spark.range(1).select(*(F.lit(v).alias(k) for k, v in defaults.items()))])
    have = set(row.columns)
    pick = lambda k, v: F.when(F.try_to_number(F.col(k).cast("string"), F.lit("999")).between(1, 100), F.col(k).cast("int")).otherwise(v) if k in have else F.lit(v)
    return row.select(*(pick(k, v).alias(k) for k, v in defaults.items()))


def probe_state(status: Column) -> Column:
    """What an answer says about a peer: ok, online without knowledge of the key, or offline."""
    return F.when(status == 200, "online").when(status == 404, "unknown").otherwise("offline")


def map_posts(raw: DataFrame) -> DataFrame:
    """Posts of a search service in our names; empty results and those without a URL are dropped."""
    keep = ~F.coalesce("noResults", F.lit(False)) & (F.coalesce("url", F.lit("")) != "")
    return raw.where(keep).select("id", "text", "url", F.col("createdAt").alias("created_at"), F.col("likeCount").alias("like_count"), F.col("retweetCount").alias("retweet_count"), F.col("replyCount").alias("reply_count"), F.nullif(F.col("bannerUrl"), F.lit("")).alias("banner_url"))
