"""Substring search through an inverted index of character trigrams.

`lists` holds for each trigram and block of identifiers the identifiers that have it, in folders by a hash of the
trigram; `grams` how many there are. A search reads only the lists of the text's rarest trigrams, intersects them block by block
from the shortest on, and verifies what is left in the table itself. A trigram that all rows have is many rows of at most BLOCK identifiers.

Defined results: searches ignore case; `%` and `_` stand for any run and any character, as in ILIKE; a null text is found by
nothing; a text without a literal character finds by a scan; texts of one or two characters read the trigrams that begin so.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers of a block, folders of lists, and lists that a search intersects.
BLOCK, FOLDERS, RAREST = 1 << 16, 64, 4
#: Ends a text, so that its last characters begin trigrams too.
_END = "\u0000\u0000"


def trigrams(text: Column) -> Column:
    """The different trigrams of the text in lower case, with its end."""
    padded = F.concat(F.lower(text), F.lit(_END))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(padded, k, 3)))


def write_index(rows: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """rows(id long, text): an identifier may have several texts."""
    grams = rows.where(F.length("text") > 0).select("id", F.explode(trigrams(F.col("text"))).alias("gram"))
    lists = grams.groupBy("gram", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    lists = lists.withColumn("folder", F.pmod(F.xxhash64("gram"), F.lit(folders)).cast("int"))
    lists.repartitionByRange("folder", "gram", "block").sortWithinPartitions("folder", "gram", "block").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/lists")
    stored = rows.sparkSession.read.parquet(f"{path}/lists")
    stored.groupBy("gram", "folder").agg(F.sum(F.size("ids")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")


def _runs(text: str) -> list[str]:
    """The literal runs of a pattern."""
    return [r for r in re.split(r"[%_]", text.lower()) if r]


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """id of the rows that may hold text; None if every row may."""
    runs = _runs(text)
    if not runs:
        return None
    grams = spark.read.parquet(f"{path}/grams")
    wanted = {r[k : k + 3] for r in runs for k in range(len(r) - 2)}
    lists = spark.read.parquet(f"{path}/lists")
    if not wanted:  # the longest run has one or two characters
        found = grams.where(F.col("gram").startswith(max(runs, key=len)))
        return lists.join(F.broadcast(found.select("gram", "folder")), ["gram", "folder"]).select(F.explode("ids").alias("id")).distinct()
    rarest = grams.where(F.col("gram").isin(sorted(wanted))).orderBy("n", "gram").collect()  # at most as many as the text has characters
    if len(rarest) < len(wanted):
        return lists.select(F.explode("ids").alias("id")).limit(0)
    rarest = rarest[:RAREST]
    read = lists.where(F.col("folder").isin(sorted({r["folder"] for r in rarest})) & F.col("gram").isin([r["gram"] for r in rarest]))
    by_size = F.array_sort(F.collect_list(F.struct(F.size("ids").alias("n"), "ids")))
    met = read.groupBy("block").agg(by_size.alias("lists")).where(F.size("lists") == len(rarest))
    both = F.aggregate(F.slice("lists", 2, RAREST), F.get("lists", F.lit(0))["ids"], lambda acc, x: F.array_intersect(acc, x["ids"]))
    return met.select(F.explode(both).alias("id"))


def search_by_index(table: DataFrame, path: str, text: str, fields: list[str], key: str = "id") -> DataFrame:
    """The rows of table with text in one of the fields, which the index at path was made of."""
    like = F.lit(False)
    for f in fields:
        like = like | F.coalesce(F.col(f).ilike(f"%{text}%"), F.lit(False))
    found = candidates(table.sparkSession, path, text)
    return table.where(like) if found is None else table.join(found.withColumnRenamed("id", key), key, "left_semi").where(like)
