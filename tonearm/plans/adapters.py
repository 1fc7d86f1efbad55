"""The sample tables as a media catalog: one track per order, candidates from line items, files from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs in Spark and DuckDB; {S} is the engine's string type, the other braces are the tables.
TRACKS = """
select cast(o.o_orderkey as bigint) as id,
 '/music/'||n.n_name||'/'||p.p_type||'/'||p.p_name||' - Episode '||cast(o.o_orderkey % 97 + 1 as {S})||' ('||cast(cast(o.o_orderdate as date) as {S})||').mp3' as filepath,
 p.p_name||' - Episode '||cast(o.o_orderkey % 97 + 1 as {S})||' ('||cast(cast(o.o_orderdate as date) as {S})||').mp3' as filename,
 '/music/'||n.n_name||'/'||p.p_type as directory,
 case when o.o_orderkey % 13 = 0 then null else p.p_name end as title,
 n.n_name as artist, p.p_brand as album,
 case when o.o_orderkey % 4 = 0 then n.n_name end as album_artist,
 o.o_orderpriority as genre,
 cast(2000 + o.o_orderkey % 25 as {S}) as year,
 case when o.o_orderkey % 17 = 0 then null else o.o_totalprice / 10 end as duration,
 cast(floor(o.o_totalprice * 1000) as bigint) as file_size,
 cast(o.o_orderkey % 320 as int) as bitrate,
 case when o.o_orderkey % 8 = 0 then p.p_name||' Live' end as matched_title,
 case when o.o_orderkey % 19 = 0 then 'DJ '||n.n_name when o.o_orderkey % 23 = 0 then '' end as matched_artist,
 case when o.o_orderkey % 7 = 0 then '' when o.o_orderkey % 3 = 0 then p.p_brand||' Remastered' end as matched_album,
 case when o.o_orderkey % 29 = 0 then 'Various' end as matched_album_artist,
 case when o.o_orderkey % 5 = 0 then p.p_type when o.o_orderkey % 11 = 0 then '' end as matched_genre,
 case when o.o_orderkey % 31 = 0 then '1999' end as matched_year,
 case when o.o_orderkey % 6 = 0 then 'http://covers.example.com/'||p.p_brand when o.o_orderkey % 10 = 0 then '' end as matched_cover_url,
 cast(null as {S}) as matched_tracklist_url, cast(null as {S}) as matched_dj, cast(null as {S}) as matched_event,
 cast(null as double) as match_confidence, cast(null as {S}) as match_source,
 case o.o_orderkey % 4 when 0 then 'pending' when 1 then 'matched' when 2 then 'tagged' else 'error' end as status,
 case when o.o_orderkey % 6 = 0 then true when o.o_orderkey % 6 = 1 then null else false end as series_tagged,
 case when o.o_orderkey % 9 = 0 then null else 'fp'||cast(o.o_custkey % 700 as {S}) end as fingerprint_hash
from {orders} o join {customer} c on o.o_custkey=c.c_custkey join {nation} n on c.c_nationkey=n.n_nationkey
join {part} p on p.p_partkey = o.o_orderkey % 200
"""

CANDIDATES = """
select cast((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey % 100000 as bigint) as id, cast(l_orderkey as bigint) as track_id, 'Set '||cast(l_partkey % 50 as {S}) as title,
 'DJ '||cast(l_suppkey as {S}) as artist, 'genre '||cast(l_partkey % 9 as {S}) as genre, cast(null as {S}) as cover_url,
 'http://site.example.com/tracklist/'||cast(l_partkey as {S})||'/x.html' as tracklist_url, 'DJ '||cast(l_suppkey as {S}) as dj,
 cast(null as {S}) as event, 'web' as source, cast(l_quantity * 2 as double) as confidence
from {lineitem}
"""

TABLES = ("orders", "customer", "nation", "part", "lineitem")


def duck(sql: str) -> str:
    return sql.format(S="varchar", **{t: t for t in TABLES})


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("{S}", "string"), **tables)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TRACKS)


#: Rows of a piece at most, but for chance, so that what a task holds doesn't grow with the tables.
PIECE_ROWS = 500_000


def pieces(spark: SparkSession, rows: int = 0) -> int:
    """Into how many pieces rows are dealt for work that costs much for each: more than there are cores, so that none waits for long, and enough for many rows."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PIECE_ROWS))


def candidate_pieces(spark: SparkSession, sf_dir: str) -> int:
    """The same for all candidates, which are counted by the files' footers."""
    return pieces(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())


def dealt_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks for work that costs much for each row, dealt out behind their joins: a join leaves pieces by its keys (200 parts) and bytes, whatever is done to their rows next."""
    return tracks(spark, sf_dir).repartition(pieces(spark, spark.read.parquet(f"{sf_dir}/orders.parquet").count()), "id")


def stream_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks as the orders come in, the other tables as they are."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in TRACKS}
    tables["orders"] = spark.readStream.schema(tables["orders"].schema).parquet(f"{sf_dir}/orders.parquet*")  # a pattern may fit a file too
    return spark.sql(TRACKS.replace("{S}", "string"), **tables)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CANDIDATES)


def placed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates with the place of their row in the table, which tells those with one identifier apart."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.withColumn("place", F.struct("_metadata.file_path", "_metadata.row_index"))
    return spark.sql(CANDIDATES.replace("{S}", "string").replace("\nfrom", ", place\nfrom"), lineitem=lines)
