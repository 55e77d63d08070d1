"""Rating-model views over the driver's parquet tables.

Every view has a Spark builder and a DuckDB twin (a CTE body) so that each
registered query can be checked against an SQL oracle on the same files.

Mapping (fixed by the build plan):

* ``inter``   = lineitem JOIN orders: user = o_custkey, item = l_partkey,
  rating = 1 + floor((l_quantity - 1) / 10) in 1..5, but 0 and 0.5 for the two
  smallest quantities; day = day number of l_shipdate; bucket = day mod 10, but 8 or 9
  for every row of a new user (key mod 50 = 7) or new item (key mod 50 = 11), so
  training never sees them; plus the columns that make a row unique.
* ``items``   = part without keys mod 97 = 5 (missing dimension rows): title p_name, with an
  accent for keys mod 11 = 0; two of the 18 genre names by key hash.
* ``users``   = customer without keys mod 89 = 3: gender 'M' for the BUILDING segment, age,
  occupation = nation, zip built from the digits of the name (no digits for keys mod 83 = 2).
* ``plays``   = (user, item, l_quantity) rows of inter.
* ``aliases`` = parts whose key ends in 7 map to the key below.
* ``personal``= the items of the most active user (ties: smallest key) with its best rating of
  each, under a new user key (max customer key + 1).
* ``feat``    = embeddings as (row_id, label, x ARRAY<DOUBLE>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..functions.hashing import md5_u32, sql_md5_u32
from ..operators.features import GENRE_FLAGS

ROW_KEY_COLS = ["l_orderkey", "l_linenumber", "item_id", "l_suppkey", "l_quantity",
                "l_extendedprice", "day"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_key(cols: dict) -> F.Column:
    return F.concat_ws(
        ":", cols["l_orderkey"], cols["l_linenumber"], cols["item_id"], cols["l_suppkey"],
        cols["l_quantity"].cast("bigint"),
        F.round(cols["l_extendedprice"] * 100).cast("bigint"), cols["day"])


def day_number(c: F.Column, dtype) -> F.Column:
    """Days since 1970-01-01 of a wall-clock timestamp, independent of the
    session time zone (a zone-aware TIMESTAMP counts UTC days)."""
    if isinstance(dtype, TimestampType):
        return F.floor(F.unix_micros(c) / F.lit(86400000000)).cast("bigint")
    return F.unix_date(c.cast("date")).cast("bigint")


def inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction rows; unique on ``row_key``."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    day = day_number(F.col("l_shipdate"), li.schema["l_shipdate"].dataType)
    df = j.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.when(F.col("l_quantity") == 1, 0.0).when(F.col("l_quantity") == 2, 0.5).otherwise(
            F.lit(1.0) + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
        day.alias("day"),
        F.when((F.pmod("o_custkey", F.lit(50)) == 7) | (F.pmod("l_partkey", F.lit(50)) == 11),
               F.pmod(day, F.lit(2)) + 8).otherwise(F.pmod(day, F.lit(10))).cast("int").alias("bucket"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
    )
    return df.withColumn("row_key", _row_key({c: F.col(c) for c in ROW_KEY_COLS}))


INTER_SQL = """inter AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
         CAST(CASE WHEN l.l_quantity = 1 THEN 0 WHEN l.l_quantity = 2 THEN 0.5
                   ELSE 1 + floor((l.l_quantity - 1) / 10) END AS DOUBLE) AS rating,
         CAST(l.l_shipdate::DATE - DATE '1970-01-01' AS BIGINT) AS day,
         CAST(CASE WHEN o.o_custkey % 50 = 7 OR l.l_partkey % 50 = 11
                   THEN (l.l_shipdate::DATE - DATE '1970-01-01') % 2 + 8
                   ELSE (l.l_shipdate::DATE - DATE '1970-01-01') % 10 END AS INTEGER) AS bucket,
         l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity, l.l_extendedprice,
         concat_ws(':', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
                   CAST(l.l_quantity AS BIGINT), CAST(round(l.l_extendedprice * 100) AS BIGINT),
                   CAST(l.l_shipdate::DATE - DATE '1970-01-01' AS BIGINT)) AS row_key
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


GENRES = [name for _, name in GENRE_FLAGS]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.pmod("p_partkey", F.lit(97)) != 5)
    key = F.col("p_partkey").cast("string")
    names = F.array(*[F.lit(g) for g in GENRES])
    pick = lambda k: F.get(names, F.pmod(md5_u32(k), F.lit(len(GENRES))).cast("int"))
    title = F.when(F.pmod("p_partkey", F.lit(11)) == 0, F.concat("p_name", F.lit(" é"))).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("item_id"), title.alias("title"),
                    F.concat_ws("|", pick(F.concat(F.lit("g:"), key)), pick(F.concat(F.lit("h:"), key))).alias("genres"))


_GENRES_SQL = "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in GENRES) + "]"
_PICK_SQL = [f"{_GENRES_SQL}[{sql_md5_u32(f"'{t}:' || CAST(p_partkey AS VARCHAR)")} % {len(GENRES)} + 1]"
             for t in ("g", "h")]
ITEMS_SQL = f"""items AS (
  SELECT p_partkey AS item_id, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' é' ELSE p_name END AS title,
         concat_ws('|', {", ".join(_PICK_SQL)}) AS genres
  FROM part WHERE p_partkey % 97 <> 5)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.pmod("c_custkey", F.lit(89)) != 3)
    digits = F.when(F.pmod("c_custkey", F.lit(83)) == 2, F.lit("nozip")).otherwise(
        F.regexp_replace(F.col("c_name"), "[^0-9]", ""))
    zip_code = F.concat(F.substring(digits, -5, 5), F.lit("-"),
                        F.lpad(F.col("c_nationkey").cast("string"), 4, "0"))
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "M").otherwise("F").alias("gender"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("age"),
        F.col("c_nationkey").cast("int").alias("occupation"),
        zip_code.alias("zip"),
    )


USERS_SQL = """users AS (
  SELECT c_custkey AS user_id,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'M' ELSE 'F' END AS gender,
         CAST(floor(c_acctbal / 100) AS INTEGER) AS age,
         CAST(c_nationkey AS INTEGER) AS occupation,
         right(CASE WHEN c_custkey % 83 = 2 THEN 'nozip' ELSE regexp_replace(c_name, '[^0-9]', '', 'g') END, 5)
           || '-' || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS zip
  FROM customer WHERE c_custkey % 89 <> 3)"""


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inter(spark, sf_dir).select(
        "user_id", "item_id", F.col("l_quantity").cast("int").alias("plays"))


PLAYS_SQL = """plays AS (
  SELECT user_id, item_id, CAST(l_quantity AS INTEGER) AS plays FROM inter)"""


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.where(F.pmod("p_partkey", F.lit(10)) == 7).select(
        F.col("p_partkey").alias("bad_id"), (F.col("p_partkey") - 1).alias("good_id"))


ALIASES_SQL = """aliases AS (
  SELECT p_partkey AS bad_id, p_partkey - 1 AS good_id FROM part WHERE p_partkey % 10 = 7)"""

def personal_user(spark: SparkSession, sf_dir: str) -> int:
    """Key of the new user."""
    return int(table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]) + 1


def personal(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Ratings of one new user: those of the most active user, one row per item. ``rows``: the interaction rows,
    where the caller has them written (they are read twice)."""
    i = (inter(spark, sf_dir) if rows is None else rows).select("user_id", "item_id", "rating")
    most = (i.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1)
            .select("user_id").scalar())
    uid = table(spark, sf_dir, "customer").agg(F.max("c_custkey") + 1).scalar()
    mine = i.where(F.col("user_id") == most).groupBy("item_id").agg(F.max("rating").alias("rating"))
    return mine.select(uid.alias("user_id"), "item_id", "rating")


PERSONAL_SQL = """personal AS (
  SELECT (SELECT max(c_custkey) + 1 FROM customer) AS user_id, item_id, max(rating) AS rating
  FROM inter WHERE user_id = (SELECT user_id FROM inter GROUP BY user_id
                              ORDER BY count(*) DESC, user_id LIMIT 1)
  GROUP BY item_id)"""


def feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"),
                    F.col("embedding").cast("array<double>").alias("x"))


FEAT_SQL = """feat AS (
  SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label,
         CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""

VIEW_SQL = {"inter": INTER_SQL, "items": ITEMS_SQL, "users": USERS_SQL, "plays": PLAYS_SQL,
            "aliases": ALIASES_SQL, "personal": PERSONAL_SQL, "feat": FEAT_SQL}
_DEPS = {"plays": ["inter"], "personal": ["inter"]}


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named views (and their dependencies)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    return "WITH " + ",\n".join(VIEW_SQL[n] for n in order)
