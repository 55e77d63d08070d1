"""Registered parser queries: rating, item, play, name and alias lines built from the
driver's tables, some broken by a rule on a key hash, then parsed and quarantined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_u32, sql_md5_u32
from ..sources import tables as T
from ..sources import text as X

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql):
    def deco(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn
    return deco


# kind of damage by key hash mod 50: 0 drops the last field, 1 makes the first field text
def _damage(key):
    return F.pmod(md5_u32(key), F.lit(50))


def _lines(df, sep: str, fields: list, key) -> DataFrame:
    parts = [F.col(f).cast("string") for f in fields]
    whole = F.concat_ws(sep, *parts)
    short = F.concat_ws(sep, *parts[:-1])
    d = _damage(key)
    return df.select(F.when(d == 0, short).when(d == 1, F.concat(F.lit("x"), whole)).otherwise(whole).alias("line"))


def rating_lines(spark, sf_dir):
    i = T.inter(spark, sf_dir).select("user_id", "item_id", "rating", "day", "row_key")
    return _lines(i, "::", ["user_id", "item_id", "rating", "day"], F.col("row_key"))


def item_lines(spark, sf_dir):
    return _lines(T.items(spark, sf_dir), "::", ["item_id", "title", "genres"], F.col("item_id").cast("string"))


def play_lines(spark, sf_dir):
    i = T.inter(spark, sf_dir).select("user_id", "item_id", F.col("l_quantity").cast("int").alias("plays"), "row_key")
    return _lines(i, " ", ["user_id", "item_id", "plays"], F.col("row_key"))


def name_lines(spark, sf_dir):
    n = T.items(spark, sf_dir).select("item_id", F.concat(F.lit("  "), "title", F.lit(" ")).alias("name"))
    return _lines(n, "\t", ["item_id", "name"], F.col("item_id").cast("string"))


def alias_lines(spark, sf_dir):
    return _lines(T.aliases(spark, sf_dir), "\t", ["bad_id", "good_id"], F.col("bad_id").cast("string"))


def _sql_damage(key: str) -> str:
    return f"({sql_md5_u32(key)} % 50)"


def _good(spark, sf_dir, lines, kind):
    return X.split_malformed(X.parse_kind(lines(spark, sf_dir), kind))[0]


@register("q_parse_ratings", T.with_views("inter") + f"""
SELECT user_id, item_id, rating, day AS ts, CAST(day % 10 AS INTEGER) AS bucket, count(*) AS n FROM inter
WHERE {_sql_damage("row_key")} > 1 GROUP BY ALL""")
def q_parse_ratings(spark, sf_dir):
    """Rating lines that parse, counted per distinct row."""
    from ..operators.splits import with_bucket
    d = with_bucket(_good(spark, sf_dir, rating_lines, "ratings"), "ts")
    return d.groupBy("user_id", "item_id", "rating", "ts", "bucket").agg(F.count(F.lit(1)).alias("n"))


@register("q_parse_items", T.with_views("items") + f"""
SELECT item_id, title, CASE WHEN {_sql_damage("CAST(item_id AS VARCHAR)")} <> 0 THEN genres END AS genres
FROM items WHERE {_sql_damage("CAST(item_id AS VARCHAR)")} <> 1""")
def q_parse_items(spark, sf_dir):
    """Item lines; a line without genres is good, one with a text id is not."""
    return _good(spark, sf_dir, item_lines, "items")


@register("q_parse_plays", T.with_views("inter") + f"""
SELECT user_id, item_id, sum(CAST(l_quantity AS BIGINT)) AS plays, count(*) AS n FROM inter
WHERE {_sql_damage("row_key")} > 1 GROUP BY ALL""")
def q_parse_plays(spark, sf_dir):
    """Play-count lines, summed per pair."""
    return _good(spark, sf_dir, play_lines, "plays").groupBy("user_id", "item_id").agg(
        F.sum("plays").alias("plays"), F.count(F.lit(1)).alias("n"))


@register("q_parse_names", T.with_views("items") + f"""
SELECT item_id, trim(title) AS name FROM items WHERE {_sql_damage("CAST(item_id AS VARCHAR)")} > 1""")
def q_parse_names(spark, sf_dir):
    """Tab-separated names, trimmed."""
    return _good(spark, sf_dir, name_lines, "names")


def user_lines(spark, sf_dir):
    return _lines(T.users(spark, sf_dir), "::", ["user_id", "gender", "age", "occupation", "zip"],
                  F.col("user_id").cast("string"))


@register("q_parse_users", T.with_views("users") + f"""
SELECT user_id, gender, age, occupation, zip FROM users WHERE {_sql_damage("CAST(user_id AS VARCHAR)")} > 1""")
def q_parse_users(spark, sf_dir):
    """S3: user lines; lines without a zip code or with a text id are left out."""
    return _good(spark, sf_dir, user_lines, "users")


def personal_lines(spark, sf_dir):
    p = T.personal(spark, sf_dir).withColumn("ts", F.lit(0))
    return _lines(p, "::", ["user_id", "item_id", "rating", "ts"], F.col("item_id").cast("string"))


@register("q_parse_personal", T.with_views("personal") + f"""
SELECT user_id, item_id, rating FROM personal
WHERE rating > 0 AND {_sql_damage("CAST(item_id AS VARCHAR)")} > 1""")
def q_parse_personal(spark, sf_dir):
    """S8 + P6: the personal file's lines, positive ratings only."""
    return X.personal_ratings(_good(spark, sf_dir, personal_lines, "ratings"))


CSV_HEADER = "item_id,title,genres"


def csv_lines(spark, sf_dir):
    """Item records as CSV: every title quoted, with a comma, some with quotes inside; a tenth or so damaged
    (the last field missing, or a text id); a header line."""
    i = T.items(spark, sf_dir)
    title = F.concat(F.col("title"), F.when(F.col("item_id") % 5 == 0, F.lit(', the "big" one')).otherwise(F.lit(", it")))
    quoted = F.concat(F.lit('"'), F.replace(title, F.lit('"'), F.lit('""')), F.lit('"'))
    head = F.concat_ws(",", "item_id", quoted)
    d = _damage(F.col("item_id").cast("string"))
    whole = F.concat_ws(",", head, "genres")
    rows = i.select(F.when(d == 0, head).when(d == 1, F.concat(F.lit("x"), whole)).otherwise(whole).alias("line"))
    return rows.unionByName(spark.range(1).select(F.lit(CSV_HEADER).alias("line")))


_CSV_TITLE = "title || CASE WHEN item_id % 5 = 0 THEN ', the \"big\" one' ELSE ', it' END"
_CSV_HEAD = f"item_id || ',\"' || replace({_CSV_TITLE}, '\"', '\"\"') || '\"'"


@register("q_parse_csv", T.with_views("items") + f"""
SELECT 'row' AS kind, item_id, {_CSV_TITLE} AS title, genres, CAST(NULL AS VARCHAR) AS line FROM items
WHERE {_sql_damage(_ITEM_KEY_SQL := "CAST(item_id AS VARCHAR)")} > 1
UNION ALL
SELECT 'quarantine', NULL, NULL, NULL, CASE WHEN {_sql_damage(_ITEM_KEY_SQL)} = 0 THEN {_CSV_HEAD}
       ELSE 'x' || {_CSV_HEAD} || ',' || genres END FROM items WHERE {_sql_damage(_ITEM_KEY_SQL)} <= 1""")
def q_parse_csv(spark, sf_dir):
    """CSV records with quoted commas and quotes, a header line, and the quarantine."""
    good, bad = X.split_malformed(X.parse_csv_lines(csv_lines(spark, sf_dir), X.ITEM_FIELDS, 2, CSV_HEADER))
    none = lambda t: F.lit(None).cast(t)
    return good.select(F.lit("row").alias("kind"), "item_id", "title", "genres", none("string").alias("line")).unionByName(
        bad.select(F.lit("quarantine").alias("kind"), none("bigint").alias("item_id"), none("string").alias("title"),
                   none("string").alias("genres"), "line"))


@register("q_write_readback", T.with_views("inter") + """
SELECT bucket, count(*) AS n, round(sum(rating), 6) AS rating, min(row_key) AS first_key FROM inter GROUP BY bucket""")
def q_write_readback(spark, sf_dir):
    """Ratings written as a table partitioned by bucket by a run that stops half way (some buckets, wrong
    values), then by a whole run over it, then again; read back and summed per bucket."""
    from ..session import cut_lineage, drop_table, new_table_path, table_path
    rows = cut_lineage(T.inter(spark, sf_dir).select("row_key", "rating", "bucket"), partition_by=["bucket"])
    path = new_table_path(spark)
    X.write_table(rows.where("bucket < 4").withColumn("rating", F.col("rating") + 1), path, ["bucket"])
    for _ in range(2):
        X.write_table(rows, path, ["bucket"])
    drop_table(spark, table_path(rows))  # the join ran once for the three runs
    return spark.read.schema(rows.schema).parquet(path).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("rating"), 6).alias("rating"), F.min("row_key").alias("first_key"))


@register("q_parse_aliases", T.with_views("aliases") + f"""
SELECT bad_id, good_id FROM aliases WHERE {_sql_damage("CAST(bad_id AS VARCHAR)")} > 1""")
def q_parse_aliases(spark, sf_dir):
    """Tab-separated aliases; malformed lines map nothing."""
    return _good(spark, sf_dir, alias_lines, "aliases")


_ITEM_KEY = "CAST(item_id AS VARCHAR)"


@register("q_quarantine", T.with_views("inter", "items", "aliases") + f"""
SELECT 'ratings' AS kind, CASE WHEN {_sql_damage("row_key")} = 0 THEN concat_ws('::', user_id, item_id, rating)
       ELSE 'x' || concat_ws('::', user_id, item_id, rating, day) END AS line, count(*) AS n
FROM inter WHERE {_sql_damage("row_key")} <= 1 GROUP BY ALL
UNION ALL
SELECT 'items', 'x' || concat_ws('::', item_id, title, genres), count(*) FROM items
WHERE {_sql_damage(_ITEM_KEY)} = 1 GROUP BY ALL
UNION ALL
SELECT 'names', CASE WHEN {_sql_damage(_ITEM_KEY)} = 0 THEN CAST(item_id AS VARCHAR)
       ELSE 'x' || item_id || chr(9) || '  ' || title || ' ' END, count(*) FROM items
WHERE {_sql_damage(_ITEM_KEY)} <= 1 GROUP BY ALL
UNION ALL
SELECT 'aliases', CASE WHEN {_sql_damage("CAST(bad_id AS VARCHAR)")} = 0 THEN CAST(bad_id AS VARCHAR)
       ELSE 'x' || bad_id || chr(9) || good_id END, count(*) FROM aliases
WHERE {_sql_damage("CAST(bad_id AS VARCHAR)")} <= 1 GROUP BY ALL""")
def q_quarantine(spark, sf_dir):
    """The malformed lines of four readers, raw."""
    out = None
    for kind, lines in (("ratings", rating_lines), ("items", item_lines), ("names", name_lines),
                        ("aliases", alias_lines)):
        bad = X.split_malformed(X.parse_kind(lines(spark, sf_dir), kind))[1]
        bad = bad.groupBy(F.lit(kind).alias("kind"), "line").agg(F.count(F.lit(1)).alias("n"))
        out = bad if out is None else out.unionByName(bad)
    return out
