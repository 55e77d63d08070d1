"""Readers for the rating, item, user, tag, play-count, name and alias text
files, a quarantine split for malformed lines, and the table writer.

Lines are read as text and split with native functions; every numeric field
goes through ``try_cast`` so a malformed line becomes a row with a NULL and
``_ok = false`` instead of failing the job or inventing a sentinel value.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.splits import with_bucket

RATING_FIELDS = [("user_id", "bigint"), ("item_id", "bigint"), ("rating", "double"), ("ts", "bigint")]
ITEM_FIELDS = [("item_id", "bigint"), ("title", "string"), ("genres", "string")]
USER_FIELDS = [("user_id", "bigint"), ("gender", "string"), ("age", "int"),
               ("occupation", "int"), ("zip", "string")]
TAG_FIELDS = [("user_id", "bigint"), ("item_id", "bigint"), ("tag", "string"), ("ts", "bigint")]
PLAY_FIELDS = [("user_id", "bigint"), ("item_id", "bigint"), ("plays", "int")]
NAME_FIELDS = [("item_id", "bigint"), ("name", "string")]
ALIAS_FIELDS = [("bad_id", "bigint"), ("good_id", "bigint")]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path).withColumnRenamed("value", "line")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise


def parse_lines(lines: DataFrame, sep: str, fields, required: int | None = None,
                strip_line: bool = True, trim_fields=()) -> DataFrame:
    """All non-blank lines (column ``line``) with parsed columns and ``_ok``.

    ``required``: number of leading fields that must be present and parse
    (default: all). Optional trailing fields may be absent (NULL).
    """
    required = len(fields) if required is None else required
    body = F.trim(F.col("line")) if strip_line else F.col("line")
    # a generated row: filters on its fields stay above it, so a line is built and split once, not once a check
    cut = F.struct(F.split(body, re.escape(sep)).alias("parts"), (F.length(F.trim(F.col("line"))) > 0).alias("full"))
    lines = lines.select("line", F.explode(F.array(cut)).alias("_cut"))
    parts = F.col("_cut.parts")
    cols, checks = [], [F.size(parts) >= required]
    for i, (name, typ) in enumerate(fields):
        v = F.get(parts, i)
        if name in trim_fields:
            v = F.trim(v)
        c = v if typ == "string" else F.trim(v).try_cast(typ)
        cols.append(c.alias(name))
        if i < required:
            checks.append(c.isNotNull())
    ok = checks[0]
    for c in checks[1:]:
        ok = ok & c
    return lines.where("_cut.full").select(*cols, "line", ok.alias("_ok"))


def parse_delimited(spark: SparkSession, path: str, sep: str, fields, required: int | None = None,
                    strip_line: bool = True, trim_fields=()) -> DataFrame:
    """:func:`parse_lines` over the lines of a text file."""
    return parse_lines(_lines(spark, path), sep, fields, required, strip_line, trim_fields)


def split_malformed(parsed: DataFrame):
    """(good rows without the bookkeeping columns, quarantined raw lines)."""
    good = parsed.where(F.col("_ok")).drop("line", "_ok")
    bad = parsed.where(~F.col("_ok")).select("line")
    return good, bad


# How each kind of line is parsed: (separator, fields, further arguments).
LINE_KINDS = {
    "ratings": ("::", RATING_FIELDS, {}),
    "items": ("::", ITEM_FIELDS, {"required": 2}),
    "users": ("::", USER_FIELDS, {}),
    "plays": (" ", PLAY_FIELDS, {}),
    "names": ("\t", NAME_FIELDS, {"strip_line": False, "trim_fields": ("name",)}),
    "aliases": ("\t", ALIAS_FIELDS, {"strip_line": False}),
}


def parse_kind(lines: DataFrame, kind: str, sep: str | None = None) -> DataFrame:
    """Lines of one of :data:`LINE_KINDS`, parsed; malformed ones have ``_ok`` false."""
    own, fields, more = LINE_KINDS[kind]
    return parse_lines(lines, sep or own, fields, **more)


def _read(spark: SparkSession, path: str, kind: str, with_bad: bool, sep: str | None = None, then=None):
    good, bad = split_malformed(parse_kind(_lines(spark, path), kind, sep))
    good = then(good) if then else good
    return (good, bad) if with_bad else good


def read_ratings(spark: SparkSession, path: str, sep: str = "::", bucket: bool = True, with_bad: bool = False):
    """S1 (+P1): user::item::rating::ts; adds ``bucket`` = ts mod 10. Like every reader:
    ``with_bad`` returns (rows, quarantined lines)."""
    return _read(spark, path, "ratings", with_bad, sep, (lambda d: with_bucket(d, "ts")) if bucket else None)


def read_items(spark: SparkSession, path: str, sep: str = "::", with_bad: bool = False):
    """Item::title[::genres] (genres optional)."""
    return _read(spark, path, "items", with_bad, sep)


def read_users(spark: SparkSession, path: str, sep: str = "::", with_bad: bool = False):
    """S3: user::gender::age::occupation::zip."""
    return _read(spark, path, "users", with_bad, sep)


def _csv(spark: SparkSession, path: str, fields, with_bad: bool, required: int, then=None):
    """Comma CSV with a header; a record that does not parse, or lacks one of its first
    ``required`` fields, goes to the quarantine as its raw text."""
    schema = ", ".join(f"{n} {t}" for n, t in fields) + ", _raw string"
    rows = (spark.read.schema(schema).option("header", True).option("quote", '"')
            .option("escape", '"').option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_raw").csv(path))
    names = [n for n, _ in fields]
    complete = F.lit(True)
    for n in names[:required]:
        complete = complete & F.col(n).isNotNull()
    ok = F.col("_raw").isNull() & complete
    good = rows.where(ok).select(*names)
    good = then(good) if then else good
    raw = F.coalesce("_raw", F.concat_ws(",", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]))
    bad = rows.where(~ok).select(raw.alias("line"))
    return (good, bad) if with_bad else good


def parse_csv_lines(lines: DataFrame, fields, required: int, header: str | None = None) -> DataFrame:
    """CSV records in the ``line`` column of a table: quoted fields may hold commas and doubled
    quotes; ``_ok`` is false for a record that does not parse or lacks one of its first
    ``required`` fields. Lines equal to ``header`` and empty lines are left out."""
    schema = ", ".join(f"{n} {t}" for n, t in fields) + ", _raw string"
    line = F.col("line")
    kept = lines.where((F.length(F.trim(line)) > 0) & (F.lit(True) if header is None else line != F.lit(header)))
    rec = F.from_csv(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw", "quote": '"',
                                    "escape": '"'})
    out = kept.select("line", rec.alias("rec"))
    complete = F.col("rec._raw").isNull()
    for n, _ in fields[:required]:
        complete = complete & F.col(f"rec.{n}").isNotNull()
    return out.select(*[F.col(f"rec.{n}").alias(n) for n, _ in fields], "line", complete.alias("_ok"))


def read_csv_ratings(spark: SparkSession, path: str, bucket: bool = True, with_bad: bool = False):
    """Comma CSV with a header line."""
    return _csv(spark, path, RATING_FIELDS, with_bad, 4, (lambda d: with_bucket(d, "ts")) if bucket else None)


def read_csv_items(spark: SparkSession, path: str, with_bad: bool = False):
    """Comma CSV items; quoted titles may hold commas."""
    return _csv(spark, path, ITEM_FIELDS, with_bad, 2)


def read_csv_tags(spark: SparkSession, path: str, with_bad: bool = False):
    """Comma CSV tags."""
    return _csv(spark, path, TAG_FIELDS, with_bad, 4)


def read_plays(spark: SparkSession, path: str, with_bad: bool = False):
    """S7: 'user item count' separated by one space."""
    return _read(spark, path, "plays", with_bad)


def read_names(spark: SparkSession, path: str, with_bad: bool = False):
    """id<TAB>name, name trimmed."""
    return _read(spark, path, "names", with_bad)


def read_aliases(spark: SparkSession, path: str, with_bad: bool = False):
    """bad_id<TAB>good_id; malformed lines are not mapped."""
    return _read(spark, path, "aliases", with_bad)


def read_personal(spark: SparkSession, path: str, sep: str = "::") -> DataFrame:
    """Personal ratings, rating > 0 kept; a missing file or one without
    positive ratings raises."""
    df = personal_ratings(read_ratings(spark, path, sep, bucket=False))
    if df.limit(1).count() == 0:
        raise ValueError(f"no ratings provided in {path}")
    return df


def personal_ratings(ratings: DataFrame) -> DataFrame:
    """P6 on a personal file: positive ratings only."""
    return ratings.where(F.col("rating") > 0).select("user_id", "item_id", "rating")


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Metrics / recommendations / factors as a parquet table. A partitioned table is
    overwritten folder by folder: only the partitions in ``df`` are replaced, so a run that was lost
    half way is repeated with the same result and other partitions stay."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)
