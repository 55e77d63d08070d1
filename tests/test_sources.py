"""Readers on generated text files (FIXTURES.md §1), malformed lines included."""

import pytest
from pyspark.sql import functions as F

from factorlab.sources import text as X


def write(tmp_path, name, content, encoding="utf-8"):
    p = tmp_path / name
    p.write_text(content, encoding=encoding)
    return str(p)


def test_read_ratings_and_bucket(spark, tmp_path):
    p = write(tmp_path, "ratings.dat",
              "7::12::4::978300760\n7::13::0.5::978300761\n8::12::5::978300762\n"
              "8::12::3::978300799\n9::14::0::978300770\n  10::15::2::978300771  \nshort::line\n")
    df = X.read_ratings(spark, p)
    rows = {(r.user_id, r.item_id, r.ts): (r.rating, r.bucket) for r in df.collect()}
    assert rows[(7, 12, 978300760)] == (4.0, 0)
    assert rows[(7, 13, 978300761)] == (0.5, 1)
    assert rows[(10, 15, 978300771)] == (2.0, 1)
    assert len(rows) == 6  # the short line is quarantined, the duplicate pair kept
    good, bad = X.split_malformed(X.parse_delimited(spark, p, "::", X.RATING_FIELDS))
    assert [r.line for r in bad.collect()] == ["short::line"]


def test_read_items_two_and_three_fields(spark, tmp_path):
    p = write(tmp_path, "movies.dat",
              "12::Blue Harbor (1999)::Comedy|Children's|Sci-Fi\n13::Café Noir (1947)::Film-Noir\n14::Only Title\n")
    df = X.read_items(spark, p).orderBy("item_id")
    rows = df.collect()
    assert rows[0].genres == "Comedy|Children's|Sci-Fi"
    assert rows[1].title == "Café Noir (1947)"
    assert rows[2].genres is None and rows[2].title == "Only Title"


def test_read_users(spark, tmp_path):
    p = write(tmp_path, "users.dat", "7::F::25::4::55117-1203\n8::M::35::x::12345\n")
    rows = X.read_users(spark, p).collect()
    assert [(r.user_id, r.gender, r.age, r.occupation, r.zip) for r in rows] == [(7, "F", 25, 4, "55117-1203")]


def test_read_csv_quoted_titles(spark, tmp_path):
    p = write(tmp_path, "movies.csv",
              'movieId,title,genres\n1,"Toy Story, The (1995)",Animation|Comedy\n2,Heat (1995),Crime\n')
    rows = X.read_csv_items(spark, p).orderBy("item_id").collect()
    assert rows[0].title == "Toy Story, The (1995)"
    assert rows[1].genres == "Crime"
    r = write(tmp_path, "ratings.csv", "userId,movieId,rating,timestamp\n1,2,3.5,1112486027\n")
    assert X.read_csv_ratings(spark, r).first().bucket == 7
    t = write(tmp_path, "tags.csv", "userId,movieId,tag,timestamp\n1,2,\"funny, dark\",1112486027\n")
    assert X.read_csv_tags(spark, t).first().tag == "funny, dark"


def test_plays_names_aliases_quarantine(spark, tmp_path):
    plays = write(tmp_path, "user_artist_data.txt", "1 10 5\n1 11 3\n2 10 x\n")
    assert X.read_plays(spark, plays).count() == 2
    names = write(tmp_path, "artist_data.txt", "10\t  Some Band \nno tab here\nabc\tBad Id\n11\tOther\n")
    good, bad = X.read_names(spark, names, with_bad=True)
    assert {(r.item_id, r.name) for r in good.collect()} == {(10, "Some Band"), (11, "Other")}
    assert bad.count() == 2
    aliases = write(tmp_path, "artist_alias.txt", "11\t10\n\t10\n12\t11\n")
    good, bad = X.read_aliases(spark, aliases, with_bad=True)
    assert {(r.bad_id, r.good_id) for r in good.collect()} == {(11, 10), (12, 11)}
    assert bad.count() == 1


def test_alias_one_hop(spark, tmp_path):
    from factorlab.operators.relational import resolve_aliases
    aliases = X.read_aliases(spark, write(tmp_path, "a.txt", "11\t10\n12\t11\n"))
    plays = X.read_plays(spark, write(tmp_path, "p.txt", "1 12 5\n1 11 2\n1 10 1\n"))
    got = sorted((r.item_id, r.plays) for r in resolve_aliases(plays, aliases).collect())
    assert got == [(10, 1), (10, 2), (11, 5)]  # 12 -> 11 only, not on to 10


def test_read_personal(spark, tmp_path):
    p = write(tmp_path, "personalRatings.txt", "0::1::4::1\n0::2::0::2\n0::3::5::3\n")
    assert sorted(r.item_id for r in X.read_personal(spark, p).collect()) == [1, 3]
    empty = write(tmp_path, "empty.txt", "")
    with pytest.raises(ValueError):
        X.read_personal(spark, empty)
    zeros = write(tmp_path, "zeros.txt", "0::1::0::1\n")
    with pytest.raises(ValueError):
        X.read_personal(spark, zeros)
    with pytest.raises(FileNotFoundError):
        X.read_personal(spark, str(tmp_path / "missing.txt"))


def test_write_table_roundtrip(spark, tmp_path):
    df = spark.range(5).withColumn("split", F.when(F.col("id") < 3, "train").otherwise("test"))
    out = str(tmp_path / "out")
    X.write_table(df, out, partition_by=["split"])
    back = spark.read.parquet(out)
    assert back.count() == 5 and set(back.columns) == {"id", "split"}


def test_every_reader_offers_its_quarantine(spark, tmp_path):
    cases = [
        (X.read_ratings, "7::12::4::9\n7::12::x::9\n1::2\n", 1, {"7::12::x::9", "1::2"}),
        (X.read_items, "12::A::B\nx::A\n", 1, {"x::A"}),
        (X.read_users, "7::F::25::4::55117\n7::F::old::4::55117\n", 1, {"7::F::old::4::55117"}),
        (X.read_plays, "1 2 3\n1 2\n", 1, {"1 2"}),
        (X.read_csv_ratings, "u,m,r,t\n1,2,3.5,4\n1,2,bad,4\n1,2\n,2,3.0,4\n", 1,
         {"1,2,bad,4", "1,2", ",2,3.0,4"}),
        (X.read_csv_items, "m,t,g\n1,\"A, B\",C\nx,T,G\n", 1, {"x,T,G"}),
        (X.read_csv_tags, "u,m,t,s\n1,2,x,3\n1,2,x,soon\n", 1, {"1,2,x,soon"}),
    ]
    for k, (reader, content, n_good, lines) in enumerate(cases):
        good, bad = reader(spark, write(tmp_path, f"f{k}.txt", content), with_bad=True)
        assert good.count() == n_good, reader.__name__
        assert {r.line for r in bad.collect()} == lines, reader.__name__
        assert "line" not in good.columns


def test_line_is_built_and_split_once(spark):
    """Filters on parsed fields do not carry the line's expression with them."""
    lines = spark.range(20).select(F.concat(F.md5(F.col("id").cast("string")), F.lit("::"), "id").alias("line"))
    good, bad = X.split_malformed(X.parse_lines(lines, "::", [("a", "string"), ("b", "bigint")]))
    for d in (good, bad):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1 and plan.count("split(") == 1
    assert sorted(r["b"] for r in good.collect()) == list(range(20)) and bad.count() == 0
