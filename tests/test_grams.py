import random

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folioframe.operators import grams as G

ROWS = StructType([StructField("id", LongType()), StructField("text", StringType())])
SEARCHES = StructType([StructField("search_id", LongType()), StructField("needle", StringType())])


def test_equals_a_scan(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcAB é漢\n%_\\ß") for _ in range(n))
    rows = [(i, text(rng.choice([0, 1, 2, 3, 5, 30, 200]))) for i in range(300)] + [(900, None), (901, "aaaa" * 50), (902, "straße"), (903, "x" * 100_000 + "needle")]
    searches = [(i, text(rng.choice([0, 1, 2, 3, 4, 6]))) for i in range(80)] + [(900, None), (901, "aaa"), (902, "STRASSE"), (903, "Needle"), (904, "nowhere"), (905, "%"), (906, "ß")]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    fold = lambda s: s.replace("ß", "ss").lower()
    want = {(s, i) for s, n in searches if n for i, t in rows if t and fold(n) in fold(t)}
    got = [tuple(r) for r in G.find_containing(G.build_grams(df, "id", "text"), df, spark.createDataFrame(searches, SEARCHES), "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    empty = df.filter("id < 0")
    assert G.find_containing(G.build_grams(empty, "id", "text"), empty, spark.createDataFrame(searches, SEARCHES), "id", "text").count() == 0


def test_capitals_as_in_sql(spark):
    """The search in capitals of the query finds what the SQL's finds, letters of wide capitals and a last sigma included."""
    import duckdb

    from folioframe.functions.common import upper_by_symbol
    texts = ["hß. x", "schß. Ö", "HSS. y", "weiß", "ΟΔΟΣ ΑΣΜΑ", "ὁδός", "ᾳ ῃ ᾀ", "İstanbul", "ﬁn", "ŉ", "straße", "a'b"]
    df = spark.createDataFrame(list(enumerate(texts)), ROWS)
    asked = df.select((F.col("id") + 100).alias("search_id"), upper_by_symbol(F.substring("text", 1, 4)).alias("needle"))
    got = {tuple(r) for r in G.find_containing(G.build_grams(df, "id", "text"), df, asked, "id", "text").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute("""SELECT a.id + 100, b.id FROM (SELECT id, upper(substr(text, 1, 4)) AS n FROM t) a JOIN t b
        ON contains(lower(replace(b.text, 'ß', 'ss')), lower(replace(n, 'ß', 'ss')))""").fetchall()
    assert got == set(want)
