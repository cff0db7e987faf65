from datetime import date

import sys
from pathlib import Path

import pytest
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    def make(rows, partitions=2):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1]) if r[1] else 0) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)
    return make


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names the operators use themselves."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    names = ["n", "tokens", "text_md5", "__gone", "h", "class", "key", "fp", "block", "lk", "stratum", "id", "line", "__body", "__g", "__id", "__b", "__key", "__h", "row", "text "]
    schema = StructType([*DOCS.fields, *[StructField(c, LongType() if i % 2 else DateType()) for i, c in enumerate(names)]])
    base = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n \t\n", None, None), (4, long, "en", "a"), (5, "same text here twice", "en", "b"),
            (5, "same text here twice", "en", "b"), (6, "same text here twice", None, "b"), (None, "without an id at all", "en", None),
            (None, None, None, None), (7, "x" * 50_000, "de", "a"), (8, "1" * 30_000 + " " + "a@" * 2_000, "de", "a"), (9, "é ß ñ Σ İ 漢字 \x00 \x1c 👩‍👧 <|endoftext|>", "fr", "a")]
    rows = [(*r, None, *[(i if k % 2 else date(2020, 1, 1)) for k in range(len(names))]) for i, r in enumerate(base)]
    return spark.createDataFrame(rows, schema)
