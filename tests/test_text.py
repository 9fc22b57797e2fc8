import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.udfs import long_edits, long_token_edits
from quillspark.operators import recognition as R

ROWS = [
    ("d1", "0", 0, "Ala ma", "Ala ma"), ("d1", "0", 1, "kota", "kotą"), ("d1", "1", 2, "żółć", "zolc"), ("d2", "0", 3, "", "x"), ("d2", "0", 4, "a  b", "a b"),
]
SCHEMA = "document_id string, line_id string, ord int, ground_truth string, prediction string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(
    "level, expected",
    [("word", (5, 0.4, 0.8, 6 / 17, 0.5, 1.2)), ("line", (3, 0.0, 1 / 3, 7 / 18, 0.5, 7 / 3)), ("document", (2, 0.0, 0.0, 7 / 19, 0.5, 3.5))],
)
def test_levels(spark, level, expected):
    got = R.evaluate(spark.createDataFrame(ROWS, SCHEMA), level).first()
    assert (got["count"], got["ema"], got["near_perfect_match"], got["cer"], got["wer"], got["levenshtein_distance"]) == pytest.approx(expected)


def test_empty_truths_and_tables(spark):
    got = R.evaluate(spark.createDataFrame([("d", "0", 0, "", "x")], SCHEMA)).first()
    assert got["cer"] == 0 and got["wer"] == 0
    got = R.evaluate(spark.createDataFrame([], SCHEMA)).first()
    assert got["count"] == 0 and got["ema"] == 0 and got["cer"] == 0


def test_guards(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="line_id"):
        R.evaluate(df.drop("line_id"))
    with pytest.raises(ValueError, match="level"):
        R.evaluate(df, "page")
    with pytest.raises(ValueError):
        T.within("a", "b", -1)


def test_distances(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices("ab żć", k=rng.randint(0, 12))), " ".join(rng.choices("ab żć", k=rng.randint(0, 12)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "l string, r string").select(T.normalize("l").alias("l"), T.normalize("r").alias("r"))
    df = df.select("l", "r", T.edits("l", "r").alias("e"), T.token_edits(T.tokens("l"), T.tokens("r")).alias("t"))
    for row in df.collect():
        assert row.e == distance(row.l, row.r)
        assert row.t == distance(row.l.split(), row.r.split())


def test_long_distances(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(["ab", "żć", "a", "b"], k=rng.randint(0, 90))), " ".join(rng.choices(["ab", "żć", "c"], k=rng.randint(0, 90)))) for _ in range(40)] + [(None, "a"), ("", ""), ("", "a b")]
    df = spark.createDataFrame(rows, "l string, r string")
    for row in df.select("l", "r", long_edits("l", "r").alias("e"), long_token_edits("l", "r").alias("t")).collect():
        if row.l is None:
            assert row.e is None and row.t is None
        else:
            assert row.e == distance(row.l, row.r) and row.t == distance(row.l.split(), row.r.split())


def test_levels_without_order(spark):
    """Rows are joined as they are read."""
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1).drop("ord")
    for level in R.LEVELS:
        with_order = R.evaluate(spark.createDataFrame(ROWS, SCHEMA), level).first()
        assert R.evaluate(df, level).first() == with_order
    assert [r.level for r in R.report(df).collect()] == list(R.LEVELS)


def test_names(spark):
    df = spark.createDataFrame([("x/doc_a_007.png",), ("scan.png",), ("a_1_b.jpg",)], "p string")
    document, line = T.sample_ids("p")
    assert [tuple(r) for r in df.select(document, line).collect()] == [("doc_a", "007"), ("scan", "0"), ("a_1_b", "0")]
    df = spark.createDataFrame([("a/b  c#d",), ("",)], "p string")
    assert [r[0] for r in df.select(T.safe_name("p")).collect()] == ["a_b_c_d", "unnamed"]
    df = spark.createDataFrame([("50% {a_b}\\",)], "p string")
    assert df.select(T.latex_escape("p")).first()[0] == r"50\% \{a\_b\}\textbackslash{}"
    df = spark.createDataFrame([(None,), (float("inf"),), (0.5,)], "v double")
    assert [r[0] for r in df.select(T.format_number("v")).collect()] == ["n/a", "n/a", "0.5000"]


def test_first_key(spark):
    df = spark.createDataFrame([('{"label": "b", "value": "c"}',)], "j string")
    assert df.select(T.first_key("j")).first()[0] == "b"
    assert df.select(T.joined(F.array(F.lit(" a "), F.lit(""), F.lit("b")))).first()[0] == "a b"
