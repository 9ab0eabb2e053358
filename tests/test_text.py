import random

from pyspark.sql import functions as F

from folioscope.functions import text as X

ALPHABET = "aBé Ü.5-'\t  #|_ß"


def samples(n=300):
    rng = random.Random(1)
    return ["", "NASA", "Title Case Line", "3.pdf's", "  x  "] + [
        "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_expressions_equal_python(spark):
    data = [(i, s) for i, s in enumerate(samples())]
    df = spark.createDataFrame(data, "i int, s string").select(
        "i", X.strip(F.col("s")).alias("strip"), X.estimate_tokens(F.col("s")).alias("tok"),
        X.is_upper(F.col("s")).alias("up"), X.is_title(F.col("s")).alias("ti"),
        X.title_case(F.col("s")).alias("tc"), X.squash(F.col("s")).alias("sq"))
    for r in df.collect():
        s = data[r.i][1]
        assert r.strip == s.strip()
        assert r.sq == " ".join(s.split())
        assert r.tok == (max(1, int(round(len(s) / 4))) if s.strip() else 0)
        assert r.up == s.isupper()
        assert r.ti == s.istitle()
        if "ß" not in s:  # one letter becomes two
            assert r.tc == s.title()


def test_token_fixture(spark):
    df = spark.createDataFrame([("",), ("x" * 49,), ("x" * 10,)], "s string").select(X.estimate_tokens(F.col("s")))
    assert [r[0] for r in df.collect()] == [0, 12, 2]
