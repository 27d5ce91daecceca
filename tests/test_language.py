import duckdb
from pyspark.sql import functions as F

from parlance.functions import language as L
from parlance.plans.analytics import _language_sql


def test_confidence_is_that_of_sql_to_the_bit(spark):
    """Summed confidences are held against LEAD, so a last bit can change the language in charge."""
    said = [(n, a, " ".join(["hasta"] * a + ["que"] + ["uvw"] * (n - a - 1))) for n in range(4, 24) for a in range(1, n)]
    rows = [(i, text) for i, (_, _, text) in enumerate(said)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE said (i BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO said VALUES (?, ?)", rows)
    theirs = dict(duck.sql(f"WITH {_language_sql('said', 'i')} SELECT i, confidence FROM guess").fetchall())
    found = spark.createDataFrame(rows, "i long, text string").select("i", L.detect(F.col("text"))["confidence"])
    assert dict(map(tuple, found.collect())) == theirs
