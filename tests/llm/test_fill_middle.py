"""Fill-in-the-middle texts against a plain version in Python."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from tieout.llm import fill_middle, queries


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return len(u), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(u), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle(spark, monkeypatch):
    rng = random.Random(4)
    odd = [None, "", " ", "a", "one\ntwo", "has <P> in it", "<", "<P", "S>", "é日 x\x00y\r\n", "𝒳" * 50, "word " * 60_000, "<S", "M>x<"]
    texts = odd + ["".join(rng.choice(["ab", "C", " ", "\n", "é", "<", ">", "P>", "9"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = [*enumerate(texts), (3, "a"), (3, "a"), (None, "no id here"), (None, None), (-5, "minus five")]
    monkeypatch.setattr(fill_middle, "STEP_BYTES", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "key": F.lit(None), "n": F.lit(1)})
    got = fill_middle.fill_middle(df, keep=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(i, *(b := brute(i, t))[:4], sha(b[4]), sha(t or ""), b[4]) for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(df.limit(0)).collect() == []
    assert dict(fill_middle.fill_middle(df.withColumn("doc_id", F.col("doc_id").cast("string")).where("doc_id = '7'")).dtypes)["doc_id"] == "string"


def test_sql(spark, tmp_path):
    spark.createDataFrame([*enumerate([None, "", "some words, and 3 more\n<x>"] * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_fill_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op13_fill_middle"])
    names = [d[0] for d in want.description]
    key = lambda r: str(r)
    assert sorted(names) == sorted(got.columns) and sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
