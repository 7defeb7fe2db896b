"""Hits by a taxonomy that is a table: the same as by one pattern, for many aliases too."""

import random

from pyspark.sql import functions as F

from rolefit.functions import extraction as E
from rolefit.functions import vocab
from rolefit.operators import taxonomy as Tx
from tests.test_extraction import derived_hits


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


def table_of(spark, taxonomy):
    return spark.createDataFrame([(s, a) for s, names in taxonomy.items() for a in names], "skill string, alias string")


def found(df, taxonomy):
    return {r["i"]: sorted((h["skill"], h["label"]) for h in r["h"]) for r in Tx.with_hits(df, "h", F.col("t"), taxonomy).collect()}


def test_equals_the_pattern(spark):
    texts = ["required: python, sql and c++; nice to have: node.js", "we use machine learning. learning is a must", "", None, "  sql",
             "mysql and sql_server, not docker", "ſql kubernetes, ci/cd", "sales cycle and sales", "sql " * 300, "python\n\tpython"]
    df = rows_of(spark, texts * 2)
    expected = {r["i"]: sorted((h["skill"], h["label"]) for h in r["h"]) for r in E.with_hits(df, "h", F.col("t")).collect() if r["t"] is not None}
    got = found(df, table_of(spark, vocab.SKILL_ALIASES))
    assert got.pop(3) == got.pop(13) == [] and got == expected


def test_fifty_thousand_aliases(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdeis", k=draw.randint(1, 5))) for _ in range(3000)]
    taxonomy = {f"skill {i}": [" ".join(draw.choices(words, k=draw.randint(1, 3))) + draw.choice(["", "", "++", "#", ".js"]) for _ in range(2)] for i in range(25_100)}
    twice = [s for s, names in taxonomy.items() if names[0] == names[1]]
    taxonomy = {s: names for s, names in taxonomy.items() if s not in twice}  # the pattern counts a repeated alias twice
    assert sum(map(len, taxonomy.values())) >= 50_000
    names = [a for aliases in taxonomy.values() for a in aliases]
    texts = []
    for _ in range(25):
        parts = draw.choices(names, k=draw.randint(0, 6)) + draw.choices(words, k=6) + draw.choices(["required", "preferred", "not"], k=2)
        draw.shuffle(parts)
        texts.append(draw.choice([" ", ", ", "/", " .", "x"]).join(parts))
    got = found(rows_of(spark, texts), table_of(spark, taxonomy))
    for i, text in enumerate(texts):
        near = {s: mine for s, names in taxonomy.items() if (mine := [a for a in names if a in text])}
        assert got[i] == sorted(derived_hits(text, near)), text


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "sql", "a"), (1, "sql", "b"), (None, "c++ ++", "c")], "i int, t string, alias string")
    odd = spark.createDataFrame([("db", "SQL"), ("db", "SQL"), ("query", "sql"), (None, "sql"), ("x", None), ("y", ""), ("z", "++"), ("cpp", "C++")], "skill string, alias string")
    out = Tx.with_hits(df, "h", F.col("t"), odd)
    assert out.columns == ["i", "t", "alias", "h"]
    assert sorted((r["alias"], sorted(h["skill"] for h in r["h"])) for r in out.collect()) == [("a", ["db", "query"]), ("b", ["db", "query"]), ("c", ["cpp"])]
    assert all(r["h"] == [] for r in Tx.with_hits(df, "h", F.col("t"), odd.limit(0)).collect())
    assert Tx.with_hits(df.limit(0), "h", F.col("t"), odd).count() == 0


def test_texts_are_made_once_and_never_broadcast(spark, monkeypatch):
    """The words and the hits read the same written texts; what is found for each text grows with them."""
    names, write = [], Tx.written
    monkeypatch.setattr(Tx, "written", lambda df, name: names.append(name) or write(df, name))
    df = rows_of(spark, ["sql and ſql", "python"]).withColumn("t", F.concat("t", F.lit(" once")))
    out = Tx.with_hits(df, "h", F.col("t"), table_of(spark, vocab.SKILL_ALIASES))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "texts" in names and " once" not in plan and f"BroadcastHashJoin [{Tx.KEY}" not in plan
    assert "translate" not in plan and "SortMergeJoin [word#" in plan
