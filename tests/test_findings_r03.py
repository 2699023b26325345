"""One small test for each finding of round 3 that was settled in the code."""

from __future__ import annotations

import difflib
import random

import duckdb

from inkspan import registry
from inkspan.operators import udfs


def test_p02_compares_whole_texts(spark):
    """a like beginning isn't enough, an unlike one doesn't part texts that are alike as a whole; bounds change no answer."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    body, other, head, start = ([word() for _ in range(n)] for n in (1500, 1500, 100, 100))
    rows = [(1, "s", " ".join(head + body)), (2, "s", " ".join(start + body)), (3, "s", " ".join(head + other)), (4, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert [tuple(x) for x in udfs.near_duplicates(docs).collect()] == [(2, 1)]
    for k in (0, 5, 12, 16, 20, 30, 150):
        a, b = body[:150], body[:150]
        for at in r.sample(range(150), k):
            b[at] = word()
        for x, y in ((" ".join(a), " ".join(b)), (" ".join(a), " ".join(b[70:] + b[:70]))):
            assert udfs._alike(x, y) == (difflib.SequenceMatcher(None, x, y, False).ratio() >= udfs.LIKENESS)


def test_w05_elements_come_in_one_pass(spark, tmp_path):
    """elements are worked out in an Arrow pass, not in trees of expressions, and agree with SQL on odd texts."""
    odd = ["Énormément, “said” she (to them)...", "It's — well -- a TION: nation; thou hast!", "Is it? And so be it. Oh \u00e9l\u00e8ve, ２ ² Ⅷ 漢字 x_1", "O\u0301ne.\r\n\r\nTwo\n \n", "was walked is created\tas if like a"]
    r = random.Random(3)
    texts = [None, "", " \n", "a " * 199, "a " * 200, "word." * 200, *(" ".join(r.choice(odd) for _ in range(60)) for _ in range(6))]
    spark.createDataFrame([(k, f"s{k % 2}", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("v01_profile_elements", "w05_sections"):
        found = registry.QUERIES[name](spark, str(tmp_path))
        assert "[aeiouy]+" not in found._jdf.queryExecution().toString()
        want = c.sql(f"select {', '.join(found.columns)} from ({registry.ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and want
