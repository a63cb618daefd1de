"""Fill-in-the-middle against plain Python and DuckDB, and exact restoring."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from loomline.llm import fill_in_middle as fim
from loomline.llm.queries import OP13_SQL, op13_fill_in_middle

SF = "/root/testdata/sf0.01"


def transformed(doc_id, text, seed=7, rate=100, spm=50):
    """n, form, prefix, middle, suffix, output."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_sql_and_plain_python(spark):
    made = op13_fill_in_middle(spark, SF)
    own = sorted(tuple(r) for r in made.collect())
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, form, p, m, _, out = transformed(r.doc_id, r.text)
        want.append((r.doc_id, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(r.text or "")))
    assert own == sorted(want) and {w[2] for w in want} >= {"psm", "spm"}
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    assert own == sorted(con.execute(OP13_SQL).fetchall())


def test_restoring_any_text(spark):
    rng = random.Random(9)
    parts = ["<", "S>", "<S", ">", "\n", "a", "<P", "M>", "<M", "\r\n", "é", "\U0001f600", "P>", " ", "\x00", "\\E"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(600)] + [None, "", "\n", "\n\n\n", "<P>", "x<M>y", "line " * 200_000, "l\n" * 100_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a\nb\nc\n", "clash")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, output string")
    for rate, spm in ((100, 50), (60, 0), (0, 50), (100, 100)):
        made = fim.transform(frame, rate=rate, spm_rate=spm).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert all(r.back == (r.text or "") for r in made)
        own = [(r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in made]
        assert own == [transformed(r.doc_id, r.text, rate=rate, spm=spm) for r in made]


def test_other_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a\nb", 3, "x", "y")], "doc_id long, text string, n int, _units string, _ string")
    made = fim.transform(frame)
    assert made.columns == ["doc_id", "text", "_units", "_", *fim.RESULTS] and (made.first().n, made.first()._units, made.first()["_"]) == (2, "x", "y")
    assert fim.transform(frame.limit(0)).count() == 0
    assert fim.transform(frame, seed=8).first().output == transformed(1, "a\nb", seed=8)[-1]
