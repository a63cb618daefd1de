"""Line de-duplication against a plain loop."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from loomline.llm import line_dedup
from loomline.llm.queries import op6_line_dedup

SF = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(WHITE))


def dropped(rows, least, keep):
    """n_lines, n_dropped, text of each row."""
    docs, first = defaultdict(set), {}
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            k = key_of(line)
            docs[k].add((i, t or ""))
            first[k] = min(first.get(k, (i, pos)), (i, pos))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if not (key_of(x) and len(docs[key_of(x)]) >= least) or (keep == "first" and first[key_of(x)] == (i, pos))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_query_equals_a_loop(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in dropped(rows, 10, "none")]
    made = sorted(tuple(r) for r in op6_line_dedup(spark, SF).collect())
    assert made == want and any(m[2] for m in made)


def test_first_occurrence_stays(spark):
    rows = [(i, f"Same Line\nown {i}\n same line \n\ntwice {i % 2}") for i in range(12)] + [(50, None), (51, ""), (52, "\n\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for keep in ("first", "none"):
        made = line_dedup.dedup(frame, min_docs=5, keep=keep).select("doc_id", "_n_lines", "_n_dropped", "text").collect()
        assert sorted(tuple(r) for r in made) == dropped(rows, 5, keep)


def test_extra_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a", "x"), (None, "a", "y")], "doc_id long, text string, pos string")
    made = line_dedup.dedup(frame, min_docs=2)
    assert made.columns[:3] == ["doc_id", "text", "pos"] and [r.text for r in made.collect()] == ["", ""]
    assert line_dedup.dedup(frame.limit(0)).count() == 0
