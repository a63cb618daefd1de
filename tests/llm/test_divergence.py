"""Source divergence against plain Python over all terms and pairs, and against DuckDB."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from loomline.llm import divergence
from loomline.llm.queries import OP11_SQL, op11_divergence

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, least=3, top=200):
    """The rule restated: every term of a language for every group and pair."""
    docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        sources[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, of in sources.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def level(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: level(counts[lang, s]) for s in of}
        q = level(sum((counts[lang, s] for s in of), Counter()))
        for s in of:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in of if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked[:most], 1)]
    return sorted(out)


def made(frame):
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in frame.collect())


def test_query_equals_sql_and_plain_python(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{SF}/documents.parquet'")
    own = made(op11_divergence(spark, SF))
    assert own == sorted(con.execute(OP11_SQL).fetchall())
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert own == audited(rows)


def test_random_sources(spark):
    rng = random.Random(5)
    words = ["Aa", "b", "é", "É", "ß", "日本", "ab", "zz", "I", "x1y", "q"]
    rows = [(" ".join(rng.choices(words[: rng.randrange(1, 12)], k=rng.randrange(0, 9))), rng.choice("ab"), rng.choice(["s", "t", "u", "v"])) for _ in range(120)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    for least, top in ((1, 200), (3, 2), (10, 5)):
        assert made(divergence.audit(frame, least, top)) == audited(rows, least, top)


def test_defined_cases(spark):
    rows = [
        ("a a b", None, None), ("a b", None, None), ("A, b!", None, "s"), (None, None, "t"), ("", None, "quiet"),  # nulls are ''; groups without terms
        ("x y", "rare", "s"), ("y z", "rare", "t"), ("y", "rare", "t"), ("only", "one", "s"), ("only", "one", "s"), ("only", "one", "s"),  # one term kept; one source
        ("no", "none", "s"), ("term", "none", "t"), ("w " * 50_000, "long", "s"), ("w", "long", "t"), ("w", "long", "t"),  # none kept; a long text; repeated rows
    ]
    want = audited(rows)
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    own = made(divergence.audit(frame))
    assert own == want
    assert [r for r in own if r[0] == "none"] == [("none", "s", "pair", "t", 0, 1), ("none", "t", "pair", "s", 0, 1)]
    assert not [r for r in own if r[0] == "one"]
    clashing = frame.select("*", F.lit(1).alias("l"), F.lit(2).alias("at"), F.lit("x").alias("term"), F.lit(0).alias("n"), F.lit("y").alias("item"))
    assert made(divergence.audit(clashing)) == want
    assert made(divergence.audit(frame.limit(0))) == []


def test_levels_of_very_large_counts(spark):
    counts = [(0, 10), (8_999_999_998, 9_000_000_001), (9_000_000_000, 10**10), (5 * 10**17, 9 * 10**17)]
    frame = spark.createDataFrame([(c, t, 7) for c, t in counts], "c long, t long, v long")
    got = [r.p for r in frame.select(F.expr(divergence.level("c", "t", "v")).alias("p")).collect()]
    assert got == [1 + 10**9 * (c + 1) // (t + 7) for c, t in counts]


def test_counts_in_pieces_and_parts(spark, monkeypatch):
    """Texts longer than a piece, more terms than a task holds, bytes at the edges of letters; a task's counts are few rows."""
    text = "Ab ab@Z[z`{\u007f\u0080É é x " * 40 + "e" * 300
    rows = [(1, 0, text.encode()), (1, 1, b"ab cd"), (2, 0, b""), (1, 0, b"ab AB new")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["l", "at", "text"])
    want_n, want_docs = Counter(), Counter()
    for l, at, t in rows:
        terms = [w.encode() for w in TERM.findall(t.decode().translate(LOWER))]
        want_n.update((l, at, w) for w in terms)
        want_docs.update({(l, at, w) for w in terms})
    for piece, most in ((1 << 20, 300_000), (7, 2), (1, 1)):
        monkeypatch.setattr(divergence, "PIECE", piece)
        monkeypatch.setattr(divergence, "MOST_HELD", most)
        n, docs, size = Counter(), Counter(), 0
        for part in divergence._counted(iter([batch])):
            for row in part.to_pylist():
                n[row["l"], row["at"], row["term"]] += row["n"]
                docs[row["l"], row["at"], row["term"]] += row["docs"]
                size += 1
        assert n == want_n and docs == want_docs
        assert most < 300_000 or size == len(want_n)
