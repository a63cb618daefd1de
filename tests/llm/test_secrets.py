"""Secret spans: the base forms against a plain loop, the randomness tests on known strings."""

from __future__ import annotations

import base64
import hashlib
import random
import re

from loomline.llm import secrets
from loomline.llm.queries import op7_secrets

SF = "/root/testdata/sf0.01"
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans)


def test_base_spans_equal_a_loop(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op7_secrets(spark, SF).collect():
        spans = base(rows[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in joined.split(",") if s]


def test_random_strings_stand_out_from_patterns():
    rng = random.Random(5)
    keys = [base64.b64encode(rng.randbytes(30)).decode() for _ in range(100)]
    words = ["abcabcabcabcabcabcabcabcabc1", "1111111111111111111111111111", "abcdefghijklmnopqrstuvwxyz01"]
    scores = [secrets.randomness(k, secrets.encoding(k)) for k in keys]
    assert sum(s > 0.01 for s in scores) >= 90
    assert all(secrets.randomness(w, secrets.encoding(w)) < 0.01 for w in words)


def test_thresholds_hold_the_rate():
    table = [("hex", 0, 39, False, 100), ("hex", 0, 39, True, 1), ("hex", 0, 10, False, 50), ("hex", 0, 10, True, 149)]
    assert secrets.thresholds(table, 0.02) == {("hex", 0): 11}
    assert secrets.thresholds([("hex", 0, 39, False, 5)], 0.02) == {}


def test_edge_cases(spark):
    key = "AKIA" + "Z9" * 8
    rows = [(1, None, 1), (2, "", 1), (3, "Token: abcdef", 1), (4, "TOKEN = abc", 1), (5, f"x {key} y", 1), (6, "0" * 24, 1), (7, "é token='abc_123' " * 3_000, 1), (7, "é token='abc_123' " * 3_000, 1)]
    made = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, found int")).collect()
    by = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found if s.kind != "random"] for r in made}
    assert by[1] == by[2] == by[4] == [] and by[3] == [("assign", 0, 13)] and by[5] == [("access", 2, 2 + len(key))] and by[6] == [("hex", 0, 24)]
    assert len(by[7]) == 3_000 and by[7][0] == ("assign", 2, 16) and len(made) == 8
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_keys_of_every_encoding_and_length_are_found(spark):
    rng = random.Random(11)
    words = "The report says that every harbour office Keeps its own book of ships and 12 crews since 1987 and Nobody reads them now".split()
    rows, planted = [], {}
    for name, alphabet in secrets.ALPHABETS.items():
        for length in secrets.LENGTHS[:-1]:
            for i in range(30):
                key = "".join(rng.choice(alphabet) for _ in range(length))
                before = " ".join(rng.choices(words, k=40)) + " " if i % 2 else ""  # every other document is only a key
                planted[len(rows)] = (name, length, len(before), len(before) + length)
                rows.append((len(rows), before + key + (" " + " ".join(rng.choices(words, k=40)) if before else "")))
    plain = range(len(rows), len(rows) + 200)
    rows += [(i, " ".join(rng.choices(words, k=80))) for i in plain]
    made = {r.doc_id: {(s.start, s.end) for s in r.found if s.kind == "random"} for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {}
    for i, (name, length, start, end) in planted.items():
        share.setdefault((name, length), []).append((start, end) in made[i])
    assert {k: sum(v) / len(v) for k, v in share.items() if sum(v) / len(v) < 0.75} == {}
    assert not any(made[i] for i in plain)


def test_decoys_keep_their_own_statistics():
    assert secrets.decoy("x" * 20 + " Efface a bad decade, 7 faced; zzz", 0, 20, "hex") == "effaceabaddecade7fac"
    spans = secrets.candidates(f"{'a1' * 10} and {'b2' * 10} end")
    assert [s[:2] for s in spans] == [(0, 20), (25, 45)] and secrets._without(f"{'a1' * 10} and {'b2' * 10} end", spans) == " " * 20 + " and " + " " * 20 + " end"


def test_too_few_decoys_take_what_stands_in():
    fixed = secrets._bin(secrets.LEAST_P) + 1
    table = [("hex", 0, 39, False, 5), ("hex", 3, 39, False, 100), ("hex", 3, 39, True, 1), ("hex", 3, 33, True, 99), ("HEX", 0, 39, False, 5), ("HEX", 0, 39, True, 1)]
    assert secrets.limits(table, 0.02) == {("hex", 0): 34, ("hex", 3): 34, ("HEX", 0): fixed}
    assert secrets.limits([("hex", 0, 39, False, 10), ("hex", 0, 39, True, 100)], 0.02) == {("hex", 0): secrets.BINS}
