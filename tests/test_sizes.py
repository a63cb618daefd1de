"""Cases that only larger or odd tables have: each gives the rows that its SQL gives."""

from __future__ import annotations

import shutil
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from loomline.plans import catalog, sessions
from loomline.plans.registry import Tables

SF = Path("/root/testdata/sf0.001")


def both(spark, tmp_path, name: str, **tables: str) -> tuple[list, list]:
    """Sorted rows of a query and of its SQL, on one thread, over the smallest tables with some of them replaced by a select."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'; set threads = 1")
    for file in SF.glob("*.parquet"):
        to = tmp_path / file.name
        if file.stem in tables:
            con.execute(f"copy ({tables[file.stem]}) to '{to}' (format parquet)")
        else:
            shutil.copyfile(file, to)
        con.execute(f"create view {file.stem} as from '{to}'")
    made = catalog.queries()[name](spark, str(tmp_path))
    columns = sorted(made.columns)
    own = made.select(*columns).collect()
    other = con.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, own), key=str), sorted(other, key=str)


EVENTS = "select event_id, ts, user_id, event_type, value, '{}' as props from (values {}) v(event_id, ts, user_id, event_type, value)"


def events(*rows: str) -> str:
    return EVENTS.replace("values {}", "values " + ", ".join(rows))


def test_pages_choose_by_full_confidence(spark, tmp_path):
    """Five observations give 0.6996, which is shown as 0.70 and is still below the 0.7 of an established record."""
    rows = [f"({i}::bigint, timestamp '2024-01-01 12:00:00', {1 if i < 5 else 2}::bigint, 'view', 1.0::double)" for i in range(11)]
    own, other = both(spark, tmp_path, "k10_memory_pages", events=events(*rows))
    assert own == other and "i2" in own[0][1] and "i1" not in own[0][1]


def test_first_of_tied_lines_stands(spark, tmp_path):
    """Lines of one order with equal date and number: the first of the file, not any."""
    line = "select (i // 2)::bigint as l_orderkey, 1::bigint as l_partkey, 1::bigint as l_suppkey, 1::int as l_linenumber, 1.0::double as l_quantity, 1.0::double as l_extendedprice, 0.0::double as l_discount, 0.0::double as l_tax, 'R' as l_returnflag, case when (i + i // 2) % 2 = 0 then 'F' else 'O' end as l_linestatus, timestamp '1995-01-01' as l_shipdate from range(0, 40) r(i)"
    orders = "select i::bigint as o_orderkey, i::bigint as o_custkey, 'P' as o_orderstatus, 1.0::double as o_totalprice, timestamp '1995-01-01' as o_orderdate, '1' as o_orderpriority from range(0, 20) r(i)"
    rows = [f"({i}::bigint, timestamp '2024-01-01', {i}::bigint, 'view', 1.0::double)" for i in range(20)]
    own, other = both(spark, tmp_path, "j15_inventory", lineitem=line, orders=orders, events=events(*rows))
    assert own == other and {r[0] for r in own} == {"F", "O"}


def test_items_are_not_searched_one_by_one(spark):
    """No plan compares texts with the items of a checklist in expressions: that took time by items times characters."""
    from loomline.operators import skills

    items = skills.checklist(spark.createDataFrame([("the", "- Check several words here\n- one\n- verify `parser` output\n- Éé ßß üü öö")], "skill_id string, markdown string"))
    texts = ["the xxchecksxx several", "the parserx verifying", "the éé ßß üü öö", "none", None, "the check several words here"]
    sessions = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "session_id int, text string, failed boolean")
    made = skills.adherence(sessions, items)
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.session_id, r.hits) for r in made.collect()} == {(0, 1), (1, 1), (2, 1), (5, 1)}
    many = items.crossJoin(spark.range(60).selectExpr("concat('s', id) as s")).drop("skill_id").withColumnRenamed("s", "skill_id")
    told = spark.createDataFrame([(0, "s7 check several", True), (1, "nothing", True)], "session_id int, text string, failed boolean")
    assert {(r.skill_id, r.session_id, r.hits) for r in skills.adherence(told, many).collect()} == {("s7", 0, 1)}
    rates = {(r.item, r.hits, r.rate) for r in skills.item_rates(sessions, items).collect()}
    assert len(rates) == 3 and all(h in (1, 2) for _, h, _ in rates)


def test_tasks_of_an_invalidation_do_not_grow(spark, monkeypatch):
    """A table of many rows is dealt to as many tasks as its rows need, whatever the number of shuffle partitions."""
    from loomline.operators import ledger
    from loomline.sources import scratch

    monkeypatch.setattr(scratch, "ROWS_A_TASK", 100)
    rows = spark.range(1000).selectExpr("id as k", "'completed' as state", "'x' as lifecycle", "'ready' as candidate_state", "true as safe_to_delete")
    made = ledger.invalidated(rows.where("k % 2 = 0"), rows, rows, rows, "k")
    assert made["queue"].where("state = 'stale'").count() == 500
    assert "RepartitionByExpression [k" in made["queue"]._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_one_folder_need_no_aggregation(spark):
    """Only records with several paths are aggregated; each pair of the others is found once."""
    from loomline.operators import recall

    paths = ["/a/x", "/a/y", "/b/x", "x", "/", "", "/a/", None]
    refs = spark.createDataFrame(list(enumerate(paths)) + [(9, "/a/z"), (9, "/b/x"), (1, "/a/y")], "id int, path string")
    targets = spark.createDataFrame([(p,) for p in ["/a/x", "/a/x", "x", "/", "", "/c/q", None]], "target string")
    made = recall.for_files(refs, targets, ["id"]).select("target", "id", "score", "kind")
    pairs = targets.distinct().crossJoin(refs).where("path is not null and target is not null").select("target", "id", recall.proximity(targets["target"], refs["path"]).alias("s"))
    best = pairs.where("s > 0").groupBy("target", "id").max("s").collect()
    assert sorted(tuple(r)[:3] for r in made.collect()) == sorted(map(tuple, best))
    plan = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [p for p in plan if "Aggregate [target" in p and "path" in p]


def test_prompt_rules_look_for_parts_first(spark):
    """Patterns with look-arounds run only where a fixed part is, and give what they gave in every text."""
    from loomline.functions import prompts

    texts = ["<b>", "x YOUR <b>role</b> is to do", "YOUR TASK IS TO x", "a /skill.MD b", "you must reply with json", "given the users most recent message", "Use BASE DIRECTORY for this skill", "ok", "turn_aborted", "turn_aborted x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    made = rows.select("t", prompts.embedded_agent(c).alias("agent"), prompts.skill_leak(c).alias("leak"), prompts.boot_line(c).alias("boot"))
    got = {r.t: (r.agent, r.leak, r.boot) for r in made.collect()}
    assert [t for t in texts if t and got[t][0]] == ["x YOUR <b>role</b> is to do", "YOUR TASK IS TO x", "you must reply with json", "given the users most recent message"]
    assert [t for t in texts if t and got[t][1]] == ["a /skill.MD b", "Use BASE DIRECTORY for this skill"]
    assert [t for t in texts if t and got[t][2]] == ["<b>", "a /skill.MD b", "turn_aborted"]
    plan = rows.select(prompts.embedded_agent(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(t" in plan or "Contains(lower" in plan


def test_classifier_learns_from_every_labelled_row(spark, monkeypatch):
    """Centre and threshold are those of all rows, in many buckets and bins."""
    import numpy as np

    from loomline.llm import quality_classifier as qc

    monkeypatch.setattr(qc, "BUCKET", 50)
    monkeypatch.setattr(qc, "FEW_VALUES", 10)
    texts = [(i, ("good words here. " if i % 3 else "BAD!! | ") * (1 + i % 17)) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in texts], "doc_id long, quality int")
    ranking = qc.train(docs, labels)
    used = [i for i, held in docs.select("doc_id", qc.held_out(F.col("doc_id"))).collect() if not held]
    x = np.array([qc.vector(texts[i][1]) for i in used])
    assert np.allclose(ranking.centre, qc.expanded(x).mean(axis=0))
    strengths = np.sort(ranking.strengths(x))
    assert np.isclose(ranking.threshold, strengths[sum(i % 3 == 0 for i in used)])


def test_turns_and_events_of_sessions_are_made_once(spark):
    """Every rule reads stored rows, not the whole way from the events again."""
    own, found = sessions.session_turns(Tables(spark, "/root/testdata/sf0.001"))
    assert own.count() > 0 and found.count() > 0
    assert not [f for frame in (own, found) for f in frame.inputFiles() if f.endswith("events.parquet")]


def test_rules_of_candidates_run_once_for_each_text(spark):
    """No rule stands in the plan over all rows: each distinct text was read once, before."""
    from loomline.operators import candidates

    rows = [("s", "p", "t", i, f"s:{i}", "decision", "decision", "We decided to use parquet" if i % 3 else None, "Decision: We decided", "", ["We decided to use parquet", "/SKILL.md"] if i % 2 else None, "high") for i in range(12)]
    schema = "session_id string, project_key string, turn_id string, line int, learning_id string, kind string, basis string, statement string, title string, trigger string, evidence array<string>, confidence string"
    made = candidates.finalized(spark.createDataFrame(rows, schema))
    assert "Base directory" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.line, r.statement, tuple(r.evidence)) for r in made.collect()} == {(i, "We decided to use parquet", ("We decided to use parquet",)) for i in range(12) if i % 3}


def test_columns_of_distinct_values_equal_those_of_rows(spark, monkeypatch):
    """Nulls, arrays and repeats come back to every row, by a broadcast or not."""
    from loomline.sources import scratch

    rows = spark.createDataFrame([(i, [None, "a", "b", ""][i % 4], [["x"], None, []][i % 3]) for i in range(60)], "i int, t string, a array<string>")
    expected = sorted((r.i, r.t, r.a, r.n) for r in rows.withColumn("n", F.concat_ws("-", "t", "a")).collect())
    for few in (scratch.FEW_BYTES, -1):
        monkeypatch.setattr(scratch, "FEW_BYTES", few)
        seen = []
        made = scratch.once_each(rows, ["t", "a"], lambda v: seen.append(v.count()) or v.withColumn("n", F.concat_ws("-", "t", "a")), "test")
        assert seen == [12] and made.columns == ["i", "t", "a", "n"]
        assert sorted(((r.i, r.t, r.a, r.n) for r in made.collect()), key=lambda r: r[0]) == expected


def test_rules_look_for_fixed_parts_first(spark):
    """A rule is looked for only where one of its fixed parts is, and is found in the same texts as before."""
    from loomline.functions import prompts, statements, text
    from loomline.operators import candidates

    patterns = [*statements.NARRATION, *statements.DURABLE_DECISION, *candidates.INSTRUCTION, *prompts.BOOT_LINES, *prompts.NO_SIGNAL, statements.DEAD_END, statements.PAST, candidates.SPEC_WORDS, candidates.CONCRETE_TASK]
    assert text.fixed_parts(r"\bfix(?:ed)?\b") == ("fix",) and text.fixed_parts(r"\b(?:one|two) x") == ("one", "two") and not text.fixed_parts(r"^once\b") and not text.fixed_parts(r"a?\z")
    texts = ["LET ME", "xlet me", "I’ll checK this", "I'll checK this", "update ONLY", "update only this", "won’t work", "#  AGENTS.md", "hello!", "a\nhello!", "ok", "CREATE A big spec", "abandonedé", "use it, because", "İs canonical", "fixed", " fixed", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    for p in patterns:
        assert not rows.where(~text.matches(c, p).eqNullSafe(c.rlike(text.rule(p)))).collect(), p
    some = rows.select(text.matches_any(c, patterns).alias("a"), F.greatest(*(c.rlike(text.rule(p)) for p in patterns)).alias("b"))
    assert not some.where(~F.col("a").eqNullSafe(F.col("b"))).collect()
    plan = rows.select(statements.narration(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan


def test_a_run_reads_stored_records_and_changes(spark, tmp_path, monkeypatch):
    """Grouped records and the changes of lessons are read several times, and are not made again each time."""
    from loomline.operators import run
    from loomline.plans import dialects

    files, tagged, fold = {}, run.events.tagged, run.instincts.fold
    monkeypatch.setattr(run.events, "tagged", lambda rows: files.update(records=rows.inputFiles()) or tagged(rows))
    monkeypatch.setattr(run.instincts, "fold", lambda rows: files.update(changes=rows.inputFiles()) or fold(rows))
    lines = dialects.overlay_lines(Tables(spark, "/root/testdata/sf0.001"))
    assert run.run(lines, str(tmp_path / "run"), F.lit("2024-04-01 00:00:00").cast("timestamp")).count() >= 0
    assert files["records"] and all("loomline-grouped" in f or "loomline-read" in f for f in files["records"])
    assert files["changes"] and all("loomline-deltas" in f for f in files["changes"])
