"""SQL functions, golden cases, the contract's catalogue."""

import importlib

from pyspark.sql import functions as F

from sparksieve import api
from sparksieve.operators.rules import Rule
from sparksieve.sources import corpus


def test_sql_functions(spark):
    api.register_functions(spark)
    rows = spark.sql("SELECT * FROM scan_findings('ping john@example.com')").collect()
    assert [(r["rule_id"], r["off"], r["end"]) for r in rows] == [("email-address", 5, 21)]
    assert spark.sql("SELECT mask_text('ping john@example.com', 'low') AS m").first()["m"] == "ping " + "•" * 8
    assert spark.sql("SELECT check_us_aba('011000015') AS a, check_us_aba('011000016') AS b").first()[:] == (True, False)


def test_cases_round_trip(spark, tmp_path):
    cases = spark.createDataFrame([("a", "ping john@example.com", "BLOCKED", ["email-address"], []), ("b", "hello", "FORWARDED", None, None)], corpus.CASE)
    corpus.write_cases(cases, f"file://{tmp_path}/cases")
    back = corpus.read_cases(spark, f"file://{tmp_path}/cases")
    f = api.scan(back, "name", "prompt", layers=False)
    got = {r["name"]: (r["expect"] == r["got"], r["missing"]) for r in corpus.judge_cases(back, f).collect()}
    assert got == {"a": (True, []), "b": (True, [])}
    assert api.rule_coverage(f, spark).count() == 89
    assert {(r["category"], r["n"]) for r in api.rollup(f).collect()} == {("pii", 1), (None, 1)}


def test_knobs():
    assert api.parse_severity(" HIGH ") == "high" and api.parse_action("") == "block"
    for f, bad in ((api.parse_severity, "urgent"), (api.parse_action, "drop")):
        try:
            f(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert api.coverage()["rules"] == 49


def test_own_rules_and_sources(spark):
    from sparksieve.operators import rules
    from sparksieve.plans import scan as plan

    api.register_rule(Rule("ticket", "internal", "low", r"\bTICKET-\d{4}\b", ("ticket-",)))
    api.register_source("none", lambda p, i, t: plan.detect(p, i, t).where("false"))
    try:
        df = spark.createDataFrame([(1, "see TICKET-1234")], "payload_id long, text string")
        assert [r["rule_id"] for r in api.scan(df, layers=False).collect()] == ["ticket"]
    finally:
        rules._EXTRA.clear()
        plan._SOURCES.clear()


def test_follow_log(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    q = corpus.follow_log(spark, f"file://{tmp_path}").writeStream.format("memory").queryName("tail").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["value"] for r in spark.table("tail").collect()) == ["one", "two"]


def test_contract(spark):
    e = importlib.import_module("__spark_entry__")
    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(sql) >= 37 and all(callable(f) for f in names.values())
    assert e.entry(spark).columns == ["category", "severity", "n", "documents"]
    assert F.lit(1) is not None
