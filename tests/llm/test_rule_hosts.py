"""Rules without a host never match; rules are literals of the plan."""

from touchline.llm import url_rules


def test_rules_without_a_host(spark):
    rules = url_rules.rules_frame(spark, (("", "/", "block"), (None, "/", "block"), ("a.b", None, "block"), ("B", "/x", "allow")))
    pages = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://q.b/x"), (3, "http:///x"), (4, None), (5, "http://c/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.apply_url_rules(pages, rules).collect()}
    assert got == {1: ("a.b", "block"), 2: ("B/x", "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow")}


def test_no_python_rows_in_the_plan(spark):
    rules = url_rules.rules_frame(spark)
    plan = rules._jdf.queryExecution().toString()
    assert "ExternalRDD" not in plan and "LogicalRDD" not in plan and rules.count() == len(url_rules.RULES)
