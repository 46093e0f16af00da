from pyspark.sql import functions as F

from zonewalk.operators import fetch, records


def rows(spark, *lines):
    return records.tokenise(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq int, rr_text string"))


def test_tokenise_drops_comments_blanks_and_short_lines(spark):
    got = rows(spark, "a.com. 60 IN A 1.2.3.4 more\n; note\n\n a.com.\t 60  IN NS ns.a.com.", "too short", None).orderBy("seq").collect()
    assert [(r.name, r.type, r.data) for r in got] == [("a.com.", "A", "1.2.3.4"), ("a.com.", "NS", "ns.a.com.")]


def test_types_and_routing(spark):
    r = rows(spark, "a.com. 1 IN A 1.1.1.1", "a.com. 1 IN AAAA 2001:DB8::1", "a.com. 1 IN TXT x")
    assert records.of_types(r, ("ANY",)).count() == 3 and records.of_types(r, ("TXT",)).count() == 1
    assert {(x.ip, x.kind) for x in records.addresses(r).collect()} == {("1.1.1.1", "ipv4"), ("2001:db8::1", "ipv6")}


def test_last_wins_by_data(spark):
    r = rows(spark, "a.com. 1 IN NS x.", "b.com. 1 IN NS x.").withColumn("response", F.lit(1))
    assert [x.name for x in records.last_wins(r, ["response"]).collect()] == ["b.com."]


def test_outcomes_follow_the_decision_table(spark):
    answers = spark.createDataFrame([("n.", "1", 2, False, 0, False), ("n.", "2", 0, True, 3, False), ("n.", "3", 0, False, 0, False), ("full.", "3", 1, False, 0, False), ("n.", "4", 0, False, 0, False), ("full.", "4", 0, True, 3, False), ("n.", "5", 0, False, None, True)], "domain string, nameserver string, n long, nx boolean, rcode int, timeout boolean").withColumns({c: F.col("rcode") for c in ("rcode_a", "rcode_aaaa")})
    asked = spark.createDataFrame([("n.", "full.", str(i)) for i in range(1, 7)] + [("n.", "n.", "3")], "name string, original string, ip string")
    got = {(r.original, r.ip): (r.answer, r.reuse) for r in fetch.outcomes(asked, answers).collect()}
    assert got == {("full.", "1"): ("n.", False), ("full.", "2"): (None, False), ("full.", "3"): ("full.", False), ("full.", "4"): (None, False), ("full.", "5"): (None, True), ("full.", "6"): (None, True), ("n.", "3"): (None, True)}


def test_last_attempt(spark):
    log = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "done"), ("b", 1, "failed")], "k string, n int, s string")
    assert {(r.k, r.attempts, r.s) for r in fetch.last_attempt(log, ["k"], "n", ["s"]).collect()} == {("a", 2, "done"), ("b", 1, "failed")}
