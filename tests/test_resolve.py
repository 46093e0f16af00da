import pytest
from pyspark.sql import functions as F

from tests import world
from zonewalk.operators import fetch
from zonewalk.operators.report import report
from zonewalk.plans import resolve as R
from zonewalk.sources.readers import TIMED


def run(spark, compat=False):
    hosts = spark.createDataFrame([(h,) for h in world.HOSTS], "query string")
    suffixes = spark.createDataFrame(world.SUFFIXES, "suffix string")
    roots = spark.createDataFrame(world.ROOTS, "ns string, ip string")
    facts, trouble = R.reports(hosts, world.responses(spark), suffixes, roots, compat)
    return {r.query: r for r in report(hosts, facts, trouble).collect()}, trouble.collect()


@pytest.fixture(scope="module")
def reports(spark):
    return run(spark)


def kinds(trouble, query):
    return {(r.kind, r.name) for r in trouble if r.query == query}


def test_plain_zone(reports):
    r, trouble = reports
    ok = r["ok.com."]
    assert ok.ns == ["ns1.ok.com.", "ns2.ok.com."]
    assert ok.ipv4 == ["10.1.0.1", "10.1.0.2"] and ok.ipv6 == ["2001:db8::2"]
    assert ok.tld == ["com."] and ok.sld == ["ok.com."]
    assert not kinds(trouble, "ok.com.") and ok.ps_ns == []


def test_case_and_missing_dot_give_the_same_facts(reports):
    r, _ = reports
    assert r["Ok.COM"][1:] == r["ok.com."][1:]


def test_nameserver_of_another_zone_is_walked(reports):
    r, trouble = reports
    assert {"ns1.deep.com.", "x.deep.com."} <= set(r["ext.com."].ns)
    assert {"10.3.0.1", "10.3.0.2"} <= set(r["ext.com."].ipv4)
    assert set(r["ext.com."].sld) == {"ext.com.", "deep.com."}
    assert not kinds(trouble, "ext.com.")


def test_public_suffix_servers_are_set_apart(reports):
    r, _ = reports
    assert r["a.co.uk."].ns == ["ns1.a.co.uk."] and r["a.co.uk."].ps_ns == ["dns1.nic.uk."]
    assert r["a.co.uk."].ps_ipv4 == [world.NICUK] and r["a.co.uk."].sld == ["a.co.uk."]


def test_hazards(reports):
    r, trouble = reports
    assert kinds(trouble, "gone.com.") == {("hazardous", "gone.com.")}
    assert kinds(trouble, "www.gone.com.") == {("hazardous", "gone.com.")}
    assert kinds(trouble, "dangling.com.") == {("hazardous", "gone.com."), ("hazardous", "dangling.com.")}
    assert [s.nameserver for s in r["gone.com."].hazardous_domains["gone.com."]] == [world.COM]


def test_misconfigurations(reports):
    r, trouble = reports
    assert ("ip_ns_records", "9.") in kinds(trouble, "ipns.com.")
    assert set(r["ipns.com."].misconfigured_domains["ip_ns_records"]) == {"9."}
    assert kinds(trouble, "lame.com.") == {("missing_ns_records", "lame.com.")}
    assert set(r["lame.com."].misconfigured_domains) == {"missing_ns_records"}


def test_silent_servers_and_empty_answers_are_no_problem(reports):
    r, trouble = reports
    for host in ("slow.com.", "ent.x.com.", "a.ent.x.com.", "host.ok.com."):
        assert not kinds(trouble, host), host
    assert "ns.a.ent.x.com." in r["a.ent.x.com."].ns  # by the full name, asked at ent.x.com.


def test_mutual_nameservers_are_cyclic(reports):
    r, trouble = reports
    for host in ("p.com.", "q.com."):
        assert {k for k, _ in kinds(trouble, host)} == {"cyclic"}
        assert r[host].hazardous_domains == {}


def test_degenerate_names_have_empty_reports(reports):
    r, _ = reports
    assert r["."].ns == [] and r[""].hazardous_domains == {}


def test_compat_reports_a_leaf_host_as_hazardous(spark):
    _, trouble = run(spark, compat=True)
    assert ("hazardous", "host.ok.com.") in kinds(trouble, "host.ok.com.")


def frame(spark, answers):
    rows = [(d, s, x if isinstance(x, int) else 0, False, i, line) for (d, s), x in answers.items() for i, line in enumerate([None] if isinstance(x, int) else x)]
    return spark.createDataFrame(rows, world.SCHEMA)


def found(spark, hosts, answers, compat=False):
    """(query, category, value) for hosts in a world of its own."""
    facts, trouble = R.reports(
        spark.createDataFrame([(h,) for h in hosts], "query string"), frame(spark, answers), spark.createDataFrame(world.SUFFIXES, "suffix string"), spark.createDataFrame(world.ROOTS, "ns string, ip string"), compat
    )
    return {(r.query, r.category, r.value) for r in facts.collect()}, {(r.query, r.kind, r.name) for r in trouble.collect()}


def test_all_servers_stay_in_charge_where_one_has_nothing(spark):
    """One server of x.com. has nothing for ent.x.com., the other says that it does not exist, and knows what is below it."""
    zone = [*world.ns("x.com.", "n1.x.com.", "n2.x.com."), world.a("n1.x.com.", "10.6.0.1"), world.a("n2.x.com.", "10.6.0.2")]
    deep = [*world.ns("a.ent.x.com.", "deep.a.ent.x.com."), world.a("deep.a.ent.x.com.", "10.6.0.9")]
    answers = {
        ("com.", world.ROOT): world.COM_ANSWER, ("com.", world.COM): world.COM_ANSWER,
        ("x.com.", world.COM): zone, ("x.com.", "10.6.0.1"): zone, ("x.com.", "10.6.0.2"): zone,
        ("ent.x.com.", "10.6.0.1"): 0, ("ent.x.com.", "10.6.0.2"): world.NX,
        ("a.ent.x.com.", "10.6.0.2"): deep, ("a.ent.x.com.", "10.6.0.9"): deep,
    }
    facts, trouble = found(spark, ["a.ent.x.com."], answers)
    assert ("a.ent.x.com.", "ns", "deep.a.ent.x.com.") in facts and not trouble


def test_hosts_with_answers_by_their_whole_name_do_not_share_states(spark):
    """ent.x.com. has no records; its server answers for a.ent.x.com. by the whole name, but not for b.ent.x.com."""
    zone = [*world.ns("x.com.", "n1.x.com."), world.a("n1.x.com.", "10.6.0.1")]
    deep = [*world.ns("a.ent.x.com.", "deep.a.ent.x.com."), world.a("deep.a.ent.x.com.", "10.6.0.9")]
    answers = {
        ("com.", world.ROOT): world.COM_ANSWER, ("com.", world.COM): world.COM_ANSWER, ("x.com.", world.COM): zone, ("x.com.", "10.6.0.1"): zone,
        ("ent.x.com.", "10.6.0.1"): 0, ("ent.x.com.", "10.6.0.9"): 0, ("a.ent.x.com.", "10.6.0.1"): deep, ("a.ent.x.com.", "10.6.0.9"): deep, ("b.ent.x.com.", "10.6.0.1"): 0,
    }
    facts, trouble = found(spark, ["a.ent.x.com.", "b.ent.x.com."], answers)
    assert ("a.ent.x.com.", "ns", "deep.a.ent.x.com.") in facts
    assert not {f for f in facts if f[0] == "b.ent.x.com." and "deep" in f[2]} and not trouble


def test_names_above_are_asked_once_however_many_hosts(spark):
    zone = [*world.ns("x.com.", "n1.x.com."), world.a("n1.x.com.", "10.6.0.1")]
    answers = {("com.", world.ROOT): world.COM_ANSWER, ("com.", world.COM): world.COM_ANSWER, ("x.com.", world.COM): zone, ("x.com.", "10.6.0.1"): zone}
    hosts = [f"h{i}.x.com." for i in range(30)]
    answers |= {(h, "10.6.0.1"): [world.a(h, "10.6.1.1")] for h in hosts}
    answers |= {(h, "10.6.1.1"): [world.a(h, "10.6.1.1")] for h in hosts}
    done = R.resolve(spark.createDataFrame([(h,) for h in hosts], "query string"), frame(spark, answers), spark.createDataFrame(world.SUFFIXES, "suffix string"), spark.createDataFrame(world.ROOTS, "ns string, ip string"))
    asked = done.asked.select("name", "who", "pass", "ip").collect()
    assert len(asked) == len(set(asked)) and len([r for r in asked if r.name in ("com.", "x.com.")]) == 4
    assert {r.query for r in R.reached(spark.createDataFrame([(h,) for h in hosts], "query string"), done).where("name = 'com.'").collect()} == set(hosts)


def walk(spark, rows, host):
    """Facts of `host` and the questions asked, call by call, of a world of rows (domain, server, lines or code)."""
    calls = []
    table = spark.createDataFrame([(d, s, 0 if isinstance(x, list) else x, False, i, t) for d, s, x in rows for i, t in (enumerate(x) if isinstance(x, list) and x else [(0, None)])], world.SCHEMA)

    def port(questions):
        calls.append([(q.domain, q.nameserver) for q in questions.collect()])
        return table.join(questions, ["domain", "nameserver"], "left_semi")

    facts, trouble = R.reports(spark.createDataFrame([(host,)], "query string"), port, spark.createDataFrame([("com.",)], "suffix string"), spark.createDataFrame(world.ROOTS, "ns string, ip string"))
    return {(r.category, r.value) for r in facts.collect()}, trouble.collect(), calls


@pytest.mark.parametrize("silence", ["empty", "missing"])
def test_silence_above_is_asked_again_by_the_whole_name(spark, silence):
    below = [*world.ns("a.b.com.", "ns.b.com."), *world.ns("b.com.", "ns.b.com."), world.a("ns.b.com.", "10.9.0.1")]
    rows = [("com.", world.ROOT, world.COM_ANSWER), ("com.", world.COM, world.COM_ANSWER), ("a.b.com.", world.COM, below), ("b.com.", "10.9.0.1", below), ("a.b.com.", "10.9.0.1", below)]
    rows += [("b.com.", world.COM, [])] if silence == "empty" else []
    facts, trouble, calls = walk(spark, rows, "a.b.com.")
    assert {("ns", "ns.b.com."), ("ipv4", "10.9.0.1"), ("sld", "b.com.")} <= facts and not trouble
    every = [q for c in calls for q in c]
    assert len(every) == len(set(every))
    assert set(every) == {("com.", world.ROOT), ("com.", world.COM), ("b.com.", world.COM), ("a.b.com.", world.COM), ("b.com.", "10.9.0.1"), ("a.b.com.", "10.9.0.1")}


def test_questions_follow_the_answers(spark):
    questions, port = [], fetch.table_port(world.responses(spark))

    def asking(q):
        questions.extend((r.domain, r.nameserver) for r in q.collect())
        return port(q)

    hosts = spark.createDataFrame([("ok.com.",), ("gone.com.",)], "query string")
    facts, trouble = R.reports(hosts, asking, spark.createDataFrame(world.SUFFIXES, "suffix string"), spark.createDataFrame(world.ROOTS, "ns string, ip string"))
    assert len(questions) == len(set(questions))
    assert {d for d, _ in questions} == {"com.", "ok.com.", "gone.com."}
    assert {(r.query, r.kind) for r in trouble.collect()} == {("gone.com.", "hazardous")}


def test_a_port_derives_its_table_once(spark):
    """The recorded answers are derived once, however often the port is asked."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(domain):
        read.add(1)
        return domain

    answers = world.responses(spark)
    port = fetch.table_port(answers.withColumn("domain", noted("domain")))
    questions = answers.select("domain", "nameserver").distinct()
    assert port(questions).count() == port(questions).count() == answers.count() == read.value


def test_answers_are_kept_from_run_to_run(spark, tmp_path):
    """gone.com. comes to exist; only its question, and those that follow from its answer, are asked in the second run."""
    hosts = spark.createDataFrame([("ok.com.",), ("gone.com.",), ("dangling.com.",)], "query string")
    suffixes, roots = spark.createDataFrame(world.SUFFIXES, "suffix string"), spark.createDataFrame(world.ROOTS, "ns string, ip string")
    before = world.responses(spark)
    new = [*world.ns("gone.com.", "ns.gone.com."), world.a("ns.gone.com.", "10.9.0.1")]
    rows = [(d, s, 0, False, i, line) for d, s in (("gone.com.", world.COM), ("gone.com.", "10.9.0.1")) for i, line in enumerate(new)]
    after = before.where("domain <> 'gone.com.'").unionByName(spark.createDataFrame(rows, world.SCHEMA))
    changed = fetch.changed(before.withColumns({c: F.lit(None).cast("int") for c in fetch.CODES[1:3]}), after.withColumns({c: F.lit(None).cast("int") for c in fetch.CODES[1:3]}))
    assert {(r.domain, r.nameserver) for r in changed.collect()} == {("gone.com.", world.COM), ("gone.com.", "10.9.0.1")}
    R.resolve(hosts, before, suffixes, roots).answers.write(str(tmp_path / "kept"))
    kept, asked = R.Answers.read(spark, str(tmp_path / "kept")), []

    def port(questions):
        asked.extend((r.domain, r.nameserver) for r in questions.collect())
        return fetch.table_port(after)(questions)

    known = {(r.domain, r.nameserver) for r in kept.questions.collect()}
    done = R.resolve(hosts, port, suffixes, roots, kept=kept.without(changed))
    assert ("gone.com.", world.COM) in asked and not set(asked) & (known - {("gone.com.", world.COM)})
    rows_of = lambda frames: [sorted(map(str, f.collect())) for f in frames]
    assert rows_of(R.told(hosts, done, suffixes)) == rows_of(R.reports(hosts, after, suffixes, roots))


def test_walks_over_the_limit_leave_the_frontier(spark):
    """w.n.com. is over the limit by itself. What n.com. still asks then waits until late.com., which is within it, comes to need n.com.

    both.com. is over it only together with the name that it needs, and unlike w.n.com. was followed to the end.
    """
    far, own = "10.8.0.1", "10.8.0.2"
    told = {
        ("com.", world.ROOT): world.COM_ANSWER, ("com.", world.COM): world.COM_ANSWER,
        ("n.com.", world.COM): [*world.ns("n.com.", "ns1.n.com.", "ns.far.com."), world.a("ns1.n.com.", own)],
        ("n.com.", own): [*world.ns("n.com.", "ns1.n.com.")], ("n.com.", far): world.ns("n.com.", "ns1.n.com."),
        ("w.n.com.", own): world.ns("w.n.com.", "ns.lost.com."), ("b.n.com.", own): [world.a("b.n.com.", "10.8.0.4")],
        ("far.com.", world.COM): [*world.ns("far.com.", "x.far.com."), world.a("x.far.com.", "10.8.0.3")],
        ("ns.far.com.", "10.8.0.3"): [world.a("ns.far.com.", far)],
        **{(f"{a}.com.", world.COM): world.ns(f"{a}.com.", f"a.{b}.com.") for a, b in (("late", "mid"), ("mid", "more"), ("more", "most"), ("most", "last"), ("both", "late"))},
        ("last.com.", world.COM): world.ns("last.com.", "b.n.com."), ("lost.com.", world.COM): world.ns("lost.com.", "ns.lost.com."),
    }
    seconds = {("w.n.com.", own): 20.0, ("late.com.", world.COM): 6.0, ("both.com.", world.COM): 5.0}
    rows = [(d, s, 0, 0, 0, False, i, line, seconds.get((d, s))) for (d, s), lines in told.items() for i, line in enumerate(lines)]
    answers, calls = fetch.table_port(spark.createDataFrame(rows, TIMED)), []

    def port(questions):
        calls.append({(r.domain, r.nameserver) for r in questions.collect()})
        return answers(questions)

    hosts = spark.createDataFrame([("w.n.com.",), ("late.com.",), ("both.com.",)], "query string")
    done = R.resolve(hosts, port, spark.createDataFrame(world.SUFFIXES, "suffix string"), spark.createDataFrame(world.ROOTS, "ns string, ip string"), limit=10.0)
    asked_in = {q: i for i, c in enumerate(calls) for q in c}
    assert asked_in[("n.com.", far)] == asked_in[("b.n.com.", own)] > asked_in[("ns.far.com.", "10.8.0.3")] + 1
    assert ("lost.com.", world.COM) not in asked_in and ("mid.com.", world.COM) in asked_in
    reach = R.reached(hosts, done)
    took = {r.query: r.seconds for r in R.spent(reach, done).collect()}
    assert took == {"w.n.com.": 20.0, "late.com.": 6.0, "both.com.": 11.0}
    assert [r.query for r in R.within(hosts, reach, done, 10.0).collect()] == ["late.com."]
