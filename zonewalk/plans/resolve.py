"""Bulk resolution of host names against a response table: rounds of joins up to a fixed point.

Every name is resolved once, whoever asks for it: a state is a name and a pass. Names are visited from the top-level domain
down; each is asked in two passes, first at the servers of the name above, then at those that this gives. Nameservers
that come without an address and lie under another registrable name are resolved themselves, with the names above them.
Each round joins only what the round before found. Sets only grow, so the result does not depend on any order; what
stays empty is classified afterwards, and facts reach the hosts at the end, along the names that each depends on.

Questions are asked as they come up: each round asks the port what its new states need and no store has, so a question is
asked once and none that nobody needs. The port is a table of recorded answers or any function of questions, a live one too.

An empty answer, a missing one too, is asked again by the whole name of the walk, so there the states of a name differ by
who asks. When a round meets such an answer, the walks below it ask by their own names; those that are told something leave
the shared states (`who` is empty) and are walked again under their own name (`who`).

Answers may come with the seconds that they took. A question is asked once but charged to every host that needs it (`spent`).
With a limit, walks that are over it by themselves leave the frontier: what only they need is not asked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonewalk.functions import names
from zonewalk.functions.suffix import Rules, prepared, sld, tld, with_suffix
from zonewalk.operators import fetch, records, report
from zonewalk.plans.closure import reachable
from zonewalk.plans.components import on_cycles
from zonewalk.plans.storage import Growing, stored

MAX_ROUNDS = 200
#: Gives the answers (readers.RESPONSES) to questions (domain, nameserver); what it leaves out has timed out.
Port = Callable[[DataFrame], DataFrame]
QUESTION = ["domain", "nameserver"]
NAME = ["name", "who"]
STATE = [*NAME, "pass"]


@dataclass
class Answers:
    """What a port said: questions with the summary of their answer, and the records in it. Kept from run to run."""

    questions: DataFrame
    records: DataFrame

    def without(self, changed: DataFrame) -> Answers:
        """All but what was said to `changed` (domain, nameserver)."""
        gone = changed.select(*QUESTION).distinct()
        return Answers(self.questions.join(gone, QUESTION, "left_anti"), self.records.join(gone.toDF("answer", "ip"), ["answer", "ip"], "left_anti"))

    def write(self, path: str) -> None:
        self.questions.write.mode("overwrite").parquet(f"{path}/questions")
        self.records.write.mode("overwrite").parquet(f"{path}/records")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Answers:
        return Answers(spark.read.parquet(f"{path}/questions"), spark.read.parquet(f"{path}/records"))


@dataclass
class Resolution:
    """visited: names with their suffix split; asked: questions with their outcome; auth: servers with addresses by state;

    found: nameservers named by state; used: records that counted; needs: nameservers that a name waits for; origins: who
    each origin asks as; answers: what the port said, for the next run.
    """

    visited: DataFrame
    asked: DataFrame
    auth: DataFrame
    found: DataFrame
    used: DataFrame
    needs: DataFrame
    origins: DataFrame
    answers: Answers
    compat: bool


def _chain(origins: DataFrame) -> DataFrame:
    """`origins` (origin, ...) with (depth, name, parent) of every name from the top-level domain down."""
    chain = origins.select("*", F.posexplode(names.superdomains(names.labels(F.col("origin")))).alias("depth", "name"))
    return chain.withColumns({"depth": F.col("depth") + 1, "parent": names.parent_name(names.labels(F.col("name")))})


class Asked:
    """What a port was asked and what it said, in earlier runs too (`kept`): the memo of a resolution."""

    def __init__(self, spark: SparkSession, port: Port, compat: bool, kept: Answers | None = None) -> None:
        self.port, self.compat = port, compat
        self.answers, self.records = Growing(spark, "answers"), Growing(spark, "records")
        if kept:
            self.answers.add(kept.questions.withColumn("elapsed", F.lit(0.0)))  # no time of this run
            self.records.add(kept.records)

    def ask(self, questions: DataFrame) -> None:
        """Ask those of `questions` (domain, nameserver) that were not asked before."""
        fresh = questions.select(*QUESTION).distinct()
        if self.answers.schema:
            fresh = fresh.join(self.answers.all().select(*QUESTION), QUESTION, "left_anti")
        fresh = stored(fresh, "questions")
        if self.answers.schema and fresh.isEmpty():
            return
        said = stored(self.port(fresh), "said")
        self.answers.add(fresh.join(fetch.summaries(said), QUESTION, "left").na.fill({"n": 0, "nx": False, "timeout": True, "elapsed": 0.0}))
        rows = records.tokenise(said.select(*QUESTION, "seq", "rr_text"))
        rows = records.last_wins(rows, QUESTION) if self.compat else rows
        self.records.add(rows.select(F.col("domain").alias("answer"), F.col("nameserver").alias("ip"), F.col("name").alias("owner"), "type", "data"))

    def silent(self, questions: DataFrame) -> DataFrame:
        """Those of `questions` (name, ip, ...) that were answered with nothing."""
        none = self.answers.all().where("n = 0 and not nx").select(F.col("domain").alias("name"), F.col("nameserver").alias("ip"))
        return questions.join(none, ["name", "ip"], "left_semi")


class Shared:
    """Walks that share states, and the silent servers above them: which of the walks must be walked by themselves."""

    def __init__(self, spark: SparkSession, asked: Asked) -> None:
        self.asked, self.servers, self.left = asked, Growing(spark, "silent"), Growing(spark, "left")

    def leaving(self, serving: DataFrame, new_origins: DataFrame, origins: DataFrame) -> DataFrame | None:
        """Of `origins` (origin, is_ns, who) those that a server says something to by their own name which is silent above them.

        serving: (name, who, ip, ...) of this round. Only the round's silent servers meet all walks; known ones meet new walks.
        """
        now = self.asked.silent(serving.where("who = ''").select("name", "ip").distinct())
        known = self.servers.all() if self.servers.schema else None
        now = stored(now.join(known, ["name", "ip"], "left_anti") if known else now, "silent")
        if now.isEmpty() and not known:
            return None
        self.servers.add(now)
        below = lambda walks, servers: _chain(walks.where("who = ''").select("origin").distinct()).where("name <> origin").join(servers, "name").select("origin", "ip")
        met = [below(origins, now)] + ([below(new_origins, known)] if known else [])
        own = stored(_union(met).distinct(), "own-questions")
        if own.isEmpty():
            return None
        self.asked.ask(own.select(F.col("origin").alias("domain"), F.col("ip").alias("nameserver")))
        told = self.asked.answers.all().where("n > 0 or nx").select(F.col("domain").alias("origin"), F.col("nameserver").alias("ip"))
        leave = own.join(told, ["origin", "ip"], "left_semi").select("origin").distinct()
        return self.left.add(leave.join(self.left.all(), "origin", "left_anti") if self.left.schema else leave)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def resolve(hosts: DataFrame, responses: DataFrame | Port, suffixes: DataFrame | Rules, roots: DataFrame, compat: bool = False, kept: Answers | None = None, limit: float | None = None) -> Resolution:
    """Resolve `hosts` (query) with responses (readers.RESPONSES, or a port that is asked for them) and roots (ns, ip).

    kept: answers of an earlier run with the same `compat`, without those that no longer hold: the port is asked for what
    they lack, and what they say too much has no effect.

    limit: seconds that the questions of one host may take in all (see `within`). Walks over it by themselves are not
    followed further, as no host that needs them is within it; addresses that only they would have met are not known.

    compat: owners match as substrings, records of one response with the same data collapse, and a query with addresses
    but no nameservers is not its own nameserver. Blank names and the root name are skipped. Raises RuntimeError if
    there is no fixed point in MAX_ROUNDS rounds.
    """
    spark, suffixes = hosts.sparkSession, prepared(suffixes)
    memo = Asked(spark, fetch.table_port(responses) if isinstance(responses, DataFrame) else responses, compat, kept)
    shared = Shared(spark, memo)
    root = roots.orderBy("ns", "ip").first()  # the choice of a root server is the first by name
    origins, visited, asked, used, told, auth, needs, reused = (Growing(spark, n) for n in ("origins", "visited", "asked", "used", "told", "auth", "needs", "reused"))
    start = hosts.select(names.norm_host(F.col("query")).alias("origin")).where("origin is not null and origin <> '.'").distinct()
    new_origins = origins.add(start.select("origin", F.lit(not compat).alias("is_ns"), F.lit("").alias("who")))
    told.add(roots.select(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("who"), F.lit(None).cast("int").alias("pass"), F.lower("ns").alias("ns"), "ip").distinct())
    new_auth = over = None
    held = Growing(spark, "held")
    for _ in range(MAX_ROUNDS):
        # Names not visited yet, with their split.
        fresh = _chain(new_origins.select("origin", "who")).select("name", "who", "parent", (F.col("depth") == 1).alias("top")).distinct()
        if visited.schema:
            fresh = fresh.join(visited.all().select(*NAME), NAME, "left_anti")
        new_names = visited.add(with_suffix(fresh, "name", suffixes).drop("subdomain"))
        every = visited.all()
        # Servers to ask: a root server at the top, those of the name above in pass 0, those found by pass 0 in pass 1.
        servers = [new_names.where("top").select(*NAME, F.lit(0).alias("pass"), F.lit(root.ns.lower()).alias("ns"), F.lit(root.ip).alias("ip"))]
        below = lambda children, known: children.select(*NAME, "parent").join(known.where("pass = 1").select(F.col("name").alias("parent"), "who", "ns", "ip"), ["parent", "who"]).select(*NAME, F.lit(0).alias("pass"), "ns", "ip")
        if new_auth is not None:
            servers += [new_auth.where("pass = 0").select(*NAME, F.lit(1).alias("pass"), "ns", "ip"), below(every, new_auth), below(new_names, auth.all())]
        serving = _union([*servers, held.all()] if held.schema else servers).distinct()
        if asked.schema:
            serving = serving.join(asked.all().select(*STATE, "ns", "ip"), [*STATE, "ns", "ip"], "left_anti")
        serving = stored(serving, "serving")
        if over is not None:  # what a later walk within the limit comes to need is asked then
            live = _live(origins.all(), over)
            held.add(serving.join(live, NAME, "left_anti"))
            serving = stored(serving.join(live, NAME, "left_semi"), "serving")
        memo.ask(serving.select(F.col("name").alias("domain"), F.col("ip").alias("nameserver")))
        if shared.left.schema:
            again = memo.silent(serving.where("who not in ('', name)"))
            memo.ask(again.select(F.col("who").alias("domain"), F.col("ip").alias("nameserver")))
        leaving = shared.leaving(serving, new_origins, origins.all())
        original = F.when(F.col("who") == "", F.col("name")).otherwise(F.col("who")).alias("original")
        now = asked.add(fetch.outcomes(serving.select("*", original), memo.answers.all()))
        if limit is not None:
            over = stored(_over(origins.all(), asked.all(), memo.answers.all(), limit), "over")
            over = None if over.isEmpty() else over
        in_answer = memo.records.all()
        # Records that count, and the nameservers and addresses in them.
        own = now.where("answer is not null").select(*STATE, "answer", "ip").distinct()
        if used.schema:
            own = own.join(used.all().select(*STATE, "answer", "ip").distinct(), [*STATE, "answer", "ip"], "left_anti")
        got = used.add(own.join(in_answer, ["answer", "ip"]))
        found, addresses = _found(got, used.all(), new_origins, origins.all(), compat), records.addresses(got.withColumnRenamed("owner", "name_").select(F.col("name_").alias("name"), "type", "data"))
        nowhere = [F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("who", "string"), ("pass", "int"))]
        spoken = found.select(*STATE, "ns", F.lit(None).cast("string").alias("ip")).unionByName(addresses.select(*nowhere, F.col("host").alias("ns"), "ip")).distinct()
        old = told.all()
        same = (F.col("a.ns") == F.col("b.ns")) & F.col("a.ip").eqNullSafe(F.col("b.ip")) & F.col("a.name").eqNullSafe(F.col("b.name")) & F.col("a.who").eqNullSafe(F.col("b.who")) & F.col("a.pass").eqNullSafe(F.col("b.pass"))
        new = told.add(spoken.alias("a").join(old.alias("b"), same, "left_anti"))
        new_found, new_glue = new.where("ip is null").drop("ip"), new.where("ip is not null").select("ns", "ip")
        glue = told.all().where("ip is not null").select("ns", "ip")
        # Servers with addresses: by glue from any answer, or, where any server stays in charge, all that are asked.
        new_reused = now.where("reuse").select(*STATE).distinct()
        if reused.schema:
            new_reused = new_reused.join(reused.all(), STATE, "left_anti")
        new_reused = reused.add(new_reused)
        charged = [new_reused.join(asked.all().select(*STATE, "ns", "ip"), STATE), reused.all().join(now.select(*STATE, "ns", "ip"), STATE)]
        all_found = told.all().where("name is not null").select(*STATE, "ns")
        holding = _union([new_found.join(glue, "ns"), all_found.join(new_glue, "ns"), *charged]).select(*STATE, "ns", "ip").distinct()
        new_auth = auth.add(holding.join(auth.all(), [*STATE, "ns", "ip"], "left_anti") if auth.schema else holding)
        # Nameservers without an address, under another registrable name, are resolved themselves.
        bare = new_found.where("ns <> '.'").join(glue.select("ns").distinct(), "ns", "left_anti")
        bare = bare.select(*NAME, "ns").distinct().join(every.where("not top").select(*NAME, F.col("registrable").alias("from")), NAME)
        wanted = with_suffix(bare, "ns", suffixes).where(records.out_of_bailiwick(F.col("registrable"), F.col("from"))).select(*NAME, "from", "ns", "registrable")
        wanted = needs.add(wanted.join(needs.all(), [*NAME, "ns"], "left_anti") if needs.schema else wanted)
        wanted = wanted if over is None else needs.all().join(_live(origins.all(), over), NAME, "left_semi")
        starts = wanted.select(F.col("ns").alias("origin"), F.lit(True).alias("is_ns")).distinct().join(origins.all().where("is_ns"), "origin", "left_anti")
        starts = starts.withColumn("who", F.lit(""))
        if leaving is not None:
            starts = starts.unionByName(origins.all().where("who = ''").join(leaving, "origin", "left_semi").withColumn("who", F.col("origin")))
            late = starts.where("who = ''").join(shared.left.all(), "origin", "left_semi")  # known to leave, met again as a nameserver
        elif shared.left.schema:
            late = starts.join(shared.left.all(), "origin", "left_semi")
        else:
            late = None
        if late is not None:
            starts = starts.unionByName(late.withColumn("who", F.col("origin"))).distinct()
        new_origins = origins.add(starts)
        if new_origins.isEmpty() and new_auth.isEmpty():
            walks = stored(origins.all().groupBy("origin").agg(F.max("who").alias("who")), "walks")
            walked = stored(_chain(walks).select(*NAME).distinct(), "walked")
            of_walks = lambda rows: rows.join(walked, NAME, "left_semi")
            return Resolution(visited.all(), of_walks(asked.all()), auth.all(), told.all().where("name is not null").select(*STATE, "ns"), used.all(), of_walks(needs.all()), walks, Answers(memo.answers.all(), memo.records.all()), compat)
    raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")


def _over(origins: DataFrame, asked: DataFrame, answers: DataFrame, limit: float) -> DataFrame:
    """(origin, who) of walks whose own questions took over `limit` seconds."""
    slow = answers.where("elapsed > 0").select(*QUESTION, "elapsed")
    questions = asked.select(*NAME, F.col("name").alias("domain"), F.col("ip").alias("nameserver")).distinct()
    took = questions.join(slow, QUESTION).groupBy(*NAME).agg(F.sum("elapsed").alias("elapsed"))
    return fetch.over_limit(_chain(origins).join(took, NAME), ["origin", "who"], "elapsed", limit)


def _live(origins: DataFrame, over: DataFrame) -> DataFrame:
    """(name, who) on walks that are not in `over`."""
    return _chain(origins.join(over, ["origin", "who"], "left_anti").select("origin", "who")).select(*NAME).distinct()


def _found(got: DataFrame, used: DataFrame, new_origins: DataFrame, origins: DataFrame, compat: bool) -> DataFrame:
    """Nameservers by state: NS records of the answered name or above it, and names that are nameservers themselves and have an address."""
    named = records.nameservers(got.withColumnRenamed("name", "of").withColumnRenamed("owner", "name"), "answer", not compat).select(F.col("of").alias("name"), "who", "pass", "ns")
    own = lambda rows: rows.where(F.col("type").isin("A", "AAAA") & (F.lower("owner") == F.col("answer")) & (F.col("answer") == F.col("name")) & F.col("who").isin("", F.col("name")))
    as_ns = lambda who: who.where("is_ns").select(F.col("origin").alias("answer")).distinct()
    promoted = own(got).join(as_ns(origins), "answer", "left_semi").unionByName(own(used).join(as_ns(new_origins), "answer", "left_semi"))
    return named.union(promoted.select(*STATE, F.col("answer").alias("ns"))).distinct()


def problems(done: Resolution) -> DataFrame:
    """(name, who, kind, nameserver, codes, domain, suffix): names that no server answers for, one row per server asked.

    hazardous: nothing in the first pass; ip_ns_records: the same for a name that is a number; missing_ns_records: nothing
    in the second; cyclic: the name depends, without addresses, on itself.
    """
    empty = done.asked.join(done.auth.select(*STATE).distinct(), STATE, "left_anti").select(*STATE, "ip", *fetch.CODES).distinct().join(done.visited, NAME)
    loops = on_cycles(done.needs.select(F.col("from").alias("src"), F.col("registrable").alias("dst"))).select(F.col("src").alias("registrable"), F.lit(True).alias("loops"))
    marked = empty.join(loops, "registrable", "left").join(done.found.select(*STATE, F.lit(True).alias("named")).distinct(), STATE, "left")
    cyclic = F.coalesce(F.col("loops") & F.col("named"), F.lit(False))
    states = marked.withColumns({"servers": F.lit(0), "cyclic": cyclic, "numeric": names.numeric_label(names.labels(F.col("name")))})
    return report.classify(states).select(*NAME, "kind", F.col("ip").alias("nameserver"), *fetch.CODES, "domain", "suffix")


def facts(done: Resolution, suffixes: DataFrame | Rules, trouble: DataFrame) -> DataFrame:
    """(name, who, category, value) in long form. Nothing is recorded for top-level domains."""
    inner = done.visited.where("not top").select(*NAME)
    used = done.used.join(inner, NAME).withColumnRenamed("name", "of").withColumnRenamed("owner", "name")
    here = [F.col("of").alias("name"), "who"]
    ns = records.nameservers(used, "answer", not done.compat).select(*here, F.lit("ns").alias("category"), F.col("ns").alias("value"))
    ips = records.addresses(used).select(*here, F.col("kind").alias("category"), F.col("ip").alias("value"))
    found = done.found.join(inner, NAME)
    target = found.select(*NAME, "ns").union(found.select(*NAME, "name")).distinct()
    split = with_suffix(target, "ns", suffixes).select(*NAME, "domain", "suffix").union(trouble.where("kind <> 'cyclic'").select(*NAME, "domain", "suffix"))
    of = {"sld": sld(F.col("domain"), F.col("suffix")), "tld": tld(F.col("domain"), F.col("suffix"))}
    zones = [split.select(*NAME, F.lit(k).alias("category"), v.alias("value")) for k, v in of.items()]
    return _union([ns, ips, *zones]).where("value is not null").select(*NAME, "category", F.lower("value").alias("value")).distinct()


def reached(hosts: DataFrame, done: Resolution) -> DataFrame:
    """(query, name, who, mark): the names that each query depends on, directly or through nameservers.

    mark: what is known of the name counts as a public suffix's there, as it is a suffix of several labels or above one
    on the way to it, or all of the way is.
    """
    walks = _chain(done.origins).join(done.visited.select(*NAME, "domain"), NAME)
    deepest = F.max(F.when((F.col("domain") == "") & (F.col("depth") > 1), F.col("depth"))).over(Window.partitionBy("origin"))
    plain = walks.withColumn("low", F.coalesce(F.col("depth") <= deepest, F.lit(False))).select("origin", *NAME, "low")
    walks = stored(plain.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("ps")).select("origin", "ps", *NAME, (F.col("ps") | F.col("low")).alias("mark")), "walks")
    key = lambda origin, ps: F.concat(F.when(F.col(ps), "ps:").otherwise(""), F.col(origin))
    edges = walks.join(done.needs.select(*NAME, "ns"), NAME).select(key("origin", "ps").alias("src"), key("ns", "mark").alias("dst")).distinct()
    start = hosts.select("query", names.norm_host(F.col("query")).alias("src")).where("src is not null").distinct()
    far = start.join(reachable(edges, start), "src").select("query", "dst")
    reach = start.select("query", F.col("src").alias("dst")).union(far).distinct()
    return stored(reach.join(walks.withColumn("dst", key("origin", "ps")), "dst").select("query", *NAME, "mark").distinct(), "reached")


def spent(reach: DataFrame, done: Resolution) -> DataFrame:
    """(query, seconds): the time of all questions that a query depends on, each once however many of its names ask it.

    A question is charged to all that need it, whoever made it be asked. Those that a walk asked by its own name below a
    silent server are charged with that name. Queries whose questions took no time are left out.
    """
    slow = done.answers.questions.where("elapsed > 0").select(*QUESTION, "elapsed")
    plain = done.asked.select(*NAME, F.col("name").alias("domain"), F.col("ip").alias("nameserver"))
    silent = done.asked.where("answer is null or answer <> name").select(*NAME, "ip").distinct()
    below = _chain(done.origins).where("name <> origin").join(silent, NAME)
    own = below.select(F.col("origin").alias("name"), "who", F.col("origin").alias("domain"), F.col("ip").alias("nameserver"))
    questions = plain.union(own).distinct().join(slow, QUESTION)
    each = reach.select("query", *NAME).distinct().join(questions, NAME).groupBy("query", *QUESTION).agg(F.max("elapsed").alias("elapsed"))
    return each.groupBy("query").agg(F.sum("elapsed").alias("seconds"))


def within(hosts: DataFrame, reach: DataFrame, done: Resolution, limit: float) -> DataFrame:
    """The `hosts` (query) whose questions took `limit` seconds at most in all; the rest have failed."""
    return hosts.join(fetch.over_limit(spent(reach, done), "query", "seconds", limit), "query", "left_anti")


def attributed(reach: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` of names (name, who, ...) for each query that depends on them: (query, ..., mark); the name stays."""
    return reach.join(rows, NAME).drop("who").distinct()


def host_facts(reach: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, category, value): categories reached through a public suffix begin with `ps_`."""
    return attributed(reach, rows).select("query", names.ps_prefix(F.col("mark"), F.col("category")).alias("category"), "value").distinct()


def reports(hosts: DataFrame, responses: DataFrame | Port, suffixes: DataFrame | Rules, roots: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(facts, problems) of every query: (query, category, value) and (query, kind, name, nameserver, codes)."""
    suffixes = prepared(suffixes)
    return told(hosts, resolve(hosts, responses, suffixes, roots, compat), suffixes)


def told(hosts: DataFrame, done: Resolution, suffixes: DataFrame | Rules, reach: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What `reports` gives, of a finished resolution of `hosts`; `reach`: what `reached` gives of them, if it is there already."""
    bad, reach = stored(problems(done), "problems"), reached(hosts, done) if reach is None else reach
    trouble = attributed(reach, bad).select("query", "kind", "name", "nameserver", *fetch.CODES).distinct()
    return host_facts(reach, facts(done, suffixes, bad)), trouble
