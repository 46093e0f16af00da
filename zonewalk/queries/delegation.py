"""Queries over the derived world, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewalk.functions import names, suffix
from zonewalk.operators import analysis, fetch, joins, records, report
from zonewalk.plans import batch, resolve
from zonewalk.plans.closure import reachable
from zonewalk.plans.components import on_cycles, strong_parts
from zonewalk.plans.storage import Growing, shared_dir, stored
from zonewalk.queries import world
from zonewalk.queries.world import SQL
from zonewalk.sources import readers, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def parts() -> Column:
    return names.labels(F.col("host"))


def query(sql: str, plain: bool = False):
    """Registers a function under its name, with its SQL over the world's tables (or over the driver's alone)."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql if plain else f"{SQL} {sql}"
        return f

    return register


def joined(array) -> Column:
    return F.array_join(F.array_sort(array), ",")


# Host names


@query("SELECT page_id, host AS query FROM hosts")
def host_list(spark, d):
    return world.pages(spark, d).withColumnRenamed("host", "query")


@query("SELECT page_id, host FROM hosts")
def norm_host(spark, d):
    raw = world.pages(spark, d).select("page_id", F.upper(F.regexp_replace("host", "[.]$", "")).alias("raw"))
    return raw.select("page_id", names.norm_host(F.col("raw")).alias("host"))


@query("SELECT page_id, array_to_string(p, '|') AS labels, CAST(len(p) AS INTEGER) AS n FROM parts")
def label_split(spark, d):
    return world.pages(spark, d).select("page_id", F.array_join(parts(), "|").alias("labels"), F.size(parts()).alias("n"))


@query("SELECT page_id, array_to_string(list_reverse(p), '|') AS labels FROM parts")
def label_reverse(spark, d):
    return world.pages(spark, d).select("page_id", F.array_join(names.labels_reversed(F.col("host")), "|").alias("labels"))


def _chain(spark, d):
    return world.pages(spark, d).select("page_id", "host", F.posexplode(names.superdomains(parts())).alias("depth", "name")).withColumn("depth", F.col("depth").cast("long") + 1)


@query("SELECT page_id, depth, name FROM chain")
def superdomain_chain(spark, d):
    return _chain(spark, d).drop("host")


@query("SELECT page_id, name, depth = 1 AS is_tld FROM chain")
def is_tld(spark, d):
    return _chain(spark, d).select("page_id", "name", names.is_tld(names.labels(F.col("name"))).alias("is_tld"))


@query("SELECT page_id, name, depth <= 2 AND (name IN (SELECT suffix FROM psl) OR depth = 1) AS is_suffix FROM chain")
def is_suffix(spark, d):
    split = suffix.with_suffix(_chain(spark, d), "name", world.suffixes(spark))
    return split.select("page_id", "name", (F.col("domain") == "").alias("is_suffix"))


def _split(spark, d):
    return suffix.with_suffix(world.hosts(spark, d), "host", world.suffixes(spark))


@query("SELECT page_id, subdomain, domain, suffix FROM psl_split")
def psl_extract(spark, d):
    return _split(spark, d).select("page_id", "subdomain", "domain", "suffix")


@query("SELECT page_id, CASE WHEN domain <> '' THEN domain || '.' || suffix ELSE suffix END AS registrable FROM psl_split")
def registrable(spark, d):
    return _split(spark, d).select("page_id", "registrable")


@query("SELECT page_id, host, CASE WHEN domain <> '' THEN domain || '.' || suffix ELSE suffix END AS sld, suffix AS tld FROM psl_split")
def sld_tld(spark, d):
    return _split(spark, d).select("page_id", "host", suffix.sld(F.col("domain"), F.col("suffix")).alias("sld"), suffix.tld(F.col("domain"), F.col("suffix")).alias("tld"))


@query("SELECT page_id, name, CASE WHEN depth = 1 OR name IN (SELECT suffix FROM psl) THEN 'ps_ns' ELSE 'ns' END AS category FROM chain")
def ps_prefix(spark, d):
    split = suffix.with_suffix(_chain(spark, d), "name", world.suffixes(spark))
    return split.select("page_id", "name", names.ps_prefix(F.col("domain") == "", F.lit("ns")).alias("category"))


@query(
    r"SELECT doc_id, token, true AS numeric_label FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+){3}')) AS token FROM documents) UNION ALL "
    r"SELECT page_id, host, regexp_matches(p[-1], '^[0-9]+$') FROM parts"
)
def numeric_label(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+(?:[.][0-9]+){3}"), 0)).alias("token"))
    both = docs.union(world.pages(spark, d))
    return both.select("doc_id", "token", names.numeric_label(names.labels(F.col("token"))).alias("numeric_label"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{i}')" for n, i in readers.ROOT_SERVERS) + ") AS t(ns, ip)", plain=True)
def root_hints(spark, d):
    return readers.root_hints(spark)


@query("SELECT DISTINCT host, 'a.root-servers.net.' AS ns FROM hosts")
def root_pick(spark, d):
    first = readers.root_hints(spark).agg(F.min("ns")).first()[0]
    return world.pages(spark, d).select("host").distinct().withColumn("ns", F.lit(first))


# Analyses


@query("SELECT page_id, zone FROM hosts WHERE zone <> '' AND zone NOT LIKE '%.org.' AND zone NOT IN (SELECT zone FROM zones WHERE zid % 7 = 0)")
def exempt_filter(spark, d):
    exempt = world.zones(spark, d).where("zid % 7 = 0").select(F.col("zone").alias("name"))
    return analysis.without_exempt(world.hosts(spark, d).where("zone <> ''").select("page_id", "zone"), "zone", exempt, ("org",))


@query("SELECT zone AS domain FROM zones WHERE klass = 2 AND zid % 4 <> 0")
def whois_available(spark, d):
    z = world.zones(spark, d)
    return analysis.available(z.where("klass = 2").select(F.col("zone").alias("domain")), z.where("zid % 4 = 0").select(F.col("zone").alias("domain")))


@query("SELECT zone AS domain, CASE WHEN zid % 7 = 0 THEN 'timeout' ELSE 'answered' END AS status, CASE WHEN zid % 7 <> 0 THEN klass <> 2 END AS registered FROM zones")
def registration_status(spark, d):
    """What recorded look-ups say of every zone: zones of class 2 are free, and a server that did not answer says neither."""
    z = world.zones(spark, d)
    text = F.when(F.col("klass") == 2, F.concat(F.lit("No match for "), "zone")).otherwise(F.concat(F.lit("Domain Name: "), F.upper("zone")))
    status = F.when(F.col("zid") % 7 == 0, "timeout").otherwise("answered")
    said = z.select(F.col("zone").alias("domain"), status.alias("status"), F.when(F.col("zid") % 7 != 0, text).alias("text"))
    return analysis.registration(said).select("domain", "status", "registered")


@query("SELECT zone, zone LIKE '%.example.org.' AS under FROM zones WHERE klass = 4")
def gov_sld_filter(spark, d):
    z = world.zones(spark, d).withColumn("named", F.when(F.col("klass") == 4, F.concat("octet", F.lit(".9."))).otherwise(F.col("zone")))
    return z.where(analysis.numeric_second_label(F.col("named"))).select("zone", analysis.not_empty(analysis.under_suffix(F.array("zone"), "example.org")).alias("under"))


@query("SELECT page_id, host FROM hosts WHERE page_id = 37")
def row_pick(spark, d):
    return analysis.row_at(world.pages(spark, d), "page_id", 37)


# Resource records

RR = r"""
, rr AS (
  SELECT page_id, host, zone, host || ' 300 IN A 10.1.' || CAST(CAST(floor(page_id / 256) AS BIGINT) % 256 AS VARCHAR) || '.' || CAST(page_id % 256 AS VARCHAR) || ' more' || chr(10) || '; note' || chr(10) || chr(10)
    || upper(zone) || '  60' || chr(9) || 'IN NS ns' || CAST(page_id % 3 AS VARCHAR) || '.' || zone || chr(10) || 'ns' || CAST(page_id % 3 AS VARCHAR) || '.' || zone || ' 60 IN AAAA 2001:DB8::' || CAST(page_id % 100 AS VARCHAR)
    || chr(10) || 'e.com. 60 IN NS ns.other.net.' || chr(10) || host || ' 5 IN TXT x' AS rr_text FROM hosts
), tok AS (
  SELECT page_id, host, zone, f[1] AS name, f[2] AS ttl, f[3] AS class, f[4] AS type, f[5] AS data FROM (
    SELECT page_id, host, zone, regexp_split_to_array(trim(line), '\s+') AS f FROM (SELECT page_id, host, zone, unnest(string_split(rr_text, chr(10))) AS line FROM rr) WHERE trim(line) <> '' AND line NOT LIKE ';%')
)
"""


def _rr(spark, d):
    n, third = F.col("page_id"), (F.col("page_id") % 3).cast("string")
    quarter = lambda x: (x % 256).cast("string")
    text = F.concat(
        "host", F.lit(" 300 IN A 10.1."), quarter(F.floor(n / 256)), F.lit("."), quarter(n), F.lit(" more\n; note\n\n"), F.upper("zone"), F.lit("  60\tIN NS ns"), third, F.lit("."), "zone",
        F.lit("\nns"), third, F.lit("."), "zone", F.lit(" 60 IN AAAA 2001:DB8::"), (n % 100).cast("string"), F.lit("\ne.com. 60 IN NS ns.other.net.\n"), "host", F.lit(" 5 IN TXT x"),
    )
    return world.hosts(spark, d).withColumn("rr_text", text)


def _tok(spark, d):
    return records.tokenise(_rr(spark, d))


@query(f"{RR} SELECT page_id, name, ttl, class, type, data FROM tok")
def rr_tokenise(spark, d):
    return _tok(spark, d).select("page_id", *records.RECORD)


@query(f"{RR} SELECT page_id, name || chr(9) || type || chr(9) || data AS line FROM tok")
def rr_tsv(spark, d):
    return records.tab_separated(_tok(spark, d)).select("page_id", "line")


@query(f"{RR} SELECT page_id, type, data FROM tok WHERE type IN ('NS', 'A', 'AAAA')")
def rr_type_filter(spark, d):
    return records.of_types(_tok(spark, d), ("NS", "A", "AAAA")).select("page_id", "type", "data")


@query(f"{RR} SELECT page_id, host, lower(data) AS ns, host = lower(name) OR host LIKE '%.' || lower(name) AS strict FROM tok WHERE type = 'NS' AND contains(host, lower(name))")
def ns_owner_match(spark, d):
    loose = records.nameservers(_tok(spark, d), "host", strict=False)
    return loose.select("page_id", "host", "ns", names.within(F.col("host"), F.col("name")).alias("strict"))


@query(f"{RR} SELECT page_id, lower(name) AS host, lower(data) AS ip, CASE type WHEN 'A' THEN 'ipv4' ELSE 'ipv6' END AS kind FROM tok WHERE type IN ('A', 'AAAA')")
def addr_route(spark, d):
    return records.addresses(_tok(spark, d)).select("page_id", "host", "ip", "kind")


@query(f"{RR} SELECT page_id, host, lower(data) AS ip FROM tok WHERE type IN ('A', 'AAAA') AND lower(name) = host")
def self_addr(spark, d):
    rows = _tok(spark, d).withColumnRenamed("host", "current")
    return records.own_addresses(rows, "current").select("page_id", "host", "ip")


@query(f"{RR} SELECT page_id, host AS ns FROM tok WHERE type IN ('A', 'AAAA') AND lower(name) = host AND page_id % 2 = 0")
def is_ns_promote(spark, d):
    rows = _tok(spark, d).withColumnRenamed("host", "current").withColumn("is_ns", F.col("page_id") % 2 == 0)
    return records.promoted(rows, "current", "is_ns").select("page_id", "ns")


@query("SELECT zone, ns, reg <> zone AS outside FROM (SELECT zone, CASE klass WHEN 1 THEN 'ns1.hub.example.net.' WHEN 5 THEN 'ns1.' || next ELSE 'ns1.' || zone END AS ns, CASE klass WHEN 1 THEN 'hub.example.net.' WHEN 5 THEN next ELSE zone END AS reg FROM zones WHERE klass IN (0, 1, 3, 5))")
def out_of_bailiwick(spark, d):
    rows = records.tokenise(world.responses(spark, d).where(F.col("nameserver") == world.REGISTRY_IP)).where("type = 'NS' and data like 'ns1.%'")
    z = world.zones(spark, d).select(F.col("zone").alias("domain"))
    ns = records.nameservers(rows.join(z, "domain", "left_semi").distinct(), "domain").select("domain", "ns").distinct().withColumnRenamed("domain", "zone")
    rules = suffix.prepared(world.suffixes(spark))
    own = suffix.with_suffix(ns, "zone", rules).select("zone", "ns", F.col("registrable").alias("own"))
    both = suffix.with_suffix(own, "ns", rules)
    return both.select("zone", "ns", records.out_of_bailiwick(F.col("registrable"), F.col("own")).alias("outside"))


@query(f"{RR} SELECT zone, data, arg_max(name, page_id) AS name, max(page_id) AS page_id FROM tok WHERE type IN ('NS', 'AAAA') GROUP BY zone, data")
def last_wins(spark, d):
    rows = _tok(spark, d).where("type in ('NS', 'AAAA')")
    return records.last_wins(rows, ["zone"], "page_id").select("zone", "data", "name", "page_id")


@query(
    f"{RR} SELECT zone, coalesce(string_agg(DISTINCT lower(data), ',' ORDER BY lower(data)) FILTER (type = 'NS'), '') AS ns, coalesce(string_agg(DISTINCT lower(data), ',' ORDER BY lower(data)) FILTER (type = 'A'), '') AS ipv4, "
    "coalesce(string_agg(DISTINCT lower(data), ',' ORDER BY lower(data)) FILTER (type = 'AAAA'), '') AS ipv6 FROM tok GROUP BY zone"
)
def filter_by_type(spark, d):
    return records.sets_by_type(_tok(spark, d), ["zone"]).select("zone", *[F.array_join(c, ",").alias(c) for c in ("ns", "ipv4", "ipv6")])


# Questions, answers and joins

PARENT = f"nameserver = '{world.REGISTRY_IP}'"


def _questions(spark, d):
    return world.hosts(spark, d).where("zone <> ''").select(F.col("zone").alias("domain"), F.lit(world.REGISTRY_IP).alias("nameserver"))


@query(f"SELECT domain, nameserver, rcode, seq, rr_text FROM responses WHERE {PARENT} AND domain IN (SELECT zone FROM zones)")
def rr_fetch_join(spark, d):
    asked = fetch.distinct_questions(_questions(spark, d))
    return fetch.recorded(asked, world.responses(spark, d)).select("domain", "nameserver", "rcode", "seq", "rr_text")


@query(f"SELECT domain, nameserver, seq, rr_text FROM responses WHERE {PARENT} AND domain IN (SELECT zone FROM zones) AND rr_text LIKE '% IN NS %'")
def recorded_source(spark, d):
    """The registry's NS records for the zones, read through the data source, which opens that server's bucket alone."""
    where = f"{shared_dir(spark)}/recorded-{uuid.uuid4().hex}"
    table.write_responses(world.responses(spark, d), where)
    said = table.dns_responses(spark, where, nameservers=[world.REGISTRY_IP], types=["NS"])
    return said.join(fetch.distinct_questions(_questions(spark, d)), ["domain", "nameserver"], "left_semi").select("domain", "nameserver", "seq", "rr_text")


@query(f"SELECT zone AS domain, '{world.REGISTRY_IP}' AS nameserver FROM zones")
def query_dedupe(spark, d):
    return fetch.distinct_questions(_questions(spark, d))


GLUE = ", glue AS (SELECT DISTINCT lower(name) AS ns, lower(data) AS ip FROM records WHERE type IN ('A', 'AAAA')), named AS (SELECT DISTINCT domain AS zone, lower(data) AS ns FROM records WHERE type = 'NS' AND domain IN (SELECT zone FROM zones))"


def _records(spark, d):
    return records.tokenise(world.responses(spark, d))


def _named(spark, d):
    z = world.zones(spark, d).select(F.col("zone").alias("domain"))
    rows = records.nameservers(_records(spark, d).join(z, "domain", "left_semi"), "domain")
    return rows.select(F.col("domain").alias("zone"), "ns").distinct()


def _glue(spark, d):
    return records.addresses(_records(spark, d)).select(F.col("host").alias("ns"), "ip").distinct()


@query(f"{GLUE} SELECT zone, ns, ip FROM named LEFT JOIN glue USING (ns)")
def glue_join(spark, d):
    return joins.with_glue(_named(spark, d), _glue(spark, d)).select("zone", "ns", "ip")


@query(f"{GLUE} SELECT ns AS host, string_agg(ip, ',' ORDER BY ip) AS ips FROM glue GROUP BY ns")
def glue_sets(spark, d):
    return records.glue_sets(_records(spark, d)).select("host", F.array_join("ips", ",").alias("ips"))


@query(f"{GLUE} SELECT DISTINCT host AS name, zone AS parent, ip FROM hosts JOIN named USING (zone) JOIN glue USING (ns)")
def server_fanout(spark, d):
    servers = joins.with_glue(_named(spark, d), _glue(spark, d)).where("ip is not null").select("zone", "ns", "ip")
    asked = world.hosts(spark, d).where("zone <> ''").select(F.col("host").alias("name"), F.col("zone").alias("parent")).distinct()
    return fetch.fan_out(asked, servers).select("name", "parent", "ip")


@query(f"{GLUE} SELECT zone, string_agg(DISTINCT ip, ',' ORDER BY ip) AS ip FROM (SELECT zone, ip FROM named JOIN glue USING (ns) UNION ALL SELECT zone, octet || '.1' FROM zones) GROUP BY zone")
def auth_merge(spark, d):
    first = joins.addresses_of(_named(spark, d), _glue(spark, d)).select("zone", "ip")
    second = world.zones(spark, d).select("zone", F.concat("octet", F.lit(".1")).alias("ip"))
    return joins.merged([first, second], ["zone"], "ip").withColumn("ip", F.array_join("ip", ","))


@query("SELECT DISTINCT host, zone FROM hosts WHERE zone <> '' AND zone NOT IN (SELECT zone FROM zones WHERE klass IN (0, 1))")
def resolved_antijoin(spark, d):
    return joins.unresolved(world.hosts(spark, d).where("zone <> ''").select("host", "zone").distinct(), world.zones(spark, d).where("klass in (0, 1)"), "zone").select("host", "zone")


@query("SELECT DISTINCT host AS query FROM hosts WHERE host NOT IN (SELECT host FROM hosts WHERE page_id % 5 = 0)")
def completed_antijoin(spark, d):
    p = world.pages(spark, d).withColumnRenamed("host", "query")
    return batch.pending(p.select("query"), p.where("page_id % 5 = 0"))


@query("SELECT DISTINCT domain, name, data FROM records WHERE type = 'NS' AND name = domain")
def old_ns_filter(spark, d):
    return records.of_types(_records(spark, d), ("NS",)).where("name = domain").select("domain", "name", "data").distinct()


@query(f"{GLUE} SELECT DISTINCT zone, ns, ip FROM named JOIN glue USING (ns)")
def old_ns_ip_join(spark, d):
    return joins.addresses_of(_named(spark, d), _glue(spark, d)).select("zone", "ns", "ip")


# Steps of the resolution

ASK = f"""{GLUE}, ask0 AS (SELECT zone AS name, '{world.REGISTRY_IP}' AS ip, 0 AS pass FROM zones), ask1 AS (SELECT DISTINCT a.name, g.ip, 1 AS pass FROM ask0 a JOIN records r ON r.domain = a.name AND r.nameserver = a.ip AND r.type = 'NS' JOIN glue g ON g.ns = lower(r.data)),
steps AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(nx, false) AS nx FROM (SELECT * FROM ask0 UNION ALL SELECT * FROM ask1) s LEFT JOIN answers a ON a.domain = s.name AND a.nameserver = s.ip)"""


def _two(spark, d):
    """(name, ip, pass, answer, reuse) of both passes for every zone."""
    answers, glue, rows = fetch.summaries(world.responses(spark, d)), _glue(spark, d), _records(spark, d)
    first = world.zones(spark, d).select(F.col("zone").alias("name"), F.col("zone").alias("original"), F.lit(world.REGISTRY_IP).alias("ip"), F.lit(0).alias("pass"))
    at = rows.select(F.col("domain").alias("current"), F.col("nameserver").alias("ip"), *records.RECORD)
    given = records.nameservers(first.select(F.col("name").alias("current"), "ip").join(at, ["current", "ip"]), "current").select("current", "ns")
    second = given.join(glue, "ns").select(F.col("current").alias("name"), F.col("current").alias("original"), "ip", F.lit(1).alias("pass")).distinct()
    return fetch.outcomes(first.unionByName(second), answers)


@query(f"{ASK} SELECT name, ip, pass, n > 0 AS answered, nx FROM steps")
def two_pass(spark, d):
    done = _two(spark, d)
    return done.select("name", "ip", "pass", F.col("answer").isNotNull().alias("answered"), fetch.is_nxdomain(F.col("rcode"), F.col("timeout")).alias("nx"))


@query(f"{ASK} SELECT host AS name, ip, CASE WHEN n > 0 THEN host WHEN nx THEN NULL WHEN zn > 0 THEN zone END AS answer, NOT nx AND n = 0 AND zn = 0 AND NOT znx AS reuse FROM (SELECT DISTINCT h.host, h.zone, s.ip, coalesce(a.n, 0) AS n, coalesce(a.nx, false) AS nx, s.n AS zn, s.nx AS znx FROM hosts h JOIN steps s ON s.name = h.zone AND s.pass = 1 AND h.host <> h.zone LEFT JOIN answers a ON a.domain = h.host AND a.nameserver = s.ip)")
def qname_fallback(spark, d):
    """Hosts below a zone are asked at its servers; the empty answer is asked again, here by the zone's name."""
    servers = _two(spark, d).where("pass = 1").select(F.col("name").alias("zone"), "ip")
    asked = world.hosts(spark, d).where("zone <> '' and host <> zone").select(F.col("host").alias("name"), "zone", F.col("zone").alias("original")).distinct().join(servers, "zone")
    return fetch.outcomes(asked, fetch.summaries(world.responses(spark, d))).select("name", "ip", "answer", "reuse")


@query(f"{ASK} SELECT DISTINCT h.host AS name, s.ip FROM hosts h JOIN steps s ON s.name = h.zone AND s.pass = 1 AND h.host <> h.zone LEFT JOIN answers a ON a.domain = h.host AND a.nameserver = s.ip WHERE coalesce(a.n, 0) = 0 AND NOT coalesce(a.nx, false)")
def zone_cut_reuse(spark, d):
    servers = _two(spark, d).where("pass = 1").select(F.col("name").alias("zone"), "ip")
    asked = world.hosts(spark, d).where("zone <> '' and host <> zone").select(F.col("host").alias("name"), "zone", F.col("host").alias("original")).distinct().join(servers, "zone")
    return fetch.outcomes(asked, fetch.summaries(world.responses(spark, d))).where("reuse").select("name", "ip")


@query("SELECT DISTINCT domain, nameserver, coalesce(rcode = 3, false) AS nx FROM responses")
def nxdomain_pred(spark, d):
    return world.responses(spark, d).select("domain", "nameserver", fetch.is_nxdomain(F.col("rcode"), F.col("timeout")).alias("nx")).distinct()


EDGES = f", edges AS (SELECT zone AS src, CASE klass WHEN 1 THEN '{world.HUB}' ELSE next END AS dst FROM zones WHERE klass = 1 OR (klass = 5 AND next <> zone)), paths AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM paths p JOIN edges e ON p.dst = e.src)"


def _edges(spark, d):
    z = world.zones(spark, d)
    return z.where("klass = 1").select(F.col("zone").alias("src"), F.lit(world.HUB).alias("dst")).union(z.where("klass = 5 and next <> zone").select("zone", "next"))


@query(f"{EDGES} SELECT src, dst FROM paths")
def ns_closure(spark, d):
    return reachable(_edges(spark, d))


@query(f"{EDGES} SELECT src AS zone FROM paths WHERE src = dst")
def cycle_semi(spark, d):
    active = on_cycles(_edges(spark, d)).withColumnRenamed("src", "zone")
    return joins.in_progress(world.zones(spark, d).select("zone"), active, "zone")


@query(f"""{EDGES} SELECT n.name, least(n.name, coalesce(min(p.dst), n.name)) AS part FROM (SELECT src AS name FROM edges UNION SELECT dst FROM edges) n
LEFT JOIN (SELECT p.src, p.dst FROM paths p JOIN paths q ON q.src = p.dst AND q.dst = p.src) p ON p.src = n.name GROUP BY n.name""")
def strong_components(spark, d):
    """Names that depend on each other, by the first of them; every other name is a part of its own."""
    return strong_parts(_edges(spark, d))


# Classes and reports

KIND = "CASE klass WHEN 2 THEN 'hazardous' WHEN 3 THEN 'missing_ns_records' WHEN 4 THEN 'hazardous' WHEN 5 THEN CASE WHEN next = zone THEN 'hazardous' ELSE 'cyclic' END END"


@query(f"SELECT zone, {KIND} AS kind FROM zones")
def hazard_class(spark, d):
    z = world.zones(spark, d)
    asked = _two(spark, d)
    rows = _records(spark, d).select(F.col("domain").alias("name"), F.col("nameserver").alias("ip"), F.lower("data").alias("ns"), "type").where("type = 'NS'")
    held = asked.where("answer is not null").join(rows, ["name", "ip"]).join(_glue(spark, d).select("ns").distinct(), "ns", "left_semi").groupBy("name", "pass").agg(F.countDistinct("ns").alias("servers"))
    states = asked.select("name", "pass").distinct().join(held, ["name", "pass"], "left").withColumns({"servers": F.coalesce("servers", F.lit(0)), "numeric": names.numeric_label(names.labels(F.col("name")))})
    cyclic = on_cycles(_edges(spark, d)).select(F.col("src").alias("name"), F.lit(True).alias("cyclic"))
    kinds = report.classify(states.join(cyclic, "name", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False))))
    return z.select("zone").join(kinds.groupBy(F.col("name").alias("zone")).agg(F.min("kind").alias("kind")), "zone", "left")


@query("SELECT domain AS zone FROM responses GROUP BY domain HAVING count(rr_text) FILTER (rr_text LIKE '% NS %') = 0")
def old_hazard(spark, d):
    ns = records.of_types(_records(spark, d), ("NS",)).select("domain").distinct()
    return joins.unresolved(world.responses(spark, d).select("domain").distinct(), ns, "domain").withColumnRenamed("domain", "zone")


def _problems(spark, d):
    """(query, kind, name, nameserver, rcode, timeout) of every page's zone by the class rules."""
    z = world.zones(spark, d)
    kind = F.when(F.col("klass") == 2, "hazardous").when(F.col("klass") == 3, "missing_ns_records").when(F.col("klass") == 4, "ip_ns_records")
    server = F.when(F.col("klass") == 3, F.concat("octet", F.lit(".1"))).otherwise(F.when(F.col("klass") == 4, world.ROOT_IP).otherwise(world.REGISTRY_IP))
    named = F.when(F.col("klass") == 4, "9.").otherwise(F.col("zone"))
    rows = z.select("zone", kind.alias("kind"), named.alias("name"), server.alias("nameserver"), *[F.lit(3).alias(c) for c in fetch.CODES[:3]], F.lit(False).alias("timeout")).where("kind is not null")
    return world.hosts(spark, d).select(F.col("host").alias("query"), "zone").distinct().join(rows, "zone").drop("zone")


def _failed(klass: str, name: str, server: str) -> str:
    return f"SELECT host AS query, {name} AS name, {server} || ':3' AS queries FROM (SELECT DISTINCT host, zone FROM hosts) JOIN zones USING (zone) WHERE klass = {klass}"


def _summary() -> Column:
    return F.array_join(F.transform("queries", lambda q: F.concat(q.nameserver, F.lit(":"), q.getField("rcodes").getField("2").cast("string"))), ",").alias("queries")


@query(_failed("2", "zone", f"'{world.REGISTRY_IP}'"))
def hazard_summary(spark, d):
    maps = report.hazards(_problems(spark, d))
    return maps.select("query", F.explode("hazardous_domains").alias("name", "queries")).select("query", "name", _summary())


@query(f"SELECT 'missing_ns_records' AS kind, * FROM ({_failed('3', 'zone', 'octet || chr(46) || chr(49)')}) UNION ALL SELECT 'ip_ns_records', * FROM ({_failed('4', repr('9.'), repr(world.ROOT_IP))})")
def misconfig_summary(spark, d):
    maps = report.misconfigurations(_problems(spark, d)).select("query", F.explode("misconfigured_domains").alias("kind", "of_name"))
    return maps.select("query", "kind", F.explode("of_name").alias("name", "queries")).select("query", "kind", "name", _summary())


@query("SELECT DISTINCT host AS query, 1 AS n FROM hosts JOIN zones USING (zone) WHERE klass = 2")
def nonempty_hazard(spark, d):
    maps = report.hazards(_problems(spark, d))
    return maps.where(analysis.not_empty(F.col("hazardous_domains"))).select("query", F.size("hazardous_domains").alias("n"))


BY_CLASS = f"""{EDGES}, own AS (
  SELECT zone, regexp_extract(zone, '([^.]+[.][^.]+[.])$', 1) AS sfx, regexp_extract(zone, '([^.]+[.])$', 1) AS top, klass, octet, next FROM zones
), reach AS (SELECT zone AS src, zone AS dst FROM zones UNION SELECT src, dst FROM paths
), facts0 AS (
  SELECT zone, 'sld' AS category, zone AS value FROM own UNION ALL SELECT zone, 'tld', sfx FROM own
  UNION ALL SELECT zone, 'ns', 'ns1.' || zone FROM own WHERE klass IN (0, 3) UNION ALL SELECT zone, 'ns', 'ns2.' || zone FROM own WHERE klass = 0
  UNION ALL SELECT zone, 'ipv4', octet || '.1' FROM own WHERE klass IN (0, 3) UNION ALL SELECT zone, 'ipv4', octet || '.2' FROM own WHERE klass = 0
  UNION ALL SELECT zone, 'ns', '{world.HUB_NS}' FROM own WHERE klass = 1 UNION ALL SELECT zone, 'ns', octet || '.9.' FROM own WHERE klass = 4 UNION ALL SELECT zone, 'ns', 'ns1.' || next FROM own WHERE klass = 5
  UNION ALL SELECT zone, 'sld', string_split(octet, '.')[3] || '.9.' FROM own WHERE klass = 4 UNION ALL SELECT zone, 'tld', '9.' FROM own WHERE klass = 4
  UNION ALL SELECT zone, 'ps_ns', 'a.nic.' || top FROM own UNION ALL SELECT zone, 'ps_ipv4', '{world.REGISTRY_IP}' FROM own
  UNION ALL SELECT zone, 'ps_sld', 'nic.' || top FROM own UNION ALL SELECT zone, 'ps_sld', sfx FROM own UNION ALL SELECT zone, 'ps_tld', top FROM own
  UNION ALL SELECT '{world.HUB}', * FROM (VALUES ('ns', '{world.HUB_NS}'), ('ipv4', '{world.HUB_IP}'), ('sld', '{world.HUB}'), ('tld', 'example.net.'), ('ps_ns', 'a.nic.net.'), ('ps_ipv4', '{world.REGISTRY_IP}'), ('ps_sld', 'nic.net.'), ('ps_sld', 'example.net.'), ('ps_tld', 'net.'))
), bad AS (
  SELECT DISTINCT h.host AS query, CASE klass WHEN 3 THEN 'missing_ns_records' ELSE 'hazardous' END AS kind, zone AS name,
         CASE klass WHEN 3 THEN octet || '.1' ELSE '{world.REGISTRY_IP}' END AS nameserver, CASE WHEN klass IN (2, 3) THEN 3 ELSE 0 END AS rcode
  FROM hosts h JOIN zones USING (zone) WHERE klass IN (2, 3, 4) OR (klass = 5 AND next = zone)
  UNION ALL SELECT DISTINCT h.host, 'ip_ns_records', '9.', '{world.ROOT_IP}', 3 FROM hosts h JOIN zones USING (zone) WHERE klass = 4
), told AS (
  SELECT DISTINCT h.host AS query, f.category, f.value FROM (SELECT DISTINCT host, zone FROM hosts) h JOIN reach r ON r.src = h.zone JOIN facts0 f ON f.zone = r.dst
"""

REPORT = f"""{BY_CLASS})
SELECT query, category, string_agg(DISTINCT value, ',' ORDER BY value) AS found FROM (
  SELECT * FROM told UNION ALL SELECT query, kind, name FROM bad
  UNION ALL SELECT DISTINCT h.host, 'cyclic', r.dst FROM hosts h JOIN reach r ON r.src = h.zone JOIN zones z ON z.zone = r.dst WHERE z.klass = 5 AND z.next <> z.zone
) GROUP BY query, category
"""


def _queries(spark, d):
    """The hosts to resolve (query), and what the world is derived from; neither reads the pages again."""
    known = world.seen(spark, d)
    return known.where("zone <> ''").select(F.col("host").alias("query")), known


def _reports(spark, d):
    """(hosts, facts, problems) of every host, resolved against the world's answers."""
    hosts, known = _queries(spark, d)
    return hosts, *resolve.reports(hosts, world.responses(spark, d, known=known), world.suffixes(spark), readers.root_hints(spark))


@query(REPORT)
def full_report(spark, d):
    """Every host resolved; sets and problems of its report in long form."""
    _, facts, trouble = _reports(spark, d)
    return _found_by_host(facts, trouble)


def _found_by_host(facts, trouble):
    rows = facts.union(trouble.select("query", F.col("kind").alias("category"), F.col("name").alias("value")))
    return rows.groupBy("query", "category").agg(joined(F.collect_set("value")).alias("found"))


@query(REPORT.replace("AS found FROM", "AS found, 0 AS asked_again, 0 AS in_vain FROM"))
def demand_fetch(spark, d):
    """The report of every host, from answers that are asked for as the resolution comes to need them.

    asked_again: questions that were asked more than once; in_vain: those whose server no state was asked at, by its own name or by
    that of the walk.
    """
    hosts, known = _queries(spark, d)
    answers, log = fetch.table_port(world.responses(spark, d, known=known)), Growing(spark, "asked-of-port")
    rules, roots = suffix.prepared(world.suffixes(spark)), readers.root_hints(spark)
    done = resolve.resolve(hosts, lambda questions: answers(log.add(questions)), rules, roots)
    asked = log.all()
    again = asked.groupBy("domain", "nameserver").count().where("count > 1").count()
    needed = done.asked.select(F.col("name").alias("domain"), F.col("ip").alias("nameserver"))
    below = done.asked.where("answer is null or answer <> name").select("name", F.col("ip").alias("nameserver")).distinct()
    walks = done.origins.select(F.col("origin").alias("domain"), F.explode(names.superdomains(names.labels(F.col("origin")))).alias("name"))
    vain = asked.join(needed, ["domain", "nameserver"], "left_anti").join(walks.join(below, "name"), ["domain", "nameserver"], "left_anti").count()
    facts, trouble = resolve.told(hosts, done, rules)
    return _found_by_host(facts, trouble).withColumns({"asked_again": F.lit(int(again)), "in_vain": F.lit(int(vain))})


@query(f"{world.later_sql(7)} {REPORT.replace('AS found FROM', 'AS found, 0 AS asked_again FROM')}", plain=True)
def reresolve(spark, d):
    """The report of every host after a seventh of the zones went, with the answers of the run before that still hold.

    asked_again: questions of the second run that the first one had an answer to which still holds.
    """
    hosts, known = _queries(spark, d)
    rules, roots, log = suffix.prepared(world.suffixes(spark)), readers.root_hints(spark), Growing(spark, "asked-of-port")
    before, after = world.responses(spark, d, known=known), world.responses(spark, d, gone=7, known=known)
    kept = resolve.resolve(hosts, before, rules, roots).answers.without(stored(fetch.changed(before, after), "changed"))
    answers = fetch.table_port(after)
    done = resolve.resolve(hosts, lambda questions: answers(log.add(questions)), rules, roots, kept=kept)
    again = log.all().join(kept.questions, ["domain", "nameserver"], "left_semi").count()
    return _found_by_host(*resolve.told(hosts, done, rules)).withColumn("asked_again", F.lit(int(again)))


#: Seconds that a host may take in the world, where the registry takes zid % 50 seconds to answer for a zone and others take none.
HOST_SECONDS = 45
TIMED = f"""SELECT DISTINCT host AS query FROM hosts JOIN (
  SELECT zone, CASE WHEN klass = 5 THEN sum(zid % 50) OVER (PARTITION BY klass, CAST(floor(zid / {world.RING}) AS BIGINT)) ELSE zid % 50 END AS seconds FROM zones
) USING (zone) WHERE seconds > {HOST_SECONDS}"""


@query(TIMED)
def limited_report(spark, d):
    """Hosts that took over the limit in a resolution that gives up on walks over it; a host of a ring is charged for all of the ring."""
    hosts, known = _queries(spark, d)
    took = world.zones(spark, d, known=known).select(F.col("zone").alias("domain"), F.lit(world.REGISTRY_IP).alias("nameserver"), (F.col("zid") % 50).cast("double").alias("elapsed"))
    answers = world.responses(spark, d, known=known).join(took, ["domain", "nameserver"], "left")
    done = resolve.resolve(hosts, answers, world.suffixes(spark), readers.root_hints(spark), limit=HOST_SECONDS)
    return fetch.over_limit(resolve.spent(resolve.reached(hosts, done), done), "query", "seconds", HOST_SECONDS)


def _codes(q: Column) -> Column:
    return F.concat_ws(":", q.getField("nameserver"), *[q.getField("rcodes").getField(t).cast("string") for t in report.RECORD_TYPES])


def _flat(reports: DataFrame) -> DataFrame:
    """The columns of reports as text: sets joined by commas, problems as name@server:codes."""
    named = lambda m: F.array_join(F.array_sort(F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(e.getField("value"), lambda q: F.concat(e.getField("key"), F.lit("@"), _codes(q)))))), ",")
    kinds = [F.coalesce(named(F.col("misconfigured_domains").getItem(k)), F.lit("")).alias(k) for k in report.MISCONFIGURED]
    return reports.select("query", *kinds, named(F.col("hazardous_domains")).alias("hazardous"), *[F.array_join(c, ",").alias(c) for c in report.CATEGORIES])


_FOUND = ", ".join(f"coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (category = '{c}'), '') AS {c}" for c in report.CATEGORIES)
_BAD = ", ".join(f"coalesce(string_agg(said, ',' ORDER BY said) FILTER (kind = '{k}'), '') AS {n}" for k, n in (*((m, m) for m in report.MISCONFIGURED), ("hazardous", "hazardous")))
ROWS = f"""{BY_CLASS}), said AS (SELECT query, kind, name || '@' || nameserver || ':' || rcode || ':' || rcode || ':' || rcode AS said FROM bad),
asked AS (SELECT DISTINCT host AS query FROM hosts WHERE zone <> '')
SELECT * FROM asked LEFT JOIN (SELECT query, {_FOUND} FROM told GROUP BY query) USING (query) LEFT JOIN (SELECT query, {_BAD} FROM (SELECT query, kind, said FROM asked LEFT JOIN said USING (query)) GROUP BY query) USING (query)"""


@query(ROWS)
def report_row(spark, d):
    """The whole report of every host, one row each."""
    return _flat(report.report(*_reports(spark, d)))


def _class_reports(spark, d):
    """Reports from the class rules, without resolution: problems and the names that each host is under."""
    split = suffix.with_suffix(world.hosts(spark, d).where("zone <> ''").select("host", "zone").distinct(), "zone", world.suffixes(spark))
    of = {"sld": suffix.sld(F.col("domain"), F.col("suffix")), "tld": suffix.tld(F.col("domain"), F.col("suffix"))}
    facts = [split.select(F.col("host").alias("query"), F.lit(k).alias("category"), v.alias("value")) for k, v in of.items()]
    return report.report(split.select(F.col("host").alias("query")), facts[0].union(facts[1]), _problems(spark, d).where("name not like '%.org.'"))


CLASS_ROWS = f"""SELECT host AS query, any_value(zone) AS sld, any_value(regexp_extract(zone, '([^.]+[.][^.]+[.])$', 1)) AS tld,
  coalesce(any_value(CASE WHEN klass = 2 AND zone NOT LIKE '%.org.' THEN zone || '@{world.REGISTRY_IP}:3:3:3' END), '') AS hazardous,
  coalesce(any_value(CASE WHEN klass = 3 AND zone NOT LIKE '%.org.' THEN zone || '@' || octet || '.1:3:3:3' END), '') AS missing_ns_records,
  coalesce(any_value(CASE WHEN klass = 4 THEN '9.@{world.ROOT_IP}:3:3:3' END), '') AS ip_ns_records FROM hosts JOIN zones USING (zone) GROUP BY host"""


@query(CLASS_ROWS)
def report_json_files(spark, d):
    """Reports written as files of JSON lines and read again."""
    where = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    readers.write_reports(_class_reports(spark, d), where)
    return _flat(readers.read_reports(spark, where)).select("query", "sld", "tld", "hazardous", *report.MISCONFIGURED)


@query("SELECT count(DISTINCT host) AS lines, count(DISTINCT host) AS queries, 1 AS files FROM hosts WHERE zone <> ''")
def compile_jsonl(spark, d):
    """Reports of many files compiled into one file of JSON lines."""
    where = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    readers.write_reports(_class_reports(spark, d).repartition(5), where)
    readers.compile_reports(spark, where, f"{where}.jsonl")
    lines = readers.read_reports(spark, f"{where}.jsonl").select("query", F.input_file_name().alias("file"))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("query").alias("queries"), F.countDistinct("file").alias("files"))


@query("SELECT 'a.ent.' || zone AS query, 'ns.a.ent.' || zone AS ns FROM zones WHERE klass = 0")
def reuse_all_servers(spark, d):
    """Of the two servers of a zone one has nothing for a name, the other says that it does not exist; both stay in charge, and the second knows of a zone below."""
    known = world.seen(spark, d)
    z, zone = stored(world.zones(spark, d, known=known).where("klass = 0"), "zones"), F.col("zone")
    below, server = F.concat(F.lit("a.ent."), zone), F.concat(F.lit("10.253."), F.col("zid").cast("string"), F.lit(".1"))
    lines = F.array(F.concat(below, F.lit(" 60 IN NS ns."), below), F.concat(F.lit("ns."), below, F.lit(" 60 IN A "), server))
    none = F.array().cast("array<string>")
    said = [(F.concat(F.lit("ent."), zone), F.concat("octet", F.lit(".1")), 0, none), (F.concat(F.lit("ent."), zone), F.concat("octet", F.lit(".2")), 3, none), (below, F.concat("octet", F.lit(".2")), 0, lines), (below, server, 0, lines)]
    rows = [z.select(n.alias("domain"), s.alias("nameserver"), *[F.lit(code).alias(c) for c in fetch.CODES[:3]], F.lit(False).alias("timeout"), F.posexplode_outer(x).alias("seq", "rr_text")) for n, s, code, x in said]
    every = world.responses(spark, d, known=known)
    for r in rows:
        every = every.unionByName(r.withColumn("seq", F.coalesce("seq", F.lit(0))))
    facts, _ = resolve.reports(z.select(below.alias("query")), every, world.suffixes(spark), readers.root_hints(spark))
    return facts.where("category = 'ns' and value like 'ns.a.ent.%'").select("query", F.col("value").alias("ns"))


# Batch runs


def _log(spark, d):
    """Attempts at hosts, for which user ids stand: an error is a failed attempt."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("query"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"))


@query("SELECT user_id AS query FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) = 'error'", plain=True)
def retry_queue(spark, d):
    return batch.retry_queue(_log(spark, d))


@query("SELECT user_id AS query, count(*) AS attempts, max(event_id) AS attempt, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' ELSE 'done' END AS status FROM events GROUP BY user_id", plain=True)
def retry_last_attempt(spark, d):
    return fetch.last_attempt(_log(spark, d), ["query"], "attempt", ["status"])


@query("SELECT user_id AS query FROM events GROUP BY user_id HAVING arg_min(event_type, event_id) = 'error' AND arg_max(event_type, event_id) = 'error'", plain=True)
def retry_pass(spark, d):
    """Two passes of a run, the first and the last attempts at each host; what fails in both."""
    log, passes = _log(spark, d), iter((F.min_by, F.max_by))

    def step(hosts):
        status = log.groupBy("query").agg(next(passes)("status", "attempt").alias("status")).withColumn("query", F.col("query").cast("string")).join(hosts, "query")
        return status.where("status = 'done'").select("query")

    hosts = log.select(F.col("query").cast("string").alias("query"))
    left = batch.crawl(spark, hosts, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", step)
    return left.select(F.col("query").cast("long").alias("query"))


@query("SELECT user_id AS query FROM events WHERE value IS NOT NULL GROUP BY user_id HAVING sum(CAST(round(value * 100) AS BIGINT)) > 330000", plain=True)
def host_limit(spark, d):
    """Hosts that took over a limit; values stand for seconds, in hundredths so that sums are exact."""
    spent = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("query"), F.round(F.col("value") * 100).cast("long").alias("spent"))
    return fetch.over_limit(spent, "query", "spent", 330000)


@query("SELECT zone, zid, klass, octet, next FROM zones")
def jsonl_roundtrip(spark, d):
    return readers.json_round_trip(world.zones(spark, d))
