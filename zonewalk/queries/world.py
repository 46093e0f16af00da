"""A DNS world derived from `pages`, by the same rules in Spark and in SQL: zones of six classes and what servers answer.

class 0: two servers with glue. 1: served by a hub in another zone, no glue. 2: does not exist. 3: its server says it does
not exist. 4: an address stands where the server's name should. 5: served by the next zone of its ring, no glue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonewalk.functions import names
from zonewalk.plans.storage import stored
from zonewalk.sources import readers

SUFFIXES = ("com.", "net.", "org.", "example.com.", "example.net.", "example.org.")
TLDS = ("com.", "net.", "org.")
HUB, HUB_NS, HUB_IP = "hub.example.net.", "ns1.hub.example.net.", "10.254.0.1"
REGISTRY_IP, ROOT_IP = "10.255.0.1", "198.41.0.4"
#: Rings are closed within runs of so many page numbers, so no window spans all zones.
RING = 600


def suffixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host)."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", readers.host_of_url(F.col("url")).alias("host")).where("host is not null")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, zone): the zone is the last three labels, empty if there are fewer."""
    zone = F.coalesce(names.last_labels(names.labels(F.col("host")), 3), F.lit(""))
    return pages(spark, sf_dir).withColumn("zone", zone)


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`hosts` with one row for each host, its first page, written once: what is derived of it does not read the pages again."""
    return stored(hosts(spark, sf_dir).groupBy("host", "zone").agg(F.min("page_id").alias("page_id")).select("page_id", "host", "zone"), "seen")


def zones(spark: SparkSession, sf_dir: str, gone: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """(zone, zid, klass, octet, next): next is set for class 5. Zones whose number `gone` divides no longer exist (class 2).

    known: what `seen` gave of the same pages.
    """
    klass = F.col("zid") % 6 if gone is None else F.when(F.col("zid") % gone == 0, 2).otherwise(F.col("zid") % 6)
    first = (hosts(spark, sf_dir) if known is None else known).where("zone <> ''").groupBy("zone").agg(F.min("page_id").alias("zid"))
    out = first.select("zone", "zid", klass.alias("klass"), F.concat(F.lit("10."), F.floor(F.col("zid") / 256).cast("string"), F.lit("."), (F.col("zid") % 256).cast("string")).alias("octet"))
    ring = Window.partitionBy("klass", F.floor(F.col("zid") / RING)).orderBy("zid")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.withColumn("next", F.when(F.col("klass") == 5, F.coalesce(F.lead("zone").over(ring), F.first("zone").over(whole))))


def _line(owner: Column | str, kind: str, data: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(as_column(owner), F.lit(f" 3600 IN {kind} "), as_column(data))


def responses(spark: SparkSession, sf_dir: str, gone: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """All answers of the world as readers.RESPONSES; `known` as in `zones`."""
    z, zone, octet = zones(spark, sf_dir, gone, known), F.col("zone"), F.col("octet")
    ns1, ns2, klass = F.concat(F.lit("ns1."), zone), F.concat(F.lit("ns2."), zone), F.col("klass")
    none = F.array().cast("array<string>")
    two = F.array(_line(zone, "NS", ns1), _line(zone, "NS", ns2), _line(ns1, "A", F.concat(octet, F.lit(".1"))), _line(ns2, "A", F.concat(octet, F.lit(".2"))))
    parent = (
        F.when(klass == 0, two).when(klass == 1, F.array(_line(zone, "NS", HUB_NS))).when(klass == 3, F.array(_line(zone, "NS", ns1), _line(ns1, "A", F.concat(octet, F.lit(".1")))))
        .when(klass == 4, F.array(_line(zone, "NS", F.concat(octet, F.lit(".9."))))).when(klass == 5, F.array(_line(zone, "NS", F.concat(F.lit("ns1."), F.col("next"))))).otherwise(none)
    )
    own_ips = F.when(klass == 0, F.array(F.concat(octet, F.lit(".1")), F.concat(octet, F.lit(".2")))).when(klass == 1, F.array(F.lit(HUB_IP))).when(klass == 3, F.array(F.concat(octet, F.lit(".1")))).otherwise(none)
    own = F.when(klass == 0, two).when(klass == 1, F.array(_line(zone, "NS", HUB_NS))).otherwise(none)
    nx = F.when(klass.isin(2, 3), 3).otherwise(0)
    at_parent = z.select(zone.alias("domain"), F.lit(REGISTRY_IP).alias("nameserver"), F.when(klass == 2, 3).otherwise(0).alias("rcode"), parent.alias("lines"))
    at_own = z.select(zone.alias("domain"), F.explode(own_ips).alias("nameserver"), nx.alias("rcode"), own.alias("lines"))
    below = (hosts(spark, sf_dir) if known is None else known).where("zone <> '' and host <> zone").select("host", "zone").distinct().join(z, "zone")
    at_host = below.select(F.col("host").alias("domain"), F.explode(own_ips).alias("nameserver"), F.lit(0).alias("rcode"), none.alias("lines"))
    fixed = []
    for t in TLDS:
        for domain, servers in ((t, (ROOT_IP, REGISTRY_IP)), (f"example.{t}", (REGISTRY_IP,))):
            fixed += [(domain, s, 0, [f"{domain} 3600 IN NS a.nic.{t}", f"a.nic.{t} 3600 IN A {REGISTRY_IP}"]) for s in servers]
    hub = [f"{HUB} 3600 IN NS {HUB_NS}", f"{HUB_NS} 3600 IN A {HUB_IP}"]
    fixed += [(HUB, s, 0, hub) for s in (REGISTRY_IP, HUB_IP)] + [(HUB_NS, HUB_IP, 0, hub[1:]), ("9.", ROOT_IP, 3, [])]
    every = at_parent.union(at_own).union(at_host).union(spark.createDataFrame(fixed, "domain string, nameserver string, rcode int, lines array<string>"))
    codes = [F.col("rcode").cast("int").alias(c) for c in ("rcode", "rcode_a", "rcode_aaaa")]
    return every.select("domain", "nameserver", *codes, F.lit(False).alias("timeout"), F.posexplode_outer("lines").alias("seq", "rr_text")).withColumn("seq", F.coalesce("seq", F.lit(0)))


SQL = f"""
WITH RECURSIVE hosts AS (
  SELECT page_id, host, regexp_extract(host, '([^.]+[.][^.]+[.][^.]+[.])$', 1) AS zone
  FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) || '.' AS host FROM pages) WHERE host <> '.'
), zones0 AS (
  SELECT zone, min(page_id) AS zid, min(page_id) % 6 AS klass,
         '10.' || CAST(CAST(floor(min(page_id) / 256) AS BIGINT) AS VARCHAR) || '.' || CAST(min(page_id) % 256 AS VARCHAR) AS octet
  FROM hosts WHERE zone <> '' GROUP BY zone
), zones AS (
  SELECT *, CASE WHEN klass = 5 THEN coalesce(lead(zone) OVER w, first_value(zone) OVER w) END AS next
  FROM zones0 WINDOW w AS (PARTITION BY klass, CAST(floor(zid / {RING}) AS BIGINT) ORDER BY zid)
), tlds AS (SELECT unnest(['com.', 'net.', 'org.']) AS tld
), psl AS (SELECT unnest([{", ".join(f"'{s}'" for s in SUFFIXES)}]) AS suffix
), parts AS (
  SELECT page_id, host, zone, string_split(rtrim(host, '.'), '.') AS p FROM hosts
), split AS (
  SELECT page_id, host, zone, p, CASE WHEN len(p) >= 2 AND array_to_string(p[-2:], '.') || '.' IN (SELECT suffix FROM psl) THEN 2 ELSE 1 END AS n FROM parts
), psl_split AS (
  SELECT page_id, host, zone, p, array_to_string(p[len(p) - n + 1:], '.') || '.' AS suffix,
         CASE WHEN len(p) > n THEN p[len(p) - n] ELSE '' END AS domain, CASE WHEN len(p) > n + 1 THEN array_to_string(p[:len(p) - n - 1], '.') ELSE '' END AS subdomain
  FROM split
), chain AS (
  SELECT page_id, host, d AS depth, array_to_string(p[len(p) - d + 1:], '.') || '.' AS name FROM (SELECT page_id, host, p, unnest(range(1, len(p) + 1)) AS d FROM parts)
), lines AS (
  SELECT zone AS domain, '{REGISTRY_IP}' AS nameserver, CASE WHEN klass = 2 THEN 3 ELSE 0 END AS rcode, CASE klass
    WHEN 0 THEN [zone || ' 3600 IN NS ns1.' || zone, zone || ' 3600 IN NS ns2.' || zone, 'ns1.' || zone || ' 3600 IN A ' || octet || '.1', 'ns2.' || zone || ' 3600 IN A ' || octet || '.2']
    WHEN 1 THEN [zone || ' 3600 IN NS {HUB_NS}'] WHEN 3 THEN [zone || ' 3600 IN NS ns1.' || zone, 'ns1.' || zone || ' 3600 IN A ' || octet || '.1']
    WHEN 4 THEN [zone || ' 3600 IN NS ' || octet || '.9.'] WHEN 5 THEN [zone || ' 3600 IN NS ns1.' || next] ELSE [] END AS rr FROM zones
  UNION ALL SELECT zone, octet || '.' || CAST(i AS VARCHAR), 0, [zone || ' 3600 IN NS ns1.' || zone, zone || ' 3600 IN NS ns2.' || zone, 'ns1.' || zone || ' 3600 IN A ' || octet || '.1', 'ns2.' || zone || ' 3600 IN A ' || octet || '.2']
    FROM zones, (SELECT unnest([1, 2]) AS i) WHERE klass = 0
  UNION ALL SELECT zone, '{HUB_IP}', 0, [zone || ' 3600 IN NS {HUB_NS}'] FROM zones WHERE klass = 1
  UNION ALL SELECT zone, octet || '.1', 3, [] FROM zones WHERE klass = 3
  UNION ALL SELECT host, ip, 0, [] FROM (SELECT DISTINCT host, zone FROM hosts WHERE zone <> '' AND host <> zone) JOIN
    (SELECT zone, octet || '.' || CAST(i AS VARCHAR) AS ip FROM zones, (SELECT unnest([1, 2]) AS i) WHERE klass = 0 UNION ALL SELECT zone, '{HUB_IP}' FROM zones WHERE klass = 1 UNION ALL SELECT zone, octet || '.1' FROM zones WHERE klass = 3) USING (zone)
  UNION ALL SELECT tld, ip, 0, [tld || ' 3600 IN NS a.nic.' || tld, 'a.nic.' || tld || ' 3600 IN A {REGISTRY_IP}'] FROM tlds, (SELECT unnest(['{ROOT_IP}', '{REGISTRY_IP}']) AS ip)
  UNION ALL SELECT 'example.' || tld, '{REGISTRY_IP}', 0, ['example.' || tld || ' 3600 IN NS a.nic.' || tld, 'a.nic.' || tld || ' 3600 IN A {REGISTRY_IP}'] FROM tlds
  UNION ALL SELECT '{HUB}', ip, 0, ['{HUB} 3600 IN NS {HUB_NS}', '{HUB_NS} 3600 IN A {HUB_IP}'] FROM (SELECT unnest(['{REGISTRY_IP}', '{HUB_IP}']) AS ip)
  UNION ALL SELECT '{HUB_NS}', '{HUB_IP}', 0, ['{HUB_NS} 3600 IN A {HUB_IP}']
  UNION ALL SELECT '9.', '{ROOT_IP}', 3, []
), responses AS (
  SELECT domain, nameserver, rcode, CAST(i - 1 AS INTEGER) AS seq, rr[i] AS rr_text FROM (SELECT *, unnest(range(1, greatest(len(rr), 1) + 1)) AS i FROM lines)
), records AS (
  SELECT domain, nameserver, seq, f[1] AS name, f[2] AS ttl, f[3] AS class, f[4] AS type, f[5] AS data FROM (SELECT *, string_split(rr_text, ' ') AS f FROM responses WHERE rr_text IS NOT NULL)
), answers AS (
  SELECT domain, nameserver, count(rr_text) AS n, max(rcode) AS rcode, bool_or(rcode = 3) AS nx FROM responses GROUP BY domain, nameserver
)
"""


def later_sql(gone: int) -> str:
    """SQL of the world when zones whose number `gone` divides no longer exist."""
    return SQL.replace("min(page_id) % 6 AS klass", f"CASE WHEN min(page_id) % {gone} = 0 THEN 2 ELSE min(page_id) % 6 END AS klass")
