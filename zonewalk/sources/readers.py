"""Readers and writers: host lists, suffix rules, responses, reports as JSON lines, retry files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewalk.functions import names
from zonewalk.plans.storage import stored

#: The root servers and their addresses.
ROOT_SERVERS = (
    ("a.root-servers.net.", "198.41.0.4"),
    ("b.root-servers.net.", "199.9.14.201"),
    ("c.root-servers.net.", "192.33.4.12"),
    ("d.root-servers.net.", "199.7.91.13"),
    ("e.root-servers.net.", "192.203.230.10"),
    ("f.root-servers.net.", "192.5.5.241"),
    ("g.root-servers.net.", "192.112.36.4"),
    ("h.root-servers.net.", "198.97.190.53"),
    ("i.root-servers.net.", "192.36.148.17"),
    ("j.root-servers.net.", "192.58.128.30"),
    ("k.root-servers.net.", "193.0.14.129"),
    ("l.root-servers.net.", "199.7.83.42"),
    ("m.root-servers.net.", "202.12.27.33"),
)
RCODES = "struct<`2`:int,`1`:int,`28`:int,timeout:boolean>"
SUMMARIES = f"array<struct<nameserver:string,rcodes:{RCODES}>>"
SETS = ", ".join(f"{p}{c} array<string>" for p in ("", "ps_") for c in ("ns", "ipv4", "ipv6", "tld", "sld"))
REPORT = f"query string, misconfigured_domains map<string,map<string,{SUMMARIES}>>, hazardous_domains map<string,{SUMMARIES}>, {SETS}"
RESPONSES = "domain string, nameserver string, rcode int, rcode_a int, rcode_aaaa int, timeout boolean, seq int, rr_text string"
#: The same with the seconds that each answer took.
TIMED = f"{RESPONSES}, elapsed double"


def root_hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROOT_SERVERS, "ns string, ip string")


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """(query) from text files with one name per line; blank lines go, the name is kept as it is written."""
    return spark.read.text(path).select(F.col("value").alias("query")).where(F.trim("query") != "")


def host_of_url(url: Column) -> Column:
    """The normal host name of a URL; null if there is none."""
    return names.norm_host(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1))


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(suffix) from a public-suffix list: one rule per line, `//` begins a comment."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("suffix")).where("suffix <> '' and suffix not like '//%'")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers; those recorded without their time have none (null)."""
    return spark.read.schema(TIMED).parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports from a file or folder of JSON lines."""
    return spark.read.schema(REPORT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(path)


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    reports.write.mode(mode).json(path)


def compile_reports(spark: SparkSession, path: str, target: str) -> None:
    """All reports of a folder as JSON lines in the one file `target`, in place of what was there.

    The lines are written in parallel; the driver's file system then puts the parts end to end, without reading them as rows.
    """
    parts = f"{target}.parts"
    read_reports(spark, path).write.mode("overwrite").json(parts)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    begun, end = hadoop.fs.Path(f"{target}.begun"), hadoop.fs.Path(target)
    files = end.getFileSystem(conf)
    out = files.create(begun, True)
    for part in sorted((s.getPath() for s in files.listStatus(hadoop.fs.Path(parts))), key=lambda p: p.getName()):
        if part.getName().startswith("part-"):
            source = files.open(part)
            hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
    out.close()
    files.delete(end, True)
    files.rename(begun, end)
    files.delete(hadoop.fs.Path(parts), True)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def json_round_trip(rows: DataFrame) -> DataFrame:
    """The rows after they were written as JSON lines and read again."""
    return stored(json_lines(rows), "json-lines").select(F.from_json("value", rows.schema).alias("r")).select("r.*")
