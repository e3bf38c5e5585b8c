"""Feeds of indicators, and the forms in which results leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.plans.base import EV, Registry, events
from siftnet.tables import load

R = Registry()


def csv_fields(line: Column, n: int) -> Column:
    """The first ``n`` fields of a line with quotes, which may hold commas."""
    return F.from_csv(line, ", ".join(f"c{i} string" for i in range(n)), {"quote": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})


def host_of(url: Column) -> Column:
    """The host of an address: no scheme, nothing from a slash, colon, question mark or hash on, in lower case."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(F.regexp_replace(url, r"^[^:/?#]*://", ""), r"^([^/:?#]*)", 1))), F.lit(""))


def tag_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[,\s]+"), lambda t: t != "")


def parse_url_feed(df: DataFrame, line: str = "line") -> DataFrame:
    """Indicators of a feed of addresses in quoted lines; remarks, blank and short lines are left out."""
    f = df.where(~F.trim(line).startswith("#") & (F.trim(line) != "")).select(csv_fields(F.col(line), 7).alias("f"))
    return f.select(host_of(F.col("f.c2")).alias("indicator"), F.lit("domain").alias("type"), F.lit("urlfeed").alias("source"), F.lit(0.85).alias("confidence"), F.array_append(tag_list(F.coalesce("f.c6", F.lit(""))), F.lit("malware_distribution")).alias("tags"), F.lit(168).alias("ttl_hours"), F.col("f.c6").alias("last")).where("indicator is not null and last is not null").drop("last")


def parse_c2_feed(df: DataFrame) -> DataFrame:
    """Indicators of command servers."""
    return df.where("ip_address is not null").select(F.trim("ip_address").alias("indicator"), F.lit("ipv4").alias("type"), F.lit("c2feed").alias("source"), F.lit(0.95).alias("confidence"), F.array_compact(F.array(F.lit("c2"), F.lower("malware"))).alias("tags"), F.lit(72).alias("ttl_hours"))


def parse_ja3_feed(df: DataFrame, line: str = "line", column: int = 0, reason: int = 3) -> DataFrame:
    """Fingerprints of TLS clients; ``column`` is where the digest is, a line without one of 32 characters is left out."""
    f = df.where(~F.trim(line).startswith("#") & (F.trim(line) != "")).select(csv_fields(F.col(line), max(column, reason) + 1).alias("f")).select(F.col(f"f.c{column}").alias("indicator"), F.lower(F.coalesce(f"f.c{reason}", F.lit(""))).alias("why"))
    return f.where(F.length("indicator") == 32).select("indicator", F.lit("ja3").alias("type"), F.lit(0.90).alias("confidence"), F.when(F.col("why").contains("c2") | F.col("why").contains("c&c"), F.array(F.lit("malicious_tls"), F.lit("c2"))).otherwise(F.array(F.lit("malicious_tls"))).alias("tags"), F.lit(336).alias("ttl_hours"))


_IOC = "data array<struct<ioc: string, ioc_type: string, malware: string, confidence_level: int, first_seen: string, last_seen: string>>"


def feed_time(c: Column) -> Column:
    """Times of three forms; anything else is null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss 'UTC'")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def parse_ioc_feed(df: DataFrame, body: str = "body") -> DataFrame:
    """Indicators with their own confidence; addresses with a port lose it, doubtful ones live shorter."""
    d = df.select(F.explode(F.from_json(body, _IOC)["data"]).alias("d")).select("d.*")
    conf = F.coalesce(F.col("confidence_level"), F.lit(50)) / 100.0
    ip = F.col("ioc_type") == "ip:port"
    return d.select(F.when(ip, F.regexp_replace("ioc", r":\d+$", "")).otherwise(F.lower("ioc")).alias("indicator"), F.when(ip, F.regexp_extract("ioc", r":(\d+)$", 1).try_cast("int")).alias("port"), F.when(ip, "ipv4").otherwise(F.col("ioc_type")).alias("type"), conf.alias("confidence"), F.when(conf < 0.5, 72).otherwise(168).alias("ttl_hours"), F.unix_micros(feed_time(F.col("first_seen"))).alias("first_us"))


# --- sinks -------------------------------------------------------------------------------------------------------------------------------


def csv_line(*cols: Column) -> Column:
    """A line with every field that needs it in quotes."""
    def field(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.array_join(F.array(*(field(c) for c in cols)), ",")


def event_line(ev: DataFrame) -> DataFrame:
    return ev.select("event_id", csv_line(F.col("event_id"), F.col("t_us"), F.col("event_type"), F.col("domain"), F.format_number(F.col("anomaly_score"), 4), F.array_join("tags", ";"), F.col("threat_desc")).alias("line"))


def write_page(rows: DataFrame, path: str, form: str) -> None:
    """A page of events as ``json`` lines, quoted ``csv``, or a ``hosts`` file of names."""
    flat = rows.withColumns({c: F.array_join(c, ";") for c, t in rows.dtypes if t == "array<string>"})
    if form == "json":
        rows.write.json(path)
    elif form == "csv":
        flat.write.csv(path, header=True, quoteAll=True, escape='"')
    elif form == "hosts":
        rows.where("domain is not null").select(F.concat(F.lit("0.0.0.0 "), "domain").alias("value")).distinct().write.text(path)
    else:
        raise ValueError(f"no form {form}")


def page_json(rows: DataFrame, total: int, page: int, limit: int) -> DataFrame:
    """One document of a page: its events, the total, and where it is. A page has 500 rows at most."""
    return rows.limit(limit).agg(F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias("events"), F.lit(total).alias("total"), F.lit(page).alias("page"), F.lit(limit).alias("limit"))).alias("body"))


# --- queries -----------------------------------------------------------------------------------------------------------------------------


@R.query(f"with {EV}, d as (select distinct domain from ev where domain is not null) select domain as indicator, 'elf,mirai,malware_distribution' as tags, 0.85::double as confidence, 168 as ttl_hours from d")
def src_url_feed(spark, sf_dir: str) -> DataFrame:
    """A feed of addresses made of the names, with remarks, blank and short lines."""
    d = events(spark, sf_dir).where("domain is not null").select("domain").distinct()
    good = F.concat(F.lit('"1","2024-01-01 00:00:00","http://'), F.upper("domain"), F.lit(':8080/a,b?x=1#y","online","t","x","ELF, Mirai"'))
    lines = d.select(F.explode(F.array(good, F.lit("# remark"), F.lit("  "), F.lit('"1","2"'))).alias("line"))
    return parse_url_feed(lines).select("indicator", F.array_join("tags", ",").alias("tags"), "confidence", "ttl_hours")


@R.query("select trim(ip_address) as indicator, case when malware is null then 'c2' else 'c2,' || lower(malware) end as tags, 72 as ttl_hours from feodo_entries where ip_address is not null")
def src_c2_feed(spark, sf_dir: str) -> DataFrame:
    return parse_c2_feed(load(spark, sf_dir, "feodo_entries")).select("indicator", F.array_join("tags", ",").alias("tags"), "ttl_hours")


@R.query("with f as (select entry_id, malware from feodo_entries) select md5(entry_id::varchar) as indicator, case when entry_id % 2 = 0 then 'malicious_tls,c2' else 'malicious_tls' end as tags from f")
def src_ja3_feed(spark, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "feodo_entries")
    good = F.concat(F.md5(F.col("entry_id").cast("string")), F.lit(",2024-01-01 00:00:00,2024-01-02 00:00:00,"), F.when(F.col("entry_id") % 2 == 0, "Some C&C").otherwise("adware"))
    return parse_ja3_feed(f.select(F.explode(F.array(good, F.lit("# x"), F.lit("short,a,b,c"))).alias("line"))).select("indicator", F.array_join("tags", ",").alias("tags"))


@R.query("select trim(ip_address) as indicator, dst_port as port, 'ipv4' as type, (entry_id % 100)::double / 100.0::double as confidence, case when (entry_id % 100) < 50 then 72 else 168 end as ttl_hours from feodo_entries where ip_address is not null and dst_port is not null")
def src_ioc_feed(spark, sf_dir: str) -> DataFrame:
    f = load(spark, sf_dir, "feodo_entries").where("ip_address is not null and dst_port is not null")
    item = F.struct(F.concat_ws(":", F.trim("ip_address"), "dst_port").alias("ioc"), F.lit("ip:port").alias("ioc_type"), "malware", (F.col("entry_id") % 100).cast("int").alias("confidence_level"), F.col("first_seen"))
    return parse_ioc_feed(f.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("body"))).select("indicator", "port", "type", "confidence", "ttl_hours")


@R.query(f"""with {EV} select event_id, event_id || ',' || t_us || ',' || event_type || ',' || coalesce(domain, '') || ',' || printf('%.4f', anomaly_score) || ',' || array_to_string(tags, ';') || ',' || coalesce(case when contains(threat_desc, ',') then '"' || threat_desc || '"' else threat_desc end, '') as line from ev""")
def sink_csv_lines(spark, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return event_line(ev)


QUERIES, SQL = R.QUERIES, R.SQL
