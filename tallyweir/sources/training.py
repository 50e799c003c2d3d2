"""Training rows: ragged lines of [labels] src_ip src_port dst_ip dst_port proto times... blank sizes... ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.schema import KEY

#: Cells among which the first address is looked for, and fewest cells of a line.
ADDRESS_WITHIN, FEWEST = 10, 10


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(group, line) of the files of a folder, without those that hold labels or names only; group is the file's name."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"[^/]*$", 0).alias("group"), F.col("value").alias("line"))
    found = text.where(~F.col("group").rlike(r"(labeled|with_domain_name)\.csv$"))
    if found.isEmpty():
        raise FileNotFoundError(f"no training lines under {path}")
    return found


def is_address(cell):
    """Dotted IPv4, or an IPv6 form: one match of one pattern, as cells are many."""
    byte = r"\s*\+?0*(?:25[0-5]|2[0-4]\d|1?\d?\d)\s*"
    return F.trim(cell).rlike(rf"^(?:{byte}(?:\.{byte}){{3}}|(?=[^:]*:[^:]*:)[0-9a-fA-F:]{{2,39}})$")


def parse(lines: DataFrame) -> DataFrame:
    """(group, ip1, port1, ip2, port2, proto, events: array of (t, size)) of the lines that can be read.

    The first address among the first cells starts the key; a blank cell splits times from sizes; cells that are no
    numbers are passed over, and the shorter of both lists sets the length. The endpoints are ordered by (text, port).
    """
    cells = F.split("line", ",", -1)
    p = lines.withColumn("cells", cells).where(F.size("cells") >= FEWEST)
    p = p.withColumn("at", F.array_position(F.transform(F.slice("cells", 1, ADDRESS_WITHIN), lambda c: is_address(c)), True)).where("at > 0 and at + 4 <= size(cells)")
    cell = lambda i: F.trim(F.try_element_at("cells", (F.col("at") + i).cast("int")))
    p = p.withColumns({"a_ip": cell(0), "a_port": cell(1).try_cast("int"), "b_ip": cell(2), "b_port": cell(3).try_cast("int"), "proto": cell(4)}).where("a_port is not null and b_port is not null")
    rest = F.slice("cells", (F.col("at") + 5).cast("int"), F.size("cells"))
    p = p.withColumn("rest", rest).withColumn("blank", F.array_position(F.transform("rest", lambda c: F.trim(c) == ""), True)).where("blank > 0")
    number = lambda a: F.filter(F.transform(a, lambda c: F.trim(c).try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    p = p.withColumns({"ts": number(F.slice("rest", F.lit(1), (F.col("blank") - 1).cast("int"))), "sizes": number(F.slice("rest", (F.col("blank") + 1).cast("int"), F.size("rest")))})
    n = F.least(F.size("ts"), F.size("sizes"))
    events = F.transform(F.arrays_zip(F.slice("ts", F.lit(1), n).alias("t"), F.slice("sizes", F.lit(1), n).alias("size")), lambda x: F.struct(x["t"].alias("t"), x["size"].alias("size")))
    first = F.struct("a_ip", "a_port") <= F.struct("b_ip", "b_port")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return p.where(n > 0).select("group", pick("a_ip", "b_ip").alias("ip1"), pick("a_port", "b_port").alias("port1"), pick("b_ip", "a_ip").alias("ip2"), pick("b_port", "a_port").alias("port2"), "proto", events.alias("events"))


def flows(parsed: DataFrame) -> DataFrame:
    """(group, key, ts, size, packets): both directions of a flow in one list, ordered by time."""
    g = parsed.groupBy("group", *KEY).agg(F.sort_array(F.flatten(F.collect_list("events"))).alias("e"))
    return g.select("group", *KEY, F.transform("e", lambda x: x["t"]).alias("ts"), F.transform("e", lambda x: x["size"]).alias("size"), F.size("e").cast("long").alias("packets"))


def lines_of(packets: DataFrame) -> DataFrame:
    """Training lines, one per direction of each flow: the inverse of `parse`. Blank cells follow the size of a single packet,
    as lines of under FEWEST cells are not read."""
    from tallyweir.functions.keys import ip_text

    held = F.sort_array(F.collect_list(F.struct("ts_us", "turn", "ip_len")))
    g = packets.groupBy("src_ip_n", "src_port", "dst_ip_n", "dst_port", "proto").agg(held.alias("h"))
    cells = F.array(F.lit("label"), ip_text(F.col("src_ip_n")), F.col("src_port").cast("string"), ip_text(F.col("dst_ip_n")), F.col("dst_port").cast("string"), F.lit("UDP"))
    ts = F.transform("h", lambda x: F.format_string("%.6f", x["ts_us"] / F.lit(1e6)))
    sizes = F.transform("h", lambda x: x["ip_len"].cast("string"))
    g = g.withColumn("cells", F.concat(cells, ts, F.array(F.lit("")), sizes))
    filled = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(0), FEWEST - F.size("cells"))))
    return g.select(F.lit("trace.csv").alias("group"), F.array_join(filled, ",").alias("line"))
