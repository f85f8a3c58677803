"""The log's journal and its workbook, read back."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT = "plate string, ts timestamp, display string, region string, confidence double, edits int, track_id int, frame int, source string, crop_path string"
#: In files the time goes by its plain name.
_JSON = EVENT.replace("ts timestamp", "timestamp timestamp")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Events of one journal file, in order of writing (``line``).

    The last line may be torn and is then left out; any other bad line is an
    error, blank ones are skipped.  A missing file is an empty journal.
    """
    from sightline.runtime import exists

    if not exists(spark, path):
        return spark.createDataFrame([], EVENT + ", line long")
    # One file's lines keep their order in (partition, place), which the id follows.
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    lines = lines.withColumn("e", F.from_json("value", _JSON))
    good = F.col("e.plate").isNotNull() & F.col("e.timestamp").isNotNull()
    last = lines.agg(F.max("line")).first()[0]
    broken = F.raise_error(F.concat(F.lit("corrupt journal line: "), F.substring("value", 1, 80)))
    lines = lines.where(good | (F.col("line") != F.lit(last))).withColumn("e", F.when(good, F.col("e")).otherwise(broken.cast(f"struct<{_JSON}>")))
    names = [p.split()[0] for p in EVENT.split(", ")]
    return lines.select(*(F.col("e.timestamp" if n == "ts" else f"e.{n}").alias(n) for n in names), "line").withColumn("region", F.coalesce("region", F.lit("XX")))


def accepted_times(journal: DataFrame) -> DataFrame:
    """The last accepted instant of every plate, which a resumed run starts from."""
    return journal.withColumn("r", F.row_number().over(W.partitionBy("plate").orderBy(F.desc("ts"), F.desc("line")))).where("r = 1").select("plate", F.unix_micros("ts").alias("last_us"))


def read_workbook(path: str) -> list[dict[str, object]]:
    """Rows of a written workbook, as dicts by header; numbers are floats, the rest is text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    rows = []
    for r in sheet.iterfind(".//m:row", ns):
        cells = {}
        for c in r.iterfind("m:c", ns):
            column = re.match("[A-Z]+", c.get("r"))[0]
            if c.get("t") == "inlineStr":
                cells[column] = "".join(t.text or "" for t in c.iterfind(".//m:t", ns))
            elif (v := c.find("m:v", ns)) is not None:
                cells[column] = float(v.text)
        rows.append(cells)
    if not rows:
        return []
    return [{name: r.get(column) for column, name in rows[0].items()} for r in rows[1:]]
