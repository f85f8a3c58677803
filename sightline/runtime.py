"""Session defaults, the shared folder, and lineage cuts.

Every multi-pass operator cuts its lineage by writing a table under the folder
named in ``spark.checkpoint.dir``, which all executors share, so a lost
executor only costs the tasks it ran.  A folder of our own is made only where
that setting is empty, as in tests.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults of a session that this package opens by itself.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Rows and bytes up to which a lookup side is broadcast; beyond either it is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def session(app: str = "sightline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULT_CONF | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; none if there is no such folder."""
    fs, p = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def write_json(spark: SparkSession, path: str, value: object) -> bool:
    """Write a small JSON file so that it appears whole or not at all.

    It is written beside its place and renamed; False means that another
    writer had already put a file there.
    """
    fs, p = _hadoop(spark, path)
    _, tmp = _hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(p.getParent())
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if fs.exists(p) or not fs.rename(tmp, p):
        fs.delete(tmp, False)
        return False
    return True


def read_json(spark: SparkSession, path: str) -> object:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one of our own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not hasattr(sc, "_sightline_dir"):
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc._sightline_dir = "file://" + tempfile.mkdtemp(prefix="sightline-")
        sc.setCheckpointDir(sc._sightline_dir)
    return sc._sightline_dir


_LIVE: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []


@atexit.register
def _clean() -> None:
    for path, spark in list(_LIVE.items()):
        try:
            delete(spark, path)
        except Exception:  # the context may be gone
            pass


@contextmanager
def scope() -> Iterator[None]:
    """Workspaces opened inside are removed at the end: for work whose results are written by then, such as a trigger's."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            if path in _LIVE:
                delete(_LIVE.pop(path), path)


class Workspace:
    """A private folder of written tables below the shared one, removed by ``close``, at the end of the ``scope`` around it, or else when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/sightline/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _LIVE[self.path] = spark
        if _SCOPES:
            _SCOPES[-1].append(self.path)

    def cut(self, df: DataFrame, name: str = "t", partition_by: Iterable[str] = ()) -> DataFrame:
        """``df`` computed once, written, and read back without its lineage."""
        self._n += 1
        at = f"{self.path}/{self._n:03d}-{name}"
        schema = df.schema
        df.write.partitionBy(*partition_by).parquet(at) if partition_by else df.write.parquet(at)
        out = self.spark.read.schema(schema).parquet(at)
        out._sightline_at = at
        return out

    def close(self) -> None:
        """Remove everything, once no later plan reads it."""
        delete(self.spark, self.path)
        _LIVE.pop(self.path, None)

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables of this workspace that no later plan reads."""
        for t in tables:
            if t is not None and hasattr(t, "_sightline_at"):
                delete(self.spark, t._sightline_at)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: strings and binaries by their length, nested values by their JSON, others as 8."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f.name).alias("v")))), F.lit(0))
    return size


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is counted to hold at most ``rows`` rows and ``size`` bytes."""
    some = df.select(row_bytes(df).alias("b")).limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return some.n <= rows and some.b <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df


def ascii_upper(c: Column) -> Column:
    """Upper case for a-z only: independent of locale and of engines' Unicode tables."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


#: A key of more than one row in HOT_SHARE is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 256


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows, of which a few keys may hold most, to a table with one row per key (``how``: inner or left).

    The table is broadcast if its rows and bytes are counted to be few.  Else
    the rows are written once and their hot keys are counted; rows of hot keys
    stay where they are and meet the few table rows of hot keys by broadcast,
    and only all other rows are shuffled.
    """
    if is_small(small):
        return rows.join(F.broadcast(small), keys, how)
    spark = rows.sparkSession
    rows = Workspace(spark, "lookup").cut(rows, "rows")
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.count()
    top = counted.dropna(subset=keys).where(F.col("_n") * HOT_SHARE > total).drop("_n").collect()  # fewer than HOT_SHARE
    if not top:
        return rows.join(small, keys, how)
    hot = F.broadcast(spark.createDataFrame(top, counted.drop("_n").schema))
    few = small.join(hot, keys, "left_semi")
    few = F.broadcast(few) if is_small(few) else few
    return rows.join(hot, keys, "left_semi").join(few, keys, how).unionByName(rows.join(hot, keys, "left_anti").join(small, keys, how))
