"""What the operators of this package share: the shared folder, written tables, batch sizes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009..U+000D.
WS = " \t\n\x0b\x0c\r"
#: Unicode's White_Space property, as a regular-expression class body.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this
    process is taken in local mode, as in tests; on a cluster it is an error."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_application_dir(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path  # type: ignore[attr-defined]
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete tables made by ``write_table`` that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_at)  # type: ignore[attr-defined]


def clean(spark: SparkSession) -> None:
    """Delete all tables this application wrote; results that still read them are lost."""
    _delete(spark, _application_dir(spark))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the like, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_uid(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once with a number for each row, so that rows have a name that ids, which may
    repeat or be null, cannot give; and that column's name."""
    uid = fresh(df, "uid")
    return write_table(df.withColumn(uid, F.monotonically_increasing_id()), name), uid


#: Rows of keys, at most about 20 MB, that may be sent to every worker; more are joined by a shuffle.
MAX_BROADCAST = 400_000


def sent(table: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """A written table, marked for broadcast if its rows number at most ``most``."""
    return F.broadcast(table) if table.count() <= most else table


def without(df: DataFrame, uid: str, gone: DataFrame) -> DataFrame:
    """``df`` without the rows named in the written table ``gone`` (uid), and without its uid column.
    While they are few their names are sent to the rows; else the rows are moved once."""
    return df.join(sent(gone.toDF(uid)), uid, "left_anti").drop(uid)


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough that very long texts fit a worker's memory, and shuffle files
    deleted at the end of each query instead of when the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.shuffleDependency.fileCleanup.enabled", "true")


def fewer_collections() -> None:
    """For workers that keep large dictionaries of strings: cycle collection would walk them again
    and again, and they hold no cycles."""
    import gc

    gc.collect()
    gc.set_threshold(500_000, 50, 100)


class Recent:
    """A bounded memory of two generations: what is asked for again moves to the young one; when
    that is full it becomes the old one, and the old one goes. So frequent keys stay."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}

    def missing(self, keys) -> list:
        """The keys of neither generation; all others are in the young one afterwards."""
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out


def map_rows(df: DataFrame, run) -> DataFrame:
    """``run`` (batches to batches of the same columns) over whole rows, whatever the columns are
    called; to ``run`` they are c0, c1, ..."""
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(df.schema)])
    return df.toDF(*schema.names).mapInArrow(trimmed(run), schema).toDF(*df.columns)


#: What this worker remembers between tasks, for one operator at a time.
_memory: dict[str, object] = {}


def trim() -> None:
    """Hand freed memory back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def trimmed(run):
    """``run`` (batches to batches) with Arrow's large buffers taken from the system and given back
    at once, and a trim when its task ends, as workers live on."""

    def wrapped(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        trim()

    return wrapped


def remembered(name: str, make):
    """The worker's memory by that name; those of other operators, whose stages are over, go."""
    if name not in _memory:
        _memory.clear()
        fewer_collections()
        trim()
        _memory[name] = make()
    return _memory[name]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)
