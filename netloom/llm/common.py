"""What the corpus operators share: tables in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the operators' contracts, [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}


def columns(text: str) -> T.StructType:
    """The schema of a list such as "a long, b array<int>", without a session (tasks import it too)."""

    def kind(t: str) -> T.DataType:
        return T.ArrayType(kind(t[6:-1])) if t.startswith("array<") else _TYPES[t]

    return T.StructType([T.StructField(n, kind(t)) for n, t in (x.split() for x in text.split(", "))])


#: Session settings made here, so that a user's own stay and clean_up() takes these back.
_SET: dict[str, str] = {}


def tuned(spark: SparkSession, rows_per_batch: int = 256) -> None:
    """Small Arrow batches, as texts can be long; skewed joins are split even where that costs a shuffle.

    A setting that the user has made stays; clean_up() takes back what is set here.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows_per_batch), "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    for key, value in wanted.items():
        if spark.conf.get(key, None) in (None, _SET.get(key)):
            spark.conf.set(key, value)
            _SET[key] = value


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one of our own on a local master (tests); on a cluster,
    whose machines don't share such a folder, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = _SET["spark.checkpoint.dir"] = "file://" + tempfile.mkdtemp(prefix="netloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def root(spark: SparkSession) -> str:
    """The application's own folder in the shared one; all intermediate tables are in it."""
    return f"{shared_folder(spark)}/netloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clean_up(spark: SparkSession) -> None:
    """Delete every intermediate table of this application and take back the session's settings. Results that have not been
    written elsewhere by then are lost, as they read these tables."""
    _delete(spark, root(spark))
    for key, value in list(_SET.items()):
        if spark.conf.get(key, None) == value:
            spark.conf.unset(key)
        del _SET[key]


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{root(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._netloom_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables that stored() wrote and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_netloom_path", None):
            _delete(df.sparkSession, path)


def partitions(df: DataFrame) -> int:
    """Partitions to deal df over: as many as the session shuffles over, or as its input has splits if that is more, so
    that a partition stays near the size of a split whatever the input's size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Keys with more rows than this share of all have less than this many; they are broadcast.
HOT = 4096


def keys_of(big: DataFrame, small: DataFrame, key: str, size: str) -> DataFrame:
    """big joined with small, which has one row for each key and the number of its rows in big as `size`.

    Keys with more than 1 / HOT of all rows, of which there are less than HOT, are broadcast; the others have few rows each
    and are shuffled. small is read several times and should be stored.
    """
    total = small.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    hot, cold = small.where(F.col(size) > total / HOT), small.where(F.col(size) <= total / HOT)
    found = big.join(F.broadcast(hot), key)  # less than HOT rows
    if not hot.limit(1).count():
        return big.join(cold, key)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return found.unionByName(rest)


_MADE: dict = {}


def once(key, make: Callable):
    """make()'s result, kept for the later tasks of this Python worker until another key is asked for."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


class Generations(dict):
    """A bounded table: when it is full it becomes the old generation, from which what is asked for again comes back."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def lacking(self, keys) -> list:
        """The keys that neither generation has; those of the old one come back."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        old, out = self.old, []
        for k in keys:
            if k not in self:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    self[k] = v
        return out


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's texts in UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def as_str(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(name).to_pylist()]


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space, each word's place among them in reading order, and where each text's
    words begin and end. A word may be empty where a text begins or ends with white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]


def gathered(it: Iterator[pa.RecordBatch], rows: int = 1024, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together, up to about so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    for b in it:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def batches(schema: T.StructType, columns: list[list]) -> pa.RecordBatch:
    """A record batch of the Spark schema from Python lists, one per column."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def with_new(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[list]]], fields: T.StructType) -> DataFrame:
    """df with more columns computed batch by batch; a column of df with the same name (in any case) is replaced.

    make() is called once in each task and returns the function from a batch to the new columns' lists.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema if f.name.lower() not in new]
    places = [i for i, f in enumerate(df.schema) if f.name.lower() not in new]
    schema = T.StructType(kept + list(fields))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for b in it:
            if b.num_rows:
                more = batches(fields, function(b))
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in places] + more.columns,
                    names=[b.schema.names[i] for i in places] + more.schema.names,
                )

    return df.mapInArrow(run, schema)
