"""Helpers that the operators share: tables, written intermediate results, Arrow passes."""

from __future__ import annotations

import ctypes
import functools
import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that are Python values at a time.
PART = 1000

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without that setting, one of our own.

    A cluster without the setting is an error: executors don't share local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_folder[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut, lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that written() made, once nothing reads them any more; other tables stay."""
    session = df.sparkSession
    for file in df.inputFiles():
        folder = session.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if re.fullmatch(r".+-[0-9a-f]{32}", folder.getName()):
            folder.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released() -> None:
    """Give what a task needed back to the system: a worker and its heap outlive the task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_BLANK = re.compile(rb"[\x09-\x0D\x20]")


def text_blocks(text: bytes, size: int = 1 << 19, anywhere: bool = True) -> Iterator[bytes]:
    """text in blocks of size to 2 * size bytes, cut before white space. Where there is none, between characters, or (not anywhere) later."""
    at = 0
    while len(text) - at > 2 * size:
        space = _BLANK.search(text, at + size, at + 2 * size if anywhere else len(text))
        end = space.start() if space else at + 2 * size if anywhere else len(text)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def map_columns(
    df: DataFrame, inputs: dict[str, F.Column], fields: list[T.StructField], function: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]]
) -> DataFrame:
    """Only the named inputs go to Python, a batch at a time as lists; function yields a dict of columns for each batch.

    Strings arrive as UTF-8 bytes. Memory is one batch as Spark cuts them, of which PART rows at a time are Python values;
    it is given back when the task ends.
    """
    schema = T.StructType(fields)
    arrow = pa.schema([pa.field(f.name, to_arrow(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists():
            for batch in batches:
                for at in range(0, batch.num_rows, PART):
                    part = batch.slice(at, PART)
                    yield {name: as_bytes(values).to_pylist() for name, values in zip(part.schema.names, part.columns)}

        try:
            for got in function(lists()):
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v := got[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow
                )
        finally:
            released()

    return df.select(*[c.alias(n) for n, c in inputs.items()]).mapInArrow(run, schema)


def as_bytes(values: pa.Array) -> pa.Array:
    """Strings as UTF-8 bytes, other values as they are."""
    if pa.types.is_string(values.type):
        return values.cast(pa.binary())
    return values.cast(pa.large_binary()) if pa.types.is_large_string(values.type) else values


def with_scores(docs: DataFrame, score: Callable[[bytes], float], names: list[str], text: str = "text") -> DataFrame:
    """docs with double columns of what score tells of the text (a number, or one for each name).

    All other columns pass through; a column of docs that has one of these names, in any case, gives way to the new one.
    """
    taken_names = {n.lower() for n in names}
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    def of(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for array in arrays:
                rows = [score(t.as_py() or b"") for t in as_bytes(array)]
                columns = zip(*rows) if rows and len(names) > 1 else [rows] if len(names) == 1 else [[] for _ in names]
                yield pa.StructArray.from_arrays([pa.array(list(c), pa.float64()) for c in columns], names=names)
        finally:
            released()

    # the annotations would be text here, and Spark reads the kind of function from them
    of.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    out = docs.withColumn(taken := f"_scores_{uuid.uuid4().hex}", F.arrow_udf(of, kind)(F.col(f"`{text}`").cast("string")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken_names]
    return out.select(*kept, *[F.col(f"`{taken}`.`{n}`").alias(n) for n in names])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int) -> DataFrame:
    """(doc_id, label, text), written once: of each label at most `most` ids of labels that docs has, and most_bytes of text.

    Ids are chosen by a hash. An id is one row: of several labels the largest counts, of several texts the one of
    least hash, so repeated rows make the sample no larger. A grade has 64 labels at most. Texts beyond a sixteenth of
    most_bytes come last, the shortest first, so they displace no others; and whatever the lengths, each label that has
    texts keeps one of them at least.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).dropna()
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = sorted(r["label"] for r in rows.select("label").distinct().limit(65).collect())
    if len(known) > 64:
        raise ValueError(f"{label} has more than 64 values")
    none = rows.filter(F.lit(False))
    chosen = functools.reduce(DataFrame.unionByName, [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in known], none)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "label", "t.text")
    # 64 * most rows at most
    size = F.octet_length("text").cast("long")
    order = Window.partitionBy("label").orderBy(F.when(size > most_bytes // 16, size).otherwise(0), F.xxhash64("doc_id"), "doc_id")
    kept = one.withColumn("so_far", F.sum(size).over(order)).withColumn("rank", F.row_number().over(order))
    return written(kept.filter((F.col("so_far") <= most_bytes) | (F.col("rank") == 1)).drop("so_far", "rank"), "sample")


def learned(rows: DataFrame, train: Callable[[pa.Table], object]) -> object:
    """What train makes of rows, a bounded sample, in one task: the driver gets the result alone, neither the rows nor train's arrays."""
    schema = pa.schema([pa.field(f.name, to_arrow(f.dataType)) for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(train(pa.Table.from_batches(batches, schema)))]}, pa.schema([("model", pa.binary())]))
        finally:
            released()

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train(schema.empty_table())  # no rows may mean no task


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, to_arrow(f.dataType)) for f in kind.fields])
    plain = {
        T.StringType(): pa.string(),
        T.BinaryType(): pa.binary(),
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.ShortType(): pa.int16(),
        T.DoubleType(): pa.float64(),
        T.FloatType(): pa.float32(),
        T.BooleanType(): pa.bool_(),
    }
    return plain[kind]


def kind_of(kind) -> T.DataType:
    """A type by its name; [kind] is an array of it, {name: kind} a struct."""
    if isinstance(kind, list):
        return T.ArrayType(kind_of(kind[0]))
    if isinstance(kind, dict):
        return T.StructType([field(n, k) for n, k in kind.items()])
    return _KINDS[kind]


def field(name: str, kind) -> T.StructField:
    return T.StructField(name, kind_of(kind))


_KINDS = {
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "boolean": T.BooleanType(),
}


class BoundedCache(dict):
    """A dict that makes missing values of strings or bytes by a function. Keys beyond `longest` are not kept, and it
    starts afresh when keys and values come to most_bytes, objects' overhead of some 200 bytes an entry included."""

    def __init__(self, make: Callable, most_bytes: int = 48 << 20, longest: int = 100):
        super().__init__()
        self.make, self.most_bytes, self.longest, self.held = make, most_bytes, longest, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self.held += 200 + len(key) + len(value)
            if self.held > self.most_bytes:
                self.clear()
                self.held = 0
            self[key] = value
        return value
