"""What the training-data operators share: shared folder, words, row keys."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Character classes fixed by the query contracts.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Stands for a null document id where ids are compared: it comes last.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session. Only where that is unset in local
    mode (tests) a temporary folder of this machine is set instead; a cluster
    without a shared folder is an error.
    """
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gleanery-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session is gone; the folder's owner cleans up
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/gleanery-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


#: Paths of the tables that ``cut`` wrote, by the frame that reads them.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, name: str = "cut", **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Ends the lineage: a lost executor re-reads the table instead of repeating
    what made it. Unlike ``checkpoint()`` the result keeps column pruning.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of ``cut`` frames that nothing reads any more."""
    for df in frames:
        if path := _written.pop(df, None):
            _delete(df.sparkSession, path)


#: The tables cut in each open ``scratch``.
_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was cut inside, but what the given function was called with.

    For results that are cut themselves, so that nothing reads those tables any more.
    """
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(own)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _scopes.remove(own)
        drop(*[df for df in own if not any(df is k for k in kept)])
        if _scopes:
            _scopes[-1].extend(kept)


def cut_with(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``cut``, and figures over the rows that were counted while they were written."""
    seen = Observation()
    return cut(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name), dict(seen.get)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` alone would change É as well)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, separators: str = SPACE) -> Column:
    """The maximal runs of characters outside ``separators``; null: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def key_of(doc_id: Column) -> Column:
    """The id as a long that is never null; null ids are one id, the last."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))



def row_keys(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """__gl_id (never null) and __gl_row, a hash of the text: what tells rows apart that share an id."""
    return {"__gl_id": key_of(F.col(id_col)), "__gl_row": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}


#: Words of the bitmap in ``join_few``: 2**16 rows of 64 bits, whatever the input.
BITMAP_WORDS = 2**16
KEYS = ["__gl_id", "__gl_row"]


def _marked(rows: DataFrame, few: DataFrame, keys: list[str], words: int) -> DataFrame:
    """``rows`` with __gl_hit: false where the key is surely not in ``few``.

    By a bitmap of hashed keys of ``few``, of a fixed size, so it can be
    broadcast. A full bitmap only means that all rows are hits.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(words * 64))
    place = {"__gl_word": F.shiftright(bit, 6).cast("int"), "__gl_at": bit.bitwiseAND(F.lit(63)).cast("int")}
    marks = few.withColumns(place).groupBy("__gl_word").agg(F.bit_or(F.expr("shiftleft(1L, __gl_at)")).alias("__gl_mask"))
    marked = rows.withColumns(place).join(F.broadcast(marks), "__gl_word", "left")
    return marked.withColumn("__gl_hit", F.expr("coalesce(getbit(__gl_mask, __gl_at), 0) = 1")).drop("__gl_word", "__gl_at", "__gl_mask")


def maybe_in(rows: DataFrame, few: DataFrame, keys: list[str], words: int = BITMAP_WORDS) -> DataFrame:
    """The rows whose key is in ``few``, and some others; nothing is moved for it."""
    return _marked(rows, few, keys, words).where("__gl_hit").drop("__gl_hit")


def join_few(rows: DataFrame, few: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``rows`` left join ``few`` on ``keys``, moving only rows that may have a partner.

    Rows that surely have none get nulls where they are; the rest goes through
    an ordinary join. ``few`` has each key once.
    """
    marked = _marked(rows, few, keys, BITMAP_WORDS)
    more = {f.name: F.lit(None).cast(f.dataType) for f in few.schema.fields if f.name not in keys}
    clear = marked.where("not __gl_hit").drop("__gl_hit").withColumns(more)
    return clear.unionByName(marked.where("__gl_hit").drop("__gl_hit").join(few, keys, "left"))


#: A key with more than one in HOT of the rows is hot; so there are fewer than HOT of them.
HOT = 4096


def join_hot(rows: DataFrame, few: DataFrame, keys: Sequence[str], total: int, count: str = "m") -> DataFrame:
    """``rows`` inner join ``few`` on ``keys``, whatever share of the rows a key has.

    ``few`` has each key once, with the ``count`` of its rows, and should be
    cheap to read twice; ``total`` is the number of ``rows``. Hot keys are
    joined where their rows are, by a broadcast of under ``HOT`` keys; of the
    others none brings more than one in ``HOT`` of the rows to a task.
    """
    keys = list(keys)
    hot = few.where(F.col(count) * HOT > total)
    cold = few.where(F.col(count) * HOT <= total)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def set_apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that have an internal name renamed, and how they are named back."""
    back = {f"own{c}": c for c in docs.columns if c.lower().startswith("__gl_")}
    return docs.withColumnsRenamed({c: own for own, c in back.items()}), back


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows whose ``row_keys`` are in ``bad``; columns may have any names."""
    gone = bad.select(*KEYS).distinct().withColumn("__gl_gone", F.lit(1))
    own, back = set_apart(docs)
    return join_few(own.withColumns(row_keys(id_col, text_col)), gone).where(F.col("__gl_gone").isNull()).select(*own.columns).withColumnsRenamed(back)
