"""What the corpus operators share: reading, document keys, tokens, tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import release, release_others, settle, settled_now
from ..workers import ship

#: ASCII white space; Java and Python regular expressions read it alike.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id, which so sorts before all others.
NULL_ID = -(2**63)
#: Rows (or entries of lists) of at most some 100 bytes that a settled table may have to be broadcast; a larger one is joined by a shuffle.
MAX_SENT = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent_if_small(settled: DataFrame, weight: Column | None = None, most: int = MAX_SENT) -> DataFrame:
    """A settled table of short rows, to be broadcast if it has at most ``most`` of them; where rows hold lists,
    ``weight`` counts what is in them."""
    n = settled.count() if weight is None else settled.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(settled) if n <= most else settled


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Before Python stages. Long texts: fewer rows an Arrow batch than Spark's default, unless the session set its own
    number; Spark's own bound of bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB) ends a batch of very long ones
    before. And the package goes to the workers."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keyed(docs: DataFrame) -> DataFrame:
    """Add ``_k`` (doc_id, null as the smallest) and ``_v``.

    ``_v`` is 0 while every doc_id is there once. Else it tells rows of one doc_id with unlike texts apart; rows
    alike in both are one document and get one verdict. Only doc_id is read to find that out.
    """
    k = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))
    again = docs.select(k.alias("_k")).groupBy("_k").count().where("count > 1").limit(1).count()
    v = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()) if again else F.lit(0).cast("bigint")
    return docs.withColumns({"_k": k, "_v": v})


def once(docs: DataFrame) -> DataFrame:
    """One row of each (_k, _v) of ``docs`` (as ``keyed`` gives it): those very rows while no doc_id comes twice, else
    settled, so that a document with very many copies under its own id costs the stages that follow one row."""
    if not docs.select("_v").where("_v <> 0").limit(1).count():
        return docs
    return settle(docs.dropDuplicates(["_k", "_v"]), "documents-once")


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many _ behind it as it takes not to be one of ``taken`` (names differ by more than case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def slim(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text and ``keep``, and all other columns out of the way in the struct ``_rest``, so that no name can clash."""
    own = ["doc_id", "text", *keep]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def restored(out: DataFrame, columns: list[str], *keep: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns that ``slim`` was given, then ``extra``; of one name, the extra one."""
    own = ["doc_id", "text", *keep]
    return out.select(*[F.col(c) if c in own else F.col("_rest").getField(c).alias(c) for c in columns if c not in extra], *extra)


def passed(schema, *names: str) -> str:
    """DDL of these columns of a schema."""
    return ", ".join(f"`{n}` {schema[n].dataType.simpleString()}" for n in names)


def text_of(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all else as it is. ``lower`` does that on pure ASCII and is much cheaper than ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


__all__ = [
    "LOWER", "MAX_SENT", "NULL_ID", "SPACE", "SPACE_CHARS", "UPPER", "ascii_lower", "free_name", "keyed", "let", "once", "passed", "release", "release_others", "restored",
    "sent_if_small", "settle", "settled_now", "slim", "small_batches", "table", "text_of", "words",
]
