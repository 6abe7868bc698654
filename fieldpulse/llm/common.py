"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

# ASCII white space as the operators' contracts define it.
SPACE_RUN = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"

#: Slots of the bounded key sketch: 2^23 bits in at most 131,072 rows of (long, long), about 2 MB.
SKETCH_BITS = 1 << 23


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's code once per application, as
    ``--py-files`` would; Spark serves the archive to them."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="fieldpulse-code-")) / "fieldpulse-code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words (runs without ASCII white space) of a text, in order."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors, and is computed once.  The folder belongs
    to the cluster's checkpoint directory and is cleared with it."""
    spark = df.sparkSession
    ship_package(spark)
    path = f"{checkpoint_root(spark)}/fieldpulse-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_sketch(hashes: DataFrame, column: str) -> DataFrame:
    """Fixed-size bitmap of a column of 64-bit hashes: at most SKETCH_BITS / 64
    rows (word, mask), whatever the input, so it may be broadcast."""
    h = F.col(column)
    return hashes.select(
        F.shiftright(F.pmod(h, F.lit(SKETCH_BITS)), 6).alias("_word"),
        F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("_bit"),
    ).groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))


def flag_sketched(df: DataFrame, column: str, sketch: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: false only if the hash is certainly not in the sketch."""
    return (
        df.withColumn("_word", F.expr(f"shiftright(pmod({column}, {SKETCH_BITS}), 6)"))
        .join(F.broadcast(sketch), "_word", "left")
        .withColumn(flag, F.expr(f"_mask is not null and getbit(_mask, cast(pmod({column}, 64) as int)) = 1"))
        .drop("_word", "_mask")
    )
