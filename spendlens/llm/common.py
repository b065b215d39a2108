"""Column helpers and shared-table helpers used by the corpus operators."""
from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import shared_path, write_table

#: A word is a maximal run of characters other than these (Java regex class body).
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; ``sf_dir`` may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lineage cut that
    survives lost executors, with a size the planner knows."""
    return write_table(df, shared_path(df.sparkSession, name))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order, as an array of strings."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != F.lit(""))


def spread_key(*columns: Column) -> Column:
    """A 60-bit pseudo-random key from the columns' text, the same in any
    engine with md5 (a null counts as an empty string)."""
    joined = F.concat_ws("\x01", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def content_key(df: DataFrame) -> Column:
    """A hash of a whole row.  Columns of types that cannot be hashed (maps and
    what holds them) go in as JSON."""
    def hashable(kind) -> bool:
        text = kind.simpleString()
        return not any(x in text for x in ("map<", "variant", "interval"))

    # A hash passes over nulls, so which columns are null goes in as well.
    nulls = F.concat_ws("", *[column(c).isNull().cast("string") for c in df.columns])
    return F.xxhash64(*[column(f.name) if hashable(f.dataType) else F.to_json(F.struct(column(f.name).alias("v"))) for f in df.schema.fields], nulls)


#: One above the largest ``spread_key``.
SPREAD = 1 << 60


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that the
    functions run there can import it wherever the package is not installed."""
    sc = spark.sparkContext
    if getattr(sc, "_spendlens_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spendlens-code-")) / "spendlens_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._spendlens_shipped = True
