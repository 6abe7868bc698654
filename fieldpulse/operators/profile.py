"""Kept path profile: which JSON leaf paths, of which kinds, each day's answers have.

``export_*`` needs the leaf paths before it can name its columns; finding them
reads every JSON text.  The profile is worked out once per day as answers arrive
and merged over any days, so an export is planned from a table of (day, path)
rows and the answers are read once, for the export itself.  Layouts of any
width are written in groups of columns that share the key columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import where_range
from ..sources.sinks import scratch_table, write_export
from ..sources.tables import ANSWER_COLUMNS
from .flatten import LEVELS, flatten_json, row_paths

SCHEMA = "path ARRAY<STRING>, kind STRING, answers BIGINT, day DATE"
#: Path columns of one group of a wide export.
GROUP = 1000


def path_profile(answers: DataFrame, col: str = "data", levels: int = LEVELS) -> DataFrame:
    """(path, kind, answers, day): leaf paths per day, the kinds of their values
    (STRING, BIGINT, ARRAY, VOID, ...) and how many answers have them.  Undated
    answers have a null day.  Objects below ``levels`` go on as rows of their own
    until none is left, so one deep answer costs another walk of that answer."""
    rows = answers.select(F.to_date("created_at").alias("day"), F.array().cast("array<string>").alias("prefix"),
                          F.col(col).alias("text"))
    found = None
    while True:
        each = rows.select("day", F.explode(row_paths(F.try_parse_json("text"), F.col("prefix"), levels)).alias("p"))
        each = scratch_table(each.groupBy("day", "p").agg(F.count(F.lit(1)).alias("answers")).select("day", "p.*", "answers"), "paths")
        here = each.where("rest is null").groupBy("path", "kind", "day").agg(F.sum("answers").alias("answers"))
        found = here if found is None else found.unionByName(here)
        deeper = each.where("rest is not null")
        if deeper.isEmpty():
            return found.groupBy("path", "kind", "day").agg(F.sum("answers").alias("answers")).select("path", "kind", "answers", "day")
        rows = deeper.select("day", F.col("path").alias("prefix"), F.col("rest").alias("text"))


def update_path_profile(answers: DataFrame, path: str, days: Iterable | None = None) -> None:
    """Replace the profile of ``days`` (all days of ``answers`` when not given)."""
    if days is not None:
        wanted = sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)) for d in days})
        if not wanted:
            return
        answers = where_range(answers, wanted[0], wanted[-1]).where(F.to_date("created_at").isin(wanted))
    profile = path_profile(answers)
    if days is not None:  # only written folders are replaced, so a day without answers writes an empty row
        given = answers.sparkSession.createDataFrame([(d,) for d in wanted], "day date")
        profile = profile.unionByName(given, allowMissingColumns=True)
    (profile.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read_path_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where("path is not null")


def known_paths(profile: DataFrame, start=None, end=None) -> list[tuple[str, ...]]:
    """Sorted leaf paths of the days in [start, end] (all days when not given):
    the names of an export's columns, which the driver needs whatever their number."""
    days = profile
    if start is not None:
        days = days.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.where(F.col("day") <= F.lit(end).cast("date"))
    return sorted(tuple(r.path) for r in days.select("path").distinct().collect())


def export_groups(df: DataFrame, paths, size: int = GROUP, keep: list[str] | None = None) -> Iterator[DataFrame]:
    """The export in groups of ``size`` path columns, each with the columns
    ``keep`` (the answers' own, when not given).  Columns are named over all
    paths, so the groups can be joined on the answer's id."""
    paths = sorted(set(map(tuple, paths)))
    for at in range(0, max(len(paths), 1), size):
        yield flatten_json(df, paths[at:at + size], keep=keep, layout=paths)


def write_wide_export(df: DataFrame, paths, folder: str, fmt: str = "parquet", size: int = GROUP) -> int:
    """Write the groups to ``folder/group=N``: the first with the answers' own
    columns, the others with the id only.  Returns the number of groups."""
    n = 0
    for n, group in enumerate(export_groups(df, paths, size), 1):
        own = [c for c in ANSWER_COLUMNS if c not in ("id", "data")]
        write_export(group if n == 1 else group.drop(*own), f"{folder}/group={n}", fmt)
    return n
