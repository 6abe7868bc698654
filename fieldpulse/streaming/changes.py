"""The polled indicators over answers that are corrected and deleted.

The pages re-run their queries, so they see an answer that was edited or
removed; a stream of new rows does not.  Here the source is a *change feed*: one
row per insert, update or delete with the answer's image before and after.  A
change becomes signed images (the one before counts -1, the one after +1), and
everything that is kept is a signed count:

* T1 (day, sector): a sum of signs;
* T2 (day) and T5 (day, enumerator): distinct submissions need to know when the
  last answer of a submission leaves a day, so the signed count of each (day,
  enumerator, submission) is kept too, and a total changes where a count becomes
  positive or stops being so;
* T4 latest answer per submission: the signed count of each answer image is kept,
  and the touched submissions are worked out anew from what is left.

Sums don't depend on the order of changes: an update may arrive before its
insert, and an answer 60 days late corrects its day.  Nothing is held in Spark's
state store; the counts are tables of a ``RunStore``, sorted by day (T4: by
submission), so a batch reads only the parts that its days can be in.  A batch
and its totals are committed together, and a retried batch counts once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import field
from ..functions.filters import in_ids
from ..functions.text import full_name
from ..params import DEFAULTS, SurveyParams
from ..session import checkpoint_root
from ..sources.tables import ANSWER_COLUMNS, ANSWER_SCHEMA
from .runs import Run, RunStore, Table, last_row, signed_sum

CHANGE_SCHEMA = T.StructType([T.StructField("before", ANSWER_SCHEMA), T.StructField("after", ANSWER_SCHEMA)])


# --------------------------------------------------------------------------- sources

def read_change_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Change rows (before, after) arriving as parquet files: an insert has no
    ``before``, a delete no ``after``."""
    r = spark.readStream.schema(CHANGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change rows that turn one snapshot of the answers into another, for
    sources without a feed.  Answer ids are unique in each; one join on the id,
    unchanged answers are left out."""
    image = F.struct(*ANSWER_COLUMNS)
    a = old.select(F.col("id").alias("_id"), image.alias("before"))
    b = new.select(F.col("id").alias("_id"), image.alias("after"))
    return a.join(b, "_id", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("before", "after")


def signed(changes: DataFrame) -> DataFrame:
    """Answer images with ``sign``: -1 for each image before, +1 for each after."""
    images = F.array(F.struct(F.col("after").alias("a"), F.lit(1).alias("sign")),
                     F.struct(F.col("before").alias("a"), F.lit(-1).alias("sign")))
    each = changes.select(F.explode(F.filter(images, lambda x: x["a"].isNotNull())).alias("x"))
    return each.select("x.a.*", F.col("x.sign").cast("bigint").alias("sign"))


def inserted(answers: DataFrame) -> DataFrame:
    """New answers as change rows, for sources that only append.  The indicators
    then hold no state either: what ``monitor`` keeps open in Spark's state store for
    every day, because an answer may be late, is here a row of a table."""
    return answers.select(F.lit(None).cast(ANSWER_SCHEMA).alias("before"), F.struct(*ANSWER_COLUMNS).alias("after"))


# --------------------------------------------------------------------------- what is kept

def _schema(*fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DataType.fromDDL(t)) for n, t in (f.split(" ") for f in fields)])


def _counts(*fields: str) -> Table:
    keys = [f.split(" ")[0] for f in fields]
    return Table(_schema(*fields, "n bigint"), keys, signed_sum(keys))


def _among(column: str, values: DataFrame) -> Column:
    """A filter that the parquet scan can use to skip row groups: the days of a batch."""
    days = [r[0] for r in values.select(column).distinct().collect()]  # the days of one micro-batch
    return F.col(column).isin(days)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


@dataclass(frozen=True)
class Indicator:
    """Tables of an indicator, how a batch of signed images becomes runs of
    them, and the result read from them."""
    tables: dict[str, Table]
    runs: object
    view: object


def sector_daily(params: SurveyParams = DEFAULTS) -> Indicator:
    """T1: answers per (day, sector) of the survey set; NULL sector is a group."""
    def runs(store: RunStore, batch: DataFrame, batch_id: int) -> dict[str, Run]:
        a = batch.where(in_ids("survey_id", params.survey_ids) & in_ids("survey_question_id", params.sector_qids)
                        & F.col("created_at").isNotNull())
        groups = a.groupBy(F.to_date("created_at").alias("day"), field(a, "value_text").alias("sector"))
        return {"totals": store.write("totals", groups.agg(F.sum("sign").alias("n")).where("n != 0"))}

    def view(store: RunStore) -> DataFrame:
        return store.read("totals").where("n > 0").select("day", "sector", F.col("n").alias("total"))

    return Indicator({"totals": _counts("day date", "sector string")}, runs, view)


def _distinct_submissions(params: SurveyParams, group: list[str], fields: list[str], view) -> Indicator:
    """Distinct submissions per group: signed counts of each (group, submission) and totals of those above 0."""
    items = [*group, "survey_user_id"]

    def runs(store: RunStore, batch: DataFrame, batch_id: int) -> dict[str, Run]:
        a = batch.where(in_ids("survey_id", params.survey_ids) & F.col("created_at").isNotNull()
                        & F.col("survey_user_id").isNotNull()).withColumn("day", F.to_date("created_at"))
        found = store.write("items", a.groupBy(*items).agg(F.sum("sign").alias("n")).where("n != 0"))
        if not found.rows:
            return {"items": found}
        new = store.rows("items", [found])
        before = store.rows("items").where(_among("day", new)).withColumnRenamed("n", "n0")
        before = before.join(F.broadcast(new.select(*items)) if found.rows <= SMALL else new.select(*items), items, "left_semi")
        before = before.groupBy(*items).agg(F.sum("n0").alias("n0"))
        both = new.join(before, items, "left").withColumn("n0", F.coalesce("n0", F.lit(0)))
        change = (F.col("n0") + F.col("n") > 0).cast("bigint") - (F.col("n0") > 0).cast("bigint")
        totals = both.groupBy(*group).agg(F.sum(change).alias("n")).where("n != 0")
        return {"items": found, "totals": store.write("totals", totals)}

    return Indicator({"items": _counts(*fields, "survey_user_id bigint"), "totals": _counts(*fields)}, runs, view)


#: Rows (of a few numbers each) up to which a batch's keys are sent to every task.
SMALL = 100_000


def submissions_daily(params: SurveyParams = DEFAULTS) -> Indicator:
    """T2: distinct submissions per day."""
    return _distinct_submissions(params, ["day"], ["day date"], lambda store: store.read("totals").where("n > 0").select(
        "day", F.col("n").alias("total_encuestas")))


def enumerators_daily(users: DataFrame, params: SurveyParams = DEFAULTS) -> Indicator:
    """T5: distinct submissions per (day, enumerator), names as the users table has them when read."""
    def view(store: RunStore) -> DataFrame:
        u = users.select(F.col("id").alias("user_id"), full_name("first_name", "last_name").alias("nombre_completo"))
        n = store.read("totals").where("n > 0")
        return n.join(u, "user_id").select("day", "user_id", "nombre_completo", F.col("n").alias("total_encuestas"))

    return _distinct_submissions(params, ["day", "user_id"], ["day date", "user_id bigint"], view)


def latest_answer() -> Indicator:
    """T4: latest answer per submission (created_at DESC with NULL first, then id
    DESC) of the answers that are left; a submission without any has no row."""
    image = ["survey_user_id", "id", "survey_question_id", "data", "created_at"]
    fields = ["survey_user_id bigint", "id bigint", "survey_question_id bigint", "data string", "created_at timestamp_ntz"]
    latest = Table(_schema(*fields, "live boolean", "_batch bigint"), ["survey_user_id"], last_row(["survey_user_id"]))

    def runs(store: RunStore, batch: DataFrame, batch_id: int) -> dict[str, Run]:
        found = store.write("items", batch.groupBy(*image).agg(F.sum("sign").alias("n")).where("n != 0"))
        if not found.rows:
            return {"items": found}
        new = store.rows("items", [found])
        touched = new.select("survey_user_id").distinct()
        low, high = touched.agg(F.min("survey_user_id"), F.max("survey_user_id")).first()
        before = store.rows("items").where(F.col("survey_user_id").isNull() | F.col("survey_user_id").between(low, high))
        before = before.join(touched, _same(before, touched, ["survey_user_id"]), "left_semi")
        left = before.unionByName(new).groupBy(*image).agg(F.sum("n").alias("n"))
        order = F.struct(F.col("n") > 0, F.col("created_at").isNull(), "created_at", "id")
        last = left.groupBy("survey_user_id").agg(F.max_by(F.struct(*image[1:], "n"), order).alias("r"))
        rows = last.select("survey_user_id", *[F.col(f"r.{c}") for c in image[1:]], (F.col("r.n") > 0).alias("live"),
                           F.lit(batch_id).alias("_batch"))
        return {"items": found, "latest": store.write("latest", rows)}

    def view(store: RunStore) -> DataFrame:
        return store.read("latest").where("live").select(*image)

    return Indicator({"items": _counts(*fields), "latest": latest}, runs, view)


# --------------------------------------------------------------------------- running

@dataclass
class ChangedTable:
    """An indicator over a change feed: ``query`` (stop it with ``query.stop()``) and ``view()``."""
    query: StreamingQuery
    store: RunStore
    indicator: Indicator

    def view(self) -> DataFrame:
        return self.indicator.view(self.store)


def start_changes(changes: DataFrame, indicator: Indicator, name: str, *, every: str = "10 seconds",
                  root: str | None = None, trigger: dict | None = None) -> ChangedTable:
    """Keep ``indicator`` current over a stream of change rows.  ``name`` under
    ``root`` (the shared checkpoint folder when not given) is resumed if it is there."""
    spark = changes.sparkSession
    base = f"{root or checkpoint_root(spark)}/changes/{name}"
    store = RunStore(spark, f"{base}/store", indicator.tables)

    def write(batch: DataFrame, batch_id: int):
        own = RunStore(batch.sparkSession, f"{base}/store", indicator.tables)
        if not own.has(batch_id):
            own.commit(batch_id, indicator.runs(own, batch, batch_id))

    q = (signed(changes).writeStream.foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(**(trigger or {"processingTime": every}))
         .queryName(f"{name}_{uuid.uuid4().hex[:8]}").start())
    return ChangedTable(q, store, indicator)


def run_changes(changes: DataFrame, indicator: Indicator, name: str, *, root: str | None = None) -> DataFrame:
    """Process the changes that have arrived since the last run of ``name`` and return the current result."""
    live = start_changes(changes, indicator, name, root=root, trigger={"availableNow": True})
    live.query.awaitTermination()
    return live.view()
