"""A dictionary that grows with a stream of documents: entities keep their numbers, batch after batch.

The dictionary is a folder of Parquet tables, one for each batch, which has the surfaces that the batch was first to bring. A batch that is run again
reads what the batches before it have written and replaces its own table, so each counts once, also after a restart.

A surface that is new is compared with leaders only (the first surfaces of entities) and with what is new itself. In first-seen order a leader that is
settled stays one, and all that the known leaders take come before all that new ones could; so many batches give the same entities and numbers as
one, if documents come in the order of their ids. Only the names of persons differ from operators.grouping: they are grouped by
similarity, but not as short forms of longer names, whose order looks at all names and would renumber those that have been given out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.frames import numbered, numbered_within
from ..functions.text import normalized_name, normalized_number, valid_name
from ..operators import detect as D
from ..operators.grouping import ALONE, THRESHOLDS, compared, kept, leaders, similar_pairs, written

ENTRY = "category string, surface string, norm string, entity_no long, variant_no long, leads boolean"


def entries(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if not there:
        return spark.createDataFrame([], ENTRY)
    rows = spark.read.schema(f"{ENTRY}, batch long").option("basePath", folder).parquet(folder)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary so far in long form, as operators.grouping.dictionary() has it."""
    id_ = F.format_string("<%s_%d>", F.upper("category"), "entity_no")
    return entries(spark, folder).select("category", F.col("entity_no").cast("int").alias("entity_no"), id_.alias("id"), F.col("variant_no").cast("int").alias("variant_no"), F.col("surface").alias("variant"), F.lit(None).cast("string").alias("pattern"))


def _alone(known: DataFrame, new: DataFrame) -> DataFrame:
    """The categories in which each surface is an entity: new rows numbered behind those that are known."""
    top = known.groupBy(F.col("category").alias("_c")).agg(F.max("entity_no").alias("_top"))
    rows = numbered_within(new, "category", [F.col("ord")], "_k").join(top, F.col("category") == F.col("_c"), "left")
    return rows.select("category", "surface", F.col("surface").alias("norm"), (F.col("_k") + F.coalesce("_top", F.lit(0))).alias("entity_no"), F.lit(1).cast("long").alias("variant_no"), F.lit(True).alias("leads"))


def _grouped(known: DataFrame, new: DataFrame, category: str) -> DataFrame:
    """A category whose spellings are grouped: new rows that go to a known leader, to each other, or are leaders themselves."""
    own = new.where(valid_name(F.col("surface"))) if category == "person" else new
    own = kept(own.select("surface", "ord", (normalized_name if category == "person" else normalized_number)(F.col("surface")).alias("norm")))
    top = known.agg(F.max("entity_no")).first()[0] or 0
    spelled = kept(known.groupBy("norm").agg(F.min("entity_no").alias("entity_no")))  # one entity each
    firsts = kept(own.groupBy("norm").agg((F.min("ord") + top).alias("id")).join(spelled, "norm", "left_anti"))
    # known leaders come first and aren't alike, so each stays a leader
    items, n = written(known.where("leads").select(F.col("entity_no").alias("id"), "norm").unionByName(firsts.select("id", "norm")), F.lit(True))
    if n <= ALONE:
        led = items.groupBy().applyInArrow(compared(THRESHOLDS[category]), "id long, leader long")
    else:
        led = leaders(items, similar_pairs(items, THRESHOLDS[category]).where(F.col("b") > top))
    led = kept(led.where(F.col("id") > top))
    order = numbered(led.where("id = leader").select(F.col("id").alias("_leader")), [F.col("_leader")], "_no").select("_leader", (F.col("_no") + 1 + top).alias("_new"))
    led = led.join(order, F.col("leader") == F.col("_leader"), "left")
    led = led.select("id", F.coalesce("_new", "leader").alias("entity_no"), (F.col("id") == F.col("leader")).alias("_first"))
    found = firsts.join(led, "id").select("norm", "entity_no", "_first", "id")
    found = kept(found.unionByName(spelled.select("norm", "entity_no", F.lit(False).alias("_first"), F.lit(None).cast("long").alias("id"))))
    rows = own.join(found, "norm").select("surface", "norm", "ord", "entity_no", (F.col("_first") & (F.col("ord") + top == F.col("id"))).alias("leads"))
    so_far = known.groupBy(F.col("entity_no").alias("_e")).agg(F.max("variant_no").alias("_so_far"))
    rows = numbered_within(rows, "entity_no", [F.col("ord")], "_k").join(so_far, F.col("entity_no") == F.col("_e"), "left")
    return rows.select(F.lit(category).alias("category"), "surface", "norm", "entity_no", (F.col("_k") + F.coalesce("_so_far", F.lit(0))).alias("variant_no"), F.coalesce("leads", F.lit(False)).alias("leads"))


def extend(folder: str, mentioned: DataFrame, batch: int) -> None:
    """Adds the mentions of a batch (category, surface, ord) to the dictionary in a folder. Batches are numbered as they come; one without
    anything new writes an empty table."""
    spark = mentioned.sparkSession
    known = entries(spark, folder, batch)
    new = kept(mentioned.join(known.select("category", "surface"), ["category", "surface"], "left_anti").select("category", "surface", F.col("ord").cast("long").alias("ord")))
    there = {r.category for r in new.select("category").distinct().collect()}  # eight at most
    single = [c for c in D.CATEGORIES if c not in THRESHOLDS]
    out = _alone(known.where(F.col("category").isin(single)), new.where(F.col("category").isin(single)))
    for c in (c for c in D.CATEGORIES if c in THRESHOLDS and c in there):
        out = out.unionByName(_grouped(known.where(F.col("category") == c), new.where(F.col("category") == c), c))
    out.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def extend_stream(docs: DataFrame, folder: str, checkpoint: str, registry: D.Registry | None = None, language: str = "en", **trigger) -> StreamingQuery:
    """A query that adds what is detected in documents (doc_id, text) of a stream to the dictionary in a folder."""
    each = lambda batch, no: extend(folder, kept(D.mentions(D.detect(batch, registry, language))), no)
    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
