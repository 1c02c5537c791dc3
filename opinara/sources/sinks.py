"""Table sinks with the engine's key rules, over Parquet folders in shared storage.

Rows are only ever added, in folders of ``versions``: a write becomes visible as a whole, and one that
fails or is repeated after a failure leaves nothing behind.  Items are kept out by a table of their keys;
replaced rows are left out on reading, until ``compact`` writes the current rows anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from opinara.session import scratch_path
from opinara.sources.versions import Versions, append, write


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when the folder holds at least one committed data file or partition."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of a table that is only appended to."""
    return Versions(spark, path).read("rows", schema).drop("_version")


# --- keys ------------------------------------------------------------------------------
def item_key(external_id: str = "external_id", url: str = "url"):
    """``external_id or url``; the empty string counts as missing."""
    return F.coalesce(F.nullif(F.col(external_id), F.lit("")), F.nullif(F.col(url), F.lit("")))


def first_wins(df: DataFrame, key, order: str = "ingest_seq") -> DataFrame:
    """One row per key, the earliest by ``order``.

    ``row_number() = 1`` is planned with a per-partition group limit ahead of the shuffle, so
    a key that holds a large share of the rows sends one row per input partition.
    """
    key = F.col(key) if isinstance(key, str) else key
    w = Window.partitionBy("_key").orderBy(order)
    return (df.withColumn("_key", key).filter("_key is not null")
            .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_key"))


def keyless(df: DataFrame) -> DataFrame:
    """Rows with neither id nor url; kept out of the corpus and handed back to the caller."""
    return df.filter(item_key().isNull())


def new_items(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``batch`` the corpus does not have yet, first-wins within the batch."""
    keyed = first_wins(batch, item_key()).withColumn("external_id", item_key())
    return keyed.join(existing.select("external_id"), "external_id", "left_anti")


# --- the item table and its keys -------------------------------------------------------------
#: Hash buckets of the key table, and bitmaps of 32,768 bits; all bitmaps together have 4 MB.
KEY_BUCKETS = 1024
BITMAPS = 1024
#: Key sets up to this many rows are broadcast.
BROADCAST_KEYS = 1_000_000
_KEYS = "external_id string, key_bucket int"
_BITS = "bitmap bigint, bits binary"
_FIRSTS = "external_id string, ingest_seq bigint, rows bigint"


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _bit(key: Column) -> Column:
    """A key's place among all bits, counted from 1 as the bitmap functions do."""
    return F.pmod(F.xxhash64(key), F.lit(BITMAPS * 32768)) + 1


def _key_bucket(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(KEY_BUCKETS)).cast("int")


def _bits_of(keys: DataFrame) -> DataFrame:
    bit = _bit(F.col("external_id"))
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("bitmap")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def _known(spark: SparkSession, table: Versions, keys: DataFrame) -> DataFrame:
    """Those of ``keys`` (a saved table of distinct ``external_id``) that the key table has.

    A key whose bit is not set is new.  The others are looked up in their hash buckets, by which the key
    files are sorted: a batch that touches few buckets reads few row groups.
    """
    bits = table.read("bits", _schema(_BITS)).groupBy("bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
    bit = _bit(F.col("external_id"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = (keys.withColumn("bitmap", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "bitmap")
             .where(F.getbit(byte, (place % 8).cast("int")) == 1).select("external_id", _key_bucket(F.col("external_id")).alias("key_bucket")))
    path = scratch_path(spark, "maybe-known")
    maybe.write.parquet(path)
    maybe = spark.read.schema(_KEYS).parquet(path)
    size, touched = maybe.agg(F.count("*"), F.collect_set("key_bucket")).first()  # at most KEY_BUCKETS numbers
    stored = table.read("keys", _schema(_KEYS)).where(F.col("key_bucket").isin(touched))
    # a small batch is sent to the stored keys, which are not shuffled then
    found = stored.join(F.broadcast(maybe) if size <= BROADCAST_KEYS else maybe, ["external_id", "key_bucket"], "left_semi")
    return found.select("external_id")


def known_keys(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``external_id`` of ``keys`` that the item table has; it is not read, its key table is."""
    saved = scratch_path(spark, "asked-keys")
    keys.select("external_id").where("external_id is not null").distinct().write.parquet(saved)
    return _known(spark, Versions(spark, path), spark.read.schema("external_id string").parquet(saved))


def append_items(spark: SparkSession, path: str, batch: DataFrame, schema: StructType) -> int:
    """Insert-or-ignore by a single writer; returns how many rows were new.

    First-wins and the look-up run on (key, seq) alone; the rows of new keys are fetched from the batch
    afterwards.  Rows, keys and key bits appear together.  The rebalance hint lets the adaptive
    planner split a large subject over several files and merge small ones.
    """
    table = Versions(spark, path)
    n, folders = table.current()
    keyed = batch.withColumn("external_id", item_key()).where("external_id is not null")
    firsts = (keyed.groupBy("external_id", "ingest_seq").agg(F.count("*").alias("rows"))
              .groupBy("external_id").agg(F.min(F.struct("ingest_seq", "rows")).alias("first")).select("external_id", "first.*"))
    if n:
        saved = scratch_path(spark, "first-keys")
        firsts.write.parquet(saved)
        firsts = spark.read.schema(_FIRSTS).parquet(saved)
        firsts = firsts.join(_known(spark, table, firsts.select("external_id")), "external_id", "left_anti")
    staged = scratch_path(spark, "fresh-keys")
    firsts.write.parquet(staged)
    fresh = spark.read.schema(_FIRSTS).parquet(staged)
    count, repeated = fresh.agg(F.count("*"), F.count_if(F.col("rows") > 1)).first()
    if not count:
        return 0
    keys, bits, rows = (table.new_folder(kind, n) for kind in ("keys", "bits", "rows"))
    once = F.broadcast(fresh) if count <= BROADCAST_KEYS else fresh
    fetched = keyed.join(once.select("external_id", "ingest_seq", "rows"),
                         (keyed["external_id"] == once["external_id"]) & keyed["ingest_seq"].eqNullSafe(once["ingest_seq"]))
    fetched = fetched.select(*(keyed[c] for c in schema.fieldNames()), once["rows"])
    single = fetched.where("rows = 1").drop("rows")
    if repeated:  # equal rows with one number: any of them
        single = single.unionByName(fetched.where("rows > 1").drop("rows").dropDuplicates(["external_id"]))
    write(single, table.path(rows), "subject")
    bucketed = fresh.select("external_id", _key_bucket(F.col("external_id")).alias("key_bucket"))
    write(bucketed.hint("rebalance", "key_bucket").sortWithinPartitions("key_bucket"), table.path(keys))
    write(_bits_of(fresh).coalesce(1), table.path(bits))
    table.switch(n, [*folders, rows, keys, bits])
    return count


# --- insert-or-replace --------------------------------------------------------------------
def latest_write(df: DataFrame, keys: list[str], write_seq: str = "write_seq") -> DataFrame:
    """One row per key, the one written last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(write_seq))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], schema: StructType,
           partition_by: str | None = None, write_seq: str | None = None) -> None:
    """Insert-or-replace on ``keys``: the batch is added, older rows of its keys no longer count.

    Costs what the batch costs, whatever the table holds; a repeated batch changes nothing.
    """
    batch = latest_write(batch, keys, write_seq) if write_seq else batch
    append(spark, path, batch.select(*schema.fieldNames()), partition_by)


def read_latest(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The newest row of each key; a table of one folder has no others."""
    table = Versions(spark, path)
    folders = table.folders("rows")
    rows = table.read("rows", schema, folders)
    return (rows if len(folders) < 2 else latest_write(rows, keys, "_version")).drop("_version")


def compact(spark: SparkSession, path: str, schema: StructType, keys: list[str], partition_by: str | None = None) -> None:
    """Write the current rows as one folder and switch to it; readers of older folders go on undisturbed."""
    table = Versions(spark, path)
    n, folders = table.current()
    if len(folders) < 2:
        return
    folder = table.new_folder("rows", n)
    write(read_latest(spark, path, schema, keys), table.path(folder), partition_by)
    table.switch(n, [folder])


def seed_if_absent(spark: SparkSession, path: str, snapshot: DataFrame) -> bool:
    """Write the snapshot unless the target already holds data; True when it was applied."""
    if table_exists(spark, path):
        return False
    snapshot.write.mode("ignore").parquet(path)
    return True


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
