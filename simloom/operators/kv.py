"""Keyed collections: point and range access, updates, ordered navigation, secondary indexes, expiry, queues.

A collection is a DataFrame with key columns. Changes give a new DataFrame; nothing is changed in place, so a snapshot is
the DataFrame before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.sources import shared, text


def get(df: DataFrame, key: str, values) -> DataFrame:
    """Rows of the given keys; a list becomes a pushed-down filter, a DataFrame with the key a semi join."""
    return df.join(values.select(key).distinct(), key, "left_semi") if isinstance(values, DataFrame) else df.filter(F.col(key).isin(list(values)))


def contains_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """keys with present."""
    there = df.select(key).distinct().withColumn("_there", F.lit(True))
    return keys.join(there, key, "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def contains_value(df: DataFrame, value: str, wanted) -> bool:
    return not df.filter(F.col(value).eqNullSafe(F.lit(wanted))).isEmpty()


def size(df: DataFrame) -> DataFrame:
    """One row: n, and whether there is none."""
    return df.agg(F.count("*").alias("n"), (F.count("*") == 0).alias("is_empty"))


def clear(df: DataFrame) -> DataFrame:
    """The collection without its entries."""
    return df.filter(F.lit(False))


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last version of each key by the order columns. Rows are combined map-side, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")) if rest else df.distinct()
    return picked.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest]).select(*df.columns)


def first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return picked.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest]).select(*df.columns)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of updates (one a key) put in: theirs win."""
    return base.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def put_if_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """base with those rows whose key it lacks."""
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti"))


def remove(base: DataFrame, gone: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """base without the keys of gone; with values given, only where these are equal too."""
    on = keys + (values or [])
    return base.join(gone.select(*on).distinct(), on, "left_anti")


def replace(base: DataFrame, rows: DataFrame, keys: list[str], value: str, new: str | None = None, expected: str | None = None) -> DataFrame:
    """base with value taken from rows (its column new) where the key exists; with expected, only where base holds that column's value."""
    found = rows.select(*keys, F.col(new or value).alias("_new"), *([F.col(expected).alias("_old")] if expected else []), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    if expected:
        hit &= F.col(value).eqNullSafe(F.col("_old"))
    return base.join(found, keys, "left").withColumn(value, F.when(hit, F.col("_new")).otherwise(F.col(value))).select(*base.columns)


def value_on_miss(df: DataFrame, value: str, make: Column) -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), make))


def range_scan(df: DataFrame, key: str, low=None, high=None, low_inclusive: bool = True, high_inclusive: bool = False) -> DataFrame:
    """Rows of a key range as filters that reach the scan; descending or ordered views are an orderBy on top."""
    if low is not None:
        df = df.filter(F.col(key) >= low if low_inclusive else F.col(key) > low)
    if high is not None:
        df = df.filter(F.col(key) <= high if high_inclusive else F.col(key) < high)
    return df


def poll(df: DataFrame, key: str, last: bool = False, n: int = 1) -> DataFrame:
    """The n rows of the smallest (or largest) keys."""
    return df.orderBy(F.desc(key) if last else F.asc(key)).limit(n)


def descending(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """All rows, each with its position from 0 on by falling key."""
    return text.number_rows(df, F.desc(key), name)


def ordered(df: DataFrame, by: list[Column], name: str = "position") -> DataFrame:
    """All rows, each with its position from 0 on by a composite order: rising, falling, over structs, arrays or bytes."""
    return text.running_total(df, [], by, F.lit(1), name)


def navigate(probes: DataFrame, probe: str, df: DataFrame, key: str) -> DataFrame:
    """probes with floor, lower, ceiling and higher: the nearest keys at most, under, at least and over each probe.

    Keys and probes are dealt together by ranges. Within a range, running extremes give the nearest keys; beyond it, the
    extremes of the other ranges, one row each, do. Every frame begins at its window's first row, from below or from above:
    Spark goes through the rest of a frame that ends at the last row anew for each row.
    """
    v, k = F.col("_v"), F.when(F.col("_key"), F.col("_v"))
    kind = df.select(key).schema[0].dataType
    both = df.select(F.col(key).alias("_v"), F.lit(True).alias("_key"), F.lit(False).alias("_asked"))
    both = both.unionByName(probes.select(F.col(probe).cast(kind).alias("_v"), F.lit(False).alias("_key"), F.lit(True).alias("_asked")))
    points = both.filter(v.isNotNull()).groupBy("_v").agg(F.bool_or("_key").alias("_key"), F.bool_or("_asked").alias("_asked"))
    ranged = shared.cut(points.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()))
    ends = ranged.groupBy("_part").agg(F.min(k).alias("_low"), F.max(k).alias("_high"))
    before = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    up, down = Window.orderBy("_part"), Window.orderBy(F.desc("_part"))
    ends = ends.select("_part", F.max("_high").over(before(up, -1)).alias("_before"), F.min("_low").over(before(down, -1)).alias("_after"))
    up, down = Window.partitionBy("_part").orderBy("_v"), Window.partitionBy("_part").orderBy(F.desc("_v"))
    near = {
        "floor": F.max(k).over(before(up, 0)), "lower": F.max(k).over(before(up, -1)), "ceiling": F.min(k).over(before(down, 0)), "higher": F.min(k).over(before(down, -1)),
    }
    found = ranged.withColumns(near).filter("_asked").join(F.broadcast(ends), "_part")
    found = found.select(v.alias(probe), *[F.coalesce(c, "_before" if c in ("floor", "lower") else "_after").alias(c) for c in near])
    return probes.join(found, probe, "left")


def multi_get(df: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """All values of each key, a row each; with most, a sorted array a key, and an error if a key has more values than that."""
    if most is None:
        return df.select(*keys, value)
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a key has {largest} values, {most} fit into an array")
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("all_values"))


def prefix_filter(df: DataFrame, **leading) -> DataFrame:
    """Rows of a composite key whose leading parts have these values."""
    for name, value in leading.items():
        df = df.filter(F.col(name) == value)
    return df


def secondary_key(df: DataFrame, primary: str, derived: Column, name: str = "secondary_key") -> DataFrame:
    """An index (derived key, primary key), a row each, from a derived key (a column, or an array of keys)."""
    pairs = df.select(derived.alias(name), F.col(primary))
    if dict(pairs.dtypes)[name].startswith("array"):
        pairs = pairs.select(F.explode(name).alias(name), primary)
    return pairs.filter(F.col(name).isNotNull()).distinct()


def secondary_values(df: DataFrame, primary: str, derived: Column, name: str = "secondary_value") -> DataFrame:
    """(primary, value) for each value of a derived array."""
    return df.select(primary, F.explode(derived).alias(name))


def inverse(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(F.col(value), F.col(key))


def histogram(df: DataFrame, category: Column, name: str = "category") -> DataFrame:
    return df.groupBy(category.alias(name)).agg(F.count("*").alias("n"))


def expire_after(df: DataFrame, time: str, seconds: int, now: Column | None = None) -> DataFrame:
    """Rows no older than so many seconds before now, or before the latest time."""
    limit = now if now is not None else F.lit(df.agg(F.max(time)).first()[0])
    return df.filter(F.unix_micros(limit.cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp")) <= seconds * 1_000_000)


def expiry_bounds(df: DataFrame, time: str, seconds: int) -> DataFrame:
    """When the first and the last row expire."""
    step = F.make_dt_interval(secs=F.lit(seconds))
    return df.agg((F.min(time) + step).alias("first_expiry"), (F.max(time) + step).alias("last_expiry"))


def expire_after_access(df: DataFrame, key: str, written: str, accesses: DataFrame, time: str, seconds: int, now: Column) -> DataFrame:
    """Rows written or read no longer ago than so many seconds; accesses are (key, time)."""
    last = accesses.groupBy(key).agg(F.max(time).alias("_read"))
    marked = df.join(last, key, "left").withColumn("_last", F.greatest(written, "_read"))
    recent = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp")) <= seconds * 1_000_000
    return marked.filter(recent).select(*df.columns)


def keep_within_size(df: DataFrame, size: Column, most: int, order: list[Column]) -> DataFrame:
    """The rows that come first in the order (newest first) while their sizes add up to at most most; what goes, goes from the oldest."""
    sized = text.running_total(df.withColumn("_size", size), [], order, F.col("_size"), "_before")
    return sized.filter(F.col("_before") + F.col("_size") <= most).select(*df.columns)


def keep_newest(df: DataFrame, most: int, *order: str) -> DataFrame:
    """The newest rows of a bounded collection; what goes is evicted()."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(most)


def evicted(df: DataFrame, most: int, key: str, *order: str) -> DataFrame:
    """The rows that keep_newest drops, to be put into a second collection."""
    return df.join(keep_newest(df, most, *order).select(key), key, "left_anti")


def sort_merge(parts: list[DataFrame], keys: list[str], *order: str) -> DataFrame:
    """The union of parts with one row a key, the first by order; sorting and spilling are Spark's."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return first(whole, keys, *order)


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The change feed between two versions: keys, change (insert, update or delete), old_value, new_value; unchanged keys have no row."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    kind = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "update")
    return both.withColumn("change", kind).filter(F.col("change").isNotNull()).select(*keys, "change", "old_value", "new_value")


def queue(df: DataFrame, order: str, n: int, kind: str = "fifo") -> DataFrame:
    """What n takes yield from a queue (fifo) or a stack (lifo), or what a ring of n places holds (circular), in order of position."""
    if kind not in ("fifo", "lifo", "circular"):
        raise ValueError(f"unknown kind {kind!r}")
    taken = df.orderBy(F.asc(order) if kind == "fifo" else F.desc(order)).limit(n)
    by = Window.orderBy(F.desc(order) if kind == "lifo" else F.asc(order))
    return taken.withColumn("position", (F.row_number().over(by) - 1).cast("long"))


def checked_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df; reading it fails at a key that occurs twice, as a bulk load of sorted data does."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).filter(F.assert_true(F.col("_n") == 1, "a key occurs twice").isNull()).drop("_n")


def bulk_load(df: DataFrame, keys: list[str], *order: str, duplicates: str = "error") -> DataFrame:
    """The rows of a bulk load: a key that occurs twice is an error, or, ignored, its first row by order counts."""
    if duplicates not in ("error", "ignore"):
        raise ValueError(f"duplicates are an error or ignored, not {duplicates!r}")
    return checked_unique(df, keys) if duplicates == "error" else first(df, keys, *order)


class Conflict(Exception):
    """Another commit came between the beginning of a transaction and its commit."""


class Catalog:
    """Named collections in the session's warehouse. A name is a view of one version's table.

    A change writes a new version beside the old one and then points the view at it, one step of the catalog; so a name is
    never without a table, and the version before stays for snapshots and rollback until the commit after.
    """

    def __init__(self, spark: SparkSession, prefix: str = "simloom_"):
        self.spark, self.prefix = spark, prefix

    def _name(self, name: str) -> str:
        return self.prefix + name

    def _point(self, name: str, version: int, tables: list[str]) -> None:
        self.spark.sql(f"CREATE OR REPLACE VIEW {self._name(name)} TBLPROPERTIES ('version' = '{version}', 'tables' = '{','.join(tables)}') AS SELECT * FROM {tables[-1]}")

    def _state(self, name: str) -> tuple[int, list[str]]:
        """(version, tables of the version before and of this one)."""
        found = {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._name(name)}").collect()}
        return int(found["version"]), found["tables"].split(",")

    def _write(self, df: DataFrame) -> str:
        table = f"{self.prefix}data_{uuid.uuid4().hex}"
        df.write.saveAsTable(table)
        return table

    def create(self, name: str, df: DataFrame) -> None:
        if self.exists(name):
            raise ValueError(f"there is a collection {name!r}")
        self._point(name, 1, [self._write(df)])

    def get(self, name: str) -> DataFrame:
        return self.spark.table(self._name(name))

    def snapshot(self, name: str) -> DataFrame:
        """This version, whatever the next commit brings."""
        return self.spark.table(self._state(name)[1][-1])

    def version(self, name: str) -> int:
        return self._state(name)[0]

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self._name(name))

    def drop(self, name: str) -> None:
        if self.exists(name):
            tables = self._state(name)[1]
            self.spark.sql(f"DROP VIEW {self._name(name)}")
            for table in tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def rename(self, old: str, new: str) -> None:
        self.spark.sql(f"ALTER VIEW {self._name(old)} RENAME TO {self._name(new)}")

    def names(self) -> list[str]:
        return sorted(t.name[len(self.prefix) :] for t in self.spark.catalog.listTables() if t.name.startswith(self.prefix) and t.tableType == "VIEW")

    def commit(self, name: str, df: DataFrame, expected: int | None = None) -> int:
        """Replace a collection by one that may be derived from it; with expected, only if that is still its version."""
        fresh = self._write(df)
        version, tables = self._state(name)
        if expected is not None and version != expected:
            self.spark.sql(f"DROP TABLE {fresh}")
            raise Conflict(f"{name} has version {version}, not {expected}")
        self._point(name, version + 1, [tables[-1], fresh])
        for table in tables[:-1]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        return version + 1

    def rollback(self, name: str) -> int:
        """Go back to the version before the last commit."""
        version, tables = self._state(name)
        if len(tables) < 2:
            raise ValueError(f"{name} has no version before {version}")
        self._point(name, version + 1, tables[:1])
        self.spark.sql(f"DROP TABLE IF EXISTS {tables[-1]}")
        return version + 1

    def compact(self, name: str, files: int = 1) -> int:
        return self.commit(name, self.get(name).coalesce(files))

    def begin(self, name: str) -> Transaction:
        return Transaction(self, name)


class Transaction:
    """Changes of one collection as it was when the transaction began; they all come at commit, or not at all."""

    def __init__(self, catalog: Catalog, name: str):
        self.catalog, self.name, self.version, self.rows = catalog, name, catalog.version(name), catalog.snapshot(name)

    def read(self) -> DataFrame:
        return self.rows

    def write(self, df: DataFrame) -> None:
        self.rows = df

    def commit(self) -> int:
        """Raises Conflict, and changes nothing, if another commit came first."""
        return self.catalog.commit(self.name, self.rows, self.version)

    def rollback(self) -> None:
        self.rows = self.catalog.snapshot(self.name)
        self.version = self.catalog.version(self.name)
