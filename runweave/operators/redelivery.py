"""Messages delivered more than once: exactly one row of each stays.

``MessageTable`` keeps one winner per message in a partitioned store. A merge looks the incoming identifiers up in an index
of (source, key, partition), reads only the historical partitions it names, recomputes the winners of these together
with the incoming rows and atomically overwrites only these partitions. Partitions that merely receive new messages get
another folder. All joins hash on (source, key, sequence), so that one identifier holding a third of all rows spreads
over all tasks; the winner of a key is found by a partial aggregate.

Defined results: an identifier is the row's letters and digits, lower case; null, blank or purely punctuated ones identify
nothing and every such row stays. A null source is a source of its own only for rows without identifier; a row without
source is never merged. Rows are ordered by sequence, then by 60 bits of a hash of the whole row; rows equal in both
are repeats of which one stays. Empty inputs give empty tables. Columns called like the operator's own (_key, _rank and so on) are renamed inside and come
out under their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runweave.session import state_path
from runweave.sources.store import PART, PartitionStore, dir_column, folder_of

KEY, RANK, KEPT = "_key", "_rank", "_kept"
LAST = 2**63 - 1  # rows without a sequence number come after all others
BUCKETS = 16
TIES = 2**60


OWN = (KEY, RANK, KEPT, PART, "_best", "_won", "_dir", "_least", "_bucket", "_fresh")
SHIELD = "_given"


def shielded(name: str) -> str:
    """The name a column has inside: another one if it is the operator's own, or looks like such another one."""
    return f"{SHIELD}{name}" if name.lower() in OWN or name.lower().startswith(SHIELD) else name


def shield(df: DataFrame) -> DataFrame:
    return df.toDF(*map(shielded, df.columns))


def unshield(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.removeprefix(SHIELD) for c in df.columns))


def message_key(column: str | F.Column) -> F.Column:
    """Letters and digits of an identifier in lower case; null if there are none."""
    bare = F.regexp_replace(F.lower(F.col(column) if isinstance(column, str) else column), r"[^\p{L}\p{N}]", "")
    return F.when(bare != "", bare)


def month_part(created: str = "created_at") -> F.Column:
    """Partition by calendar month of a timestamp; rows without one share a partition."""
    return F.coalesce(F.date_format(F.col(created), "yyyyMM"), F.lit("none"))


def _row_hash(df: DataFrame, seq: str) -> F.Column:
    """A hash of the whole row, maps as sorted entries."""
    plain = []
    for name, kind in df.dtypes:
        if name != seq:
            plain.append(F.to_json(F.struct(F.col(f"`{name}`"))) if "map<" in kind else F.col(f"`{name}`"))
    return F.xxhash64(*plain) if plain else F.lit(0)


def with_keys(df: DataFrame, id_col: str, source_col: str, seq: str) -> DataFrame:
    """Adds the message key and the rank by which the winner is the least: the sequence number, then 60 bits of the row's hash.

    Both are packed into one decimal, since the minimum of a number is a hash aggregate and that of a struct a sort.
    """
    keyed = F.when(F.col(source_col).isNotNull(), message_key(id_col))
    order = F.coalesce(F.col(seq).cast("bigint"), F.lit(LAST)).cast("decimal(20,0)")
    tie = _row_hash(df, seq).bitwiseAND(F.lit(TIES - 1)).cast("decimal(19,0)")
    return df.withColumns({KEY: keyed, RANK: (order * F.lit(TIES).cast("decimal(19,0)") + tie).cast("decimal(38,0)")})


def flag_winners(rows: DataFrame, source_col: str) -> DataFrame:
    """rows with _kept: true for the least-ranked row of each message and for rows without a key."""
    best = rows.where(F.col(KEY).isNotNull()).groupBy(source_col, KEY).agg(F.min(RANK).alias(RANK)).withColumn("_best", F.lit(True))
    same = [source_col, KEY, RANK]
    # rows equal in rank are repeats of one row: the window runs on the join's own partitioning
    copy = F.row_number().over(W.partitionBy(*same).orderBy(RANK))
    won = F.col(KEY).isNull() | (F.col("_best").isNotNull() & (copy == 1))
    return rows.join(best, same, "left").withColumn(KEPT, won).select(*(F.col(f"`{c}`") for c in rows.columns), KEPT)


class MessageTable:
    """One winner per message, in partitions of a store, with an identifier index beside it.

    The index is a store of its own, cut into ``buckets`` by a hash of (source, key): a batch reads the buckets its messages fall into. A table of very
    many messages that takes small batches wants more buckets than a batch has messages.
    """

    def __init__(self, spark: SparkSession, root: str, *, id_col: str = "id", source_col: str = "repo_id", seq: str = "ingest_seq", part: F.Column | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.id_col, self.source_col, self.seq = shielded(id_col), shielded(source_col), shielded(seq)
        self.part = F.coalesce(month_part() if part is None else part.cast("string"), F.lit(""))
        self.rows = PartitionStore(spark, f"{self.root}/rows")
        self.index = PartitionStore(spark, f"{self.root}/index")
        self.surplus: list[str] = []
        for part in self.index.manifest()["parts"]:  # the number of buckets stays what the first merge used
            self.buckets = int(part.split("/")[1])

    def _bucket(self) -> F.Column:
        """Bucket of (source, key) and the number of buckets, as an index partition."""
        return F.concat(F.pmod(F.xxhash64("source", "key"), F.lit(self.buckets)).cast("string"), F.lit(f"/{self.buckets}"))

    def _entries(self, rows: DataFrame) -> DataFrame:
        keyed = rows.where(F.col(KEY).isNotNull())
        return keyed.select(F.col(self.source_col).alias("source"), F.col(KEY).alias("key"), PART).withColumn("_bucket", self._bucket())

    def _write_index(self, entries: DataFrame, path: str) -> None:
        entries.hint("rebalance", "_bucket").select("source", "key", PART, dir_column("_bucket").alias("_dir")).write.partitionBy("_dir").parquet(path)

    def affected(self, incoming: DataFrame) -> list[str]:
        """Historical partitions that hold, or once held, a message of the incoming rows (at most one value a partition).

        Index entries are only ever added, so an entry may be out of date; that names a partition too many, never one too few.
        """
        known = self.index.manifest()["parts"]
        if not known:
            return []
        wanted, hit = self._entries(incoming), set(known)
        if incoming.count() < 8 * self.buckets:  # a larger batch falls into every bucket
            hit &= {r[0] for r in wanted.select("_bucket").distinct().collect()}  # at most ``buckets`` values
        index = self.index.read(sorted(hit))
        if index is None:
            return []
        # distinct: an identifier with a third of the batch shrinks to a row a task before the join's shuffle
        hits = index.join(wanted.select("source", "key").distinct(), ["source", "key"], "left_semi").select(PART).distinct()
        return sorted(r[0] for r in hits.collect())

    def merge(self, incoming: DataFrame) -> int:
        """Take a batch in; returns the new version. Rows that lost are kept beside the table, see ``surplus_rows``."""
        base, index_base = self.rows.version(), self.index.version()
        fresh = with_keys(shield(incoming), self.id_col, self.source_col, self.seq).withColumn(PART, self.part)
        touched = self.affected(fresh)
        old = self.rows.read(touched, base) if touched else None
        rows = fresh.withColumn("_fresh", F.lit(True))
        if old is not None:
            rows = old.withColumn("_fresh", F.lit(False)).unionByName(rows, allowMissingColumns=True)
        flagged = flag_winners(rows, self.source_col)
        out = self.rows.fresh("merge")
        state = F.when(~F.col(KEPT), "lost").when(F.col("_fresh"), "new").otherwise("old")
        # one shuffle by partition; AQE cuts a hot month into several files and joins small ones
        flagged.hint("rebalance", PART).withColumns({"_won": state, "_dir": dir_column(PART)}).drop(KEPT, "_fresh").write.partitionBy("_won", "_dir").parquet(out)
        schema = flagged.drop(KEPT, "_fresh").schema
        won, kept = self.rows.folders_below(f"{out}/_won=new"), self.rows.folders_below(f"{out}/_won=old")
        if won:
            slots = self.index.fresh("index")
            entries = self._entries(self.spark.read.schema(schema).parquet(f"{out}/_won=new"))
            self._write_index(entries, slots)
            # the index goes first: an entry without rows does no harm, rows without an entry would
            self.index.commit(slots, entries.drop("_bucket").schema, self.index.folders_below(slots), set(), index_base)
        self.surplus.append(f"{out}/_won=lost")
        return self.rows.commit(f"{out}/_won=new", schema, won, set(touched), base, more=[(f"{out}/_won=old", kept)])

    def compact(self, most: int = 8) -> int:
        """Rewrite partitions made of more than ``most`` folders, and the index if it has that many; returns the rows' version.

        The index then names for each message the partition of its winner and no other.
        """
        base = self.rows.version()
        manifest = self.rows.manifest(base)
        worn = [p for p, folders in manifest["parts"].items() if len(folders) > most]
        if worn:
            rows = self.rows.read(worn, base)
            out = self.rows.fresh("compact")
            rows.hint("rebalance", PART).withColumn("_dir", dir_column(PART)).write.partitionBy("_dir").parquet(out)
            base = self.rows.commit(out, rows.schema, self.rows.folders_below(out), set(worn), base)
        index_base = self.index.version()
        if any(len(folders) > most for folders in self.index.manifest(index_base)["parts"].values()):
            entries = self._entries(self.rows.read())
            out = self.index.fresh("compact")
            self._write_index(entries, out)
            self.index.commit(out, entries.drop("_bucket").schema, self.index.folders_below(out), set(self.index.manifest(index_base)["parts"]), index_base)
        return base

    def winners(self) -> DataFrame | None:
        """The current rows, one per message, in the input's columns."""
        rows = self.rows.read()
        return None if rows is None else unshield(rows.drop(KEY, RANK, PART))

    def surplus_rows(self, columns: Sequence[str]) -> DataFrame | None:
        """The rows that lost in any merge made through this object."""
        there = [f"{p}/{folder_of(part)}" for p in self.surplus for part in self.rows.folders_below(p)]
        if not there:
            return None
        schema = self.rows.read().schema
        return self.spark.read.schema(schema).parquet(*there).select(*(F.col(f"`{shielded(c)}`").alias(c) for c in columns))


def in_epochs(df: DataFrame, batch: str, shares: Iterable[float]) -> list[DataFrame]:
    """Cut deliveries at shares of the range of batch numbers, in order; rows without a batch come first."""
    low, high = df.agg(F.min(batch), F.max(batch)).first()
    if low is None:
        return [df]
    cuts = [low + (high - low) * s for s in shares]
    number = F.coalesce(F.col(batch), F.lit(low))
    bounds = [None, *cuts, None]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        keep = F.lit(True)
        keep = keep if a is None else keep & (number > a)
        keep = keep if b is None else keep & (number <= b)
        out.append(df.where(keep))
    return out


def replay(df: DataFrame, *, batch: str = "batch_id", shares: Sequence[float] = (0.7, 0.85), **names: str) -> MessageTable:
    """Load the older deliveries, then merge the later ones epoch by epoch, as they would arrive."""
    spark = df.sparkSession
    table = MessageTable(spark, state_path(spark, "messages"), **names)
    for epoch in in_epochs(df, batch, shares):
        table.merge(epoch)
    return table


def once(df: DataFrame, *, id_col: str = "id", source_col: str = "repo_id", seq: str = "ingest_seq", unique_seq: bool = False) -> DataFrame:
    """The rows that count, as a plain lazy plan for queries that read runs; same rule as the table's.

    ``unique_seq`` says that the sequence number alone ranks the rows of a message: the scan for the winners then reads three columns. Should
    a message hold its least number twice nevertheless, the copies are repeats and any one of them stays.
    """
    id_in, source, order = shielded(id_col), shielded(source_col), shielded(seq)
    rows = shield(df)
    if not unique_seq:
        return unshield(flag_winners(with_keys(rows, id_in, source, order), source).where(KEPT).drop(KEY, RANK, KEPT))
    keyed = rows.withColumns({KEY: F.when(F.col(source).isNotNull(), message_key(id_in)), "_least": F.coalesce(F.col(order).cast("bigint"), F.lit(LAST))})
    best = keyed.where(F.col(KEY).isNotNull()).groupBy(source, KEY).agg(F.min("_least").alias("_least")).withColumn("_best", F.lit(True))
    same = [source, KEY, "_least"]
    met = keyed.join(best, same, "left").where(F.col(KEY).isNull() | F.col("_best").isNotNull())
    # repeats of the least number: the window runs on the join's own partitioning and order
    copy = F.row_number().over(W.partitionBy(*same).orderBy("_least"))
    kept = met.withColumn(KEPT, F.col(KEY).isNull() | (copy == 1)).where(KEPT)
    return unshield(kept.select(*(F.col(f"`{c}`") for c in rows.columns)))
