"""Sequenced changes, applied per client by a stateful streaming query.

Each client has held rows by number, its next number and its current values; a few hundred clients share a key of the state. A client's rows count in the order of their numbers:
whatever continues the sequence is applied at once, the rest is held. A clock (the largest day of earlier batches) comes with each batch to every
group of clients known so far; a gap in front of a row that has waited long enough is jumped.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import growth
from .common import crc32_of, shared_dir, stored

BATCHES = 8
FIRST_DAY, DAYS = 19723, 160
#: Days that a held row waits
WAIT = 5
#: A row of whose hash this is a divisor is lost, which makes gaps
LOST = 11
#: Rows of a group that are in a worker's memory at once
CHUNK = 20_000

#: Held rows of a client that are part of its group's value; more are in the map
LISTED = 32
#: Clients of a group, about
GROUP = 500

COLUMNS = ["change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance"]
_ROWS = "client_id long, n long, change_id long, op string, city string, balance double, day int, batch int"
_OUT = "client_id long, n long, change_id long, status string, batch int, missed long, city string, cents long"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # would read before each write
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a start reads one batch, so nothing is gained by an open store
}


def _order(row: list) -> tuple:
    """Of rows with one number the least counts: by day and change_id, then (equal ids) by what they say, nulls first."""
    change, op, city, balance, day, _ = row
    return day, change, op or "", city or "", -math.inf if balance is None else balance


_Out = Row("row")


class _Client:
    """What a client has in its group's state: next, the number of held rows in the map, a day that no held row is before, held rows that are few, and of the
    last applied row its number, whether it was a D, city and balance. While ``few`` is null, held rows are in the map."""

    def __init__(self, number: int | None, group: "Sequences", was: list | None):
        self.number, self.group = number, group
        self.at, self.held, self.least, few, *self.now = was or [1, 0, None, [], 0, True, None, None]
        self.few: dict[int, list] | None = None if few is None else {n: row for n, *row in few}
        self.fresh: dict[int, list] = {}

    def state(self) -> list:
        few = None if self.few is None else [[n, *row] for n, row in self.few.items()]
        return [self.number, [self.at, self.held, self.least if self.held or self.few else None, few, *self.now]]

    def out(self, row: list, n: int, status: str, missed: int = 0, city: str | None = None, cents: int | None = None) -> Row:
        return _Out(json.dumps({"client_id": self.number, "n": n, "change_id": row[0], "status": status, "batch": self.group.batch, "missed": missed, "city": city, "cents": cents}))

    def applied(self, row: list, n: int, missed: int) -> Row:
        _, op, city, balance, _, _ = row
        _, _, old_city, old_balance = self.now
        if op == "U":
            city, balance = old_city if city is None else city, old_balance if balance is None else balance
        elif op == "D":
            city = balance = None
        elif op != "I":
            city, balance = old_city, old_balance
        self.now = [n, op == "D", city, balance]
        cents = 100 * balance + 0.5 if balance is not None else math.nan
        return self.out(row, n, "applied", missed, city, math.floor(cents) if math.isfinite(cents) else None)

    def found(self, n: int) -> list | None:
        if self.few is not None:
            return self.few.get(n)
        kept = self.group.rows.getValue((self.number, n)) if self.held else None
        return json.loads(kept[0]) if kept else None

    def gone(self, n: int) -> None:
        """No longer held."""
        if self.few is not None:
            del self.few[n]
        else:
            self.group.rows.removeKey((self.number, n))
            self.held -= 1
            if not self.held:
                self.few = {}

    def taken(self, n: int) -> list | None:
        row = self.fresh.pop(n, None)
        if row is None:
            row = self.found(n)
            if row is not None:
                self.gone(n)
        return row

    def keep(self) -> None:
        """New rows are held; in the map from where they are many."""
        if not self.fresh:
            return
        self.least = min([self.least] * (self.least is not None) + [row[4] for row in self.fresh.values()])
        if self.few is not None:
            self.few.update(self.fresh)
            put = self.few if len(self.few) > self.group.listed else {}
        else:
            put = self.fresh
        for n, row in put.items():
            self.group.rows.updateValue((self.number, n), (json.dumps(row),))
        self.held += len(put)
        if put and self.few is not None:
            self.few = None
        self.fresh = {}

    def waiting(self) -> bool:
        group = self.group
        return bool(self.held or self.few) and (group.last or (group.clock is not None and self.least + group.wait <= group.clock))

    def jumped(self, held: dict[int, int]) -> Iterator[Row]:
        """Gaps in front of rows that have waited long enough; ``held``: day by number of the held rows."""
        days = [(day, n) for n, day in held.items()]
        waiting = sorted(held)
        heapq.heapify(days)
        i = 0
        while i < len(waiting):
            while days[0][1] < self.at:
                heapq.heappop(days)
            if not self.group.last and days[0][0] + self.group.wait > self.group.clock:
                break
            missed, self.at = waiting[i] - self.at, waiting[i]
            while i < len(waiting) and waiting[i] == self.at:
                yield self.applied(self.taken(self.at), self.at, missed)
                missed, self.at, i = 0, self.at + 1, i + 1
        self.least = days[0][0] if i < len(waiting) else None

    def given(self, n: int, row: list) -> Iterator[Row]:
        rival = None if n < self.at else self.fresh.get(n) or self.found(n)
        if rival is None and n >= self.at:
            self.fresh[n] = row
        elif rival is not None and rival[5] == self.group.batch and _order(row) < _order(rival):
            if n not in self.fresh:
                self.gone(n)
            self.fresh[n] = row
            yield self.out(rival, n, "rejected")
        else:
            yield self.out(row, n, "rejected")

    def continued(self) -> Iterator[Row]:
        while (row := self.taken(self.at)) is not None:
            yield self.applied(row, self.at, 0)
            self.at += 1
        self.keep()


class Sequences(StatefulProcessor):
    """The rows (g, row: JSON) of a group of clients in a batch; a null row is the clock's.

    Clients come in groups, since what a key and a call to the state cost (about 0.3 ms) is many times what a row needs. A group's clients are one value; a client's
    held rows are in it while they are few, and else in a map by client and number. Rows and values are JSON, since what a row costs grows with its columns.
    """

    def __init__(self, batch: int, clock: int | None, last: bool, wait: int, chunk: int, listed: int):
        self.batch, self.clock, self.last, self.wait, self.chunk, self.listed = batch, clock, last, wait, chunk, listed

    def init(self, handle) -> None:
        gc.freeze()  # what is loaded so far stays; looking through it for garbage takes longer than the rows
        self.value = handle.getValueState("value", "value string")
        self.rows = handle.getMapState("rows", "client_id long, n long", "row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = iter(rows)
        chunk = list(itertools.islice(rows, self.chunk))
        known = self.value.get()
        clients = {c: _Client(c, self, was) for c, was in json.loads(known[0])} if known else {}
        jumping = [c for c in clients.values() if c.waiting()]
        many: dict[int | None, dict[int, int]] = {c.number: {} for c in jumping if c.few is None}
        if many:  # number and day of each
            for (number, n), kept in self.rows.iterator():
                if number in many:
                    many[number][n] = json.loads(kept[0])[4]
        for c in jumping:
            yield from c.jumped({n: row[4] for n, row in c.few.items()} if c.few is not None else many.pop(c.number))
        while chunk:
            met = {}
            for r in chunk:
                if r.row is None:
                    continue
                number, n, *row = map(json.loads(r.row).get, ("client_id", "n", "change_id", "op", "city", "balance", "day"))
                row = [*row[:3], None if row[3] is None else float(row[3]), row[4], self.batch]
                client = clients.get(number)
                if client is None:
                    client = clients[number] = _Client(number, self, None)
                met[number] = client
                yield from client.given(n, row)
            chunk = list(itertools.islice(rows, self.chunk))
            if chunk:  # the next may bring an earlier row of any number
                for client in met.values():
                    client.keep()
        for client in clients.values():
            yield from client.continued()
            if self.last and not client.now[1]:
                yield client.out([None], client.now[0], "current")
        self.value.update((json.dumps([c.state() for c in clients.values()]),))

    def close(self) -> None:
        pass


def numbered(changes: DataFrame) -> DataFrame:
    """Distinct rows with n, the dense rank of seq within a client (nulls first), and day.

    Distinct (client, seq) pairs get their place in the whole order, by ranges; a client's least place is taken off. So no window holds a client.
    """
    rows = stored(changes.select(*COLUMNS).distinct(), "changes")
    pairs = growth.numbered(rows.select("client_id", "seq").distinct(), [F.col("client_id"), F.col("seq")])
    first = pairs.groupBy("client_id").agg(F.min("place").alias("first")).withColumnRenamed("client_id", "c")
    ranks = pairs.join(first, F.col("client_id").eqNullSafe(F.col("c"))).select(F.col("client_id").alias("c"), F.col("seq").alias("s"), (F.col("place") - F.col("first") + 1).alias("n"))
    found = rows.join(ranks, F.col("client_id").eqNullSafe(F.col("c")) & F.col("seq").eqNullSafe(F.col("s")))
    h = crc32_of("change_id")
    day = F.unix_date(F.to_date("valid_at")) + 2 * (h % 4)
    return found.select(*COLUMNS, "n", h.alias("h"), day.cast("int").alias("day"))


def batched(changes: DataFrame, batches: int = BATCHES, lost: int = LOST) -> DataFrame:
    """Rows of the stream: those that have a day and aren't lost, with their batch."""
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - FIRST_DAY) * batches / F.lit(DAYS)))).cast("int")
    found = numbered(changes).where((F.col("h") % lost != 0) & F.col("day").isNotNull()).withColumn("batch", batch)
    return found.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in _ROWS.split(", ")])


def _moved(spark: SparkSession, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(old)) and not fs.rename(path(old), path(new)):
        raise OSError(f"can't move {old} to {new}")


def _made(spark: SparkSession, folder: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return folder


def apply(changes: DataFrame, batches: int = BATCHES, wait: int = WAIT, lost: int = LOST, chunk: int = CHUNK, group: int = GROUP, listed: int = LISTED) -> DataFrame:
    """What became of each change: change_id, client_id, status (applied, rejected), batch, missed, city, cents, current.

    Rows without a client are one client's; rows without a day or a change_id take part in the numbering only; null numbers come first; days before
    the first batch count to it; an op other than I, U and D changes nothing; equal change_ids with different values are different
    changes. Other columns are ignored, repeated rows count once, an empty table gives no rows.

    Every call has a new folder. Each start of the query finds one more batch in its source, goes on from the checkpoint and ends. A group's rows of a batch are
    read in chunks; its clients' values are in memory, with at most ``listed`` held rows of each, and the rest of what is held lies in the state store. Only while
    gaps are jumped, number and day of those clients' held rows are in memory.
    """
    spark = changes.sparkSession
    folder = shared_dir(spark, "sequenced")
    rows = stored(batched(changes, batches, lost), "batched")
    n_groups = -(-(rows.agg(F.approx_count_distinct("client_id")).first()[0] + 1) // group)
    rows = rows.withColumn("g", F.pmod(F.xxhash64("client_id"), F.lit(n_groups)))
    known = rows.groupBy("g").agg(F.min("batch").alias("first")).select("g", F.explode(F.sequence(F.col("first") + 1, F.lit(batches + 1))).alias("b"))
    said = F.to_json(F.struct("client_id", "n", "change_id", "op", "city", "balance", "day"))
    fed = rows.select("g", said.alias("row"), F.col("batch").alias("b")).unionByName(known, allowMissingColumns=True)
    fed.write.partitionBy("b").parquet(f"{folder}/waiting")
    days = {r["batch"]: r["day"] for r in rows.groupBy("batch").agg(F.max("day").alias("day")).collect()}  # a row a batch
    _made(spark, f"{folder}/source")
    saved = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        for b in range(1, batches + 2):
            _moved(spark, f"{folder}/waiting/b={b}", f"{folder}/source/b={b}")
            clock = max((d for e, d in days.items() if e < b), default=None)
            given = spark.readStream.schema("g long, row string, b int").parquet(f"{folder}/source").drop("b")
            done = given.groupBy("g").transformWithState(Sequences(b, clock, b > batches, wait, chunk, listed), "row string", "Append", "None")
            done.writeStream.format("parquet").option("path", _made(spark, f"{folder}/out")).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema("row string").parquet(f"{folder}/out").select(F.from_json("row", _OUT).alias("r")).select("r.*")
    final = out.where("status = 'current'").select(F.col("client_id").alias("c"), F.col("n").alias("m"))
    rows = out.where("status <> 'current'")
    joined = rows.join(final, F.col("client_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m")) & (F.col("status") == "applied"), "left")
    return joined.select("change_id", "client_id", "status", "batch", "missed", "city", "cents", F.col("m").isNotNull().alias("current"))
