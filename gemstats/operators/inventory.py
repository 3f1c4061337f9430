"""The inventory as an append-only ledger.

Every action appends one batch of rows tagged ``(batch_id, op)``:
``select`` (rows picked from the listing), ``all`` (every filtered row),
``manual`` (one hand-entered stone) or ``clear`` (a marker row). The
current inventory is the rows after the last ``clear``. Appends are bag
unions: the same stone added twice is there twice.

The ledger lives as a lazy union in memory, or in a folder that several
sessions may save to. A save writes its batches to a folder of its own, then
commits them (``commits``): only the commit gives them their numbers, after
all that was committed before, so two sessions never share one, and a save that
breaks off leaves nothing that a reader sees. A commit also holds each
batch's count and sums, so totals of stored batches read no rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grades
from ..sources.files import write_csv
from ..sources.order import ORDINAL
from .commits import read_commits, try_commit
from .numbering import numbered

META = ["batch_id", "op", "row_id", "seq"]  # seq: the row's place in its batch's source, to sort by
ITEM_SCHEMA = T.StructType([
    T.StructField("carat", T.DoubleType()), T.StructField("cut", T.StringType()),
    T.StructField("color", T.StringType()), T.StructField("clarity", T.StringType()),
    T.StructField("price", T.LongType()), T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()), T.StructField("z", T.DoubleType()),
    T.StructField("color_numeric", T.IntegerType()), T.StructField("clarity_numeric", T.IntegerType()),
    T.StructField("cut_gia", T.StringType()),
])
MANUAL_SCHEMA = T.StructType(ITEM_SCHEMA.fields[:5])  # carat, cut, color, clarity, price


def row_key_sql(columns: list[str]) -> str:
    """Content key of a row as SQL text: SHA-256 of its JSON text (stable across runs)."""
    return "sha2(to_json(struct(" + ", ".join(f"`{c}`" for c in columns) + ")), 256)"


def row_key(columns: list[str]) -> Column:
    return F.expr(row_key_sql(columns))


def _manual_rules() -> list[tuple[str, tuple, str]]:
    """``(column, check, reason)`` of the manual-entry form: one rule table
    for the Spark check of a table and the driver check of one entry."""
    return [
        ("carat", ("range", *grades.MANUAL_CARAT_RANGE), "carat out of range"),
        ("price", ("range", *grades.MANUAL_PRICE_RANGE), "price out of range"),
        ("cut", ("in", grades.CUT_CHOICES), "unknown cut"),
        ("color", ("in", grades.COLOR_CHOICES), "unknown color"),
        ("clarity", ("in", grades.CLARITY_CHOICES), "unknown clarity"),
    ]


def validate_manual(df: DataFrame) -> DataFrame:
    """Checks of the manual-entry form as columns: ``valid`` and a ``reason``
    listing every failed check (NULL when valid). A missing value fails."""
    ok, reasons = [], []
    for column, check, reason in _manual_rules():
        c = F.col(column)
        cond = c.between(check[1], check[2]) if check[0] == "range" else c.isin(list(check[1]))
        ok.append(F.coalesce(cond, F.lit(False)))
        reasons.append(reason)
    valid = ok[0]
    for o in ok[1:]:
        valid = valid & o
    reason = F.concat_ws("; ", *[F.when(~o, F.lit(text)) for o, text in zip(ok, reasons)])
    return df.select("carat", "cut", "color", "clarity", "price",
                     valid.alias("valid"), F.nullif(reason, F.lit("")).alias("reason"))


def manual_problems(entry: dict) -> list[str]:
    """The same checks for one entry given as Python values (a form input,
    not data): the reasons it fails, empty when valid."""
    out = []
    for column, check, reason in _manual_rules():
        v = entry.get(column)
        good = v is not None and (check[1] <= v <= check[2] if check[0] == "range" else v in check[1])
        if not good:
            out.append(reason)
    return out


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def _literal_row(spark: SparkSession, values: dict, schema: T.StructType) -> DataFrame:
    """One row of literals, planned inside the JVM (no Python-side scan)."""
    return spark.range(1, numPartitions=1).selectExpr(
        *[f"CAST({_sql_literal(values.get(f.name))} AS {f.dataType.simpleString()}) AS `{f.name}`"
          for f in schema.fields])


class Ledger:
    """Immutable handle on the ledger: every action returns a new ledger.

    ``commits`` describe the part stored at ``path``; ``batches`` are the
    appended batches not saved yet, in order, as ``(batch_id, op, DataFrame)``
    (their numbers are settled by the save). ``current`` skips every batch up to
    the last ``clear`` before planning anything.

    The items have the columns of ``item_schema`` first; a batch with further
    columns widens the ledger by name, and a column keeps the widest type
    that it came with (prices with cents stay so). ``row_id`` is a hash of all
    item columns of a row.
    """

    def __init__(self, spark: SparkSession, commits: tuple = (), batches: tuple = (),
                 item_schema: T.StructType = ITEM_SCHEMA, path: str | None = None):
        self.spark = spark
        self.commits = tuple(commits)
        self.batches = tuple(batches)
        self.item_schema = item_schema
        self.path = path

    @property
    def _stored(self) -> list[dict]:
        """The stored batches: save, k (number in the save), batch_id, op, rows, priced, total."""
        return [{**b, "save": c["save"], "batch_id": c["first"] + b["k"] - 1} for c in self.commits for b in c["batches"]]

    @property
    def next_batch(self) -> int:
        return _after(self.commits) + len(self.batches)

    @property
    def last_clear(self) -> int:
        ops = [(b["batch_id"], b["op"]) for b in self._stored] + [(n, op) for n, op, _ in self.batches]
        return max((n for n, op in ops if op == "clear"), default=0)

    @property
    def items(self) -> list[str]:
        return [f.name for f in self.item_schema.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("batch_id", T.LongType()),
                             T.StructField("op", T.StringType()),
                             T.StructField("row_id", T.StringType()),
                             T.StructField("seq", T.DecimalType(38, 0))] + list(self.item_schema.fields))

    def _empty(self) -> DataFrame:
        # a false filter on a literal row folds to an empty local relation
        return _literal_row(self.spark, {}, self.schema).where(F.lit(False))

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        """All frames in the ledger's present columns and types (a column that
        an earlier batch lacked is NULL there)."""
        out = None
        for f in frames:
            have = set(f.columns)
            same = f.selectExpr(*[f"CAST({'`' + c.name + '`' if c.name in have else 'NULL'} AS {c.dataType.simpleString()})"
                                  f" AS `{c.name}`" for c in self.schema.fields])
            out = same if out is None else out.union(same)
        return self._empty() if out is None else out

    # -- appends ---------------------------------------------------------
    def _append(self, rows: DataFrame, op: str, seq: str | None = None) -> "Ledger":
        # one projection in SQL text: a single call to the JVM per batch
        seq = seq or (ORDINAL if ORDINAL in rows.columns else "0")
        items = [c for c in rows.columns if c != ORDINAL]
        kept = T.StructType([f for f in rows.schema.fields if f.name != ORDINAL and f.name != "pos"])
        items = [c for c in items if c != "pos"]
        batch = rows.selectExpr(f"CAST({self.next_batch} AS BIGINT) AS batch_id", f"'{op}' AS op",
                                f"{row_key_sql(items)} AS row_id", f"CAST({seq} AS DECIMAL(38,0)) AS seq", *[f"`{c}`" for c in items])
        return Ledger(self.spark, self.commits, self.batches + ((self.next_batch, op, batch),),
                      widened(self.item_schema, kept), self.path)

    def add_selected(self, listed: DataFrame, positions: list[int]) -> "Ledger":
        """Rows of a numbered listing (see ``filters.listing``) picked by position,
        in the order of the picks."""
        picked = listed.filter(F.col("pos").isin(list(positions)))
        return self._append(picked, "select", f"array_position(array({', '.join(f'{int(p)}L' for p in positions)}), pos)")

    def add_keys(self, rows: DataFrame, keys: DataFrame) -> "Ledger":
        """Rows whose content key is in ``keys.row_id`` (a semi join). The key
        holds whatever filters or order the rows were listed with."""
        keyed = rows.withColumn("_k", row_key([c for c in rows.columns if c != ORDINAL]))
        picked = keyed.join(keys.select(F.col("row_id").alias("_k")), "_k", "left_semi").drop("_k")
        return self._append(picked, "select")

    def add_all(self, rows: DataFrame) -> "Ledger":
        """Every row of ``rows`` (e.g. all filtered rows, not just those listed)."""
        return self._append(rows, "all")

    def add_manual(self, carat: float, cut: str, color: str, clarity: str, price: float) -> "Ledger":
        """One hand-entered stone; it is checked but not cleaned or enriched, so
        its dimensions and grade ordinals stay NULL."""
        whole = float(price).is_integer()
        entry = {"carat": float(carat), "cut": cut, "color": color, "clarity": clarity,
                 "price": int(price) if whole else float(price)}
        bad = manual_problems(entry)
        if bad:
            raise ValueError(f"manual entry rejected: {'; '.join(bad)}")
        fields = [T.StructField("price", T.DoubleType()) if f.name == "price" and not whole else f for f in MANUAL_SCHEMA.fields]
        return self._append(_literal_row(self.spark, entry, T.StructType(fields)), "manual")

    def clear(self) -> "Ledger":
        marker = _literal_row(self.spark, {}, T.StructType([T.StructField("carat", T.DoubleType())]))
        return self._append(marker, "clear")

    # -- views -----------------------------------------------------------
    def _read(self, batches: list[dict]) -> list[DataFrame]:
        """The rows of stored batches, from their own folders alone."""
        live = [b for b in batches if b["rows"]]
        if not live:
            return []
        folders = [f"{self.path}/save={b['save']}/batch={b['k']}/op={b['op']}" for b in live]
        items = T.StructType.fromJson(self.commits[-1]["schema"]).fields  # the types that all saves so far share
        schema = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("seq", T.DecimalType(38, 0)), *items,
                               T.StructField("save", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("op", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)
        first = {b["save"]: b["batch_id"] - b["k"] for b in live}
        base = ", ".join(f"'{save}', {n}L" for save, n in first.items())
        return [rows.selectExpr(f"map({base})[save] + batch AS batch_id", "op", "row_id", "seq", *[f"`{f.name}`" for f in items])]

    @property
    def events(self) -> DataFrame:
        """Every event: stored part, then the unsaved batches."""
        return self._union(self._read(self._stored) + [b for _, _, b in self.batches])

    def _live(self) -> tuple[list[dict], list[DataFrame]]:
        """Stored and unsaved batches after the last ``clear``."""
        last = self.last_clear
        return [b for b in self._stored if b["batch_id"] > last], [b for n, op, b in self.batches if n > last]

    def current(self) -> DataFrame:
        """Rows after the last ``clear``; order by ``(batch_id, seq, row_id)``.
        Batches up to it are left out before planning, their folders unread."""
        stored, fresh = self._live()
        return self._union(self._read(stored) + fresh)

    def numbered(self) -> DataFrame:
        """The current items with ``no`` 0 .. n - 1: batches in their order, the
        rows of one in the order of its source or of the picks."""
        order = [F.col(c) for c in ("batch_id", "seq", "row_id")]
        return numbered(self.current(), order).drop(*META)

    def totals(self) -> DataFrame:
        """Count, total and mean price of the current inventory: what the commits
        say of stored batches, plus the rows of unsaved ones."""
        stored, fresh = self._live()
        whole = isinstance(self.item_schema["price"].dataType, T.IntegralType)
        kind = "BIGINT" if whole else "DOUBLE"
        items, priced = sum(b["rows"] for b in stored), sum(b["priced"] for b in stored)
        known = sum((int if whole else float)(b["total"]) for b in stored if b["priced"])
        rows = (self._union(fresh) if fresh else self.spark.range(0).selectExpr(f"CAST(id AS {kind}) AS price")).agg(
            F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.sum(F.col("price").cast(kind)).alias("total"))
        if not fresh:
            rows = self.spark.range(1, numPartitions=1).selectExpr("0L AS n", "0L AS priced", f"CAST(NULL AS {kind}) AS total")
        added = rows.selectExpr(f"n + {items}L AS items", f"priced + {priced}L AS priced",
                                f"CASE WHEN priced + {priced}L > 0 THEN coalesce(total, 0) + CAST('{known}' AS {kind}) END AS total")
        total = "total" if whole else "round(total, 6)"
        return added.selectExpr("items", f"{total} AS total_value", "round(try_divide(CAST(total AS DOUBLE), priced), 6) AS avg_price")

    # -- storage -----------------------------------------------------------
    def save(self, path: str) -> "Ledger":
        """Save to the folder ``path`` and return the ledger that reads it from
        there, with what other sessions committed meanwhile. At its own path only
        the unsaved batches are written; a new path gets the stored part too and
        must not hold another ledger."""
        path = path.rstrip("/")
        fresh = self.path != path
        if fresh and read_commits(self.spark, path):
            raise ValueError(f"{path} holds another ledger; load it, or save to a new path")
        if not fresh and not self.batches:
            return self
        if not fresh:
            _widened_schema(self.commits, self.item_schema)
        before = 0 if fresh else _after(self.commits) - 1
        ops = ([(b["batch_id"], b["op"]) for b in self._stored] if fresh else []) + [(n, op) for n, op, _ in self.batches]
        rows = self._union((self._read(self._stored) if fresh else []) + [b for _, _, b in self.batches])
        save = uuid.uuid4().hex
        folder = f"{path}/save={save}"
        rows.withColumn("batch", F.col("batch_id") - before).drop("batch_id").write.partitionBy("batch", "op").parquet(folder)
        batches = self._sums(folder, [(n - before, op) for n, op in ops]) if ops else []
        while True:
            commits = read_commits(self.spark, path)
            schema = _widened_schema(commits, self.item_schema)
            entry = {"save": save, "first": _after(commits), "batches": batches, "schema": json.loads(schema.json())}
            if try_commit(self.spark, path, len(commits) + 1, entry):
                return Ledger.load(self.spark, path)

    def _sums(self, folder: str, ops: list[tuple[int, str]]) -> list[dict]:
        """What a commit says of each batch: one aggregate over the prices written."""
        price = self.item_schema["price"]
        whole = isinstance(price.dataType, T.IntegralType)
        kind = T.StructType([price, T.StructField("batch", T.LongType()), T.StructField("op", T.StringType())])
        total = F.sum(F.col("price").cast("bigint" if whole else "double")).cast("string")
        rows = self.spark.read.schema(kind).parquet(folder).groupBy("batch").agg(
            F.count(F.lit(1)).alias("rows"), F.count("price").alias("priced"), total.alias("total")).collect()  # one row a batch
        found = {r["batch"]: r for r in rows}
        out = []
        for k, op in ops:
            r = found.get(k)
            out.append({"k": k, "op": op, "rows": r["rows"] if r else 0, "priced": r["priced"] if r else 0, "total": r["total"] if r else None})
        return out

    def compact(self, path: str) -> "Ledger":
        """The current rows alone as a new ledger at the new ``path``: one batch,
        whatever was appended and cleared before."""
        rows = self.current().withColumnRenamed("seq", ORDINAL).drop("batch_id", "op", "row_id")
        return Ledger(self.spark, item_schema=self.item_schema).add_all(rows).save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, item_schema: T.StructType | None = None) -> "Ledger":
        """The ledger stored at ``path``, with the columns it was saved with. Only
        its commits are read."""
        path = path.rstrip("/")
        commits = read_commits(spark, path)
        if not commits:
            raise ValueError(f"{path} holds no ledger")
        return cls(spark, commits, (), item_schema or T.StructType.fromJson(commits[-1]["schema"]), path)


def _after(commits) -> int:
    """The number of the next batch."""
    return max((c["first"] + max((b["k"] for b in c["batches"]), default=0) for c in commits), default=1)


def _widened_schema(commits: list[dict], own: T.StructType) -> T.StructType:
    """The columns of the last commit and ``own``; their types must agree, as
    rows are stored with them."""
    if not commits:
        return own
    old = T.StructType.fromJson(commits[-1]["schema"])
    new = widened(old, own)
    if any(new[f.name].dataType != f.dataType for s in (old, own) for f in s.fields):
        raise ValueError("a column's type has widened since the last save; save to a new path")
    return new


_WIDTH = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def widened(old: T.StructType, new: T.StructType) -> T.StructType:
    """``old`` with the columns it lacks, and with the wider of two numeric types."""
    fields = {f.name: f for f in old.fields}
    for f in new.fields:
        if f.name not in fields:
            fields[f.name] = T.StructField(f.name, f.dataType)
            continue
        a, b = fields[f.name].dataType, f.dataType
        if a == b:
            continue
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            wide: T.DataType = T.DoubleType()
        elif a in _WIDTH and b in _WIDTH:
            wide = _WIDTH[max(_WIDTH.index(a), _WIDTH.index(b))]
        else:
            raise ValueError(f"column {f.name} is {a.simpleString()} in the ledger and {b.simpleString()} here")
        fields[f.name] = T.StructField(f.name, wide)
    return T.StructType(list(fields.values()))


def inventory_totals(current: DataFrame) -> DataFrame:
    """``items, total_value, avg_price``; NULL sums on an empty inventory. The
    total is a bigint for whole prices, a double (6 decimals) for others."""
    whole = isinstance(current.schema["price"].dataType, T.IntegralType)
    total = F.sum("price").cast("bigint") if whole else F.round(F.sum(F.col("price").cast("double")), 6)
    return current.agg(F.count(F.lit(1)).alias("items"), total.alias("total_value"),
                       F.round(F.avg("price"), 6).alias("avg_price"))


def export_csv(current: DataFrame, path: str) -> None:
    """Write the inventory as CSV with a header and no index (one file per task)."""
    write_csv(current.drop(*META), path)
