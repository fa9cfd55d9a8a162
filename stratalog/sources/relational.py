"""Tables over the store: rows under a table's key prefix, decoded as DataFrames for Spark SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from stratalog.functions.keys import encode_int, int_key, prefix_range, table_prefix
from stratalog.plans.scratch import cut
from stratalog.sources.store import Store, WritePlan


class Table:
    """A table with an integer primary key. Its id is kept in the manifest; nulls are kept; duplicate keys are refused."""

    def __init__(self, store: Store, name: str, schema: T.StructType, key: str):
        self.store, self.name, self.schema, self.key = store, name, schema, key

        def make(m: dict):
            if name in m["tables"]:
                return False
            return m | {"version": m["version"] + 1, "tables": m["tables"] | {name: 1 + max(m["tables"].values(), default=0)}}

        store._commit(make)
        self.prefix = table_prefix(store._latest()["tables"][name])

    def row_key(self, pk: int) -> bytes:
        return self.prefix + encode_int(pk)

    def insert(self, rows: DataFrame) -> None:
        """Rows of any number, in one commit; ValueError if a key comes twice, or is there in the version that it follows."""
        keyed = rows.select(F.concat(F.lit(self.prefix), int_key(F.col(self.key))).alias("key"), F.to_json(F.struct(*self.schema.names)).alias("value"), F.lit("put").alias("op"))
        keyed = cut(keyed, "insert")
        if not keyed.groupBy("key").count().filter("count > 1").isEmpty():
            raise ValueError("duplicate key")

        def check(view) -> None:
            there = view.relation().filter(prefix_range(F.col("key"), self.prefix)).select("key")
            if not keyed.join(there, "key", "left_semi").isEmpty():
                raise ValueError("duplicate key")

        self.store.apply_frame(keyed, "key", check=check)

    def get(self, pk: int) -> dict | None:
        """A row by its key."""
        import json

        value = self.store.get(self.row_key(pk))
        return None if value is None else json.loads(value)

    def count(self) -> int:
        return self.store.prefix(self.prefix, keys_only=True).count()

    def update(self, pk: int, row: dict) -> bool:
        import json

        snap = self.store.snapshot()
        try:
            return self.store.apply_if(snap, WritePlan().ensure_present(self.row_key(pk)).put(self.row_key(pk), json.dumps(row).encode()))
        finally:
            snap.close()

    def delete(self, pk: int) -> bool:
        return self.store.delete(self.row_key(pk))

    def frame(self) -> DataFrame:
        rows = self.store.prefix(self.prefix)
        return rows.select(F.from_json(F.col("value").cast("string"), self.schema).alias("r")).select("r.*")

    def drop(self) -> None:
        """The rows go, as tombstones, in one commit."""
        gone = self.store.prefix(self.prefix, keys_only=True).select("key", F.lit(None).cast("binary").alias("value"), F.lit("delete").alias("op"))
        self.store.apply_frame(gone, "key")
