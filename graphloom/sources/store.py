"""Tables as snapshots in a folder of any file system.

A snapshot is a list of part folders. A write makes new parts and then a new
version file that lists them; versions are numbered, none is ever changed, and
the highest complete one counts. So readers see the old or the new rows at any
moment, a crash leaves the old ones, a table can be rewritten from its own
contents, and of two writers of one version the second fails. New rows are
appended as parts; only rows with known keys make a table be rewritten. Old
parts and versions go with ``vacuum``, which joins many parts into one.

The status and path of documents are kept in a narrow table of their own and
laid over ``source_documents`` as it is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schemas import KEYS, SORTED, TABLES
from graphloom.session import stage, staging

MANY_PARTS = 32


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        home = self._path(f"{self.root}/{table}")
        names = [f.getPath().getName() for f in self._fs.listStatus(home)] if self._fs.exists(home) else []
        return sorted((int(n[2:]) for n in names if n.startswith("_v") and n[2:].isdigit()), reverse=True)

    def _version_file(self, table: str, version: int):
        return self._path(f"{self.root}/{table}/_v{version:012d}")

    def _current(self, table: str) -> tuple[int, list[str]]:
        """The highest complete version and its parts; (0, []) if there is none."""
        for v in self._versions(table):
            stream = self._fs.open(self._version_file(table, v))
            try:
                *parts, end = bytes(stream.readAllBytes()).decode().split("\n") or [""]
            finally:
                stream.close()
            if end == ".":
                return v, parts
        return 0, []

    def _publish(self, table: str, parts: list[str], seen: int) -> None:
        """Makes the parts the version after ``seen``; raises if another writer was faster."""
        if self._current(table)[0] != seen:
            raise RuntimeError(f"{table} was changed by another writer")
        at = max(self._versions(table), default=0) + 1  # above a version left incomplete by a crash
        out = self._fs.create(self._version_file(table, at), False)
        out.write(bytearray("\n".join([*parts, "."]).encode()))
        out.close()

    def _part(self, table: str, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        shaped = self.spark.createDataFrame([], TABLES[table]).schema
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shaped])
        if table in SORTED:
            rows = rows.repartitionByRange(SORTED[table]).sortWithinPartitions(SORTED[table])
        rows.write.parquet(f"{self.root}/{table}/{name}")
        return name

    def _stored(self, table: str) -> DataFrame:
        schema, parts = TABLES[table], self._current(table)[1]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def read(self, table: str) -> DataFrame:
        """The table, empty if nothing was written yet."""
        rows = self._stored(table)
        if table != "source_documents":
            return rows
        over = self._stored("document_status").select("id", F.col("pipeline_status").alias("_s"), F.col("source_path").alias("_p"))
        joined = rows.join(over, "id", "left")
        return joined.select("id", F.coalesce("_p", "source_path").alias("source_path"), "raw_content", F.coalesce("_s", "pipeline_status").alias("pipeline_status"), "created_at")

    def has(self, table: str) -> bool:
        """Whether the table was ever written."""
        return bool(self._current(table)[0])

    def write(self, table: str, df: DataFrame) -> None:
        """The rows are all the table has from now on."""
        seen = self._current(table)[0]
        self._publish(table, [self._part(table, df)], seen)

    def append(self, table: str, df: DataFrame) -> None:
        """Rows beside those there are; their keys must be new."""
        seen, parts = self._current(table)
        self._publish(table, [*parts, self._part(table, df)], seen)

    def create(self) -> None:
        """Every table that is not there yet, empty."""
        for t in TABLES:
            if not self._current(t)[0]:
                self.write(t, self._stored(t))

    def upsert(self, table: str, rows: DataFrame, keep: tuple[str, ...] = ()) -> None:
        """Rows by key: new ones added, known ones replaced but for the columns in ``keep``.

        Of several rows of one key the one that sorts last is taken. Without known
        keys among them the rows are appended.
        """
        old, key = self._stored(table), KEYS[table]
        with staging():
            new = stage(merged(old.limit(0), rows, key, keep))
            if new.isEmpty() and self.has(table):
                return
            if old.select(key).join(new.select(key), key, "left_semi").isEmpty():
                self.append(table, new)
            else:
                self.write(table, merged(old, new, key, keep))

    def upsert_documents(self, rows: DataFrame) -> None:
        """Path and content are taken over; status and time of known documents stay."""
        self.upsert("source_documents", rows, ("pipeline_status", "created_at"))

    def upsert_relationships(self, rows: DataFrame) -> None:
        """The ends of a known relationship stay."""
        self.upsert("relationships", rows, ("source_entity_id", "target_entity_id"))

    def set_status(self, ids: DataFrame, status: str, id_col: str = "id") -> None:
        self.upsert("document_status", ids.select(F.col(id_col).alias("id"), F.lit(status).alias("pipeline_status")).distinct(), ("source_path",))

    def statuses(self) -> DataFrame:
        """(id, pipeline_status, source_path) of all documents, without their contents."""
        return self.read("source_documents").select("id", "pipeline_status", "source_path")

    def move_documents(self, moved: DataFrame) -> None:
        """New paths of documents, from (id, source_path)."""
        self.upsert("document_status", moved.select("id", "source_path"), ("pipeline_status",))

    def move_document(self, old: str, new: str) -> None:
        self.move_documents(self.statuses().where(F.col("source_path") == old).select("id", F.lit(new).alias("source_path")))

    def delete(self, table: str, ids: DataFrame) -> None:
        key = KEYS[table]
        gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
        for t in (table, "document_status") if table == "source_documents" else (table,):
            self.write(t, self._stored(t).join(gone, key, "left_anti"))

    def delete_chunks(self, ids: DataFrame) -> None:
        """Chunks with their vectors and postings; statistics follow, as they are derived."""
        one = ids.select(F.col(ids.columns[0]).alias("chunk_id")).distinct()
        for t in ("chunks", "embeddings", "postings", "vector_index"):
            self.write(t, self.read(t).join(one, "chunk_id", "left_anti"))

    def clear(self) -> dict[str, int]:
        """Empties all tables; returns how many rows each had."""
        counts = {t: self._stored(t).count() for t in TABLES}
        for t in TABLES:
            self.write(t, self.spark.createDataFrame([], TABLES[t]))
        return counts

    def reset(self) -> dict[str, int]:
        """Removes the whole store; returns how many rows each table had."""
        counts = {t: self._stored(t).count() for t in TABLES}
        self._fs.delete(self._path(self.root), True)
        return counts

    def vacuum(self, many: int = MANY_PARTS) -> int:
        """Removes parts and versions that are no longer current, after joining the parts of tables that have many. Returns the parts removed."""
        gone = 0
        for t in TABLES:
            seen, parts = self._current(t)
            if not seen:
                continue
            if len(parts) > many:
                self.write(t, self._stored(t))
                seen, parts = self._current(t)
            for f in self._fs.listStatus(self._path(f"{self.root}/{t}")):
                name = f.getPath().getName()
                if f.isDirectory() and name not in parts:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
                elif name.startswith("_v") and name[2:].isdigit() and int(name[2:]) < seen:
                    self._fs.delete(f.getPath(), False)
        return gone


def merged(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Old and new rows by key in one aggregation, without a join."""
    cols = [c for c in old.columns if c != key]
    tagged = lambda df, n: df.select(key, F.struct(F.lit(n).alias("n"), *[c if c in df.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in cols]).alias("r"))
    rows = tagged(old, 0).unionByName(tagged(new, 1))
    # Maps cannot be ordered, so ties are settled by a hash of the row.
    order = F.struct("r.n", F.xxhash64(F.to_json("r")))
    best = rows.groupBy(key).agg(F.max_by("r", order).alias("r"), F.min_by("r", order).alias("f"))
    return best.select(key, *[(F.col(f"f.{c}") if c in keep else F.col(f"r.{c}")).alias(c) for c in cols])
