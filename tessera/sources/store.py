"""The keyed store: documents, chunks and meta as Parquet files with a pointer file for each table.

Documents and chunks lie in buckets by a hash of their url. The pointer, ``CURRENT``, names the folder of
each bucket's rows. A write makes new folders for the buckets that it changes only, so that it costs in
proportion to them, and then renames a new pointer into place: readers see the old or the new table, and
a failed write leaves nothing behind that is read. What a write replaces is deleted by the next one, so
that plans made before it can still run. One writer at a time. Files go through Spark's file systems, so
the root can be in any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import ConfigurationError, StoreError
from ..functions.misc import model_directory

DOCUMENTS = "url string, title string, etag string, last_modified string, last_crawled timestamp, content_hash string"
CHUNKS = "id string, url string, section_path string, text string, tokens int, embedding array<float>, chunk_index int, created_at timestamp, updated_at timestamp"
META = "key string, value string"
#: Buckets of a new store's tables; a table keeps the number that it was made with.
BUCKETS = 64


def latest(rows: DataFrame, key: str, order) -> DataFrame:
    """The last row of each key by ``order``, whole: a null overwrites, as a replaced row does."""
    last = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def one_each(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row a key: the one with the greatest ``order``, and of several, by the other columns."""
    first = [c for c in (order,) if c is not None]
    rest = [*first, *[c for c in rows.columns if c not in (key, *first)]]
    return rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("row")).select(*[F.col(key) if c == key else F.col(f"row.{c}") for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Old rows that aren't replaced, and the new ones, one a key."""
    new = one_each(new, key, order)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def bucket_of(url, buckets: int):
    return F.coalesce(F.pmod(F.xxhash64(url), F.lit(buckets)), F.lit(0)).cast("int")


def refreshed(old: DataFrame, fetched: DataFrame) -> DataFrame:
    """Document rows after a fetch of (url, status, body, etag, last_modified, fetched_at).

    304 renews last_crawled only. Otherwise the hash is of the raw body, the title stays, and etag and
    last_modified stay where the answer has none.
    """
    o = old.select("url", *[F.col(c).alias(f"old_{c}") for c in ("title", "etag", "last_modified", "content_hash")])
    rows = fetched.join(o, "url", "left")
    same = F.col("status") == 304
    return rows.select(
        "url",
        F.col("old_title").alias("title"),
        F.when(same, F.col("old_etag")).otherwise(F.coalesce("etag", "old_etag")).alias("etag"),
        F.when(same, F.col("old_last_modified")).otherwise(F.coalesce("last_modified", "old_last_modified")).alias("last_modified"),
        F.col("fetched_at").alias("last_crawled"),
        F.when(same, F.col("old_content_hash")).otherwise(F.sha2(F.col("body").cast("binary"), 256)).alias("content_hash"),
    )


def revalidated(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests (url, etag) with ``unchanged``: the stored etag is the one the page has now."""
    stored = documents.select("url", F.col("etag").alias("stored_etag"))
    return requests.join(stored, "url", "left").withColumn("unchanged", F.coalesce(F.col("etag") == F.col("stored_etag"), F.lit(False)))


class Store:
    """One directory for each embedding model below ``root``."""

    def __init__(self, spark: SparkSession, root: str, model: str, dim: int | None = None, buckets: int = BUCKETS):
        """``buckets``: of tables that have no rows yet. A write's cost is that of the buckets that it changes."""
        self.spark, self.model, self.buckets = spark, model, buckets
        self.root = f"{root.rstrip('/')}/model={model_directory(model)}"
        self.configure(dim)

    # files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _state(self, name: str) -> dict:
        """The pointer: number of buckets, folder of each one that has rows, and folders that the next write deletes."""
        fs, p = self._fs(f"{self.root}/{name}/CURRENT")
        if not fs.exists(p):
            return {"buckets": 1 if name == "meta" else self.buckets, "folders": {}, "old": []}
        stream = fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            raise StoreError(f"the pointer of {name} can't be read") from None

    def _point(self, name: str, state: dict) -> None:
        """Put a pointer in place by renaming a whole file."""
        jvm = self.spark.sparkContext._jvm
        fs, new = self._fs(f"{self.root}/{name}/.CURRENT-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(json.dumps(state).encode())
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/CURRENT"), how)

    def _read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        folders = self._state(name)["folders"]
        paths = [f"{self.root}/{name}/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, name: str, rows: DataFrame, schema: str, buckets: list[int] | None = None) -> None:
        """Replace the rows of ``buckets``, or of all, by ``rows``, which must be of these buckets.

        Rows are gathered by bucket in files of the advisory size: a large bucket is split, small ones share a task.
        """
        state, version, kinds = self._state(name), uuid.uuid4().hex, StructType.fromDDL(schema)
        own = F.lit(0) if state["buckets"] == 1 else bucket_of(F.col("url"), state["buckets"])
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in kinds], own.alias("bucket"))
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{version}")
        fs, p = self._fs(f"{self.root}/{name}/{version}")
        new = {f.getPath().getName().partition("=")[2]: f"{version}/{f.getPath().getName()}" for f in fs.listStatus(p) if f.isDirectory()}
        gone = {b: f for b, f in state["folders"].items() if buckets is None or int(b) in buckets}
        kept = {b: f for b, f in state["folders"].items() if b not in gone}
        self._point(name, {"buckets": state["buckets"], "folders": kept | new, "old": list(gone.values())})
        self._delete(name, state["old"])

    def _delete(self, name: str, folders: list[str]) -> None:
        for f in folders:
            fs, p = self._fs(f"{self.root}/{name}/{f}")
            fs.delete(p, True)

    def _buckets_of(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of some rows' urls: as many as the table has, at most."""
        n = self._state(name)["buckets"]
        return [r["b"] for r in rows.select(bucket_of(F.col("url"), n).alias("b")).distinct().collect()]

    def _staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """The rows written once, so that what made them, such as a paid model, runs once; and their folder."""
        folder = f"{self.root}/staged-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder), folder

    def size_bytes(self) -> int:
        fs, p = self._fs(self.root)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    # tables

    @property
    def documents(self) -> DataFrame:
        return self._read("documents", DOCUMENTS)

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    @property
    def meta(self) -> DataFrame:
        return self._read("meta", META)

    def document(self, url: str) -> DataFrame:
        return self.documents.filter(F.col("url") == url)

    def chunks_of(self, url: str) -> DataFrame:
        """In document order."""
        return self.chunks.filter(F.col("url") == url).orderBy("chunk_index")

    # changes

    def configure(self, dim: int | None) -> None:
        """Pin model and dimension; another model is an error, another dimension empties the chunks."""
        known = {r["key"]: r["value"] for r in self.meta.collect()}  # two rows
        if known.get("embedding_model", self.model) != self.model:
            raise ConfigurationError(f"the store is of model {known['embedding_model']}, not {self.model}")
        if dim is None or known.get("embedding_dim") == str(dim):
            return
        if "embedding_dim" in known:
            self._write("chunks", self.spark.createDataFrame([], CHUNKS), CHUNKS)
        self._write("meta", self.spark.createDataFrame([("embedding_model", self.model), ("embedding_dim", str(dim))], META), META)

    def clear_configuration(self) -> None:
        self._write("chunks", self.spark.createDataFrame([], CHUNKS), CHUNKS)
        self._write("meta", self.meta.filter(~F.col("key").isin("embedding_model", "embedding_dim")), META)

    def upsert_documents(self, rows: DataFrame) -> None:
        """New rows by url; of several with one url, the one crawled last."""
        rows, folder = self._staged(rows)
        buckets = self._buckets_of("documents", rows)
        if buckets:
            self._write("documents", upsert(self._read("documents", DOCUMENTS, buckets), rows, "url", "last_crawled"), DOCUMENTS, buckets)
        self._delete("", [folder.rpartition("/")[2]])

    def upsert_chunks(self, rows: DataFrame, replace: bool = False) -> None:
        """New rows by id, which is of one url. A known id keeps its times; ``replace`` also drops its url's other chunks."""
        rows, folder = self._staged(rows)
        try:
            buckets = self._buckets_of("chunks", rows)
            if not buckets:
                return
            dim = self.meta.filter("key = 'embedding_dim'").collect()
            if dim and not rows.filter(F.size("embedding") != int(dim[0]["value"])).isEmpty():
                raise StoreError(f"embeddings must have {dim[0]['value']} components")
            old = self._read("chunks", CHUNKS, buckets)
            times = old.select("id", F.col("created_at").alias("_c"), F.col("updated_at").alias("_u"))
            now = F.current_timestamp()
            new = one_each(rows, "id").join(times, "id", "left").withColumn("created_at", F.coalesce("_c", now)).withColumn("updated_at", F.coalesce("_u", now)).drop("_c", "_u")
            kept = old.join(rows.select("url").distinct(), "url", "left_anti") if replace else old
            self._write("chunks", upsert(kept, new.select(*old.columns), "id"), CHUNKS, buckets)
        finally:
            self._delete("", [folder.rpartition("/")[2]])

    def _without(self, name: str, schema: str, rows: DataFrame, condition) -> None:
        """Delete the rows that meet a condition; ``rows`` (url) tell which buckets have them."""
        if buckets := self._buckets_of(name, rows):
            self._write(name, self._read(name, schema, buckets).filter(~F.coalesce(condition, F.lit(False))), schema, buckets)

    def _urls(self, url: str) -> DataFrame:
        return self.spark.createDataFrame([(url,)], "url string")

    def delete_document(self, url: str) -> None:
        self._without("documents", DOCUMENTS, self._urls(url), F.col("url") == url)
        self.delete_chunks_of(url)

    def delete_chunk(self, chunk_id: str) -> None:
        self._without("chunks", CHUNKS, self.chunks.filter(F.col("id") == chunk_id), F.col("id") == chunk_id)

    def delete_chunks_of(self, url: str) -> None:
        self._without("chunks", CHUNKS, self._urls(url), F.col("url") == url)

    def delete_expired(self, cutoff) -> dict:
        """Remove documents crawled before ``cutoff`` and their chunks; what was removed."""
        from ..plans.retention import dry_run, expired, survivors

        report = dry_run(self.documents, self.chunks, cutoff).first().asDict()
        if report["documents"]:
            old = expired(self.documents, cutoff).select("url")
            touched = {n: self._buckets_of(n, old) for n in ("documents", "chunks")}
            documents, chunks = survivors(self._read("documents", DOCUMENTS), self._read("chunks", CHUNKS, touched["chunks"]), cutoff)
            self._write("chunks", chunks, CHUNKS, touched["chunks"])
            kept = documents.filter(bucket_of(F.col("url"), self._state("documents")["buckets"]).isin(touched["documents"]))
            self._write("documents", kept, DOCUMENTS, touched["documents"])
        return report

    def compact(self) -> None:
        """Rewrite the tables in files of the advisory size, and delete what was replaced at once."""
        for name, schema in (("documents", DOCUMENTS), ("chunks", CHUNKS)):
            if self._state(name)["folders"]:
                self._write(name, self._read(name, schema), schema)
                state = self._state(name)
                self._point(name, state | {"old": []})
                self._delete(name, state["old"])

    def tables(self) -> list[tuple[str, int, int]]:
        """(name, rows, columns) of each table."""
        return [(n, t.count(), len(t.columns)) for n, t in (("chunks", self.chunks), ("documents", self.documents), ("meta", self.meta))]
