"""JSON, JSON lines and CSV files, and tables that take appends, upserts, deletes and updates.

Tables live under a folder that all executors share.  A version of a table is a list of files that
a log names; only what the log names is ever read, so a lost executor or driver leaves the table as it was.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir; one of this machine's only where everything runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shelfscope-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(rows: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: what follows does not recompute it, and a lost executor does not either."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "tables"))
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """checkpointed() as Parquet: the files tell Spark how large the rows are, where a plan only guesses, so a join with few of them shuffles nothing else."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "stored")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def read_documents(spark: SparkSession, path: str, schema: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON by schema, and a warning (file, text) for each text that is none; ValueError if there are texts and none is valid.

    Each line is a document; with ``whole`` each file is one, over as many lines as it likes, or a
    list of documents (files are then read in one piece, so they must be small).
    """
    if whole:
        files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()).withColumn("_json", F.try_parse_json("value"))
        items = F.transform(F.expr("try_cast(_json as array<variant>)"), lambda v: F.to_json(v))
        lines = files.select("file", F.explode(F.coalesce(items, F.array("value"))).alias("value")).where("trim(value) <> ''")
    else:
        lines = spark.read.text(path).where("trim(value) <> ''").withColumn("file", F.input_file_name())
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("file", "value", parsed.alias("x"))
    if not rows.isEmpty() and rows.where("x._corrupt_record is null").isEmpty():
        raise ValueError(f"no valid JSON document in {path}")
    return rows.where("x._corrupt_record is null").select("x.*", "file").drop("_corrupt_record"), rows.where("x._corrupt_record is not null").select("file", F.col("value").alias("text"))


def read_urls(lines: DataFrame) -> DataFrame:
    """Url entries (url, kind) out of lines that are a plain url, a JSON object or a JSON text; comments and blanks aside, each url once."""
    x = F.trim("value")
    kind = F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.type"))
    url = F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.url")).when(F.startswith(x, F.lit('"')), F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0]).otherwise(x)
    found = lines.where((x != "") & ~F.startswith(x, F.lit("#"))).select(F.trim(url).alias("url"), kind.alias("kind")).where("url is not null and url <> ''")
    return found.groupBy("url").agg(F.max("kind").alias("kind"))


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


class Conflict(RuntimeError):
    """Another writer changed the same files first; nothing of this change is seen."""


class Table:
    """A table of Parquet files under a folder, and a log of which files each version has.

    A change writes new files and then one log entry: the files that it adds and those that it
    takes out.  An entry is created only if no other writer has created one of that number, so of
    two writers one goes second: appends then take the next number, and so do changes whose files
    the first writer left alone; else it is a Conflict.  Readers see the files of one version, whole.

    An append writes its own rows only.  An upsert, delete or update finds by a scan of its key or
    condition columns which files hold rows to change, and rewrites these; files have ``most_rows``
    rows at most, so what a change of one row writes does not grow with the table.  Every tenth
    entry lists all files, so a reader reads ten entries at most.
    """

    FULL = 10

    def __init__(self, spark: SparkSession, path: str, most_rows: int = 1_000_000) -> None:
        self.spark, self.path, self.most_rows = spark, path.rstrip("/"), most_rows

    # The log.

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jpath, fs = self._fs(f"{self.path}/_log")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(jpath) if f.getPath().getName().endswith(".json")) if fs.exists(jpath) else []

    @property
    def version(self) -> int:
        return max(self.versions(), default=0)

    def _entry(self, version: int) -> dict:
        jpath, fs = self._fs(f"{self.path}/_log/{version:020d}.json")
        stream = fs.open(jpath)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def files(self, version: int | None = None) -> tuple[list[str], str | None]:
        """The files of a version (the last one), and the schema as JSON."""
        version = self.version if version is None else version
        entries, at = [], version
        while at > 0:
            entries.append(self._entry(at))
            if "all" in entries[-1]:
                break
            at -= 1
        held = dict.fromkeys(entries[-1]["all"] if entries and "all" in entries[-1] else [])
        for entry in reversed(entries):
            if "all" not in entry:
                for f in entry["remove"]:
                    held.pop(f, None)
                held |= dict.fromkeys(entry["add"])
        return list(held), entries[0]["schema"] if entries else None

    def _commit(self, seen: int, add: list[str], remove: list[str], schema: str) -> Table:
        while True:
            now = self.version
            for k in range(seen + 1, now + 1):
                if remove and (taken := set(self._entry(k)["remove"]) & set(remove)):
                    raise Conflict(f"version {k} has replaced {len(taken)} of the files that this change replaces")
            seen = now
            entry = {"add": add, "remove": remove, "schema": schema}
            if (now + 1) % self.FULL == 0:
                entry["all"] = [f for f in self.files(now)[0] if f not in set(remove)] + add
            # Written aside and then renamed: an entry is seen whole or not at all, and a rename never replaces one.
            aside, fs = self._fs(f"{self.path}/_log/{uuid.uuid4().hex}.tmp")
            stream = fs.create(aside, False)
            stream.write(bytearray(json.dumps(entry).encode()))
            stream.close()
            jpath, _ = self._fs(f"{self.path}/_log/{now + 1:020d}.json")
            if self._claim(fs, aside, jpath):
                return self

    def _claim(self, fs, aside, jpath) -> bool:
        """Whether the entry got its number; a marker that can be created only once decides."""
        marker, _ = self._fs(f"{jpath.toString()}.claim")
        try:
            fs.create(marker, False).close()
        except Exception as e:  # noqa: BLE001  (what says that the file is there differs between file systems)
            if not fs.exists(marker):
                raise
            fs.delete(aside, False)
            while not fs.exists(jpath):
                if time.time() * 1000 - fs.getFileStatus(marker).getModificationTime() > 60_000:
                    raise Conflict("a writer claimed the next version a minute ago and has not written it") from e
                time.sleep(0.05)
            return False
        fs.rename(aside, jpath)
        return True

    # Rows.

    def read(self, version: int | None = None) -> DataFrame:
        files, schema = self.files(version)
        if schema is None:
            raise FileNotFoundError(f"no table at {self.path}")
        kind = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/data/{f}" for f in files]) if files else self.spark.createDataFrame([], kind)

    def _written(self, rows: DataFrame) -> list[str]:
        folder = uuid.uuid4().hex
        rows.write.option("maxRecordsPerFile", self.most_rows).parquet(f"{self.path}/data/{folder}")
        jpath, fs = self._fs(f"{self.path}/data/{folder}")
        return [f"{folder}/{f.getPath().getName()}" for f in fs.listStatus(jpath) if f.getPath().getName().endswith(".parquet")]

    def create(self, rows: DataFrame) -> Table:
        return self._commit(self.version, self._written(rows), self.files()[0], rows.schema.json())

    def append(self, rows: DataFrame) -> Table:
        seen = self.version
        schema = self.read(seen).schema
        return self._commit(seen, self._written(rows.select(*schema.names)), [], schema.json())

    def _touched(self, seen: int, where: Column | None = None, keys: DataFrame | None = None) -> tuple[list[str], DataFrame]:
        """The files that hold rows of a condition or of keys, and their rows."""
        rows = self.read(seen)
        file = F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+/[^/]+)$", 1).alias("_file")
        if not self.files(seen)[0]:
            return [], rows
        if where is not None:
            found = rows.where(where).select(file)
        else:
            found = rows.select(*keys.columns, file).join(keys.distinct(), keys.columns, "left_semi").select("_file")
        names = [r["_file"] for r in found.distinct().collect()]  # names of files, never rows
        return names, self.spark.read.schema(rows.schema).parquet(*[f"{self.path}/data/{f}" for f in names]) if names else rows.limit(0)

    def upsert(self, rows: DataFrame, keys: list[str], order: str) -> Table:
        """Rows of a key replace the one that is there; of several the one of the largest ``order``.  Doing it twice changes nothing."""
        seen = self.version
        names, old = self._touched(seen, keys=rows.select(*keys))
        values = F.struct(*[c for c in rows.columns if c not in keys])
        newest = rows.groupBy(*keys).agg(F.max_by(values, order).alias("x")).select(*keys, "x.*").select(*rows.columns)
        kept = old.join(newest.select(*keys), keys, "left_anti").select(*rows.columns)
        return self._commit(seen, self._written(kept.unionByName(newest)), names, rows.schema.json())

    def delete(self, keys: DataFrame) -> Table:
        """Without the rows whose key columns are in ``keys``."""
        seen = self.version
        names, old = self._touched(seen, keys=keys)
        return self._commit(seen, self._written(old.join(keys.distinct(), keys.columns, "left_anti").select(*old.columns)) if names else [], names, old.schema.json())

    def update(self, where: Column, **values: Column) -> Table:
        seen = self.version
        names, old = self._touched(seen, where=F.coalesce(where, F.lit(False)))
        changed = old.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(old.schema[c].dataType) for c, v in values.items()})
        return self._commit(seen, self._written(changed) if names else [], names, old.schema.json())

    def vacuum(self, keep: int = 1) -> Table:
        """Delete the files that none of the last ``keep`` versions has."""
        last = self.version
        held = {f.split("/")[0] for k in range(max(1, last - keep + 1), last + 1) for f in self.files(k)[0]}
        jpath, fs = self._fs(f"{self.path}/data")
        for folder in fs.listStatus(jpath):
            if folder.getPath().getName() not in held:
                fs.delete(folder.getPath(), True)
        return self


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with header: lists joined by "; ", true and false as Yes and No, quotes doubled."""
    plain = {c: F.array_join(c, "; ") if kind.startswith("array") else F.when(F.col(c), "Yes").when(~F.col(c), "No") if kind == "boolean" else F.col(c) for c, kind in rows.dtypes}
    rows.select(*[v.alias(c) for c, v in plain.items()]).write.option("header", True).option("escape", '"').csv(path)
