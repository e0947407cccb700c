"""Readers and writers: collections, taxonomies, rule tables, inboxes, message archives, repositories and pages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.schema import INBOX, RECORD, STARRED_REPO, Taxonomy


def load_store(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(RECORD).option("multiLine", True).json(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_store(records: DataFrame, path: str, one_file: bool = False) -> DataFrame:
    """Sorted by id, staged beside the target and swapped in, so the path being read may be the one that is written.

    Parquet by default, range-sorted over as many files as needed; one_file writes JSON for exchange.
    """
    spark = records.sparkSession
    staged = f"{path.rstrip('/')}._staged"
    out = records.select(*RECORD.fieldNames()).orderBy("id")
    if one_file:
        out.coalesce(1).write.mode("overwrite").json(staged)
    else:
        out.write.mode("overwrite").parquet(staged)
    fs, target = _fs(spark, path)
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(_fs(spark, staged)[1], target)
    return spark.read.schema(RECORD).json(path) if one_file else spark.read.schema(RECORD).parquet(path)


def load_taxonomy(spark: SparkSession, path: str) -> Taxonomy:
    """Groups and limits of a taxonomy document; missing limits take their defaults."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    doc = json.loads(text)
    limits = doc.get("limits") or {}
    return Taxonomy(list(doc["groups"]), limits.get("maxGroups", 3), limits.get("maxTags", 8), limits.get("maxDescriptionChars", 160))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """signal and grp from a JSON object of group to signals."""
    schema = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", schema)).alias("grp", "signals"))
    return rows.select(F.explode("signals").alias("signal"), "grp")


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of links with their order; fails where it is absent or not readable as one."""
    rows = spark.read.schema(INBOX).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("_ord", F.monotonically_increasing_id())


_MESSAGE = "array<struct<text:string,ts:string,attachments:array<struct<title_link:string,from_url:string,text:string>>>>"


def read_export(spark: SparkSession, directory: str) -> DataFrame:
    """Messages of an export tree: JSON arrays in any depth; other and broken files are skipped; the channel is the folder's name."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(directory)
    path = F.col("_metadata.file_path")
    own = files.select(path.alias("path"), F.col("value")).where(F.ltrim("value").startswith("["))
    messages = own.select("path", F.posexplode(F.from_json("value", _MESSAGE)).alias("pos", "m"))
    channel = F.try_url_decode(F.element_at(F.split("path", "/"), -2))
    return messages.where("m IS NOT NULL").select("m.text", "m.ts", "m.attachments", channel.alias("channel"), F.struct("path", "pos").alias("_ord"))


def read_starred(spark: SparkSession, path: str) -> DataFrame:
    """Starred repositories, one JSON object a line; blank lines are dropped."""
    return spark.read.schema(STARRED_REPO).json(path).where("full_name IS NOT NULL OR html_url IS NOT NULL")


class Conflict(RuntimeError):
    """Another version was committed between read and write."""


class VersionedStore:
    """A record table with numbered versions: each is a folder, and creating its marker file, which fails if it exists, commits it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        fs, root = _fs(self.spark, self.path)
        if not fs.exists(root):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(root)]
        return max([0, *(int(n.removeprefix("commit-")) for n in names if n.startswith("commit-"))])

    def _data(self, version: int) -> str:
        fs, marker = _fs(self.spark, f"{self.path}/commit-{version}")
        stream = fs.open(marker)
        try:
            return f"{self.path}/{stream.readUTF()}"
        finally:
            stream.close()

    def read(self) -> tuple[int, DataFrame]:
        v = self.version()
        return v, self.spark.read.schema(RECORD).parquet(self._data(v)) if v else self.spark.createDataFrame([], RECORD)

    def write(self, records: DataFrame, expected: int) -> int:
        """Commits the version after ``expected``, or raises Conflict."""
        import uuid

        name = f"data-{uuid.uuid4().hex}"
        records.select(*RECORD.fieldNames()).orderBy("id").write.parquet(f"{self.path}/{name}")
        fs, marker = _fs(self.spark, f"{self.path}/commit-{expected + 1}")
        try:
            if self.version() != expected:
                raise Conflict(f"version {expected} is no longer the last")
            stream = fs.create(marker, False)
        except Exception as e:
            fs.delete(_fs(self.spark, f"{self.path}/{name}")[1], True)
            raise e if isinstance(e, Conflict) else Conflict(str(e)[:200]) from e
        stream.writeUTF(name)
        stream.close()
        return expected + 1
