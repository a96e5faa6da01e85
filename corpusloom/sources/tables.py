"""Sources and sinks: corpora of files, records of several shapes, a versioned vector index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import rendering


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """source_file, text: a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return text_corpus(spark, path).select("source_file", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def chunk_records(spark: SparkSession, path: str) -> DataFrame:
    """text, variation_type of a JSON array; older records have is_varied instead."""
    raw = spark.read.schema("text string, variation_type string, is_varied boolean").option("multiLine", True).json(path)
    return raw.select("text", F.coalesce("variation_type", F.when(F.col("is_varied"), "varied").otherwise("original")).alias("variation_type"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one line each; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def selected_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraph rows of a selection file."""
    raw = spark.read.schema("metadata map<string,string>, paragraphs array<struct<text:string,quality_score:double,cluster_id:int,tokens:int>>").option("multiLine", True).json(path)
    return raw.select(F.inline("paragraphs"))


def training_record(raw: DataFrame) -> DataFrame:
    """neutral, styled of chat messages, instruction records or input and output pairs; rows of no known shape go."""
    said = lambda role: F.element_at(F.filter("messages", lambda m: m["role"] == role), -1)["content"]
    have = set(raw.columns)
    pick = lambda role, *names: F.coalesce(*([said(role)] if "messages" in have else []), *(F.col(n) for n in names if n in have), F.lit(None).cast("string"))
    return raw.select(pick("user", "input", "prompt", "neutral").alias("neutral"), pick("assistant", "output", "completion", "styled").alias("styled")).where("neutral is not null and styled is not null")


def write_text(paragraphs: DataFrame, path: str, by: str, order: str = "para_idx") -> None:
    """A file of paragraphs, a blank line between two, for each group."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "\n\n")
    paragraphs.groupBy(by).agg(whole.alias("value")).select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """name, template of the .txt files of a folder; `rendering.filled` fills them."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt\z", "").alias("name"), F.col("value").alias("template"))


def personas(spark: SparkSession, path: str) -> DataFrame:
    """name, section, idx, frame of the persona files of a folder."""
    return prompts(spark, path).select("name", F.inline(rendering.frames(F.col("template"))))


#: Paragraphs of a built-in sample, on everyday matters.
SAMPLES = (
    "The baker opens at five. By six the street smells of bread, and by seven the first loaves are gone.",
    "A bicycle has two wheels and one good idea. Everything else on it keeps the idea from falling over.",
    "When the river froze, the ferry stopped. People walked across instead, slowly, with their hands out.",
    "She kept a list of every bird she saw. It had four hundred names on it, and one question mark.",
    "Rain fell on the roof all night. In the morning the bucket under the leak was full, and the cat was dry.",
)


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLES)), "para_idx int, text string")


def write_selection(rows: DataFrame, path: str, score: str = "quality_score") -> None:
    """Selected paragraphs as JSON records, scores rounded to three places, half to even."""
    rows.withColumn(score, F.bround(F.col(score).cast("decimal(30,15)"), 3).cast("double")).write.mode("overwrite").json(path)


def replaced(spark: SparkSession, rows: DataFrame, path: str, backup: str | None = None, kind: str = "json") -> None:
    """Writes rows in the place of what is at the path: to a new folder first, which then takes the old one's name. The old
    one stays under `backup`, if one is named. What fails before the end leaves the old one."""
    jvm = spark.sparkContext._jvm
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    rows.write.format(kind).save(new)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = backup or f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved to {old}")
    if not fs.rename(at(new), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"{new} can't be moved to {path}")
    if had and backup is None:
        fs.delete(at(old), True)


def write_json(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


class VectorIndex:
    """Rows with an id in a folder, partitioned by author; each change is a new version, and a pointer names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, author: str | None = None) -> DataFrame | None:
        try:
            at = self.spark.read.text(f"{self.path}/current").first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        rows = self.spark.read.parquet(at[0])
        return rows if author is None else rows.where(F.col("author") == author)

    def write(self, rows: DataFrame) -> None:
        version = f"{self.path}/version-{uuid.uuid4().hex}"
        rows.write.partitionBy("author").parquet(version)
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")

    def upsert(self, new: DataFrame) -> None:
        old = self.read()
        self.write(new if old is None else old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True))

    def delete(self, author: str) -> int:
        rows = self.read()
        n = 0 if rows is None else rows.where(F.col("author") == author).count()
        if n:
            self.write(rows.where(F.col("author") != author))
        return n

    def fill(self, column: str, values: DataFrame) -> None:
        """Values (id, column) for the rows that lack one."""
        rows, new = self.read(), values.select("id", F.col(column).alias("new_value"))
        self.write(rows.join(new, "id", "left").withColumn(column, F.coalesce(column, "new_value")).drop("new_value"))
