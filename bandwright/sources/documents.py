"""Document sources: text folders, quotas, XML, nested JSON, HTML, chunks of articles, provenance."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwright.functions.text import strip
from bandwright.operators.windows import first_wins, last_wins, number_rows

#: Elements whose content is no text of the page; fixed values.
DROPPED = ("script", "style", "nav", "footer", "header", "noscript")
#: A heading of an article in a legal text; fixed value.
ARTICLE = r"(?m)^(?=Điều \d+\.)"


def scan(rows: DataFrame, least: int, most: int, n: int | None = None) -> DataFrame:
    """(name, text) in order of name: texts of at least ``least`` characters, cut at ``most``, the first ``n``."""
    kept = rows.select("name", "text").filter(F.length("text") >= least).withColumn("text", F.substring("text", 1, most)).orderBy("name")
    return kept if n is None else kept.limit(n)


def read_folder(spark: SparkSession, path: str, least: int, most: int, n: int | None = None) -> DataFrame:
    """``scan`` of the files of a folder."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return scan(rows, least, most, n)


def quota(rows: DataFrame, source: str, order: str, n: int, sources: int = 2, text: str = "text", least: int = 3000) -> DataFrame:
    """ceil(n / sources) rows of each source, in order, of texts that are long enough; ids get the source as prefix."""
    q = -(-n // sources)
    w = Window.partitionBy(source).orderBy(order)
    long = rows.filter(F.length(text) >= least)
    return long.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= q).drop("__r").withColumn("key", F.concat_ws("_", source, F.col(order).cast("string")))


def read_question_xml(spark: SparkSession, path: str, pairs: int = 3, least: int = 1500) -> DataFrame:
    """(focus, text) of Documents with enough question-answer pairs and text; files that don't parse are skipped."""
    schema = "Focus string, QAPairs struct<QAPair: array<struct<Question: string, Answer: string>>>"
    rows = spark.read.format("xml").option("rowTag", "Document").option("mode", "DROPMALFORMED").schema(schema).load(path)
    qa = F.col("QAPairs.QAPair")
    filled = F.filter(qa, lambda p: (F.coalesce(p["Question"], F.lit("")) != "") & (F.coalesce(p["Answer"], F.lit("")) != ""))
    text = F.concat_ws("\n\n", F.col("Focus"), F.concat_ws("\n\n", F.transform(filled, lambda p: F.concat_ws("\n", p["Question"], p["Answer"]))))
    return rows.filter(F.size(filled) >= pairs).select(F.col("Focus").alias("focus"), text.alias("text")).filter(F.length("text") >= least)


def until(parts: Column, most: int) -> Column:
    """The leading parts up to and including the one that takes their length over ``most``."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"))
    step = lambda s, p: F.when(s["n"] > most, s).otherwise(F.struct(F.concat(s["kept"], F.array(p)).alias("kept"), (s["n"] + F.length(p)).alias("n")))
    return F.aggregate(parts, start, step, lambda s: s["kept"])


def explode_archive(rows: DataFrame, entries: str, position: str) -> DataFrame:
    """(key, value, n) of map columns of several files: the later file's value of a key wins; keys are numbered in order, from 1."""
    each = rows.select(F.col(position).alias("__at"), F.explode(entries).alias("key", "value"))
    last = last_wins(each, ["key"], "__at").drop("__at")
    return number_rows(last, [F.col("key")], "n").withColumn("n", (F.col("n") + 1).cast("int"))


def read_archive(spark: SparkSession, path: str, value: str, suffix: str = ".json") -> DataFrame:
    """(archive, file, entries map<string, value>) of the JSON objects in tar archives, compressed or not; members that aren't JSON objects are skipped.

    A task reads one archive at a time and gives on a member at a time.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_buffer()), mode="r:*") as archive:
                    for m in archive:
                        if m.isfile() and m.name.endswith(suffix):
                            text = archive.extractfile(m).read().decode("utf-8", "replace")
                            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (name, m.name, text)], names=["archive", "file", "text"])

    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("archive"), "content")
    texts = files.mapInArrow(members, "archive string, file string, text string")
    return texts.select("archive", "file", F.from_json("text", f"map<string,{value}>").alias("entries")).filter("entries IS NOT NULL")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in DROPPED

    def handle_endtag(self, tag):
        if tag in DROPPED and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and (t := data.strip()):
            self.parts.append(t)


def html_to_text(c: Column) -> Column:
    """The text of a page: contents of dropped elements left out (nesting counted), parts stripped and joined by newlines, three or more newlines as two."""

    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        import re

        def one(page):
            if page is None:
                return None
            parser = _Text()
            parser.feed(page)
            parser.close()
            return re.sub(r"\n{3,}", "\n\n", "\n".join(parser.parts))

        return pages.map(one, na_action="ignore")

    return convert(c)


def chunks(rows: DataFrame, key: str, title: str, text: str, heading: str = ARTICLE, per: int = 3, least: int = 800, articles: int = 5) -> DataFrame:
    """(key, chunk, text): a text is split before each heading, ``per`` articles a chunk, the title before each; documents of
    fewer articles and chunks shorter than ``least`` are left out."""
    parts = F.filter(F.split(text, heading), lambda p: p.rlike(heading.replace("^(?=", "(?:^)(?=")))
    each = rows.withColumn("__parts", parts).filter(F.size("__parts") >= articles).select(key, title, F.posexplode("__parts").alias("__pos", "__part"))
    grouped = each.groupBy(key, title, F.floor(F.col("__pos") / per).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("__pos", "__part"))).alias("__p"))
    body = F.concat_ws("", F.transform("__p", lambda p: p["__part"]))
    return grouped.select(key, "chunk", F.concat_ws("\n\n", title, strip(body)).alias("text")).filter(F.length("text") >= least)


def questions(rows: DataFrame, position: str, columns: tuple[str, ...] = ("question", "q1", "text", "variation"), second: str | None = "q2") -> DataFrame:
    """(position, question): the first non-empty of the columns that exist, and the second question, each text once where it comes first."""
    there = [c for c in columns if c in rows.columns]
    first = F.coalesce(*[F.nullif(strip(F.col(c)), F.lit("")) for c in there])
    more = [F.nullif(strip(F.col(second)), F.lit(""))] if second and second in rows.columns else []
    each = rows.select(F.col(position).alias("position"), F.posexplode(F.array(first, *more)).alias("k", "question")).filter("question IS NOT NULL")
    return first_wins(each, ["question"], [F.col("position"), F.col("k")]).select("position", "question")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``questions`` of a file whose lines are JSON records or plain questions; a broken record is skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), strip(F.col("value")).alias("value")).filter("value <> ''")
    record = F.from_json("value", "question string, q1 string, text string, variation string, q2 string")
    plain = ~F.startswith(F.col("value"), F.lit("{"))
    rows = lines.withColumn("r", record).select("line", F.when(plain, F.col("value")).otherwise(F.col("r.question")).alias("question"), "r.q1", "r.text", "r.variation", "r.q2")
    return questions(rows, "line")


def numbered(files: DataFrame, license_: str) -> DataFrame:
    """(n, file, license, retrieved) of (path, retrieved), numbered from 1 in order of path."""
    rows = number_rows(files.select("path", "retrieved"), [F.col("path")], "n")
    return rows.select((F.col("n") + 1).cast("int").alias("n"), F.substring_index("path", "/", -1).alias("file"), F.lit(license_).alias("license"), "retrieved")


def provenance(spark: SparkSession, path: str, license_: str) -> DataFrame:
    """``numbered`` files of a folder."""
    return numbered(spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("retrieved")), license_)


def read_sheet(spark: SparkSession, path: str, key: str, label: str, allowed: tuple[str, ...]) -> DataFrame:
    """(gid, label) of an annotator's CSV sheet (header, byte order mark or none); ValueError if any row has no key or a label that isn't allowed."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    clean = [c.lstrip("﻿").strip() for c in rows.columns]
    rows = rows.toDF(*clean).select(strip(F.col(f"`{key}`")).alias("gid"), F.upper(strip(F.col(f"`{label}`"))).alias("label"))
    bad = rows.filter(F.coalesce("gid", F.lit("")) == "").count() + rows.filter(~F.coalesce(F.col("label").isin(*allowed), F.lit(False))).count()
    if bad:
        raise ValueError(f"{bad} rows without a key or an allowed label")
    return rows


def read_dimension(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A small YAML list of records under ``key`` as a table; needs the yaml library."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame(pd.DataFrame(yaml.safe_load(f)[key]))
