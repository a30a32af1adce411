"""Gradebooks, rubrics and submissions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.text import Rule, replace_all
from arbora.storage import numbered

# What a submission's archive keeps as text, as it is, and skips; and rows of a gradebook that name no one.
TEXT_KINDS, VERBATIM_KINDS, SKIPPED = (".pde", ".java", ".xml"), (".jar",), "__MACOSX"
NO_STUDENT = ("student", "points possible", "student, test")


def read_gradebook(spark: SparkSession, path: str) -> DataFrame:
    """``name`` ("Last, First"), ``user_id`` and ``student_number`` of each student; rows that name none, whatever their case, are left out."""
    rows = spark.read.csv(path, header=False).select(F.trim("_c0").alias("name"), F.trim("_c1").alias("user_id"), F.trim("_c2").alias("student_number"))
    return rows.filter(F.col("name").isNotNull() & (F.col("name") != "") & ~F.lower("name").isin(*NO_STUDENT))


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """A row per submission: ``assignment``, ``course``, ``attachments`` (ids), ``score`` and ``assessments`` (JSON)."""
    schema = "data struct<assignment: struct<name: string, course: struct<name: string>, submissionsConnection: struct<nodes: array<struct<attachments: array<struct<_id: string>>, score: double, rubricAssessmentsConnection: string>>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("data.assignment.*").select(F.col("name").alias("assignment"), F.col("course.name").alias("course"), F.explode("submissionsConnection.nodes").alias("s"))
    return rows.select("assignment", "course", F.transform("s.attachments", lambda a: a["_id"]).alias("attachments"), "s.score", F.col("s.rubricAssessmentsConnection").alias("assessments"))


def rubric_lookup(submissions: DataFrame, rubric: DataFrame) -> DataFrame:
    """``submissions`` (with ``attachment_id``) and ``assessment``: score and assessments of the rubric's rows that list the attachment, none if no row does."""
    rows = rubric.select(F.explode("attachments").alias("attachment_id"), F.struct("score", "assessments").alias("a")).distinct()
    found = rows.groupBy("attachment_id").agg(F.array_sort(F.collect_list("a")).alias("assessment"))
    return submissions.join(found, "attachment_id", "left").withColumn("assessment", F.coalesce("assessment", F.array().cast(found.schema["assessment"].dataType)))


def shuffled_ids(submissions: DataFrame, key: str, seed: int = 0, width: int = 3) -> DataFrame:
    """``submissions`` with ``new_id``: gapless numbers from 0 in an order that a hash of ``seed`` and ``key`` decides, with leading zeros to ``width`` digits at least."""
    rows = numbered(submissions.withColumn("__order", F.xxhash64(F.lit(seed), key)), "__order", key, name="__number", label="shuffled-ids")
    text = F.col("__number").cast("string")
    return rows.withColumn("new_id", F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)).drop("__order", "__number")


def cleaned(members: DataFrame, ids: DataFrame, rules: list[Rule]) -> DataFrame:
    """``new_id``, ``path`` and ``content`` of the members of archives: paths and texts through ``rules``, other contents as they are; errors are left out.

    ``members`` as ``read_archives`` gives them; ``ids``: ``archive`` and ``new_id``.
    """
    text = F.when(F.col("kind") == "text", replace_all(F.decode("content", "UTF-8"), rules).cast("binary")).otherwise(F.col("content"))
    return members.filter("kind <> 'error'").join(ids.select("archive", "new_id"), "archive").select("new_id", replace_all(F.col("path"), rules).alias("path"), text.alias("content"))


def assessed(submissions: DataFrame, column: str = "assessment") -> DataFrame:
    """Submissions whose assessment (an array of structs with ``rubrics``) is not empty and begins with one that has rubrics."""
    return submissions.filter((F.size(column) > 0) & (F.size(F.get(column, F.lit(0))["rubrics"]) > 0))


def archive_members(name: str, content: bytes, depth: int = 8) -> Iterator[tuple[str, str, bytes | None, str | None]]:
    """(path, kind, content, error) of what an archive keeps, archives within it included; a broken part and an archive nested over ``depth`` deep is an error row and stops nothing else."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                path = f"{name}/{info.filename}"
                lower = info.filename.lower()
                if info.is_dir() or SKIPPED in info.filename.split("/"):
                    continue
                try:
                    if lower.endswith(".zip") and depth:
                        yield from archive_members(path, z.read(info), depth - 1)
                    elif lower.endswith(".zip"):
                        yield path, "error", None, "archives are nested too deep"
                    elif lower.endswith(TEXT_KINDS):
                        yield path, "text", z.read(info), None
                    elif lower.endswith(VERBATIM_KINDS):
                        yield path, "verbatim", z.read(info), None
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError) as e:
                    yield path, "error", None, str(e)
    except (zipfile.BadZipFile, OSError) as e:
        yield name, "error", None, str(e)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``archive``, ``path``, ``kind``, ``content`` and ``error`` of the members of all zip files under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                rows = list(archive_members(archive.rsplit("/", 1)[-1], content))
                yield pd.DataFrame([(archive, *r) for r in rows], columns=["archive", "path", "kind", "content", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "archive string, path string, kind string, content binary, error string")


def submission_names(files: DataFrame, column: str = "file") -> DataFrame:
    """``student``, ``late``, ``user_id``, ``attachment_id`` and ``file_name`` from ``name_[LATE_]user_attachment_file``."""
    part = F.split(column, "_")
    late = F.get(part, F.lit(1)) == "LATE"
    at = lambda i: F.get(part, F.when(late, i + 1).otherwise(i))
    rest = F.array_join(F.slice(part, F.when(late, 5).otherwise(4), F.size(part)), "_")
    return files.select("*", F.get(part, F.lit(0)).alias("student"), late.alias("late"), at(1).alias("user_id"), at(2).alias("attachment_id"), rest.alias("file_name"))


def sketch_main(files: DataFrame) -> DataFrame:
    """Per ``folder`` the first ``path`` of a sketch with lines that declare both ``setup`` and ``draw``; ``sketch`` is the folder's name, or a fixed one if that is over 30 characters."""
    both = F.col("value").rlike(r"(?m)^\s*void\s+setup\s*\(\s*\)") & F.col("value").rlike(r"(?m)^\s*void\s+draw\s*\(\s*\)")
    found = files.filter(F.endswith("path", F.lit(".pde")) & both).withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    name = F.element_at(F.split("folder", "/"), -1)
    return found.groupBy("folder").agg(F.min("path").alias("path")).withColumn("sketch", F.when(F.length(name) > 30, "EndAssignment").otherwise(name))
