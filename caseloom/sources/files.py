"""Readers of case files, manifests, stored runs and raw corpora; all distributed, with explicit schemas."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse
from . import schemas


def _json(spark: SparkSession, root: str, schema: str, glob: str) -> DataFrame:
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return read.json(root).withColumn("file_path", F.col("_metadata.file_path"))


def public_cases(spark: SparkSession, root: str) -> DataFrame:
    """All *.public.json below root, with file_path. Files that are no JSON give a row of NULLs, which `case_problems` names."""
    return _json(spark, root, schemas.PUBLIC_CASE, "*.public.json")


def private_cases(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, schemas.PRIVATE_CASE, "*.private.json")


def _part(path: Column, place: int) -> Column:
    return F.element_at(F.split(path, "/"), place)


def case_problems(public: DataFrame, private: DataFrame) -> DataFrame:
    """file_path, problem: case files that must not be run. A case's id is its file's name, its suite the folder above the
    folder of the cases; ids are unique; both halves are there; graders are listed."""
    stem = F.regexp_replace(_part(F.col("file_path"), -1), r"\.(public|private)\.json\z", "")
    first = public.select(
        "file_path",
        F.when(F.col("id").isNull(), "not a case").when(F.col("id") != stem, "id is not the file's name").when(F.col("suite") != _part(F.col("file_path"), -3), "suite is not the folder's").alias("problem"),
    )
    twice = public.groupBy("id").agg(F.min("file_path").alias("file_path"), F.count("*").alias("n")).where("n > 1").select("file_path", F.lit("id is not unique").alias("problem"))
    lone = public.join(private.select("id"), "id", "left_anti").select("file_path", F.lit("no private half").alias("problem"))
    orphan = private.join(public.select("id"), "id", "left_anti").select("file_path", F.lit("no public half").alias("problem"))
    bare = private.where("coalesce(size(graders), -1) < 1").select("file_path", F.lit("no graders").alias("problem"))
    return first.where("problem is not null").unionByName(twice).unionByName(lone).unionByName(orphan).unionByName(bare)


def load_cases(spark: SparkSession, root: str) -> DataFrame:
    """Public and private halves joined; an error names the first files that are wrong."""
    pub, priv = public_cases(spark, root), private_cases(spark, root)
    wrong = case_problems(pub, priv).orderBy("file_path").limit(20).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.file_path}: {r.problem}" for r in wrong))
    return pub.drop("file_path").join(priv.drop("file_path"), "id")


def harnesses(spark: SparkSession, root: str, image: str = "bench-sandbox", entry: str = "dist/entry.js") -> DataFrame:
    """Harness manifests with their defaults and folders; a row per harness.json."""
    h = _json(spark, root, schemas.HARNESS, "harness.json")
    return h.withColumns({"dir": F.regexp_replace("file_path", "/harness.json$", ""), "image": F.coalesce("image", F.lit(image)), "imageEntry": F.coalesce("imageEntry", F.lit(entry))}).drop("file_path")


def harness_problems(h: DataFrame) -> DataFrame:
    """name, problem: manifests without name, entry, suites or main model, or with a provider for a model they don't use."""
    main = F.try_element_at("models", F.lit("main"))
    stray = F.size(F.array_except(F.map_keys("providers"), F.map_values("models"))) > 0
    problem = F.when(F.col("name").isNull(), "no name").when(F.col("entry").isNull(), "no entry").when(F.col("suites").isNull(), "no suites").when(main.isNull(), "no main model").when(F.col("providers").isNotNull() & stray, "provider of no model")
    return h.select("name", problem.alias("problem")).where("problem is not null")


def benchmarks(spark: SparkSession, root: str) -> DataFrame:
    return _json(spark, root, schemas.BENCHMARK, "benchmark.json").withColumn("dir", F.regexp_replace("file_path", "/benchmark.json$", "")).drop("file_path")


def stored_runs(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of one or more stored runs (JSON lines), with the file they came from. Lines that are no records are dropped;
    members that old records lack are NULL."""
    r = spark.read.schema(f"{schemas.RECORD}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(list(paths))
    return r.withColumn("file_path", F.col("_metadata.file_path")).where("_corrupt is null and run is not null").drop("_corrupt")


def contracts(spark: SparkSession, path: str) -> DataFrame:
    """title, context, qas array<struct<category, details, answers>> from a nested contract corpus: one row a contract."""
    c = spark.read.schema(schemas.CONTRACTS).option("multiLine", True).json(path).select(F.explode("data").alias("c"))
    first = F.get("c.paragraphs", 0)
    qas = F.transform(first.getField("qas"), lambda q: F.struct(F.element_at(F.split(q["id"], "__"), -1).alias("category"), F.regexp_replace(q["question"], r"(?s)^.*?Details: ", "").alias("details"), q["answers"].alias("answers")))
    return c.select("c.title", first.getField("context").alias("context"), qas.alias("qas"))


def _colons(ddl: str) -> str:
    """A schema's columns as the fields of a struct."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def retrieval(spark: SparkSession, path: str, passages: int) -> DataFrame:
    """question, docs (the first `passages`), qaPairs from a retrieval corpus (a JSON array a file), and the file's path and
    `place`, the item's place in it from 0. A file's array is read as one value and unfolded, so the place is the file's."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file_path"), F.from_json("value", f"array<struct<{_colons(schemas.RETRIEVAL)}>>").alias("items"))
    r = whole.select("file_path", F.posexplode("items").alias("place", "item")).select("file_path", "place", "item.*")
    pairs = F.transform("qa_pairs", lambda p: F.struct(p["question"].alias("question"), p["short_answers"].alias("shortAnswers")))
    docs = F.transform(F.slice("docs", 1, passages), lambda d: F.struct(collapse(d["title"]).alias("title"), d["text"].alias("text")))
    return r.select("file_path", "place", "question", docs.alias("docs"), pairs.alias("qaPairs"))


def checked_binary(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The files at path as binary rows; an error if a file's digest isn't the one expected."""
    b = spark.read.format("binaryFile").load(path)
    wrong = b.where(F.sha2("content", 256) != sha256).select("path").limit(5).collect()
    if wrong:
        raise ValueError("unexpected digest: " + ", ".join(r.path for r in wrong))
    return b


def subdirectories(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders in root, sorted; works on any file system Spark reads."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(sc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def setting(name: str, default: str | None = None) -> str | None:
    """An environment variable; a blank one counts as unset."""
    value = (os.environ.get(name) or "").strip()
    return value or default


def secret(name: str | None) -> str:
    """The secret in a named variable, for the driver only; missing or blank is an error that doesn't tell its value."""
    value = setting(name) if name else None
    if value is None:
        raise KeyError(f"environment variable {name} is not set")
    return value


def code_state(folder: str = ".") -> tuple[str | None, list[str]]:
    """The commit checked out and the files that differ from it; (None, []) outside a repository."""

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
        return done.stdout if done.returncode == 0 else None

    rev, status = git("rev-parse", "HEAD"), git("status", "--porcelain")
    return (rev.strip() if rev else None), [line[3:] for line in (status or "").splitlines()]


@dataclass
class Project:
    """A project's folders as tables: harness and benchmark manifests, the halves of its cases, and what is wrong with them."""

    systems: DataFrame
    benchmarks: DataFrame
    public: DataFrame
    private: DataFrame
    problems: DataFrame


def project(spark: SparkSession, root: str) -> Project:
    """A project from its folder: harnesses below `harnesses`, benchmarks and their cases below `benchmarks`. problems: what,
    problem; wrong case files, wrong harness manifests, and suites that systems list but no benchmark has."""
    systems, marks = harnesses(spark, f"{root}/harnesses"), benchmarks(spark, f"{root}/benchmarks")
    public, private = public_cases(spark, f"{root}/benchmarks"), private_cases(spark, f"{root}/benchmarks")
    wrong = case_problems(public, private).select(F.col("file_path").alias("what"), "problem")
    lone = harness_problems(systems).withColumnRenamed("name", "what")
    listed = systems.select(F.col("name").alias("what"), F.explode("suites").alias("suite"))
    lost = listed.join(marks.select(F.col("name").alias("suite")), "suite", "left_anti").select("what", F.concat(F.lit("unknown suite "), "suite").alias("problem"))
    return Project(systems, marks, public, private, wrong.unionByName(lone).unionByName(lost))
