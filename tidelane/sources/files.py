"""Scans and sinks of datasets, manifests, results and logs."""

from __future__ import annotations

import json
import time
import tomllib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.operators.curation import unique_keys
from tidelane.operators.sequences import borders, seeded_hash


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines. With a schema, a line that doesn't fit it is an error (or a row of
    nulls, if not strict); without one, the schema is inferred. Blank lines are skipped."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line) of the lines that don't fit the schema."""
    bad = f"{schema}, broken_ STRING"
    parsed = F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken_"})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.input_file_name().alias("file"), F.col("value").alias("line"), parsed.alias("p"))
    return rows.filter("p.broken_ IS NOT NULL").select("file", "line")


def dataset(spark: SparkSession, *paths: str, sample: int | None = None, seed: int | None = None, key: str | None = None) -> DataFrame:
    """Parquet, JSON or JSONL files as one frame. `sample` rows are the first by key, or with
    a seed the first by a seeded hash of it: an exact number, though keys be repeated."""
    parts = [spark.read.parquet(p) if p.endswith(".parquet") else spark.read.option("multiLine", p.endswith(".json")).json(p) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if sample is None:
        return out
    if key is None:
        raise ValueError("an exact sample needs a key to order by")
    if seed is None:
        return out.orderBy(key).limit(sample)
    hashed = out.withColumn("hash_", seeded_hash(key, seed))
    border = borders(hashed, [sample]).first()[0][0]
    below = hashed.filter(F.col("hash_") < border)
    return below.union(hashed.filter(F.col("hash_") == border).limit(max(0, sample - below.count()))).drop("hash_")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Simulations of a results file (one JSON document) or folder (a document per simulation)."""
    docs = spark.read.option("multiLine", True).json(path)
    return docs.select(F.explode("simulations").alias("s")).select("s.*") if "simulations" in docs.columns else docs


def keyed_document(spark: SparkSession, path: str, name: str, value: str) -> DataFrame:
    """A document's table, a map from id to record of the given schema, as rows with their id."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"{name} MAP<STRING, STRUCT<{value}>>")[name]).alias("id", "r")).select("id", "r.*")


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def tree_hash(hashes: DataFrame) -> DataFrame:
    """One hash of a folder: of its files' hashes in the order of their paths."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256")))
    return hashes.agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("sha256"))


def inside(path: Column) -> Column:
    """Whether a path from data stays below its root: relative, and never above its start."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), (a["ok"] & (a["d"] + F.when(p == "..", -1).otherwise(1) >= 0)).alias("ok")))
    return ~path.startswith("/") & depth["ok"]


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "kind", value: str = "text") -> DataFrame:
    """Preference pairs to rows."""
    return df.unpivot(ids, values, name, value)


def canonical_json(df: DataFrame) -> Column:
    """All columns as one JSON text with keys in alphabetical order at each level."""

    def ordered(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*(ordered(col[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: ordered(x, kind.elementType))
        return col

    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*(ordered(F.col(f.name), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, replace: bool = False) -> None:
    """Canonical JSON lines; a path that exists is an error unless it is to be replaced."""
    df.select(canonical_json(df).alias("value")).write.mode("overwrite" if replace else "errorifexists").text(path)


def write_splits(df: DataFrame, path: str, split: str = "split", key: str = "task_id") -> None:
    """Parquet by split, and beside it one row per split with its size and a hash of its keys."""
    df.write.mode("errorifexists").partitionBy(split).parquet(f"{path}/data")
    keyed = df.groupBy(split).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key)).alias("keys_hash"))
    keyed.write.mode("errorifexists").json(f"{path}/manifest")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def next_step(log: DataFrame, rows: DataFrame, step: str = "step", order: str | None = None) -> DataFrame:
    """The rows whose step is beyond all that the log has, one of each step: the one with the least `order`, or without one the row that
    comes first as JSON text. Where a row stands in its partition says nothing. Rows without a step are left out."""
    done = log.agg(F.max(step).alias("done_"))
    rank = F.to_json(F.struct(*(F.col(c) for c in rows.columns)))
    w = Window.partitionBy(step).orderBy(*([order] if order else []), rank)
    beyond = F.col(step).isNotNull() & (F.col("done_").isNull() | (F.col(step) > F.col("done_")))
    return rows.crossJoin(F.broadcast(done)).filter(beyond).drop("done_").withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def manifest(spark: SparkSession, path: str, key: str = "task_id", schema: str = "task_id STRING, split STRING, task_hash STRING") -> DataFrame:
    """A manifest's entries: JSON lines of a schema; an entry without a key, or one that is there twice, is an error where it is read."""
    return unique_keys(jsonl(spark, path, schema), key)


def stream_results(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """A folder of result documents as a stream of at most `per_batch` files a step, so that memory is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("multiLine", True).json(path)


def results_metadata(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The named top-level fields of results files alone: simulations are never parsed."""
    return spark.read.schema(fields).option("multiLine", True).json(path)


def evaluation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(run, trajectories, errors, hashes of the files) of an evaluation's folder; one without errors has no such file."""
    hashes = content_hashes(spark, folder)
    names = [r[0] for r in hashes.select(F.element_at(F.split("path", "/"), -1)).distinct().collect()]  # a handful of fixed names
    missing = {"run.json", "trajectories.jsonl"} - set(names)
    if missing:
        raise ValueError(f"not an evaluation: without {sorted(missing)}")
    trajectories = spark.read.json(f"{folder}/trajectories.jsonl")
    errors = spark.read.json(f"{folder}/errors.jsonl") if "errors.jsonl" in names else spark.createDataFrame([], "task_id STRING, trial LONG, error STRING")
    return spark.read.option("multiLine", True).json(f"{folder}/run.json"), trajectories, errors, hashes


def toml_document(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, key, value): the leaves of TOML files, values as JSON text."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(value: object, at: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
            if isinstance(value, dict):
                for k, v in value.items():
                    yield from walk(v, (*at, k))
            else:
                yield "/".join(at[:-1]), at[-1], json.dumps(value, default=str)

        for batch in batches:
            for file, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = list(walk(tomllib.loads(text.decode()), ()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), *(pa.array(c) for c in zip(*rows))], ["path", "section", "key", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(leaves, "path string, section string, key string, value string")


def knowledge_base(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, title, text) of a folder's documents. A JSON file is an object with id, title and content, all of them
    texts; one that lacks any is an error, and of files with one id the greatest name holds. Markdown and text files, in
    folders below too, have their name as id, and the first heading, or else the name, as title. A folder without such files has no documents."""
    kind = "id string, title string, content string"
    json = spark.read.schema(kind).option("mode", "FAILFAST").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    path = F.col("_metadata.file_path")
    lacks = F.raise_error(F.concat(F.lit("no id, title or content: "), path)).cast(kind.join(("struct<", ">")).replace(" string", ":string"))
    told = json.select(F.when(F.col("id").isNull() | F.col("title").isNull() | F.col("content").isNull(), lacks).otherwise(F.struct("id", "title", "content")).alias("x"), path.alias("path"))
    told = told.groupBy("x.id").agg(F.max_by("x", "path").alias("x")).select(F.col("id").alias("doc_id"), "x.title", F.col("x.content").alias("text"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(folder)
    text = F.decode("content", "UTF-8")
    name = F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1)
    title = F.regexp_extract(text, r"(?m)^#+[ \t]+(.+?)[ \t]*$", 1)
    return told.union(files.select(name.alias("doc_id"), F.when(title != "", title).otherwise(name).alias("title"), text.alias("text")))


def leaderboard(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(submission, fields of the schema) of submission.json files, each in its own folder; one that isn't JSON is an error."""
    files = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "submission.json").json(folder)
    return files.withColumn("submission", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def unified(df: DataFrame, source: str, question: str, answer: str, instruction: str = "", split: str = "train", row: str | None = None) -> DataFrame:
    """Question and answer rows as training rows: data_source, prompt (messages), ability, ground_truth (the number after ####, or the
    answer), split and index."""
    truth = F.regexp_replace(F.regexp_extract(answer, r"#### (-?[0-9.,]+)", 1), ",", "")
    said = F.concat_ws(" ", F.col(question), F.lit(instruction)) if instruction else F.col(question)
    return df.select(
        F.lit(source).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), said.alias("content"))).alias("prompt"), F.lit("math").alias("ability"), F.when(truth != "", truth).otherwise(F.trim(answer)).alias("ground_truth"), F.lit(split).alias("split"), (F.col(row) if row else F.lit(None)).cast("long").alias("index")
    )


def write_parquet(df: DataFrame, path: str, *partitions: str, replace: bool = False) -> None:
    df.write.mode("overwrite" if replace else "errorifexists").partitionBy(*partitions).parquet(path)


def replace_state(df: DataFrame, path: str) -> str:
    """Writes a small state as JSON under a new version; readers follow the last version that is whole (see read_state), so that
    none sees a part of one."""
    version = f"{path}/v={time.time_ns():020d}-{uuid.uuid4().hex}"
    df.coalesce(1).write.mode("errorifexists").json(version)
    return version


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version: the one with the greatest number among those whose one file was committed."""
    done = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    last = done.agg(F.max(F.regexp_extract("path", r"^(.*/v=[0-9]+-[0-9a-f]+)/part-[^/]*$", 1))).first()[0]
    if last is None:
        raise ValueError(f"no whole version below {path}")
    return spark.read.json(last)


def write_results(df: DataFrame, path: str, key: str, folder: bool) -> None:
    """Simulations as a folder of JSON documents by key with an index beside it, or as one JSON document."""
    if folder:
        df.withColumn("key_", F.col(key)).write.mode("errorifexists").partitionBy("key_").json(f"{path}/simulations")
        df.select(key).write.mode("errorifexists").json(f"{path}/index")
    else:
        df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias("simulations"))).alias("value")).write.mode("errorifexists").text(path)


def write_pivot(df: DataFrame, path: str, rows: list[str], column: str, names: list, value: Column) -> None:
    """A pivot table as CSV with a header, rows in order."""
    df.groupBy(*rows).pivot(column, names).agg(value).orderBy(*rows).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def write_bundle(records: DataFrame, summary: DataFrame, path: str) -> None:
    """Records, their summary, and a manifest with the hash of every file; nothing is overwritten."""
    write_jsonl(records, f"{path}/records")
    write_jsonl(summary, f"{path}/summary")
    hashes = content_hashes(records.sparkSession, path).filter(F.col("path").rlike(r"/part-[^/]+$"))
    hashes.withColumn("path", F.regexp_extract("path", r"((?:records|summary)/[^/]+)$", 1)).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def verify_bundle(spark: SparkSession, path: str, summarize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(problem, what): files that aren't as the manifest says, and rows of the summary that its records don't give."""
    files = content_hashes(spark, path).filter(F.col("path").rlike(r"/(records|summary)/part-[^/]+$")).select(F.regexp_extract("path", r"((?:records|summary)/[^/]+)$", 1).alias("path"), F.col("sha256").alias("now"))
    known = spark.read.json(f"{path}/manifest").select("path", F.col("sha256").alias("then"))
    changed = files.join(known, "path", "full_outer").filter(~F.col("now").eqNullSafe(F.col("then"))).select(F.lit("file").alias("problem"), F.col("path").alias("what"))
    again = summarize(spark.read.json(f"{path}/records"))
    text = again.select(canonical_json(again).alias("what"))
    said = spark.read.text(f"{path}/summary").withColumnRenamed("value", "what")
    both = text.exceptAll(said).union(said.exceptAll(text))
    return changed.union(both.select(F.lit("summary").alias("problem"), "what"))


def provenance(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, files, sha256) of named inputs: one hash over the hashes of all their files."""
    out = None
    for name, path in paths.items():
        hashes = content_hashes(spark, path)
        one = tree_hash(hashes).crossJoin(hashes.agg(F.count("*").alias("files"))).select(F.lit(name).alias("name"), "files", "sha256")
        out = one if out is None else out.union(one)
    return out
