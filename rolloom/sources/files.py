"""Readers and writers. All paths go to Spark, so any file system it knows will do."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROLLOUT_SCHEMA = """run_id STRING, prompt_id STRING, sample_id BIGINT, model_name STRING, dataset_name STRING, split STRING, generation_seed BIGINT, temperature DOUBLE, top_p DOUBLE, max_new_tokens BIGINT, batch_size BIGINT,
prompt STRING, response STRING, ground_truth STRING,
verification STRUCT<extraction: STRUCT<raw_answer: STRING, normalized_answer: STRING, parsed_value: STRING, extraction_status: STRING, format_ok: BOOLEAN>, is_correct: BOOLEAN, error_type: STRING>,
reward STRUCT<correctness_reward: DOUBLE, format_reward: DOUBLE, length_penalty: DOUBLE, final_reward: DOUBLE>,
prompt_tokens BIGINT, response_tokens BIGINT, hit_max_length BOOLEAN, finish_reason STRING"""


def read_rollouts(spark: SparkSession, path: str, strict: bool = True, schema: str = ROLLOUT_SCHEMA) -> DataFrame:
    """JSON lines with the rollout schema. Bad lines fail, or land in ``_corrupt`` if not strict; blank ones are skipped."""
    reader = spark.read.schema(schema if strict else schema + ", _corrupt STRING").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line and text of lines that are no JSON object (line numbers from 1, for reports)."""
    w = Window.partitionBy("file").orderBy("at")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.withColumn("line", F.row_number().over(w))
    kind = F.schema_of_variant(F.try_parse_json("value"))
    return rows.where((F.trim("value") != "") & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))).select("file", "line", "value")


def write_rollouts(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; NaN and infinities are an error."""
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = F.isnan(name) | (F.abs(F.col(name)) == float("inf"))
            df = df.withColumn(name, F.when(bad, F.raise_error(F.lit(f"{name} is not finite")).cast(kind)).otherwise(F.col(name)))
    df.write.mode("append" if append else "overwrite").json(path)


def atomic_json(path: str, value: object) -> None:
    """One small JSON document on the driver: whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, suffix=".tmp") as f:
        json.dump(value, f, ensure_ascii=False, allow_nan=False, indent=2, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def load_tables(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Parquet, JSON or JSON-lines files, in one table; columns may be missing from some."""
    out = None
    for path in paths:
        suffix = path.rstrip("/").rpartition(".")[2].lower()
        if suffix not in ("parquet", "json", "jsonl"):
            raise ValueError(f"unknown file kind: {path}")
        one = spark.read.parquet(path) if suffix == "parquet" else spark.read.json(path)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def read_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of <step>.jsonl generation dumps, with the step from the file's name."""
    df = spark.read.json(folder)
    return df.withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.jsonl$", 1).try_cast("long"))


def read_gpu_csv(spark: SparkSession, path: str) -> DataFrame:
    """util and memory of each line, from the first columns whose headers say so; units go, other text is null."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    pick = lambda part: next((c for c in df.columns if part in c.lower()), None)

    def number(name: str | None) -> Column:
        if name is None:
            return F.lit(None).cast("double")
        return F.regexp_replace(F.col(f"`{name}`"), r"[%\s]|MiB", "").try_cast("double")

    return df.select(number(pick("util")).alias("util"), number(pick("mem")).alias("memory"))


def log_values(lines: DataFrame, prefixes: tuple[str, ...], order: list[str], text: str = "value") -> DataFrame:
    """The last value of each 'key': number pair in log lines whose key has an allowed prefix."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"'([^']+)':\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"), F.lit(0))
    rows = lines.select(*order, F.posexplode(found).alias("_p", "_x"))
    key = F.regexp_extract("_x", r"'([^']+)'", 1)
    value = F.regexp_extract("_x", r":\s*(.+)$", 1).try_cast("double")
    keep = F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col("key"), p))
    return rows.select(*order, "_p", key.alias("key"), value.alias("number")).where(keep).groupBy("key").agg(F.max_by("number", F.struct(*order, "_p")).alias("number"))


def last_lines(lines: DataFrame, pattern: str, n: int, order: str, text: str = "value") -> DataFrame:
    """The last n lines that match, in order."""
    return lines.where(F.col(text).rlike(f"(?i){pattern}")).orderBy(F.desc(order)).limit(n).orderBy(order)


def metric_lines(df: DataFrame, step: str, metrics: str) -> DataFrame:
    """"step:n - key:value - ..." of a map of metrics, keys in order."""
    pairs = F.transform(F.array_sort(F.map_entries(metrics)), lambda e: F.concat_ws(":", e.key, e.value.cast("string")))
    return df.select(step, F.concat_ws(" - ", F.concat(F.lit("step:"), F.col(step).cast("string")), F.concat_ws(" - ", pairs)).alias("line"))


def best_of_lines(lines: DataFrame, key: str, text: str = "line") -> DataFrame:
    """The largest value of one key over metric lines."""
    return lines.agg(F.max(F.try_element_at(F.str_to_map(text, F.lit(" - "), F.lit(":")), F.lit(key)).try_cast("double")).alias("best"))


def write_steps(df: DataFrame, path: str, step: str, data: str) -> None:
    """{"step": n, "data": {...}} lines."""
    df.select(F.col(step).alias("step"), F.col(data).alias("data")).write.mode("append").json(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def generation_table(df: DataFrame, step: str, order: str, columns: list[str], n: int) -> DataFrame:
    """One wide row per step: the first n generations side by side."""
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(step).orderBy(order))).where(F.col("_i") <= n)
    return ranked.groupBy(step).agg(*[F.max(F.when(F.col("_i") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, n + 1) for c in columns])


def flat_parameters(value: object, prefix: str = "") -> dict[str, object]:
    """A nested configuration as path-like names; lists also get their length."""
    if isinstance(value, dict):
        items = [(str(k), v) for k, v in value.items()]
        extra: dict[str, object] = {}
    elif isinstance(value, list | tuple):
        items = [(str(i), v) for i, v in enumerate(value)]
        extra = {f"{prefix}/list_len" if prefix else "list_len": len(value)}
    else:
        return {prefix: value}
    for k, v in items:
        extra |= flat_parameters(v, f"{prefix}/{k}" if prefix else k)
    return extra


def step_cache(df: DataFrame, path: str, step: str) -> None:
    """Rollouts of steps, in folders by step."""
    df.write.mode("append").partitionBy(step).parquet(path)


def latest_step(spark: SparkSession, path: str, step: str) -> DataFrame:
    """The newest cached step; other folders are pruned."""
    df = spark.read.parquet(path)
    newest = df.agg(F.max(step)).first()[0]
    return df.where(F.col(step) == newest)


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _files(spark, path)
    return fs.exists(place)


def make_folders(spark: SparkSession, path: str) -> None:
    fs, place = _files(spark, path)
    fs.mkdirs(place)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, place = _files(spark, path)
    return fs.getContentSummary(place).getLength()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder between any two file systems that Spark knows."""
    (a, x), (b, y) = _files(spark, source), _files(spark, target)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, True, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"{source} was not copied")


def cached_copy(spark: SparkSession, source: str, cache: str) -> str:
    """Where a file's copy lies below ``cache``, by the MD5 of its path. Copied again if its size differs."""
    target = f"{cache.rstrip('/')}/{hashlib.md5(source.encode()).hexdigest()}/{source.rstrip('/').rpartition('/')[2]}"
    if not exists(spark, target) or size_of(spark, target) != size_of(spark, source):
        copy(spark, source, target)
        if size_of(spark, target) != size_of(spark, source):
            raise OSError(f"the copy of {source} is not whole")
    return target


def write_text(spark: SparkSession, path: str, value: str) -> None:
    """One small text file, whole or not at all: written beside its place and renamed."""
    fs, place = _files(spark, path)
    _, beside = _files(spark, path + ".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(value.encode()))
    out.close()
    fs.delete(place, False)
    if not fs.rename(beside, place):
        raise OSError(f"{path} was not written")


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, allow_nan=False, indent=2, sort_keys=True))


def write_dump(df: DataFrame, folder: str, step: int) -> None:
    """One step's generations as <step>.jsonl: a step's batch is small, so it is one file."""
    spark, beside = df.sparkSession, f"{folder}/.{step}-{uuid.uuid4().hex}"
    df.coalesce(1).write.json(beside)
    fs, place = _files(spark, beside)
    part = next(x.getPath() for x in fs.listStatus(place) if x.getPath().getName().startswith("part-"))
    fs.rename(part, _files(spark, f"{folder}/{step}.jsonl")[1])
    fs.delete(place, True)


def write_report(groups: DataFrame, summary: DataFrame, issues: DataFrame, folder: str) -> None:
    """prompt_group_metrics.csv (tags joined by ;), summary.json (null without groups) and issues.jsonl."""
    groups.withColumn("tags", F.concat_ws(";", "tags")).write.mode("overwrite").option("header", True).csv(f"{folder}/prompt_group_metrics.csv")
    row = summary.first()
    write_json(groups.sparkSession, f"{folder}/summary.json", None if row is None or not row["n_groups"] else row.asDict())
    issues.write.mode("overwrite").json(f"{folder}/issues.jsonl")


def provenance(spark: SparkSession, config: dict) -> dict:
    """What a run was made with: versions, the configuration and its digest."""
    text = json.dumps(config, sort_keys=True)
    return {"spark": spark.version, "config": config, "config_sha256": hashlib.sha256(text.encode()).hexdigest()}


def write_splits(splits: dict[str, DataFrame], folder: str) -> None:
    """<split>.parquet for each split, and <split>_example.json with its first row."""
    for name, df in splits.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        row = df.limit(1).select(F.to_json(F.struct("*")).alias("x")).first()
        write_json(df.sparkSession, f"{folder}/{name}_example.json", json.loads(row.x) if row else None)


def dataset(spark: SparkSession, path: str, name: str, split: str, question: str, answer: str, index: str) -> DataFrame:
    """Rows of a question set from local files: prompt_id, source_index, question, gold (the hash answer)."""
    from rolloom.functions.text import hash_answer

    df = load_tables(spark, [path])
    return df.select(
        F.format_string("%s-%s-%06d", F.lit(name), F.lit(split), F.col(index)).alias("prompt_id"), F.col(index).alias("source_index"), F.col(question).alias("question"), hash_answer(F.col(answer)).alias("gold"))


def newest(spark: SparkSession, folder: str, suffix: str = ".parquet") -> str:
    """The file or folder with the suffix, anywhere below ``folder``, that was changed last (of equals, the last name)."""
    fs, place = _files(spark, folder)
    found, waiting = [], [place]
    while waiting:
        for x in fs.listStatus(waiting.pop()):
            if x.getPath().getName().endswith(suffix):
                found.append((x.getModificationTime(), x.getPath().toString()))
            elif x.isDirectory():
                waiting.append(x.getPath())
    if not found:
        raise FileNotFoundError(folder)
    return max(found)[1]


def categories(spark: SparkSession, root: str, names: list[str], levels: list[str] | None = None, level: str = "level") -> DataFrame:
    """The newest file of each category's folder, in the given order: category, order and columns, of the given levels."""
    out = None
    for k, name in enumerate(names):
        one = spark.read.parquet(newest(spark, f"{root}/{name}")).select(F.lit(name).alias("category"), F.lit(k).alias("category_order"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no categories")
    return out if levels is None else out.where(F.col(level).isin(levels))


def masked(df: DataFrame, pattern: str) -> DataFrame:
    """For a viewer: matches in text columns become *, other columns become JSON."""
    as_json = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":|\}$', "")
    return df.select(*[(F.regexp_replace(c, pattern, "*") if kind == "string" else as_json(c)).alias(c) for c, kind in df.dtypes])
