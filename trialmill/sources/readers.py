"""Sources: JSON lines under three policies for bad lines, documents, rosters, logs, answers.

Schemas are given, never inferred, except where a caller asks for it. Dotted keys become
underscored once, here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialmill.sources.sinks import slice_of

C = F.col
CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, bad: str = "raise") -> DataFrame:
    """JSON lines (gzip by suffix, globs and lists welcome). Missing paths are empty.

    bad: ``raise`` fails on a line that does not parse, ``skip`` drops it, ``keep`` puts the first 120
    characters into ``parse_error``.
    """
    found = [p for p in _paths(paths) if exists(spark, p)]
    if not found:
        empty = T.StructType([*schema.fields, T.StructField("parse_error", T.StringType())]) if bad == "keep" else schema
        return spark.createDataFrame([], empty)
    if bad == "raise":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(found)
    if bad == "skip":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found)
    if bad != "keep":
        raise ValueError(f"bad must be raise, skip or keep, not {bad}")
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(found)
    return rows.withColumn("parse_error", F.substring(CORRUPT, 1, 120)).drop(CORRUPT)


def canonical_names(df: DataFrame, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Dots in top-level names become underscores; ``renames`` go first."""
    wanted = {c: (renames or {}).get(c, c.replace(".", "_")) for c in df.columns}
    return df.select(*[C(f"`{c}`").alias(n) for c, n in wanted.items()])


def with_sequence(df: DataFrame, into: str = "seq") -> DataFrame:
    """The place of each row in its files, as file name and offset order give it.

    Rows are numbered inside the splits of files; only the sizes of splits, one row each, are summed in order.
    """
    key = ["__file", "__split"]
    marked = df.select("*", C("_metadata.file_path").alias("__file"), C("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__row"))
    sizes = marked.groupBy(*key).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*key, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("__row"))
    return marked.withColumn("__inside", inside).join(offsets, key).withColumn(into, C("__before") + C("__inside")).drop(*key, "__row", "__inside", "__before")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] = ()) -> DataFrame:
    """CSV with a header; empty fields are null. ``columns`` are all that is parsed."""
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return rows.select(*columns) if columns else rows


def read_roster(spark: SparkSession, path: str, header: str = r"(?i)^#\s*bracket:\s*(.+?)\s*$") -> DataFrame:
    """(line, tag, bracket): tags with the bracket of the header line before them; blanks and comments go.

    A roster is a small text file, read as one row, so its line numbers are exact.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    marked = lines.withColumn("bracket", F.nullif(F.regexp_extract("text", header, 1), F.lit("")))
    carried = F.last("bracket", ignorenulls=True).over(Window.partitionBy().orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    text = F.trim("text")
    return marked.withColumn("bracket", carried).filter((text != "") & ~text.startswith("#")).select("line", text.alias("tag"), "bracket")


SCENARIO = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "class", "difficulty", "grounding", "pair_id", "context", "question", "gold_answer", "judge_rubric")],
        *[T.StructField(n, T.IntegerType()) for n in ("max_tokens", "timeout_s", "tier")],
    ]
)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios of a JSON document: a list, an object with ``scenarios``, or an object of scenarios."""
    text = spark.read.text(path, wholetext=True)
    item, many, keyed = SCENARIO.simpleString(), f"array<{SCENARIO.simpleString()}>", f"map<string,{SCENARIO.simpleString()}>"
    body = F.trim("value")
    listed = F.when(body.startswith("["), F.from_json("value", many))
    nested = F.when(F.json_object_keys("value").isNotNull() & F.array_contains(F.json_object_keys("value"), "scenarios"), F.from_json(F.get_json_object("value", "$.scenarios"), many))
    mapped = F.map_values(F.from_json("value", keyed))
    assert item
    return text.select(F.explode(F.coalesce(listed, nested, mapped)).alias("s")).select("s.*")


def read_object(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row from a JSON document; all null where it is missing or does not parse."""
    if not exists(spark, path):
        return spark.createDataFrame([(None,) * len(schema.fields)], schema)
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("o")).select("o.*").limit(1)


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, text) of all answer files below a folder."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    return spark.read.text(f"{folder}/*.txt", wholetext=True).select(stem.alias("stem"), C("value").alias("text"))


def with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (model, scenario, rep) with the text of their answer: the file with the repetition's suffix, else the one without."""
    base = F.concat_ws("__", F.translate("model", "/:", "__"), "scenario")
    named = rows.withColumn("__one", F.concat(base, F.lit("__r"), C("rep").cast("string"))).withColumn("__any", base)
    one, some = answers.toDF("__one", "__t1"), answers.toDF("__any", "__t2")
    return named.join(one, "__one", "left").join(some, "__any", "left").withColumn("text", F.coalesce("__t1", "__t2")).drop("__one", "__any", "__t1", "__t2")


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines) of non-blank lines, without parsing them."""
    return spark.read.text(path).select(C("_metadata.file_name").alias("file"), "value").filter(F.trim("value") != "").groupBy("file").agg(F.count("*").alias("lines"))


def newest_run(spark: SparkSession, pattern: str, run: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """The run whose marker files, matched by ``pattern``, changed last."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    seen = files.groupBy(F.regexp_extract("path", run, 1).alias("run_id")).agg(F.max("modificationTime").alias("changed"))
    return seen.orderBy(F.desc("changed"), "run_id").limit(1)


def read_run_folders(spark: SparkSession, pattern: str, schema: T.StructType, run: str = r"/([^/]+)/[^/]+$") -> DataFrame:
    """Records of many run folders, each with its ``run_id``, taken from the path; cut lines are dropped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(pattern)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), run, 1).alias("run_id"), *schema.fieldNames())


def read_slices(spark: SparkSession, path: str, schema: T.StructType, subject: str = "model", only: object = None) -> DataFrame:
    """Records that ``sinks.write_slices`` wrote: of all subjects, or those of ``only``, from that subject's folder alone."""
    rows = spark.read.schema(schema).json(path)
    if only is not None:
        one = F.lit(only).cast(schema[subject].dataType)
        if "slices" in rows.columns and "slices" not in schema.fieldNames():
            rows = rows.filter(C("slice").cast("int") == slice_of(one, C("slices").cast("int")))
        rows = rows.filter(C(subject) == one)
    return rows.select(*schema.fieldNames())


def first_nonempty(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first path that has a line: a mirror before the original, a working file before the committed one."""
    for path in candidates:
        if exists(spark, path) and not spark.read.text(path).filter(F.trim("value") != "").isEmpty():
            return path
    return None


def parse_perf(lines: DataFrame) -> DataFrame:
    """Interval output of a counter tool (``t  count  unit  event``) as (t, event, value); thousands separators go."""
    row = r"^\s*([0-9.]+)\s+([0-9.,]+)\s+(?:(\S+)\s+)?(\S*(?:read|write|requests|instructions|cycles)\S*)"
    value = F.regexp_replace(F.regexp_extract("value", row, 2), ",", "").try_cast("double")
    parsed = lines.select(F.regexp_extract("value", row, 1).try_cast("double").alias("t"), F.regexp_extract("value", row, 4).alias("event"), value.alias("x"))
    return parsed.filter("t IS NOT NULL").withColumnRenamed("x", "value")


def parse_perplexity(logs: DataFrame) -> DataFrame:
    """(model, text) -> (model, ppl): the figure after ``PPL =``, null where there is none."""
    return logs.select("model", F.nullif(F.regexp_extract("text", r"PPL = ([0-9.]+)", 1), F.lit("")).try_cast("double").alias("ppl"))


def skip_lines(lines: DataFrame, needle: str = "SKIP after", window: int = 400, keep: int = 30) -> DataFrame:
    """Of the last ``window`` lines (n, value) those with the needle: the last ``keep`` of them, with the total."""
    recent = lines.orderBy(F.desc("n")).limit(window).filter(C("value").contains(needle))
    total = recent.agg(F.count("*").alias("total"))
    return recent.orderBy(F.desc("n")).limit(keep).join(F.broadcast(total)).orderBy("n")
