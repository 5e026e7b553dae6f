"""Sources and sinks: FASTA, delimited, nested JSON, A3M, event logs, shards, wide exports, manifests."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from edgewise.functions.expressions import hash_draw


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``id`` and ``seq`` of each record. Multi-line records; the id ends at the first blank; ``db|id|name`` gives its second field.

    One id with two sequences is an error when its row is read; equal repeats are one row.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    head = F.substring_index(text, "\n", 1)
    name = F.element_at(F.split(head, r"[ \t\r]"), 1)
    fields = F.split(name, r"\|")
    ident = F.when(F.size(fields) >= 3, F.element_at(fields, 2)).otherwise(name)
    seq = F.regexp_replace(F.substr(text, F.char_length(head) + 1), r"\s", "")
    rows = raw.filter(F.trim(text) != "").select(ident.alias("id"), seq.alias("seq"))
    grouped = rows.groupBy("id").agg(F.min("seq").alias("seq"), F.max("seq").alias("other"))
    clash = F.raise_error(F.concat(F.lit("two sequences for id "), "id")).cast("string")
    return grouped.select("id", F.when(F.col("seq") == F.col("other"), F.col("seq")).otherwise(clash).alias("seq"))


def write_fasta(df: DataFrame, path: str, ident: str = "id", seq: str = "seq") -> None:
    """Records in ascending id order over the part files."""
    rows = df.select(F.col(ident).cast("string").alias("id"), F.concat(F.lit(">"), F.col(ident).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))
    rows.repartitionByRange("id").sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)


def read_delimited(spark: SparkSession, path: str, schema: str | StructType, sep: str = "\t", header: bool = False) -> DataFrame:
    """S3: CSV or TSV with a given schema, gzip by its suffix; a malformed row is an error."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "FAILFAST").csv(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON entries with only the fields in use: accession, secondary accessions, annotations with prefix ``P:``, displayed isoforms."""
    schema = "primaryAccession string, secondaryAccessions array<string>, uniProtKBCrossReferences array<struct<database:string,id:string,properties:array<struct<key:string,value:string>>>>, comments array<struct<commentType:string,isoforms:array<struct<isoformSequenceStatus:string,isoformIds:array<string>>>>>"
    raw = spark.read.schema(schema).json(path)
    terms = F.filter("uniProtKBCrossReferences", lambda x: (x["database"] == "GO") & F.exists(x["properties"], lambda p: F.startswith(p["value"], F.lit("P:"))))
    isoforms = F.flatten(F.transform(F.filter("comments", lambda c: c["isoforms"].isNotNull()), lambda c: F.flatten(F.transform(F.filter(c["isoforms"], lambda i: i["isoformSequenceStatus"] == "Displayed"), lambda i: i["isoformIds"]))))
    empty = F.array().cast("array<string>")
    return raw.select(F.col("primaryAccession").alias("primary"), F.coalesce("secondaryAccessions", empty).alias("aliases"), F.coalesce(F.transform(terms, lambda x: x["id"]), empty).alias("annotations"), F.coalesce(isoforms, empty).alias("displayed"))


def read_a3m(spark: SparkSession, path: str) -> DataFrame:
    """Records of alignment files: uid (file), key, tax, aligned. Insertions go, J becomes X; ``bad_length`` marks rows unlike the file's longest query row."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("uid"), F.regexp_replace("value", "^>", "").alias("text"))
    head = F.substring_index("text", "\n", 1)
    body = F.regexp_replace(F.substr("text", F.char_length(head) + 1), r"[\s.a-z]", "")
    named = raw.filter(F.trim("text") != "").select("uid", F.split(head, r"\s+").alias("h"), F.translate(body, "J", "X").alias("aligned"))
    rows = named.select("uid", F.element_at("h", 1).alias("key"), F.when(F.size("h") > 1, F.element_at("h", 2)).alias("tax"), "aligned")
    width = rows.filter("key = 'query'").groupBy("uid").agg(F.max(F.char_length("aligned")).alias("__width"))
    return rows.join(width, "uid", "left").withColumn("bad_length", F.char_length("aligned") != F.col("__width")).drop("__width")


def select_archive(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of all archive members (name, query) those whose query is wanted (``sha``); the smallest name of each wins."""
    keyed = files.withColumn("sha", F.sha2(F.col("query").cast("binary"), 256))
    return keyed.join(wanted.select("sha").distinct(), "sha", "left_semi").groupBy("sha").agg(F.min("name").alias("name"))


def read_event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines. A file's last line may be torn and is dropped; any other line that can't be read is an error when its row is read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"))
    parsed = lines.filter(F.trim("value") != "").withColumn("x", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    last = parsed.groupBy("file").agg(F.max("place").alias("last"))  # a row a file
    bad = F.col("x._corrupt").isNotNull()
    clash = F.raise_error(F.concat(F.lit("a line before the last can't be read in "), "file")).cast("boolean")
    kept = parsed.join(last, "file").withColumn("keep", F.when(bad & (F.col("place") != F.col("last")), clash).otherwise(~bad))
    return kept.filter("keep").select(*[f"x.{f}" for f in StructType.fromDDL(schema).fieldNames()])


def read_shards(spark: SparkSession, paths: list[str], row: str = "row_id") -> DataFrame:
    """Shards of predictions by name, in row order within partitions, with the file of each row."""
    return spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("shard", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).repartitionByRange(row).sortWithinPartitions(row)


def wide_predictions(df: DataFrame, models: list[str], row: str = "row_id", score: str = "score") -> DataFrame:
    """One row a pair with each model's score as a column; of several scores of one row the greatest."""
    return df.groupBy(row).pivot("model", models).agg(F.max(score))


def write_with_manifest(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Publish ``df`` as Parquet at ``path``, whole or not at all, and return its manifest.

    The table is written and read back under another name, its manifest goes
    in beside its files (``_manifest``), and one rename makes it visible. The
    manifest has per file its rows and an order-insensitive digest of ``keys``.
    A path that is taken is an error.
    """
    spark = df.sparkSession
    hidden = f"{path}.unpublished-{uuid.uuid4().hex}"
    df.write.parquet(hidden)
    digest = F.bit_xor(hash_draw(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])))
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    spark.read.parquet(hidden).groupBy(name.alias("file")).agg(F.count("*").alias("rows"), digest.alias("digest")).coalesce(1).write.parquet(f"{hidden}/_manifest")
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (hidden, path))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target) or not system.rename(source, target):
        system.delete(source, True)
        raise FileExistsError(path)
    return spark.read.parquet(f"{path}/_manifest")


def tokenise(df: DataFrame, alphabet: str, unknown: int, seq: str = "seq") -> DataFrame:
    """``tokens`` by place in the alphabet, other letters ``unknown``, and how many those were."""
    table = F.create_map(*[x for i, c in enumerate(alphabet) for x in (F.lit(c), F.lit(i))])
    tokens = F.transform(F.split(F.col(seq), ""), lambda c: F.coalesce(F.element_at(table, c), F.lit(unknown)))
    named = df.withColumn("tokens", F.when(F.char_length(seq) > 0, tokens).otherwise(F.array().cast("array<int>")))
    return named.withColumn("n_unknown", F.size(F.filter("tokens", lambda t: t == unknown)))


def task_rows(pairs: DataFrame, stride: int, swap: bool, longer_than: int | None = None) -> DataFrame:
    """Rows of a named task: every ``stride``-th row, ends swapped, both lengths over a limit together."""
    rows = pairs.filter(F.col("row_id") % stride == 0) if stride > 1 else pairs
    rows = rows if longer_than is None else rows.filter(F.col("len_a") + F.col("len_b") > longer_than)
    return rows.withColumns({"a": F.col("b"), "b": F.col("a")}) if swap else rows


def task_catalogue(pairs: DataFrame, tasks: dict[str, dict]) -> DataFrame:
    """Rows of every task of a catalogue (``stride``, ``swap``, ``longer_than`` by name), with the task's name."""
    parts = [task_rows(pairs, t.get("stride", 1), t.get("swap", False), t.get("longer_than")).withColumn("task", F.lit(name)) for name, t in tasks.items()]
    return reduce(DataFrame.unionByName, parts)


def clean_interactions(raw: DataFrame, sequences: DataFrame, salt: str = "shuffle") -> DataFrame:
    """Raw pairs with labels as text in a hash order, ends joined to sequences, missing ones marked."""
    left, right = (sequences.select(F.col("id").alias(x), F.col("seq").alias(f"{x}_seq")) for x in ("a", "b"))
    rows = raw.withColumn("y", F.col("label").cast("double").cast("int")).join(left, "a", "left").join(right, "b", "left")
    marked = rows.withColumn("missing", F.col("a_seq").isNull() | F.col("b_seq").isNull())
    return marked.withColumn("place", hash_draw(F.concat_ws(":", F.lit(salt), "a", "b")))
