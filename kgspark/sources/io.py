"""Readers and writers of documents, pages, reports and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .buckets import BucketTable
from .shared import materialize

ENTITY = "entity struct<entity_type: string, id: string, ten_raw: string, display_name: string, canonical_name: string, variants: array<string>, properties: map<string, string>, error: string>"
EDGE = "struct<`from`: string, `to`: string, relation_type: string, properties: map<string, string>, source: struct<source_id: string>, confidence_score: double>"
SILVER = f"{ENTITY}, nodes array<struct<id: string, label: string, properties: map<string, string>>>, relationships array<{EDGE}>, claims array<struct<source: struct<source_id: string>, confidence_score: double>>"


def read_documents(spark: SparkSession, path: str, schema: str | StructType = SILVER) -> DataFrame:
    """One JSON document a file (an object or an array of one), with its file name; damaged ones have _corrupt_record."""
    full = f"{schema}, _corrupt_record string" if isinstance(schema, str) else schema.add("_corrupt_record", "string")
    docs = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return docs.withColumn("file", F.col("_metadata.file_name"))


def repair_json(text: Column, schema: str) -> Column:
    """Parse text that should be JSON: a fenced block or the outermost brackets, stray backslashes and trailing commas
    dropped, a one-element array unwrapped; then once more without any backslash; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    span = F.regexp_extract(body, r"(?s)(\[.*\]|\{.*\})", 1)
    fixed = F.regexp_replace(F.regexp_replace(span, r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})', ""), r",\s*([\]}])", "$1")
    open_ = lambda s: F.regexp_replace(F.trim(s), r"(?s)^\[(.*)\]$", "$1")

    def parse(s: Column) -> Column:
        # A damaged text parses to a struct whose corrupt column is set; only whole ones count.
        parsed = F.from_json(open_(s), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        return F.when(parsed["_bad"].isNull() & (s != ""), parsed.dropFields("_bad"))

    return F.coalesce(parse(fixed), parse(F.regexp_replace(fixed, r"\\", "")))


def corrupt_record_stats(docs: DataFrame) -> DataFrame:
    """Files, good and damaged ones (not parsed, or with an error in the entity), and the damaged share in percent.

    Any field can damage a document, and Spark parses only the columns that are used, so the test uses all: docs need no cache.
    """
    used = sum((F.col(c).isNull().cast("int") for c in docs.columns), F.lit(0)) >= 0
    bad = used & (F.col("_corrupt_record").isNotNull() | F.coalesce(F.col("entity.error").isNotNull(), F.lit(False)))
    return docs.agg(F.count("*").alias("files"), F.count_if(~bad).alias("good"), F.count_if(bad).alias("damaged"), F.round(100 * F.count_if(bad) / F.count("*"), 2).alias("damaged_percent"))


def natural_key(name: Column) -> Column:
    """A text that sorts as names with numbers in them are counted: page2 before page10."""
    parts = F.split(F.lower(name), r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def compact_documents(spark: SparkSession, path: str, out: str, schema: str | StructType = SILVER, file_bytes: int = 128 << 20) -> None:
    """Many small JSON files, a document each, as a few Parquet files of about file_bytes of JSON, in the natural order of the file names.

    Rows are those of read_documents, damaged ones too, with the source's size and time as file_size and file_time. Later jobs read the columns that
    they need of few large files instead of opening every small one; the range of names in each is in its statistics. Overwrites out.
    The small files are opened once, into a checkpoint: their sizes, the sample for the order and the rows each come from that.
    """
    docs = read_documents(spark, path, schema).withColumns({"file_size": F.col("_metadata.file_size"), "file_time": F.col("_metadata.file_modification_time")})
    docs = materialize(docs)
    total = docs.agg(F.sum("file_size")).first()[0] or 0
    key = natural_key(F.col("file"))
    placed = docs.withColumn("place", key).repartitionByRange(max(1, -(-total // file_bytes)), "place", "file").sortWithinPartitions("place", "file")
    placed.write.mode("overwrite").parquet(out)


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """page, text and file of one text file a page, under path or in folders of it named page=<number>.

    The page is the folder's number, else the first number in the file's name, 999999 without one.
    """
    pages = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    pages = pages.select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"), F.regexp_extract("_metadata.file_path", r"/page=(\d+)/[^/]*$", 1).alias("folder"))
    number = F.when(F.col("folder") != "", F.col("folder")).otherwise(F.regexp_extract("file", r"(\d+)", 1))
    return pages.withColumn("page", F.when(number == "", 999_999).otherwise(number.cast("int"))).drop("folder")


def toc_by_page(toc: DataFrame, group: str = "VI_THUOC") -> DataFrame:
    """Candidate entities of each page, in order, with a default group. toc: page, entity_name, group."""
    item = F.struct("entity_name", F.coalesce(F.when(F.col("group") != "", F.col("group")), F.lit(group)).alias("group"))
    return toc.groupBy("page").agg(F.sort_array(F.collect_list(item)).alias("candidates"))


def explode_edges(docs: DataFrame, doc_id: str = "file") -> DataFrame:
    """Documents' relationships as rows with their place; entries without both ends are skipped."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode("relationships").alias("pos", "r"))
    out = rows.select("doc_id", "pos", F.col("r.from").alias("from_id"), F.col("r.to").alias("to_id"), F.col("r.relation_type").alias("relation_type"), F.col("r.source.source_id").alias("source_id"), F.col("r.properties").alias("props"), F.col("r.confidence_score").alias("confidence"))
    return out.where("from_id is not null and to_id is not null")


def explode_nodes(docs: DataFrame, doc_id: str = "file") -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode("nodes").alias("pos", "n"))
    return rows.where("n.id is not null").select("doc_id", "pos", F.col("n.id").alias("id"), F.col("n.label").alias("label"), F.col("n.properties").alias("props"))


def explode_claims(docs: DataFrame, doc_id: str = "file") -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode("claims").alias("pos", "c"))
    return rows.select("doc_id", "pos", F.col("c.source.source_id").alias("source_id"), F.col("c.confidence_score").alias("confidence"))


def flatten_text(df: DataFrame, fields: list[str]) -> Column:
    """"[FIELD]" and the text of each field that has one, blank lines between."""
    block = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"[{c.upper()}]\n"), F.col(c)))
    return F.concat_ws("\n\n", *[block(c) for c in fields])


def append_report(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def one_a_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One whole row of each key, the same one whatever the order of rows."""
    row = F.struct(*df.columns)
    best = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, F.to_json(row)).alias("_row"))
    return best.select("_row.*")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = 64, version: int | None = None) -> None:
    """Load nodes (id, ...) and edges (from_id, relation_type, to_id, ...) into the graph under path, which the first load begins.

    A node or edge that is there keeps its properties, and those of the load that aren't null replace them or are added. Of
    several rows of one key in a load one counts. Edges without both ends, in the graph or the load, are left out. Nodes and edges lie in
    buckets by their keys; a later load writes the touched buckets alone. version: the load's number, under which it can be run again.
    """
    spark, edge_key = nodes.sparkSession, ["from_id", "relation_type", "to_id"]
    node_table, edge_table = BucketTable(spark, f"{path}/nodes"), BucketTable(spark, f"{path}/edges")
    nodes, edges = one_a_key(nodes, ["id"]), one_a_key(edges, edge_key)
    first = not node_table.exists() or version == 0
    if first:
        node_table.create(nodes, ["id"], buckets)
    else:
        node_table.upsert(nodes, version)
    ids = node_table.read().select("id")
    kept = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)
    if first:
        edge_table.create(kept, edge_key, buckets)
    else:
        edge_table.upsert(kept, version)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return BucketTable(spark, f"{path}/nodes").read(), BucketTable(spark, f"{path}/edges").read()


def read_relational(spark: SparkSession, path: str, names: list[str], jdbc: dict | None = None) -> dict[str, DataFrame]:
    """Tables from Parquet under path, or from a database: jdbc holds url and options, read in ranges of id."""
    if jdbc is None:
        return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}
    options = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "1000000000", "numPartitions": "64"} | jdbc
    return {n: spark.read.format("jdbc").options(**options, dbtable=n).load() for n in names}
