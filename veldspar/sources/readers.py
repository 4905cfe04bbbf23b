"""Texts and records from lists, files and folders, all as ``(document_id, text, metadata)``."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = "document_id string, text string, metadata map<string,string>"


def texts(spark: SparkSession, values: Sequence[str], metadata: Sequence[dict] | None = None, prefix: str = "text") -> DataFrame:
    """A list from the program; ids are the prefix and the place.  Metadata of another length is an error."""
    if metadata is not None and len(metadata) != len(values):
        raise ValueError(f"{len(values)} texts but {len(metadata)} metadata")
    rows = [(f"{prefix}-{i}", v, {k: str(x) for k, x in (metadata[i] if metadata else {}).items()}) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, DOCUMENT)


def records(df: DataFrame, text_field: str, id_field: str | None = None, document_id: str = "record") -> DataFrame:
    """Rows with a text; every other field goes to the metadata.  Null and blank texts are dropped.

    Without ``id_field`` ids are the name and the row's number, without gaps, in the order of the partitions; only the counts of these are collected.
    """
    others = [c for c in df.columns if c not in (text_field, id_field)]
    meta = F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda _, v: v.isNotNull()) if others else F.create_map().cast("map<string,string>")
    if id_field:
        key = F.col(id_field).cast("string")
    else:
        df = df.withColumn("_at", F.monotonically_increasing_id())
        part = F.shiftright("_at", 33).cast("int")
        counts = {r["p"]: r["n"] for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        before, run = {}, 0
        for p in sorted(counts):
            before[p], run = run, run + counts[p]
        offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map().cast("map<int,int>")
        key = F.concat(F.lit(f"{document_id}-"), (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.element_at(offset, part)).cast("string"))
    return df.where(F.trim(F.coalesce(F.col(text_field).cast("string"), F.lit(""))) != "").select(key.alias("document_id"), F.col(text_field).cast("string").alias("text"), meta.alias("metadata"))


def _stem(path: str = "path"):
    return F.regexp_extract(F.col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def whole_files(spark: SparkSession, path: str | list[str], glob: str = "*", recursive: bool = True) -> DataFrame:
    """Each file as one text, ordered names as ids; bytes that are no UTF-8 are read as Latin-1, and unreadable files skipped."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").load(path)
    utf = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf, F.decode("content", "ISO-8859-1"))
    return raw.select(_stem().alias("document_id"), text.alias("text"), F.create_map(F.lit("source_path"), F.col("path")).alias("metadata"))


def csv(spark: SparkSession, path: str, text_field: str, id_field: str | None = None) -> DataFrame:
    """A CSV file with a header, all fields as strings."""
    return records(spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"'), text_field, id_field)


def jsonl(spark: SparkSession, path: str, text_field: str, id_field: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line; lines that are none are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return records((reader.schema(schema) if schema else reader).json(path), text_field, id_field)


def json_documents(spark: SparkSession, path: str | list[str], text_field: str, id_field: str | None = None) -> DataFrame:
    """A file with a list of objects, an object whose first list is meant, one object, or a bare value as the text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out: list[tuple[str, str, list]] = []
            for path_, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    data = json.loads(content.decode("utf-8", "replace"))
                except ValueError:
                    continue
                rows = data
                if isinstance(data, dict):
                    rows = next((v for v in data.values() if isinstance(v, list)), [data])
                elif not isinstance(data, list):
                    rows = [{text_field: data}]
                stem = path_.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for i, r in enumerate(rows):
                    r = r if isinstance(r, dict) else {text_field: r}
                    t = r.get(text_field)
                    if t is None or not str(t).strip():
                        continue
                    key = str(r[id_field]) if id_field and r.get(id_field) is not None else f"{stem}-{i}"
                    meta = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in r.items() if k not in (text_field, id_field) and v is not None]
                    out.append((key, str(t), meta))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.map_(pa.string(), pa.string())))], names=["document_id", "text", "metadata"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(run, DOCUMENT)


def file(spark: SparkSession, path: str, text_field: str = "text", id_field: str | None = None) -> DataFrame:
    """A file by its ending: json, jsonl, csv, and anything else as one text."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "json":
        return json_documents(spark, path, text_field, id_field)
    if end == "jsonl":
        return jsonl(spark, path, text_field, id_field)
    if end == "csv":
        return csv(spark, path, text_field, id_field)
    return whole_files(spark, path)


def folder(spark: SparkSession, path: str, text_field: str = "text", id_field: str | None = None) -> DataFrame:
    """All files under a folder, each kind by its ending in one pass of its own, with the file beside each row's metadata; what cannot be read is skipped."""
    kinds = {"json": json_documents, "jsonl": jsonl, "csv": csv}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found: dict[str, list[str]] = {}
    while files.hasNext():
        name = files.next().getPath().toString()
        end = name.rsplit(".", 1)[-1].lower()
        found.setdefault(end if end in kinds else "", []).append(name)
    out = None
    for end in sorted(found):
        for part in [sorted(found[end])] if end in ("", "json") else [[f] for f in sorted(found[end])]:
            df = whole_files(spark, part) if not end else kinds[end](spark, part if end == "json" else part[0], text_field, id_field)
            out = df if out is None else out.unionByName(df)
    return spark.createDataFrame([], DOCUMENT) if out is None else out


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, query, chunk_id)`` of a JSON list of ``{query, relevant_ids}``; items without a query and ids that are no strings are dropped."""
    raw = spark.read.schema("query string, relevant_ids array<string>").option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    each = raw.where(F.trim("query") != "").select(F.xxhash64("query").cast("string").alias("query_id"), "query", F.explode("relevant_ids").alias("chunk_id"))
    return each.where(F.col("chunk_id").isNotNull())
