"""File sources (A1, A2, A4, A6, A7) and the report sink.

Files are listed and read by Spark's ``binaryFile`` / JSON / CSV sources in
parallel; nothing is listed or opened on the driver beyond what the file index
itself does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsearch_spark.functions.text import file_suffix
from docsearch_spark.schemas import ALLOWED_DATASETS, CORPUS, QRELS_TSV, QUERIES_JSON, REPORT

TEXT_SUFFIXES = (".txt", ".md", ".markdown")
PDF_SUFFIX = ".pdf"
SUFFIX_PATTERN = r"\.(pdf|txt|md|markdown)$"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    """A1: supported files under ``root`` (recursive). A table has no order; a
    caller that lists files sorts by path.

    Suffixes are compared lower-cased ({.pdf,.txt,.md,.markdown}); unsupported
    files in a directory are skipped; a single unsupported file is an error; a
    missing root gives an empty table. Spark's file index skips names starting
    with '.' or '_' (documented difference). Output: path, length, content.
    """
    empty = spark.createDataFrame([], "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    if not path_exists(spark, root):
        return empty
    if _is_file(spark, root):
        name = root.rsplit("/", 1)[-1].lower()
        if not any(name.endswith(s) for s in (PDF_SUFFIX,) + TEXT_SUFFIXES):
            raise ValueError(f"Unsupported file: {root}")
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .filter(F.lower(F.col("path")).rlike(SUFFIX_PATTERN)))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """A1, A2, A4: the text files under ``root`` as (doc_id, source_path, text).

    The path names a document; its id is a hash of the path, the same at every scan."""
    text, _, _ = route_by_type(scan_documents(spark, root))
    return text.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_path"), "text")


def written_by_tasks(root: str) -> bool:
    """Whether tasks can write files under ``root`` themselves (:func:`write_texts`)."""
    try:
        arrow_fs.FileSystem.from_uri(root)
    except (pa.ArrowException, OSError):
        return False
    return True


def write_texts(rows: DataFrame, root: str) -> int:
    """Write ``rows`` (folder, name, text; no null folder or name) as files ``<root>/<folder>/<name>``,
    each text (null: none) with a line end, and return the number of files.

    Rows of one file share it, whatever their number. A folder is written by one task and in one
    order, so a task that runs again writes the same files. The files are opened by the tasks: a
    Spark writer makes a directory, a checksum file and, without Hadoop's native library, a few
    processes for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = arrow_fs.FileSystem.from_uri(root)
        made, at, out, files = None, None, None, 0
        try:
            for rb in batches:
                for row in zip(*(rb.column(c).to_pylist() for c in ("folder", "name", "text"))):
                    if row[:2] != at:
                        if out is not None:
                            out.close()
                        if row[0] != made:
                            made = row[0]
                            store.create_dir(f"{base}/{made}", recursive=True)
                        at, files = row[:2], files + 1
                        out = store.open_output_stream(f"{base}/{at[0]}/{at[1]}")
                    out.write((row[2] or "").encode("utf-8", "surrogatepass") + b"\n")
        finally:
            if out is not None:
                out.close()
        yield pa.record_batch({"files": pa.array([files], pa.int64())})

    dealt = rows.select("folder", "name", "text").repartition("folder").sortWithinPartitions("folder", "name", "text")
    return dealt.mapInArrow(run, "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first()["n"]


def decode_text(content) -> F.Column:
    """A2: bytes -> UTF-8 text, invalid sequences become U+FFFD."""
    c = F.col(content) if isinstance(content, str) else content
    return F.make_valid_utf8(c.cast("string"))


def route_by_type(files: DataFrame, strict: bool = False):
    """A4: choose the extractor from the suffix.

    Returns (text_files with ``text``, pdf_files, rejected with ``error``).
    PDF byte parsing is not done here: page texts enter through
    ``assemble_fragments`` (A3). With ``strict`` an unsupported file fails the job.
    """
    suf = file_suffix("path")
    tagged = files.withColumn("route", F.when(suf == PDF_SUFFIX, F.lit("pdf"))
                              .when(suf.isin(*TEXT_SUFFIXES), F.lit("text")))
    if strict:
        tagged = tagged.withColumn("route", F.coalesce(
            F.col("route"), F.raise_error(F.concat(F.lit("Unsupported file type: "), F.col("path")))))
    text = (tagged.filter(F.col("route") == "text")
            .withColumn("text", decode_text("content")).drop("content"))
    pdf = tagged.filter(F.col("route") == "pdf")
    rejected = (tagged.filter(F.col("route").isNull())
                .select("path", F.concat(F.lit("Unsupported file type: "), F.col("path")).alias("error")))
    return text, pdf, rejected


def check_dataset(name: str) -> str:
    """Lower-cased, trimmed, and one of the allowed names."""
    ds = name.lower().strip()
    if ds not in ALLOWED_DATASETS:
        raise ValueError(f"dataset must be one of {sorted(ALLOWED_DATASETS)}, got {name!r}")
    return ds


def load_eval_dataset(spark: SparkSession, folder: str, split: str = "test", dataset: str | None = None):
    """(corpus, queries, qrels) from a BEIR-layout folder:
    corpus.jsonl, queries.jsonl, qrels/<split>.tsv (header, tab separated).

    A ``dataset`` name must be one of the allowed ones (``check_dataset``)."""
    if dataset is not None:
        check_dataset(dataset)
    base = folder.rstrip("/")
    corpus = (spark.read.schema(CORPUS).json(f"{base}/corpus.jsonl")
              .select(F.col("_id").alias("doc_id"), "title", "text"))
    queries = (spark.read.schema(QUERIES_JSON).json(f"{base}/queries.jsonl")
               .select(F.col("_id").alias("query_id"), "text"))
    qrels = (spark.read.schema(QRELS_TSV).option("sep", "\t").option("header", True)
             .csv(f"{base}/qrels/{split}.tsv")
             .select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"),
                     F.col("score").alias("grade")))
    return corpus, queries, qrels


def write_eval_dataset(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str,
                       split: str = "test") -> None:
    """Inverse of A6 (used to stage derived datasets)."""
    base = folder.rstrip("/")
    corpus.select(F.col("doc_id").cast("string").alias("_id"), "title", "text") \
        .write.mode("overwrite").json(f"{base}/corpus.jsonl")
    queries.select(F.col("query_id").cast("string").alias("_id"), "text") \
        .write.mode("overwrite").json(f"{base}/queries.jsonl")
    qrels.select(F.col("query_id").cast("string").alias("query-id"),
                 F.col("doc_id").cast("string").alias("corpus-id"),
                 F.col("grade").cast("int").alias("score")) \
        .write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{base}/qrels/{split}.tsv")


def read_reports(spark: SparkSession, paths) -> DataFrame:
    """Saved report JSON (one multi-line document per file), with the file path."""
    return (spark.read.schema(REPORT).option("multiLine", True).json(paths)
            .withColumn("path", F.input_file_name()))


def report_json(report: DataFrame) -> DataFrame:
    """The report record as one JSON string per row."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("json"))


def write_report(report: DataFrame, path: str) -> None:
    """Write the report record(s) as JSON."""
    report.write.mode("overwrite").json(path)
