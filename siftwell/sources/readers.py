"""Readers of the corpus' file formats, and a registry of them by name."""

from __future__ import annotations

import lzma
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.columns import strip

def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", encoding: str = "UTF-8", columns: list[str] | None = None, line_breaks: bool = True) -> DataFrame:
    """Delimited text with a header. Without a schema all columns are strings.

    Quoted fields may hold line breaks; a file is one task then. Where none do, `line_breaks` = False lets large files be split.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", line_breaks).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*columns) if columns else df


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line becomes a row of nulls."""
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, name, text of each file below `path`."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    file = F.col("_metadata.file_path")
    return files.select(file.alias("path"), F.element_at(F.split(file, "/"), -1).alias("name"), F.col("value").alias("text"))


def texts(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """text of each item of a folder of .txt files, a column of a .csv file, or a file with blank lines between items."""
    if path.endswith(".csv"):
        items = csv(spark, path).select(F.col(text_col).alias("text"))
    elif path.endswith(".txt"):
        items = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n\s*\n")).alias("text"))
    else:
        items = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("value").alias("text"))
    return items.select(strip(F.col("text")).alias("text")).filter("text <> ''")


def post_rows(spark: SparkSession, path: str, year_from: int, year_to: int, last_edit: str = "9999", words: tuple[int, int] = (80, 700)) -> DataFrame:
    """Answers of a forum dump: rows of type 2 of an XML file with one element per post, by year, edit date and length."""
    schema = "_Id string, _PostTypeId string, _CreationDate string, _LastEditDate string, _CommunityOwnedDate string, _OwnerUserId string, _Body string"
    rows = spark.read.format("xml").option("rowTag", "row").option("ignoreSurroundingSpaces", False).schema(schema).load(path)
    year = F.substring("_CreationDate", 1, 4).cast("int")
    count = F.regexp_count("_Body", F.lit(r"\S+"))
    kept = rows.filter((F.col("_PostTypeId") == "2") & F.col("_CommunityOwnedDate").isNull() & year.between(year_from, year_to) & (F.substring(F.coalesce("_LastEditDate", F.lit("")), 1, 10) <= last_edit) & count.between(*words))
    return kept.select(F.col("_Id").alias("post_id"), year.alias("pub_year"), F.coalesce("_OwnerUserId", F.concat(F.lit("anon-"), "_Id")).alias("author"), F.col("_Body").alias("html"))


def messages_tsv(spark: SparkSession, path: str, least: float = 0.8) -> DataFrame:
    """Tab-separated messages whose columns 2, 3 and 6 are JSON strings and column 7 a score: at, author, text, score.

    Lines with fewer than ten columns or malformed JSON, a score below `least` or NaN, and reposts are passed over.
    """
    cells = F.split("value", "\t")
    text = lambda i: F.from_json(F.concat(F.lit('{"v":'), F.get(cells, F.lit(i)), F.lit("}")), "v string").getField("v")
    rows = spark.read.text(path).filter(F.size(cells) >= 10).select(text(1).alias("at"), text(2).alias("author"), text(5).alias("text"), F.get(cells, F.lit(6)).try_cast("double").alias("score"))
    return rows.filter(F.col("at").isNotNull() & F.col("author").isNotNull() & F.col("text").isNotNull() & ~F.isnan("score") & (F.col("score") >= least) & ~F.col("text").startswith("RT @"))


def _opened(path: str):
    """A seekable file of the shared storage, opened in a worker: nothing is read but what is asked for."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _paths(spark: SparkSession, path: str) -> DataFrame:
    """The files of a path, one task each at most; their content is not read here."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, min(files.count(), 10_000)))


def _unpacked(most: int | None):
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _opened(path) as raw, lzma.open(raw) as lines:
                    chunk = []
                    for k, line in enumerate(lines):
                        if k == most:
                            break
                        chunk.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                        if len(chunk) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(chunk)), pa.array(chunk)], ["path", "value"])
                            chunk = []
                    if chunk:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(chunk)), pa.array(chunk)], ["path", "value"])

    return run


def xz_lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, value of each line of xz files, or of the first `most` of each, after which a file is read no further; a file
    is one task, decompressed as a stream from the shared storage, whatever its size."""
    return _paths(spark, path).mapInArrow(_unpacked(most), "path string, value string")


def _members(name: str):
    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with _opened(path) as raw, zipfile.ZipFile(raw) as archive:
                    rows += [(path, archive.read(m)) for m in archive.namelist() if m == name]
            columns = [*zip(*rows, strict=True)] or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary())], ["path", "content"])

    return run


def zip_members(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, content of one member of each zip archive; only the directory and the member are read."""
    return _paths(spark, path).mapInArrow(_members(name), "path string, content binary")


def zip_member(archive: bytes, name: str) -> bytes | None:
    """One member of a zip archive, found by its local headers alone, as when only a byte range is at hand."""
    at = 0
    while archive[at : at + 4] == b"PK\x03\x04":
        flags, method, packed, full, n_name, n_extra = struct.unpack("<HH8xIIHH", archive[at + 6 : at + 30])
        start = at + 30 + n_name + n_extra
        own = archive[at + 30 : at + 30 + n_name].decode("utf-8", "replace")
        if flags & 8 and not packed:
            body = zlib.decompressobj(-15)
            data = body.decompress(archive[start:])
            packed = len(archive) - start - len(body.unused_data)
            trailer = start + packed
            packed += 16 if archive[trailer : trailer + 4] == b"PK\x07\x08" else 12
        elif own == name:
            data = archive[start : start + packed] if method == 0 else zlib.decompressobj(-15).decompress(archive[start : start + packed], full)
        else:
            data = b""
        if own == name:
            return data
        at = start + packed
    return None


def _words(batches):
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            with _opened(path) as raw, zipfile.ZipFile(raw) as archive:
                for name in archive.namelist():
                    found = re.search(r"words/([A-Z]{2}\d+[a-z])\.([A-Z])\.words\.xml$", name)
                    if not found:
                        continue
                    for element in ElementTree.fromstring(archive.read(name)):
                        start = element.get("starttime")
                        if element.tag == "w" and element.text and start is not None:
                            rows.append((found[1], found[2], float(start), float(element.get("endtime") or start), element.text, element.get("punc") == "true"))
        columns = [*zip(*rows, strict=True)] or [[]] * 6
        kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["meeting", "speaker", "start", "stop", "token", "punctuation"])


def transcript_words(spark: SparkSession, path: str) -> DataFrame:
    """meeting, speaker, start, stop, token, punctuation from zip archives of per-speaker word files."""
    return _paths(spark, path).mapInArrow(_words, "meeting string, speaker string, start double, stop double, token string, punctuation boolean")


def book_catalogue(spark: SparkSession, path: str, prefixes: tuple[str, ...] = ("PR", "PS")) -> DataFrame:
    """English texts of the wanted subject classes from a catalogue, without verse and drama, with their single author's
    years: book_id, author, born, died. Works of several authors, or of one without years, are passed over."""
    verse = r"(?i)poetry|poems|drama|\bplays\b|\bverses?\b|hymn|\bsongs\b|ballad|sonnet"
    rows = csv(spark, path).filter((F.col("Type") == "Text") & (F.col("Language") == "en"))
    wanted = F.exists(F.split("LoCC", ";"), lambda c: F.array_contains(F.array(*(F.trim(c).startswith(p) for p in prefixes)), True))
    rows = rows.filter(wanted & ~F.concat_ws(" ", "Subjects", "Title", "Bookshelves").rlike(verse))
    return rows.select(F.col("Text#").alias("book_id"), lifespan(F.col("Authors")).alias("life")).filter("life is not null").select("book_id", "life.*")


def lifespan(authors):
    """struct(author, born, died) of a single author given as 'Name, 1812-1870', else null."""
    parts = F.filter(F.transform(F.split(authors, ";"), lambda a: F.trim(a)), lambda a: a != "")
    years = r"^(.*?)(\d{3,4})\??-(\d{3,4})\??"
    one = F.get(parts, F.lit(0))
    life = F.struct(F.regexp_replace(F.regexp_extract(one, years, 1), r"^[ ,]+|[ ,]+$", "").alias("author"), F.regexp_extract(one, years, 2).try_cast("int").alias("born"), F.regexp_extract(one, years, 3).try_cast("int").alias("died"))
    return F.when((F.size(parts) == 1) & one.rlike(years), life)


def api_entries(spark: SparkSession, path: str, entry: str = "entry") -> DataFrame:
    """entry_id, title, summary, published, updated, category of the entries of landed answers (Atom XML) of a paper archive, each
    entry once, from its last update; answers may overlap, as those to windows of time do."""
    schema = "id string, title string, summary string, published string, updated string, category array<struct<_term:string>>"
    rows = spark.read.format("xml").option("rowTag", entry).schema(schema).load(path)
    flat = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    own = rows.select(F.trim("id").alias("entry_id"), flat("title").alias("title"), flat("summary").alias("summary"), "published", F.coalesce("updated", "published").alias("updated"), F.get("category", F.lit(0))["_term"].alias("category"))
    last = own.filter("entry_id is not null").groupBy("entry_id").agg(F.max(F.struct("updated", "title", "summary", "published", "category")).alias("r"))
    return last.select("entry_id", "r.title", "r.summary", "r.published", "r.updated", "r.category")


def date_proxy(born):
    """The year an author was about 35, held to 1900..1921."""
    return F.greatest(F.lit(1900), F.least(F.lit(1921), born + 35))


REGISTRY = {
    "parquet": parquet, "csv": csv, "jsonl": jsonl, "json": json_document, "texts": texts, "files": whole_texts, "posts": post_rows,
    "messages": messages_tsv, "xz": xz_lines, "zip": zip_members, "api": api_entries, "transcripts": transcript_words, "catalogue": book_catalogue,
}


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in REGISTRY:
        raise ValueError(f"unknown source {kind!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](spark, path, **options)
