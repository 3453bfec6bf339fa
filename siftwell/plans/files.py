"""Queries that write tables in a format and read them again through the readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators.segment import latest_version
from siftwell.plans.registry import register
from siftwell.runtime import Scratch, table
from siftwell.sources import readers, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)


def _folder(spark, name: str) -> str:
    return f"{Scratch(spark, 'files').root}/{name}"


def _one_document(spark, rows, root: str, path: str) -> None:
    """Lines of XML as a single document."""
    line = lambda x: spark.createDataFrame([(x,)], "value string")
    line(f"<{root}>").unionByName(rows).unionByName(line(f"</{root}>")).coalesce(1).write.text(path)


@query("select doc_id, stratum, license, md5(text) as digest from candidates")
def csv_rows(spark, d):
    path = _folder(spark, "rows.csv")
    table(spark, d, "candidates").select("doc_id", "stratum", "license", "text").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = readers.read(spark, "csv", path, columns=["doc_id", "stratum", "license", "text"])
    return rows.select("doc_id", "stratum", "license", F.md5("text").alias("digest"))


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def plain_csv_rows(spark, d):
    path = _folder(spark, "customer.csv")
    table(spark, d, "customer").write.option("header", True).option("sep", "\t").csv(path)
    return readers.csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", sep="\t", line_breaks=False)


@query("select stage, model, group_name, n, utc, count(*) as times from ledger group by all")
def jsonl_rows(spark, d):
    path = _folder(spark, "ledger")
    table(spark, d, "ledger").write.json(path)
    rows = readers.read(spark, "jsonl", path, schema="stage string, model string, group_name string, n int, utc string")
    return rows.groupBy("stage", "model", "group_name", "n", "utc").agg(F.count(F.lit(1)).alias("times"))


@query("select instance, threshold from thresholds")
def json_document(spark, d):
    path = _folder(spark, "thresholds")
    whole = table(spark, d, "thresholds").agg(F.to_json(F.collect_list(F.struct("instance", "threshold"))).alias("value"))
    whole.write.text(path)
    return readers.read(spark, "json", path, schema="instance string, threshold double")


@query("select item_id::varchar as item_id, md5(text) as digest from eval_items")
def text_files(spark, d):
    path = _folder(spark, "items")
    table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("item"), "text").repartition("item").write.partitionBy("item").text(path)
    read = readers.read(spark, "files", path)
    item = F.regexp_extract("path", "item=([^/]+)/", 1)
    return read.select(item.alias("item_id"), F.md5(F.regexp_replace("text", "\n$", "")).alias("digest"))


@query("select md5(trim(text, e' \\t\\n\\r')) as digest, count(*) as times from eval_items group by 1")
def text_items(spark, d):
    path = _folder(spark, "items.csv")
    table(spark, d, "eval_items").select("text").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read(spark, "texts", path).groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("times"))


_ESCAPED = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;"))


@query("""select doc_id::varchar as post_id, pub_year, coalesce(source_doc_id, 'anon-' || doc_id) as author, md5(text) as digest from documents
where pub_year between 2009 and 2019 and doc_id % 5 <> 0 and len(regexp_extract_all(text, '\\S+')) between 80 and 700""")
def forum_posts(spark, d):
    """Answers from a forum dump: of every fifth document a question is made, which is passed over."""
    body, owner = F.col("text"), F.col("source_doc_id")
    for char, entity in _ESCAPED:
        body, owner = F.replace(body, F.lit(char), F.lit(entity)), F.replace(owner, F.lit(char), F.lit(entity))
    rows = table(spark, d, "documents").filter("pub_year is not null").select(
        F.concat(
            F.lit('  <row Id="'), F.col("doc_id").cast("string"), F.lit('" PostTypeId="'), F.when(F.col("doc_id") % 5 == 0, "1").otherwise("2"), F.lit('" CreationDate="'), F.col("pub_year").cast("string"), F.lit('-02-03T04:05:06.000" '),
            F.when(owner.isNotNull(), F.concat(F.lit('OwnerUserId="'), owner, F.lit('" '))).otherwise(""), F.lit('Body="'), body, F.lit('" />'),
        ).alias("value")
    )
    path = _folder(spark, "posts")
    _one_document(spark, rows, "posts", path)
    return readers.read(spark, "posts", path, year_from=2009, year_to=2019).select("post_id", "pub_year", "author", F.md5("html").alias("digest"))


@query("""select doc_id::varchar as author, md5(text) as digest, round((doc_id % 10) / 10, 1) as score from documents where text is not null and (doc_id % 10) / 10 >= 0.8 and not starts_with(text, 'RT @')""")
def tsv_messages(spark, d):
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    own = table(spark, d, "documents").filter("text is not null")
    score = F.when(F.col("doc_id") % 10 == 7, "NaN").otherwise(F.format_string("%.1f", F.col("doc_id") % 10 / 10))
    cells = [F.lit("x"), quoted(F.lit("Mon")), quoted(F.col("doc_id").cast("string")), F.lit("0"), F.lit("0"), quoted(F.col("text")), score, F.lit("0"), F.lit("0"), F.lit("0")]
    path = _folder(spark, "messages")
    own.select(F.concat_ws("\t", *cells).alias("value")).write.text(path)
    return readers.read(spark, "messages", path).select("author", F.md5("text").alias("digest"), F.round("score", 1).alias("score"))


@query("""select c_custkey::varchar as book_id, c_name as author, (1800 + c_custkey % 130)::int as born, (1850 + c_custkey % 130)::int as died, greatest(1900, least(1921, 1835 + c_custkey % 130))::int as year
from customer where c_custkey % 3 <> 0 and c_custkey % 5 <> 0 and c_nationkey % 2 = 0 and c_mktsegment <> 'BUILDING'""")
def catalogue_books(spark, d):
    """Books of single authors with known years, in English and the wanted classes, without verse, and the year each stands for."""
    k = F.col("c_custkey")
    years = F.concat(F.lit(", "), (1800 + k % 130).cast("string"), F.lit("-"), (1850 + k % 130).cast("string"))
    rows = table(spark, d, "customer").select(
        k.cast("string").alias("Text#"), F.when(k % 5 == 0, "Sound").otherwise("Text").alias("Type"), F.lit("en").alias("Language"), F.when(F.col("c_nationkey") % 2 == 0, "PR; Z").otherwise("QA").alias("LoCC"),
        F.when(F.col("c_mktsegment") == "BUILDING", "English poetry").otherwise("Fiction").alias("Subjects"), F.lit("A title").alias("Title"), F.lit("").alias("Bookshelves"),
        F.when(k % 3 == 0, F.concat(F.col("c_name"), years, F.lit("; Other, A, 1850-1900"))).otherwise(F.concat(F.col("c_name"), years)).alias("Authors"),
    )
    path = _folder(spark, "catalogue")
    rows.write.option("header", True).option("quoteAll", True).csv(path)
    return readers.read(spark, "catalogue", path).withColumn("year", readers.date_proxy(F.col("born")).cast("int"))


@query("select doc_id::varchar as entry_id, pub_year || '-01-01' as published, source as category, md5(trim(regexp_replace(source || ' ' || n_chars, '\\s+', ' ', 'g'))) as digest from documents where pub_year is not null")
def archive_entries(spark, d):
    """Entries of overlapping answers of an archive: every entry comes twice, the second time updated."""
    own = table(spark, d, "documents").filter("pub_year is not null")
    year = F.col("pub_year").cast("string")
    entry = lambda title, update: F.concat(F.lit("<entry><id>"), F.col("doc_id").cast("string"), F.lit("</id><published>"), year, F.lit("-01-01</published><updated>"), year, F.lit(update), F.lit("</updated><title>"), title, F.lit('</title><summary>s</summary><category term="'), "source", F.lit('"/></entry>'))
    both = own.select(entry(F.lit("old"), "-01-01").alias("value")).unionByName(own.select(entry(F.concat_ws(" \n ", "source", F.col("n_chars").cast("string")), "-05-01").alias("value")))
    path = _folder(spark, "answers")
    _one_document(spark, both, "feed", path)
    return readers.read(spark, "api", path).select("entry_id", "published", "category", F.md5("title").alias("digest"))


@query("""select instance, item_id, group_name, score from (select *, row_number() over (partition by instance, item_id order by run_id desc, group_name desc, score desc) as p from scores where score is not null and not isnan(score) and item_id is not null and run_id is not null) where p = 1""")
def parts_consolidated(spark, d):
    """Scores flushed in parts, made one row per instance and item."""
    path = _folder(spark, "parts")
    rows = table(spark, d, "scores").filter("score is not null and not isnan(score) and item_id is not null and run_id is not null").select("instance", "item_id", "group_name", "score", "run_id")
    for k in range(3):
        sinks.write_table(rows.filter(F.pmod(F.xxhash64("run_id"), F.lit(3)) == k), path, mode="append")
    whole = sinks.consolidate(readers.parquet(spark, path).select(*rows.columns, *((-F.col("score")).alias("low"), F.col("run_id").alias("run"))), ["instance", "item_id"], [F.desc("run"), F.desc("group_name"), "low"])
    return whole.select("instance", "item_id", "group_name", "score")


@query("select source, lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1, 2")
def table_rewritten(spark, d):
    """A table written over an older one, by partition, and read with few columns."""
    path = _folder(spark, "documents")
    own = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    sinks.write_table(own.limit(10), path, ["source"])
    sinks.write_table(own, path, ["source"])
    return readers.read(spark, "parquet", path, columns=["source", "lang", "n_chars"]).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("select instance, item_id, try_cast(printf('%.6g', score) as double) as score from (select instance, item_id, arg_max(score, run_id) as score from scores where score is not null and not isnan(score) group by 1, 2)")
def release_rows(spark, d):
    """A release of scores with six significant digits, and read again."""
    from siftwell.plans import frames

    path = _folder(spark, "release")
    sinks.release_csv(frames.latest(spark, d).select("instance", "item_id", "score"), path)
    return readers.csv(spark, path, "instance string, item_id string, score double", line_breaks=False)


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as p from events) where p = 1")
def versions_reread(spark, d):
    """The last version of each key of a table that arrives in batches, as the resumable scorer leaves it."""
    from siftwell.streaming import resume

    inbox, out = _folder(spark, "inbox"), _folder(spark, "scored")
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    rows.repartition(3).write.parquet(inbox)
    resume.score_arrivals(spark, inbox, rows.schema.simpleString()[7:-1].replace(":", " "), lambda batch: batch, out, _folder(spark, "state"), files_per_batch=1)
    return latest_version(spark.read.parquet(out), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")
