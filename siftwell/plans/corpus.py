"""Queries that build the corpus: cleaning, filters, windows, deduplication, sampling, edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell import config
from siftwell.functions.columns import SPACE, plain_marks, repair_c1, ruler, token_count
from siftwell.operators import dedup, edits, sample, segment, texts
from siftwell.plans import frames
from siftwell.plans.registry import register
from siftwell.plans.sqltext import DOCS, SIGNATURES, cleaned, fold as sql_fold, n_blank, strip, tokens
from siftwell.runtime import Scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)
count = lambda name: F.count(F.lit(1)).alias(name)


# text -----------------------------------------------------------------------------------------------------------------


@query(f"select doc_id, {n_blank('text')} as n_blank, {tokens('text')} as n_tokens, length(text) as n_chars from documents")
def ruler_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", ruler(F.col("text")).alias("n_blank"), token_count(F.col("text")).alias("n_tokens"), F.length("text").cast("long").alias("n_chars"))


@query("select distinct doc_id, sha256(text) as sha, (stratum || '-' || substr(sha256(text), 1, 12)) = doc_id as named from candidates")
def doc_identity(spark, d):
    sha = F.sha2("text", 256)
    return table(spark, d, "candidates").select("doc_id", sha.alias("sha"), (F.concat_ws("-", "stratum", F.substring(sha, 1, 12)) == F.col("doc_id")).alias("named")).distinct()


_CLEAN = "regexp_replace(array_to_string(list_transform(string_split({0}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t\\r\\f\\v]+', ' ', 'g'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), chr(10)), '^\\s+|\\s+$', '', 'g')".format(cleaned("text"))


@query(f"select doc_id, md5(any_value({_CLEAN})) as digest from candidates group by doc_id")
def clean_text(spark, d):
    return texts.cleaned(frames.docs(spark, d)).select(F.col("id").alias("doc_id"), F.md5("value").alias("digest"))


@query(f"""with {DOCS} select stratum, count(*) as docs, count(*) filter (where regexp_matches(text, '(?i)&(?:[a-z]{{2,8}}|#\\d{{2,5}}|#x[0-9a-f]{{2,4}});')) as with_entities,
count(*) filter (where regexp_matches(text, '[\\x{{80}}-\\x{{9f}}]')) as with_c1 from docs group by 1""")
def entity_rate(spark, d):
    rows = frames.docs(spark, d)
    return rows.groupBy("stratum").agg(count("docs"), F.count_if(F.col("text").rlike(texts.ENTITY)).alias("with_entities"), F.count_if(F.col("text").rlike("[\\x80-\\x9f]")).alias("with_c1"))


@query(f"select doc_id, md5(any_value({cleaned('text')})) as digest from (select doc_id, regexp_replace(text, '&', '', 'g') as text from documents) group by doc_id")
def repaired_marks(spark, d):
    plain = plain_marks(repair_c1(F.regexp_replace("text", "&", "")))
    return table(spark, d, "documents").select("doc_id", F.md5(plain).alias("digest"))


_ABBREVIATED = "|".join(a.replace(".", r"\.") for a in texts.ABBREVIATIONS)


_CUT = rf"""regexp_replace(text, '([.!?]["'')\]]?)[{SPACE}]+(["''(\[]?[A-Z0-9])', '\1' || chr(30) || '\2', 'g')"""


@query(rf"""with c as (select doc_id, {strip(_CUT)} as t from documents),
j as (select doc_id, regexp_replace(t, '((?:^|[({SPACE}])(?:{_ABBREVIATED})\.)\x1e', '\1 ', 'g') as t from c)
select doc_id, case when t = '' then 0 else len(string_split(t, chr(30))) end::int as sentences, md5(t) as digest from j""")
def sentence_counts(spark, d):
    return texts.sentences(table(spark, d, "documents")).select(F.col("id").cast("long").alias("doc_id"), F.size("value").alias("sentences"), F.md5(F.array_join("value", "\x1e")).alias("digest"))


@query()
def html_paragraphs(spark, d):
    rows = frames.docs(spark, d).withColumnRenamed("text", "html")
    return texts.paragraphs(rows).select(F.col("id").alias("doc_id"), F.size("value").alias("paragraphs"), F.md5(F.array_join("value", "\n")).alias("digest"))


@query()
def prose_paragraphs(spark, d):
    rows = frames.docs(spark, d).filter(F.col("stratum").isin("S1", "S2"))
    return rows.select("doc_id", F.size(texts.prose_paragraphs(texts.book_body(F.col("text")))).alias("paragraphs"))


_BASIC = "text"
for _ in range(4):
    for _entity, _char in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        _BASIC = f"replace({_BASIC}, '{_entity}', '{_char}')"


@query(rf"""with {DOCS}, b as (select doc_id, {_BASIC} as text, meta from docs where stratum = 'S10'), m as (select doc_id, starts_with(text, 'RT @') as again, trim(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '@\w+', '@user', 'g'), ' ') as t, try_cast(case when json_valid(meta) then json_extract_string(meta, '$.aa') end as double) as aa from b)
select doc_id, md5(case when {n_blank('t')} >= 3 and not again then t end) as digest from m where aa >= 0.8 and not isnan(aa)""")
def messages(spark, d):
    meta = F.when(F.try_parse_json("meta").isNotNull(), F.get_json_object("meta", "$.aa").try_cast("double"))
    rows = frames.docs(spark, d).filter("stratum = 'S10'").withColumn("aa", meta).filter("not isnan(aa) and aa >= 0.8")
    return rows.select("doc_id", F.md5(texts.message(F.col("text"))).alias("digest"))


@query(f"""with {DOCS}, p as (select doc_id, regexp_replace(unnest(string_split(text, chr(10))), '{texts.PAGE_MARK}', '', 'g') as p from docs where stratum = 'S11')
select doc_id, count(*) filter (where {n_blank('p')} >= 8 and not contains(p, '�') and not regexp_matches(p, '{texts.FORMAL}') and len(regexp_extract_all(p, '{texts.CITATION}')) <= 2) as paragraphs from p group by 1""")
def opinion_paragraphs(spark, d):
    parts = frames.docs(spark, d).filter("stratum = 'S11'").select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    return parts.groupBy("doc_id").agg(F.count(texts.opinion_paragraph(F.col("p"))).alias("paragraphs"))


def _fill_sql() -> str:
    out = "text"
    for kind, word in texts.FILL.items():
        out = f"regexp_replace({out}, '@{kind}(\\d+|([^A-Z\\d])|$)', '{word}\\2', 'g')"
    return f"regexp_replace({out}, '@([A-Z]+)\\d*', 'it', 'g')"


@query(rf"""with {DOCS} select doc_id, md5(case when len(regexp_extract_all(text, '@([A-Z]+)\d*')) <= 5 and not regexp_matches(text, '(?i)\?\?\?|\billegible\b|\bnot legible\b') then {_fill_sql()} end) as digest from docs where stratum = 'S9'""")
def essays_filled(spark, d):
    return frames.docs(spark, d).filter("stratum = 'S9'").select("doc_id", F.md5(texts.filled(F.col("text"))).alias("digest"))


@query(f"""with {DOCS} select doc_id, upper(split_part(source_doc_id, '_', 2)) as region, case when pub_year < 2011 then 'CC BY-SA 2.5' when pub_year < 2018 then 'CC BY-SA 3.0' when pub_year is not null then 'CC BY-SA 4.0' end as terms from docs where stratum = 'S8' and source_doc_id is not null""")
def writer_regions(spark, d):
    rows = frames.docs(spark, d, text=False).filter("stratum = 'S8' and source_doc_id is not null")
    return rows.select("doc_id", F.upper(F.split_part("source_doc_id", F.lit("_"), F.lit(2))).alias("region"), texts.license_by_year(F.col("pub_year")).alias("terms"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '(?m)^#{1,6}\s*', '', 'g'), '(?m)^\s*(?:[-*•]|\d+[.)])\s+', '', 'g'), '`([^`]*)`', '\1', 'g')) as digest from documents""")
def markdown_removed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(texts.without_markdown(F.col("text"))).alias("digest"))


@query(f"with {DOCS} select doc_id, length(text) - length(replace(text, '$', '')) > 4 as heavy from docs where stratum in ('S3', 'S4')")
def formula_heavy(spark, d):
    return frames.docs(spark, d).filter(F.col("stratum").isin("S3", "S4")).select("doc_id", texts.formula_heavy(F.col("text")).alias("heavy"))


@query("select coalesce(json_extract_string(props, '$.k'), '?') as k, count(*) as n from events group by 1")
def json_field_default(spark, d):
    return table(spark, d, "events").groupBy(texts.json_field(F.col("props"), "k").alias("k")).agg(count("n"))


# sequences ------------------------------------------------------------------------------------------------------------


@query()
def text_windows(spark, d):
    return segment.windows(table(spark, d, "documents"))


@query("""with s as (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) > interval '30 minutes' as gap from events),
t as (select user_id, ts, event_id, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)
select user_id, session::bigint as session, count(*) as n from t group by 1, 2""")
def event_sessions(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id")
    cut = segment.sessions(rows, ["user_id"], "ts", "ts", F.expr("interval 30 minutes"), ["event_id"])
    return cut.groupBy("user_id", "session").agg(count("n"))


@query("""with o as (select *, case when event_type is not distinct from lag(event_type) over (partition by user_id order by ts, event_id) and row_number() over (partition by user_id order by ts, event_id) > 1 then 0 else 1 end as fresh from events),
t as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as turn from o)
select user_id, turn::bigint as turn, event_type, string_agg(event_id::varchar, ' ' order by ts, event_id) as text from t group by 1, 2, 3""")
def merged_turns(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.col("event_id").cast("string").alias("text"))
    return segment.merge_turns(rows, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "turn", "event_type", "text")


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as p from events) where p = 1")
def latest_events(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return segment.latest_version(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("select user_id, string_agg(event_type, ',' order by ts, event_type) as kinds from (select distinct user_id, ts, event_type from events) group by 1")
def user_sequences(spark, d):
    return segment.sequences(table(spark, d, "events"), "user_id", "ts", "event_type").select("user_id", F.array_join("values", ",").alias("kinds"))


@query(f"""with {DOCS} select doc_id, source_doc_id from (select *, row_number() over (partition by source_doc_id order by md5('42:' || source_doc_id || ':' || doc_id)) as p from docs where source_doc_id is not null) where p <= 3""")
def windows_taken(spark, d):
    rows = frames.docs(spark, d, text=False).filter("source_doc_id is not null").select("doc_id", "source_doc_id")
    return segment.take_windows(rows, 3, "source_doc_id", "doc_id")


# deduplication --------------------------------------------------------------------------------------------------------


@query(f"with {DOCS} select min(doc_id) as doc_id, text_sha256 from docs group by text_sha256")
def exact_dedup(spark, d):
    return dedup.exact(frames.docs(spark, d, text=False).select("doc_id", "text_sha256"))


@query(f"with {DOCS}, {SIGNATURES} select doc_id, count(*) as shingles, sum(h)::bigint as checksum from g group by 1")
def shingle_hashes(spark, d):
    return dedup.shingle_hashes(frames.docs(spark, d)).groupBy("doc_id").agg(count("shingles"), F.sum("h").alias("checksum"))


_SIGS = f"""{DOCS}, {SIGNATURES},
sig as (select doc_id, [{', '.join(f'min(({a} * (h % {dedup.PRIME}) + {b}) % {dedup.PRIME})' for a, b in dedup.coefficients())}] as sig from g group by doc_id),
heads as (select min(doc_id) as doc_id, sig from sig group by sig), bands as (select doc_id, unnest(range(0, 16)) as band, sig from heads),
keyed as (select doc_id, band, array_to_string(sig[band * 4 + 1:band * 4 + 4], ',') as key from bands),
pairs as (select distinct a.doc_id as doc_a, b.doc_id as doc_b from keyed a join keyed b on a.band = b.band and a.key = b.key and a.doc_id < b.doc_id),
near as (select doc_a, doc_b, len(list_filter(list_zip(a.sig, b.sig), lambda x: x[1] = x[2])) / 64 as similarity from pairs join sig a on a.doc_id = doc_a join sig b on b.doc_id = doc_b)"""


def _signatures(spark, d):
    return Scratch(spark, "signatures").keep(dedup.signatures(dedup.shingle_hashes(frames.docs(spark, d))), "signatures")


@query(f"with {_SIGS} select doc_id, md5(array_to_string(sig, ',')) as digest from sig")
def minhash_signatures(spark, d):
    return dedup.signatures(dedup.shingle_hashes(frames.docs(spark, d))).select("doc_id", F.md5(F.concat_ws(",", "sig")).alias("digest"))


# Pairs are those of the representatives of equal signatures; signature_members names the rest.
@query(f"with {_SIGS} select doc_a, doc_b from pairs")
def band_pairs(spark, d):
    return dedup.candidate_pairs(dedup.signature_classes(_signatures(spark, d))[0])


@query(f"with {_SIGS} select sig.doc_id, heads.doc_id as class_id from sig join heads using (sig)")
def signature_members(spark, d):
    return dedup.signature_classes(_signatures(spark, d))[1]


@query(f"with {_SIGS} select doc_a, doc_b, similarity from near where similarity >= 0.8")
def similar_pairs(spark, d):
    heads, _ = dedup.signature_classes(_signatures(spark, d))
    return dedup.similar_pairs(heads, dedup.candidate_pairs(heads))


@query(f"with {_SIGS} select doc_id from heads where doc_id not in (select doc_b from near where similarity >= 0.8)")
def similar_removed(spark, d):
    sigs = _signatures(spark, d)
    heads, members = dedup.signature_classes(sigs)
    return dedup.keep_smallest(sigs.select("doc_id"), dedup.similar_pairs(heads, dedup.candidate_pairs(heads)), members=members)


# sampling -------------------------------------------------------------------------------------------------------------


@query(f"""with {DOCS}, ok as (select *, coalesce(pub_year between 1500 and 2021, false) as y, n_tokens between 150 and 400 as l from docs),
k as (select stratum, source_doc_id, sum(1) as n from (select distinct stratum, source_doc_id, text_sha256 from ok where y and l) group by 1, 2)
select stratum, count(*) as candidates, count(*) filter (where y) as after_year, count(*) filter (where y and l) as after_length, count(distinct text_sha256) filter (where y and l) as after_dedup,
(select coalesce(sum(least(n, 3)), 0)::bigint from k where k.stratum = ok.stratum) as after_cap from ok group by stratum""")
def corpus_funnel(spark, d):
    rows = frames.docs(spark, d, text=False)
    year = F.coalesce(sample.in_years(F.col("pub_year"), 1500, 2021), F.lit(False))
    good = year & sample.in_length(F.col("n_tokens"))
    per = rows.groupBy("stratum", "source_doc_id").agg(count("a"), F.count_if(year).alias("b"), F.count_if(good).alias("c"), F.countDistinct(F.when(good, F.col("text_sha256"))).alias("e"))
    return per.groupBy("stratum").agg(
        F.sum("a").alias("candidates"), F.sum("b").alias("after_year"), F.sum("c").alias("after_length"), F.sum("e").alias("after_dedup"), F.sum(F.least(F.col("e"), F.lit(config.SOURCE_CAP))).alias("after_cap")
    )


@query(f"with {DOCS} select doc_id from (select *, row_number() over (partition by source_doc_id order by md5('42:' || doc_id), doc_id) as p from docs) where p <= 3")
def source_capped(spark, d):
    return sample.source_cap(frames.docs(spark, d, text=False).select("doc_id", "source_doc_id"), 3).select("doc_id")


@query(f"with {DOCS} select stratum, greatest(0, least(4, floor((n_tokens - 150) * 5 / 251)))::int as bin, count(*) as n from docs group by 1, 2")
def length_bins(spark, d):
    return frames.docs(spark, d, text=False).groupBy("stratum", sample.length_bin(F.col("n_tokens")).alias("bin")).agg(count("n"))


@query(f"""with {DOCS}, b as (select *, greatest(0, least(4, floor((n_tokens - 150) * 5 / 251)))::int as bin from docs where n_tokens between 150 and 400)
select stratum, doc_id from (select *, row_number() over (partition by stratum, bin order by md5('42:' || doc_id), doc_id) as p from b) where p <= 5""")
def length_quota(spark, d):
    rows = frames.docs(spark, d, text=False).filter(sample.in_length(F.col("n_tokens"))).withColumn("bin", sample.length_bin(F.col("n_tokens")))
    return sample.reservoir(rows.select("stratum", "bin", "doc_id"), ["stratum", "bin"], 5, "doc_id").select("stratum", "doc_id")


@query()
def length_matched(spark, d):
    rows = frames.docs(spark, d, text=False).filter((F.col("stratum") == config.CALIBRATION) & sample.in_length(F.col("n_tokens")))
    return sample.length_matched(rows, 100)[0].select("doc_id", "n_tokens")


_CELL = "greatest(0, least(4, floor((n_tokens - 150) * 5 / 251)))::int as bin, coalesce(split_part(source_doc_id, ':', 1), '?') as field"


@query(f"with {DOCS} select stratum, {_CELL}, count(*) as n from docs where stratum in ('S5', 'S6') group by all")
def pair_cells(spark, d):
    rows = frames.docs(spark, d, text=False).filter(F.col("stratum").isin("S5", "S6"))
    field = F.coalesce(F.split_part("source_doc_id", F.lit(":"), F.lit(1)), F.lit("?"))
    parts = [sample.cell_counts(rows.filter(F.col("stratum") == s), field).withColumn("stratum", F.lit(s)) for s in ("S5", "S6")]
    return parts[0].unionByName(parts[1])


@query(f"""with {DOCS}, c as (select stratum, {_CELL}, count(*) as n from docs where stratum in ('S5', 'S6') group by all), a as (select * from c where stratum = 'S5'), b as (select * from c where stratum = 'S6')
select coalesce(a.bin, b.bin) as bin, sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0)))::bigint as mismatch from a full join b on a.bin = b.bin and a.field = b.field group by 1""")
def pair_mismatch(spark, d):
    cells = pair_cells(spark, d)
    a, b = (cells.filter(F.col("stratum") == s).select("bin", "field", F.col("n").alias(n)) for s, n in (("S5", "a"), ("S6", "b")))
    return a.join(b, ["bin", "field"], "full").groupBy("bin").agg(F.sum(F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))).alias("mismatch"))


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5('42:' || doc_id), doc_id) as p from documents) where p <= 10")
def reservoir_sample(spark, d):
    return sample.reservoir(table(spark, d, "documents").select("source", "doc_id"), "source", 10, "doc_id")


# edits ----------------------------------------------------------------------------------------------------------------


@query(r"select doc_id, len(regexp_extract_all(text, ', (and|but|so|yet) [a-z]')) as n_sites from documents")
def split_sites(spark, d):
    return edits.site_counts(table(spark, d, "documents"), ("T3",)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_sites").cast("long").alias("n_sites"))


_SPLIT_ALL = "text"
for _word in ("and", "but", "so", "yet"):
    _SPLIT_ALL = f"regexp_replace({_SPLIT_ALL}, ', {_word} ([a-z])', '. {_word.capitalize()} \\1', 'g')"


@query(f"select doc_id, md5({_SPLIT_ALL}) as digest from documents")
def split_texts(spark, d):
    out = edits.edited(table(spark, d, "documents"), "T3", (1.0,))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


_CLAUSES = rf"(?i)\b({'|'.join(edits.CLAUSE_VERBS)}) ((?:{'|'.join(edits.SUBJECTS)})\b)"


@query(rf"select doc_id, md5(regexp_replace(text, '{_CLAUSES}', '\1 that \2', 'g')) as digest, len(regexp_extract_all(text, '{_CLAUSES}'))::int as n_sites from documents")
def clause_texts(spark, d):
    out = edits.edited(table(spark, d, "documents"), "T6", (1.0,))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), F.col("n_sites_applied").alias("n_sites"))


@query(r"""with s as (select doc_id, unnest(regexp_extract_all(text, '[.!?] ([A-Z][a-z]+)', 1)) as w from documents)
select d.doc_id, count(w) as n_sites from documents d left join s on s.doc_id = d.doc_id and lower(w) not in ('moreover', 'furthermore', 'additionally', 'also', 'however', 'therefore', 'thus', 'hence', 'besides', 'but', 'and', 'so', 'yet', 'or') group by 1""")
def opener_sites(spark, d):
    rows = edits.site_counts(table(spark, d, "documents"), ("T4",))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_sites").cast("long").alias("n_sites"))


@query(r"select doc_id, p as intensity, ceil(p * len(regexp_extract_all(text, ', (and|but|so|yet) [a-z]')) - 1e-9)::bigint as k from documents, (values (0.25::double), (0.5::double), (1.0::double)) v(p)")
def edit_budgets(spark, d):
    out = edits.edited(table(spark, d, "documents"), "T3")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "intensity", F.col("n_sites_applied").cast("long").alias("k"))


@query(rf"""with {DOCS}, n as (select doc_id, len(regexp_extract_all(text, ', (and|but|so|yet) [a-z]')) as n from docs where stratum = 'S6')
select doc_id, 'T3' as edit from (select *, row_number() over (order by md5('42:' || doc_id || ':T3'), doc_id) as p from n where n > 0) where p <= 300""")
def edit_selection(spark, d):
    rows = frames.docs(spark, d).filter(F.col("stratum") == config.CALIBRATION)
    return edits.select_documents(edits.site_counts(rows, ("T3",)))


@query()
def edit_site_counts(spark, d):
    return edits.site_counts(frames.docs(spark, d))


@query()
def edit_variants(spark, d):
    rows = frames.docs(spark, d).filter(F.col("stratum") == config.CALIBRATION)
    return edits.variants(rows)


@query(f"""select upper({sql_fold('reference')}) as reference, upper({sql_fold('stratum')}) as stratum, try_cast(trim(source_in_pretraining, ' ') as double) as sip from source_overlap""")
def overlap_covariate(spark, d):
    from siftwell.operators.tables import covariate

    return covariate(table(spark, d, "source_overlap"))


@query("select stage, model, count(distinct coalesce(group_name, '?')) as groups from ledger where model is not null group by 1, 2")
def ledger_groups(spark, d):
    rows = table(spark, d, "ledger").filter("model is not null").select("stage", "model", F.coalesce("group_name", F.lit("?")).alias("group_name")).distinct()
    return rows.groupBy("stage", "model").agg(count("groups"))



# further texts and samples --------------------------------------------------------------------------------------------


@query("select doc_id, md5(chr(10) || text || chr(10)) as digest from documents where text is not null")
def book_bodies(spark, d):
    rows = table(spark, d, "documents").filter("text is not null")
    wrapped = F.concat(F.lit("Title\n*** START OF THE PROJECT BOOK ***\n"), "text", F.lit("\n*** END OF THE PROJECT BOOK ***\nlicence"))
    return rows.select("doc_id", F.md5(texts.book_body(wrapped)).alias("digest"))


@query(f"""with p as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+|[ \t\n\f\r]{{3,}}'), lambda x: {strip('x')}), lambda x: x <> '') as ps from documents)
select doc_id, len(ps)::int as parts, md5(array_to_string(ps, chr(10))) as digest from p""")
def blank_runs(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.blank_runs(F.col("text")).alias("ps")).select("doc_id", F.size("ps").alias("parts"), F.md5(F.array_join("ps", "\n")).alias("digest"))


@query("""select p_partkey, case when p_type = upper(p_type) and p_type <> lower(p_type) and length(p_type) > 1 then upper(p_name)
when left(p_type, 1) = upper(left(p_type, 1)) and left(p_type, 1) <> lower(left(p_type, 1)) then upper(left(p_name, 1)) || substr(p_name, 2) else p_name end as of_type,
case when p_brand = upper(p_brand) and p_brand <> lower(p_brand) and length(p_brand) > 1 then upper(p_name)
when left(p_brand, 1) = upper(left(p_brand, 1)) and left(p_brand, 1) <> lower(left(p_brand, 1)) then upper(left(p_name, 1)) || substr(p_name, 2) else p_name end as of_brand from part""")
def case_transfer(spark, d):
    return table(spark, d, "part").select("p_partkey", texts.match_case(F.col("p_type"), F.col("p_name")).alias("of_type"), texts.match_case(F.col("p_brand"), F.col("p_name")).alias("of_brand"))


@query("""with c as (select c_custkey, case when c_custkey % 7 = 0 then 'ENS' else upper(substr(c_mktsegment, 1, 3)) end as region, c_custkey % 3 as task, c_custkey % 50 as student, case c_custkey % 4 when 0 then 'A2' when 1 then 'B1' when 2 then 'B2' else 'C1' end as level from customer)
select c_custkey, region || '_' || student as writer, region, level from c where region <> 'ENS'""")
def essay_names(spark, d):
    rows = table(spark, d, "customer").withColumn("region", F.when(F.col("c_custkey") % 7 == 0, "ENS").otherwise(F.upper(F.substring("c_mktsegment", 1, 3))))
    level = F.element_at(F.array(*map(F.lit, ("A2", "B1", "B2", "C1"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    name = F.concat_ws("_", F.lit("WE"), "region", (F.col("c_custkey") % 3).cast("string"), (F.col("c_custkey") % 50).cast("string"), F.concat(level, F.lit("_0")), F.lit("1.txt"))
    read = rows.select("c_custkey", texts.essay_name(name).alias("e")).filter("e is not null")
    return read.select("c_custkey", "e.writer", "e.region", "e.level")


@query(f"""with {DOCS} select doc_id from (select *, row_number() over (partition by source, source_doc_id order by md5('42:' || doc_id), doc_id) as p from docs) where p <= case source when 'pelic' then 4 when 'ami' then 8 else 3 end""")
def capped_by_source(spark, d):
    return sample.source_caps(frames.docs(spark, d, text=False).select("doc_id", "source", "source_doc_id")).select("doc_id")


@query(f"with {DOCS} select source_doc_id, row_number() over (order by md5('42:' || source_doc_id), source_doc_id) - 1 as place from (select distinct source_doc_id from docs where source_doc_id is not null)")
def shuffled_sources(spark, d):
    rows = frames.docs(spark, d, text=False).filter("source_doc_id is not null")
    return sample.shuffled_groups(rows, "source_doc_id", Scratch(spark, "shuffled"))


@query(f"with {DOCS} select source_doc_id, doc_id from (select *, row_number() over (partition by source_doc_id order by md5('42:' || doc_id), doc_id) as p from docs where source_doc_id is not null) where p = 1")
def one_per_source(spark, d):
    return sample.one_of_each(frames.docs(spark, d, text=False), "source_doc_id", "doc_id")
