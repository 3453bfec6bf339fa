import io
import lzma
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell import schema
from siftwell.functions import columns, text
from siftwell.operators import segment, texts
from siftwell.sources import readers, sinks


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first().r


def test_clean():
    assert text.clean("a\u0097b &amp;amp; c d") == "a—b & c d"
    assert text.clean(" x\u00a0\t y \n\n z\ufeff\u200b ") == "x y\n\nz"
    assert text.clean("a\u0081b") == "ab"
    assert text.clean(None) == text.clean("") == ""


@settings(max_examples=100)
@given(st.text())
def test_clean_settles(value):
    once = text.clean(value)
    assert text.clean(once.replace("&", "")) == once.replace("&", "").strip() or "&" in once or "\n" in once or " " in once


def test_source_has_no_hidden_characters():
    from pathlib import Path

    hidden = {*range(0x20), *range(0x7F, 0xA1), *range(0x200B, 0x2010), 0xFEFF} - {ord("\n")}
    for path in Path(__file__).resolve().parents[1].rglob("*.py"):
        assert not hidden & set(map(ord, path.read_text(encoding="utf-8"))), path


def test_column_versions_agree(spark):
    value = "He\u0092s &amp;quot;in\u00a0it\u200b. été là, _x 3½!?"
    assert column(spark, value, lambda c: columns.plain_marks(columns.repair_c1(columns.unescape_basic(c)))) == text.repair(value)
    for v in (value, "", "a-b  c　d", "x" * 5000):
        assert column(spark, v, columns.token_count) == text.count_tokens(v)


def test_sentences():
    assert texts.split_sentences('He left. "Why?" asked Dr. Lee. 5 came! no') == ["He left.", '"Why?" asked Dr. Lee.', "5 came! no"]
    assert texts.split_sentences("") == []


def test_html():
    html = "<p>One &amp; two</p><pre>code</pre><ul><li>three <b>four</b></li></ul><blockquote><p>no</p></blockquote>tail<br/>end"
    assert texts.html_blocks(html) == ["One & two", "three four", "tail end"] or texts.html_blocks(html) == ["One & two", "three four", "tail", "end"]
    assert texts.html_blocks(None) == []


def test_filters(spark):
    assert column(spark, "see https://a.b/c @bob now ok", texts.message) == "see  @user now ok"
    assert column(spark, "@bob hi", texts.message) is None
    assert column(spark, "*228 The court held that this is a long enough line", texts.opinion_paragraph) == "The court held that this is a long enough line"
    assert column(spark, "Argued by some one for the many of us here now", texts.opinion_paragraph) is None
    assert column(spark, "@PERSON1 met @CAPS2 in @ODD3 @DRX1 @DR1", texts.filled) == "Alex met Sam in it it Dr. Lee"
    assert column(spark, "@A @B @C @D @E @F", texts.filled) is None
    assert column(spark, "an illegible word", texts.filled) is None
    assert column(spark, "**b** __u__\n# Head\n- item `c`", texts.without_markdown) == "b u\nHead\nitem c"
    assert column(spark, "$a$ $b$ $c", texts.formula_heavy) is True
    assert column(spark, "xx*** START OF IT *** body *** END OF IT ***", texts.book_body).strip() == "body"
    prose = "A plain first paragraph.\n\nROMEO. Speak now.\n\nUPPER CASE HEADING\n\nshort\nverse\nlines\n\nCHAPTER one\n\n_Good_ prose that stays here."
    assert column(spark, prose, texts.prose_paragraphs) == ["A plain first paragraph.", "Good prose that stays here."]
    life = column(spark, "Doe, Jane, 1812-1870", readers.lifespan)
    assert life is not None, life
    assert (life.author, life.born, life.died) == ("Doe, Jane", 1812, 1870)
    assert column(spark, "Doe, Jane, 1812-1870; Roe, R., 1800-1860", readers.lifespan) is None
    name = column(spark, "WE_CHN_PTJ0_001_B1_1.txt", texts.essay_name)
    assert (name.writer, name.region, name.level) == ("CHN_001", "CHN", "B1")
    assert column(spark, "WE_ENS_PTJ0_001_XX_1.txt", texts.essay_name) is None
    for word, want in (("USE", "GET"), ("Use", "Get"), ("use", "get"), ("I", "Get")):
        assert column(spark, word, lambda c: texts.match_case(c, F.lit("get"))) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=30), st.integers(5, 20), st.integers(0, 30))
def test_windows_hold(sizes, low, more):
    units = [" ".join(["Word"] * n) for n in sizes]
    for window in segment.pack_windows(units, "doc", low, low + more):
        assert low <= len(window.split()) <= low + more


def test_windows_drop_endless_units():
    assert segment.pack_windows(["w " * 500], "d", 150, 400) == []
    packed = segment.pack_windows(["This is one sentence of ten words for the test. " * 60], "d", 150, 400)
    assert packed and all(150 <= len(w.split()) <= 400 for w in packed)


def test_turns(spark):
    words = [("m", "A", 0.0, 0.4, "Hello", False), ("m", "A", 0.4, 0.4, ",", True), ("m", "A", 0.5, 0.9, "you", False), ("m", "B", 1.0, 1.2, "yes", False), ("m", "A", 2.6, 2.9, "late", False), ("m", "A", 3.0, 3.0, ".", True)]
    rows = segment.turns(spark.createDataFrame(words, "meeting string, speaker string, start double, stop double, token string, punctuation boolean")).orderBy("turn").collect()
    assert [(r.speaker, r.text) for r in rows] == [("A", "Hello, you"), ("B", "yes"), ("A", "late.")]


def test_readers(spark, tmp_path):
    (tmp_path / "rows.xml").write_text('<posts><row Id="1" PostTypeId="2" CreationDate="2015-01-01" Body="' + "w " * 90 + '"/><row Id="2" PostTypeId="1" CreationDate="2015-01-01" Body="q"/><row Id="3" PostTypeId="2" CreationDate="2019-01-01" Body="' + "w " * 90 + '" OwnerUserId="7"/></posts>')
    rows = readers.post_rows(spark, str(tmp_path / "rows.xml"), 2010, 2018).collect()
    assert [(r.post_id, r.author, r.pub_year) for r in rows] == [("1", "anon-1", 2015)]
    line = lambda text, score: "\t".join(["x", '"Mon Jan 02 10:00:00 +0000 2012"', '"u1"', "x", "x", text, score, "x", "x", "x"])
    (tmp_path / "m.tsv").write_text("\n".join([line('"good one"', "0.9"), line('"low"', "0.1"), line('"nan"', "nan"), line("bad json", "0.9"), line('"RT @x y"', "0.9"), "short\tline"]))
    assert [r.text for r in readers.messages_tsv(spark, str(tmp_path / "m.tsv")).collect()] == ["good one"]
    (tmp_path / "l.xz").write_bytes(lzma.compress(b'{"a": 1}\n{"a": 2}\n'))
    assert readers.xz_lines(spark, str(tmp_path / "l.xz")).count() == 2
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("other.txt", "no")
        z.writestr("words/ES2002a.A.words.xml", '<d><w starttime="0.1" endtime="0.2">hi</w><w starttime="0.2" punc="true">.</w><gap/></d>')
    assert readers.zip_member(packed.getvalue(), "other.txt") == b"no"
    assert readers.zip_member(packed.getvalue(), "none") is None
    (tmp_path / "t.zip").write_bytes(packed.getvalue())
    assert [(r.token, r.punctuation) for r in readers.transcript_words(spark, str(tmp_path / "t.zip")).collect()] == [("hi", False), (".", True)]
    (tmp_path / "cat.csv").write_text('Text#,Type,Language,LoCC,Subjects,Title,Bookshelves,Authors\n1,Text,en,PR,Novel,"A, B",,"Doe, J., 1812-1870"\n2,Text,en,PR,Poetry,B,,"Doe, J., 1812-1870"\n3,Text,fr,PR,Novel,C,,"Doe, J., 1812-1870"\n4,Text,en,QA; PS,Novel,D,,"Roe, 1890?-1950"\n')
    assert sorted((r.book_id, r.born) for r in readers.book_catalogue(spark, str(tmp_path / "cat.csv")).collect()) == [("1", 1812), ("4", 1890)]
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_text("one\n\ntwo\n")
    assert [r.text for r in readers.texts(spark, str(folder / "a.txt")).collect()] == ["one", "two"]
    assert readers.texts(spark, str(folder)).count() == 1
    assert readers.read(spark, "files", str(folder)).first().name == "a.txt"
    with pytest.raises(ValueError):
        readers.read(spark, "nothing", "x")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3), ("b", None)], "doc_id string, score double")
    sinks.release_csv(df, str(tmp_path / "out"))
    back = {r["doc_id"]: r["score"] for r in readers.csv(spark, str(tmp_path / "out")).collect()}
    assert back["a"] == "0.333333" and back["b"] in (None, "null")
    with pytest.raises(ValueError):
        sinks.release_csv(df.withColumn("text", F.lit("x")), str(tmp_path / "no"))
    with pytest.raises(ValueError):
        sinks.release_csv(df.withColumn("note", F.lit("x" * 81)), str(tmp_path / "no"))
    sinks.write_json({"a": 1}, tmp_path / "r.json")
    assert "_provenance" in (tmp_path / "r.json").read_text()
    assert all(len(s.split()[0]) == 64 for s in sinks.checksums(tmp_path))
    parts = spark.createDataFrame([("d", 1, 0.5), ("d", 1, 0.5), ("d", 2, 0.1)], "doc_id string, token_idx int, logp double")
    assert sinks.consolidate(parts, ["doc_id", "token_idx"]).count() == 2


def test_schema(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert schema.nan_to_null(df).agg(F.avg("x").alias("m"), F.count("x").alias("n")).first() == (1.0, 1)
    with pytest.raises(ValueError):
        schema.require(df, "x", "y")
    with pytest.raises(Exception, match="non-finite"):
        schema.assert_finite(df, "x").collect()
