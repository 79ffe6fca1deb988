import zipfile

from lexloom.sources import readers, writers


def test_corpus_from_files(spark, tmp_path):
    (tmp_path / "meta.csv").write_text('filename,itemID,title\na.txt,1,"A, ""quoted"""\nb.txt,2,B\n,,\n')
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes("héllo\xff".encode("latin-1") + "é".encode())
    (tmp_path / "t/p.html").write_text("<b>x</b>y")
    (tmp_path / "t/q.doc").write_bytes(b"doc")
    meta = readers.metadata(spark, str(tmp_path / "meta.csv"))
    rows = {r["itemID"]: r for r in readers.corpus(meta, readers.whole_texts(spark, str(tmp_path / "t"))).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["title"] == 'A, "quoted"' and rows["2"]["text"] == "" and rows["1"]["text"].endswith("é")
    found = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.extract(spark, str(tmp_path / "t"), {"doc": lambda b: bytes(b).decode().upper()}).collect()}
    assert found["p.html"] == "xy" and found["q.doc"] == "DOC"


def test_word_counts_and_archives(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/wordcounts_d1.CSV").write_text("WORDCOUNTS,WEIGHT\nword,3\n")
    (tmp_path / "c.csv").write_text("id,title,pubdate\nd1,T,1999-01-01\n")
    meta, counts = readers.word_counts(spark, str(tmp_path / "c.csv"), str(tmp_path / "w"))
    assert tuple(meta.first()) == ("d1", "T", "1999", "external") and tuple(counts.first()) == ("d1", "word", 3)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/y.txt", "1")
    assert readers.unpack(str(tmp_path / "z.zip"), str(tmp_path / "out")) == ["x/y.txt"]


def test_stop_words(spark, tmp_path):
    (tmp_path / "s.txt").write_text(" foo \n\nbar\n")
    assert readers.stop_words(spark, None, str(tmp_path / "s.txt"), "baz\nfoo") == ("foo", "bar", "baz")
    assert "the" in readers.stop_words(spark, "english")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "x,y")], "k string, text string")
    writers.csv(df, str(tmp_path / "c"))
    assert tuple(readers.metadata(spark, str(tmp_path / "c")).first()) == ("a", "x,y")
    writers.export_texts(df, str(tmp_path / "e"))
    writers.records(df, "text", str(tmp_path / "r"))
    assert "<\\/b>" in writers.page("t<", {"a": "</b>"}) and "t&lt;" in writers.page("t<", {})
    assert writers.cached(spark, str(tmp_path / "k"), lambda: df).count() == writers.cached(spark, str(tmp_path / "k"), lambda: 1 / 0).count() == 1
    assert writers.run_key("q", {"a": 1}) != writers.run_key("q", {"a": 2})


def test_views_are_saved_as_text(spark):
    from lexloom.plans.queries import queries

    state = writers.view_state("wordcloud_by_label", {"n": 3, "label": "lang", "labels": ["de", "fr"]})
    assert writers.from_view_state(state) == ("wordcloud_by_label", {"n": 3, "label": "lang", "labels": ["de", "fr"]})
    odd = {"a&b": "x=1?&é", "none": None, "list": [], "": 0.5}
    assert writers.from_view_state(writers.view_state("q?/&", odd)) == ("q?/&", odd)
    rows = writers.view(spark, "/root/testdata/sf0.001", state, queries()).collect()
    assert {r["label"] for r in rows} == {"de", "fr"} and len(rows) >= 6
