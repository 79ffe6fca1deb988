"""What follows a corpus: counts of changed documents, run logs, archives, and patterns over words."""

import io
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.operators import incremental, patterns
from lexloom.sources import readers, runs


def bag(frame):
    return Counter((r["doc_id"], r["version"], r["term"], r["tf"]) for r in frame.collect())


DOCS = "doc_id bigint, version int, text string"


def test_counts_follow_the_corpus(spark):
    before = spark.createDataFrame([(1, 0, "a b a"), (2, 0, "b"), (3, 0, "c"), (4, 0, ""), (5, 0, None)], DOCS)
    after = spark.createDataFrame([(1, 0, "a b a"), (2, 1, "b d"), (4, 0, ""), (5, 2, "now a"), (6, 1, "new")], DOCS)
    kept = incremental.versioned_bags(before)
    found = incremental.updated(kept, after)
    assert bag(found) == bag(incremental.versioned_bags(after))
    fresh, same = incremental.changes(kept, after.select("doc_id", "version"))
    assert {r["doc_id"] for r in fresh.collect()} == {2, 5, 6} and {r["doc_id"] for r in same.collect()} == {1, 4}
    assert bag(incremental.updated(found, after)) == bag(found)
    assert incremental.updated(found, after.limit(0)).count() == 0


def test_texts_of_unchanged_documents_are_not_read(spark):
    """Reading the text of an unchanged document would fail."""
    before = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], DOCS)
    after = spark.createDataFrame([(1, 0, "x"), (2, 1, "c")], DOCS).withColumn("text", F.when(F.col("version") == 0, F.raise_error(F.lit("read"))).otherwise(F.col("text")))
    assert bag(incremental.updated(incremental.versioned_bags(before), after)) == Counter([(1, 0, "a", 1), (2, 1, "c", 1)])


def test_batches_of_changes(spark, tmp_path):
    state = {"kept": incremental.versioned_bags(spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], DOCS))}
    source = tmp_path / "in"
    source.mkdir()
    changes = "doc_id bigint, version int, text string, deleted boolean"
    spark.createDataFrame([(2, 1, "bb", False), (2, 2, "bbb", False), (3, 1, None, True), (4, 1, "d d", None)], changes).write.parquet(str(source / "1"))
    step = incremental.follow(lambda: state["kept"], lambda df: state.update(kept=df))
    stream = spark.readStream.schema(changes).option("recursiveFileLookup", "true").parquet(str(source))
    stream.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    want = Counter([(1, 0, "a", 1), (2, 2, "bbb", 1), (4, 1, "d", 2)])
    assert bag(state["kept"]) == want
    step(spark.read.parquet(str(source / "1")), 1)  # again
    assert bag(state["kept"]) == want
    assert {r["term"]: (r["df"], r["cf"]) for r in incremental.totals(state["kept"]).collect()} == {"a": (1, 1), "bbb": (1, 1), "d": (1, 2)}


def test_runs_are_logged(spark, tmp_path):
    log = f"{tmp_path}/log"
    found = runs.logged(spark, log, "count", "all", lambda: spark.range(7), f"{tmp_path}/a", k=1)
    assert found.count() == 7
    with pytest.raises(ZeroDivisionError):
        runs.logged(spark, log, "count", "all", lambda: 1 / 0, f"{tmp_path}/b", k=1)
    runs.logged(spark, log, "count", "all", lambda: spark.range(0), f"{tmp_path}/c", k=1)
    rows = sorted((r["status"], r["rows"], r["ended"] is not None and r["ended"] >= r["started"]) for r in runs.runs(spark, log).where("status <> 'failed'").collect())
    assert rows == [("done", 0, True), ("done", 7, True)] and runs.runs(spark, log).where("status = 'failed' AND rows IS NULL").count() == 1
    newest = runs.latest(spark, log).collect()
    assert [(r["rows"], r["outfile"]) for r in newest] == [(0, f"{tmp_path}/c")]


def test_archives_are_read_by_tasks(spark, tmp_path):
    def archive(name, files):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        (tmp_path / name).write_bytes(data.getvalue())

    archive("a.zip", {"set/citations.CSV": "id,title,pubdate\nd1,\"T, one\",1999-01-01\nd2,Two,\n", "set/wordcounts/wordcounts_d1.CSV": "WORDCOUNTS,WEIGHT\nword,3\nété,1\n", "set/readme.txt": "x"})
    archive("b.zip", {"citations.CSV": "﻿id,title,pubdate\nd1,\"T, one\",1999-01-01\nd3,Three,2001-05\n", "wordcounts/wordcounts_d1.CSV": "WORDCOUNTS,WEIGHT\nword,3\n", "wordcounts/wordcounts_d3.CSV": "WORDCOUNTS,WEIGHT\nz,x\n"})
    (tmp_path / "c.zip").write_bytes(b"no archive")
    meta, counts = readers.data_sets(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["title"], r["year"]) for r in meta.collect()) == [("d1", "T, one", "1999"), ("d2", "Two", ""), ("d3", "Three", "2001")]
    assert sorted((r["doc_id"], r["word"], r["weight"]) for r in counts.where("weight IS NOT NULL").collect()) == [("d1", "word", 3), ("d1", "été", 1)]
    entries = {(r["archive"][-5:], r["entry"]): bytes(r["content"]) for r in readers.archive_entries(spark, str(tmp_path)).collect()}
    assert len(entries) == 6 and entries["a.zip", "set/readme.txt"] == b"x"


def test_files_are_grouped_by_day(spark):
    rows = [("/x/b_v2.pdf", "2001-02-03 10:00:00"), ("/y/a_v1.pdf", "2001-02-03 23:00:00"), ("/x/c.pdf", "2001-02-04 00:00:00"), ("/x/d.pdf", None)]
    files = spark.createDataFrame(rows, "path string, created string").withColumn("created", F.to_timestamp("created"))
    found = {(str(r["day"]), r["number"]): (r["path"], r["issue"]) for r in readers.imported_by_date(files, r"_v(\d+)").collect()}
    assert found == {("2001-02-03", 1): ("/x/b_v2.pdf", "2"), ("2001-02-03", 2): ("/y/a_v1.pdf", "1"), ("2001-02-04", 1): ("/x/c.pdf", ""), ("None", 1): ("/x/d.pdf", "")}


TERMS = "the than thanking thing sing singing banana bananas ab abc ababc xabcabcx word world worlds mentioning moment été naïve a an zzzz eel seen lee foo.bar foobar ABC Abc running rerunning unpaired repaired".split()
PATTERNS = [
    "ing", "^than", "^than.*ing$", "ing$", "(ab)+c", "(abc){2}", "ab?c", "ab*c", "wor(ld|d)", "worlds?", "wor.d", "e{2}", "e{1,3}n", "[aeiou]{2}", "ana(na)", "(?:ana)na", "an(an)?a", "x|abc", "(abc|xyz)", "foo\\.bar", "foo.bar",
    "^a$", "^..$", "", ".*", "naïve", "été", "(?i)abc", "[A]bc", "run+ing", "^(un|re)[a-z]+ed$", "mo(?=ment)", "(?<=re)pair", "(?!than)th", "\\bword", "\\w+ing", "z{4}", "zzz+", "th(e|an)", "the??", "than(king)*", "th[ai]n",
    "s\\w*ng", "bananas", "^banana$", "(b)(anana)", "pai(red)+", "r.e.r", "\\x61bc", "wor\\x6cd",
]


def test_patterns_by_the_index(spark):
    assert len(PATTERNS) == 50
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    index = patterns.piece_index(terms).cache()
    for p in PATTERNS:
        want = {t for t in TERMS if re.search(p, t)}
        pieces = patterns.required(p)
        # no match is lost by the pieces
        assert all(all(x in t for x in pieces) for t in want), p
        found = patterns.candidates(index, pieces) if pieces else terms
        assert {r["term"] for r in found.collect() if re.search(p, r["term"])} == want, p
    assert patterns.required("^than.*ing$") == ["han", "ing", "tha"] and patterns.required("(a") == [] and patterns.required("(?i)abc") == []
    assert {r["term"] for r in patterns.matching_terms(terms, index, "wor(ld|d)").collect()} == {"word", "world", "worlds"}
    assert {r["term"] for r in patterns.candidates(index, ["wor"]).collect()} == {"word", "world", "worlds"}
