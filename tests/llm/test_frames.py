"""Operators on tables: odd rows, empty tables, plain versions, SQL and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import bpe_lexicon, components, gru_lm, packing, phrase_prints, quality, queries, reply_trees, secret_scan, simhash, toxicity, url_rules
from lexloom.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "word " * 4000
ODD = [
    (1, "the same words as ever stand here", "en", 1), (1, "the same words as ever stand here", "en", 1), (2, "The same words as ever stand here", None, 2), (3, None, "en", 3), (4, "", "en", 4),
    (None, "a row without an id password=abcdef123", "en", 5), (5, LONG, "de", 6), (6, " \n\t ", "de", 7), (7, "été 你好 😀 <|endoftext|>", "fr", 8), (8, "x", "fr", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    # columns whose names the operators use for their own
    rows = [(*r, "a", 1, "b") for r in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint, key string, fp bigint, word string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def by_id(frame):
    return sorted((r.asDict() for r in frame.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def test_bpe(spark, odd, none):
    rows = by_id(bpe_lexicon.round_trip(odd, lexicon_words=4))
    assert len(rows) == len(ODD)
    library = bpe_lexicon.vocabulary("word_bpe_49k.json").library
    for (doc_id, text, *_), row in zip(sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)), rows):
        ids = library.encode(text or "", add_special_tokens=False).ids
        if doc_id != 1:
            assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_lexicon.round_trip(none).count() == 0


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(0)
    word = lambda: "w" + str(rng.integers(0, 50))
    bad = rng.random(400) < 0.3
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(20)) + (" you dolt" if b else "")) for i, b in enumerate(bad.tolist())], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad.tolist())] + [(0, int(bad[0])), (None, 1), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    rows = by_id(toxicity.score(docs, model))
    assert all(r["predicted"] == int(b) for r, b in zip(rows, bad)) and {r["held_out"] for r in rows} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert toxicity.reject(docs, model).count() == (~bad).sum()
    odd_rows = by_id(toxicity.score(odd, model))
    assert len(odd_rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd_rows) and odd_rows[-1]["held_out"] is False
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    only = toxicity.train(docs, labels.where("toxic = 1"))
    assert only.score("x") > 0.99


def test_held_out_labels_do_not_matter(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a.index == b.index and (a.weights == b.weights).all()


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("com", "/en/7/x", "allow"), ("a.b.c", "", "block")]


def slow_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    hosts = ["com", "example.com", "WWW.Example.com", "xcom", "example.net", "m.example.net", "net", "a.b.c", "x.a.b.c", "b.c", "", "com.", "ü.com"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/7/x", "/en/70?q=/de/", "/de/8#x", "/de/", "?/en/", "/EN/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c", "http://example.com/en/7"] * 3
    pages = spark.createDataFrame([(None if i % 17 == 0 else i % 90, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, hk string, rule string")
    for per in (2, 1000):
        got = Counter(tuple(r) for r in url_rules.judge(pages, url_rules.rules_frame(spark, RULES), rows_per_sweep=per).collect())
        assert got == Counter((None if i % 17 == 0 else i % 90, *slow_rule(u)) for i, u in enumerate(urls))
    assert url_rules.judge(pages.limit(0), url_rules.rules_frame(spark, RULES)).count() == 0
    no_rules = url_rules.judge(pages, url_rules.rules_frame(spark, RULES).limit(0)).collect()
    assert len(no_rules) == len(urls) and {r["verdict"] for r in no_rules} == {"allow"}


def test_simhash(spark, odd, none):
    rows = by_id(simhash.components(odd))
    assert len(rows) == len(ODD)
    groups = {r["doc_id"]: r["component_id"] for r in rows}
    assert groups[1] == groups[2] == 1 and groups[3] == groups[4] == groups[6] == 3
    assert [r["fingerprint"] for r in rows if r["doc_id"] == 3] == ["0" * 16]
    kept = by_id(simhash.keep_one(odd))
    assert [r["doc_id"] for r in kept] == [1, 3, 5, 7, 8, None] and kept[0]["word"] == "b"
    assert simhash.components(none).count() == 0 and simhash.keep_one(none).count() == 0


def plain_near_copies(rows):
    """The smallest id of each component of the pairs with five-word Jaccard of 0.8 or more, by all pairs."""
    def grams(text):
        w = (text or "").encode().lower().split()
        return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} - {()}
    ids, own = [r[0] for r in rows], [grams(r[1]) for r in rows]
    near = [(i, j) for i in range(len(own)) for j in range(i + 1) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    return set(components.union_find(np.array([ids[i] for i, _ in near]), np.array([ids[j] for _, j in near]))[1].tolist())


@pytest.mark.parametrize("most", [2, 48])
def test_near_copies_against_all_pairs(spark, most):
    rng = np.random.default_rng(9)
    word = lambda k: [f"w{i}" for i in rng.integers(0, 3000, k)]
    rows, passage = [], word(60)
    for base in ([word(n) for n in (4, 9, 30, 120, 200, 400)] + [word(25) + passage + word(25) for _ in range(10)] + [passage + word(12) for _ in range(10)]):
        for k in range(6):
            new = list(base)
            for i in rng.integers(0, len(new), k * len(new) // 150 + (k > 3)):
                new[i] = word(1)[0]
            rows.append((len(rows), " ".join(new[: len(new) - k])))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, rows[7][1]), (1004, rows[7][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r["doc_id"] for r in simhash.keep_one(docs, most=most).collect()} == plain_near_copies(rows)


def test_near_copies_of_repeated_ids(spark):
    """An id with two texts loses only the text that is a near copy, and keeps both if neither is."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, d), (3, d), (4, c + " end"), (5, b), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == Counter([(1, a), (2, b), (3, c), (3, d), (None, a)])


def test_pipeline_drops_near_copies(spark):
    """The near-duplicate stage on texts with 4-11 bits between near copies."""
    import corpus_pipeline

    docs = table(spark, SF, "documents").where("doc_id IN (1, 6, 42, 106, 110, 145, 155, 177, 185, 192)")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, SF).collect()}
    assert kept == plain_near_copies(rows) and {6, 1} < kept and not {145, 177} & kept


def test_simhash_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    hot = base[0]
    for _ in range(3):
        hot = np.append(hot, hot ^ (np.uint64(1) << rng.integers(20, 64, np.size(hot)).astype(np.uint64)))
        hot = np.unique(np.concatenate([hot] * 1 + [hot ^ (np.uint64(1) << rng.integers(20, 64, len(hot)).astype(np.uint64)) for _ in range(4)]))
    fp = np.unique(np.concatenate([base, hot, base ^ np.uint64(7), base ^ np.uint64(0xFF)]))
    frame = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp bigint")
    near = components.stars(simhash.links(frame, len(fp), 3, tile=16)).collect()
    got = {int(v): int(v) for v in fp.view(np.int64)} | {r["node"]: r["root"] for r in near}
    x, y = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3)
    nodes, root = components.union_find(fp.view(np.int64)[x], fp.view(np.int64)[y])
    assert got == dict(zip(nodes.tolist(), root.tolist()))


def test_language_model(spark, odd, none):
    rows = by_id(gru_lm.score(odd, vocabulary=3, table=5))
    known = Counter()
    for doc_id, text, *_ in ODD:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            known.update((text or "").encode().lower().split() + [b"\n"])
    n, v = sum(known.values()), len(known)
    assert len(rows) == len(ODD)
    texts = {r[0]: r[1] for r in ODD}
    for r in rows:
        found = (texts[r["doc_id"]] or "").encode().lower().split() + [b"\n"]
        assert math.isclose(r["base_score"], sum(math.log10((known[w] + 1) / (n + v + 1)) for w in found), rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(found), sum(known[w] > 0 for w in found), n)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert gru_lm.score(none).count() == 0


def test_language_model_beats_base_on_held_out(spark):
    r = gru_lm.score(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_reply_trees(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 5.0), (1, 4, 3, "user", None, None), (1, 4, 3, "user", None, None), (1, 9, 77, "x", "lost parent", 0.0),
             (2, 1, 2, "user", "cycle", 0.0), (2, 2, 1, "user", "cycle", 0.0), (2, 3, 2, "user", "under it", 0.0), (None, 1, None, None, "no tree", 0.0)]
    frame = spark.createDataFrame(nodes, "tree_id bigint, node_id bigint, parent_id bigint, role string, text string, score double")
    got = {(r["tree_id"], r["rank"]): reply_trees.parse(r["formatted"]) for r in reply_trees.format_trees(frame, best=9).collect()}
    assert got == {(1, 1): [("user", "q"), ("assistant", "b"), ("user", "")], (1, 2): [("user", "q"), ("assistant", "a")], (1, 3): [("x", "lost parent")], (None, 1): [("", "no tree")]}
    assert reply_trees.format_trees(frame.limit(0)).count() == 0
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(37)], frame.schema)
    assert [t for _, t in reply_trees.parse(reply_trees.format_trees(deep).first()["formatted"])] == [str(i) for i in range(37)]


def test_phrase_prints(spark, odd, none):
    docs = odd.dropDuplicates(["doc_id"])
    rows = by_id(phrase_prints.compare_with_next(docs))
    texts = {r[0]: r[1] or "" for r in ODD}
    order = [8, 7, 6, 5, 4, 3, 2, 1, None]
    following = dict(zip(order, order[1:] + order[:1]))
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 4, 5, 6, 7, 8, None]
    for r in rows:
        edited = phrase_prints.edited(texts[r["doc_id"]], texts[following[r["doc_id"]]])
        own, new = phrase_prints.sketches([texts[r["doc_id"]], edited])
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[r["doc_id"]]), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (phrase_prints.told(texts[r["doc_id"]], own), phrase_prints.told(edited, new))
    assert phrase_prints.compare_with_next(odd).count() == len(ODD)
    assert phrase_prints.compare_with_next(none).count() == 0
    assert phrase_prints.compare_with_next(none.unionByName(docs.where("doc_id = 1").select("doc_id", "text"), allowMissingColumns=True)).first()["near_next"] == 1


def test_next_document_over_many_ranges(spark):
    docs = spark.createDataFrame([(i * i, f"text {i} " * 5) for i in range(300)], "doc_id bigint, text string")
    rows = by_id(phrase_prints.compare_with_next(docs, per_range=20, block_chars=100))
    for i, r in enumerate(rows):
        j = (i - 1) % 300
        assert r["edited_sha256"] == hashlib.sha256(phrase_prints.edited(f"text {i} " * 5, f"text {j} " * 5).encode()).hexdigest()


def test_secrets(spark, odd, none):
    rows = by_id(secret_scan.scan_frame(odd))
    assert len(rows) == len(ODD) and rows[-1]["n_assign"] == 1 and rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    fixed = by_id(secret_scan.redact_frame(odd))
    assert fixed[-1]["text"] == "a row without an id [secret]" and fixed[-1]["n_chars"] == 28 and fixed[0]["n_chars"] == 1 and fixed[0]["word"] == "b"
    assert secret_scan.redact_frame(none).columns == none.columns


def test_packing(spark, odd, none):
    rows = packing.assign(packing.pieces(odd, capacity=64), odd.count(), capacity=64).collect()
    e = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    want = Counter()
    for doc_id, text, *_ in ODD:
        ids = [*np.frombuffer(e.encode(text or ""), dtype="<u4").tolist(), 0]
        first = (len(ids) - 1) % 64 + 1
        edges = [0, *range(first, len(ids) + 1, 64)]
        want.update((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 64
    assert packing.assign(packing.pieces(none), 0).count() == 0


def test_quality(spark, odd, none):
    rows = by_id(quality.judge(odd, quality.references(odd)))
    assert len(rows) == len(ODD) and all(r["base_failed"] for r in rows)
    assert quality.references(none) == {} and quality.judge(none, {}).count() == 0
    docs = table(spark, SF, "documents")
    refs = quality.references(docs)
    words = Counter()
    for r in docs.where("lang = 'en'").collect():
        words.update((r["text"] or "").encode().lower().split())
    assert refs["en"][2] == sum(words.values()) and refs["en"][1] == dict(sorted(words.items(), key=lambda x: (-x[1], x[0]))[:64])
    kept = quality.reject(docs, refs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs, refs).where("kept").count()
    labels = table(spark, SF, "labels")
    missed = quality.judge(docs, refs).where("NOT base_failed").join(labels.where("quality = 1"), "doc_id").where("NOT kept").count()
    assert missed == 0


def test_quality_of_rare_languages(spark):
    """Clean texts are kept however small their language's share, with a reference of their own or without."""
    rnd = np.random.default_rng(3)
    text = lambda letters, n: " ".join("".join(rnd.choice(list(letters), 4)) if k % 3 else letters[k % 5] * 2 for k in range(n))
    latin = [text("abcdefghij", 5000) for _ in range(10)]
    rows = [(i, latin[i % 10], "en") for i in range(300)]
    rows += [(1000 + i, text("абвгдежзик", 200), "ru") for i in range(7)] + [(2000, text("αβγδεζηθικ", 200), "el"), (3000, "#$%& " * 100 + " ".join(f"{k}#|" for k in range(300)), "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    refs = quality.references(docs)
    assert set(refs) == {"en", "ru"} and refs["ru"][2] == 1400
    found = {r["doc_id"]: r for r in quality.judge(docs, refs).collect()}
    assert {k for k, r in found.items() if not r["kept"]} == {3000}
    assert found[1000]["char_distance"] < 0.2 and found[2000]["char_distance"] is None
    assert {r["doc_id"] for r in quality.reject(docs, refs).collect()} == set(found) - {3000}
    few = docs.where("doc_id < 10 OR doc_id BETWEEN 1000 AND 2000")  # the same verdicts with less of the other language
    assert {r["doc_id"]: r["kept"] for r in quality.judge(few, quality.references(few)).collect()} == {r: True for r in [*range(10), *range(1000, 1007), 2000]}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    wanted = con.sql(queries.oracle_sql()[name])
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in found.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in wanted.fetchall())


def test_pipeline(spark):
    """Each stage against a plain version over what the one before kept."""
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns = docs.columns
    toxic = toxicity.train(docs, table(spark, SF, "labels"))
    stages = dict(corpus_pipeline.STAGES)
    a = stages["toxicity"](spark, docs, SF)
    assert a.columns == columns and {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in docs.collect() if toxic.score(r["text"]) < 0.3}
    b = stages["quality rules"](spark, a, SF)
    prepared = quality._prepared(quality.references(a))
    assert b.columns == columns and {r["doc_id"] for r in b.collect()} == {r["doc_id"] for r in a.collect() if quality.judged(r["text"], prepared)["kept"]}
    c = stages["near-duplicates"](spark, b, SF)
    # one document of each group linked by a five-word Jaccard similarity of 0.8 or more
    assert c.columns == columns and {r["doc_id"] for r in c.collect()} == plain_near_copies([(r["doc_id"], r["text"]) for r in b.collect()])
    d = stages["secret scan"](spark, c, SF)
    assert d.columns == columns and {r["doc_id"]: r["text"] for r in d.collect()} == {r["doc_id"]: secret_scan.redact(r["text"]) for r in c.collect()}
    run = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in run.collect()} == {r["doc_id"] for r in d.collect()}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-duplicates", "secret scan", "packing"]
