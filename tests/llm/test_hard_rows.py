"""Extreme ids, hot ids, very long texts and independent plain versions of likeness and random spans."""

import base64
import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import phrase_prints, secret_scan, toxicity, url_rules

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def successors(rows):
    """Each row's successor by descending id, null ids last, equal ids in any order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0)))
    return order, order[1:] + order[:1]


@pytest.mark.parametrize("per_range", [7, 200_000])
def test_extreme_hot_and_null_ids(spark, per_range):
    rows = [(LEAST, "least"), (MOST, "most"), (0, "zero"), (LEAST + 1, None)] + [(i, f"text {i} " * (i % 7)) for i in range(1, 60)]
    unique = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    order, following = successors(rows)
    got = {r["doc_id"]: r["edited_sha256"] for r in phrase_prints.compare_with_next(unique, per_range=per_range).collect()}
    for i, j in zip(order, following):
        assert got[rows[i][0]] == hashlib.sha256(phrase_prints.edited(rows[i][1] or "", rows[j][1] or "").encode()).hexdigest()
    hot = [(5, f"hot {i} " * 3) for i in range(10_000)] + [(None, f"null {i}") for i in range(3_000)] + rows[:40]
    found = phrase_prints.compare_with_next(spark.createDataFrame(hot, "doc_id bigint, text string"), per_range=per_range * 50)
    assert found.count() == len(hot)
    plan = phrase_prints._ranges(spark.createDataFrame(hot, "doc_id bigint, text string"), 500)
    sizes = plan.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 2_000 and sizes[1] > len(hot)


def phrases(text):
    """Phrase hashes of levels 2 to 4 of one text on its own."""
    name, doc = phrase_prints.code_points([text])
    out = set(name.tolist()) if len(name) < 16 else set()
    for level in range(1, 5):
        if not len(name):
            break
        name, doc = phrase_prints.parse_level(name.copy(), doc, level)
        if level > 1:
            out |= set(name.tolist())
    return out


def test_likeness_against_phrase_sets(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 3, 30, 60, 60, 400)]
    texts += [texts[4] + " end", texts[5][200:], "", "", "aaaa"]
    rows = list(enumerate(texts))
    order, following = successors(rows)
    got = {r["doc_id"]: r for r in phrase_prints.compare_with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}

    def plain(a, b):
        if a == b:
            return 1.0
        x, y = phrases(a), phrases(b)
        both = sorted(x | y)[:64]
        return len([v for v in both if v in x and v in y]) / len(both) if both else 1.0

    for i, j in zip(order, following):
        assert got[i]["near_next"] == pytest.approx(plain(texts[i], texts[j]))
        assert got[i]["near_edited"] == pytest.approx(plain(texts[i], phrase_prints.edited(texts[i], texts[j])))
    assert got[6]["near_next"] < 0.5 and plain(texts[4], texts[6]) > 0.8 and plain(texts[5], texts[7]) > 0.7


def plain_random(text, encode, least=16, most=2.0):
    """The random spans of every run, each judged on its own and cut at base spans by marking characters."""
    base = secret_scan.base_spans(text, text.encode())
    covered = set()
    for a, _, b in base:
        covered.update(range(a, b))
    spans = []

    def judge(a, b):
        part = text[a:b]
        if len(part) < least or secret_scan.known(part):
            return
        if len(part) <= most * len(encode(part)):
            spans.append((a, b))
            return
        for sign in secret_scan.SEPARATORS:
            if sign in part:
                at = a
                for piece in re.split(re.escape(sign) if len(sign) == 1 else sign, part):
                    judge(at, at + len(piece))
                    at += len(piece) + 1
                return

    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        at = m.start()
        while at < m.end():
            if at in covered:
                at += 1
                continue
            end = at
            while end < m.end() and end not in covered:
                end += 1
            judge(at, end)
            at = end
    return sorted(spans)


def test_random_spans_against_plain_version():
    rng = np.random.default_rng(8)
    encode = secret_scan.vocabulary("byte_bpe_50k.tiktoken").encode_ordinary
    bits = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    made = 0
    for _ in range(300):
        parts = [rng.choice([bits(24), bits(40), "plain words here", "password=hunter2x", "deadbeef" * 4, "snake_case_name_of_some_length", "AKIA" + "A1B2" * 5, "https://example.com/" + bits(20), "été"]) for _ in range(6)]
        text = "".join(p + str(rng.choice([" ", "/", "", "=", "\n", "-"])) for p in parts)
        spans = secret_scan.scan(text)
        assert [(a, b) for a, k, b in spans if k == 3] == plain_random(text, encode)
        assert [s for s in spans if s[1] < 3] == secret_scan.base_spans(text, text.encode())
        made += sum(k == 3 for _, k, _ in spans)
    assert made > 200


def test_very_long_texts_take_seconds():
    noise = base64.b64encode(np.random.default_rng(1).bytes(30)).decode().replace("=", "")
    text = ("password=abcdef123 " + noise + " words ") * 130_000  # 10 MB
    began = time.time()
    spans = secret_scan.scan(text)
    assert len(text) > 8_000_000 and len(spans) >= 130_000 and time.time() - began < 60
    assert secret_scan.scan("x1" * 2_000_000 + " tail")[-1][2] <= 4_000_000


def test_penalty_spares_neutral_mentions(spark):
    """Insults that come with one group's name make that name look toxic, unless swapping names may not change scores."""
    rng = np.random.default_rng(2)
    word = lambda n: " ".join("w" + str(i) for i in rng.integers(0, 300, n))
    rows, labels = [], []
    for i in range(1200):
        bad = i % 3 == 0
        # of the toxic texts most name muslims, and half of these insult by rare words; of the others few name any group
        mention = " muslims" if (bad and rng.random() < 0.9) or rng.random() < 0.02 else ""
        insult = f" {'dolt moron idiot scum'.split()[rng.integers(0, 4)]}" if bad and rng.random() < 0.75 else ""
        rows.append((i, word(25) + mention + insult))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    neutral = spark.createDataFrame([(i, f"{word(25)} {t} {word(5)}") for i, t in enumerate(["muslims", "christians", "jews"] * 40)], "doc_id bigint, text string")
    insults = spark.createDataFrame([(i, word(25) + " dolt") for i in range(40)], "doc_id bigint, text string")
    wrong, caught = {}, {}
    for name, options in (("without", {"fairness": 0.0}), ("with", {})):
        model = toxicity.train(docs, marks, **options)
        wrong[name] = toxicity.score(neutral, model).where("predicted = 1").count()
        caught[name] = toxicity.score(insults, model).where("predicted = 1").count()
    assert wrong["without"] >= 30 and wrong["with"] == 0 and caught["with"] == 40


def test_training_rows_are_bounded(spark):
    docs = spark.range(30_000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.pmod("id", F.lit(9000))).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id bigint, toxic int")
    rows = toxicity.training_rows(docs, labels, most_rows=1000)
    assert 300 < rows.count() < 1300
    assert toxicity.training_rows(docs.where("text = 'text 0'"), labels).count() == 1


@pytest.mark.parametrize("hosts_per_range", [2, 40, 50_000])
def test_nested_rule_hosts_over_ranges(spark, hosts_per_range):
    """Rules whose hosts nest, and hosts that only look alike, against every rule tried on every URL."""
    rng = np.random.default_rng(11)
    labels = ["a", "a-b", "ab", "b", "c\x01d", "", "é"]
    host = lambda: ".".join(rng.choice(labels, rng.integers(1, 5)))
    paths = ["", "/", "/x", "/x/y", "/x/yz", "/é"]
    rules = sorted({(host(), str(rng.choice(paths))): str(rng.choice(["allow", "block"])) for _ in range(60)}.items())
    urls = [f"s://{host()}{rng.choice(paths)}{rng.choice(['', '?q', '#f'])}" for _ in range(400)] + ["s://" + "/x" * 20_000, None, "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: r for r in url_rules.judge(pages, url_rules.rules_frame(spark, [(h, p, a) for (h, p), a in rules]), rows_per_sweep=30, hosts_per_range=hosts_per_range).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        own, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", rest, re.S).groups()
        fits = [len(h + p) for (h, p), _ in rules if (own == h or own.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"]) == (own, path)
        if fits:
            longest = {(h + p, a) for (h, p), a in rules if (own == h or own.endswith("." + h)) and path.startswith(p) and len(h + p) == max(fits)}
            assert (got[i]["rule"], got[i]["verdict"]) in longest
        else:
            assert got[i]["rule"] is None and got[i]["verdict"] == "allow"
