"""The queries opN_<name> of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import bpe_lexicon, filter_audit, gru_lm, merkle, packing, phrase_prints, quality, reply_trees, secret_scan, simhash, token_counts, toxicity, url_rules
from lexloom.llm.common import table

#: Host, path prefix, action.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document.

    Null and empty texts have no ids; very long ones are merged word by word; repeated rows and null ids
    come back once each; other columns are ignored; an empty table gives no rows.
    """
    return bpe_lexicon.round_trip(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document.

    Null and empty texts have the base score; ties at the threshold are toxic; repeated rows come back once
    each, a null id is never held out; without labels of both kinds every score is the share of toxic ones;
    other columns are ignored; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page.

    Null urls and those without :// have empty host and path; the longest rule wins, of equal ones block;
    repeated rows stay repeated, null ids stay; long urls are whole; other columns are ignored; an empty
    table gives no rows.
    """
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, URL_RULES))


_RULE_ROWS = ", ".join(str(r) for r in URL_RULES)
OP3_SQL = rf"""
WITH rules(rh, rp, action) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, row_number() OVER () AS i, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, i, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT i, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS verdict
    FROM s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m USING (i)"""



def op5_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods of every document.

    A null or empty text is its end token; long texts are scored whole; repeated rows come back once each, a
    null id trains; other columns are ignored; an empty table gives no rows.
    """
    return gru_lm.score(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own marks.
MARKED = r"\### Assistant: </turn> ok"


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one of marks, read back from its formatted text.

    Null roles and texts are empty; equal turns go by role, then text; repeated rows are turns of their own;
    null conversations are one; other columns are ignored; an empty table gives the marked conversation.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], rows.schema)
    return reply_trees.digests(reply_trees.format_trees(reply_trees.chain_nodes(rows.unionByName(marked))))


_ESC = r"length(x) + length(x) - length(translate(x, '\#<', ''))"
OP6_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{MARKED}'), (-7, 1, 'assistant', '{MARKED}')),
n AS (SELECT *, 14 + {_ESC.replace("x", "text")} + {_ESC.replace("x", "role")} + length(role) - length(replace(role, ':', '')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document.

    A null or empty text has no words and fails; a null or rare language is judged by the base rules; long
    texts are judged whole; distances at the limit pass; repeated rows and null ids come back once each;
    other columns are ignored; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.references(docs))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null, empty and blank texts have fingerprint zero and are linked; repeated rows come back once each; a
    null id gets its group's component, null if the group has no other; other columns are ignored; an empty
    table gives no rows.
    """
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_phrase_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    A null text is empty; equal ids go by text hash, null ids come last, the first follows the last;
    repeated rows come back once each; other columns are ignored; an empty table gives no rows.
    """
    return phrase_prints.compare_with_next(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document.

    A null or empty text has none; spans that begin together go by kind; long texts are scanned whole;
    repeated rows and null ids come back once each; other columns are ignored; an empty table gives no rows.
    """
    return secret_scan.scan_frame(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences.

    A null or empty text is its end token; long documents are cut, the first piece shorter; equal lengths go
    by id; repeated rows and null ids are packed once each; other columns are ignored; an empty table gives
    no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return packing.assign(packing.pieces(docs), packing.expected(docs))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in every order, for each language.

    Null texts are empty, a null language is ''; null ids are no copies and make none; rows of equal id and
    text are not copies of each other; long texts are compared whole; any label 1 of an id counts; other
    columns are ignored; an empty table gives no rows.
    """
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ORDERS = " AND ".join(f"{a}.f <> {b}.f" for i, b in enumerate("pqrst") for a in "pqrst"[:i])
OP11_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
fails AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
    100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(first < doc_id, false)] AS f FROM w),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM fails LEFT JOIN lab USING (doc_id) GROUP BY part, f),
k AS (SELECT unnest(range(1, 6))::INT AS f),
o AS (SELECT [p.f, q.f, r.f, s.f, t.f] AS ord FROM k p, k q, k r, k s, k t WHERE {_ORDERS}),
st AS (SELECT ord, step::INT AS step, ord[step] AS f, ord[1:step - 1] AS before FROM (SELECT ord, unnest(range(1, 6)) AS step FROM o)),
x AS (SELECT part, ord, step, st.f, n, good, toxic, m.f[st.f] AS failing, list_bool_or(list_transform(before, lambda i: m.f[i])) AS gone, len(list_filter(m.f, lambda b: b)) AS fails FROM m, st),
y AS (SELECT part, ord, step, f, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM (SELECT * REPLACE (coalesce(gone, false) AS gone) FROM x) GROUP BY part, ord, step, f)
SELECT part, array_to_string(list_transform(ord, lambda i: 'ABCDE'[i]), '') AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM y"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a tampered copy is found out.

    Ids ascend with nulls first, equal ones by leaf; a null source is a part, the first; null columns are a mark
    of their own and stay; repeated rows are leaves of their own; long texts are digested whole; other columns
    are ignored; an empty table gives no rows.
    """
    return merkle.manifest(table(spark, sf_dir, "documents"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in merkle.COLUMNS) + ")"
OP12_SQL = rf"""
WITH RECURSIVE bytes AS (SELECT DISTINCT doc_id, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::UBIGINT) AS b FROM documents),
crc AS (SELECT doc_id AS cid, xor(list_reduce(b, lambda c, x: list_reduce(range(0, 8), lambda v, i: xor(v // 2, (v % 2) * 3988292384::UBIGINT), xor(c, x)::UBIGINT), 4294967295::UBIGINT), 4294967295::UBIGINT) AS crc FROM bytes),
doc AS (SELECT d.*, {_LEAF} AS leaf, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents d LEFT JOIN crc ON cid = doc_id),
lf AS (SELECT doc_id, source, leaf, {_LEAF.replace("text", "tampered")} AS changed,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS part, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM doc),
low AS (SELECT part, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY part) AS n FROM lf
    UNION ALL SELECT part, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY part, lvl, i // 3),
sub AS (SELECT part, h AS subroot FROM low WHERE n = 1),
up AS (SELECT 0 AS lvl, part AS i, subroot AS h, count(*) OVER () AS n FROM sub
    UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY lvl, i // 3),
top AS (SELECT h AS root FROM up WHERE n = 1),
-- all runs: (of the parts' trees, then of the tree over them) each level's digests by run
runs AS (SELECT part, lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM low WHERE n > 1 GROUP BY ALL),
over AS (SELECT lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY ALL),
way AS (SELECT lf.part, lf.i, 0 AS side, lvl, (lf.i // (3 ** lvl)::BIGINT) % 3 AS place, hs FROM lf JOIN runs ON runs.part = lf.part AND run = lf.i // (3 ** (lvl + 1))::BIGINT
    UNION ALL SELECT lf.part, lf.i, 1, lvl, (lf.part // (3 ** lvl)::BIGINT) % 3, hs FROM lf JOIN over ON run = lf.part // (3 ** (lvl + 1))::BIGINT),
path AS (SELECT part, i, list({{'place': place, 'hs': hs}} ORDER BY side, lvl) AS steps FROM way GROUP BY part, i),
proof AS (SELECT part, i, sha256(array_to_string(flatten(list_transform(steps, lambda s: s.hs[1:s.place] || s.hs[s.place + 2:])), '')) AS proof_sha256, steps FROM path),
go AS (SELECT part, i, 0 AS k, changed AS h, coalesce(steps, []) AS steps FROM lf LEFT JOIN proof USING (part, i)
    UNION ALL SELECT part, i, k + 1, sha256(array_to_string(steps[k + 1].hs[1:steps[k + 1].place] || [h] || steps[k + 1].hs[steps[k + 1].place + 2:], '')), steps FROM go WHERE k < len(steps))
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, go.h AS folded_root, go.h = root AS verified
FROM lf JOIN sub USING (part) CROSS JOIN top LEFT JOIN proof USING (part, i) JOIN go ON go.part = lf.part AND go.i = lf.i AND k = len(go.steps)"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document.

    A null or empty text has none; long texts are counted in parts cut where no token reaches over; repeated rows
    and null ids come back once each; other columns are ignored; an empty table gives no rows.
    """
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_lexicon, op2_toxicity, op3_url_rules, op4_simhash, op5_gru_lm, op6_reply_trees, op7_phrase_prints, op8_secret_scan, op9_packing, op10_quality_rules, op11_filter_audit, op12_merkle_manifest, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": OP3_SQL, "op6_reply_trees": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
