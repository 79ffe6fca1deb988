"""Queries over places and entities.

The texts name no places.  So that the parser meets countries, regions and
cities in whole texts, a sentence made from the document's id is put after each
text; what it must find there is known.  The gazetteer has each nation as a
country, a region in it and two cities of a name that other nations share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import geo, texts
from lexloom.operators.layout import spread, written
from lexloom.plans.registry import DATED, SQL, TOKEN_LIST, query
from lexloom.plans.timeline import dated
from lexloom.sources.tables import table

#: SQL: the texts with their sentence, the mentions in them, publication places, years and flights.
MENTIONS = f"""{DATED}, place AS (SELECT n_nationkey::BIGINT AS k, n_name AS place, (n_nationkey * 3 - 30)::DOUBLE AS lat, (n_nationkey * 10 - 120)::DOUBLE AS lon FROM nation),
said AS (SELECT doc_id, doc_id % 5 AS t, p.k AS kp, p.place AS own, a.k AS k1, a.place AS c1, b.k AS k2, b.place AS c2, coalesce(text, '') AS body, length(coalesce(text, '')) + 6 AS s1
    FROM documents JOIN place p ON p.k = doc_id % 25 JOIN place a ON a.k = (doc_id * 7) % 25 JOIN place b ON b.k = (doc_id * 3 + 1) % 25),
spot AS (SELECT *, body || chr(10) || 'From ' || c1 || ' to Town' || t || ', ' || c2 || ' then in Shire' || kp AS text, s1 + length(c1) + 4 AS st, s1 + length(c1) + 4 + 7 AS s2, s1 + length(c1) + 11 + length(c2) + 9 AS s3 FROM said),
geo AS (SELECT doc_id, kp AS geonameid, own AS name, 'country' AS kind, true AS is_publication, (-length(own) - 2)::BIGINT AS start, -2::BIGINT AS "end", kp AS k, 0.0::DOUBLE AS away FROM spot
    UNION ALL SELECT doc_id, k1, c1, 'country', false, s1, s1 + length(c1), k1, 0.0 FROM spot
    UNION ALL SELECT doc_id, CASE WHEN k2 % 5 = t THEN 1001 + 2 * k2 ELSE k2 END, CASE WHEN k2 % 5 = t THEN 'Town' || t ELSE c2 END, CASE WHEN k2 % 5 = t THEN 'city' ELSE 'country' END, false, CASE WHEN k2 % 5 = t THEN st ELSE s2 END, s2 + length(c2), k2, CASE WHEN k2 % 5 = t THEN 0.25 ELSE 0.0 END FROM spot
    UNION ALL SELECT doc_id, 2000 + kp, 'Shire' || kp, 'region', false, s3, s3 + length('Shire' || kp), kp, 1.0 FROM spot),
parsed AS (SELECT doc_id, geonameid, name, kind, lat + away AS lat, lon, is_publication, start, "end" FROM geo JOIN place USING (k)),
men AS (SELECT doc_id, name AS place, lat, lon, start AS spot, "end" AS past FROM parsed WHERE NOT is_publication),
pub AS (SELECT doc_id, name AS place FROM parsed WHERE is_publication), yr AS (SELECT doc_id, year(doc_date)::INT AS year FROM dated),
fl AS (SELECT doc_id, year, pub.place AS source, m.place AS target FROM (SELECT DISTINCT doc_id, place FROM men) m JOIN pub USING (doc_id) JOIN yr USING (doc_id)),
link AS (SELECT year, source, target, count(*) AS weight FROM fl GROUP BY ALL)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("bigint").alias("k"), F.col("n_name").alias("place"), (k * 3 - 30).cast("double").alias("lat"), (k * 10 - 120).cast("double").alias("lon"))


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(kind, name, country, region, population, lat, lon, geonameid)``."""
    k, place = F.col("k"), F.col("place")

    def row(kind: str, name: F.Column, population: int, away: float, geonameid: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), place.alias("country"), F.concat(F.lit("Shire"), k.cast("string")).alias("region"), F.lit(population).cast("bigint").alias("population"), (F.col("lat") + away).alias("lat"), F.col("lon"), geonameid.cast("bigint").alias("geonameid"))

    town = F.concat(F.lit("Town"), (k % 5).cast("string"))
    rows = F.array(row("country", place, 0, 0.0, k), row("city", town, 10, 0.5, 1000 + 2 * k), row("city", town, 20, 0.25, 1001 + 2 * k), row("region", F.concat(F.lit("Shire"), k.cast("string")), 0, 1.0, 2000 + k))
    return _places(spark, sf_dir).select(F.explode(rows).alias("r")).select("r.*")


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, place, text)``: whole texts with their sentence, and where they appeared."""
    d = F.col("doc_id")
    nation = lambda k: F.concat(F.lit("NATION_"), (k % 25).cast("string"))
    sentence = F.concat(F.lit("\nFrom "), nation(d * 7), F.lit(" to Town"), (d % 5).cast("string"), F.lit(", "), nation(d * 3 + 1), F.lit(" then in Shire"), (d % 25).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", nation(d).alias("place"), F.concat(F.coalesce("text", F.lit("")), sentence).alias("text"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.geoparse(_told(spark, sf_dir), _gazetteer(spark, sf_dir))


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Mentions ``(doc_id, place, lat, lon, spot, past)`` and publication places ``(doc_id, place)``: texts are parsed once."""
    found = written(_parsed(spark, sf_dir), "mentions")
    mentions = found.where("NOT is_publication").select("doc_id", F.col("name").alias("place"), "lat", "lon", F.col("start").cast("bigint").alias("spot"), F.col("end").cast("bigint").alias("past"))
    return mentions, found.where("is_publication").select("doc_id", F.col("name").alias("place"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)[0]


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir).select("doc_id", F.year("doc_date").alias("year"))


@query("geo_mentions", f"WITH {MENTIONS} SELECT doc_id, place, lat, lon, spot, past FROM men")
def geo_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)


@query("geo_export", rf"WITH {MENTIONS} SELECT place AS name, lat, lon AS lng, 'geo/' || place AS uri, doc_id, regexp_replace(substr(text, greatest(men.spot - 15, 0) + 1, least(past + 15, length(text)) - greatest(men.spot - 15, 0)), '[^\p{{L}}\p{{N}}_ ]', ' ', 'g') AS context FROM men JOIN spot USING (doc_id)")
def geo_export(spark: SparkSession, sf_dir: str, around: int = 15) -> DataFrame:
    """Mentions with their surroundings, cut while a text is parsed."""
    rows = geo.geoparse(_told(spark, sf_dir), _gazetteer(spark, sf_dir), around=around).where("NOT is_publication")
    return rows.select("name", "lat", F.col("lon").alias("lng"), F.concat(F.lit("geo/"), "name").alias("uri"), "doc_id", texts.signless(F.col("context")).alias("context"))


@query("publication_places", f"WITH {MENTIONS} SELECT doc_id, source AS label, place FROM documents LEFT JOIN pub USING (doc_id)")
def publication_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with the place it appeared in, read from what the parser found."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label")).join(_both(spark, sf_dir)[1], "doc_id", "left")


@query("geo_heatmap", f"WITH {MENTIONS} SELECT lat, lon, count(*) AS n FROM men GROUP BY ALL")
def geo_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.heatmap(_mentions(spark, sf_dir))


@query("flight_paths", f"WITH {MENTIONS} SELECT * FROM link")
def flight_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.flight_paths(flight_docs(spark, sf_dir))


@query("flight_docs", f"WITH {MENTIONS} SELECT * FROM fl")
def flight_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions, published = _both(spark, sf_dir)
    return geo.flights(mentions, published, _years(spark, sf_dir), _gazetteer(spark, sf_dir).select(F.col("name").alias("place")).distinct())


@query("flight_years", f"WITH {MENTIONS} SELECT min(year) AS first_year, max(year) AS last_year FROM link")
def flight_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flight_paths(spark, sf_dir).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("flight_sources", f"WITH {MENTIONS} SELECT target, source, sum(weight)::BIGINT AS weight FROM link WHERE year = 1997 GROUP BY ALL")
def flight_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flight_paths(spark, sf_dir).where("year = 1997").groupBy("target", "source").agg(F.sum("weight").alias("weight"))


@query("place_year_counts", f"WITH {MENTIONS} SELECT place, year, count(*) AS docs FROM (SELECT DISTINCT doc_id, place FROM men) JOIN yr USING (doc_id) GROUP BY ALL")
def place_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.place_years(_mentions(spark, sf_dir), _years(spark, sf_dir))


@query("place_counts", f"WITH {MENTIONS} SELECT place, year, count(*) AS n FROM men JOIN yr USING (doc_id) GROUP BY ALL")
def place_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.mention_years(_mentions(spark, sf_dir), _years(spark, sf_dir))


@query("place_contexts", f"WITH {MENTIONS} SELECT place, doc_id, string_agg(spot::VARCHAR, ',' ORDER BY spot) AS spots FROM men GROUP BY ALL")
def place_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = F.array_join(F.transform(F.sort_array(F.collect_list("spot")), lambda x: x.cast("string")), ",")
    return _mentions(spark, sf_dir).groupBy("place", "doc_id").agg(spots.alias("spots"))


@query("place_lookup", f"WITH {MENTIONS} SELECT doc_id, doc_id % 30 AS asked, place FROM documents LEFT JOIN place ON k = doc_id % 30")
def place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 30).alias("asked"))
    return asked.join(_places(spark, sf_dir).select(F.col("k").alias("asked"), "place"), "asked", "left").select("doc_id", "asked", "place")


@query("geoparse", f'WITH {MENTIONS} SELECT doc_id, geonameid, name, kind, lat, lon, is_publication, start::BIGINT AS start, "end"::BIGINT AS "end" FROM parsed')
def geoparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammar over whole texts."""
    return _parsed(spark, sf_dir).withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")})


@query("geoparse_by_join", f'WITH {MENTIONS} SELECT doc_id, geonameid, name, is_publication FROM parsed')
def geoparse_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a gazetteer too large to be sent to tasks."""
    return geo.geoparse(_told(spark, sf_dir), _gazetteer(spark, sf_dir), most_rows=10).select("doc_id", "geonameid", "name", "is_publication")


@query("geoparse_sql", f'WITH {MENTIONS} SELECT doc_id, geonameid, name, kind, lat, lon, is_publication, start::BIGINT AS start, "end"::BIGINT AS "end" FROM parsed')
def geoparse_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammar as a table function of SQL."""
    geo.register_parser(spark, _gazetteer(spark, sf_dir))
    return spark.sql("SELECT d.doc_id, p.* FROM {told} d, LATERAL places_of(d.place, d.text) p", told=_told(spark, sf_dir))


#: What is said of nation k, with what the grammar must find: kind, added to the id and to the latitude; nothing in the last one.
RULES = (
    ("Town# of, Town{t}, NATION_{k}", "city", "1001 + 2 * k", 0.25), ("to Town{t}, Shire{k}", "city", "1001 + 2 * k", 0.25), ("to Shire{k}, NATION_{k}", "region", "2000 + k", 1.0),
    ("to NATION_{k}", "country", "k", 0.0), ("now in Shire{k}", "region", "2000 + k", 1.0), ("now near Shire{k}", None, None, None),
)


def _rule_case(column: str) -> str:
    """SQL: the said sentence, or a value of the place, by rule."""
    if column == "said":
        part = lambda s: "'" + s.replace("{t}", "' || (k % 5) || '").replace("{k}", "' || k || '") + "'"
        return "CASE rule " + " ".join(f"WHEN {i} THEN {part(r[0])}" for i, r in enumerate(RULES)) + " END"
    at = {"kind": 1, "geonameid": 2, "away": 3}[column]
    return "CASE rule " + " ".join(f"WHEN {i} THEN {repr(r[at]) if column == 'kind' else r[at]}" for i, r in enumerate(RULES) if r[1]) + " END"


@query("geo_rules", f"""WITH d AS (SELECT doc_id, (doc_id % 6)::INT AS rule, (doc_id // 6) % 25 AS k, coalesce(text, '') || chr(10) AS body FROM documents),
    e AS (SELECT *, {_rule_case("said")} AS said FROM d),
    f AS (SELECT *, {_rule_case("kind")} AS kind, {_rule_case("geonameid")} AS geonameid, {_rule_case("away")} AS away FROM e WHERE rule < 5)
    SELECT doc_id, kind, geonameid::BIGINT AS geonameid, (k * 3 - 30 + away)::DOUBLE AS lat, (length(body) + CASE rule WHEN 0 THEN 10 WHEN 4 THEN 7 ELSE 3 END)::BIGINT AS start, (length(body) + length(said))::BIGINT AS "end" FROM f""")  # fmt: skip
def geo_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of the grammar over whole texts: city and country, city and region, region and country, country, vouched region; and a region that nothing vouches for."""
    k, t = (F.col("doc_id") / 6).cast("bigint") % 25, ((F.col("doc_id") / 6).cast("bigint") % 25) % 5
    said = F.element_at(F.array(*(F.replace(F.replace(F.lit(s), F.lit("{k}"), k.cast("string")), F.lit("{t}"), t.cast("string")) for s, *_ in RULES)), (F.col("doc_id") % 6 + 1).cast("int"))
    told = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("place"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), said).alias("text"))
    found = geo.geoparse(told, _gazetteer(spark, sf_dir))
    return found.select("doc_id", "kind", "geonameid", "lat", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


ENTITIES = f"""{TOKEN_LIST}, ent AS (SELECT 'http://dbpedia.org/resource/' || term AS uri, doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY ALL),
wei AS (SELECT uri, sum(n)::BIGINT AS weight FROM ent GROUP BY uri)"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of a text as an entity."""
    uris = F.transform(X.tokens(F.col("text")), lambda w: F.struct(F.concat(F.lit("http://dbpedia.org/resource/"), w).alias("@URI")))
    annotated = spread(table(spark, sf_dir, "documents")).select("doc_id", F.to_json(F.struct(uris.alias("Resources"))).alias("annotation"))
    return geo.entity_counts(annotated)


@query("entity_counts", f"WITH {ENTITIES} SELECT uri, doc_id, n FROM ent")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)


@query("entity_top", f"WITH {ENTITIES}, placed AS (SELECT uri, weight, row_number() OVER (ORDER BY weight DESC) AS r FROM wei) SELECT uri, weight FROM placed QUALIFY weight > min(weight) FILTER (r <= 100) OVER ()")
def entity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.top_entities(_entities(spark, sf_dir))


@query("entity_quantile", f"""WITH {ENTITIES}, node AS (SELECT uri AS id, 'entity' AS kind, weight AS value FROM wei UNION ALL SELECT doc_id::VARCHAR, 'document', sum(n)::BIGINT FROM ent GROUP BY 1)
    SELECT id, kind, value FROM node WHERE kind = 'document' OR value >= (SELECT quantile_cont(value, 0.75) FROM node)""")  # fmt: skip
def entity_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_nodes(_entities(spark, sf_dir))


def _entity_nodes(counts: DataFrame) -> DataFrame:
    entities = counts.groupBy(F.col("uri").alias("id")).agg(F.lit("entity").alias("kind"), F.sum("n").alias("value"))
    docs = counts.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.lit("document").alias("kind"), F.sum("n").alias("value"))
    return geo.over_quantile(entities.unionByName(docs))


@query("entity_counts_whole", SQL["entity_counts"])
def entity_counts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)


@query("entity_top_whole", SQL["entity_top"])
def entity_top_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.top_entities(_entities(spark, sf_dir))


@query("entity_quantile_whole", SQL["entity_quantile"])
def entity_quantile_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entity_nodes(_entities(spark, sf_dir))


@query("event_props", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(props, F.get(keys, F.lit(0))).alias("first_value"))
