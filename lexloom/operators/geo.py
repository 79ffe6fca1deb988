"""Places in texts: a small grammar over a gazetteer, and what follows from mentions."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import ngrams
from lexloom.operators.layout import spread, written

#: Words between blanks and these signs.
TOKEN = re.compile(r"""[^\s'",.\-/<>]+""")
#: Words that vouch for a region after them, and the longest name.
VOUCHERS = frozenset(("at", "in"))
MOST_WORDS = 3


@dataclass
class Gazetteer:
    """Places by lower-case name: countries and regions one each, cities all of a name; and the last words of countries' and regions' names."""

    countries: dict[str, dict]
    regions: dict[str, list[dict]]
    cities: dict[str, list[dict]]
    ends: frozenset[str]

    @staticmethod
    def of(rows: list[dict]) -> Gazetteer:
        """``rows``: kind, name, country, region, population, lat, lon, geonameid."""
        countries, regions, cities = {}, defaultdict(list), defaultdict(list)
        for r in sorted(rows, key=lambda r: (-(r["population"] or 0), r["geonameid"])):
            name = r["name"].lower()
            if r["kind"] == "country":
                countries.setdefault(name, r)
            else:
                (regions if r["kind"] == "region" else cities)[name].append(r)
        return Gazetteer(countries, dict(regions), dict(cities), frozenset(n.rsplit(" ", 1)[-1] for n in (*countries, *regions)))


def _names_ending_at(words: list[re.Match], i: int):
    """(first word's place, name) of the names of 1 to 3 words that end at word i; a lower-case beginning rules one out."""
    for k in range(1, MOST_WORDS + 1):
        if i - k + 1 < 0:
            return
        if not words[i - k + 1][0][0].islower():
            yield i - k + 1, " ".join(w[0] for w in words[i - k + 1 : i + 1]).lower()


def _country(g: Gazetteer, words, i):
    return next(((a, g.countries[n]) for a, n in _names_ending_at(words, i) if n in g.countries), None)


def _region(g: Gazetteer, words, i, country=None):
    for a, n in _names_ending_at(words, i):
        for r in g.regions.get(n, ()):
            if country is None or r["country"] == country["country"]:
                return a, r
    return None


def _city(g: Gazetteer, words, i, within):
    for a, n in _names_ending_at(words, i):
        for c in g.cities.get(n, ()):  # the most populous first
            if c["country"] == within["country"] and (within["kind"] == "country" or c["region"] == within["region"]):
                return a, c
    return None


def find_places(text: str | None, g: Gazetteer) -> list[dict]:
    """Mentions in order: the most specific place of each match with the match's span.

    Read from the end, a country or region is looked for at each word, then
    what may come before it: a city of the country, a city of the region, a
    region of the country; a country stands alone, a region only after a
    vouching word.  The first that fits wins and reading goes on before it.
    Every match ends with the last word of a country's or a region's name, so
    words that are none are passed over.
    """
    words, out, ends = list(TOKEN.finditer(text or "")), [], g.ends
    i = len(words) - 1
    while i >= 0:
        if words[i][0].lower() not in ends:
            i -= 1
            continue
        country, region = _country(g, words, i), _region(g, words, i)
        found = None
        if country and (city := _city(g, words, country[0] - 1, country[1]) if country[0] else None):
            found = city
        elif region and (city := _city(g, words, region[0] - 1, region[1]) if region[0] else None):
            found = city
        elif country and (inner := _region(g, words, country[0] - 1, country[1]) if country[0] else None):
            found = inner
        elif country:
            found = country
        elif region and region[0] and words[region[0] - 1][0].lower() in VOUCHERS:
            found = region
        if found is None:
            i -= 1
            continue
        a, place = found
        out.append({"geonameid": place["geonameid"], "name": place["name"], "kind": place["kind"], "lat": place["lat"], "lon": place["lon"], "start": words[a].start(), "end": words[i].end()})
        i = a - 1
    return out[::-1]


MENTION = "array<struct<geonameid:bigint,name:string,kind:string,lat:double,lon:double,start:int,`end`:int,context:string>>"


def _parsed(b, names, gazetteer_of, kind, around):
    """A batch's rows with their mentions; ``gazetteer_of``: the places that row i may name.

    With ``around`` a mention carries its text and as many characters on each side.
    """
    import pyarrow as pa

    found = []
    for i, (p, t) in enumerate(zip(b.column("place").to_pylist(), b.column("text").to_pylist())):
        lead = p + ". " if p else ""
        mentions = find_places(lead + (t or ""), gazetteer_of(i))
        for m in mentions if around is not None else ():
            a, z = m["start"] - len(lead), m["end"] - len(lead)
            m["context"] = (t or "")[max(a - around, 0) : max(z + around, 0)]
        found.append(mentions)
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(found, kind)], names=names)


def possible_names(text: F.Column) -> F.Column:
    """All names of 1 to 3 words of a text that begin with no lower-case letter, lower-cased."""
    words = F.filter(F.split(text, r"""[\s'",.\-/<>]+"""), lambda w: w != "")
    begins = lambda g: ~g[0].rlike(r"^\p{Ll}")
    grams = [F.transform(F.filter(ngrams(words, n), begins), lambda g: F.lower(F.array_join(g, " "))) for n in range(1, MOST_WORDS + 1)]
    return F.array_distinct(F.concat(*grams))


def geoparse(docs: DataFrame, gazetteer: DataFrame, most_rows: int = 200_000, around: int | None = None) -> DataFrame:
    """``(doc_id, geonameid, name, kind, lat, lon, is_publication, start, end)`` of each mention.

    ``docs`` have ``place`` and ``text``; a match inside the leading ``place``
    is the publication place, before the text's beginning.  A gazetteer of
    ``most_rows`` rows or fewer is sent to the tasks.  Of a larger one each
    document gets the places whose names its text has, by a join.  With
    ``around`` a last column ``context`` has the mention's text and as many
    characters on each side.
    """
    from lexloom.sources.arrow import arrow_type

    kind, names = arrow_type(MENTION), ["doc_id", "place", "mentions"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, place string, mentions {MENTION}"
    docs = docs.select("doc_id", "place", "text")
    if gazetteer.limit(most_rows + 1).count() <= most_rows:
        known = docs.sparkSession.sparkContext.broadcast(Gazetteer.of([r.asDict() for r in gazetteer.collect()]))

        def run(batches):
            for b in batches:
                yield _parsed(b, names, lambda i: known.value, kind, around)

        rows = spread(docs).mapInArrow(run, schema)
    else:
        columns = ["kind", "name", "country", "region", "population", "lat", "lon", "geonameid"]
        keyed = written(docs.withColumn("row", F.monotonically_increasing_id()), "places-of")
        named = keyed.select("row", F.explode(possible_names(F.concat_ws(". ", "place", "text"))).alias("low"))
        met = named.join(gazetteer.select(F.lower("name").alias("low"), F.struct(*columns).alias("g")), "low").groupBy("row").agg(F.collect_list("g").alias("own"))  # a text's own names

        def run(batches):
            for b in batches:
                own = b.column("own").to_pylist()
                yield _parsed(b, names, lambda i, own=own: Gazetteer.of(own[i] or []), kind, around)

        rows = keyed.join(met, "row", "left").select("doc_id", "place", "text", "own").mapInArrow(run, schema)
    shift = F.when(F.coalesce(F.length("place"), F.lit(0)) > 0, F.length("place") + 2).otherwise(0)
    m = rows.select("doc_id", F.coalesce(F.length("place"), F.lit(0)).alias("own"), shift.alias("shift"), F.explode("mentions").alias("m"))
    return m.select("doc_id", "m.geonameid", "m.name", "m.kind", "m.lat", "m.lon", (F.col("m.start") < F.col("own")).alias("is_publication"), (F.col("m.start") - F.col("shift")).alias("start"), (F.col("m.end") - F.col("shift")).alias("end"), *([F.col("m.context").alias("context")] if around is not None else []))


def register_parser(spark: SparkSession, gazetteer: DataFrame, name: str = "places_of", most_rows: int = 200_000) -> None:
    """A table function for SQL: ``FROM docs, LATERAL places_of(place, text)`` gives a row for each mention, as ``geoparse`` does.

    The gazetteer is sent to the tasks; one of more than ``most_rows`` rows is an error, and ``geoparse`` joins it instead.
    """
    from pyspark.sql.functions import udtf

    rows = gazetteer.limit(most_rows + 1).collect()  # checked below
    if len(rows) > most_rows:
        raise ValueError(f"a gazetteer of more than {most_rows} rows can't be sent to the tasks")
    known = spark.sparkContext.broadcast(Gazetteer.of([r.asDict() for r in rows]))

    class Places:
        def eval(self, place: str, text: str):
            own = len(place) if place else 0
            shift = own + 2 if own else 0
            for m in find_places((place + ". " if place else "") + (text or ""), known.value):
                yield m["geonameid"], m["name"], m["kind"], m["lat"], m["lon"], m["start"] < own, m["start"] - shift, m["end"] - shift

    kind = "geonameid bigint, name string, kind string, lat double, lon double, is_publication boolean, start bigint, `end` bigint"
    spark.udtf.register(name, udtf(Places, returnType=kind))


def heatmap(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("lat", "lon").agg(F.count("*").alias("n"))


def place_years(mentions: DataFrame, years: DataFrame) -> DataFrame:
    """``(place, year, docs)``: documents that mention a place, once each."""
    return mentions.select("doc_id", "place").distinct().join(years, "doc_id").groupBy("place", "year").agg(F.count("*").alias("docs"))


def mention_years(mentions: DataFrame, years: DataFrame) -> DataFrame:
    """``(place, year, n)``: all mentions."""
    return mentions.join(years, "doc_id").groupBy("place", "year").agg(F.count("*").alias("n"))


def flights(mentions: DataFrame, published: DataFrame, years: DataFrame, places: DataFrame) -> DataFrame:
    """``(doc_id, year, source, target)``: from where documents appeared to the places they mention, known places only, a row each."""
    known = places.select("place")
    links = mentions.select("doc_id", F.col("place").alias("target")).join(known.withColumnRenamed("place", "target"), "target", "left_semi").distinct()
    own = published.select("doc_id", F.col("place").alias("source")).join(known.withColumnRenamed("place", "source"), "source", "left_semi")
    return links.join(own, "doc_id").join(years, "doc_id").select("doc_id", "year", "source", "target")


def flight_paths(flights_: DataFrame) -> DataFrame:
    """``(year, source, target, weight)``."""
    return flights_.groupBy("year", "source", "target").agg(F.count("*").alias("weight"))


def entity_counts(annotations: DataFrame, default: str = "unknown") -> DataFrame:
    """``(uri, doc_id, n)`` from annotation JSON ``{"Resources": [{"@URI": ...}]}``."""
    parsed = F.from_json("annotation", "Resources array<struct<`@URI`:string>>")
    rows = annotations.select("doc_id", F.explode(parsed["Resources"]).alias("r"))
    return rows.select("doc_id", F.coalesce(F.col("r.`@URI`"), F.lit(default)).alias("uri")).groupBy("uri", "doc_id").agg(F.count("*").alias("n"))


def top_entities(counts: DataFrame, n: int = 100) -> DataFrame:
    """``(uri, weight)`` of entities heavier than the n-th, or than the lightest if there are fewer."""
    weights = counts.groupBy("uri").agg(F.sum("n").alias("weight"))
    edge = weights.select("weight").orderBy(F.desc("weight")).limit(n).agg(F.min("weight").alias("edge"))
    return weights.join(F.broadcast(edge)).where("weight > edge").drop("edge")  # one row


def over_quantile(nodes: DataFrame, q: float = 0.75) -> DataFrame:
    """Entity nodes at or over the quantile of all nodes' values, and every document node."""
    edge = nodes.agg(F.percentile("value", q).alias("edge"))
    return nodes.join(F.broadcast(edge)).where("value >= edge OR kind = 'document'").drop("edge")  # one row
