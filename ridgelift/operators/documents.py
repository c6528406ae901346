"""Published documents as rows: guards by schema and version, catalogues, indexes of archives, the order of an upload, freshness of the measured ground.

A document is a row with its text. What cannot be used is a row too: `miss` says whether it is absent or invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


def guarded(raw: DataFrame, schema: str, versions: tuple[int, ...], required: tuple[str, ...] = ()) -> DataFrame:
    """raw: path, body. Adds doc (null unless the body has a supported version and the required fields), miss (absent, invalid or null), declared_version and supported_version (of misses)."""
    declared = F.get_json_object("body", "$.schemaVersion").try_cast("double")
    is_number = F.get_json_object("body", "$.schemaVersion").rlike(r"^-?\d+(\.\d+)?$")
    doc = F.from_json("body", schema)
    whole = doc.isNotNull() & declared.isin(*[float(v) for v in versions])
    for f in required:
        whole = whole & doc[f].isNotNull()
    ok = F.coalesce(whole, F.lit(False))
    x = raw.withColumn("doc", F.when(ok, doc)).withColumn("miss", F.when(F.col("body").isNull(), "absent").when(~ok, "invalid"))
    return x.withColumn("declared_version", F.when((F.col("miss") == "invalid") & is_number, declared)).withColumn("supported_version", F.when(F.col("miss") == "invalid", F.lit(max(versions))))


def strict_sites(raw: DataFrame, fields: tuple[str, ...], version: int = 2) -> DataFrame:
    """raw: path, body of a site catalogue. One row a site with its slug, name, latitude, longitude, and problem: a wrong version, an empty list, an elevation, missing or unknown fields, or a malformed slug.

    A writer's catalogue is read strictly, so that a mistyped entry shows instead of being passed over.
    """
    declared = F.get_json_object("body", "$.schemaVersion").try_cast("double")
    sites = F.from_json(F.get_json_object("body", "$.sites"), "array<map<string,string>>")
    x = raw.select("path", declared.alias("v"), sites.alias("sites"))
    x = x.select("path", "v", F.coalesce(F.size("sites"), F.lit(-1)).alias("n"), F.explode_outer("sites").alias("s"))
    keys, known = F.map_keys("s"), F.array(*[F.lit(f) for f in fields])
    missing, unknown = F.array_sort(F.array_except(known, keys)), F.array_sort(F.array_except(keys, known))
    problem = (
        F.when(F.col("v").isNull() | (F.col("v") != version), "version")
        .when(F.col("n") <= 0, "no sites")
        .when(F.array_contains(keys, "elevationM"), "elevation")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(unknown, ", ")))
        .when(~F.col("s")["slug"].rlike(SLUG), "slug")
    )
    return x.select("path", F.col("s")["slug"].alias("slug"), F.col("s")["name"].alias("name"), F.col("s")["latitude"].try_cast("double").alias("latitude"), F.col("s")["longitude"].try_cast("double").alias("longitude"), problem.alias("problem"))


def catalogued_models(raw: DataFrame) -> DataFrame:
    """raw: body of a model catalogue. slug and kind of every dataset, forecasts first, then smoke, then observations; `place` keeps the order."""
    lists = [F.from_json(F.get_json_object("body", f"$.{k}"), "array<struct<slug:string,kind:string>>") for k in ("models", "smokeModels", "observationModels")]
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<slug:string,kind:string>>")) for x in lists]))
    return raw.select(F.posexplode(every).alias("place", "m")).select("place", "m.slug", "m.kind")


def index_members(raw: DataFrame, version: int = 1) -> DataFrame:
    """raw: path, body of an archive's index. Its members; those whose bytes cannot be placed are left out, and so is everything of an index with another version."""
    fields = ("byteOffset", "byteLength", "lines", "referenceTime", "generatedAt", "firstObservedAt", "lastObservedAt")
    declared = F.get_json_object("body", "$.schemaVersion")
    x = raw.where(declared.isNull() | (declared.try_cast("double") == version))
    x = x.select("path", F.explode(F.from_json(F.get_json_object("body", "$.members"), "array<map<string,string>>")).alias("m"))
    whole = lambda f: F.when(F.col("m")[f].rlike(r"^-?\d+$"), F.col("m")[f].try_cast("bigint"))
    x = x.select("path", *[(whole(f) if f in fields[:3] else F.col("m")[f]).alias(f) for f in fields])
    return x.where("byteOffset >= 0 and byteLength > 0").withColumn("lines", F.when(F.col("lines") >= 0, F.col("lines")))


def open_months(now: Column) -> tuple[Column, Column]:
    """The months whose archives may still grow: this one and the one before (UTC)."""
    return F.date_format(now, "yyyy-MM"), F.date_format(F.add_months(F.trunc(now, "month"), -1), "yyyy-MM")


def upload_plan(files: DataFrame, now: Column) -> DataFrame:
    """files: model, kind (archive, index, site or manifest), site, month. In the order of an upload: open archives, their indexes, closed archives, their indexes, sites, and the manifest last, for it makes the rest visible."""
    this, before = open_months(now)
    is_open = F.col("month").isin(this, before)
    rank = F.when(F.col("kind") == "manifest", 5).when(F.col("kind") == "site", 4).otherwise(F.when(is_open, 0).otherwise(2) + F.when(F.col("kind") == "index", 1).otherwise(0))
    return files.withColumn("rank", rank).withColumn("key", document_key(F.col("model"), F.col("kind"), F.col("site"), F.col("month"))).withColumn("live", (rank >= 4) | F.coalesce(is_open, F.lit(False))).orderBy("model", "rank", "site", "month")


def document_key(model: Column, kind: Column, site: Column, month: Column) -> Column:
    """Where a document of a dataset lies."""
    history = F.concat_ws("/", model, F.lit("history"), site, month)
    return F.when(kind == "manifest", F.concat(model, F.lit("/manifest.json"))).when(kind == "site", F.concat(model, F.lit("/sites/"), site, F.lit(".json"))).when(kind == "archive", F.concat(history, F.lit(".jsonl.gz"))).when(kind == "index", F.concat(history, F.lit(".index.json")))


def context_freshness(sites: DataFrame, context: DataFrame) -> DataFrame:
    """sites and context: slug, latitude, longitude. One row: whether every site was measured at exactly its catalogued point."""
    c = context.select("slug", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    same = F.coalesce((F.col("latitude") == F.col("_lat")) & (F.col("longitude") == F.col("_lon")), F.lit(False))
    return sites.join(c, "slug", "left").agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("fresh"), F.count_if(~same).alias("stale_sites"))


def cycle(stamp: Column, hours: tuple[str, ...]) -> Column:
    """date and hour of a cycle's stamp (YYYY-MM-DDTHH:00:00Z); null if it is none, or not at one of the model's hours."""
    part = lambda i: F.regexp_extract(stamp, r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):00:00Z$", i)
    return F.when(part(4).isin(*hours), F.struct(F.concat(part(1), part(2), part(3)).alias("date"), part(4).alias("hour")))


def observation_manifest(rows: DataFrame) -> DataFrame:
    """rows: model, site, observed_at. The reference time of an observed dataset is its newest instant."""
    return rows.groupBy("model").agg(F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"), F.max("observed_at").alias("reference_time"), F.count("*").alias("observations"), F.count_distinct("site").alias("sites"))


def resolve_station(stations: DataFrame, asked: Column, primary: Column) -> DataFrame:
    """stations: feed_id, place, station_id. Of each feed the station asked for (and no other, if one is asked for), else the primary one, else the first."""
    sid = F.col("station_id")
    rank = F.when(asked.isNotNull(), F.when(sid == asked, 0)).when(sid == primary, 0).otherwise(1)
    return stations.withColumn("_r", rank).where("_r is not null").groupBy("feed_id").agg(F.min_by("station_id", F.struct("_r", "place")).alias("station_id"))
