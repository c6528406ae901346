"""Text around the numbers: words for readings, keys in listings, event streams replayed from text, slugs; and checks that members may be compared at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgelift.functions import air, wind

from .documents import SLUG
from .sequences import micros

#: A reading about an hour off points at a clock on the wrong side of a change of time.
HOUR_SKEW_S, SKEW_TOLERANCE_S = 3600, 300
#: The kinds of findings in the order in which they are told.
KINDS = (
    "terrainMismatch",
    "thermalWindow",
    "percentileCrossing",
    "quietDay",
    "liftCeiling",
    "capTiming",
    "convectiveDay",
    "smokeImpact",
    "windSummary",
    "windExceedance",
    "windDirection",
    "bandShear",
    "ensembleMembership",
    "dataCaveats",
)


def speed_text(mps: Column, per_mps: float) -> Column:
    """Whole units, or a dash."""
    return F.when(mps.isNull(), "—").otherwise(F.floor(mps * per_mps + 0.5).cast("bigint").cast("string"))


def direction_text(speed: Column, deg: Column) -> Column:
    return F.when(wind.is_calm(speed), "calm").when(deg.isNull(), "—").otherwise(F.concat_ws(" ", wind.compass(deg), F.floor(deg + 0.5).cast("bigint").cast("string")))


def age_text(seconds: Column) -> Column:
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min ago"))).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h ago")))


def hour_skew(observed: Column, now: Column) -> Column:
    """Whether a reading is about an hour from now."""
    return F.abs(F.abs(micros(observed) - micros(now)) / 1e6 - HOUR_SKEW_S) <= SKEW_TOLERANCE_S


def season_phase(at: Column) -> Column:
    """Share of the year since the last 21 December, from 0 to 1."""
    this = F.make_timestamp(F.year(at), F.lit(12), F.lit(21), F.lit(0), F.lit(0), F.lit(0))
    last = F.make_timestamp(F.year(at) - 1, F.lit(12), F.lit(21), F.lit(0), F.lit(0), F.lit(0))
    since = F.when(at >= this, micros(at) - micros(this)).otherwise(micros(at) - micros(last))
    return F.pmod(since / (365.25 * 86_400e6), F.lit(1.0))


def history_hours(text: Column, ceiling: float, step: float = 0.25) -> Column:
    """Hours of history as asked for, in steps; the ceiling if nothing is asked, null if it is no number in (0, ceiling]."""
    x = text.try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x <= ceiling)
    rounded = F.least(F.lit(ceiling), F.greatest(F.lit(step), F.floor(x / step + 0.5) * step))
    return F.when(text.isNull(), F.lit(ceiling)).when(ok, rounded)


def is_slug(text: Column) -> Column:
    return text.rlike(SLUG)


def station_key(text: Column, host: str) -> Column:
    """A station's key, given as such or as the address of its page."""
    t = F.trim(text)
    path = F.regexp_extract(t, rf"^https://{host.replace('.', '[.]')}/en/([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.when(is_slug(t), t).when(is_slug(path), path)


def decoded_xml(text: Column) -> Column:
    """Text with its character references in place: the five named ones and any number, decimal or hexadecimal. Each is read once, so what decoding yields is not decoded again; numbers of no character stay."""
    named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}

    def decoded(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#(?:[xX]0*([0-9A-Fa-f]{1,6})|0*([0-9]{1,7}));$", 1)
        decimal = F.regexp_extract(piece, "^&#0*([0-9]{1,7});$", 1)
        code = F.conv(F.when(digits != "", digits), 16, 10).cast("long")
        code = F.coalesce(code, F.when(decimal != "", decimal).cast("long"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        out = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for entity, char in named.items():
            out = F.when(piece == entity, char).otherwise(out)
        return F.coalesce(out, piece)

    pieces = F.regexp_extract_all(text, F.lit("(?s)&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|lt|gt|quot|apos|amp);|[^&]+|&"), F.lit(0))
    return F.array_join(F.transform(pieces, decoded), "")


def listed_keys(raw: DataFrame, suffix: str) -> DataFrame:
    """raw: path, body of an object listing. The keys with a suffix, in order."""
    keys = F.regexp_extract_all("body", F.lit(r"(?s)<Contents>(?:(?!</Contents>).)*?<Key>(.*?)</Key>"), F.lit(1))
    return raw.select("path", F.posexplode(keys).alias("place", "key")).select("path", "place", decoded_xml(F.col("key")).alias("key")).where(F.col("key").endswith(suffix))


def stream_events(raw: DataFrame, most_bytes: int = 262_144) -> DataFrame:
    """raw: path, body of an event stream. Its dispatched events: place, event (message without a name), data. What a blank line does not end is dropped; comments, ids and retries are passed over.

    An event of more than most_bytes is given as too_long, without its data.
    """
    blocks = F.split(F.regexp_replace("body", "\r\n", "\n"), "\n\n+")
    x = raw.select("path", F.posexplode(F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("place", "b"))
    lines = F.filter(F.split("b", "\n"), lambda s: ~s.startswith(":") & (s != ""))
    field = lambda name: F.filter("ls", lambda s: (s == name) | s.startswith(f"{name}:"))
    value = lambda s: F.regexp_replace(s, "^[a-z]+:? ?", "")
    x = x.withColumn("ls", lines).withColumn("data", F.transform(field("data"), value)).withColumn("names", F.transform(field("event"), value))
    size = F.aggregate("ls", F.lit(0), lambda a, s: a + F.length(s))
    name = F.try_element_at("names", F.lit(-1))
    long = size > most_bytes
    return x.where(F.size("data") > 0).select("path", "place", F.when(name.isNull() | (name == ""), "message").otherwise(name).alias("event"), F.when(~long, F.array_join("data", "\n")).alias("data"), long.alias("too_long"))


def with_depression(levels: DataFrame) -> DataFrame:
    """levels with a dew-point depression from their relative humidity."""
    t = F.col("temperature_c")
    return levels.withColumn("dew_point_depression_c", t - air.dew_point(t, F.col("relative_humidity_pct")))


def fractions_map(shares: DataFrame, key: str, code: str) -> DataFrame:
    """shares: key, code, share, rank. One map a key, its classes by rank."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(code).cast("string").alias("c"), "share")))
    return shares.groupBy(key).agg(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["c"], x["share"]))).alias("fractions"))


def coherence(members: DataFrame) -> DataFrame:
    """members: site, member, zone, launch_m, thresholds, vocabulary. Per site what keeps its members from being compared: the first of duplicate members, mixed vocabularies, zones, launches or thresholds; null if nothing does."""
    mixed = lambda c: F.count_distinct(F.struct(F.col(c))) > 1
    g = members.groupBy("site").agg(F.count("*").alias("members"), (F.count_distinct("member") < F.count("*")).alias("d"), *[mixed(c).alias(f"_{c}") for c in ("vocabulary", "zone", "launch_m", "thresholds")])
    problem = F.when(F.col("d"), "duplicate member").when(F.col("_vocabulary"), "vocabulary").when(F.col("_zone"), "zone").when(F.col("_launch_m"), "launch").when(F.col("_thresholds"), "thresholds")
    return g.select("site", "members", problem.alias("problem"))


def every_finding(frames: dict[str, DataFrame]) -> DataFrame:
    """profile_id, kind, kind_order and the finding as JSON, of frames by kind: told in the order of `KINDS`, then as given."""
    unknown = set(frames) - set(KINDS)
    if unknown:
        raise ValueError(f"no such kinds: {sorted(unknown)}")
    rows = [df.select("profile_id", F.lit(k).alias("kind"), F.lit(KINDS.index(k)).alias("kind_order"), F.to_json(F.struct(*[c for c in df.columns if c != "profile_id"])).alias("finding")) for k, df in frames.items()]
    return reduce(DataFrame.unionByName, rows)


def elevation_pick(candidates: DataFrame) -> DataFrame:
    """candidates: place_id, source, year, elevation_m. Of each place the first elevation there is, surveys from the newest down, then the map."""
    rank = F.when(F.col("source") == "survey", 0).otherwise(1)
    return candidates.where("elevation_m is not null").groupBy("place_id").agg(F.min_by(F.struct("source", "elevation_m"), F.struct(rank, -F.coalesce("year", F.lit(0)), "elevation_m")).alias("p")).select("place_id", "p.*")
