"""Registry responses: outcome, features, object projection, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import filled, strip


def _json(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def outcome(body: Column, http_status: Column) -> Column:
    """``found``, ``not found`` or ``broken``.

    An answer that only says OK, is empty or no JSON marks a broken host; a
    404 counts as an answer when it carries code 204 or says "not found".
    """
    raw = strip(F.coalesce(body, F.lit("")))
    valid = F.try_parse_json(F.when((raw != "") & (raw != "OK"), raw)).isNotNull()
    missing = (http_status == 404) & (
        (_json(raw, "$.code") == "204") | _json(raw, "$.message").rlike("(?iu)no objects found|не найден")
    )
    features = _json(raw, "$.data.features")
    some = features.isNotNull() & (features != "[]")
    answered = http_status.between(200, 299) & (
        (_json(raw, "$.data.type") == "FeatureCollection") | F.coalesce(features.startswith("["), F.lit(False))
    )
    return (
        F.when(valid & F.coalesce(missing, F.lit(False)), F.lit("not found"))
        .when(valid & F.coalesce(answered, F.lit(False)), F.when(some, F.lit("found")).otherwise(F.lit("not found")))
        .otherwise(F.lit("broken"))
    )


def features_of(body: Column) -> Column:
    """Features of a response as an array of JSON texts."""
    return F.from_json(_json(body, "$.data.features"), "array<string>")


def pick_feature(features: Column, key: Column) -> Column:
    """The feature that names the key in any of three fields, else the first."""

    any_field = F.filter(
        features,
        lambda f: F.coalesce(_json(f, "$.properties.options.cad_num") == key, F.lit(False))
        | F.coalesce(_json(f, "$.properties.descr") == key, F.lit(False))
        | F.coalesce(_json(f, "$.properties.label") == key, F.lit(False)),
    )
    return F.coalesce(F.get(any_field, F.lit(0)), F.get(features, F.lit(0)))


def polygons_of(geometry: Column) -> Column:
    """GeoJSON geometry text to polygons -> rings -> [x, y]; a point is one
    ring of one vertex."""
    kind, coords = _json(geometry, "$.type"), _json(geometry, "$.coordinates")
    wrap = lambda c: F.when(c.isNotNull(), F.array(c))
    return (
        F.when(kind == "Point", wrap(wrap(wrap(F.from_json(coords, "array<double>")))))
        .when(kind == "Polygon", wrap(F.from_json(coords, "array<array<array<double>>>")))
        .when(kind == "MultiPolygon", F.from_json(coords, geo.RINGS))
    )


def location_of(geometry: Column) -> Column:
    """Centre of a geometry as (lon, lat) degrees."""
    c = geo.ring_centroid(polygons_of(geometry))
    point = geo.to_wgs84(c["x"], c["y"], _json(geometry, "$.crs.properties.name"))
    usable = point["lon"].isNotNull() & point["lat"].isNotNull() & ~F.isnan(point["lat"]) & ~F.isnan(point["lon"])
    return F.when(usable, point)


def registry_object(df: DataFrame, feature: str, key: str, *keep: str) -> DataFrame:
    """Typed object of a registry feature; each field has its fall-back paths."""
    f = F.col(feature)
    prop = lambda name: _json(f, f"$.properties.{name}")
    opt = lambda name: _json(f, f"$.properties.options.{name}")
    text = lambda *cs: F.coalesce(*[filled(c) for c in cs])
    number = lambda *names: F.coalesce(*[opt(n) for n in names]).try_cast("double")
    geometry = _json(f, "$.geometry")
    polygons = polygons_of(geometry)
    return df.select(
        *keep,
        text(opt("cad_num"), prop("descr"), F.col(key)).alias("key"),
        text(opt("readable_address"), opt("address")).alias("address"),
        text(opt("land_record_type"), opt("build_record_type"), prop("categoryName")).alias("object_type"),
        filled(prop("categoryName")).alias("category"),
        number("land_record_area", "specified_area", "area", "build_record_area").alias("area"),
        F.when(F.coalesce(opt("land_record_area"), opt("specified_area")).isNotNull(), F.lit("кв. м")).alias("area_unit"),
        number("cost_value").alias("value"),
        text(opt("permitted_use_established_by_document"), opt("purpose")).alias("permitted_use"),
        filled(opt("status")).alias("status"),
        filled(opt("quarter_cad_number")).alias("quarter_cad_number"),
        filled(opt("ownership_type")).alias("ownership_type"),
        text(opt("land_record_reg_date"), opt("registration_date")).alias("registration_date"),
        F.coalesce(
            prop("cadastralDistrictsCode").try_cast("int"), F.substring_index(F.col(key), ":", 1).try_cast("int")
        ).alias("region_code"),
        location_of(geometry).alias("location"),
        geo.reproject(polygons, _json(geometry, "$.crs.properties.name")).alias("polygons"),
        F.when(f.isNotNull(), F.lit(True)).otherwise(F.lit(False)).alias("found"),
    )


def related_objects(df: DataFrame, key: str, tabs: list[str]) -> DataFrame:
    """(key, related_key, group) from tab documents, tabs in order; the first
    group that names an object keeps it."""
    out = None
    for rank, tab in enumerate(tabs):
        groups = F.from_json(_json(F.col(tab), "$.object"), "array<struct<title:string,value:array<string>>>")
        part = (
            df.select(F.col(key).alias("key"), F.posexplode(groups).alias("g", "item"))
            .select(
                "key",
                "g",
                F.regexp_replace("item.title", r"(?U):?\s*$", "").alias("group"),
                F.posexplode(F.filter("item.value", lambda v: F.coalesce(v != "", F.lit(False)))).alias("v", "related_key"),
            )
            .where("group <> ''")
            .select("key", "related_key", "group", F.struct(F.lit(rank).alias("tab"), "g", "v").alias("ord"))
        )
        out = part if out is None else out.unionByName(part)
    return first_group(out, "key", "related_key", "group", "ord")


def first_group(pairs: DataFrame, key: str, related: str, group: str, order: str) -> DataFrame:
    """Per (key, related) the group that comes first in ``order``."""
    return pairs.groupBy(F.col(key).alias("key"), F.col(related).alias("related_key")).agg(
        F.min_by(group, order).alias("group")
    )
