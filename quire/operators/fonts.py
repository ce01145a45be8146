"""Font matching: the face that differs least from what a usage asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import font_class, font_family_key


def resolve_fonts(usages: DataFrame, faces: DataFrame, max_broadcast: int = 20_000) -> DataFrame:
    """Add ``face_family, face_path, exact, distance, n_missing`` to usages (usage_id, family, bold, italic,
    characters array<int>).

    Faces: family, path, weight, italic, width_class, glyphs. The faces of the family itself are the
    candidates where there are any, else all are. The distance is |weight - (700 or 400)| / 500 +
    |width - 5| / 8 + .35 for another slant + .45 for another class + min(2, missing / distinct
    characters); ties go by family, then path. Without faces the distance is 1.

    Usages are reduced to their distinct requests (family, weight, slant and characters) before they meet any
    face, and the answer returns to them by the request. Faces are a catalogue: it is broadcast where it has
    at most ``max_broadcast`` faces; a larger one meets the requests without a family of their own by class.
    Null flags count as false, null characters as none.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    asked = usages.withColumn("_request", F.struct(font_family_key(F.col("family")).alias("key"), font_class(F.col("family")).alias("kind"), flag("bold").alias("bold"), flag("italic").alias("italic"), F.array_sort(F.array_distinct(F.coalesce(F.col("characters").cast("array<int>"), F.array().cast("array<int>")))).alias("chars")))
    requests = asked.select("_request").distinct().withColumn("_key", F.coalesce("_request.key", F.lit("")))
    f = faces.select(F.col("family").alias("face_family"), F.col("path").alias("face_path"), "weight", F.col("italic").alias("face_italic"), "width_class", "glyphs").withColumn("_fkey", F.coalesce(font_family_key(F.col("face_family")), F.lit(""))).withColumn("_fclass", font_class(F.col("face_family")))
    known = f.select(F.col("_fkey").alias("_key")).distinct()
    few = faces.limit(max_broadcast + 1).count() <= max_broadcast
    own = requests.join(known, "_key", "left_semi")
    exact = own.join(f, own["_key"] == f["_fkey"]).withColumn("exact", F.lit(True))
    rest = requests.join(known, "_key", "left_anti")
    other = rest.join(F.broadcast(f), F.lit(True)) if few else _by_class(rest, f)
    pairs = exact.unionByName(other.withColumn("exact", F.lit(False)))
    chars = F.col("_request.chars")
    missing = F.size(F.array_except(chars, "glyphs"))
    distance = (
        F.abs(F.col("weight") - F.when(F.col("_request.bold"), 700).otherwise(400)) / 500
        + F.abs(F.col("width_class") - 5) / 8
        + F.when(F.col("_request.italic") != F.col("face_italic"), 0.35).otherwise(0.0)
        + F.when(F.col("_request.kind") != F.col("_fclass"), 0.45).otherwise(0.0)
        + F.least(F.lit(2.0), F.when(F.size(chars) > 0, missing / F.size(chars)).otherwise(0.0))
    )
    pairs = pairs.withColumns({"distance": F.round(distance, 9), "n_missing": missing})
    best = pairs.groupBy("_request").agg(F.min_by(F.struct("face_family", "face_path", "exact", "distance", "n_missing"), F.struct("distance", "_fkey", F.lower("face_path").alias("p"))).alias("_b"))
    out = asked.join(best.withColumnRenamed("_request", "_asked"), F.col("_request") == F.col("_asked"), "left")
    return out.select(*usages.columns, "_b.face_family", "_b.face_path", F.coalesce("_b.exact", F.lit(False)).alias("exact"), F.coalesce("_b.distance", F.lit(1.0)).alias("distance"), "_b.n_missing")


def _by_class(requests: DataFrame, faces: DataFrame) -> DataFrame:
    """All pairs, met by the faces' class: a request goes to each class that there is, and Spark may split a class."""
    classes = faces.select("_fclass").distinct()
    return requests.join(F.broadcast(classes), F.lit(True)).join(faces, "_fclass")


def resolution_report(resolved: DataFrame) -> DataFrame:
    """One row: usages, substitutions, usages with missing glyphs, and unresolved ones."""
    return resolved.agg(
        F.count("*").alias("n_usages"), F.count_if(~F.col("exact") & F.col("face_path").isNotNull()).alias("n_substituted"),
        F.count_if(F.col("n_missing") > 0).alias("n_missing_glyphs"), F.count_if(F.col("face_path").isNull()).alias("n_unresolved"),
    )


def document_fonts_first(usages: DataFrame, own: DataFrame, system: DataFrame) -> DataFrame:
    """Add ``path``: the document's own program of a family, weight and slant, else the system's face."""
    key = ["doc_id", "family", "bold", "italic"]
    o = own.groupBy(*key).agg(F.min("path").alias("_own"))
    s = resolve_fonts(usages, system)
    return s.join(o, key, "left").withColumn("path", F.coalesce("_own", "face_path")).drop("_own")


def theme_fonts(runs: DataFrame, theme: DataFrame) -> DataFrame:
    """Replace ``+mj-lt``-like references in ``family`` by the theme's family; unknown ones become null."""
    t = theme.select("doc_id", F.col("ref").alias("family"), F.col("family").alias("_t"))
    out = runs.join(t, ["doc_id", "family"], "left")
    return out.withColumn("family", F.when(F.startswith("family", F.lit("+")), F.col("_t")).otherwise(F.col("family"))).drop("_t")
