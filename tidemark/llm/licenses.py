"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Only DataFrame expressions run: words are split and hashed to shingles inside the scan, texts
without any template shingle end there, and the rest are read in overlapping windows sized for
each template. A window is retrieved for a template if one of BANDS bands of ROWS MinHashes is
equal, and reported if the window holds at least CONTAINMENT of the template's shingles, and of
those that tell it from each sibling of another license (a version, a name) at least TELLING. A
template that lies whole in one of another license gives way where that one is found around it.

A window is a stride longer than the template's own run of m shingles, so any run of m shingles
lies whole in some window. One that holds 3/4 of the shingles of a template has a Jaccard
similarity of 0.75 m / (1.25 m + 0.25 m) = 0.5 with it at least, and shares a band with
probability 1 - (1 - 0.5) ** 24, which misses 6 in 10**8. With exact=True every window is
verified against all templates of its size, and none is missed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .license_texts import TEMPLATES

SHINGLE = 5
CONTAINMENT = 0.75
BANDS, ROWS = 24, 1

#: Of the shingles that tell a template from one of another license that is most of it, a window must hold this share.
TELLING, SIBLING = 0.5, 0.5


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and of characters beyond ASCII."""
    return F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def shingles_of(words: Column) -> Column:
    """Hashes of the words' SHINGLE-grams in order; none for fewer words."""

    def hashed(w: Column) -> Column:
        n = F.size(w) - SHINGLE + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))

    return bound(words, hashed)


def bands_of(shingles: Column) -> Column:
    """array<struct<band int, value bigint>> of the MinHashes of a shingle array."""
    mins = lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*[F.struct(F.lit(b).alias("band"), (mins(b * ROWS) if ROWS == 1 else F.xxhash64(*[mins(b * ROWS + r) for r in range(ROWS)])).alias("value")) for b in range(BANDS)])


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, license, shingles (distinct), m (their number), telling (for each sibling, the shingles that it lacks), around (the templates of other licenses that hold all shingles: shingles, m, telling)."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.withColumn("shingles", F.array_distinct(shingles_of(words_of(F.col("text"))))).withColumn("m", F.size("shingles")).where("m > 0").drop("text").collect()
    sets = {r.template: set(r.shingles) for r in rows}
    license = {r.template: r.license for r in rows}
    telling = {t: [sorted(a - b) for s, b in sets.items() if license[s] != license[t] and a - b and len(a & b) >= SIBLING * len(a)] for t, a in sets.items()}
    around = {t: [(sorted(b), len(b), telling[s]) for s, b in sets.items() if license[s] != license[t] and a < b] for t, a in sets.items()}
    kind = "template int, license string, shingles array<bigint>, m int, telling array<array<bigint>>, around array<struct<shingles: array<bigint>, m: int, telling: array<array<bigint>>>>"
    return spark.createDataFrame([(r.template, r.license, r.shingles, r.m, telling[r.template], around[r.template]) for r in rows], kind)


def holds(window: Column, shingles: Column, m: Column, telling: Column) -> Column:
    """Does the window hold enough of a template, and of what tells it from each sibling?"""
    return (F.size(F.array_intersect(window, shingles)) >= CONTAINMENT * m) & F.forall(telling, lambda t: F.size(F.array_intersect(window, t)) >= TELLING * F.size(t))


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """One row for each document and license found: id, license, containment (the best), first_shingle of its best window, n_matches.

    Null, empty and short texts match nothing. Repeated rows share one result row; null ids make
    one group. Templates must have SHINGLE words or more; the list is a short one, its table is
    collected to the driver and broadcast.

    exact: retrieve all templates of a window's size without bands.
    """
    spark = docs.sparkSession
    listed = template_table(spark, templates or TEMPLATES)
    rows = listed.collect()
    known = sorted({h for r in rows for h in r.shingles})
    sizes = sorted({r.m for r in rows})
    own = {m: sorted({h for r in rows if r.m == m for h in r.shingles}) for m in sizes}
    # How far on either side of a window of each size a larger template may reach.
    reach = {m: max((a.m for r in rows if r.m == m for a in r.around), default=0) for m in sizes}
    sizes_of: dict[int, list[int]] = {}
    for m in sizes:
        for h in own[m]:
            sizes_of.setdefault(h, []).append(m)
    # Texts with a template's shingle, and where; written, so that later steps don't split words again.
    hits = lambda s: F.filter(F.transform(s, lambda h, i: F.when(h.isin(known), F.struct(i.alias("at"), h.alias("h")))), lambda x: x.isNotNull())
    found = bound(shingles_of(words_of(F.col(text_col))), lambda s: F.when(F.exists(s, lambda h: h.isin(known)), F.struct(s.alias("shingles"), hits(s).alias("hits"))))
    shingled = saved(docs.select(F.col(id_col).alias("id"), F.explode(F.array(found)).alias("f")).where("f is not null").select("id", "f.shingles", "f.hits"), "license-texts")

    def window_starts(m: int) -> Column:
        """Starts, multiples of the stride, of the windows of size m + stride that hold hits enough for a template of m shingles."""
        stride, length = max(1, m // 4), m + max(1, m // 4) - 1
        near = F.transform(F.filter("hits", lambda x: x["h"].isin(own[m])), lambda x: F.sequence(F.greatest(F.ceil((x["at"] - length + 1) / stride), F.lit(0)).cast("int"), F.floor(x["at"] / stride).cast("int")))
        # Each hit names its windows, so in order a window with enough of them is found again need - 1 places on.
        need = ceil(CONTAINMENT * m)
        full = bound(F.sort_array(F.flatten(near)), lambda a: F.array_distinct(F.filter(a, lambda k, i: F.get(a, i + (need - 1)) == k)))
        return F.transform(full, lambda k: F.struct(F.lit(m).alias("m"), (k * stride).cast("int").alias("start"), F.lit(length).alias("length"), F.lit(reach[m]).alias("reach")))

    # Few rows with much work each: spread over all cores.
    low = F.greatest(F.col("w.start") - F.col("w.reach"), F.lit(0))
    windows = (
        shingled.repartition(F.xxhash64("id")).withColumn("w", F.explode(reduce(lambda a, b: F.concat(a, b), [window_starts(m) for m in sizes])))
        .select("id", "w.m", "w.start", F.slice("shingles", F.col("w.start") + 1, F.col("w.length")).alias("window"), F.when(F.col("w.reach") > 0, F.slice("shingles", low + 1, F.col("w.start") + F.col("w.length") + F.col("w.reach") - low)).alias("context"))
        .where(F.size("window") > 0)
    )
    wanted = listed.select("template", "license", "m", F.col("shingles").alias("wanted"), "telling", "around")
    if exact:
        retrieved = windows.join(F.broadcast(wanted), "m")
    else:
        banded = wanted.withColumn("b", F.explode(bands_of(F.col("wanted")))).select(*wanted.columns, "b.band", "b.value")
        retrieved = windows.withColumn("b", F.explode(bound(F.col("window"), bands_of))).select("id", "m", "start", "window", "context", "b.band", "b.value").join(F.broadcast(banded), ["m", "band", "value"])
    held = retrieved.where(holds(F.col("window"), F.col("wanted"), F.col("m"), F.col("telling")))
    alone = held.where(~F.exists("around", lambda a: holds(F.col("context"), a["shingles"], a["m"], a["telling"])))
    verified = alone.withColumn("containment", F.size(F.array_intersect("window", "wanted")) / F.col("m"))
    return verified.groupBy("id", "license").agg(
        F.max("containment").alias("containment"),
        F.min_by("start", F.struct(-F.col("containment"), F.col("start"))).cast("long").alias("first_shingle"),
        F.countDistinct("template", "start").alias("n_matches"),
    ).withColumnRenamed("id", id_col)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, containment, first_shingle and n_matches of every license found in documents; see scan for nulls, ties and empty texts."""
    return scan(table(spark, sf_dir, "documents"))
