"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size.
Documents of a source stand in one fixed order; the expected copies are prefix-summed along it,
one offset per source is added, and a document is emitted once for each integer its interval
crosses. The order goes by size band first, so the sample is stratified by document length and
the words taken stay near the target.

The prefix sum never puts a source into one task. Documents are counted in cells of
(source, band, salt), cells are summed in bands and bands in sources, and a document needs only
its rank in its cell plus the cell's offset. A source with a third of all rows is thus spread
over thousands of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table

#: Cells of a band; a cell is what one window task sorts.
SALTS = 4096
#: A source's weight by its rank: 1, 2, 3, repeating.
WEIGHTS = 3
#: A target stops at this many times the source's size.
MOST_COPIES = 3
SEED = "mix"


def source_targets(sources: DataFrame) -> DataFrame:
    """(g, g_null, source_size) -> the same with `weight` and `target`.

    Targets share the sum of all sizes by weight; those above MOST_COPIES times their size stop
    there and the excess is reshared by weight. That fixed point is a water level: with sources
    in order of cap / weight, it is the first (total - caps before) / (weights left) that does
    not exceed its own cap / weight. Rows: one per source, a curated list, so ranking it in one
    task is no bottleneck. All sizes zero: all targets zero.
    """
    by_name = Window.orderBy("g_null", "g")
    by_cap = Window.orderBy("cap_ratio", "rank")
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", (F.col("rank") - 1) % WEIGHTS + 1)
        .withColumn("cap", F.col("source_size") * MOST_COPIES)
        .withColumn("cap_ratio", F.col("cap") / F.col("weight"))
    )
    levelled = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
    )
    level = F.min_by(F.when(F.col("level") <= F.col("cap_ratio"), F.col("level")), F.when(F.col("level") <= F.col("cap_ratio"), F.struct("cap_ratio", "rank"))).over(everything)
    return levelled.withColumn("target", F.least(F.col("weight") * level, F.col("cap").cast("double"))).select("g", "g_null", "source_size", "weight", "target")


def _hex(text, digits: int):
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows: bool = False) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies (and with `rows` the whole row as the struct __row).

    Null text: size 0. Null source: a source of its own, last in order. Repeated rows count each
    time; rows equal in id and text are interchangeable. Empty table: no rows. Columns other
    than those named are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    bits = F.length(F.bin("size"))
    sized = saved(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(source_col), F.lit("")).alias("g"),
            F.col(source_col).isNull().alias("g_null"),
            size.alias("size"),
            F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).alias("name"),
            F.xxhash64(text_col).alias("tie"),
            (F.struct(*docs.columns) if rows else F.lit(None).cast("boolean")).alias("__row"),
        )
        # Eight bands an octave.
        .withColumn("band", bits * 8 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 4, F.lit(0))) % 8)
        # Rows without an id are dealt out by their text.
        .withColumn("salt", _hex(F.col("name"), 3) % SALTS)
        .drop("name"),
        "mix-sizes",
    )
    source, band, cell = ["g", "g_null"], ["g", "g_null", "band"], ["g", "g_null", "band", "salt"]
    before = (Window.unboundedPreceding, -1)
    cells = sized.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    bands = cells.groupBy(*band).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    targets = source_targets(bands.groupBy(*source).agg(F.sum("s").alias("source_size")))
    bands = bands.select(*band, F.coalesce(F.sum("n").over(Window.partitionBy(*source).orderBy("band").rowsBetween(*before)), F.lit(0)).alias("band_base")).join(targets, source)
    cells = cells.select(*cell, F.coalesce(F.sum("n").over(Window.partitionBy(*band).orderBy("salt").rowsBetween(*before)), F.lit(0)).alias("cell_base")).join(bands, band)
    placed = sized.join(cells, cell).withColumn("k", F.col("band_base") + F.col("cell_base") + F.row_number().over(Window.partitionBy(*cell).orderBy("id", "size", "tie")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    offset = _hex(F.concat(F.lit(SEED), F.col("g_null").cast("string"), F.col("g")), 8) / F.lit(4294967296.0)
    counted = placed.withColumn("copies", (F.floor(rate * F.col("k") + offset) - F.floor(rate * (F.col("k") - 1) + offset)).cast("long"))
    return counted.select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies", *["__row"] * rows,
    )


def emit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: every row of docs as many times as the mix takes it, columns unchanged."""
    mixed = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, rows=True).where("copies > 0")
    return mixed.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of documents; see mix for nulls, ties and repeated rows."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
with sized as (
  select doc_id, coalesce(source, '') g, source is null g_null,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, coalesce(doc_id::varchar, text, '') as name from documents),
banded as (
  select *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) % 8 band,
    ('0x' || substr(md5(name), 1, 3))::bigint salt from sized),
sources as (select g, g_null, sum(size)::bigint source_size from sized group by all),
ranked as (select *, row_number() over (order by g_null, g) as rank from sources),
capped as (select *, (rank - 1) % 3 + 1 as weight, source_size * 3 as cap, source_size * 3 / ((rank - 1) % 3 + 1)::double as cap_ratio from ranked),
levelled as (
  select *, ((sum(source_size) over ())::bigint - coalesce(sum(cap) over (order by cap_ratio, rank rows between unbounded preceding and 1 preceding), 0)::bigint)::double
    / (sum(weight) over (order by cap_ratio, rank rows between current row and unbounded following))::double as level from capped),
picked as (select level as l from levelled where level <= cap_ratio order by cap_ratio, rank limit 1),
targets as (select g, g_null, source_size, least(weight * l, cap::double) as target from levelled, picked),
placed as (select *, row_number() over (partition by g, g_null order by band, salt, doc_id, size) as k from banded),
rated as (
  select p.*, source_size, target, case when source_size > 0 then least(target / source_size, 3.0::double) else 0 end as rate,
    ('0x' || substr(md5('mix' || p.g_null::varchar || p.g), 1, 8))::bigint / 4294967296.0::double as u
  from placed p join targets t on p.g = t.g and p.g_null = t.g_null)
select doc_id, size, source_size, target, ((floor(rate * k + u) - floor(rate * (k - 1) + u))::bigint * size)::bigint as taken from rated
"""
