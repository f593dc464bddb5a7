"""Named queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import deviations, embed, gsea, intervals, markers, matrix, motifs, neighbours, peaks, plots, qc
from ..session import materialize, stored, table, tasks_of
from ..sources import formats
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with the SQL it must agree with."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(c: str | Column, digits: int = 8) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _cells_matrix(spark: SparkSession, d: str) -> DataFrame:
    tiles = matrix.tile_matrix(fx.fragments(spark, d), fx.sizes(spark))
    return tiles.select(F.col("barcode").alias("cell"), F.concat_ws(":", "chrom", F.col("tile").cast("string")).alias("feature"), "value")


MATRIX = "x as (select barcode as cell, concat(chrom, ':', cast(tile as varchar)) as feature, value from tiles)"

# Quality control ------------------------------------------------------------------------------


@query(
    _with(fx.FRAGMENTS)
    + """select barcode, cast(count(*) as bigint) as n_unique, round((sum(n) - count(*)) / (sum(n) + 1e-9), 8) as duplicate_fraction,
       round(sum(case when chrom in ('chrM','M') then n else 0 end) / (sum(n) + 1e-9), 8) as mito_fraction
       from frag group by barcode having count(*) >= 100"""
)
def qc_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = qc.qc_metrics(fx.fragments(spark, d))
    return m.select("barcode", "n_unique", rounded("duplicate_fraction").alias("duplicate_fraction"), rounded("mito_fraction").alias("mito_fraction"))


_TSSE = (
    fx.FRAGMENTS, fx.CELLS, fx.TRANSCRIPTS,
    "tss as (select distinct chrom, case when strand = '-' then g_end - 1 else g_start - 1 end as t, strand from tx)",
    "ins as (select barcode, chrom, s as p from frag union all select barcode, chrom, e - 1 from frag)",
    "o as (select barcode, case when strand = '-' then t - p else p - t end + 2000 as o from ins join tss using (chrom) where p between t - 2000 and t + 2000)",
    """b as (select barcode, sum(case when o < 100 then 1 else 0 end) as b0, sum(case when o >= 100 and o between 1995 and 2005 then 1 else 0 end) as b1,
       sum(case when o > 3900 then 1 else 0 end) as b2 from o group by barcode)""",
    "sc as (select barcode, coalesce((b1 / 11.0) / ((b0 / 100.0 + b2 / 100.0) / 2 + 0.1), 0) as tsse from cells left join b using (barcode))",
)


@query(_with(*_TSSE) + "select barcode, round(tsse, 8) as tsse_score from sc")
def tsse(spark: SparkSession, d: str) -> DataFrame:
    frags = fx.fragments(spark, d)
    return qc.compute_metrics(frags, qc.tss_of(fx.transcripts(spark, d))).select("barcode", rounded("tsse_score").alias("tsse_score"))


@query(_with(fx.FRAGMENTS, "c as (select barcode from frag where chrom <> 'chrM' group by barcode having count(*) >= 500)") + "select chrom, s as start, e as \"end\", concat('A_', barcode) as barcode, n as count from frag where chrom <> 'chrM' and barcode in (select barcode from c)")
def filter_min_frags(spark: SparkSession, d: str) -> DataFrame:
    valid = fx.sizes(spark).filter("chrom <> 'chrM'")
    return qc.filter_fragments(fx.fragments(spark, d).select(formats.COLUMNS), min_fragments=500, prefix="A_", chrom_sizes=valid)


@query(
    _with(fx.FRAGMENTS, """m as (select barcode, count(*) as n_unique, (sum(n) - count(*)) / (sum(n) + 1e-9) as dup, sum(case when chrom = 'chrM' then n else 0 end) / (sum(n) + 1e-9) as mito
       from frag group by barcode having count(*) >= 100)""")
    + "select chrom, s as start, e as \"end\", barcode, n as count from frag where barcode in (select barcode from m where n_unique >= 500 and n_unique > 580 and (mito < 0.14 or not dup > 0.95))"
)
def filter_query(spark: SparkSession, d: str) -> DataFrame:
    frags = fx.fragments(spark, d).select(formats.COLUMNS)
    cells = materialize(qc.qc_metrics(frags))
    return qc.filter_fragments(frags, metrics=cells, query="n_unique > 580 and (mito_fraction < 0.14 or not duplicate_fraction > 0.95)", min_fragments=500)


_SWEEP = (
    "ev as (select barcode, chrom, s as p, 1 as d from frag where chrom <> 'chrM' and e - s <= 900 union all select barcode, chrom, e, -1 from frag where chrom <> 'chrM' and e - s <= 900)",
    "evs as (select barcode, chrom, p, sum(d) as d from ev group by barcode, chrom, p)",
    "cov as (select barcode, chrom, p as s, sum(d) over w as depth, lead(p) over w as e from evs window w as (partition by barcode, chrom order by p))",
    "deep as (select *, case when lag(e) over (partition by barcode, chrom order by s) = s then 0 else 1 end as fresh from cov where depth >= 3)",
    "isl as (select *, sum(fresh) over (partition by barcode, chrom order by s) as i from deep)",
    "seg as (select barcode, chrom, min(s) as s, max(e) as e, cast(arg_min(depth, s) as bigint) as min_overlap, cast(max(depth) as bigint) as max_overlap from isl group by barcode, chrom, i)",
)
_UNION = (
    "u0 as (select chrom, s, e, case when s <= max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from seg)",
    "u1 as (select *, sum(fresh) over (partition by chrom order by s, e rows unbounded preceding) as i from u0)",
    "reg as (select chrom, min(s) as s, max(e) as e from u1 group by chrom, i)",
    "inc as (select distinct r.chrom, r.s, r.e, seg.barcode from reg r join seg on r.chrom = seg.chrom and r.s <= seg.e and r.e >= seg.s)",
)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return qc.overlap_segments(fx.fragments(spark, d).filter(F.col("chrom").rlike(qc.AUTOSOME)))


@query(_with(fx.FRAGMENTS, *_SWEEP) + 'select barcode, chrom, s as start, e as "end", min_overlap, max_overlap from seg')
def doublet_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("barcode", "chrom", "start", "end", "min_overlap", "max_overlap")


@query(_with(fx.FRAGMENTS, *_SWEEP, *_UNION) + 'select chrom, s as start, e as "end" from reg')
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_intervals(_segments(spark, d).select("chrom", "start", "end"))


@query(_with(fx.FRAGMENTS, *_SWEEP, *_UNION) + 'select chrom, s as start, e as "end", barcode from inc')
def incidence(spark: SparkSession, d: str) -> DataFrame:
    seg = materialize(_segments(spark, d))
    return qc.incidence(intervals.union_intervals(seg.select("chrom", "start", "end")), seg)


_POISSON = """case when k + 1 >= m then (select list_sum(list_transform(range(1, 400), lambda j: exp(-m + (k + j) * ln(m) - lgamma(k + j + 1.0)))))
  else 1 - list_sum(list_transform(range(0, cast(k as bigint) + 1), lambda j: exp(-m + j * ln(m) - lgamma(j + 1.0)))) end"""


@query(
    _with(
        fx.FRAGMENTS, "cc as (select barcode from frag where chrom <> 'chrM' group by barcode having count(*) >= 100)", *_SWEEP, *_UNION,
        "k0 as (select cc.barcode, count(inc.barcode) as k from cc left join inc on cc.barcode = inc.barcode group by cc.barcode)",
        "k1 as (select barcode, k, avg(k) over () as m from k0)",
        f"p as (select barcode, greatest(0, least(1, {_POISSON})) as p from k1)",
        "r as (select barcode, p, count(*) over () as n, row_number() over (order by p, barcode) as rk from p)",
    )
    + "select barcode, round(p, 8) as p_value, round(least(1, min(p * n / rk) over (order by rk rows between current row and unbounded following)), 8) as q_value from r"
)
def doublet_pq(spark: SparkSession, d: str) -> DataFrame:
    """Cells by number of regions, before repeats are inferred."""
    reads = fx.fragments(spark, d).filter(F.col("chrom").rlike(qc.AUTOSOME))
    seg = materialize(qc.overlap_segments(reads))
    found = qc.incidence(intervals.union_intervals(seg.select("chrom", "start", "end")), seg).groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))
    cells = qc.passing_cells(reads).join(found, "barcode", "left").fillna(0, ["n"])
    return qc.poisson_excess(cells, "n", ("barcode",)).select("barcode", rounded("p_value").alias("p_value"), rounded("q_value").alias("q_value"))


@query(
    _with(
        fx.FRAGMENTS, *_SWEEP, *_UNION,
        "k1 as (select reg.chrom, reg.s, reg.e, count(inc.barcode) as k from reg left join inc on reg.chrom = inc.chrom and reg.s = inc.s and reg.e = inc.e group by all)",
        f"p as (select *, greatest(0, least(1, {_POISSON})) as p from (select *, avg(k) over () as m from k1))",
        "r as (select *, count(*) over () as n, row_number() over (order by p, chrom, s, e) as rk from p)",
        "q as (select *, least(1, min(p * n / rk) over (order by rk rows between current row and unbounded following)) as q from r)",
    )
    + 'select chrom, s as start, e as "end", round(p, 8) as p_value, round(q, 8) as q_value from q'
)
def repeat_inference(spark: SparkSession, d: str) -> DataFrame:
    """Regions by number of cells, from which those of repeats are inferred."""
    seg = materialize(_segments(spark, d))
    regions = intervals.union_intervals(seg.select("chrom", "start", "end"))
    found = qc.incidence(regions, seg).groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    per = regions.join(found, ["chrom", "start", "end"], "left").fillna(0, ["n"])
    return qc.poisson_excess(per, "n", ("chrom", "start", "end")).select("chrom", "start", "end", rounded("p_value").alias("p_value"), rounded("q_value").alias("q_value"))


@query(_with(fx.FRAGMENTS, "rp as (select concat('chr', cast(1 + i % 6 as varchar)) as chrom, i * 7919 % 200000 as lo, i * 7919 % 200000 + 900 as hi from (select unnest(range(0, 90)) as i))") + 'select chrom, s as start, e as "end", barcode, n as count from frag where not exists (select 1 from rp where rp.chrom = frag.chrom and s <= hi and e >= lo)')
def without_repeats(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    spans = spark.range(90).select(F.concat(F.lit("chr"), (1 + i % 6).cast("string")).alias("chrom"), (i * 7919 % 200000).alias("start"), (i * 7919 % 200000 + 900).alias("end"))
    return qc.without_repeats(fx.fragments(spark, d).select(formats.COLUMNS), spans)


def _renamed(sql: tuple[str, ...], **names: str) -> tuple[str, ...]:
    for old, new in names.items():
        sql = tuple(re.sub(rf"\b{old}\b", new, x) for x in sql)
    return sql


@query(
    _with(
        fx.FRAGMENTS.replace("frag as", "frag0 as", 1), "cc as (select barcode from frag0 where chrom <> 'chrM' group by barcode having count(*) >= 100)", "frag as (select * from frag0 where barcode in (select barcode from cc))", *_SWEEP, *_UNION,
        "rk1 as (select reg.chrom, reg.s, reg.e, count(inc.barcode) as k from reg left join inc on reg.chrom = inc.chrom and reg.s = inc.s and reg.e = inc.e group by all)",
        f"rp as (select *, greatest(0, least(1, {_POISSON})) as p from (select *, avg(k) over () as m from rk1))",
        "rr as (select *, count(*) over () as n, row_number() over (order by p, chrom, s, e) as rk from rp)",
        "rq as (select *, least(1, min(p * n / rk) over (order by rk rows between current row and unbounded following)) as q from rr)",
        "kept as (select * from seg where not exists (select 1 from rq where q < 0.01 and rq.chrom = seg.chrom and rq.s <= seg.e and rq.e >= seg.s))",
        *_renamed(_UNION, u0="v0", u1="v1", reg="regb", inc="incb", seg="kept"),
        "k0 as (select cc.barcode, count(incb.barcode) as k from cc left join incb on cc.barcode = incb.barcode group by cc.barcode)",
        "k1 as (select barcode, k, avg(k) over () as m, max(k) over () as most from k0)",
        f"p as (select barcode, most, case when most = 0 then 1 else greatest(0, least(1, {_POISSON})) end as p from k1)",
        "r as (select *, count(*) over () as n, row_number() over (order by p, barcode) as rk from p)",
        "q as (select *, case when most = 0 then 1 else least(1, min(p * n / rk) over (order by rk rows between current row and unbounded following)) end as q from r)",
    )
    + "select barcode as cell_id, round(p, 7) as p_value, round(q, 7) as q_value, q < 0.01 as is_doublet from q"
)
def detect_doublets(spark: SparkSession, d: str) -> DataFrame:
    out = qc.detect_doublets(fx.fragments(spark, d))
    return out.withColumns({"p_value": rounded("p_value", 7), "q_value": rounded("q_value", 7)})


# Matrices -------------------------------------------------------------------------------------


@query(_with(fx.FRAGMENTS, fx.CELLS, fx.TILES) + "select barcode, chrom, tile, value from tiles")
def tile_unique(spark: SparkSession, d: str) -> DataFrame:
    return matrix.tile_matrix(fx.fragments(spark, d), fx.sizes(spark))


@query(_with(fx.FRAGMENTS, fx.CELLS, fx.TILES) + "select barcode, chrom, tile, total as value from tiles")
def tile_count(spark: SparkSession, d: str) -> DataFrame:
    return matrix.tile_matrix(fx.fragments(spark, d), fx.sizes(spark), strategy="count")


@query(_with(fx.FRAGMENTS, fx.CELLS, fx.TILES) + "select barcode, chrom, tile, cast(1 as bigint) as value from tiles")
def tile_binarize(spark: SparkSession, d: str) -> DataFrame:
    return matrix.tile_matrix(fx.fragments(spark, d), fx.sizes(spark), strategy="binarize")


@query(
    _with(fx.FRAGMENTS, "c as (select chrom, max(e) as size from frag where chrom <> 'chrM' group by chrom)", "t as (select chrom, size, unnest(range(0, (size + 4999) // 5000)) as tile from c)")
    + """select chrom, tile, tile * 5000 as start, least((tile + 1) * 5000, size) as "end", concat(chrom, ':', cast(tile * 5000 as varchar), '-', cast(least((tile + 1) * 5000, size) as varchar)) as name,
           row_number() over (order by chrom, tile) - 1 as index from t"""
)
def tile_dim(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of chromosomes as long as their fragments reach."""
    return matrix.tile_dimension(fx.fragments(spark, d).groupBy("chrom").agg(F.max("end").alias("size")))


@query(_with(fx.FRAGMENTS, fx.CELLS, fx.TILES, "w as (select barcode, chrom, value, unnest(range((tile * 5000) // 12000, (least((tile + 1) * 5000, 201000) - 1) // 12000 + 1)) as t from tiles)") + "select barcode as cell, chrom, t as tile, cast(sum(value) as bigint) as value from w group by barcode, chrom, t")
def retile(spark: SparkSession, d: str) -> DataFrame:
    tiles = matrix.tile_matrix(fx.fragments(spark, d), fx.sizes(spark))
    named = tiles.join(F.broadcast(matrix.tile_dimension(fx.sizes(spark)).select("chrom", "tile", "name")), ["chrom", "tile"])
    return matrix.retile(named.select(F.col("barcode").alias("cell"), F.col("name").alias("feature"), "value"), 12000)


_DOMAINS = """dom as (select chrom, greatest(case when strand = '+' then g_start - 1 - 2000 else g_start - 1 end, 0) as lo,
  case when strand = '+' then g_end - 1 else g_end - 1 + 2000 end as hi, gene_id as id, min(transcript_id) as transcript_id from tx group by all)"""


@query(_with(fx.TRANSCRIPTS, _DOMAINS) + 'select chrom, lo as start, hi as "end", id, transcript_id from dom')
def gene_domains(spark: SparkSession, d: str) -> DataFrame:
    return matrix.gene_domains(fx.transcripts(spark, d))


_GENE = _with(
    fx.FRAGMENTS, fx.TRANSCRIPTS, _DOMAINS,
    "known as (select * from frag where chrom in (select chrom from dom))",
    "cells as (select barcode from known group by barcode having count(*) >= 100)",
    "per as (select barcode, dom.id, dom.lo, dom.hi, known.chrom, count(*) as k from known join dom on known.chrom = dom.chrom and ((s >= lo and s < hi) or (e - 1 >= lo and e - 1 < hi)) where barcode in (select barcode from cells) group by all)",
)


@query(_GENE + "select barcode, id, cast(max(k) as bigint) as value from per group by barcode, id")
def gene_matrix_gene(spark: SparkSession, d: str) -> DataFrame:
    return matrix.gene_matrix(fx.fragments(spark, d), matrix.gene_domains(fx.transcripts(spark, d)))


@query(_GENE.replace("gene_id as id,", "transcript_id as id,").replace(", min(transcript_id) as transcript_id", ", 1 as one") + "select barcode, id, cast(max(k) as bigint) as value from per group by barcode, id")
def gene_matrix_transcript(spark: SparkSession, d: str) -> DataFrame:
    tx = fx.transcripts(spark, d).withColumn("gene_id", F.col("transcript_id"))
    return matrix.gene_matrix(fx.fragments(spark, d), matrix.gene_domains(tx))


_SCORE = _with(
    fx.FRAGMENTS, fx.CELLS, fx.TRANSCRIPTS,
    "gene as (select gene_id as symbol, chrom, strand, min(g_start) as lo, max(g_end) as hi from tx group by all)",
    """g1 as (select *, case when strand = '-' then hi else lo end as tss, greatest(case when strand = '-' then lo else lo - 5000 end, 1) as g_lo,
       case when strand = '-' then hi + 5000 else hi end as g_hi, 1.0::double / (hi - lo + 1) as m from gene)""",
    "g2 as (select *, case when max(m) over () > min(m) over () then 1 + m * 4.0 / (max(m) over () - min(m) over ()) else 1 end as w from g1)",
    """g3 as (select *, greatest(1, least(greatest(coalesce(lag(g_hi) over o + 500, 1), g_lo - 100000), g_lo - 1000)) as s_lo,
       greatest(least(coalesce(lead(g_lo) over o - 500, 1099511627776), g_hi + 100000), g_hi + 1000) as s_hi from g2 window o as (partition by chrom order by g_lo, symbol))""",
    "ends as (select barcode, chrom, s as p from frag where barcode in (select barcode from cells) union all select barcode, chrom, e from frag where barcode in (select barcode from cells))",
    "cnt as (select barcode, chrom, p // 500 * 500 as t, least(count(*), 4) as n from ends group by all)",
    """wt as (select cnt.barcode, symbol, cnt.n * w * (exp(-abs(greatest(g_lo - (t + 499) - 1, t - g_hi - 1, 0)) / 5000.0) + exp(-1)) as v
       from cnt join g3 on cnt.chrom = g3.chrom and t >= s_lo - 499 and t <= s_hi)""",
    "raw as (select barcode, symbol, sum(v) as v from wt group by all)",
)


@query(_SCORE + "select barcode, symbol, round(v * 10000 / sum(v) over (partition by barcode), 3) as value from raw where v > 0 qualify round(v * 10000 / sum(v) over (partition by barcode), 3) <> 0")
def gene_score(spark: SparkSession, d: str) -> DataFrame:
    frags = fx.fragments(spark, d)
    return matrix.gene_scores(frags, matrix.gene_score_domains(fx.genes(spark, d)), cells=qc.passing_cells(frags))


@query(
    _with(fx.FRAGMENTS, fx.CELLS, fx.TILES, MATRIX, "c as (select feature, cast(sum(value) as bigint) as k from x group by feature)",
          "r as (select feature, k, row_number() over (order by k, feature desc) as rk, count(*) over () as n from c where k > 0)")
    + "select feature, k as accessibility_count, rk > greatest(floor(0.05 * n), n - floor(0.02 * n) - 100) and rk <= n - floor(0.02 * n) as selected from r"
)
def feature_select_count(spark: SparkSession, d: str) -> DataFrame:
    return matrix.select_features(_cells_matrix(spark, d), 100, 0.05, 0.02)


@query(_with(fx.FRAGMENTS, fx.CELLS, fx.TILES, MATRIX, "c as (select feature, count(*) as k from x group by feature)") + "select feature, k as accessibility_count, row_number() over (order by k desc, feature) <= 50 as selected from c")
def feature_select_binary(spark: SparkSession, d: str) -> DataFrame:
    x = _cells_matrix(spark, d).withColumn("value", F.lit(1).cast("long"))
    return matrix.select_features(x, 50, binary=True)


@query(_with(fx.FRAGMENTS, fx.CELLS, fx.TILES, MATRIX) + "select concat(cell, '@', cast(i as varchar)) as cell, feature, value, concat('part', cast(i as varchar)) as source_file from x, (values (0), (1)) v(i)")
def combine(spark: SparkSession, d: str) -> DataFrame:
    x = materialize(_cells_matrix(spark, d))
    return matrix.combine({f"part{i}": x.withColumn("cell", F.concat("cell", F.lit(f"@{i}"))) for i in range(2)})


@query(
    _with(fx.FRAGMENTS, fx.CELLS, fx.TILES, MATRIX, "c as (select feature, 2 * sum(value) as k from x group by feature)",
          "r as (select feature, row_number() over (order by k, feature desc) as rk, count(*) over () as n from c)",
          "s as (select feature from r where rk > greatest(floor(0.05 * n), n - floor(0.02 * n) - 100) and rk <= n - floor(0.02 * n))")
    + "select case when i > 0 then concat(cell, '-1') else cell end as cell, feature, cast(1 as bigint) as value from x, (values (0), (1)) v(i) where feature in (select feature from s)"
)
def feature_select_multi(spark: SparkSession, d: str) -> DataFrame:
    x = materialize(_cells_matrix(spark, d))
    return matrix.select_features_multi([x, x], 100, 0.05, 0.02)


# Peaks ----------------------------------------------------------------------------------------

_PILE = (
    "ends as (select g, chrom, s as p from frag where chrom <> 'chrM' union all select g, chrom, e from frag where chrom <> 'chrM')",
    "top as (select g, chrom, max(e) - 1 as last from frag where chrom <> 'chrM' group by g, chrom)",
    """pe as (select g, chrom, greatest(0, least(p + o, last)) as p, t, c from ends join top using (g, chrom), (values (-100, 1, 0), (100, -1, 0), (-5000, 0, 1), (5000, 0, -1)) v(o, t, c))""",
    "pat as (select g, chrom, p, sum(t) as t, sum(c) as c from pe group by g, chrom, p)",
    "prun as (select g, chrom, p as s, sum(t) over w as treat, sum(c) over w as ctrl, lead(p) over w as e from pat window w as (partition by g, chrom order by p))",
    "runs as (select g, chrom, s, e, cast(treat as bigint) as treat, cast(ctrl as bigint) as ctrl from prun where e is not null)",
    "reads as (select g, count(*) as reads from frag where chrom <> 'chrM' group by g)",
    "rated as (select runs.*, greatest(ctrl * (200 / 10000.0::double), 2.0::double * 200 * reads / 1206000.0::double) as lam from runs join reads using (g))",
    f"pv as (select k, m, -log10(greatest({_POISSON}, 1e-300)) as p_score from (select distinct treat as k, lam as m from rated))",
    "scored as (select rated.*, p_score from rated join pv on treat = k and lam = m)",
)


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return fx.peak_fragments(spark, d).filter("chrom <> 'chrM'")


@query(_with(*fx.PEAK_FRAGMENTS, *_PILE) + 'select cast(g as int) as "group", chrom, s as start, e as "end", treat, ctrl from runs')
def peak_pileup(spark: SparkSession, d: str) -> DataFrame:
    return peaks.pileup(_grouped(spark, d))


_QTAB = (
    "byp as (select g, round(p_score, 6) as p, sum(e - s) as bases from scored group by all)",
    "qt as (select g, p, p + log10(1.0 + coalesce(sum(bases) over (partition by g order by p desc rows between unbounded preceding and 1 preceding), 0)) - log10(cast(sum(bases) over (partition by g) as double)) as raw from byp)",
)


@query(_with(*fx.PEAK_FRAGMENTS, *_PILE, *_QTAB) + 'select cast(g as int) as "group", p as p_score, round(greatest(0, min(raw) over (partition by g order by p desc)), 5) as q_score from qt')
def peak_pq(spark: SparkSession, d: str) -> DataFrame:
    frags = _grouped(spark, d)
    scored = peaks.score_runs(peaks.pileup(frags), frags, fx.GENOME).withColumn("p_score", F.round("p_score", 6))
    return peaks.q_table(scored).select("group", "p_score", F.round("q_score", 5).alias("q_score"))


@query(
    _with(
        *fx.PEAK_FRAGMENTS, *_PILE, *_QTAB, "q as (select g, p, greatest(0, min(raw) over (partition by g order by p desc)) as q_score from qt)",
        "good as (select scored.g, chrom, s, e from scored join q on scored.g = q.g and round(p_score, 6) = q.p where q_score >= -log10(0.05))",
        "fl as (select *, case when s - (lag(e) over w - 1) < 30 then 0 else 1 end as fresh from good window w as (partition by g, chrom order by s))",
        "isl2 as (select *, sum(fresh) over (partition by g, chrom order by s) as i from fl)",
    )
    + 'select cast(g as int) as "group", chrom, min(s) as start, max(e) - 1 as "end" from isl2 group by g, chrom, i having max(e) - 1 - min(s) >= 99'
)
def peak_islands(spark: SparkSession, d: str) -> DataFrame:
    frags = _grouped(spark, d)
    scored = stored(peaks.score_runs(peaks.pileup(frags), frags, fx.GENOME).withColumn("p_score", F.round("p_score", 6)))
    scored = scored.join(peaks.q_table(scored), ["group", "p_score"])
    return peaks.islands(scored, 0.05, 30, 100).select("group", "chrom", F.col("i_start").alias("start"), F.col("i_end").alias("end")).distinct()


def _called(spark: SparkSession, d: str) -> DataFrame:
    return peaks.call_peaks(_grouped(spark, d), fx.GENOME, q_thresh=0.05, peak_amp=100)


_CALLED = (
    *fx.PEAK_FRAGMENTS, *_PILE,
    "byp as (select g, p_score as p, sum(e - s) as bases from scored group by all)",
    "qt as (select g, p, p + log10(1.0 + coalesce(sum(bases) over (partition by g order by p desc rows between unbounded preceding and 1 preceding), 0)) - log10(cast(sum(bases) over (partition by g) as double)) as raw from byp)",
    "q as (select g, p, greatest(0, min(raw) over (partition by g order by p desc)) as q_score from qt)",
    "good as (select scored.*, q_score from scored join q on scored.g = q.g and p_score = q.p where q_score >= -log10(0.05))",
    "fl as (select *, case when s - (lag(e) over w - 1) < 30 then 0 else 1 end as fresh from good window w as (partition by g, chrom order by s))",
    "isl2 as (select *, sum(fresh) over (partition by g, chrom order by s) as i from fl)",
    "best as (select *, min(s) over own as lo, max(e) over own - 1 as hi, row_number() over (partition by g, chrom, i order by p_score desc, s) as r from isl2 window own as (partition by g, chrom, i))",
    "peak as (select *, (treat + 1.0::double) / (lam + 1) as signal from best where r = 1 and hi - lo >= 99)",
)


@query(
    _with(*_CALLED)
    + """select cast(g as int) as "group", chrom, lo as start, hi as "end", concat(cast(g as varchar), '_', chrom, '_', cast(lo as varchar)) as name, cast(least(floor(q_score * 10), 1000) as int) as score,
       '.' as strand, round(signal, 6) as signal_value, round(p_score, 4) as p_value, round(q_score, 4) as q_value, s - lo as peak from peak where signal >= 1"""
)
def call_peaks(spark: SparkSession, d: str) -> DataFrame:
    called = _called(spark, d)
    return called.withColumns({"signal_value": F.round("signal_value", 6), "p_value": F.round("p_value", 4), "q_value": F.round("q_value", 4)})


# In each round the windows without a better one among those they overlap are kept, and what overlaps them goes.
_MERGED = (
    _with(
        *_CALLED, "wide as (select chrom, greatest(s - 250, 0) as a, least(s + 251, 201000) as b, max(p_score) as p from peak where signal >= 1 group by all)",
        "wd as (select *, row_number() over (order by p desc, a, b) as r from wide)",
        """rounds as (
          select chrom, a, b, p, r, false as kept from wd
          union all
          (with u as (
             select x.chrom, x.a, x.b, x.p, x.r, min(y.r) as least from rounds x join rounds y on x.chrom = y.chrom and x.a < y.b and y.a < x.b
             where not x.kept and not y.kept group by x.chrom, x.a, x.b, x.p, x.r)
           select u.chrom, u.a, u.b, u.p, u.r, u.least = u.r as kept
           from u join u v on u.chrom = v.chrom and u.a < v.b and v.a < u.b
           group by u.chrom, u.a, u.b, u.p, u.r, u.least having u.least = u.r or not bool_or(v.least = v.r)))""",
    ).replace("with ", "with recursive ", 1)
    + 'select chrom, a as start, b as "end", round(p, 4) as p_value from rounds where kept'
)


@query(_MERGED)
def merge_peaks(spark: SparkSession, d: str) -> DataFrame:
    return peaks.merge_peaks(_called(spark, d), fx.sizes(spark)).withColumn("p_value", F.round("p_value", 4))


_PEAKS = "pk as (select concat('chr', cast(1 + i % 6 as varchar)) as chrom, i * 997 % 200000 as lo, i * 997 % 200000 + 501 as hi from (select unnest(range(0, 120)) as i))"


def _fixed_peaks(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(120).select(F.concat(F.lit("chr"), (1 + i % 6).cast("string")).alias("chrom"), (i * 997 % 200000).alias("start"), (i * 997 % 200000 + 501).alias("end"))


def _peak_sql(on: str, frag: str = "frag") -> str:
    return _with(fx.FRAGMENTS, _PEAKS, f"r as (select barcode, chrom, s, e from {frag})") + f'select barcode, r.chrom, lo as start, hi as "end", count(*) as value from r join pk on r.chrom = pk.chrom and ({on}) group by all'


@query(_peak_sql("(s >= lo and s < hi) or (e - 1 >= lo and e - 1 < hi)"))
def peak_matrix_paired(spark: SparkSession, d: str) -> DataFrame:
    return peaks.peak_matrix(fx.fragments(spark, d), _fixed_peaks(spark))


@query(_peak_sql("s >= lo and s < hi", "(select barcode, chrom, s, e from frag union all select barcode, chrom, e - 1, e from frag)"))
def peak_matrix_insertion(spark: SparkSession, d: str) -> DataFrame:
    return peaks.peak_matrix(fx.fragments(spark, d), _fixed_peaks(spark), "insertion")


@query(_peak_sql("s < hi and e > lo"))
def peak_matrix_fragment(spark: SparkSession, d: str) -> DataFrame:
    return peaks.peak_matrix(fx.fragments(spark, d), _fixed_peaks(spark), "fragment")


# Markers --------------------------------------------------------------------------------------

_BINOM = "least(1, list_sum(list_transform(range(greatest(k, 1), n + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(p) + (n - j) * ln(1 - p)))))"
_MARK = _with(
    fx.FRAGMENTS, fx.CELLS, fx.TILES, MATRIX,
    "cg as (select distinct barcode as cell, case when g = 1 then 'fg' else 'bg' end as side from frag where barcode in (select barcode from cells))",
    "ranked as (select *, row_number() over (partition by side order by md5(concat(cell, ':42')), cell) as k from cg)",
    "size as (select least(min(c), 500) as n, count(*) as sides from (select side, count(*) as c from cg group by side))",
    "smp as (select cell, side from ranked, size where k <= n and sides = 2)",
    "cnt as (select feature, count(*) filter (side = 'fg') as fg, count(*) filter (side = 'bg') as bg from x join smp using (cell) group by feature)",
    "nn as (select count(*) filter (side = 'fg') as n_fg, count(*) filter (side = 'bg') as n_bg from smp)",
    "f as (select feature, coalesce(fg, 0) as fg, coalesce(bg, 0) as bg, n_fg, n_bg from (select distinct feature from x) left join cnt using (feature), nn)",
    "s as (select *, case when fg / n_fg >= bg / n_bg then fg else bg end as k, case when fg / n_fg >= bg / n_bg then n_fg else n_bg end as n, case when fg / n_fg >= bg / n_bg then greatest(bg, 1) / n_bg else greatest(fg, 1) / n_fg end as p from f)",
    f"t as (select *, log2((fg + 1) / (bg + 1)) as lfc, greatest(1e-300, least(1, 2 * case when k <= 0 then 1 when p >= 1 then 1 else {_BINOM} end)) as pv from s)",
    "r as (select *, count(*) over () as m, row_number() over (order by pv, feature) as rk from t)",
    "res as (select feature, fg, bg, lfc, pv, least(1, min(pv * m / rk) over (order by rk rows between current row and unbounded following)) as fdr from r)",
)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.fragments(spark, d).select(F.col("barcode").alias("cell"), F.col("group").cast("string").alias("group")).distinct()
    x = materialize(_cells_matrix(spark, d))
    return markers.marker_test(x, cells.join(x.select("cell").distinct(), "cell", "left_semi"), "1")


@query(_MARK + "select feature, fg, bg, round(lfc, 8) as log2_fc, round(pv, 8) as p_value, round(fdr, 8) as fdr from res")
def marker_test(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("feature", F.col("fg").cast("long").alias("fg"), F.col("bg").cast("long").alias("bg"), rounded("log2_fc").alias("log2_fc"), rounded("p_value").alias("p_value"), rounded("fdr").alias("fdr"))


@query(_MARK + "select feature, fg, bg, round(lfc, 8) as log2_fc, round(fdr, 8) as fdr from res, nn where (fg / n_fg >= 0.3 or bg / n_bg >= 0.3) and abs(lfc) >= 0.2")
def marker_peaks(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.fragments(spark, d).select(F.col("barcode").alias("cell"), F.col("group").cast("string").alias("group")).distinct()
    x = materialize(_cells_matrix(spark, d))
    out = markers.marker_peaks(x, cells.join(x.select("cell").distinct(), "cell", "left_semi"), ["1"], min_pct=0.3, min_log2_fc=0.2)
    return out.select("feature", F.col("fg").cast("long").alias("fg"), F.col("bg").cast("long").alias("bg"), rounded("log2_fc").alias("log2_fc"), rounded("fdr").alias("fdr"))


@query(_MARK + "select feature, round(lfc, 8) as log2_fc, row_number() over (order by round(fdr, 8), round(abs(lfc), 8) desc, feature) as rank from res where lfc > 0.1 and fdr < 1 - 1e-9 qualify rank <= 10")
def marker_top(spark: SparkSession, d: str) -> DataFrame:
    r = _marked(spark, d).withColumn("fdr", rounded("fdr")).withColumn("log2_fc", rounded("log2_fc"))
    return markers.top_markers(r, fdr=1 - 1e-9, log2_fc=0.1, n=10).select("feature", "log2_fc", F.col("rank").cast("long").alias("rank"))


# Sequences and motifs -------------------------------------------------------------------------


@query(_with(fx.DNA) + "select doc_id as region, round(case when length(seq) > 0 then length(regexp_replace(upper(seq), '[^GC]', '', 'g')) / length(seq) else 0 end, 8) as gc from dna")
def gc_content(spark: SparkSession, d: str) -> DataFrame:
    return fx.sequences(spark, d).select("region", rounded(motifs.gc_content(F.col("seq"))).alias("gc"))


@query(_with(fx.DNA) + "select doc_id as region, round(case when length(seq) > 0 then (length(seq) - length(replace(upper(seq), 'CG', ''))) / 2 / length(seq) else 0 end, 8) as cpg from dna")
def cpg(spark: SparkSession, d: str) -> DataFrame:
    return fx.sequences(spark, d).select("region", rounded(motifs.cpg_density(F.col("seq"))).alias("cpg"))


@query(_with(fx.DNA, "n as (select b, sum(length(seq) - length(replace(seq, b, ''))) as k from dna, (values ('A'), ('C'), ('G'), ('T')) v(b) group by b)") + "select round(max(case when b = 'A' then k end) / sum(k), 8) as a, round(max(case when b = 'C' then k end) / sum(k), 8) as c, round(max(case when b = 'G' then k end) / sum(k), 8) as g, round(max(case when b = 'T' then k end) / sum(k), 8) as t from n")
def nucleotide_background(spark: SparkSession, d: str) -> DataFrame:
    return motifs.base_frequencies(fx.sequences(spark, d)).select(*[rounded(b).alias(b) for b in "acgt"])


_BIAS = "b as (select vec_id as feature, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings)"


def _bias(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("feature"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(
    _with(_BIAS, "c as (select var_samp(x) as a, covar_samp(x, y) as b, var_samp(y) as d from b)", "l as (select sqrt(a) as l11, b / sqrt(a) as l21, sqrt(d - b * b / a) as l22 from c)")
    + "select feature, round(x / l11, 6) as w0, round((y - l21 * x / l11) / l22, 6) as w1 from b, l"
)
def bias_whiten(spark: SparkSession, d: str) -> DataFrame:
    return motifs.whiten(_bias(spark, d), ("x", "y")).select("feature", rounded("w0", 6).alias("w0"), rounded("w1", 6).alias("w1"))


@query(
    _with(
        "b as (select vec_id as feature, list_transform(embedding, lambda x: x::double) as e from embeddings)",
        "p as (select q.feature as query, b.feature, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - b.e[i]) ** 2))) as dist from b q, b where q.feature % 20 = 0 and q.feature <> b.feature)",
        "r as (select *, row_number() over (partition by query order by dist, feature) as rank from p)",
    )
    + "select query, feature, round(dist, 8) as distance, rank from r where rank <= 10"
)
def bias_knn(spark: SparkSession, d: str) -> DataFrame:
    """All 64 dimensions: every cell is within reach."""
    names = [f"d{i}" for i in range(64)]
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("feature"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    return neighbours.nearest(b, b.filter("feature % 20 = 0"), tuple(names), 10).select("query", "feature", rounded("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(
    _with(_BIAS, "p as (select q.feature as query, b.feature, sqrt((q.x - b.x) ** 2 + (q.y - b.y) ** 2) as dist from b q, b where q.feature % 20 = 0 and q.feature <> b.feature)", "r as (select *, row_number() over (partition by query order by dist, feature) as rank from p)")
    + "select query, feature, round(dist, 8) as distance, rank from r where rank <= 10"
)
def bias_knn_plane(spark: SparkSession, d: str) -> DataFrame:
    b = _bias(spark, d)
    return neighbours.nearest(b, b.filter("feature % 20 = 0"), ("x", "y"), 10).select("query", "feature", rounded("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


_KMERS = [("m1", "GATTACA"), ("m2", "CACGTG"), ("m3", "TGACGT"), ("m4", "AAAGCTTT"), ("m5", "GGATGC")]
_HITS = f"""km as (select * from (values {", ".join(f"('{m}', '{k}')" for m, k in _KMERS)}) v(motif, kmer)),
hits as (select distinct doc_id as region, motif from dna, km where contains(upper(seq), kmer) or contains(reverse(translate(upper(seq), 'ACGT', 'TGCA')), kmer))"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return motifs.kmer_hits(fx.sequences(spark, d), spark.createDataFrame(_KMERS, "motif string, kmer string"))


@query(_with(fx.DNA, _HITS) + "select region, motif from hits")
def kmer_scan(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query(_with(fx.DNA, _HITS) + "select region, motif from hits")
def pwm_scan(spark: SparkSession, d: str) -> DataFrame:
    """Matrices of one letter per position at a threshold that only the k-mer reaches."""
    import numpy as np

    models = [motifs.Motif(m, np.eye(4)[[motifs.BASES.index(b) for b in k]]) for m, k in _KMERS]
    return motifs.scan_motifs(fx.sequences(spark, d), models, p_value=4.0**-6 * 1.01, background="even")


_ENRICH = (
    "tg as (select cast(doc_id % 4 as bigint) as g, doc_id as region from dna)", "al as (select count(*) as n_all from dna)", "hm as (select motif, count(*) as n_hit from hits group by motif)",
    "sz as (select g, count(*) as n_draw from tg group by g)", "kk as (select g, motif, count(*) as k from tg join hits using (region) group by g, motif)",
    "gr as (select sz.g, hm.motif, n_draw, n_hit, n_all, coalesce(k, 0) as k from sz cross join hm cross join al left join kk on sz.g = kk.g and hm.motif = kk.motif)",
    "fc as (select *, case when k = 0 then -1e9 else log2((k / n_draw) / (n_hit / n_all)) end as lfc from gr)",
)
_ENRICHED = (
    "rk as (select *, row_number() over (partition by g order by p, motif) as r, count(*) over (partition by g) as m from ps)",
    'fin as (select g as "group", motif, k, n_hit, lfc, p, least(1, min(p * m / r) over (partition by g order by r rows between current row and unbounded following)) as q from rk)',
)


def _enrichment_sql(tail: str, low: str, high: str) -> str:
    """Upper tails of enriched motifs and lower ones of depleted ones; ``tail`` is the log of a chance at j."""
    ps = f"ps as (select *, least(1, list_sum(list_transform(case when lfc >= 0 then range(k, {high} + 1) else range({low}, k + 1) end, lambda j: exp({tail})))) as p from fc)"
    said = 'select "group", motif, k, n_hit, case when k = 0 then null else round(lfc, 8) end as log2_fc, round(p, 6) as p_value, round(q, 6) as fdr from fin'
    return _with(fx.DNA, _HITS, *_ENRICH, ps, *_ENRICHED) + said


_CHOOSE = "lgamma({a} + 1.0) - lgamma({b} + 1.0) - lgamma({a} - {b} + 1.0)"
_HYPER = " + ".join([_CHOOSE.format(a="n_hit", b="j"), _CHOOSE.format(a="(n_all - n_hit)", b="(n_draw - j)")]) + " - (" + _CHOOSE.format(a="n_all", b="n_draw") + ")"
_SHARE = "greatest(1e-10, least(1 - 1e-10, n_hit / n_all))"


def _enriched(spark: SparkSession, d: str, method: str) -> DataFrame:
    regions = fx.sequences(spark, d).select("region")
    out = motifs.motif_enrichment(materialize(_hits(spark, d)), regions.withColumn("group", F.col("region") % 4), regions, method)
    fold = F.when(F.col("k") > 0, F.round("log2_fc", 8))
    return out.select("group", "motif", "k", "n_hit", fold.alias("log2_fc"), F.round("p_value", 6).alias("p_value"), F.round("fdr", 6).alias("fdr"))


@query(_enrichment_sql(_HYPER, "greatest(0, n_draw + n_hit - n_all)", "least(n_hit, n_draw)"))
def motif_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d, "hypergeometric")


@query(_enrichment_sql(f"{_CHOOSE.format(a='n_draw', b='j')} + j * ln({_SHARE}) + (n_draw - j) * ln(1 - {_SHARE})", "0", "n_draw"))
def motif_enrichment_binomial(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d, "binomial")


@query()
def matched_background(spark: SparkSession, d: str) -> DataFrame:
    seqs = fx.sequences(spark, d)
    return motifs.matched_background(seqs.filter("lang = 'fr'"), seqs, 300)


@query()
def background_bins(spark: SparkSession, d: str) -> DataFrame:
    return motifs.background_bins(motifs.whiten(_bias(spark, d), ("x", "y")))


@query(
    _with(_BIAS, "c as (select var_samp(x) as a, covar_samp(x, y) as b, var_samp(y) as d from b)", "l as (select sqrt(a) as l11, b / sqrt(a) as l21, sqrt(d - b * b / a) as l22 from c)",
          "w as (select feature, x / l11 as w0, (y - l21 * x / l11) / l22 as w1 from b, l)",
          "p as (select q.feature, o.feature as background, row_number() over (partition by q.feature order by sqrt((q.w0 - o.w0) ** 2 + (q.w1 - o.w1) ** 2), o.feature) as r from w q, w o where q.feature <> o.feature)")
    + "select feature, cast(r - 1 as int) as iteration, background from p where r <= 5"
)
def background_knn(spark: SparkSession, d: str) -> DataFrame:
    return motifs.sample_background(_bias(spark, d), columns=("x", "y"), n_iterations=5).select("feature", F.col("iteration").cast("int").alias("iteration"), "background")


# Deviations, sets and embeddings --------------------------------------------------------------

_MOTIF_FEATURES = "mf as (select distinct concat('m', cast(ascii(right(feature, 1)) % 3 as varchar)) as motif, feature from x)"
_BACKGROUND = "bgp as (select feature, i as iteration, first_value(feature) over (order by feature) as f0, lead(feature, i + 1, 'chr1:0') over (partition by i order by feature) as background from (select distinct feature from x), (values (0), (1), (2)) v(i))"


def _motif_features(x: DataFrame) -> DataFrame:
    return x.select(F.concat(F.lit("m"), (F.ascii(F.right("feature", F.lit(1))) % 3).cast("string")).alias("motif"), "feature").distinct()


@query(
    _with(
        fx.FRAGMENTS, fx.CELLS, fx.TILES, MATRIX, _MOTIF_FEATURES, _BACKGROUND,
        "sh as (select feature, sum(value) / (select sum(value) from x) as share from x group by feature)", "dp as (select cell, sum(value) as depth from x group by cell)",
        "st as (select motif, -1 as iteration, feature from mf union all select motif, iteration, background from mf join bgp using (feature))",
        "ex as (select motif, iteration, sum(share) as share from st join sh using (feature) group by all)", "ob as (select cell, motif, iteration, sum(value) as obs from st join x using (feature) group by all)",
        "dv as (select dp.cell, ex.motif, ex.iteration, (coalesce(obs, 0) - depth * share) / (depth * share) as dev from dp cross join ex left join ob on dp.cell = ob.cell and ex.motif = ob.motif and ex.iteration = ob.iteration)",
        "ag as (select cell, motif, max(dev) filter (iteration = -1) as deviation, avg(dev) filter (iteration >= 0) as mu, stddev_pop(dev) filter (iteration >= 0) as sd from dv group by cell, motif)",
    )
    + "select cell, motif, round(deviation, 6) as deviation, round(case when sd > 1e-12 then (deviation - mu) / sd else 0 end, 4) as z from ag"
)
def deviations_z(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    x = materialize(_cells_matrix(spark, d))
    names = x.select("feature").distinct().withColumn("iteration", F.explode(F.array(*map(F.lit, range(3)))))
    w = Window.partitionBy("iteration").orderBy("feature")
    background = names.withColumn("background", F.coalesce(*[F.when(F.col("iteration") == i, F.lead("feature", i + 1, "chr1:0").over(w)) for i in range(3)]))
    out = deviations.compute_deviations(x, _motif_features(x), background)
    return out.select("cell", "motif", F.round("deviation", 6).alias("deviation"), F.round("z", 4).alias("z"))


def _chromvar(spark: SparkSession, d: str) -> DataFrame:
    """Documents as features, their letters as sequences, counts from their words."""
    import numpy as np

    seqs = fx.sequences(spark, d).select("region", "seq")
    x = table(spark, d, "documents").select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cell"), F.col("doc_id").alias("feature"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    x = x.select("cell", "feature", ((F.col("n") + F.col("cell") * F.col("feature")) % 7 + 1).alias("value"))
    models = [motifs.Motif(m, np.eye(4)[[motifs.BASES.index(b) for b in k]]) for m, k in _KMERS[:3]]
    return deviations.chromvar(stored(x), seqs, models, p_value=4.0**-6 * 1.01, base="even")


@query()
def chromvar(spark: SparkSession, d: str) -> DataFrame:
    return _chromvar(spark, d)


@query(
    _with(
        fx.DNA, _HITS, "x as (select c as cell, doc_id as feature, (coalesce(n_chars, 0) + c * doc_id) % 7 + 1 as value from documents, (select unnest(range(10)) as c))",
        "sh as (select feature, sum(value) / (select sum(value) from x) as share from x group by feature)", "dp as (select cell, sum(value) as depth from x group by cell)",
        "ob as (select cell, motif, sum(value) as n, sum(share) as share from x join hits on feature = region join sh using (feature) where motif in ('m1', 'm2', 'm3') group by cell, motif)",
    )
    + "select cell, motif, round(n / (depth * share) - 1, 6) as deviation from ob join dp using (cell)"
)
def chromvar_deviations(spark: SparkSession, d: str) -> DataFrame:
    """Deviations without their scores, which depend on drawn backgrounds."""
    return _chromvar(spark, d).select("cell", "motif", F.round("deviation", 6).alias("deviation"))


@query(
    """with rk as (select p_partkey as feature, abs(p_retailprice - 1400.0) as r, row_number() over (order by p_retailprice - 1400.0 desc, p_partkey) as rank, count(*) over () as n from part),
    h as (select p_brand as term, rank, r, n from rk join part on feature = p_partkey),
    q as (select *, count(*) over (partition by term) as size, row_number() over w as k, sum(r) over (partition by term order by rank rows unbounded preceding) as up, sum(r) over (partition by term) as tot from h window w as (partition by term order by rank)),
    v as (select term, size, up / tot - (rank - k) / (n - size) as high, (up - r) / tot - (rank - k) / (n - size) as low from q),
    m as (select term, max(size) as size, max(high) as high, least(min(low), 0) as low from v group by term)
    select term, size, round(case when high > -low then high else low end, 8) as es from m"""
)
def gsea_es(spark: SparkSession, d: str) -> DataFrame:
    out = gsea.enrichment_scores(fx.ranking(spark, d), fx.term_sets(spark, d))
    return out.select("term", "size", rounded("es").alias("es"))


@query(
    _with(fx.DNA, "r as (select doc_id, seq, doc_id % 50 as a, doc_id % 50 + 10 + doc_id % 90 as b from dna)")
    + "select concat('s', cast(doc_id as varchar)) as chrom, a as start, b as \"end\", substr(seq, a + 1, b - a) as seq from r"
)
def fetch_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Regions of sequences that were written as a block-gzip FASTA file of lines of 60 letters."""
    import uuid

    from ..session import shared_dir
    from ..sources import blockgzip

    path = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    dna = fx.sequences(spark, d).select(F.concat(F.lit("s"), F.col("region").cast("string")).alias("chrom"), "seq", "region")
    lines = F.concat(F.array(F.concat(F.lit(">"), F.col("chrom"))), F.filter(F.split(F.regexp_replace("seq", "(.{60})", "$1\n"), "\n"), lambda x: x != ""))
    blockgzip.write_lines(dna.select(F.explode(lines).alias("value")), path, suffix=".fa.gz")
    k = F.col("region")
    regions = dna.select("chrom", (k % 50).alias("start"), (k % 50 + 10 + k % 90).alias("end"))
    return formats.fetch_sequences(regions, formats.fasta_chunks(spark, path, split_bytes=1 << 16))


_PRIME = gsea.PRIME
_PRERANK = """with rk as (select p_partkey as feature, abs(p_retailprice - 1400.0) as r, row_number() over (order by p_retailprice - 1400.0 desc, p_partkey) - 1 as place, count(*) over () as n from part),
    hits as (select p_brand as term, rk.* from rk join part on feature = p_partkey),
    own as (select term as id, r, place, n, row_number() over w as k, count(*) over (partition by term) as size from hits window w as (partition by term order by place)),
    m1 as (select place, r, n, t, (place * 1103515245 + t * 69621 + 12345) % {p} as x from rk, (select unnest(range(1000)) as t)),
    m2 as (select *, (x * x + t) % {p} as y from m1),
    m3 as (select *, (y * 48271 + x) % {p} as z from m2),
    dr as (select t, place, r, n, row_number() over (partition by t order by (z * z + y) % {p}, place) as q from m3 qualify q <= 2000),
    sz as (select size, count(distinct id) as w from own where size between 15 and 2000 group by size),
    nl as (select concat(size, ':', t) as id, r, place, n, row_number() over (partition by size, t order by place) as k, size from dr join sz on q <= size),
    v as (select *, sum(r) over (partition by id order by k) as up, sum(r) over (partition by id) as tot from (select * from own where size between 15 and 2000 union all select * from nl)),
    h as (select id, max(size) as size, max(up / tot - (place - k + 1) / (n - size)) as high, least(0, min((up - r) / tot - (place - k + 1) / (n - size))) as low from v group by id),
    e as (select id, size, case when high > -low then high else low end as es from h),
    nu as (select size, es as x, es >= 0 as s from e where contains(id, ':')),
    mn as (select size, s, avg(abs(x)) as mean, count(*) as m from nu group by size, s),
    te as (select id as term, size, es, es >= 0 as s from e where not contains(id, ':')),
    pv as (select te.*, mean, m, (select count(*) from nu where nu.size = te.size and nu.s = te.s and abs(x) >= abs(es)) as beyond from te left join mn using (size, s)),
    ne as (select term, size, es, case when mean > 0 then es / mean else 0 end as nes, case when m is null then 1 else beyond / m end as p_value from pv),
    sc as (select x / mean as x, w from nu join mn using (size, s) join sz using (size) where mean > 0),
    f as (select term, size, es, nes, p_value,
            (select coalesce(sum(w), 0) from sc where (x >= 0) = (nes >= 0) and abs(x) >= abs(nes)) / greatest(1, (select coalesce(sum(w), 0) from sc where (x >= 0) = (nes >= 0))) as far,
            (select count(*) from ne b where (b.nes >= 0) = (a.nes >= 0) and abs(b.nes) >= abs(a.nes)) / (select count(*) from ne b where (b.nes >= 0) = (a.nes >= 0)) as seen from ne a)
    select term, size, round(es, 7) as es, round(nes, 6) as nes, round(p_value, 6) as p_value, round(least(1, far / seen), 6) as fdr from f""".replace("{p}", str(_PRIME))


@query(_PRERANK)
def gsea_prerank(spark: SparkSession, d: str) -> DataFrame:
    out = gsea.prerank(fx.ranking(spark, d), fx.term_sets(spark, d))
    return out.select("term", "size", rounded("es", 7).alias("es"), *[rounded(c, 6).alias(c) for c in ("nes", "p_value", "fdr")])


_IDF = (
    "nc as (select count(distinct cell) as n from x)", "dfr as (select feature, count(distinct cell) as df from x group by feature)",
    "idf as (select feature, ln(n / case when df >= n then greatest(n - 1, 1) else df end) as raw from dfr, nc)",
    "wi as (select feature, case when min(raw) over () = max(raw) over () then 1 else raw end as idf from idf)",
    "wv as (select cell, feature, value * idf as w from x join wi using (feature))", "nv as (select cell, feature, w / sqrt(sum(w * w) over (partition by cell)) as v from wv)",
)


@query(_with(fx.FRAGMENTS, fx.CELLS, fx.TILES, MATRIX, *_IDF) + "select cell, feature, round(v, 8) as v from nv")
def idf_l2(spark: SparkSession, d: str) -> DataFrame:
    return embed.normalized(materialize(_cells_matrix(spark, d))).select("cell", "feature", rounded("v").alias("v"))


@query(_with(fx.FRAGMENTS, fx.CELLS, fx.TILES, MATRIX, *_IDF, "sm as (select feature, sum(v) as s from nv group by feature)") + "select cell, round(sum(v * s) - 1, 6) as degree from nv join sm using (feature) group by cell")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return embed.degrees(embed.normalized(materialize(_cells_matrix(spark, d)))).select("cell", F.round("degree", 6).alias("degree"))


@query()
def spectral(spark: SparkSession, d: str) -> DataFrame:
    return embed.spectral(_cells_matrix(spark, d), 5)


@query(
    _with(fx.FRAGMENTS, fx.CELLS, fx.TILES, MATRIX, *_IDF, "sm as (select feature, sum(v) as s from nv group by feature)", "dg as (select cell, sum(v * s) - 1 as d from nv join sm using (feature) group by cell)")
    + "select cell, round(sqrt(d / sum(d) over ()), 5) as leading from dg"
)
def spectral_leading(spark: SparkSession, d: str) -> DataFrame:
    """The first component of each cell: its eigenvalue is one, and its vector the root of the degrees."""
    return embed.spectral(_cells_matrix(spark, d), 2).select("cell", F.round(F.get("embedding", F.lit(0)), 5).alias("leading"))


@query()
def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    return embed.Topics(4, max_iter=5).fit(materialize(_cells_matrix(spark, d))).top_peaks(10)


@query(_with(fx.FRAGMENTS, "h as (select barcode, chrom, s//5000 as tile from frag union all select barcode, chrom, (e-1)//5000 from frag where (e-1)//5000 <> s//5000)") + "select barcode, chrom, tile, count(*) as value from h group by all")
def streaming_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Fragments written in four parts, streamed part by part."""
    import uuid

    from ..session import shared_dir
    from ..streaming import counts

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    fx.fragments(spark, d).select(formats.COLUMNS).repartition(4).write.parquet(f"{base}/in")
    counts.count_stream(counts.stream_fragments(spark, f"{base}/in"), f"{base}/state", f"{base}/check").awaitTermination()
    return counts.read_counts(spark, f"{base}/state")


@query(
    _with(fx.FRAGMENTS)
    + """select barcode, cast(count(*) as bigint) as n_unique, round((sum(n) - count(*)) / (sum(n) + 1e-9), 8) as duplicate_fraction,
       round(sum(case when chrom in ('chrM','M') then n else 0 end) / (sum(n) + 1e-9), 8) as mito_fraction
       from frag group by barcode having count(*) >= 100"""
)
def streaming_qc(spark: SparkSession, d: str) -> DataFrame:
    """Fragments in four parts, the second one sent twice; the stream stops after the first files and goes on from its checkpoint."""
    import uuid

    from ..session import shared_dir
    from ..streaming import counts

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # What tells a row from others is 128 bits of its record; rows are made once, and sent part by part as they are.
    frags = fx.fragments(spark, d, record=True).withColumn("seen", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("record"), F.lit(3600)))).withColumn("part", F.pmod(F.xxhash64("record", F.lit(1)), F.lit(4)))
    frags = frags.withColumn("record", F.unhex(F.md5("record")))
    frags.write.partitionBy("part").parquet(f"{base}/parts")
    made = spark.read.schema(frags.schema).parquet(f"{base}/parts")
    rows = made.count()

    def send(part: int) -> None:
        # As many files as tasks run at once: the batches don't become more with the rows.
        made.filter(F.col("part") == part).drop("part").coalesce(spark.sparkContext.defaultParallelism).write.mode("append").parquet(f"{base}/in")

    for part in range(2):
        send(part)
    for turn in range(2):
        stream = spark.readStream.schema(made.drop("part").schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
        counts.qc_stream(stream, f"{base}/state", f"{base}/check", keys=("record",), tasks=tasks_of(spark, rows), on_disk=rows > counts.STATE_ROWS).awaitTermination()
        if not turn:
            for part in (1, 2, 3):
                send(part)
    m = counts.read_qc(spark, f"{base}/state")
    return m.select("barcode", "n_unique", rounded("duplicate_fraction").alias("duplicate_fraction"), rounded("mito_fraction").alias("mito_fraction"))


# Plot data and formats ------------------------------------------------------------------------


@query(_with(fx.FRAGMENTS) + "select b as bin, n, b * 5.0::double as start from (select (e - s) // 5 as b, count(*) as n from frag where e - s < 1000 group by 1)")
def fragment_size_hist(spark: SparkSession, d: str) -> DataFrame:
    return plots.fragment_sizes(fx.fragments(spark, d))


@query(
    _with(*_TSSE, "m as (select barcode, count(*) as n from frag group by barcode having count(*) >= 100)")
    + "select cast(floor(log10(n + 1) * 10) as bigint) as x, cast(least(floor(tsse), 50) as bigint) as y, count(*) as n from m join sc using (barcode) group by 1, 2"
)
def qc_panel(spark: SparkSession, d: str) -> DataFrame:
    return plots.qc_grid(qc.compute_metrics(fx.fragments(spark, d), qc.tss_of(fx.transcripts(spark, d))))


@query(_enrichment_sql(_HYPER, "greatest(0, n_draw + n_hit - n_all)", "least(n_hit, n_draw)").split("select \"group\", motif, k, n_hit, case")[0]
       + 'select "group", motif, row_number() over (partition by "group" order by round(q, 6), round(lfc, 6) desc, motif) as rank from fin qualify rank <= 3')
def top_motifs(spark: SparkSession, d: str) -> DataFrame:
    out = _enriched(spark, d, "hypergeometric").withColumn("log2_fc", F.coalesce(F.round("log2_fc", 6), F.lit(-1e9)))
    return plots.top_motifs(out, 3).select("group", "motif", F.col("rank").cast("long").alias("rank"))


@query(_with(fx.FRAGMENTS) + "select chrom, s as start, e as \"end\", concat('L_', barcode) as barcode, n as count from frag")
def fragments_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Fragments written as block-gzip text, read in ranges with a prefix, and once more through Parquet."""
    import uuid

    from ..session import shared_dir

    base = f"{shared_dir(spark)}/fragments-{uuid.uuid4().hex}"
    formats.write_fragments_tsv(fx.fragments(spark, d), f"{base}/text")
    formats.make_parquet(spark, f"{base}/text", f"{base}/parquet", prefix="L_")
    return formats.read_fragments(spark, f"{base}/parquet")


@query(_with(fx.FRAGMENTS, "t as (select chrom, s, e, barcode, n from frag)") + "select chrom, count(*) as n, cast(sum(s) as bigint) as starts, cast(sum(e) as bigint) as ends, cast(sum(n) as bigint) as reads from t group by chrom")
def fragments_by_range(spark: SparkSession, d: str) -> DataFrame:
    """Block-gzip text read in ranges of 64 KB, which cut members and lines anywhere."""
    import uuid

    from ..session import shared_dir

    path = f"{shared_dir(spark)}/fragments-{uuid.uuid4().hex}"
    formats.write_fragments_tsv(fx.fragments(spark, d), path)
    rows = formats.read_fragments_tsv(spark, path, split_bytes=1 << 16)
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum("count").alias("reads"))


@query(
    _with(fx.FRAGMENTS, """t as (select barcode, chrom, count(*) as k from frag group by all)""", "m as (select chrom, avg(k) as mean from t group by chrom)")
    + """select barcode, t.chrom, k, round(mean, 6) as mean, round(least(1, case when k + 1 >= mean then list_sum(list_transform(range(1, cast(12 * sqrt(mean) as bigint) + 60), lambda j: exp(-mean + (k + j) * ln(mean) - lgamma(k + j + 1.0))))
      else 1 - list_sum(list_transform(range(cast(greatest(0, k - 12 * sqrt(mean) - 60) as bigint), k + 1), lambda j: exp(-mean + j * ln(mean) - lgamma(j + 1.0)))) end), 7) as p from t join m on t.chrom = m.chrom"""
)
def poisson_tail(spark: SparkSession, d: str) -> DataFrame:
    """How far a cell's fragments on a chromosome are above the mean of all cells."""
    k = fx.fragments(spark, d).groupBy("barcode", "chrom").agg(F.count(F.lit(1)).alias("k"))
    both = k.join(k.groupBy("chrom").agg(F.avg("k").alias("mean")), "chrom")
    return both.select("barcode", "chrom", "k", rounded("mean", 6).alias("mean"), F.round(stats.poisson_upper(F.col("k"), F.col("mean")), 7).alias("p"))


_HEX = (
    "m as (select barcode, count(*) as n from frag group by barcode having count(*) >= 100)", "p as (select log10(n + 1) as x, tsse as y from m join sc using (barcode))",
    "en as (select min(x) as lx, case when max(x) > min(x) then (max(x) - min(x)) / 20 else 1 end as ux, min(y) as ly, case when max(y) > min(y) then (max(y) - min(y)) / 22 else 1 end as uy from p)",
    "ax as (select (x - lx) / ux - (y - ly) / uy / 2 as a, (y - ly) / uy as b from p, en)",
    "cu as (select a, b, -a - b as c, floor(a + 0.5::double) as ra, floor(b + 0.5::double) as rb, floor(-a - b + 0.5::double) as rc from ax)",
    "df as (select *, abs(ra - a) as da, abs(rb - b) as db, abs(rc - c) as dc from cu)",
    "hx as (select case when da > db and da > dc then -rb - rc else ra end as q, case when da > db and da > dc then rb when db > dc then -ra - rc else rb end as r from df)",
)


@query(_with(*_TSSE, *_HEX) + "select cast(q as bigint) as q, cast(r as bigint) as r, round(lx + (q + r / 2) * ux, 6) as x, round(ly + r * uy, 6) as y, count(*) as n from hx, en group by q, r, lx, ux, ly, uy")
def qc_hexbin(spark: SparkSession, d: str) -> DataFrame:
    out = plots.qc_hexagons(qc.compute_metrics(fx.fragments(spark, d), qc.tss_of(fx.transcripts(spark, d))), 20)
    return out.select("q", "r", rounded("x", 6).alias("x"), rounded("y", 6).alias("y"), "n")


@query(_with(fx.FRAGMENTS) + "select cast(least(floor((e - s - 40) / 21.5::double), 39) as bigint) as bin, count(*) as n from frag where e - s between 40 and 900 group by 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return plots.histogram(fx.fragments(spark, d), F.col("end") - F.col("start"), 40, 900, 40)
