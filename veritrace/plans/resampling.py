"""Named queries that resample items over a space of configurations: slopes, flips, ranks, regressions, recapture, re-scoring.

Each has a form of _B hash draws that SQL follows, and a `_full` form of SETTINGS.bootstrap_b multinomial draws of patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..operators import fourarm as A
from ..operators import resample as Z
from .fixture import FOURARM, _u, _unit, fourarm, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_B = 100

Draw = Callable[[DataFrame, int], DataFrame]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _both(sql: str, tag: str):
    """Registers f(spark, sf_dir, draw, b) twice: with hash draws and its SQL, and with multinomial draws."""

    def add(f):
        def small(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir, lambda items, n: Z.hashed_sums(items, n, _B, tag), _B)

        def full(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir, Z.drawn_sums, SETTINGS.bootstrap_b)

        small.__name__, full.__name__ = f.__name__, f.__name__ + "_full"
        small.__doc__ = full.__doc__ = f.__doc__
        query(sql)(small)
        query()(full)
        return f

    return add


def _times(tag: str, items: str, suffix: str = "") -> str:
    """CTEs up to times{suffix}(space, r, item, t) for items(space, item)."""
    return f"""it{suffix} AS (SELECT space, item, row_number() OVER (PARTITION BY space ORDER BY item::VARCHAR) - 1 AS i, count(*) OVER (PARTITION BY space) AS n FROM ({items})),
draw{suffix} AS (SELECT space, r, ('0x' || substr(md5('{tag}|' || space || '|' || r || '|' || j), 1, 8))::BIGINT % n AS i FROM (SELECT space, n, r, unnest(range(1, n + 1)) AS j FROM (SELECT DISTINCT space, n FROM it{suffix}), (SELECT unnest(range(0, {_B})) AS r))),
times{suffix} AS (SELECT space, r, item, count(*) AS t FROM draw{suffix} JOIN it{suffix} USING (space, i) GROUP BY ALL)"""


_CI = "round(quantile_cont({0}, 0.025), 9) AS {1}ci_low, round(quantile_cont({0}, 0.975), 9) AS {1}ci_high"


def _cell() -> Column:
    """Models and depths in their order."""
    return F.concat_ws("|", F.lpad(F.col("ord").cast("string"), 2, "0"), F.col("model"), F.lpad(F.col("k").cast("string"), 2, "0"))


_CELL = "lpad(ord::VARCHAR, 2, '0') || '|' || model || '|' || lpad(k::VARCHAR, 2, '0')"

# --- dose and response: masking on what is remembered, over cells

_DOSE = f"dose AS (SELECT question_id AS item, model, k, {_CELL} AS cell, CASE WHEN k = 10 THEN 'C' ELSE 'B' END AS line, a, (d - c) - (b - a) AS y FROM fourarm WHERE k IN (1, 5, 10))"


def _dose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fourarm(spark, sf_dir, (1, 5, 10)).withColumn("cell", _cell())


@query(
    f"""WITH {FOURARM}, {_DOSE}, c AS (SELECT model, line, avg(a) AS x, avg(y) AS y FROM dose GROUP BY model, k, line),
s AS (SELECT 'total' AS slice, x, y FROM c UNION ALL SELECT 'line ' || line, x, y FROM c UNION ALL SELECT 'without ' || m.model, x, y FROM c, models m WHERE m.model <> c.model)
SELECT slice, count(*) AS n_cells, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept FROM s GROUP BY slice"""
)
def dose_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of masking on closed-book accuracy over cells: of all, by line, and without each model."""
    cells = _dose(spark, sf_dir).groupBy("model", "k").agg(F.count("*").alias("s0"), F.sum("a").alias("s1"), F.sum(A.masking()).alias("s2"))
    line = F.when(F.col("k") == 10, "line C").otherwise("line B")
    models = [m[0] for m in _models()]
    without = [F.when(F.col("model") != m, f"without {m}") for m in models]
    sliced = cells.withColumn("slice", F.explode(F.array_compact(F.array(F.lit("total"), line, *without))))
    return Z.slope_over_cells(sliced, "slice").select("slice", "n_cells", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"))


def _models():
    from .fixture import MODELS

    return MODELS


_DOSE_SUMS = "SELECT '{0}' AS draw, times{1}.r, cell, sum(t) AS n, sum(t * a) AS x, sum(t * y) AS y FROM times{1} JOIN dose ON dose.item = times{1}.item{2} GROUP BY ALL"


@_both(
    f"""WITH {FOURARM}, {_DOSE}, {_times('dose', "SELECT DISTINCT 'paired' AS space, item FROM dose")}, {_times('dose', "SELECT cell AS space, item FROM dose", '2')},
sums AS ({_DOSE_SUMS.format('paired', '', '')} UNION ALL {_DOSE_SUMS.format('independent', '2', ' AND cell = space')}),
reps AS (SELECT draw, r, regr_slope(y / n, x / n) AS slope FROM sums GROUP BY draw, r)
SELECT draw, {_CI.format('slope', '')}, count(slope) AS n_ok, round(avg((slope < 1)::INT), 9) AS p_below_1 FROM reps GROUP BY draw""",
    "dose",
)
def dose_bootstrap(spark: SparkSession, sf_dir: str, draw: Draw, b: int) -> DataFrame:
    """Intervals of the slope, where all cells share a draw of items and where each has its own."""
    rows = _dose(spark, sf_dir)
    sums = [F.lit(1), F.col("a"), A.masking()]
    paired = draw(Z.vectors(rows, "paired", "question_id", F.col("cell"), sums), 3).withColumn("draw", F.lit("paired"))
    own = draw(Z.vectors(rows, F.col("cell"), "question_id", F.col("cell"), sums), 3).withColumn("draw", F.lit("independent"))
    reps = Z.slope_over_cells(paired.unionByName(own), "draw", "r").withColumn("below", (F.col("slope") < 1).cast("int"))
    return Z.interval(reps, "slope", "draw").join(reps.groupBy("draw").agg(F.round(F.avg("below"), 9).alias("p_below_1")), "draw")


# --- flips of the best configuration

_SPACES = "sp AS (SELECT question_id AS item, CASE WHEN k <= 5 THEN 'shallow' ELSE 'deep' END AS space, " + _CELL + " AS cell, a, b - a AS app, d - c AS cor FROM fourarm)"
_FLIP_SUMS = "SELECT {0} AS space, times{1}.r, cell, sum(t * app) AS app, sum(t * cor) AS cor FROM times{1} JOIN sp ON sp.item = times{1}.item AND times{1}.space = {2} GROUP BY ALL"
_FLIPS = "{0} AS (SELECT space, r, list(cell ORDER BY cell) FILTER (WHERE app = ma) AS wa, list(cell ORDER BY cell) FILTER (WHERE cor = mc) AS wc FROM (SELECT *, max(app) OVER (PARTITION BY space, r) AS ma, max(cor) OVER (PARTITION BY space, r) AS mc FROM ({1})) GROUP BY space, r)"


@_both(
    f"""WITH {FOURARM}, {_SPACES}, {_times('flip', 'SELECT DISTINCT space, item FROM sp')}, {_times('flip', "SELECT space || '/' || cell AS space, item FROM sp", '2')},
{_FLIPS.format('pair', _FLIP_SUMS.format('times.space', '', 'sp.space'))}, {_FLIPS.format('indep', _FLIP_SUMS.format('sp.space', '2', "sp.space || '/' || cell"))},
point AS (SELECT space, cell, count(*) AS n, avg(a) AS a, avg(app) AS app, avg(cor) AS cor FROM sp GROUP BY ALL),
best AS (SELECT space, max(n) AS n_items, count(*) AS k_configs, first(cell ORDER BY round(app, 9) DESC, cell) AS argmax_apparent, first(cell ORDER BY round(cor, 9) DESC, cell) AS argmax_corrected, round(corr(app, a), 8) AS r_apparent_a, round(corr(cor, a), 8) AS r_corrected_a FROM point GROUP BY space),
p AS (SELECT space, round(avg((wa[1] <> wc[1])::INT), 9) AS p_flip_paired, count(*) FILTER (WHERE len(wa) > 1 OR len(wc) > 1) AS ties_paired FROM pair GROUP BY space),
q AS (SELECT space, round(avg((wa[1] <> wc[1])::INT), 9) AS p_flip_independent, count(*) FILTER (WHERE len(wa) > 1 OR len(wc) > 1) AS ties_independent FROM indep GROUP BY space)
SELECT * FROM best JOIN p USING (space) JOIN q USING (space)""",
    "flip",
)
def flip_rates(spark: SparkSession, sf_dir: str, draw: Draw, b: int) -> DataFrame:
    """How often the best configuration by apparent gain is not the best by corrected gain, in paired and independent draws, with ties."""
    rows = fourarm(spark, sf_dir).withColumns({"cell": _cell(), "space": F.when(F.col("k") <= 5, "shallow").otherwise("deep")})
    gains = [A.apparent(), A.corrected()]
    found = None
    for name, space in (("paired", F.col("space")), ("independent", F.concat_ws("/", "space", "cell"))):
        sums = draw(Z.vectors(rows, space, "question_id", F.col("cell"), gains), 2)
        best = Z.best_cells(sums.withColumn("space", F.split("space", "/")[0]), "space", "r")
        said = best.groupBy("space").agg(F.round(F.avg((F.col("best0") != F.col("best1")).cast("int")), 9).alias(f"p_flip_{name}"), F.count_if("tied").alias(f"ties_{name}"))
        found = said if found is None else found.join(said, "space")
    cells = rows.groupBy("space", "cell").agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg(A.apparent()).alias("app"), F.avg(A.corrected()).alias("cor"))
    first = lambda c: F.array_sort(F.collect_list(F.struct((-F.round(c, 9)).alias("x"), "cell")))[0]["cell"]
    point = cells.groupBy("space").agg(F.max("n").alias("n_items"), F.count("*").alias("k_configs"), first("app").alias("argmax_apparent"), first("cor").alias("argmax_corrected"), F.round(F.corr("app", "a"), 8).alias("r_apparent_a"), F.round(F.corr("cor", "a"), 8).alias("r_corrected_a"))
    return point.join(found, "space")


# --- memory strength: ranks, and the two ends

_STRONG = "st AS (SELECT question_id AS item, model, sum(a) OVER (PARTITION BY question_id) - a AS s, b - d AS y FROM fourarm WHERE k = 5)"
_TIED_RANKS = "sum(w) OVER (PARTITION BY model, r ORDER BY {0} RANGE UNBOUNDED PRECEDING) - (sum(w) OVER (PARTITION BY model, r, {0}) - 1) / 2"
_RHO = "CASE WHEN (n * pp - p * p) * (n * qq - q * q) > 0 THEN (n * pq - p * q) / sqrt((n * pp - p * p) * (n * qq - q * q)) END"


@_both(
    f"""WITH {FOURARM}, {_STRONG}, {_times('strength', "SELECT DISTINCT 'k5' AS space, item FROM st")},
h AS (SELECT model, r, s, y, sum(t)::DOUBLE AS w FROM (SELECT r, item, t FROM times UNION ALL SELECT DISTINCT -1, item, 1 FROM times) x JOIN st USING (item) GROUP BY ALL),
rk AS (SELECT *, {_TIED_RANKS.format('s')} AS i, {_TIED_RANKS.format('y')} AS j FROM h),
g AS (SELECT model, r, sum(w) AS n, sum(w * i) AS p, sum(w * j) AS q, sum(w * i * i) AS pp, sum(w * j * j) AS qq, sum(w * i * j) AS pq, sum(w * y) FILTER (WHERE s = 4) / sum(w) FILTER (WHERE s = 4) - sum(w * y) FILTER (WHERE s = 0) / sum(w) FILTER (WHERE s = 0) AS delta FROM rk GROUP BY model, r),
v AS (SELECT model, r, {_RHO} AS rho, delta FROM g)
SELECT model, round(max(rho) FILTER (WHERE r = -1), 8) AS spearman, round(quantile_cont(rho, 0.025) FILTER (WHERE r >= 0), 8) AS rho_low, round(quantile_cont(rho, 0.975) FILTER (WHERE r >= 0), 8) AS rho_high,
  round(max(delta) FILTER (WHERE r = -1), 8) AS delta, round(quantile_cont(delta, 0.025) FILTER (WHERE r >= 0), 8) AS delta_low, round(quantile_cont(delta, 0.975) FILTER (WHERE r >= 0), 8) AS delta_high, count(delta) FILTER (WHERE r >= 0) AS delta_ok FROM v GROUP BY model""",
    "strength",
)
def strength_bootstrap(spark: SparkSession, sf_dir: str, draw: Draw, b: int) -> DataFrame:
    """Spearman's rho of reliance on evidence with memory strength, and the change between its two ends, from a drawn histogram."""
    from pyspark.sql import Window as W

    own = F.sum("a").over(W.partitionBy("question_id")) - F.col("a")
    rows = fourarm(spark, sf_dir, (5,)).select("question_id", "model", own.alias("s"), (F.col("b") - F.col("d")).alias("y"))
    items = Z.vectors(rows, "k5", "question_id", F.concat_ws("|", "model", F.col("s").cast("string"), F.col("y").cast("string")), [F.lit(1)])
    sums = draw(items, 1).unionByName(Z.point_sums(items, 1))
    part = F.split("cell", r"\|")
    h = sums.select(part[0].alias("model"), "r", part[1].cast("int").alias("s"), part[2].cast("int").alias("y"), F.col("s0").alias("w"))
    end = lambda s: F.try_divide(F.sum(F.when(F.col("s") == s, F.col("w") * F.col("y"))), F.sum(F.when(F.col("s") == s, F.col("w"))))
    v = Z.weighted_spearman(h, "s", "y", "w", "model", "r").join(h.groupBy("model", "r").agg((end(4) - end(0)).alias("delta")), ["model", "r"])
    of = lambda c: (F.when(F.col("r") >= 0, F.col(c)))
    cut = lambda c: F.percentile(of(c), F.array(*map(F.lit, SETTINGS.ci)))
    out = v.groupBy("model").agg(*[f for c in ("rho", "delta") for f in (F.max(F.when(F.col("r") == -1, F.col(c))).alias(c), cut(c).alias(f"{c}_cut"))], F.count(of("delta")).alias("delta_ok"))
    r8 = lambda c, name: F.round(c, 8).alias(name)
    return out.select("model", r8("rho", "spearman"), r8(F.col("rho_cut")[0], "rho_low"), r8(F.col("rho_cut")[1], "rho_high"), r8("delta", "delta"), r8(F.col("delta_cut")[0], "delta_low"), r8(F.col("delta_cut")[1], "delta_high"), "delta_ok")


# --- regressions on log-probabilities, clustered by question

_LP = f"lp AS (SELECT question_id AS item, model, -({_u('question_id', 'model', chr(39) + 'lp' + chr(39))} + 400 * a) / 250.0 AS x, a AS z, (d - c) - (b - a) AS y FROM fourarm WHERE k = 5)"
_WITHIN = "WITH_ AS (SELECT r, model, sum(t) AS n, sum(t * x) AS x, sum(t * z) AS z, sum(t * y) AS y, sum(t * x * x) AS xx, sum(t * z * z) AS zz, sum(t * x * z) AS xz, sum(t * x * y) AS xy, sum(t * z * y) AS zy FROM (SELECT r, item, t FROM times UNION ALL SELECT DISTINCT -1, item, 1 FROM times) u JOIN lp USING (item) GROUP BY r, model)".replace("WITH_", "mo")



@_both(
    f"""WITH {FOURARM}, {_LP}, {_times('memory', "SELECT DISTINCT 'k5' AS space, item FROM lp")}, {_WITHIN},
ce AS (SELECT r, sum(xx - x * x / n) AS xx, sum(zz - z * z / n) AS zz, sum(xz - x * z / n) AS xz, sum(xy - x * y / n) AS xy, sum(zy - z * y / n) AS zy FROM mo GROUP BY r),
co AS (SELECT r, unnest([{{'coefficient': 'slope', 'v': xy / xx}}, {{'coefficient': 'slope_x', 'v': (zz * xy - xz * zy) / (xx * zz - xz * xz)}}, {{'coefficient': 'slope_z', 'v': (xx * zy - xz * xy) / (xx * zz - xz * xz)}}], recursive := true) FROM ce)
SELECT coefficient, round(max(v) FILTER (WHERE r = -1), 8) AS point, round(quantile_cont(v, 0.025) FILTER (WHERE r >= 0), 8) AS ci_low, round(quantile_cont(v, 0.975) FILTER (WHERE r >= 0), 8) AS ci_high, count(v) FILTER (WHERE r >= 0) AS n_ok FROM co GROUP BY coefficient""",
    "memory",
)
def memory_bootstrap(spark: SparkSession, sf_dir: str, draw: Draw, b: int) -> DataFrame:
    """Masking on the old answer's log-probability, alone and beside closed-book success, within models, with intervals by question."""
    x = -(_unit(F.col("question_id"), F.col("model"), F.lit("lp")) + 400 * F.col("a")) / 250.0
    rows = fourarm(spark, sf_dir, (5,)).select("question_id", "model", x.alias("x"), F.col("a").alias("z"), A.masking().alias("y"))
    items = Z.vectors(rows, "k5", "question_id", F.col("model"), Z.moments(F.col("x"), F.col("z"), F.col("y")))
    c = Z.within_regression(draw(items, 9).unionByName(Z.point_sums(items, 9)), "r")
    names = ("slope", "slope_x", "slope_z")
    each = c.select("r", F.explode(F.array(*[F.struct(F.lit(n).alias("coefficient"), F.col(n).alias("v")) for n in names])).alias("x")).select("r", "x.*")
    cut = F.percentile(F.when(F.col("r") >= 0, F.col("v")), F.array(*map(F.lit, SETTINGS.ci)))
    return each.groupBy("coefficient").agg(F.round(F.max(F.when(F.col("r") == -1, F.col("v"))), 8).alias("point"), F.round(cut[0], 8).alias("ci_low"), F.round(cut[1], 8).alias("ci_high"), F.count(F.when(F.col("r") >= 0, F.col("v"))).alias("n_ok"))


# --- capture and recapture

_FOUND = f"fo AS (SELECT doc_id AS item, coalesce(lang, '?') AS space, ({_u('doc_id', chr(39) + 'h' + chr(39))} < 60)::INT AS h, ({_u('doc_id', chr(39) + 'm' + chr(39))} < CASE WHEN {_u('doc_id', chr(39) + 'h' + chr(39))} < 60 THEN 400 ELSE 20 END)::INT AS m FROM documents)"


@_both(
    f"""WITH {_FOUND}, {_times('recapture', 'SELECT space, item FROM fo')},
s AS (SELECT fo.space, u.r, sum(t)::DOUBLE AS n, sum(t * m)::DOUBLE AS n1, sum(t * h)::DOUBLE AS n2, sum(t * m * h)::DOUBLE AS m FROM (SELECT space, r, item, t FROM times UNION ALL SELECT DISTINCT space, -1, item, 1 FROM times) u JOIN fo ON fo.item = u.item AND fo.space = u.space GROUP BY ALL),
v AS (SELECT *, CASE WHEN m > 0 THEN n1 * n2 / m / n END AS rate, CASE WHEN m > 0 THEN ((n1 + 1) * (n2 + 1) / (m + 1) - 1) / n END AS chap FROM s)
SELECT space AS pool, max(n)::BIGINT AS n_items, round(max(rate) FILTER (WHERE r = -1), 9) AS rate_lp, round(max(chap) FILTER (WHERE r = -1), 9) AS rate_chapman, round(quantile_cont(rate, 0.025) FILTER (WHERE r >= 0), 9) AS ci_low, round(quantile_cont(rate, 0.975) FILTER (WHERE r >= 0), 9) AS ci_high, count(*) FILTER (WHERE r >= 0 AND rate IS NULL) AS ci_undef_replicates FROM v GROUP BY space""",
    "recapture",
)
def recapture_bootstrap(spark: SparkSession, sf_dir: str, draw: Draw, b: int) -> DataFrame:
    """Rate of faults by two finders for each pool; replicates in which both find nothing in common are left out and counted."""
    u = lambda tag: _unit(F.col("doc_id"), F.lit(tag))
    h = u("h") < 60
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("space"), h.cast("int").alias("h"), (u("m") < F.when(h, 400).otherwise(20)).cast("int").alias("m"))
    items = Z.vectors(rows, F.col("space"), "doc_id", F.lit("pool"), [F.lit(1), F.col("m"), F.col("h"), F.col("m") * F.col("h")])
    sums = draw(items, 4).unionByName(Z.point_sums(items, 4))
    v = Z.recapture(sums, "space", "r", "s0")
    at = lambda c, point: F.when((F.col("r") == -1) if point else (F.col("r") >= 0), F.col(c))
    cut = F.percentile(at("rate", False), F.array(*map(F.lit, SETTINGS.ci)))
    return v.groupBy(F.col("space").alias("pool")).agg(
        F.max("s0").cast("long").alias("n_items"), F.round(F.max(at("rate", True)), 9).alias("rate_lp"), F.round(F.max(at("rate_chapman", True)), 9).alias("rate_chapman"),
        F.round(cut[0], 9).alias("ci_low"), F.round(cut[1], 9).alias("ci_high"), F.count_if((F.col("r") >= 0) & F.col("rate").isNull()).alias("ci_undef_replicates"),
    )


# --- re-scoring by aliases: two runs whose items only partly agree

_RUNS = f"""rn AS (SELECT question_id AS item, model AS space, k = 5 AS later, d - c AS uniform, greatest(d, ({_u('question_id', 'model', chr(39) + 'alias' + chr(39))} < 120)::INT) - c AS alias FROM fourarm WHERE (k = 1 AND {_u('question_id', chr(39) + 'old' + chr(39))} < 900) OR (k = 5 AND {_u('question_id', chr(39) + 'new' + chr(39))} < 700))"""


@_both(
    f"""WITH {FOURARM}, {_RUNS}, {_times('alias', 'SELECT DISTINCT space, item FROM rn')},
k AS (SELECT space, item, later, unnest([{{'kind': 'uniform', 'g': uniform}}, {{'kind': 'alias', 'g': alias}}], recursive := true) FROM rn),
v AS (SELECT k.space, u.r, kind, (sum(t * g) FILTER (WHERE later))::DOUBLE / sum(t) FILTER (WHERE later) - (sum(t * g) FILTER (WHERE NOT later))::DOUBLE / sum(t) FILTER (WHERE NOT later) AS d FROM (SELECT space, r, item, t FROM times UNION ALL SELECT DISTINCT space, -1, item, 1 FROM times) u JOIN k ON k.space = u.space AND k.item = u.item GROUP BY ALL)
SELECT space AS model, kind, round(max(d) FILTER (WHERE r = -1), 9) AS point, round(quantile_cont(d, 0.025) FILTER (WHERE r >= 0), 9) AS ci_low, round(quantile_cont(d, 0.975) FILTER (WHERE r >= 0), 9) AS ci_high FROM v GROUP BY space, kind""",
    "alias",
)
def rescore_change(spark: SparkSession, sf_dir: str, draw: Draw, b: int) -> DataFrame:
    """Change of corrected gain from an earlier to a later run, strictly and with aliases; questions are drawn with their rows of both runs."""
    u = lambda *parts: _unit(*parts)
    q = F.col("question_id")
    rows = fourarm(spark, sf_dir, (1, 5)).where(((F.col("k") == 1) & (u(q, F.lit("old")) < 900)) | ((F.col("k") == 5) & (u(q, F.lit("new")) < 700)))
    late = (F.col("k") == 5).cast("int")
    alias = F.greatest(F.col("d"), (u(q, F.col("model"), F.lit("alias")) < 120).cast("int")) - F.col("c")
    rows = rows.withColumn("x", F.explode(F.array(F.struct(F.lit("uniform").alias("kind"), A.corrected().alias("g")), F.struct(F.lit("alias").alias("kind"), alias.alias("g")))))
    g = F.col("x.g")
    items = Z.vectors(rows, F.col("model"), "question_id", F.col("x.kind"), [g * (1 - late), 1 - late, g * late, late])
    v = Z.ratio_change(draw(items, 4).unionByName(Z.point_sums(items, 4)), "space", "cell", "r")
    cut = F.percentile(F.when(F.col("r") >= 0, F.col("change")), F.array(*map(F.lit, SETTINGS.ci)))
    return v.groupBy(F.col("space").alias("model"), F.col("cell").alias("kind")).agg(F.round(F.max(F.when(F.col("r") == -1, F.col("change"))), 9).alias("point"), F.round(cut[0], 9).alias("ci_low"), F.round(cut[1], 9).alias("ci_high"))
