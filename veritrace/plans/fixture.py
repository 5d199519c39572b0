"""Stand-ins for question pools and model outputs, as expressions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Model, order, and per mille of each arm a, b, c, d.
MODELS = (("m1", 1, 100, 490, 10, 440), ("m2", 2, 210, 420, 15, 320), ("m3", 3, 370, 690, 12, 450), ("m4", 4, 360, 560, 8, 430), ("m5", 5, 470, 660, 9, 435))
DEPTHS = (1, 3, 5, 10, 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") % 1000


def fourarm(spark: SparkSession, sf_dir: str, depths=DEPTHS) -> DataFrame:
    """question_id, kind, model, ord, k, a, b, c, d, passed_gates: documents x models x depths; closed-book arms do not depend on depth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"))
    grid = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("model", "ord", "pa", "pb", "pc", "pd"), m)]) for m in MODELS]))
    rows = docs.select("doc_id", "kind", grid.alias("m")).select("doc_id", "kind", "m.*").withColumn("k", F.explode(F.array(*map(F.lit, depths))))
    hit = lambda arm, *more: (_unit(F.col("doc_id"), F.col("model"), *more, F.lit(arm)) < F.col(f"p{arm}")).cast("int").alias(arm)
    return rows.select(
        F.col("doc_id").alias("question_id"), "kind", "model", "ord", "k", hit("a"), hit("b", F.col("k")), hit("c"), hit("d", F.col("k")),
        (_unit(F.col("doc_id"), F.lit("gate")) < 930).alias("passed_gates"),
    )


def _u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT % 1000)"


_VALUES = ", ".join(str(m) for m in MODELS)
FOURARM = f"""models(model, ord, pa, pb, pc, pd) AS (VALUES {_VALUES}), depths(k) AS (VALUES {', '.join(f'({k})' for k in DEPTHS)}),
fourarm AS (SELECT doc_id AS question_id, lang AS kind, model, ord, k,
  ({_u('doc_id', 'model', "'a'")} < pa)::INT AS a, ({_u('doc_id', 'model', 'k', "'b'")} < pb)::INT AS b,
  ({_u('doc_id', 'model', "'c'")} < pc)::INT AS c, ({_u('doc_id', 'model', 'k', "'d'")} < pd)::INT AS d,
  {_u('doc_id', "'gate'")} < 930 AS passed_gates FROM documents, models, depths)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs: each turn and the next one of its conversation."""
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return c.select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("answer")).where(F.col("answer").isNotNull())


TURNS = """turns AS (SELECT * FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS answer FROM conversations WHERE text IS NOT NULL) WHERE answer IS NOT NULL)"""

#: Normalised answer in DuckDB: articles go token by token, as its \\b knows ASCII only.
def norm_sql(x: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(regexp_replace(lower(trim({x})), '[[:punct:]]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def tokens_sql(x: str) -> str:
    """Tokens of a normalised answer."""
    return f"list_filter(string_split({norm_sql(x)}, ' '), lambda w: w <> '')"


def pairs_sql(w: str) -> str:
    """Neighbouring tokens of a list."""
    return f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


def first_line_sql(x: str) -> str:
    """The extracted answer."""
    line = f"trim(split_part(trim({x}, e' \\n\\t\\r'), e'\\n', 1), e' \\t\\r')"
    rest = f"trim(regexp_replace({line}, '(?i)^(the answer is|answer is|answer|the answer|my answer is|i think the answer is|the correct answer is|the short answer is)\\s*:?\\s*', ''), e' \\t\\r')"
    return f"trim(regexp_extract({rest}, '^(.*?)([.!?;]\\s|$)', 1), e' \\t\\r')"
