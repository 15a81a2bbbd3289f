"""Queries on what is taken when there is a choice: model outputs, a shutter's frame with its corners, the page to save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corners, sessions
from ..streaming.detector import detect_frames, shutter_captures
from .capture import _FOLD
from .geometry import sql_default, sql_valid
from .inputs import frames, table
from .registry import query

_NAMES = ["coords", "score", "logits", "coord_score", "boxes", "other"]


@query(f"""WITH named AS (SELECT vec_id, [{", ".join(f"'{n}'" for n in _NAMES)}] AS every, [i FOR i IN range(6) IF (vec_id // (2 ** i)::INT) % 2 = 1] AS own FROM embeddings), given AS (SELECT vec_id, [every[i + 1] FOR i IN own] AS names FROM named),
parts AS (SELECT vec_id, names, [n FOR n IN names IF contains(n, 'coord')] AS c, [n FOR n IN names IF NOT contains(n, 'coord') AND (contains(n, 'score') OR contains(n, 'logit'))] AS s FROM given)
SELECT vec_id, CASE WHEN len(c) > 0 AND len(s) > 0 THEN c[-1] ELSE names[1] END AS coords, CASE WHEN len(c) > 0 AND len(s) > 0 THEN s[-1] ELSE names[2] END AS score FROM parts WHERE len(names) > 1""")
def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a model's outputs are coordinates and score, for every choice of six names."""
    bit = lambda i: F.shiftright(F.col("vec_id"), i) % 2 == 1
    names = F.filter(F.array(*[F.when(bit(i), F.lit(n)) for i, n in enumerate(_NAMES)]), F.isnotnull)
    found = table(spark, sf_dir, "embeddings").select("vec_id", corners.output_roles(names).alias("r"))
    return found.where("r is not null").select("vec_id", "r.coords", "r.score")


_QUAD = ", ".join(f"quad[{2 * i + 1}] AS x{i}, quad[{2 * i + 2}] AS y{i}" for i in range(4))
_CORNER = ", ".join(f"round(sqrt(CASE WHEN best IS NOT NULL THEN c[{2 * i + k + 1}] WHEN own THEN quad[{2 * i + k + 1}] ELSE {sql_default(n, i)} END), 6) AS root_{n}{i}" for i in range(4) for k, n in enumerate("xy"))


@query(f"""{_FOLD}, ends AS (SELECT session, arg_max(seq, seq) AS last_seq, arg_max_null(-list_max(ring).s, seq) AS best FROM scan WHERE seq > 0 GROUP BY session),
taken AS (SELECT e.session, e.best, coalesce(e.best, e.last_seq) AS seq, s.corners AS c, f.quad, f.outcome, 640 AS w, 480 AS h FROM ends e JOIN scan s ON s.session = e.session AND s.seq = coalesce(e.best, e.last_seq) JOIN frames f ON f.session = e.session AND f.seq = coalesce(e.best, e.last_seq)),
judged AS (SELECT *, outcome = 'hit' AND {sql_valid(*corners.STRICT_SHAPE)} AS own FROM (SELECT *, {_QUAD} FROM taken))
SELECT session, seq, CASE WHEN best IS NOT NULL THEN 'best' ELSE 'current' END AS source, 640 AS width, 480 AS height, {_CORNER} FROM judged""")
def shutter_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame that a shutter press at the end of each session takes, its size and its corners, given as roots, as those have no decimal ties to round."""
    f = frames(spark, sf_dir)
    taken = shutter_captures(f, detect_frames(f))
    at = [F.round(F.sqrt(F.col("corners")[i][n]), 6).alias(f"root_{n}{i}") for i in range(4) for n in "xy"]
    return taken.select("session", "seq", "source", "size.width", "size.height", *at)


@query("""SELECT conv_id AS session, turn::INT AS page, md5(CASE WHEN (conv_id + turn) % 3 = 0 THEN coalesce('preview ' || text, text) ELSE text END) AS saved_md5, (conv_id + turn) % 3 = 0 AS previewed FROM conversations WHERE text IS NOT NULL""")
def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is saved of each page: its preview, for every third page, else what is computed now; pages with neither are not saved."""
    third = (F.col("conv_id") + F.col("turn")) % 3 == 0
    page = sessions.page_to_save(F.when(third, F.concat(F.lit("preview "), "text")), F.col("text"))
    saved = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("int").alias("page"), F.md5(page).alias("saved_md5"), third.alias("previewed"))
    return saved.where("saved_md5 is not null")
