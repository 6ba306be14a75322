"""Queries of the operators of this subpackage, and their SQL where SQL can say it on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetrail.llm import bpe, clusters, mixing, runs, sentences, similar, splits
from kinetrail.session import table

WIDTH = 24
CLOSE = 0.4
GROUP = 8.0


def _runs(s, d):
    return runs.state_runs(table(s, d, "label_frames"), table(s, d, "meta"))


def p1_runs(s, d):
    return _runs(s, d)


def p1_found(s, d):
    return _runs(s, d).where(F.col("n_frames") >= 2).select("traj_id", "first_frame", "last_frame")


def p3_neighbours(s, d):
    near = similar.similar_vectors(table(s, d, "featurized"), "vec_id", "data", WIDTH)
    return near.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour"), "distance")


def p3_found(s, d):
    return similar.close_pairs(table(s, d, "featurized"), "vec_id", "data", WIDTH, CLOSE)


def _frames(s, d):
    return table(s, d, "featurized"), table(s, d, "meta"), table(s, d, "topologies")


def p4_splits(s, d):
    return splits.frame_splits(*_frames(s, d)).select("vec_id", "split")


def p4_found(s, d):
    return splits.frame_groups(splits.frame_splits(*_frames(s, d)))


def _groups(s, d):
    return clusters.similarity_groups(table(s, d, "featurized"), "vec_id", "data", WIDTH, GROUP)


def p6_found(s, d):
    return _groups(s, d).members.withColumnRenamed("id", "vec_id")


def p6_groups(s, d):
    return clusters.group_profiles(_groups(s, d))


def p6_frames(s, d):
    return clusters.all_frames(_groups(s, d)).withColumnRenamed("id", "vec_id")


def p7_ids(s, d):
    return bpe.encode_column(table(s, d, "documents"), "text", ["doc_id"])


def p7_roundtrip(s, d):
    """Each text as it comes back from its ids: its length, and whether it is the same."""
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = bpe.encode_column(docs, "text", ["doc_id", "text"])
    back = bpe.decode_column(ids, "ids", ["doc_id", "text"], out="decoded")
    same = F.col("text") == F.col("decoded")
    return back.select("doc_id", F.length("decoded").cast("bigint").alias("n_chars"), same.alias("same"))


def _mix(s, d):
    return mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets"))


def p8_found(s, d):
    return _mix(s, d).short()


def p8_mix(s, d):
    return _mix(s, d).copies().select("doc_id", "source", "copies")


def p8_shares(s, d):
    return _mix(s, d).shares()


def p9_found(s, d):
    return sentences.sentences(table(s, d, "documents"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_runs, p3_found, p3_neighbours, p4_found, p4_splits, p6_found, p6_groups, p6_frames, p7_ids, p7_roundtrip, p8_found, p8_mix, p8_shares, p9_found,
    )
}

_STATES = r"""
WITH latest AS (
  SELECT traj_id, frame, label FROM label_frames WHERE traj_id IS NOT NULL AND frame IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY traj_id, frame ORDER BY loaded_at DESC NULLS LAST, label DESC NULLS LAST) = 1),
numbered AS (
  SELECT traj_id, frame, try_cast(ltrim(regexp_extract(translate(lower(label), '０１２３４５６７８９', '0123456789'),
    '^\s*(?:s(?:tate)?[\s_:#-]*)?(\+?[0-9]+(?:\.[0-9]*)?(?:e[+-]?[0-9]+)?)\s*$', 1), '+') AS DOUBLE) AS v FROM latest),
states AS (SELECT traj_id, frame, CAST(round(v) AS BIGINT) AS state FROM numbered WHERE abs(v - round(v)) <= 0.001 AND round(v) > 0),
runs AS (SELECT traj_id, state, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames FROM (
  SELECT *, frame - row_number() OVER (PARTITION BY traj_id, state ORDER BY frame) AS island FROM states) GROUP BY traj_id, state, island)
"""

_PATH = r"regexp_replace(replace(lower(trim({c}, chr(32) || chr(9) || chr(10) || chr(13))), '\', '/'), '/(\./|/)+', '/', 'g')"


def _project(c: str) -> str:
    return f"nullif(regexp_extract({_PATH.format(c=c)}, '(?:^|/)(proj[0-9]+/.*)$', 1), '')"


def _topology(c: str) -> str:
    return f"nullif(regexp_extract({_PATH.format(c=c)}, '([^/]+/)?[^/]+$'), '')"


#: Usable vectors as SQL sees them, and every pair within a distance: for the small tables.
_WITHIN = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CAST(any_value(data) AS DOUBLE[{WIDTH}]) AS x FROM featurized
  WHERE vec_id IS NOT NULL AND len(data) = {WIDTH} AND len(list_filter(data, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 GROUP BY vec_id),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE array_distance(a.x, b.x) <= {{0}})
"""
_GROUPED = _WITHIN.format(GROUP) + """, sets AS (SELECT a, list_sort(list(b)) AS near FROM near GROUP BY a),
full_sets AS (SELECT near, min(a) AS cluster_id FROM sets GROUP BY near HAVING count(*) = len(near) AND count(*) >= 8)
"""

ORACLE = {
    "p3_found": _WITHIN.format(CLOSE) + "SELECT a AS vec_a, b AS vec_b FROM near WHERE a < b",
    "p6_found": _GROUPED + "SELECT a AS vec_id, cluster_id FROM sets JOIN full_sets USING (near)",
    "p6_frames": _GROUPED + "SELECT a AS vec_id, cluster_id FROM sets LEFT JOIN full_sets USING (near)",
    "p7_roundtrip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, true AS same FROM documents",
    "p1_runs": _STATES
    + """, steps AS (SELECT traj_id, CASE WHEN step_ps > 0 AND NOT isnan(step_ps) THEN step_ps END AS step FROM meta
  QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY gathered_at DESC) = 1)
SELECT traj_id, state, first_frame, last_frame, n_frames, n_frames * step AS duration_ps FROM runs LEFT JOIN steps USING (traj_id)""",
    "p1_found": _STATES + "SELECT traj_id, first_frame, last_frame FROM runs WHERE n_frames >= 2",
    "p4_found": f"""
WITH RECURSIVE own AS (SELECT top_id, {_topology('top_fn')} AS t, {_topology('derived_from')} AS p FROM topologies),
edges AS (SELECT t AS a, coalesce(p, t) AS b FROM own UNION SELECT coalesce(p, t), t FROM own),
reach AS (SELECT a, a AS b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
named AS (SELECT r.a AS topology, min(o.top_id) AS group_id FROM reach r JOIN own o ON o.t = r.b GROUP BY 1),
files AS (SELECT {_project('traj_fn')} AS file, min(coalesce({_topology('top_fn')}, {_topology('top_abs_fn')})) AS topology FROM meta GROUP BY 1),
frames AS (SELECT vec_id, max({_project('fns')}) AS file FROM featurized GROUP BY 1)
SELECT vec_id, group_id FROM frames JOIN files USING (file) JOIN named USING (topology)""",
}
