"""Registered queries of the core operators and the SQL that says the same.

Floating results are rounded, as sums depend on the order of addition.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinetrail.functions import divergence
from kinetrail.functions.distances import METRICS
from kinetrail.operators import bayes, cluster, counting, decomposition, featurizers, fragment, hmm, lumping, msm, ratematrix, sampling, tpt
from kinetrail.operators import preprocessing as prep
from kinetrail.plans import geometry_queries as geo
from kinetrail.plans import views
from kinetrail.session import scratch_path, table
from kinetrail.sources import archive, examples, store

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# --- fragment and replicate (p2), archives (p5) --------------------------------

_RUNS = """
WITH runs AS (
  SELECT traj_id, max(nullif(upper(trim(i0)), '')) OVER (PARTITION BY traj_id) AS i0,
    CASE WHEN nframes >= 0 THEN CAST(nframes AS BIGINT) END AS nframes,
    CASE WHEN step_ps > 0 AND NOT isnan(step_ps) AND NOT isinf(step_ps) THEN step_ps END AS step_ps
  FROM meta WHERE traj_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY gathered_at DESC NULLS LAST, nframes DESC NULLS LAST, step_ps DESC NULLS LAST) = 1),
totals AS (
  SELECT i0, CAST(count(*) AS BIGINT) AS n_traj, CAST(coalesce(sum(nframes), 0) AS BIGINT) AS nframes,
    round(CAST(coalesce(sum(nframes * step_ps), 0) AS DOUBLE), 3) AS sim_ps, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share
  FROM runs GROUP BY i0)
"""


@query("p2_found", _RUNS + "SELECT i0 FROM totals WHERE share > 0.05 AND i0 IS NOT NULL")
def p2_found(s, d):
    return fragment.project_totals(table(s, d, "meta")).where(F.col("share") > 0.05).select("i0")


@query("p2_projects", _RUNS + "SELECT * FROM totals WHERE i0 IS NOT NULL")
def p2_projects(s, d):
    t = fragment.project_totals(table(s, d, "meta"))
    return t.select("i0", "n_traj", "nframes", F.round("sim_ps", 3).alias("sim_ps"), F.round("share", 9).alias("share"))


@query("p2_shares", _RUNS + """SELECT r.traj_id, r.i0, r.nframes, round(r.nframes / CAST(t.nframes AS DOUBLE), 9) AS share
FROM runs r JOIN totals t ON r.i0 = t.i0 WHERE r.nframes > 0""")
def p2_shares(s, d):
    return fragment.trajectory_shares(table(s, d, "meta")).withColumn("share", F.round("share", 9))


_PATH = r"regexp_replace(replace(lower(trim({c}, chr(32) || chr(9) || chr(10) || chr(13))), '\', '/'), '/(\./|/)+', '/', 'g')"
_CHUNKS = f"""
WITH files AS (
  SELECT chunk_id, regexp_extract({_PATH.format(c='chunk_fn')}, '(?:^|/)(proj[0-9]+/.*)$', 1) AS path, frames, potential FROM chunk_files
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY coalesce(len(frames), -1) DESC) = 1),
listed AS (SELECT filename, unnest(chunks) AS c FROM trajectories),
owners AS (
  SELECT DISTINCT regexp_extract({_PATH.format(c='filename')}, '[^/]+$') AS trajectory, regexp_extract({_PATH.format(c='c')}, '(?:^|/)(proj[0-9]+/.*)$', 1) AS path
  FROM listed WHERE c IS NOT NULL),
records AS (SELECT chunk_id, path, unnest(frames) AS frame, unnest(potential) AS potential, generate_subscripts(frames, 1) AS pos FROM files),
ranked AS (
  SELECT chunk_id, frame, pos, rank() OVER (PARTITION BY trajectory, frame, potential ORDER BY chunk_id) AS r FROM records JOIN owners USING (path)),
surplus AS (SELECT DISTINCT chunk_id, pos, frame FROM ranked WHERE r > 1)
"""


def _chunks(s, d):
    return table(s, d, "chunk_files"), table(s, d, "trajectories")


@query("p5_found", _CHUNKS + "SELECT DISTINCT chunk_id, frame FROM surplus")
def p5_found(s, d):
    return archive.packed_surplus(*_chunks(s, d))


@query("p5_index", _CHUNKS + """, kept AS (
  SELECT chunk_id, count(*) AS n, count(*) FILTER (WHERE frame IS NULL OR potential IS NULL) AS missing FROM records ANTI JOIN surplus USING (chunk_id, pos) GROUP BY 1)
SELECT f.chunk_id, nullif(f.path, '') AS path, CAST(1 + 16 * coalesce(k.n, 0) + CASE WHEN k.missing > 0 THEN ceil(k.n / 4) ELSE 0 END AS BIGINT) AS length, CAST(coalesce(s.n, 0) AS INTEGER) AS n_surplus
FROM files f LEFT JOIN kept k USING (chunk_id) LEFT JOIN (SELECT chunk_id, count(*) AS n FROM surplus GROUP BY 1) s USING (chunk_id)""")
def p5_index(s, d):
    return archive.packed_index(*_chunks(s, d)).select("chunk_id", "path", "length", "n_surplus")


@query("p5_records", _CHUNKS + "SELECT chunk_id, frame, potential FROM records ANTI JOIN surplus USING (chunk_id, pos)")
def p5_records(s, d):
    return archive.packed_records(*_chunks(s, d))


# --- transition counting --------------------------------------------------------

_PAIRS = """WITH p AS (SELECT user_id, event_type AS src, lead(event_type, {lag}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
c AS (SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst)
"""


@query("msm_counts_lag1", _PAIRS.format(lag=1) + "SELECT src, dst, n, round(n / 1.0, 6) AS count FROM c")
def msm_counts_lag1(s, d):
    return counting.transition_counts(views.events(s, d)).withColumn("count", F.round("count", 6))


@query("msm_counts_lag3", _PAIRS.format(lag=3) + "SELECT src, dst, n, round(n / 3.0, 6) AS count FROM c")
def msm_counts_lag3(s, d):
    return counting.transition_counts(views.events(s, d), 3).withColumn("count", F.round("count", 6))


_LAGS = [1, 2, 5, 10]


@query("msm_counts_multilag", " UNION ALL ".join(
    f"SELECT {k} AS lag, src, dst, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type AS src, lead(event_type, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst" for k in _LAGS))
def msm_counts_multilag(s, d):
    return counting.multilag_counts(views.events(s, d), _LAGS)


@query("msm_counts_strided", """WITH f AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
p AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY k) AS dst FROM f WHERE k % 3 = 0)
SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE dst IS NOT NULL GROUP BY src, dst""")
def msm_counts_strided(s, d):
    return counting.transition_counts(views.events(s, d), 3, sliding=False).select("src", "dst", "n")


@query("msm_transmat_none", _PAIRS.format(lag=1) + "SELECT src, dst, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY src), 10) AS t_ij FROM c")
def msm_transmat_none(s, d):
    return counting.row_matrix(counting.transition_counts(views.events(s, d))).withColumn("t_ij", F.round("t_ij", 10))


@query("msm_transmat_transpose", _PAIRS.format(lag=1) + """, s AS (SELECT src, dst, sum(n) AS n2 FROM (SELECT src, dst, n FROM c UNION ALL SELECT dst, src, n FROM c) GROUP BY src, dst)
SELECT src, dst, round(CAST(n2 AS DOUBLE) / sum(n2) OVER (PARTITION BY src), 10) AS t_ij, round(CAST(sum(n2) OVER (PARTITION BY src) AS DOUBLE) / sum(n2) OVER (), 10) AS pi_i FROM s""")
def msm_transmat_transpose(s, d):
    m = counting.transpose_matrix(counting.transition_counts(views.events(s, d)))
    return m.select("src", "dst", F.round("t_ij", 10).alias("t_ij"), F.round("pi_i", 10).alias("pi_i"))


@query("msm_orders_transmat", """WITH p AS (SELECT o_orderpriority AS src, lead(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders),
c AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY src, dst)
SELECT src, dst, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY src), 10) AS t_ij FROM c""")
def msm_orders_transmat(s, d):
    return counting.row_matrix(counting.transition_counts(views.orders(s, d))).withColumn("t_ij", F.round("t_ij", 10))


#: A mapping that leaves one label out.
_MAPPING = {"click": 0, "purchase": 1, "signup": 2, "view": 3}
_MAPPED = """WITH f AS (SELECT user_id AS traj_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
  CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END AS idx FROM events)
"""


@query("msm_fill_labels", _MAPPED + "SELECT traj_id, frame, idx FROM f")
def msm_fill_labels(s, d):
    return counting.fill_labels(views.events(s, d), _MAPPING)


@query("msm_clip_segments", _MAPPED + """, g AS (SELECT *, sum(CASE WHEN idx IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY frame) AS k FROM f)
SELECT traj_id, CAST(dense_rank() OVER (PARTITION BY traj_id ORDER BY k) - 1 AS BIGINT) AS segment, frame, idx FROM g WHERE idx IS NOT NULL""")
def msm_clip_segments(s, d):
    return counting.clip_labels(views.events(s, d), _MAPPING)


@query("msm_inverse_labels", _MAPPED + "SELECT traj_id, frame, CASE idx WHEN 0 THEN 'click' WHEN 1 THEN 'purchase' WHEN 2 THEN 'signup' WHEN 3 THEN 'view' END AS label FROM f")
def msm_inverse_labels(s, d):
    filled = counting.fill_labels(views.events(s, d), _MAPPING)
    return counting.inverse_labels(filled, "idx", list(_MAPPING)).select("traj_id", "frame", "label")


@query("subsample_sliding", """SELECT user_id AS traj_id, CAST(k AS BIGINT) AS frame, event_type AS state, CAST(k % 3 AS BIGINT) AS shift
FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)""")
def subsample_sliding(s, d):
    return counting.subsample(views.events(s, d), 3)


@query("msm_score_ll", """WITH a AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
c AS (SELECT src, dst, count(*) AS n FROM a WHERE dst IS NOT NULL AND user_id % 2 = 0 GROUP BY 1, 2),
t AS (SELECT src, dst, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY src) AS t_ij FROM c),
e AS (SELECT src, dst, count(*) AS n FROM a WHERE dst IS NOT NULL AND user_id % 2 = 1 GROUP BY 1, 2)
SELECT round(sum(CASE WHEN t_ij > 0 THEN e.n * ln(t_ij) ELSE CAST('-inf' AS DOUBLE) END), 4) AS log_likelihood FROM e LEFT JOIN t USING (src, dst)""")
def msm_score_ll(s, d):
    """Half of the users to estimate, the other half to score: the split is the feature."""
    t = views.events(s, d)
    half = lambda k: counting.transition_counts(t.replace(t.df.where(F.col("user_id") % 2 == k)))
    return msm.score_terms(counting.row_matrix(half(0)), half(1)).select(F.round("log_likelihood", 4).alias("log_likelihood"))


@query("macro_transitions", """WITH f AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 0 WHEN event_type IN ('purchase', 'signup') THEN 1 END AS m FROM events),
p AS (SELECT m AS src, lead(m) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM f)
SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst""")
def macro_transitions(s, d):
    return msm.macro_counts(views.events(s, d), {"click": 0, "view": 0, "purchase": 1, "signup": 1})


@query("trajectory_counts", """SELECT user_id AS traj_id, src, dst, CAST(count(*) AS BIGINT) AS n FROM (
SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2, 3""")
def trajectory_counts(s, d):
    return counting.trajectory_counts(views.events(s, d))


@query("bootstrap_weighted_counts")
def bootstrap_weighted_counts(s, d):
    return msm.weighted_replicates(counting.trajectory_counts(views.events(s, d)), 20)


# --- Markov models: rows only, tested against NumPy ------------------------------


def _model(s, d, **kw):
    return msm.MarkovStateModel(**({"reversible_type": "mle"} | kw)).fit(views.events(s, d))


@query("msm_mle_modes")
def msm_mle_modes(s, d):
    return _model(s, d).to_frames(s)["modes"]


@query("msm_mle_transmat", _PAIRS.format(lag=1).replace("WITH p AS", "WITH RECURSIVE p AS") + """, k AS (SELECT src, dst, coalesce(n, 0) AS n FROM (SELECT DISTINCT src FROM c) CROSS JOIN (SELECT DISTINCT dst FROM c) LEFT JOIN c USING (src, dst)),
b AS (SELECT src, dst, n + m AS two, sum(n) OVER (PARTITION BY src) AS cs, sum(m) OVER (PARTITION BY dst) AS cd FROM (SELECT k.src, k.dst, k.n, r.n AS m FROM k JOIN k r ON r.src = k.dst AND r.dst = k.src)),
x AS (SELECT 0 AS t, src, dst, CAST(two AS DOUBLE) AS x FROM b UNION ALL
  SELECT t + 1, src, dst, two / (cs / xs + cd / xd) FROM (
    SELECT x.t, b.src, b.dst, b.two, b.cs, b.cd, sum(x.x) OVER (PARTITION BY b.src) AS xs, sum(x.x) OVER (PARTITION BY b.dst) AS xd FROM x JOIN b USING (src, dst)) WHERE t < 400)
SELECT src, dst, round(x / sum(x) OVER (PARTITION BY src), 6) AS t_ij FROM x WHERE t = 400""")
def msm_mle_transmat(s, d):
    m = _model(s, d)
    rows = [(str(a), str(b), round(float(m.transmat_[i, j]), 6)) for i, a in enumerate(m.labels_) for j, b in enumerate(m.labels_)]
    return s.createDataFrame(rows, "src string, dst string, t_ij double")


_TWO = """WITH l AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS s FROM events), g(lag) AS (VALUES (1), (2), (3), (5)),
f AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM l),
c AS (SELECT lag, a.s, avg(CASE WHEN a.s <> b.s THEN 1.0 ELSE 0.0 END) AS leave FROM g, f a, f b WHERE a.user_id = b.user_id AND b.r = a.r + lag GROUP BY ALL)
"""


@query("implied_timescales_two_states", _TWO + "SELECT lag, CASE WHEN sum(leave) < 1 THEN round(-lag / ln(1 - sum(leave)), 4) ELSE CAST('nan' AS DOUBLE) END AS timescale FROM c GROUP BY lag")
def implied_timescales_two_states(s, d):
    t = views.Trajectories(table(s, d, "events").withColumn("bought", F.col("event_type") == "purchase"), "user_id", ("ts", "event_id"), "bought")
    out = msm.implied_timescales(t, [1, 2, 3, 5], 1)
    return out.select(F.col(out.columns[0]).alias("lag"), F.round(out.columns[-1], 4).alias("timescale"))


_THREE = """WITH l AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'a' WHEN 'purchase' THEN 'c' ELSE 'b' END AS s FROM events),
p AS (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM l),
c AS (SELECT s, n, count(*) AS k FROM p WHERE n IS NOT NULL GROUP BY 1, 2), s AS (SELECT s, n, sum(k) AS k FROM (SELECT s, n, k FROM c UNION ALL SELECT n, s, k FROM c) GROUP BY 1, 2),
t AS (SELECT s, n, k / sum(k) OVER (PARTITION BY s) AS t FROM s),
v AS (SELECT sum(CASE WHEN s = 'a' AND n = 'a' THEN t END) AS aa, sum(CASE WHEN s = 'a' AND n = 'b' THEN t END) AS ab, sum(CASE WHEN s = 'b' AND n = 'a' THEN t END) AS ba,
  sum(CASE WHEN s = 'b' AND n = 'b' THEN t END) AS bb, sum(CASE WHEN s = 'b' AND n = 'c' THEN t END) AS bc FROM t)
"""


@query("tpt_three_states", _THREE + """SELECT 'a' AS label, CAST(0 AS DOUBLE) AS committor, round((1 - bb + ab) / ((1 - aa) * (1 - bb) - ab * ba), 5) AS mfpt FROM v
UNION ALL SELECT 'b', round(bc / (ba + bc), 7), round((1 - aa + ba) / ((1 - aa) * (1 - bb) - ab * ba), 5) FROM v UNION ALL SELECT 'c', 1, 0 FROM v""")
def tpt_three_states(s, d):
    label = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "purchase", "c").otherwise("b")
    t = views.Trajectories(table(s, d, "events").withColumn("s", label), "user_id", ("ts", "event_id"), "s")
    m = msm.MarkovStateModel(reversible_type="transpose").fit(t)
    rows = zip(m.labels_, tpt.committors(0, 2, m), tpt.mfpts(m, 2))
    return s.createDataFrame([(str(a), round(float(q), 7), round(float(f), 5)) for a, q, f in rows], "label string, committor double, mfpt double")


@query("implied_timescales")
def implied_timescales(s, d):
    return msm.implied_timescales(views.events(s, d), [1, 2, 3, 5], 3)


@query("msm_eigtransform")
def msm_eigtransform(s, d):
    return _model(s, d).eigtransform(views.events(s, d))


@query("msm_draw_samples")
def msm_draw_samples(s, d):
    return _model(s, d).draw_samples(views.events(s, d), 5)


@query("msm_uncertainty")
def msm_uncertainty(s, d):
    m = _model(s, d)
    rows = [(i, float(t), float(e)) for i, (t, e) in enumerate(zip(m.timescales_, m.uncertainty_timescales()))]
    return s.createDataFrame(rows, "mode int, timescale double, error double")


@query("param_sweep_scores")
def param_sweep_scores(s, d):
    fits = msm.param_sweep(views.events(s, d), {"lag_time": [1, 2, 4], "reversible_type": ["mle", "transpose"]})
    return s.createDataFrame([(m.lag_time, m.reversible_type, m.score_) for m in fits], "lag int, kind string, score double")


@query("bootstrap_msm")
def bootstrap_msm(s, d):
    b = msm.BootStrapMarkovStateModel(10).fit(views.events(s, d))
    rows = [(k, str(x), float(p)) for k, pops in enumerate(b.all_populations_) for x, p in zip(b.mle_.labels_, pops)]
    return s.createDataFrame(rows, "sample int, label string, population double")


@query("bayesian_msm")
def bayesian_msm(s, d):
    return bayes.BayesianMarkovStateModel(n_samples=40).fit(views.events(s, d)).to_frame(s)


@query("rate_matrix")
def rate_matrix(s, d):
    m = ratematrix.ContinuousTimeMSM().fit(views.events(s, d))
    rows = [(i, j, float(m.ratemat_[i, j])) for i in range(m.n_states_) for j in range(m.n_states_)]
    return s.createDataFrame(rows, "src int, dst int, rate double")


@query("bayesian_rate_matrix")
def bayesian_rate_matrix(s, d):
    m = ratematrix.BayesianContinuousTimeMSM(n_samples=50).fit(views.events(s, d))
    return s.createDataFrame([(k, i, float(x)) for k, t in enumerate(m.all_timescales_) for i, x in enumerate(t)], "sample int, mode int, timescale double")


# --- path theory, lumping ---------------------------------------------------------

_FLUX = _PAIRS.format(lag=1) + """, s AS (SELECT src, dst, sum(n) AS n2 FROM (SELECT src, dst, n FROM c UNION ALL SELECT dst, src, n FROM c) GROUP BY src, dst),
m AS (SELECT src, dst, CAST(n2 AS DOUBLE) / sum(n2) OVER (PARTITION BY src) AS t, CAST(sum(n2) OVER (PARTITION BY src) AS DOUBLE) / sum(n2) OVER () AS pi FROM s),
q(idx, q) AS (VALUES ('click', 0.0), ('error', 0.2), ('purchase', 1.0), ('signup', 0.7), ('view', 0.4)),
f AS (SELECT src, dst, pi * (1 - a.q) * t * b.q AS flux FROM m JOIN q a ON a.idx = src JOIN q b ON b.idx = dst WHERE src <> dst)
SELECT f.src, f.dst, round(CAST(f.flux AS DOUBLE), 10) AS flux, round(CAST(greatest(f.flux - coalesce(g.flux, 0), 0) AS DOUBLE), 10) AS net
FROM f LEFT JOIN f g ON g.src = f.dst AND g.dst = f.src"""


@query("tpt_fluxes", _FLUX)
def tpt_fluxes(s, d):
    m = counting.transpose_matrix(counting.transition_counts(views.events(s, d)))
    q = s.createDataFrame([("click", 0.0), ("error", 0.2), ("purchase", 1.0), ("signup", 0.7), ("view", 0.4)], "idx string, q double")
    pops = m.select(F.col("src").alias("idx"), "pi_i").distinct()
    f = tpt.flux_table(m.select("src", "dst", "t_ij"), pops, q)
    return f.select("src", "dst", F.round("flux", 10).alias("flux"), F.round("net", 10).alias("net"))


@query("tpt_paths")
def tpt_paths(s, d):
    m = _model(s, d)
    return tpt.path_table(s, *tpt.paths([0], [2], tpt.net_fluxes([0], [2], m), num_paths=10))


@query("tpt_states")
def tpt_states(s, d):
    m = _model(s, d)
    rows = zip(m.labels_, tpt.committors(0, 2, m), tpt.conditional_committors(0, 2, 1, m), tpt.mfpts(m, 2), tpt.hub_scores(m))
    return s.createDataFrame([(str(a), *map(float, r)) for a, *r in rows], "label string, committor double, conditional double, mfpt double, hub double")


@query("lumping_states")
def lumping_states(s, d):
    m = _model(s, d)
    rows = []
    for kind in (lumping.PCCA, lumping.PCCAPlus, lumping.MVCA, lumping.BACE):
        macro = kind.from_msm(m, 2).microstate_mapping_
        rows += [(kind.__name__, str(x), int(k)) for x, k in zip(m.labels_, macro)]
    return s.createDataFrame(rows, "kind string, label string, macro int")


_SHARES = "(SELECT event_type, user_id % 2 AS g, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY user_id % 2) AS p FROM events GROUP BY 1, 2)"


@query("js_divergence", f"""WITH a AS {_SHARES},
x AS (SELECT coalesce(l.p, 0) AS p, coalesce(r.p, 0) AS q FROM (SELECT * FROM a WHERE g = 0) l FULL JOIN (SELECT * FROM a WHERE g = 1) r USING (event_type)),
m AS (SELECT p, q, (p + q) / 2 AS m FROM x)
SELECT round(greatest(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END), 0), 10) AS kl,
round(greatest(sum((CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2), 0), 10) AS js FROM m""")
def js_divergence(s, d):
    n = table(s, d, "events").groupBy("event_type", (F.col("user_id") % 2).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("g").agg(F.sum("n").alias("t"))
    p = n.join(total, "g").select("event_type", "g", (F.col("n") / F.col("t")).alias("p"))
    part = lambda k: p.where(F.col("g") == k).select("event_type", "p")
    out = divergence.divergence_table(part(0), part(1), [], "event_type")
    return out.select(F.round("kl", 10).alias("kl"), F.round("js", 10).alias("js"))


# --- distances and clustering -----------------------------------------------------


def _literals(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]"


#: Four centres in the space of the embeddings, from a rule.
_CENTERS = [[round(((i * 37 + j * 17) % 23 - 11) / 40.0, 4) for j in range(64)] for i in range(4)]
_LIST = {
    "euclidean": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))))",
    "sqeuclidean": "list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i])))",
    "cityblock": "list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i])))",
    "chebyshev": "list_max(list_transform(range(1, 65), lambda i: abs(x[i] - y[i])))",
    "canberra": "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x[i] <> 0 OR y[i] <> 0 THEN abs(x[i] - y[i]) / (abs(x[i]) + abs(y[i])) ELSE 0 END))",
    "braycurtis": "list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))) / list_sum(list_transform(range(1, 65), lambda i: abs(x[i] + y[i])))",
    "hamming": "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x[i] <> y[i] THEN 1.0 ELSE 0.0 END)) / 64.0",
    "jaccard": "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x[i] <> y[i] AND (x[i] <> 0 OR y[i] <> 0) THEN 1.0 ELSE 0.0 END)) / list_sum(list_transform(range(1, 65), lambda i: CASE WHEN x[i] <> 0 OR y[i] <> 0 THEN 1.0 ELSE 0.0 END))",
}
_VEC = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_CENT = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {_literals(c)})" for i, c in enumerate(_CENTERS)) + ") AS c(k, y))"


def _nearest_sql(metric: str) -> str:
    return f"""WITH dd AS (SELECT vec_id, k, CAST({_LIST[metric]} AS DOUBLE) AS dist FROM {_VEC} v, {_CENT} c)
SELECT vec_id, CAST(k AS INTEGER) AS label, round(dist, 8) AS distance FROM dd QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) = 1"""


def _nearest(metric: str):
    def run(s, d):
        near = cluster.nearest_expression(F.col("features"), np.array(_CENTERS), metric)
        return views.vectors(s, d).select("vec_id", near.alias("n")).select("vec_id", "n.label", F.round("n.distance", 8).alias("distance"))

    return run


for _metric in METRICS:
    query(f"assign_nearest_{_metric}", _nearest_sql(_metric))(_nearest(_metric))


@query("assign_nearest_arrow", _nearest_sql("euclidean"))
def assign_nearest_arrow(s, d):
    return cluster.assign_nearest(views.vectors(s, d), np.array(_CENTERS)).select("vec_id", "label", F.round("distance", 8).alias("distance"))


@query("dist_to_point", f"SELECT vec_id, round(CAST({_LIST['cityblock']} AS DOUBLE), 8) AS distance FROM {_VEC} v, (SELECT y FROM {_CENT} WHERE k = 2) c")
def dist_to_point(s, d):
    return cluster.distances_to(views.vectors(s, d), _CENTERS[2], "cityblock").select("vec_id", F.round("distance", 8).alias("distance"))


@query("cdist_centers", f"SELECT vec_id AS a, CAST(k AS BIGINT) AS b, round(CAST({_LIST['euclidean']} AS DOUBLE), 8) AS distance FROM {_VEC} v, {_CENT} c")
def cdist_centers(s, d):
    centers = s.createDataFrame([(i, c) for i, c in enumerate(_CENTERS)], "vec_id bigint, features array<double>")
    return cluster.cdist(views.vectors(s, d), centers, "vec_id").withColumn("distance", F.round("distance", 8))


@query("sumdist_pairs", f"""WITH v AS {_VEC}, p AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings),
j AS (SELECT v.x, w.x AS y FROM p JOIN v ON v.vec_id = a JOIN v w ON w.vec_id = b) SELECT round(sum(CAST({_LIST['euclidean']} AS DOUBLE)), 5) AS total FROM j""")
def sumdist_pairs(s, d):
    v = views.vectors(s, d)
    pairs = v.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return cluster.sumdist(v, pairs, "vec_id").select(F.round("total", 5).alias("total"))


_GRID = """WITH g AS (SELECT min(value) - 1e-10 AS a, max(value) + 1e-10 AS b FROM events),
l AS (SELECT event_id, user_id, ts, least(CAST(floor((value - a) / ((b - a) / 8)) AS BIGINT), 7) AS label FROM events, g)
"""


def _grid(s, d):
    df = table(s, d, "events").withColumn("features", F.array("value"))
    return cluster.NDGrid(8).fit(df).predict(df)


@query("ndgrid_labels", _GRID + "SELECT event_id, label FROM l")
def ndgrid_labels(s, d):
    return _grid(s, d).select("event_id", "label")


@query("ndgrid_transitions", _GRID + """, p AS (SELECT label AS src, lead(label) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM l)
SELECT src, dst, CAST(count(*) AS BIGINT) AS n FROM p WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst""")
def ndgrid_transitions(s, d):
    t = views.events(s, d).replace(_grid(s, d)).with_state("label")
    return counting.transition_counts(t).select("src", "dst", "n")


@query("sample_states_knn", f"""SELECT CAST(k AS INTEGER) AS query, CAST(r - 1 AS INTEGER) AS rank, round(dist, 8) AS distance, vec_id FROM (
SELECT vec_id, k, dist, row_number() OVER (PARTITION BY k ORDER BY dist, vec_id) AS r FROM (SELECT vec_id, k, CAST({_LIST['euclidean']} AS DOUBLE) AS dist FROM {_VEC} v, {_CENT} c)) WHERE r <= 5""")
def sample_states_knn(s, d):
    return cluster.NearestFrames(views.vectors(s, d), ["vec_id"]).query(np.array(_CENTERS), 5).withColumn("distance", F.round("distance", 8))


_STEP = f"(SELECT v.vec_id, v.x, CAST({_LIST['euclidean']} AS DOUBLE) AS d FROM {_VEC} v, (SELECT x AS y FROM {{}}))"
_FARTHEST = f"WITH v AS MATERIALIZED {_VEC}, c0 AS MATERIALIZED (SELECT 0 AS k, vec_id, x FROM v WHERE vec_id = 1)" + "".join(
    f", d{k} AS MATERIALIZED (SELECT n.vec_id, n.x, n.d" + (f" AS raw, least(n.d, o.d) AS d FROM {_STEP.format(f'c{k}')} n JOIN d{k - 1} o USING (vec_id))" if k else f" AS raw, n.d FROM {_STEP.format('c0')} n)")
    + f", c{k + 1} AS MATERIALIZED (SELECT {k + 1} AS k, vec_id, x FROM d{k} ORDER BY d DESC, vec_id LIMIT 1)" for k in range(10))


@query("kcenters_labels", _FARTHEST + " SELECT vec_id, CAST(arg_min(k, raw) AS INTEGER) AS label, round(min(raw), 7) AS distance FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, vec_id, raw FROM d{k}" for k in range(10)) + ") GROUP BY vec_id")
def kcenters_labels(s, d):
    v = views.vectors(s, d)
    return cluster.KCenters(10, key="vec_id", first=1).fit(v).predict(v).select("vec_id", "label", F.round("distance", 7).alias("distance"))


@query("regular_spatial_labels")
def regular_spatial_labels(s, d):
    v = views.vectors(s, d)
    return cluster.RegularSpatial(1.2, order=["vec_id"]).fit(v).predict(v).select("vec_id", "label", "distance")


@query("kmeans_labels")
def kmeans_labels(s, d):
    v = views.vectors(s, d)
    return cluster.KMeans(8).fit(v).predict(v).select("vec_id", "label", "distance")


@query("kmedoids_labels")
def kmedoids_labels(s, d):
    v = views.vectors(s, d)
    return cluster.KMedoids(6, n_passes=3).fit(v).predict(v).select("vec_id", "label", "distance")


@query("minibatch_kmedoids_labels")
def minibatch_kmedoids_labels(s, d):
    v = views.vectors(s, d)
    return cluster.MiniBatchKMedoids(6).fit(v).predict(v).select("vec_id", "label")


@query("landmark_agglomerative_labels")
def landmark_agglomerative_labels(s, d):
    v = views.vectors(s, d)
    return cluster.LandmarkAgglomerative(5, 200, "ward").fit(v).predict(v).select("vec_id", "label")


# --- preprocessing ------------------------------------------------------------------

_LINE_SQL = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, {i} AS i, CAST({e} AS DOUBLE) AS x FROM lineitem" for i, e in enumerate(views.LINE_FEATURES))


def _scaled(s, d, scaler):
    df = views.lines(s, d).df
    out = scaler.fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode("features").alias("i", "v")).withColumn("v", F.round("v", 7))


def _scaler_sql(expression: str) -> str:
    return f"WITH x AS ({_LINE_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, i, round({expression}, 7) AS v FROM x"


def _over(f: str) -> str:
    return f"{f} OVER (PARTITION BY i)"


_SCALERS = {
    "scaler_standard": (prep.StandardScaler, f"(x - {_over('avg(x)')}) / coalesce(nullif({_over('stddev_pop(x)')}, 0), 1)"),
    "scaler_minmax": (prep.MinMaxScaler, f"(x - {_over('min(x)')}) / coalesce(nullif({_over('max(x)')} - {_over('min(x)')}, 0), 1)"),
    "scaler_maxabs": (prep.MaxAbsScaler, f"x / coalesce(nullif({_over('max(abs(x))')}, 0), 1)"),
    "scaler_robust": (prep.RobustScaler, f"(x - {_over('quantile_cont(x, 0.5)')}) / coalesce(nullif({_over('quantile_cont(x, 0.75)')} - {_over('quantile_cont(x, 0.25)')}, 0), 1)"),
}
for _name, (_kind, _sql) in _SCALERS.items():
    query(_name, _scaler_sql(_sql))(lambda s, d, k=_kind: _scaled(s, d, k()))

query("binarizer", _scaler_sql("CASE WHEN x > 5 THEN 1.0 ELSE 0.0 END"))(lambda s, d: _scaled(s, d, prep.Binarizer(5.0)))


@query("normalizer_l1", f"""SELECT vec_id, i - 1 AS i, round(x[i] / list_sum(list_transform(x, lambda v: abs(v))), 8) AS v FROM (SELECT vec_id, x, unnest(range(1, 65)) AS i FROM {_VEC})""")
def normalizer_l1(s, d):
    out = prep.Normalizer("l1").transform(views.vectors(s, d))
    return out.select("vec_id", F.posexplode("features").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("v", 8).alias("v"))


@query("normalizer_l2", f"""SELECT vec_id, i - 1 AS i, round(x[i] / sqrt(list_sum(list_transform(x, lambda v: v * v))), 8) AS v FROM (SELECT vec_id, x, unnest(range(1, 65)) AS i FROM {_VEC})""")
def normalizer_l2(s, d):
    out = prep.Normalizer("l2").transform(views.vectors(s, d))
    return out.select("vec_id", F.posexplode("features").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("v", 8).alias("v"))


@query("imputer_mean", """WITH x AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(coalesce(v, avg(v) OVER ()), 7) AS v FROM x""")
def imputer_mean(s, d):
    df = table(s, d, "events").select("event_id", F.array(F.when(F.col("event_id") % 7 != 0, F.col("value"))).alias("features"))
    return prep.Imputer().fit(df).transform(df).select("event_id", F.round(F.col("features")[0], 7).alias("v"))


@query("imputer_median", """WITH x AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM x)), 7) AS v FROM x""")
def imputer_median(s, d):
    df = table(s, d, "events").select("event_id", F.array(F.when(F.col("event_id") % 7 != 0, F.col("value"))).alias("features"))
    return prep.Imputer("median").fit(df).transform(df).select("event_id", F.round(F.col("features")[0], 7).alias("v"))


@query("variance_threshold", f"WITH x AS ({_LINE_SQL}) SELECT i, round(var_pop(x), 4) AS variance FROM x GROUP BY i HAVING var_pop(x) > 7")
def variance_threshold(s, d):
    v = prep.VarianceThreshold(7.0).fit(views.lines(s, d).df)
    return s.createDataFrame([(int(i), round(float(v.variances_[i]), 4)) for i in v.support_], "i int, variance double")


@query("polynomial_features", """SELECT event_id, round(1.0, 6) AS p0, round(value, 6) AS p1, round(value * value, 6) AS p2 FROM events""")
def polynomial_features(s, d):
    df = table(s, d, "events").select("event_id", F.array("value").alias("features"))
    out = prep.PolynomialFeatures(2).fit(df).transform(df)
    return out.select("event_id", *(F.round(F.col("features")[i], 6).alias(f"p{i}") for i in range(3)))


@query("label_binarizer", "SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{c}' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_{c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM events")
def label_binarizer(s, d):
    b = prep.LabelBinarizer().fit(table(s, d, "events"), "event_type")
    out = b.transform(table(s, d, "events"), "event_type")
    return out.select("event_id", *(F.col("features")[i].alias(f"is_{c}") for i, c in enumerate(b.classes_)))


@query("kernel_centerer", """WITH k AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST(a.n_nationkey * b.n_nationkey AS DOUBLE) AS k FROM nation a, nation b)
SELECT i, j, round(k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER (), 8) AS k FROM k""")
def kernel_centerer(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("i"))
    k = n.crossJoin(F.broadcast(n.withColumnRenamed("i", "j"))).withColumn("k", (F.col("i") * F.col("j")).cast("double"))  # 25 nations
    return prep.center_kernel(k).withColumn("k", F.round("k", 8))


@query("ewma", """WITH f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)
SELECT a.user_id AS traj_id, CAST(a.t AS BIGINT) AS frame, round(sum(b.value * pow(0.5, a.t - b.t)) / sum(pow(0.5, a.t - b.t)), 7) AS v
FROM f a JOIN f b ON a.user_id = b.user_id AND b.t <= a.t GROUP BY 1, 2""")
def ewma(s, d):
    return prep.ewma(views.event_values(s, d), span=3).select("traj_id", "frame", F.round(F.col("features")[0], 7).alias("v"))


@query("double_ewma", """WITH f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
w AS (SELECT a.user_id, a.t, sum(CASE WHEN b.t <= a.t THEN b.value * pow(0.5, a.t - b.t) END) / sum(CASE WHEN b.t <= a.t THEN pow(0.5, a.t - b.t) END) AS u,
  sum(CASE WHEN b.t >= a.t THEN b.value * pow(0.5, b.t - a.t) END) / sum(CASE WHEN b.t >= a.t THEN pow(0.5, b.t - a.t) END) AS v FROM f a JOIN f b ON a.user_id = b.user_id GROUP BY 1, 2)
SELECT user_id AS traj_id, CAST(t AS BIGINT) AS frame, round((u + v) / 2, 7) AS v FROM w""")
def double_ewma(s, d):
    return prep.double_ewma(views.event_values(s, d), span=3).select("traj_id", "frame", F.round(F.col("features")[0], 7).alias("v"))


@query("butterworth")
def butterworth(s, d):
    return prep.butterworth(views.event_values(s, d)).select("traj_id", "frame", F.col("features")[0].alias("v"))


# --- decomposition --------------------------------------------------------------------

_LEADS = ", ".join(f"CAST({e} AS DOUBLE) AS x{i}, lead(CAST({e} AS DOUBLE), 2) OVER w AS y{i}" for i, e in enumerate(views.LINE_FEATURES))
_MOMENTS = f"""WITH p AS (SELECT {_LEADS} FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)),
q AS (SELECT * FROM p WHERE y0 IS NOT NULL)
""" + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, round(sum(x{i} * y{j}) / count(*), 6) AS xy, round(sum(x{i} * x{j}) / count(*), 6) AS xx, round(sum(y{i} * y{j}) / count(*), 6) AS yy FROM q" for i in range(4) for j in range(4))


@query("tica_moments", _MOMENTS)
def tica_moments(s, d):
    m = decomposition.lagged_moments(views.lines(s, d), 2)
    rows = [(i, j, *(round(float(a[i, j] / m.n), 6) for a in (m.xy, m.xx, m.yy))) for i in range(4) for j in range(4)]
    return s.createDataFrame(rows, "i int, j int, xy double, xx double, yy double")


@query("tica_moments_sql", _MOMENTS)
def tica_moments_sql(s, d):
    t = views.lines(s, d)
    m = decomposition.moment_table(t, 2)
    n = t.df.groupBy(t.traj).agg(F.greatest(F.count(F.lit(1)) - 2, F.lit(0)).alias("n")).agg(F.sum("n").alias("n"))
    return m.crossJoin(F.broadcast(n)).select("i", "j", *(F.round(F.col(c) / F.col("n"), 6).alias(c) for c in ("xy", "xx", "yy")))  # one row


def _projected(s, d, model):
    t = views.lines(s, d)
    out = model.fit(t if isinstance(model, decomposition.tICA) else t.df).transform(t.df)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.posexplode("features").alias("i", "v"))


query("tica_transform")(lambda s, d: _projected(s, d, decomposition.tICA(2, lag_time=2)))
query("sparse_tica_transform")(lambda s, d: _projected(s, d, decomposition.SparseTICA(1, lag_time=2, rho=0.05)))
query("ksparse_tica_transform")(lambda s, d: _projected(s, d, decomposition.KSparseTICA(1, lag_time=2, k=2)))
@query("pca_lengths", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(views.LINE_FEATURES)) + " FROM lineitem), m AS (SELECT "
    + ", ".join(f"avg(x{i}) AS m{i}" for i in range(4)) + " FROM x) SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(" + " + ".join(f"(x{i} - m{i}) ** 2" for i in range(4)) + "), 5) AS length FROM x, m")
def pca_lengths(s, d):
    """All components together keep the distance of every row to the mean."""
    t = views.lines(s, d)
    out = decomposition.PCA(4).fit(t.df).transform(t.df)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v)), 5).alias("length"))


query("pca_transform")(lambda s, d: _projected(s, d, decomposition.PCA(2)))
query("factor_analysis_transform")(lambda s, d: _projected(s, d, decomposition.FactorAnalysis(1)))
query("fast_ica_transform")(lambda s, d: _projected(s, d, decomposition.FastICA(2, max_iter=10)))


@query("kernel_tica_transform")
def kernel_tica_transform(s, d):
    t = views.event_values(s, d)
    m = decomposition.KernelTICA(2).fit(t)
    return m.transform(t.df).select("event_id", F.posexplode("features").alias("i", "v"))


# --- hidden Markov models ---------------------------------------------------------------


@query("gaussian_hmm_path")
def gaussian_hmm_path(s, d):
    t = views.event_values(s, d)
    return hmm.GaussianHMM(2, n_init=1, n_iter=4).fit_predict(t)


@query("vonmises_hmm_path")
def vonmises_hmm_path(s, d):
    df = table(s, d, "events").withColumn("features", F.array(F.pmod(F.col("value"), F.lit(2 * np.pi)) - np.pi))
    t = views.Trajectories(df, "user_id", ("ts", "event_id"), None, "features")
    return hmm.VonMisesHMM(2, n_init=1, n_iter=3).fit_predict(t)


# --- sources, featurizers, sampling -------------------------------------------------------

_NAMES = r"(PROJ\d+)/(RUN\d+)/(CLONE\d+)/(?:\./)?traj-(\d+)\.(xtc|dcd)"


@query("gather_metadata_regex", r"""SELECT traj_fn, gathered_at::VARCHAR AS at, regexp_matches(traj_fn, '^(?:(PROJ\d+)/(RUN\d+)/(CLONE\d+)/(?:\./)?traj-(\d+)\.(xtc|dcd))$') AS parsed,
""" + ", ".join(f"nullif(regexp_extract(traj_fn, '^(?:{_NAMES})$', {i}), '') AS {n}" for i, n in ((1, "project"), (2, "run"), (3, "clone"))) + f", try_cast(nullif(regexp_extract(traj_fn, '^(?:{_NAMES})$', 4), '') AS INTEGER) AS number FROM meta")
def gather_metadata_regex(s, d):
    meta = table(s, d, "meta").select("traj_fn", F.date_format("gathered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    meta = meta.withColumn("at", F.regexp_replace("at", r"\.?0+$", ""))
    out = store.parsed_metadata(meta, "traj_fn", _NAMES, ["project", "run", "clone", "number"], {"number": "int"})
    return out


@query("dataset_roundtrip", "SELECT user_id AS traj_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame, event_type AS state FROM events")
def dataset_roundtrip(s, d):
    frames = views.events(s, d).frames()
    return store.Dataset.create(frames, scratch_path(s, "dataset"), command="query").frames()


@query("feature_union", f"""WITH x AS (SELECT user_id, ts, event_id, value, ln(1 + greatest(value, 0)) AS l FROM events),
n AS (SELECT stddev_pop(value) AS a, stddev_pop(l) AS b FROM x)
SELECT user_id AS traj_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame, round(value / a, 7) AS f0, round(l / b, 7) AS f1 FROM x, n""")
def feature_union(s, d):
    f = views.event_values(s, d).frames()
    one = lambda i: f.select("traj_id", "frame", F.array(F.col("features")[i]).alias("features"))
    u = featurizers.feature_union([one(0), one(1)])
    return u.select("traj_id", "frame", *(F.round(F.col("features")[i], 7).alias(f"f{i}") for i in range(2)))


@query("atom_pairs", """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, round(sqrt((x[1] - x[4]) ** 2 + (x[2] - x[5]) ** 2 + (x[3] - x[6]) ** 2), 8) AS d01, round(sqrt((x[1] - x[7]) ** 2 + (x[2] - x[8]) ** 2 + (x[3] - x[9]) ** 2), 8) AS d02 FROM a""")
def atom_pairs(s, d):
    """The first numbers of a vector read as atoms of three coordinates."""
    atoms = F.array(*(F.slice("features", 3 * i + 1, 3) for i in range(21)))
    df = views.vectors(s, d).withColumn("xyz", atoms)
    f = featurizers.AtomPairsFeaturizer([(0, 1), (0, 2)]).expression()
    return df.select("vec_id", f.alias("f")).select("vec_id", F.round(F.col("f")[0], 8).alias("d01"), F.round(F.col("f")[1], 8).alias("d02"))


@query("dihedral_angles", "WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) " + " UNION ALL ".join(
    f"SELECT vec_id, {k} AS i, round({geo._torsion(*q)}, 6) AS angle FROM a" for k, q in enumerate(((0, 1, 2, 3), (4, 5, 6, 7)))))
def dihedral_angles(s, d):
    from kinetrail.functions import geometry

    atoms = F.array(*(F.slice("features", 3 * i + 1, 3) for i in range(21)))
    f = featurizers.FunctionFeaturizer(lambda x: geometry.dihedrals(x, np.array([[0, 1, 2, 3], [4, 5, 6, 7]])))
    return f.transform(views.vectors(s, d).withColumn("xyz", atoms), "angles").select("vec_id", F.posexplode("angles").alias("i", "angle")).withColumn("angle", F.round("angle", 6))


@query("rmsd_to_reference")
def rmsd_to_reference(s, d):
    atoms = F.array(*(F.slice("features", 3 * i + 1, 3) for i in range(21)))
    reference = np.array(_CENTERS[0][:63]).reshape(1, 21, 3)
    return featurizers.RMSDFeaturizer(reference).transform(views.vectors(s, d).withColumn("xyz", atoms), "rmsd").select("vec_id", F.col("rmsd")[0].alias("rmsd"))


@query("sample_dimension_linear", """WITH f AS (SELECT user_id AS traj_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame, value FROM events),
p AS (SELECT min(value) + k * ((max(value) - min(value)) / 19) AS p, k FROM f, range(20) r(k) GROUP BY k),
n AS (SELECT traj_id, frame, value, row_number() OVER (PARTITION BY k ORDER BY abs(value - p), traj_id, frame) AS r FROM f, p)
SELECT DISTINCT traj_id, frame, value FROM n WHERE r = 1""")
def sample_dimension_linear(s, d):
    return sampling.sample_dimension(views.event_values(s, d), 0, 20)


@query("unique_in_order", "SELECT event_type, CAST(min(event_id) AS BIGINT) AS event_id FROM events GROUP BY event_type")
def unique_in_order(s, d):
    return sampling.unique_in_order(table(s, d, "events"), "event_type", "event_id")


@query("trajectory_medians", """WITH f AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS m FROM events)
SELECT user_id AS traj_id, CAST(t AS BIGINT) AS frame, value AS v FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(value - m), t) = 1""")
def trajectory_medians(s, d):
    return sampling.trajectory_medians(views.event_values(s, d), 0)


@query("muller_energy", "SELECT event_id, round(" + " + ".join(
    "{A} * exp({a} * (x - {x}) ** 2 + {b} * (x - {x}) * (y - {y}) + {c} * (y - {y}) ** 2)".format(**{k: f"({v[i]})" for k, v in examples.MULLER.items()}) for i in range(4)
) + ", 6) AS energy FROM (SELECT event_id, CAST(event_id % 25 AS DOUBLE) / 10 - 1.5 AS x, CAST(event_id % 20 AS DOUBLE) / 10 AS y FROM events)")
def muller_energy(s, d):
    e = table(s, d, "events")
    x, y = (F.col("event_id") % 25).cast("double") / 10 - 1.5, (F.col("event_id") % 20).cast("double") / 10
    return e.select("event_id", F.round(examples.muller_energy(x, y), 6).alias("energy"))


@query("distance_matrix_nations", "SELECT a.r_regionkey AS a, b.r_regionkey AS b, round(CAST(abs(a.r_regionkey - b.r_regionkey) AS DOUBLE), 6) AS distance FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
def distance_matrix_nations(s, d):
    r = table(s, d, "region").select("r_regionkey", F.array(F.col("r_regionkey").cast("double")).alias("features"))
    return cluster.pdist(r, "r_regionkey").withColumn("distance", F.round("distance", 6))


@query("windowed_states", "SELECT time_bucket(INTERVAL 1 day, ts)::VARCHAR AS start, event_type AS state, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def windowed_states(s, d):
    from kinetrail.streaming.counts import windowed_states as run

    out = run(table(s, d, "events"), "ts", "event_type", "1 day")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_transitions", _PAIRS.format(lag=1) + "SELECT src, dst, n FROM c")
def stream_transitions(s, d):
    """The events as a stream that is read to its end: the counts are those of the table."""
    from kinetrail.streaming.counts import transition_stream

    at = scratch_path(s, "stream")
    source = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    # equal times do not occur within a user
    q = transition_stream(source, "user_id", "ts", "event_type").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{at}/out").where(F.col("src").isNotNull()).groupBy("src", "dst").agg(F.sum("n").alias("n"))


# --- the rest of the inventory: rows only, tested against definitions ------------------------


@query("cross_validated_scores")
def cross_validated_scores(s, d):
    from kinetrail.plans.pipeline import cross_validate

    scores = cross_validate(views.events(s, d), msm.MarkovStateModel(), 5)
    return s.createDataFrame([(k, float(x)) for k, x in enumerate(scores)], "fold int, score double")


@query("pipeline_states")
def pipeline_states(s, d):
    """Scaling, slow components and clusters of line items, chained."""
    from kinetrail.plans.pipeline import Pipeline

    t = views.lines(s, d)
    steps = [("scale", prep.StandardScaler()), ("tica", decomposition.tICA(2, lag_time=2)), ("cluster", cluster.KMeans(5))]
    return Pipeline(steps).fit(t).transform(t).df.select("l_orderkey", "l_linenumber", "l_partkey", "label")


@query("apm_labels")
def apm_labels(s, d):
    from kinetrail.operators.apm import APM

    t = views.event_values(s, d)
    return APM(2).fit(t).predict(t.df).select("event_id", "label")


query("gmm_labels")(lambda s, d: cluster.GMM(3, 20, 1).fit(views.vectors(s, d).drop("label")).predict(views.vectors(s, d).drop("label")).select("vec_id", "label"))
query("minibatch_kmeans_labels")(lambda s, d: cluster.MiniBatchKMeans(8).fit(views.vectors(s, d)).predict(views.vectors(s, d)).select("vec_id", "label"))
query("agglomerative_labels")(lambda s, d: cluster.AgglomerativeClustering(5).fit(views.vectors(s, d)).predict(views.vectors(s, d)).select("vec_id", "label"))
query("spectral_labels")(lambda s, d: cluster.SpectralClustering(5).fit(views.vectors(s, d)).predict(views.vectors(s, d)).select("vec_id", "label"))
query("affinity_labels")(lambda s, d: cluster.AffinityPropagation().fit(views.vectors(s, d)).predict(views.vectors(s, d)).select("vec_id", "label"))
query("mean_shift_labels")(lambda s, d: cluster.MeanShift(1.2).fit(views.vectors(s, d)).predict(views.vectors(s, d)).select("vec_id", "label"))
query("sparse_pca_transform")(lambda s, d: _projected(s, d, decomposition.SparsePCA(1)))
query("kernel_pca_transform")(lambda s, d: _projected(s, d, decomposition.KernelPCA(1)))


@query("chunks_numbered_through", """WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem)
SELECT l_suppkey, l_orderkey, l_partkey, CAST(k - 1 AS BIGINT) AS l_linenumber FROM f""")
def chunks_numbered_through(s, d):
    """Orders as chunks of a supplier: their lines are numbered through. Lines of one part and number keep its order."""
    df = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("l_linenumber"))
    return store.join_chunks(df, "l_suppkey", "l_orderkey", "l_linenumber", drop_first_duplicate=False)


@query("categorical_draws")
def categorical_draws(s, d):
    p = s.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.3)], "idx int, p double")
    return sampling.categorical(table(s, d, "events").select("event_id"), p, F.col("event_id"))


@query("double_well_frames")
def double_well_frames(s, d):
    return examples.double_well(s, 4, 2000).select("traj_id", "frame", F.col("features")[0].alias("x"))


@query("stored_numpy_arrays", "SELECT n_regionkey AS traj_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS frame, CAST(n_nationkey AS DOUBLE) AS v FROM nation")
def stored_numpy_arrays(s, d):
    """Frames written as one array a trajectory to the shared folder and read back."""
    t = views.Trajectories(table(s, d, "nation").withColumn("features", F.array(F.col("n_nationkey").cast("double"))), "n_regionkey", ("n_nationkey",), None, "features")
    at = scratch_path(s, "arrays").replace("file:///", "/").replace("file:/", "/")
    store.write_npy(t.frames(), at)
    back = store.read_npy(s, f"file://{at}")
    key = F.regexp_extract("path", r"(\d{8})\.npy$", 1).cast("int")
    return back.select(key.alias("traj_id"), "frame", F.col("features")[0].alias("v"))


QUERIES.update(geo.QUERIES)
ORACLE.update(geo.ORACLE)
