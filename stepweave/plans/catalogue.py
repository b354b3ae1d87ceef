"""Every query by name, with the SQL that gives the same rows where SQL can: the SQL takes other ways than the plans do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import clustering, model, network, patterns, plotdata, prepare, resample, scaling, transitions
from ..operators.sequences import Sequences, bounded, from_wide, glued, to_wide, width_of
from ..sources.tables import conversations, event_sessions, orders, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIGITS = 9


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """-0 becomes 0, so that both engines write the same."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in columns})


def _edges(m: model.Model) -> DataFrame:
    return _rounded(m.weights.select(*m.groups, "from_state", "to_state", "weight"), "weight")


def _e(spark, d, **o) -> Sequences:
    return event_sessions(spark, d, **o).sequences


# Common tables of the SQL: e, o and c are the sequences of events, orders and conversations; g has groups.

E = """
ev AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
         OR date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) > 86400000000 THEN 1 ELSE 0 END AS st FROM events),
es AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sn FROM ev),
el AS (SELECT *, CAST(user_id AS VARCHAR) || '_' || CAST(CAST(sn AS BIGINT) AS VARCHAR) AS seq,
         CAST(row_number() OVER (PARTITION BY user_id, sn ORDER BY ts, event_id) - 1 AS INTEGER) AS p, event_type AS s FROM es),
e AS (SELECT seq, p, s FROM el)"""
O = """o AS (SELECT o_custkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS p, o_orderpriority AS s FROM orders)"""  # noqa: E741
C = """c AS (SELECT conv_id AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, role AS s FROM conversations)"""
G = O + """, g AS (SELECT o.seq, o.p, o.s, c_mktsegment AS grp FROM o JOIN customer ON c_custkey = seq)"""


def _pairs(t: str, on: str, weight: str = "1.0", grp: str = "", back: bool = False) -> str:
    """SQL of counted pairs of places of the sequences of t."""
    a, b = ("b", "a") if back else ("a", "b")
    g = f"a.{grp}, " if grp else ""
    return f"SELECT {g}{a}.s AS f, {b}.s AS t, CAST(sum({weight}) AS DOUBLE) AS n FROM {t} a JOIN {t} b ON a.seq = b.seq AND {on} GROUP BY ALL"


def _full(t: str, counts: str, grp: str = "", normal: bool = True) -> str:
    """SQL tables k (counts), l (labels), w (dense weights) on top of t."""
    g = f"{grp}, " if grp else ""
    names = f"(SELECT DISTINCT {grp} FROM {t})" if grp else "(SELECT 1)"
    total = f"sum(coalesce(n, 0)) OVER (PARTITION BY {g}a.s)"
    value = f"CASE WHEN {total} = 0 THEN 0 ELSE coalesce(n, 0) / {total} END" if normal else "coalesce(n, 0)"
    on = f" AND k.{grp} = n_.{grp}" if grp else ""
    g2 = f"n_.{grp} AS {grp}, " if grp else ""
    value = value.replace(f"PARTITION BY {g}", f"PARTITION BY n_.{grp}, " if grp else "PARTITION BY ")
    return f"""k AS ({counts}), l AS (SELECT DISTINCT s FROM {t}),
w AS (SELECT {g2}a.s AS from_state, b.s AS to_state, CAST({value} AS DOUBLE) AS weight FROM l a CROSS JOIN l b CROSS JOIN {names} n_ LEFT JOIN k ON k.f = a.s AND k.t = b.s{on})"""


def _sql(base: str, *more: str, select: str = "SELECT from_state, to_state, round(weight, 9) + 0.0 AS weight FROM w") -> str:
    return "WITH " + ",\n".join([base.strip(), *more]) + "\n" + select


NEXT = "b.p = a.p + 1"
E_REL, E_FREQ = _full("e", _pairs("e", NEXT)), _full("e", _pairs("e", NEXT), normal=False)
O_REL, C_REL = _full("o", _pairs("o", NEXT)), _full("c", _pairs("c", NEXT))
ALL = "a.p < b.p"
COOC = """SELECT f, t, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT a.s AS f, b.s AS t, count(*) AS n FROM {t} a JOIN {t} b ON a.seq = b.seq AND a.p < b.p GROUP BY ALL
UNION ALL SELECT b.s, a.s, count(*) FROM {t} a JOIN {t} b ON a.seq = b.seq AND a.p < b.p AND a.s <> b.s GROUP BY ALL) GROUP BY ALL"""
COOC_G = COOC.replace("SELECT f, t,", "SELECT grp, f, t,").replace("SELECT a.s", "SELECT a.grp AS grp, a.s").replace("SELECT b.s", "SELECT a.grp, b.s")


# Preparation


@query("session_assign", _sql(E, select="SELECT event_id, seq AS session_id, p AS raw_pos FROM el"))
def _(spark, d):
    return event_sessions(spark, d).long.select("event_id", "session_id", F.col("raw_pos").cast("int").alias("raw_pos"))


@query("session_stats", _sql(E, select="""SELECT (SELECT count(DISTINCT seq) FROM e) AS n_sessions, (SELECT count(DISTINCT user_id) FROM events) AS n_actors, (SELECT count(*) FROM events) AS n_events,
(SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY seq)) AS max_length, round((SELECT avg(n) FROM (SELECT count(*) AS n FROM e GROUP BY seq)), 9) AS mean_length, (SELECT count(DISTINCT s) FROM e) AS n_unique_actions"""))
def _(spark, d):
    return _rounded(event_sessions(spark, d).statistics(), "mean_length")


@query("action_frequencies", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return event_sessions(spark, d).action_frequencies()


@query("unix_time_parse", "SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 AS text FROM events")
def _(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("event_id", us.alias("us"), F.date_format(F.col("ts").cast("timestamp"), "dd/MM/yyyy HH:mm:ss").alias("text"))
    at = prepare.parsed_time
    rows = rows.withColumn("ms_", F.floor(F.col("us") / 1000)).withColumn("s_", F.floor(F.col("us") / 1_000_000))
    return rows.select(
        "event_id", F.unix_millis(at(F.col("ms_"), is_unix_time=True, unix_time_unit="milliseconds")).alias("ms"), F.unix_micros(at(F.col("us"), is_unix_time=True, unix_time_unit="microseconds")).alias("us"),
        F.unix_seconds(at(F.col("s_"), is_unix_time=True)).alias("s"), F.unix_seconds(at(F.col("text"), "%d/%m/%Y %H:%M:%S")).alias("text"),
    )


@query("multi_actor_sessions", """WITH a AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) || '_' || event_type AS who FROM events),
b AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY who ORDER BY ts, event_id) IS NULL OR date_diff('microsecond', lag(ts) OVER (PARTITION BY who ORDER BY ts, event_id), ts) > 86400000000 THEN 1 ELSE 0 END AS st FROM a)
SELECT event_id, who || '_' || CAST(CAST(sum(st) OVER (PARTITION BY who ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS VARCHAR) AS session_id FROM b""")
def _(spark, d):
    return event_sessions(spark, d, actor=["user_id", "event_type"]).long.select("event_id", "session_id")


@query("session_meta_first", _sql(E, select="SELECT seq AS session_id, arg_min(user_id, p) AS user_id, arg_min(value, p) FILTER (WHERE value IS NOT NULL) AS value, arg_min(props, p) FILTER (WHERE props IS NOT NULL) AS props FROM el GROUP BY seq"))
def _(spark, d):
    return event_sessions(spark, d).meta_data(["user_id", "value", "props"])


# Wide tables have as many columns as the longest session has places; these two are held against SQL by all cells of a
# row in one text, and the _all queries return them as they are.


def _joined(wide: DataFrame, value=lambda c: F.col(c)) -> DataFrame:
    cells = F.array(*[value(c) for c in wide.columns[1:]])
    return wide.select("session_id", F.lit(len(wide.columns) - 1).alias("places"), F.concat_ws(",", F.transform(cells, lambda x: F.coalesce(x.cast("string"), F.lit("-")))).alias("cells"))


_CELLS = """ws AS (SELECT seq, max(p) + 1 AS n, string_agg({cell}, ',' ORDER BY p) AS t FROM el GROUP BY seq), wn AS (SELECT max(n) AS m FROM ws)"""
_ROW = "SELECT seq AS session_id, CAST(m AS INTEGER) AS places, t || repeat(',-', CAST(m - n AS INTEGER)) AS cells FROM ws CROSS JOIN wn"


@query("sequences_wide", _sql(E, _CELLS.format(cell="s"), select=_ROW))
def _(spark, d):
    return _joined(event_sessions(spark, d).sequence_data())


@query("time_wide", _sql(E, _CELLS.format(cell="CAST(epoch_us(ts) AS VARCHAR)"), select=_ROW))
def _(spark, d):
    return _joined(event_sessions(spark, d).time_data(), lambda c: F.unix_micros(F.col(c).cast("timestamp")))


# The same with a column a place, as many as the longest session has.
_WIDE = "PIVOT (SELECT seq AS session_id, '{name}_' || (p + 1) AS place, {cell} AS cell FROM el) ON place USING max(cell) GROUP BY session_id"


@query("sequences_wide_all", _sql(E, select=_WIDE.format(name="action", cell="s")))
def _(spark, d):
    return event_sessions(spark, d).sequence_data()


@query("time_wide_all", _sql(E, select=_WIDE.format(name="time", cell="epoch_us(ts)")))
def _(spark, d):
    rows = event_sessions(spark, d).time_data()
    return rows.select("session_id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in rows.columns[1:]])


@query("sequences_long", _sql(E, select="SELECT seq AS session_id, p AS raw_pos, s AS state FROM e"))
def _(spark, d):
    return event_sessions(spark, d).long.select("session_id", F.col("raw_pos").cast("int").alias("raw_pos"), "state")


@query("wide_round_trip", _sql(C, select="SELECT seq AS seq_id, CAST(p AS INTEGER) AS raw_pos, s AS state FROM c"))
def _(spark, d):
    wide = to_wide(conversations(spark, d))
    return from_wide(wide, wide.columns[1:], "seq_id").present().select("seq_id", "raw_pos", "state")


@query("seq_concat", _sql(O, select="SELECT seq // 2 AS seq_id, CAST(p + (seq % 2) * 50 AS INTEGER) AS raw_pos, s AS state FROM o"))
def _(spark, d):
    seqs = orders(spark, d)
    width = max(50, width_of(seqs))  # the SQL's places, and more where a customer has more orders
    return glued(Sequences(seqs.frame.withColumn("number", F.col("seq_id"))), "number", 2, width).frame


@query("seq_begin_end", _sql(O, select="""SELECT seq AS seq_id, CAST(p AS INTEGER) AS raw_pos, s AS state FROM o UNION ALL SELECT DISTINCT seq, -1, 'begin' FROM o
UNION ALL SELECT DISTINCT seq, CAST((SELECT max(p) + 1 FROM o) AS INTEGER), 'end' FROM o"""))
def _(spark, d):
    return bounded(orders(spark, d), "begin", "end").frame.select("seq_id", F.col("raw_pos").cast("int").alias("raw_pos"), "state")


# One-hot windows

H = """h0 AS (SELECT user_id AS u, CAST(ts AS DATE) AS day, {cols} FROM events GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY day) - 1 AS r FROM h0)"""
KINDS = ("click", "error", "purchase", "signup", "view")
H = H.format(cols=", ".join(f"max(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS {k}" for k in KINDS))


def _long(t: str, expr: str, w: str, place: str) -> str:
    parts = [f"SELECT u AS user_id, CAST({w} AS INTEGER) AS w, CAST({place} + {k} AS INTEGER) AS raw_pos, CASE WHEN {expr.format(c=c)} = 1 THEN '{c}' END AS state FROM {t}" for k, c in enumerate(KINDS)]
    return " UNION ALL ".join(parts)


def _kinds(spark: SparkSession, d: str) -> list[str]:
    """The types of events that there are: as many as the model has states. The SQL knows those of the test tables."""
    return sorted(r[0] for r in table(spark, d, "events").select("event_type").where("event_type is not null").distinct().collect())


def _days(spark: SparkSession, d: str, kinds: list[str]) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return rows.groupBy("user_id", "day").agg(*[F.max(F.when(F.col("event_type") == k, 1).otherwise(0)).alias(k) for k in kinds])


def _onehot(spark, d, **o) -> DataFrame:
    kinds = _kinds(spark, d)
    seqs, _ = prepare.onehot(_days(spark, d, kinds), kinds, ["day"], actor="user_id", **o)
    return seqs.frame.select("user_id", "w", "raw_pos", "state")


@query("onehot_tumbling", _sql(H, select=_long("h", "{c}", "r // 2", "(r // 2) * 10 + (r % 2) * 5")))
def _(spark, d):
    return _onehot(spark, d, window_size=2)


@query("onehot_tumbling_agg", _sql(H, "m AS (SELECT u, r // 3 AS r, " + ", ".join(f"max({k}) AS {k}" for k in KINDS) + " FROM h GROUP BY 1, 2)", select=_long("m", "{c}", "r", "r * 5")))
def _(spark, d):
    return _onehot(spark, d, window_size=3, aggregate=True)


def _slid(t: str, out: str, by: int) -> str:
    return f"{out} AS (SELECT u, day, r, " + ", ".join(f"greatest({k}, coalesce(lag({k}, {by}) OVER (PARTITION BY u ORDER BY day), 0)) AS {k}" for k in KINDS) + f" FROM {t})"


@query("onehot_sliding2", _sql(H, _slid("h", "m", 1), select=_long("(SELECT * FROM m WHERE r > 0)", "{c}", "r - 1", "(r - 1) * 5")))
def _(spark, d):
    return _onehot(spark, d, window_size=2, window_type="sliding")


@query("onehot_sliding3", _sql(H, _slid("h", "m", 1), _slid("m", "m2", 2), select=_long("(SELECT * FROM m2 WHERE r > 0)", "{c}", "r - 1", "(r - 1) * 5")))
def _(spark, d):
    return _onehot(spark, d, window_size=3, window_type="sliding")


# Models


@query("model_relative", _sql(E, E_REL))
def _(spark, d):
    return _edges(model.tna(_e(spark, d)))


@query("model_frequency", _sql(E, E_FREQ))
def _(spark, d):
    return _edges(model.ftna(_e(spark, d)))


@query("model_reverse", _sql(E, _full("e", _pairs("e", NEXT, back=True))))
def _(spark, d):
    return _edges(model.build_model(_e(spark, d), "reverse"))


@query("model_ngram3", _sql(O, _full("o", _pairs("o", "b.p = a.p + 2"))))
def _(spark, d):
    return _edges(model.build_model(orders(spark, d), "n-gram", n=3))


@query("model_gap", _sql(O, _full("o", _pairs("o", "b.p BETWEEN a.p + 1 AND a.p + 5", "pow(0.5, b.p - a.p - 1)"))))
def _(spark, d):
    return _edges(model.build_model(orders(spark, d), "gap"))


@query("model_window3", _sql(O, "n AS (SELECT seq, count(*) AS n FROM o GROUP BY 1)", "v AS (SELECT seq, unnest(range(0, n - 2)) AS a FROM n WHERE n >= 3)",
    _full("o", "SELECT a.s AS f, b.s AS t, CAST(count(*) AS DOUBLE) AS n FROM v JOIN o a ON a.seq = v.seq AND a.p BETWEEN v.a AND v.a + 2 JOIN o b ON b.seq = v.seq AND b.p > a.p AND b.p <= v.a + 2 GROUP BY ALL")))
def _(spark, d):
    return _edges(model.build_model(orders(spark, d), "window", size=3))


@query("model_attention", _sql(O, _full("o", _pairs("o", ALL, "exp(-1.0 * (b.p - a.p))"), normal=False), select="SELECT from_state, to_state, round(weight, 6) AS weight FROM w"))
def _(spark, d):
    return model.atna(orders(spark, d)).weights.select("from_state", "to_state", F.round("weight", 6).alias("weight"))


@query("model_cooccurrence", _sql(O, _full("o", COOC.format(t="o"), normal=False)))
def _(spark, d):
    return _edges(model.ctna(orders(spark, d)))


@query("model_cooc_windowed", _sql(E, _full("e", _pairs("e", "a.p // 6 = b.p // 6"), normal=False)))
def _(spark, d):
    return _edges(model.ctna(_e(spark, d), windowed=True, window_size=2, window_span=3))


@query("model_onehot_ctna", _sql(H, f"e AS (SELECT user_id AS seq, raw_pos AS p, state AS s FROM ({_long('h', '{c}', 'r // 2', '(r // 2) * 10 + (r % 2) * 5')}) WHERE state IS NOT NULL)", _full("e", _pairs("e", "a.p // 10 = b.p // 10"), normal=False)))
def _(spark, d):
    kinds = _kinds(spark, d)
    seqs, params = prepare.onehot(_days(spark, d, kinds), kinds, ["day"], actor="user_id", window_size=2)
    return _edges(model.ctna(seqs, **params))


@query("model_some_labels", _sql(E, "l2 AS (SELECT DISTINCT s FROM e WHERE s IN ('click', 'view'))", f"k AS ({_pairs('e', NEXT)})",
    "w AS (SELECT a.s AS from_state, b.s AS to_state, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY a.s) AS weight FROM l2 a CROSS JOIN l2 b LEFT JOIN k ON k.f = a.s AND k.t = b.s)"))
def _(spark, d):
    return _edges(model.tna(_e(spark, d), labels=["click", "view"]))


def _ends(t: str, pick: str) -> str:
    return f"SELECT s AS state, round(count(*) / (SELECT count(DISTINCT seq) FROM {t}), 9) AS prob FROM (SELECT seq, {pick}(s, p) AS s FROM {t} GROUP BY seq) GROUP BY s"


@query("inits_first", _sql(E, select=_ends("e", "arg_min")))
def _(spark, d):
    return _rounded(model.tna(_e(spark, d)).inits, "prob")


@query("inits_last", _sql(E, select=_ends("e", "arg_max")))
def _(spark, d):
    return _rounded(model.build_model(_e(spark, d), "reverse").inits, "prob")


_SUMMARY = """SELECT {g}count(DISTINCT from_state) AS n_states, count(*) FILTER (WHERE weight > 0) AS n_edges, round(count(*) FILTER (WHERE weight > 0) / count(*), 9) AS density, round(avg(weight) FILTER (WHERE weight > 0), 9) AS mean_weight,
round(max(weight), 9) AS max_weight, bool_or(weight > 0 AND from_state = to_state) AS has_self_loops FROM w"""


@query("model_summary", _sql(E, E_REL, select=_SUMMARY.format(g="")))
def _(spark, d):
    return _rounded(model.tna(_e(spark, d)).summary(), "density", "mean_weight", "max_weight")


@query("model_matrix_pivot", _sql(E, E_REL, select="SELECT from_state, " + ", ".join(f"round(max(CASE WHEN to_state = '{k}' THEN weight END), 9) AS {k}" for k in KINDS) + " FROM w GROUP BY 1"))
def _(spark, d):
    kinds = _kinds(spark, d)
    return _rounded(model.tna(_e(spark, d)).to_dataframe(kinds), *kinds)


@query("model_from_matrix", _sql(E, E_REL))
def _(spark, d):
    counted = transitions.adjacent(_e(spark, d)).withColumnRenamed("n", "weight")
    return _edges(model.from_matrix(counted))


# Scaling


@query("scale_minmax", _sql(E, E_FREQ, select="SELECT from_state, to_state, round((weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()), 9) AS weight FROM w"))
def _(spark, d):
    return _edges(model.ftna(_e(spark, d), scaling="minmax"))


@query("scale_max", _sql(E, E_FREQ, select="SELECT from_state, to_state, round(weight / max(weight) OVER (), 9) AS weight FROM w"))
def _(spark, d):
    return _edges(model.ftna(_e(spark, d), scaling="max"))


_RANK = "CASE WHEN weight = 0 THEN 0 ELSE (SELECT count(*) FROM w b WHERE b.weight < w.weight) + (SELECT count(*) + 1 FROM w b WHERE b.weight = w.weight) / 2 END"


@query("scale_rank", _sql(C, _full("c", _pairs("c", NEXT), normal=False), select=f"SELECT from_state, to_state, CAST({_RANK} AS DOUBLE) AS weight FROM w"))
def _(spark, d):
    return _edges(model.ftna(conversations(spark, d), scaling="rank"))


@query("scale_chain", _sql(C, _full("c", _pairs("c", NEXT), normal=False), f"x AS (SELECT from_state, to_state, {_RANK} AS weight FROM w)", select="SELECT from_state, to_state, round((weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()), 9) AS weight FROM x"))
def _(spark, d):
    return _edges(model.ftna(conversations(spark, d), scaling=["rank", "MinMax"]))


@query("prune_edges", _sql(E, E_REL, select="SELECT from_state, to_state, round(CASE WHEN weight < 0.2 THEN 0 ELSE weight END, 9) AS weight FROM w"))
def _(spark, d):
    return _edges(model.tna(_e(spark, d)).pruned(0.2))


@query("weight_distances", _sql(E, E_REL, select="SELECT from_state, to_state, round(-ln(weight), 9) AS distance FROM w WHERE weight > 0"))
def _(spark, d):
    rows = scaling.distance_from_weights(model.tna(_e(spark, d)).weights).where("weight > 0")
    return _rounded(rows.select("from_state", "to_state", "distance"), "distance")


# Graphs

PATHS = """x{k} AS (SELECT from_state AS f, to_state AS t, {w} AS weight FROM w WHERE from_state <> to_state),
y{k} AS (SELECT f, t, 1.0 / weight AS d FROM x{k} WHERE weight > 0),
r{k} AS (SELECT f, t, d, [f, t] AS path FROM y{k} UNION ALL SELECT r.f, y.t, r.d + y.d, list_append(r.path, y.t) FROM r{k} r JOIN y{k} y ON y.f = r.t WHERE NOT list_contains(r.path, y.t)),
b{k} AS (SELECT f, t, min(d) AS d FROM r{k} GROUP BY 1, 2)"""


def _paths(base: str, weights: str, select: str, w: str = "weight") -> str:
    return "WITH RECURSIVE " + ",\n".join([base.strip(), weights, PATHS.format(w=w, k="")]) + "\n" + select


_CLOSE = "SELECT s AS state, round(coalesce((SELECT 1 / sum(d) FROM b WHERE b.{side} = l.s), 0), 9) AS value FROM l"
_BOTH = "greatest(weight, (SELECT weight FROM w v WHERE v.from_state = w.to_state AND v.to_state = w.from_state))"


def _measure(m: model.Model, *names: str, **o) -> DataFrame:
    return _rounded(network.centralities(m, list(names), **o).select(*m.groups, "state", "measure", "value"), "value")


@query("cent_strength", _sql(E, E_REL, select="""SELECT from_state AS state, 'OutStrength' AS measure, round(sum(weight) FILTER (WHERE from_state <> to_state), 9) AS value FROM w GROUP BY 1
UNION ALL SELECT to_state, 'InStrength', round(sum(weight) FILTER (WHERE from_state <> to_state), 9) FROM w GROUP BY 1"""))
def _(spark, d):
    return _measure(model.tna(_e(spark, d)), "OutStrength", "InStrength")


@query("cent_strength_loops", _sql(E, E_REL, select="SELECT to_state AS state, 'InStrength' AS measure, round(sum(weight), 9) AS value FROM w GROUP BY 1"))
def _(spark, d):
    return _measure(model.tna(_e(spark, d)), "InStrength", loops=True)


@query("cent_closeness_out", _paths(O, O_REL, _CLOSE.format(side="f")))
def _(spark, d):
    return _measure(model.tna(orders(spark, d)), "ClosenessOut").drop("measure")


@query("cent_closeness_in", _paths(O, O_REL, _CLOSE.format(side="t")))
def _(spark, d):
    return _measure(model.tna(orders(spark, d)), "ClosenessIn").drop("measure")


@query("cent_closeness", _paths(O, O_REL, _CLOSE.format(side="f"), _BOTH))
def _(spark, d):
    return _measure(model.tna(orders(spark, d)), "Closeness").drop("measure")


_BEST = ", best AS (SELECT r.f, r.t, r.path, count(*) OVER (PARTITION BY r.f, r.t) AS n FROM r JOIN b ON b.f = r.f AND b.t = r.t AND b.d = r.d)"


@query("cent_betweenness", _paths(C, C_REL, _BEST + " SELECT s AS state, round(coalesce((SELECT sum(1.0 / n) FROM best WHERE f <> l.s AND t <> l.s AND list_contains(path, l.s)), 0), 9) AS value FROM l").replace("\n, best", ", best"))
def _(spark, d):
    return _measure(model.tna(conversations(spark, d)), "Betweenness").drop("measure")


@query("edge_betweenness", _paths(C, C_REL, _BEST + """ SELECT from_state, to_state, round(coalesce((SELECT sum(1.0 / n) FROM best WHERE w.from_state <> w.to_state AND list_contains(path, from_state)
AND list_position(path, to_state) = list_position(path, from_state) + 1), 0), 9) AS weight FROM w""").replace("\n, best", ", best"))
def _(spark, d):
    return _edges(network.betweenness_network(model.tna(conversations(spark, d))))


def _diffused(steps: int) -> str:
    parts = ["v0 AS (SELECT s, 1.0 AS x FROM l)"] + [f"v{k} AS (SELECT from_state AS s, sum(weight * x) AS x FROM w JOIN v{k - 1} ON s = to_state WHERE from_state <> to_state GROUP BY 1)" for k in range(1, steps + 1)]
    return ",\n".join(parts)


@query("cent_diffusion", _sql(E, E_REL, _diffused(5), select="SELECT s AS state, round(sum(x), 9) AS value FROM (" + " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(1, 6)) + ") GROUP BY 1"))
def _(spark, d):
    return _rounded(network.diffusion(model.tna(_e(spark, d)), len(_kinds(spark, d))), "value")


_CLUSTERING = [
    "z AS (SELECT w.from_state AS f, w.to_state AS t, CASE WHEN w.from_state = w.to_state THEN 0 ELSE w.weight + v.weight END AS m FROM w JOIN w v ON v.from_state = w.to_state AND v.to_state = w.from_state)",
    "num AS (SELECT a.f AS s, sum(a.m * b.m * c.m) AS n FROM z a JOIN z b ON b.f = a.t JOIN z c ON c.f = b.t AND c.t = a.f GROUP BY 1)", "den AS (SELECT t AS s, pow(sum(m), 2) - sum(m * m) AS d FROM z GROUP BY 1)",
]


@query("cent_clustering", _sql(E, E_REL, *_CLUSTERING,
    select="SELECT s AS state, round(n / d, 9) AS value FROM num JOIN den USING (s)"))
def _(spark, d):
    return _measure(model.tna(_e(spark, d)), "Clustering").drop("measure")


@query("cent_normalized", _sql(E, E_REL, "i AS (SELECT to_state AS state, sum(weight) FILTER (WHERE from_state <> to_state) AS v FROM w GROUP BY 1)", select="SELECT state, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 9) AS value FROM i"))
def _(spark, d):
    return _measure(model.tna(_e(spark, d)), "InStrength", normalize=True).drop("measure")


# Randomised shortest paths: the sum of all powers of the killed matrix by doubling, then visits of each node over all pairs.


def _times(a: str, b: str) -> str:
    return f"SELECT a.f, b.t, sum(a.x * b.x) AS x FROM {a} a JOIN {b} b ON b.f = a.t GROUP BY 1, 2"


def _rsp(doublings: int = 14) -> list[str]:
    out = ["r0 AS (SELECT from_state AS f, to_state AS t, CASE WHEN from_state = to_state THEN 0 ELSE weight END AS x FROM w)",
           "p0 AS (SELECT f, t, CASE WHEN x > 0 THEN x / sum(x) OVER (PARTITION BY f) * exp(-0.01 / x) ELSE 0 END AS x FROM r0)",
           "s0 AS (SELECT f, t, CASE WHEN f = t THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM r0)"]
    for k in range(doublings):
        out += [f"m{k} AS ({_times(f's{k}', f'p{k}')})", f"s{k + 1} AS (SELECT a.f, a.t, a.x + b.x AS x FROM s{k} a JOIN m{k} b USING (f, t))", f"p{k + 1} AS ({_times(f'p{k}', f'p{k}')})"]
    z = f"s{doublings}"
    return [*out, f"vi AS (SELECT i.f AS state, sum((si.x / st.x - ti.x / tt.x) * i.x) AS x FROM {z} i JOIN {z} tt ON tt.f = i.t AND tt.t = i.t JOIN {z} st ON st.t = i.t JOIN {z} si ON si.f = st.f AND si.t = i.f JOIN {z} ti ON ti.f = i.t AND ti.t = i.f GROUP BY 1)"]


@query("cent_rsp", _sql(E, E_REL, *_rsp(), select="SELECT state, round_even(x, 0) - min(round_even(x, 0)) OVER () + 1 AS value FROM vi"))
def _(spark, d):
    return _measure(model.tna(_e(spark, d)), "BetweennessRSP").drop("measure")


def _all_measures() -> str:
    parts = [E.strip(), E_REL, PATHS.format(w="weight", k=""), _BEST.removeprefix(", "), PATHS.format(w=_BOTH, k="_both"), *_rsp(), _diffused(5), *_CLUSTERING]
    values = {
        "OutStrength": "(SELECT sum(weight) FROM w WHERE from_state = l.s AND to_state <> l.s)",
        "InStrength": "(SELECT sum(weight) FROM w WHERE to_state = l.s AND from_state <> l.s)",
        "ClosenessIn": "coalesce((SELECT 1 / sum(d) FROM b WHERE t = l.s), 0)",
        "ClosenessOut": "coalesce((SELECT 1 / sum(d) FROM b WHERE f = l.s), 0)",
        "Closeness": "coalesce((SELECT 1 / sum(d) FROM b_both WHERE f = l.s), 0)",
        "Betweenness": "coalesce((SELECT sum(1.0 / n) FROM best WHERE f <> l.s AND t <> l.s AND list_contains(path, l.s)), 0)",
        "BetweennessRSP": "(SELECT round_even(x, 0) - (SELECT min(round_even(x, 0)) FROM vi) + 1 FROM vi WHERE vi.state = l.s)",
        "Diffusion": "(SELECT sum(x) FROM (" + " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(1, 6)) + ") v WHERE v.s = l.s)",
        "Clustering": "(SELECT n / d FROM num JOIN den USING (s) WHERE num.s = l.s)",
    }
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT s AS state, " + ", ".join(f"round(CAST({v} AS DOUBLE), 9) AS {k}" for k, v in values.items()) + " FROM l"


@query("cent_all_wide", _all_measures())
def _(spark, d):
    found = network.wide(network.centralities(model.tna(_e(spark, d))))
    return _rounded(found, *found.columns[1:])


_MUTUAL = "q AS (SELECT a.from_state AS i, a.to_state AS j FROM w a JOIN w b ON b.from_state = a.to_state AND b.to_state = a.from_state WHERE a.weight > 0.19 AND b.weight > 0.19 AND a.from_state < a.to_state)"


@query("cliques_2", _sql(E, E_REL, _MUTUAL, select="SELECT i AS state_1, j AS state_2 FROM q"))
def _(spark, d):
    return network.cliques(model.tna(_e(spark, d)), 2, 0.19)


@query("cliques_3", _sql(E, E_REL, _MUTUAL, select="SELECT a.i AS state_1, a.j AS state_2, b.j AS state_3 FROM q a JOIN q b ON b.i = a.j WHERE EXISTS (SELECT 1 FROM q c WHERE c.i = a.i AND c.j = b.j)"))
def _(spark, d):
    return network.cliques(model.tna(_e(spark, d)), 3, 0.19)


@query("communities_all")
def _(spark, d):
    from ..functions.graph import METHODS

    return network.communities(model.ftna(_e(spark, d)), tuple(METHODS))


# Groups

_GSEL = "SELECT grp, from_state, to_state, round(weight, {n}) AS weight FROM w"
G_REL = _full("g", _pairs("g", NEXT, grp="grp"), "grp")
G_FREQ = _full("g", _pairs("g", NEXT, grp="grp"), "grp", normal=False)


@query("group_relative", _sql(G, G_REL, select=_GSEL.format(n=9)))
def _(spark, d):
    return _edges(model.group_tna(orders(spark, d, segments=True), "grp"))


@query("group_frequency", _sql(G, G_FREQ, select=_GSEL.format(n=9)))
def _(spark, d):
    return _edges(model.group_ftna(orders(spark, d, segments=True), "grp"))


@query("group_cooccurrence", _sql(G, _full("g", COOC_G.format(t="g"), "grp", normal=False), select=_GSEL.format(n=9)))
def _(spark, d):
    return _edges(model.group_ctna(orders(spark, d, segments=True), "grp"))


@query("group_attention", _sql(G, _full("g", _pairs("g", ALL, "exp(-0.5 * (b.p - a.p))", grp="grp"), "grp", normal=False), select=_GSEL.format(n=6)))
def _(spark, d):
    m = model.group_atna(orders(spark, d, segments=True), "grp", beta=0.5)
    return m.weights.select("grp", "from_state", "to_state", F.round("weight", 6).alias("weight"))


@query("group_summary", _sql(G, G_REL, select=_SUMMARY.format(g="grp, ") + " GROUP BY grp"))
def _(spark, d):
    return _rounded(model.group_tna(orders(spark, d, segments=True), "grp").summary(), "density", "mean_weight", "max_weight")


@query("group_centralities", _sql(G, G_REL, select="SELECT grp, to_state AS state, 'InStrength' AS measure, round(sum(weight) FILTER (WHERE from_state <> to_state), 9) AS value FROM w GROUP BY 1, 2"))
def _(spark, d):
    return _measure(model.group_tna(orders(spark, d, segments=True), "grp"), "InStrength")


@query("group_inits", _sql(G, select="SELECT grp, s AS state, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 9) AS prob FROM g WHERE p = 0 GROUP BY 1, 2"))
def _(spark, d):
    return _rounded(model.group_tna(orders(spark, d, segments=True), "grp").inits.where("prob > 0"), "prob")


@query("group_renamed", _sql(G, G_REL, select="SELECT CASE grp WHEN 'FURNITURE' THEN 'chairs' ELSE grp END AS grp, from_state, to_state, round(CASE WHEN weight < 0.2 THEN 0 ELSE weight END, 9) AS weight FROM w"))
def _(spark, d):
    return _edges(model.group_tna(orders(spark, d, segments=True), "grp").renamed({"FURNITURE": "chairs"}).pruned(0.2))


@query("group_communities")
def _(spark, d):
    return network.communities(model.group_ftna(orders(spark, d, segments=True), "grp"), ("leading_eigen", "fast_greedy"))


# Patterns

_RUNS = """u AS (SELECT seq, grp, p, s, lead(s, 1) OVER x AS s1, lead(s, 2) OVER x AS s2 FROM g WINDOW x AS (PARTITION BY seq ORDER BY p)),
t AS (SELECT seq, grp, 1 AS length, s AS pattern FROM u UNION ALL SELECT seq, grp, 2, s || '->' || s1 FROM u WHERE s1 IS NOT NULL UNION ALL SELECT seq, grp, 3, s || '->' || s1 || '->' || s2 FROM u WHERE s2 IS NOT NULL),
f AS (SELECT a.length, a.pattern, b.grp, count(t.seq) AS n FROM (SELECT DISTINCT length, pattern FROM t) a CROSS JOIN (SELECT DISTINCT grp FROM g) b LEFT JOIN t ON t.pattern = a.pattern AND t.length = a.length AND t.grp = b.grp GROUP BY ALL)"""
_STAT = """m AS (SELECT *, sum(n) OVER (PARTITION BY length, pattern) AS pn, sum(n) OVER (PARTITION BY grp) AS gn, sum(n) OVER () AS an FROM f)"""


@query("patterns_compare", _sql(G, _RUNS, select="""SELECT pattern, length, grp, freq, prop FROM (SELECT pattern, length, grp, n AS freq, round(n / sum(n) OVER (PARTITION BY length, grp), 9) AS prop,
min(n) OVER (PARTITION BY length, pattern) AS least FROM f) WHERE least >= 5"""))
def _(spark, d):
    return _rounded(patterns.compare(orders(spark, d, segments=True), "grp", (1, 2, 3)), "prop")


@query("patterns_occurrences", _sql(G, _RUNS, select="SELECT length, pattern, count(*) AS n FROM t GROUP BY 1, 2"))
def _(spark, d):
    return patterns.occurrences(orders(spark, d, segments=True), (1, 2, 3)).groupBy("length", "pattern").agg(F.count("*").alias("n"))


@query("patterns_statistic", _sql(G, _RUNS, _STAT, select="SELECT length, pattern, round(sqrt(sum(pow(n - pn * gn / an, 2))), 7) AS statistic FROM m GROUP BY 1, 2"))
def _(spark, d):
    seqs = orders(spark, d, segments=True)
    runs = patterns.occurrences(seqs, (1, 2, 3)).groupBy("length", "pattern", "grp").agg(F.count("*").alias("n"))
    freqs = patterns.filled(runs, seqs.frame.select("grp").distinct(), "grp")
    return patterns.statistic(freqs, "grp").select("length", "pattern", F.round("statistic", 7).alias("statistic"))


# Replicates, by multiplicities and sides that a hash of whole numbers gives

REPS = 20
_MD5 = "(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) / 4294967296e0)"
_U = _MD5.format(key="CAST(seq AS VARCHAR) || ' ' || CAST(rep AS VARCHAR)")
# fixed values: the distribution function of a Poisson variable of mean 1, at 0 to 9
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217)
_TIMES_OF = f"CASE {' '.join(f'WHEN {_U} < {end!r}e0 THEN {k}' for k, end in enumerate(_POISSON))} ELSE {len(_POISSON)} END"
BOOT = O_REL + f""",
ml AS (SELECT seq, rep, {_TIMES_OF} AS m FROM (SELECT DISTINCT seq FROM o) CROSS JOIN (SELECT unnest(range({REPS})) AS rep)),
bc AS (SELECT rep, a.s AS f, b.s AS t, sum(m) AS n FROM o a JOIN o b ON a.seq = b.seq AND b.p = a.p + 1 JOIN ml ON ml.seq = a.seq GROUP BY ALL),
bw AS (SELECT r.rep, w.from_state, w.to_state, w.weight AS w, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY r.rep, w.from_state) AS x FROM w CROSS JOIN (SELECT unnest(range({REPS})) AS rep) r LEFT JOIN bc ON bc.rep = r.rep AND f = from_state AND t = to_state)"""


def _u():
    return resample.uniform("seq_id", "rep")


def _boot(spark, d):
    m = model.tna(orders(spark, d))
    return m, resample.bootstrap_weights(m, REPS, resample.poisson_multiplicity("seq_id", "rep"))


_BSTAT = """SELECT from_state, to_state, round(any_value(w), 9) AS weight, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS sd, round(quantile_cont(x, 0.025), 9) AS ci_lower, round(quantile_cont(x, 0.975), 9) AS ci_upper,
round((sum({worse}) + 1) / {n}, 9) AS p_value FROM bw GROUP BY 1, 2"""
_STABLE = "CASE WHEN x <= w * 0.75 THEN 1 ELSE 0 END + CASE WHEN x >= w * 1.25 THEN 1 ELSE 0 END"


@query("bootstrap_edges", _sql(O, BOOT, select=_BSTAT.format(worse=_STABLE, n=float(REPS + 1))))
def _(spark, d):
    m, again = _boot(spark, d)
    return _rounded(resample.bootstrap(m, again).drop("sig"), "weight", "mean", "sd", "ci_lower", "ci_upper", "p_value")


@query("bootstrap_threshold", _sql(O, BOOT, select=_BSTAT.format(worse="CASE WHEN x < 0.2 THEN 1 ELSE 0 END", n=float(REPS + 1))))
def _(spark, d):
    m, again = _boot(spark, d)
    return _rounded(resample.bootstrap(m, again, method="threshold", threshold=0.2).drop("sig"), "weight", "mean", "sd", "ci_lower", "ci_upper", "p_value")


@query("bootstrap_centrality", _sql(O, BOOT, "bi AS (SELECT rep, to_state AS state, sum(x) FILTER (WHERE from_state <> to_state) AS v FROM bw GROUP BY 1, 2)",
    select="SELECT 'InStrength' AS measure, state, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS ci_lower, round(quantile_cont(v, 0.975), 9) AS ci_upper, round(stddev_samp(v), 9) AS se FROM bi GROUP BY state"))
def _(spark, d):
    m, again = _boot(spark, d)
    return _rounded(resample.bootstrap_centralities(m, again, ("InStrength",)), "mean", "ci_lower", "ci_upper", "se")


@query("ci_percentile", _sql(O, BOOT, select="SELECT from_state, to_state, round(quantile_cont(x, 0.025), 9) AS ci_lower, round(quantile_cont(x, 0.975), 9) AS ci_upper FROM bw GROUP BY 1, 2"))
def _(spark, d):
    return _rounded(stats.confidence_interval(_boot(spark, d)[1], "weight", ("from_state", "to_state")), "ci_lower", "ci_upper")


@query("ci_basic", _sql(O, BOOT, select="SELECT from_state, to_state, round(2 * avg(x) - quantile_cont(x, 0.975), 9) AS ci_lower, round(2 * avg(x) - quantile_cont(x, 0.025), 9) AS ci_upper FROM bw GROUP BY 1, 2"))
def _(spark, d):
    return _rounded(stats.confidence_interval(_boot(spark, d)[1], "weight", ("from_state", "to_state"), method="basic"), "ci_lower", "ci_upper")


PERM = f"""sd AS (SELECT seq, CAST(seq % 2 AS INTEGER) AS side, -1 AS rep FROM (SELECT DISTINCT seq FROM o) UNION ALL
SELECT seq, CAST(floor({_U} * 2) AS INTEGER), rep FROM (SELECT DISTINCT seq FROM o) CROSS JOIN (SELECT unnest(range({REPS})) AS rep)),
l AS (SELECT DISTINCT s FROM o), pk AS (SELECT rep, side, a.s AS f, b.s AS t, count(*) AS n FROM o a JOIN o b ON a.seq = b.seq AND b.p = a.p + 1 JOIN sd ON sd.seq = a.seq GROUP BY ALL),
pw AS (SELECT r.rep, r.side, a.s AS f, b.s AS t, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY r.rep, r.side, a.s) AS x FROM (SELECT DISTINCT rep, side FROM sd) r CROSS JOIN l a CROSS JOIN l b
  LEFT JOIN pk ON pk.rep = r.rep AND pk.side = r.side AND pk.f = a.s AND pk.t = b.s)"""
_PTEST = """SELECT {what}, round(max(CASE WHEN rep = -1 THEN diff END), 9) AS diff, round(max(CASE WHEN rep = -1 THEN diff END) / stddev_samp(CASE WHEN rep >= 0 THEN diff END), 6) AS effect_size,
round((sum(CASE WHEN rep >= 0 AND abs(diff) >= abs(real) THEN 1 ELSE 0 END) + 1) / {n}, 9) AS p_value FROM (SELECT *, max(CASE WHEN rep = -1 THEN diff END) OVER (PARTITION BY {what}) AS real FROM pd) GROUP BY ALL"""


def _perm(spark, d, measures=()):
    seqs = orders(spark, d)
    ids = seqs.frame.select("seq_id").distinct()
    real = ids.withColumn("side", F.pmod("seq_id", F.lit(2)).cast("string"))
    again = ids.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1)))).withColumn("side", F.floor(_u() * 2).cast("string"))
    return resample.permutation_test(seqs, "relative", real, again, "0", "1", measures=measures)


@query("perm_edges", _sql(O, PERM, "pd AS (SELECT rep, f AS from_state, t AS to_state, sum(CASE WHEN side = 0 THEN x ELSE -x END) AS diff FROM pw GROUP BY ALL)", select=_PTEST.format(what="from_state, to_state", n=float(REPS + 1))))
def _(spark, d):
    rows = _rounded(_perm(spark, d)[0].drop("diff_sig"), "diff", "p_value")
    return rows.withColumn("effect_size", F.round("effect_size", 6) + 0.0)


@query("perm_centrality", _sql(O, PERM, "pd AS (SELECT rep, t AS state, 'InStrength' AS measure, sum(CASE WHEN side = 0 THEN x ELSE -x END) FILTER (WHERE f <> t) AS diff FROM pw GROUP BY ALL)", select=_PTEST.format(what="state, measure", n=float(REPS + 1))))
def _(spark, d):
    rows = _rounded(_perm(spark, d, ("InStrength",))[1].drop("diff_sig"), "diff", "p_value")
    return rows.withColumn("effect_size", F.round("effect_size", 6) + 0.0)


@query("perm_summary", _sql(O, PERM, "pd AS (SELECT rep, f, t, sum(CASE WHEN side = 0 THEN x ELSE -x END) AS diff FROM pw GROUP BY ALL)", select="SELECT round(sqrt(sum(diff * diff)), 9) AS observed FROM pd WHERE rep = -1"))
def _(spark, d):
    return _rounded(resample.permutation_summary(_perm(spark, d)[0]).select("observed"), "observed")


# Two models, of even and odd customers: the calls that take models and sequences themselves.

_OWN = _MD5.format(key="CASE WHEN seq % 2 = 0 THEN 'x' ELSE 'y' END || ' ' || CAST(seq AS VARCHAR) || ' ' || CAST(rep AS VARCHAR) || ' 0'")
PERM2 = PERM.replace(f"CAST(floor({_U} * 2) AS INTEGER)", f"CASE WHEN {_OWN} < (SELECT count(DISTINCT seq) FROM o WHERE seq % 2 = 0) / (SELECT CAST(count(DISTINCT seq) AS DOUBLE) FROM o) THEN 0 ELSE 1 END")
_PD = "pd AS (SELECT rep, f AS from_state, t AS to_state, sum(CASE WHEN side = 0 THEN x ELSE -x END) AS diff FROM pw GROUP BY ALL)"


def _halves(spark, d) -> tuple[Sequences, Sequences]:
    seqs = orders(spark, d)
    even = F.pmod("seq_id", F.lit(2)) == 0
    return Sequences(seqs.frame.where(even), seqs.ids), Sequences(seqs.frame.where(~even), seqs.ids)


def _hashed_halves(spark, d) -> DataFrame:
    """Differences of the two, each replicate dealing every sequence by hash, with the share of the even ones as its chance."""
    seqs = orders(spark, d)
    own = F.when(F.pmod("seq_id", F.lit(2)) == 0, "x").otherwise("y")
    ids = seqs.frame.select("seq_id").distinct().withColumn("side", own)
    total, first = ids.agg(F.count("*"), F.count(F.when(F.col("side") == "x", 1))).first()
    again = ids.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))))
    again = again.withColumn("side", F.when(resample.uniform("side", "seq_id", "rep", F.lit(0)) < first / max(total, 1), "x").otherwise("y"))
    return resample.permutation_test(seqs, "relative", ids, again, "x", "y")[0]


@query("perm_models", _sql(O, PERM2, _PD, select=_PTEST.format(what="from_state, to_state", n=float(REPS + 1))))
def _(spark, d):
    rows = _rounded(_hashed_halves(spark, d).drop("diff_sig"), "diff", "p_value")
    return rows.withColumn("effect_size", F.round("effect_size", 6) + 0.0)


@query("perm_edges_models", _sql(O, PERM2, _PD, f"pt AS ({_PTEST.format(what='from_state, to_state', n=float(REPS + 1))})",
    select="SELECT from_state, to_state, diff, p_value, p_value AS p_adjusted, p_value < 0.05 AS significant FROM pt"))
def _(spark, d):
    rows = _hashed_halves(spark, d).withColumn("p_adjusted", F.col("p_value")).withColumn("significant", F.col("p_value") < 0.05)
    return _rounded(rows.select("from_state", "to_state", "diff", "p_value", "p_adjusted", "significant"), "diff", "p_value", "p_adjusted")


_BOOT0 = BOOT.replace(_U, _MD5.format(key="CAST(seq AS VARCHAR) || ' ' || CAST(rep AS VARCHAR) || ' 0'"))


@query("bootstrap_model", _sql(O, _BOOT0, select=f"SELECT * FROM ({_BSTAT.format(worse=_STABLE, n=float(REPS + 1))}) WHERE weight > 0"))
def _(spark, d):
    m = model.tna(orders(spark, d))
    found = resample.bootstrap(m, resample.bootstrap_weights(m, REPS, resample.poisson_multiplicity("seq_id", "rep", F.lit(0))))
    return _rounded(found.where("weight > 0").drop("sig"), "weight", "mean", "sd", "ci_lower", "ci_upper", "p_value")


# A windowed model keeps its windows under resampling.

_BOOTW = f"""{_full("o", _pairs("o", "a.p // 6 = b.p // 6"), normal=False)},
ml AS (SELECT seq, rep, {_TIMES_OF} AS m FROM (SELECT DISTINCT seq FROM o) CROSS JOIN (SELECT unnest(range({REPS})) AS rep)),
bc AS (SELECT rep, a.s AS f, b.s AS t, sum(m) AS n FROM o a JOIN o b ON a.seq = b.seq AND a.p // 6 = b.p // 6 JOIN ml ON ml.seq = a.seq GROUP BY ALL),
bw AS (SELECT r.rep, w.from_state, w.to_state, w.weight AS w, CAST(coalesce(n, 0) AS DOUBLE) AS x FROM w CROSS JOIN (SELECT unnest(range({REPS})) AS rep) r LEFT JOIN bc ON bc.rep = r.rep AND f = from_state AND t = to_state)"""


@query("bootstrap_windowed", _sql(O, _BOOTW, select=_BSTAT.format(worse=_STABLE, n=float(REPS + 1))))
def _(spark, d):
    m = model.ctna(orders(spark, d), windowed=True, window_size=2, window_span=3)
    found = resample.bootstrap(m, resample.bootstrap_weights(m, REPS, resample.poisson_multiplicity("seq_id", "rep")))
    return _rounded(found.drop("sig"), "weight", "mean", "sd", "ci_lower", "ci_upper", "p_value")


# n of n draws come from binomials of a counter-based generator, which SQL has not.


@query("bootstrap_exact")
def _(spark, d):
    found = resample.bootstrap_tna(model.tna(orders(spark, d)), 200)
    return _rounded(found.edges, "weight", "mean", "sd", "ci_lower", "ci_upper", "p_value")


@query("bootstrap_bca")
def _(spark, d):
    found = resample.bca_edges(model.tna(orders(spark, d)), 200)
    return _rounded(found, "weight", "bias", "acceleration", "ci_lower", "ci_upper")


# Permutations of exact sizes: places of sequences in a keyed network, which SQL can walk.


def _walk(ids: str, order: str, reps: int = REPS, rounds: int = 8) -> str:
    """SQL tables: fi (ids, idx), fy (rep, idx, y), y being where number idx stands in the permutation of a replicate."""
    word = lambda t: f"[CAST('0x' || substr(md5('0 ' || CAST(rep AS VARCHAR) || ' {t}'), 1, 8) AS UBIGINT)]"
    # a round takes [left, right] to [right, left xor mixed(right)]
    a = "((xor(s[2], k[1]) * 2246822507::UBIGINT) % 4294967296::UBIGINT)"
    b = f"((xor({a}, {a} >> 13) * 3266489909::UBIGINT) % 4294967296::UBIGINT)"
    walked = f"list_reduce(list_prepend([y >> w, y & m], keys), lambda s, k: [s[2], xor(s[1], xor({b}, {b} >> 16) & m)])"
    return f"""fi AS (SELECT *, CAST(row_number() OVER (ORDER BY {order}) - 1 AS UBIGINT) AS idx FROM ({ids})),
fn AS (SELECT n, w, (1::UBIGINT << w) - 1 AS m FROM (SELECT CAST(count(*) AS UBIGINT) AS n, CAST(greatest(4, (length(bin(count(*) - 1)) + 1) // 2) AS UBIGINT) AS w FROM fi)),
fk AS (SELECT rep, [{", ".join(word(t) for t in range(rounds))}] AS keys FROM (SELECT unnest(range({reps})) AS rep)),
fw AS (SELECT rep, idx, idx AS y, true AS fresh FROM fi CROSS JOIN fk UNION ALL
  SELECT rep, idx, (h[1] << w) + h[2] AS y, false FROM (SELECT fw.rep, idx, w, {walked} AS h FROM fw JOIN fk ON fk.rep = fw.rep CROSS JOIN fn WHERE fresh OR y >= n)),
fy AS (SELECT rep, idx, y FROM fw CROSS JOIN fn WHERE NOT fresh AND y < n)"""


def _recursive(base: str, *more: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([base.strip(), *more]) + "\n" + select


_PERMX = f"""{_walk("SELECT DISTINCT CASE WHEN seq % 2 = 0 THEN 'x' ELSE 'y' END AS own, seq FROM o", "own, seq")},
sd AS (SELECT seq, CASE WHEN own = 'x' THEN 0 ELSE 1 END AS side, -1 AS rep FROM fi UNION ALL SELECT seq, CASE WHEN y < (SELECT count(*) FROM fi WHERE own = 'x') THEN 0 ELSE 1 END, rep FROM fy JOIN fi USING (idx)),
l AS (SELECT DISTINCT s FROM o), pk {PERM[PERM.index("AS (SELECT rep, side, a.s AS f"):]}"""


@query("perm_exact", _recursive(O, _PERMX, _PD, select=_PTEST.format(what="from_state, to_state", n=float(REPS + 1))))
def _(spark, d):
    x, y = (model.tna(s) for s in _halves(spark, d))
    rows = _rounded(resample.permutation_test_models(x, y, REPS)[0].drop("diff_sig"), "diff", "p_value")
    return rows.withColumn("effect_size", F.round("effect_size", 6) + 0.0)


@query("perm_edges_exact", _recursive(O, _PERMX, _PD, f"pt AS ({_PTEST.format(what='from_state, to_state', n=float(REPS + 1))})",
    select="SELECT from_state, to_state, diff, p_value, round(least(1, p_value * count(*) OVER ()), 9) AS p_adjusted, p_value * count(*) OVER () < 0.05 AS significant FROM pt"))
def _(spark, d):
    x, y = _halves(spark, d)
    rows = resample.permutation_test_edges(x, y, REPS, "none")
    return _rounded(stats.p_adjust(rows.drop("p_adjusted"), "p_value", "bonferroni").withColumn("significant", F.col("p_adjusted") < 0.05), "diff", "p_value", "p_adjusted")


_CSX = O_REL + f""",
{_walk("SELECT DISTINCT seq FROM o", "seq")},
dp AS (SELECT unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS prop),
ck AS (SELECT prop, rep, seq FROM fy JOIN fi USING (idx) CROSS JOIN dp CROSS JOIN fn WHERE y < n - CAST(floor(CAST(n AS DOUBLE) * prop) AS BIGINT)),
cc AS (SELECT prop, rep, a.s AS f, b.s AS t, count(*) AS n FROM o a JOIN o b ON a.seq = b.seq AND b.p = a.p + 1 JOIN ck ON ck.seq = a.seq GROUP BY ALL),
cw AS (SELECT r.prop, r.rep, w.from_state, w.to_state, coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY r.prop, r.rep, w.from_state), 1) AS x FROM w CROSS JOIN (SELECT prop, rep FROM dp CROSS JOIN fk) r
  LEFT JOIN cc ON cc.prop = r.prop AND cc.rep = r.rep AND f = from_state AND t = to_state),
ms AS (SELECT prop, rep, 'InStrength' AS measure, to_state AS state, sum(x) FILTER (WHERE from_state <> to_state) AS v FROM cw GROUP BY ALL UNION ALL
  SELECT prop, rep, 'OutStrength', from_state, sum(x) FILTER (WHERE from_state <> to_state) FROM cw GROUP BY ALL),
mr AS (SELECT 'InStrength' AS measure, to_state AS state, sum(weight) FILTER (WHERE from_state <> to_state) AS z FROM w GROUP BY 2 UNION ALL
  SELECT 'OutStrength', from_state, sum(weight) FILTER (WHERE from_state <> to_state) FROM w GROUP BY 2),
cs AS (SELECT prop, rep, measure, corr(v, z) AS corr FROM ms JOIN mr USING (measure, state) GROUP BY ALL)"""


@query("cs_exact", _recursive(O, _CSX, select="SELECT prop, CAST(rep AS INTEGER) AS rep, measure, round(corr, 6) AS corr FROM cs"))
def _(spark, d):
    found = resample.estimate_cs(model.tna(orders(spark, d)), REPS, measures=("OutStrength", "InStrength"))
    return found.correlations.select("prop", "rep", "measure", F.round("corr", 6).alias("corr"))


@query("cs_exact_coefficients", _recursive(O, _CSX, "ca AS (SELECT measure, prop, avg(CASE WHEN corr >= 0.7 THEN 1.0 ELSE 0.0 END) AS share FROM cs GROUP BY ALL)", select="SELECT measure, CAST(coalesce(max(CASE WHEN share >= 0.95 THEN prop END), 0) AS DOUBLE) AS cs FROM ca GROUP BY measure"))
def _(spark, d):
    return resample.estimate_cs(model.tna(orders(spark, d)), REPS, measures=("OutStrength", "InStrength")).coefficients


@query("cs_exact_all")
def _(spark, d):
    return resample.estimate_cs(model.tna(orders(spark, d)), 100).coefficients


CSQ = O_REL + f""",
ck AS (SELECT seq, rep, prop FROM (SELECT DISTINCT seq FROM o) CROSS JOIN (SELECT unnest(range({REPS})) AS rep) CROSS JOIN (SELECT unnest([0.2, 0.5, 0.8]) AS prop) WHERE {_U} >= prop),
cc AS (SELECT prop, rep, a.s AS f, b.s AS t, count(*) AS n FROM o a JOIN o b ON a.seq = b.seq AND b.p = a.p + 1 JOIN ck ON ck.seq = a.seq GROUP BY ALL),
cw AS (SELECT r.prop, r.rep, w.from_state, w.to_state, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY r.prop, r.rep, w.from_state) AS x FROM w CROSS JOIN (SELECT DISTINCT prop, rep FROM ck) r
  LEFT JOIN cc ON cc.prop = r.prop AND cc.rep = r.rep AND f = from_state AND t = to_state),
ci AS (SELECT prop, rep, to_state, sum(x) FILTER (WHERE from_state <> to_state) AS v FROM cw GROUP BY ALL), cr AS (SELECT to_state, sum(weight) FILTER (WHERE from_state <> to_state) AS z FROM w GROUP BY ALL),
cs AS (SELECT prop, rep, corr(v, z) AS corr FROM ci JOIN cr USING (to_state) GROUP BY ALL)"""


def _stable(spark, d):
    m = model.tna(orders(spark, d))
    ids = m.sequences.frame.select("seq_id").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1)))).withColumn("prop", F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))))
    return resample.stability(m, ids.where(_u() >= F.col("prop")), ("InStrength",))


@query("cs_correlations", _sql(O, CSQ, select="SELECT CAST(prop AS DOUBLE) AS prop, CAST(rep AS INTEGER) AS rep, round(corr, 6) AS corr FROM cs"))
def _(spark, d):
    return _stable(spark, d).select("prop", "rep", F.round("corr", 6).alias("corr"))


@query("cs_coefficients", _sql(O, CSQ, "ca AS (SELECT prop, avg(CASE WHEN corr >= 0.7 THEN 1.0 ELSE 0.0 END) AS share FROM cs GROUP BY 1)", select="SELECT 'InStrength' AS measure, CAST(coalesce(max(CASE WHEN share >= 0.6 THEN prop END), 0) AS DOUBLE) AS cs FROM ca"))
def _(spark, d):
    return resample.cs_coefficients(_stable(spark, d), certainty=0.6)


@query("plot_cs_lines", _sql(O, CSQ, select="SELECT 'InStrength' AS measure, CAST(prop AS DOUBLE) AS prop, round(avg(corr), 6) AS mean_corr FROM cs GROUP BY prop"))
def _(spark, d):
    return plotdata.stability_lines(_stable(spark, d)).withColumn("mean_corr", F.round("mean_corr", 6))


@query("patterns_perm_test", _sql(G, _RUNS, "gs AS (SELECT list(grp ORDER BY grp) AS names FROM (SELECT DISTINCT grp FROM g))",
    f"rg AS (SELECT seq, rep, names[1 + CAST(floor({_U} * len(names)) AS INTEGER)] AS grp FROM (SELECT DISTINCT seq FROM g) CROSS JOIN (SELECT unnest(range({REPS})) AS rep) CROSS JOIN gs)",
    "rn AS (SELECT rg.rep, t.length, t.pattern, rg.grp, count(*) AS n FROM t JOIN rg ON rg.seq = t.seq GROUP BY ALL)",
    f"rf AS (SELECT -1 AS rep, length, pattern, grp, n FROM f UNION ALL SELECT r.rep, f.length, f.pattern, f.grp, coalesce(rn.n, 0) FROM f CROSS JOIN (SELECT unnest(range({REPS})) AS rep) r LEFT JOIN rn ON rn.rep = r.rep AND rn.length = f.length AND rn.pattern = f.pattern AND rn.grp = f.grp)",
    "rm AS (SELECT *, sum(n) OVER (PARTITION BY rep, length, pattern) AS pn, sum(n) OVER (PARTITION BY rep, grp) AS gn, sum(n) OVER (PARTITION BY rep) AS an FROM rf)",
    "rs AS (SELECT rep, length, pattern, sqrt(sum(pow(n - pn * gn / an, 2))) AS s FROM rm GROUP BY ALL)",
    "rt AS (SELECT length, pattern, any_value(a) AS a, avg(s) AS mu, stddev_pop(s) AS sd, (sum(CASE WHEN s >= a THEN 1 ELSE 0 END) + 1) / 21.0 AS p FROM (SELECT *, max(CASE WHEN rep = -1 THEN s END) OVER (PARTITION BY length, pattern) AS a FROM rs) WHERE rep >= 0 GROUP BY ALL)",
    select="""SELECT length, pattern, round(a, 6) AS statistic, round(CASE WHEN sd > 0 THEN (a - mu) / sd ELSE 0 END, 6) AS effect_size, round(p, 9) AS p_value, round(least(1, p * count(*) OVER (PARTITION BY length)), 9) AS p_adjusted
FROM rt WHERE true QUALIFY (SELECT min(n) FROM f WHERE f.length = rt.length AND f.pattern = rt.pattern) >= 0"""))  # fmt: skip
def _(spark, d):
    seqs = orders(spark, d, segments=True)
    names = seqs.frame.select("grp").distinct().agg(F.array_sort(F.collect_set("grp")).alias("names"))
    ids = seqs.frame.select("seq_id").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1)))).crossJoin(F.broadcast(names))  # one row
    shuffled = ids.select("rep", "seq_id", F.element_at("names", (F.floor(_u() * F.size("names")) + 1).cast("int")).alias("grp"))
    rows = patterns.permutation_test(seqs, "grp", shuffled, (1, 2, 3), min_freq=0)
    return rows.select("length", "pattern", F.round("statistic", 6).alias("statistic"), (F.round("effect_size", 6) + 0.0).alias("effect_size"), F.round("p_value", 9).alias("p_value"), F.round("p_adjusted", 9).alias("p_adjusted"))


# The same with lengths 1 to 5 and groups dealt out anew to as many sequences as they have, which are the defaults.

_RUNS5 = """u AS (SELECT seq, grp, p, s, lead(s, 1) OVER x AS s1, lead(s, 2) OVER x AS s2, lead(s, 3) OVER x AS s3, lead(s, 4) OVER x AS s4 FROM g WINDOW x AS (PARTITION BY seq ORDER BY p)),
t AS (SELECT seq, grp, 1 AS length, s AS pattern FROM u UNION ALL SELECT seq, grp, 2, s || '->' || s1 FROM u WHERE s1 IS NOT NULL UNION ALL SELECT seq, grp, 3, s || '->' || s1 || '->' || s2 FROM u WHERE s2 IS NOT NULL
  UNION ALL SELECT seq, grp, 4, s || '->' || s1 || '->' || s2 || '->' || s3 FROM u WHERE s3 IS NOT NULL UNION ALL SELECT seq, grp, 5, s || '->' || s1 || '->' || s2 || '->' || s3 || '->' || s4 FROM u WHERE s4 IS NOT NULL),
""" + _RUNS[_RUNS.index("f AS (SELECT a.length"):]


@query("patterns_compare_default", _sql(G, _RUNS5, select="""SELECT pattern, length, grp, freq, prop FROM (SELECT pattern, length, grp, n AS freq, round(n / sum(n) OVER (PARTITION BY length, grp), 9) AS prop,
min(n) OVER (PARTITION BY length, pattern) AS least FROM f) WHERE least >= 5"""))
def _(spark, d):
    return _rounded(patterns.compare(orders(spark, d, segments=True), "grp"), "prop")


@query("patterns_perm_exact", _recursive(G, _RUNS5, _walk("SELECT DISTINCT grp, seq FROM g", "grp, seq"), "gz AS (SELECT grp, sum(count(*)) OVER (ORDER BY grp) AS e FROM fi GROUP BY grp)",
    "rg AS (SELECT fy.rep, fi.seq, min(gz.grp) AS grp FROM fy JOIN fi USING (idx) JOIN gz ON gz.e > fy.y GROUP BY ALL)",
    "rn AS (SELECT rg.rep, t.length, t.pattern, rg.grp, count(*) AS n FROM t JOIN rg ON rg.seq = t.seq GROUP BY ALL)",
    f"rf AS (SELECT -1 AS rep, length, pattern, grp, n FROM f UNION ALL SELECT r.rep, f.length, f.pattern, f.grp, coalesce(rn.n, 0) FROM f CROSS JOIN (SELECT unnest(range({REPS})) AS rep) r LEFT JOIN rn ON rn.rep = r.rep AND rn.length = f.length AND rn.pattern = f.pattern AND rn.grp = f.grp)",
    "rm AS (SELECT *, sum(n) OVER (PARTITION BY rep, length, pattern) AS pn, sum(n) OVER (PARTITION BY rep, grp) AS gn, sum(n) OVER (PARTITION BY rep) AS an FROM rf)",
    "rs AS (SELECT rep, length, pattern, sqrt(sum(pow(n - pn * gn / an, 2))) AS s FROM rm GROUP BY ALL)",
    f"rt AS (SELECT length, pattern, any_value(a) AS a, avg(s) AS mu, stddev_pop(s) AS sd, (sum(CASE WHEN s >= a THEN 1 ELSE 0 END) + 1) / {float(REPS + 1)} AS p FROM (SELECT *, max(CASE WHEN rep = -1 THEN s END) OVER (PARTITION BY length, pattern) AS a FROM rs) WHERE rep >= 0 GROUP BY ALL)",
    "ra AS (SELECT *, least(1, p * count(*) OVER (PARTITION BY length)) AS pa FROM rt)", "fm AS (SELECT length, pattern, min(n) AS least FROM f GROUP BY 1, 2)",
    select="""SELECT length, pattern, round(a, 6) AS statistic, round(CASE WHEN sd > 0 THEN (a - mu) / sd ELSE 0 END, 6) AS effect_size, round(p, 9) AS p_value, round(pa, 9) AS p_adjusted FROM ra JOIN fm USING (length, pattern) WHERE fm.least >= 5"""))
def _(spark, d):
    rows = patterns.permuted_patterns(orders(spark, d, segments=True), "grp", REPS)
    return rows.select("length", "pattern", F.round("statistic", 6).alias("statistic"), (F.round("effect_size", 6) + 0.0).alias("effect_size"), F.round("p_value", 9).alias("p_value"), F.round("p_adjusted", 9).alias("p_adjusted"))


_P = "pv AS (SELECT from_state, to_state, weight AS p FROM w)"


def _p(spark, d, method):
    rows = model.tna(_e(spark, d)).weights.select("from_state", "to_state", F.col("weight").alias("p"))
    rows = stats.p_adjust(rows, "p", method)
    return _rounded(rows.select("from_state", "to_state", "p_adjusted"), "p_adjusted")


@query("p_adjust_bonferroni", _sql(E, E_REL, _P, select="SELECT from_state, to_state, round(least(1, p * count(*) OVER ()), 9) AS p_adjusted FROM pv"))
def _(spark, d):
    return _p(spark, d, "bonferroni")


_HELD = "pr AS (SELECT *, row_number() OVER (ORDER BY p, from_state, to_state) AS r, count(*) OVER () AS n FROM pv)"


@query("p_adjust_holm", _sql(E, E_REL, _P, _HELD, select="SELECT a.from_state, a.to_state, round(least(1, max(b.p * (b.n - b.r + 1))), 9) AS p_adjusted FROM pr a JOIN pr b ON b.r <= a.r GROUP BY 1, 2"))
def _(spark, d):
    return _p(spark, d, "holm")


@query("p_adjust_bh", _sql(E, E_REL, _P, _HELD, select="SELECT a.from_state, a.to_state, round(least(1, min(b.p * b.n / b.r)), 9) AS p_adjusted FROM pr a JOIN pr b ON b.r >= a.r GROUP BY 1, 2"))
def _(spark, d):
    return _p(spark, d, "fdr")


# Distances and clusters, of conversations

PAD = C + """, wd AS (SELECT max(p) + 1 AS n FROM c), pd AS (SELECT q.seq, k.p, coalesce(c.s, '*') AS s FROM (SELECT DISTINCT seq FROM c) q CROSS JOIN (SELECT unnest(range(0, n)) AS p FROM wd) k LEFT JOIN c ON c.seq = q.seq AND c.p = k.p),
hd AS (SELECT a.seq AS i, b.seq AS j, CAST(sum(CASE WHEN a.s <> b.s THEN {w} ELSE 0 END) AS DOUBLE) AS d FROM pd a JOIN pd b ON a.p = b.p AND a.seq < b.seq GROUP BY 1, 2)"""


@query("dist_hamming", _sql(PAD.format(w="1"), select="SELECT i, j, d FROM hd"))
def _(spark, d):
    return clustering.distances(conversations(spark, d))


@query("dist_hamming_weighted", _sql(PAD.format(w="exp(-0.5 * a.p)"), select="SELECT i, j, round(d, 9) AS d FROM hd"))
def _(spark, d):
    return clustering.distances(conversations(spark, d), weighted=True, lambda_=0.5, digits=9)


# The rows of a table of edit distances one after the other; a step to the right is a running minimum (or maximum) of the row.
_EDIT = "WITH RECURSIVE " + C.strip() + """,
q AS (SELECT seq, list(s ORDER BY p) AS a FROM c GROUP BY seq),
t AS (SELECT x.seq AS i, y.seq AS j, 0 AS r, x.a AS a, y.a AS b, {first} AS prev, {first} AS older FROM q x JOIN q y ON x.seq < y.seq
UNION ALL SELECT i, j, r + 1, a, b, list_transform(range(0, len(b) + 1), lambda k: {along}), prev FROM (
  SELECT *, list_concat([{start}], list_transform(range(1, len(b) + 1), lambda k: {cell})) AS u FROM t WHERE r < len(a)))
SELECT i, j, CAST({result} AS DOUBLE) AS d FROM t WHERE r = len(a)"""
_SAME = "(CASE WHEN a[r + 1] = b[k] THEN 1 ELSE 0 END)"
_RIGHT = "k + list_min(list_transform(range(0, k + 1), lambda h: u[h + 1] - h))"
_LV = f"least(prev[k + 1] + 1, prev[k] + {_SAME})"
_OSA = f"CASE WHEN r >= 1 AND k >= 2 AND a[r + 1] = b[k - 1] AND a[r] = b[k] THEN least({_LV}, older[k - 1] + {_SAME}) ELSE {_LV} END"
_COUNT, _NONE = "range(0, len(y.a) + 1)", "list_transform(range(0, len(y.a) + 1), lambda k: 0)"
_EDITS = {
    "lv": _EDIT.format(first=_COUNT, start="r + 1", cell=_LV, along=_RIGHT, result="prev[len(b) + 1]"),
    "osa": _EDIT.format(first=_COUNT, start="r + 1", cell=_OSA, along=_RIGHT, result="prev[len(b) + 1]"),
    "lcs": _EDIT.format(first=_NONE, start="0", cell=f"greatest(prev[k + 1], prev[k] + {_SAME})", along="list_max(u[1:k + 1])", result="greatest(len(a), len(b)) - prev[len(b) + 1]"),
}

for _metric, _text in _EDITS.items():
    query(f"dist_{_metric}", _text)(lambda spark, d, m=_metric: clustering.distances(conversations(spark, d), m))


@query("silhouette", _sql(PAD.format(w="1"), """b2 AS (SELECT i, j, d FROM hd UNION ALL SELECT j, i, d FROM hd), mm AS (SELECT i, i % 3 AS own, j % 3 AS c, avg(d) AS m FROM b2 GROUP BY 1, 2, 3),
sz AS (SELECT seq % 3 AS c, count(*) AS n FROM (SELECT DISTINCT seq FROM c) GROUP BY 1), ab AS (SELECT i, own, max(CASE WHEN c = own THEN m END) AS a, min(CASE WHEN c <> own THEN m END) AS b FROM mm GROUP BY 1, 2)""",
    select="SELECT round(avg(CASE WHEN sz.n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 9) AS silhouette FROM ab JOIN sz ON sz.c = own"))
def _(spark, d):
    seqs = conversations(spark, d)
    member = seqs.frame.select(F.col("seq_id").alias("id")).distinct().withColumn("cluster", F.pmod("id", F.lit(3)))
    return _rounded(clustering.sequence_silhouette(seqs, member), "silhouette")


@query("cluster_pam")
def _(spark, d):
    return clustering.cluster_sequences(conversations(spark, d), 3).assignments


@query("cluster_hierarchical")
def _(spark, d):
    return clustering.cluster_sequences(conversations(spark, d), 3, "lcs", "average").assignments


# Plot data


@query("plot_seq_distribution", _sql(E, select="SELECT p AS raw_pos, s AS state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p), 9) AS share FROM e GROUP BY 1, 2"))
def _(spark, d):
    return _rounded(plotdata.sequence_distribution(_e(spark, d)).withColumn("raw_pos", F.col("raw_pos").cast("int")), "share")


@query("plot_seq_index", _sql(C, select="SELECT seq AS seq_id, CAST(p AS INTEGER) AS raw_pos, CAST(dense_rank() OVER (ORDER BY s) - 1 AS INTEGER) AS code FROM c"))
def _(spark, d):
    return plotdata.sequence_index(conversations(spark, d)).select("seq_id", F.col("raw_pos").cast("int").alias("raw_pos"), F.col("code").cast("int").alias("code"))


@query("plot_mosaic_residuals", _sql(E, E_FREQ, "mz AS (SELECT to_state, from_state, weight AS n, sum(weight) OVER (PARTITION BY to_state) AS r, sum(weight) OVER (PARTITION BY from_state) AS c, sum(weight) OVER () AS t FROM w)",
    select="SELECT to_state, from_state, n, round(c / t, 9) AS width, round(n / c, 9) AS height, round((n - r * c / t) / sqrt(r * c / t * (1 - r / t) * (1 - c / t)), 9) AS residual FROM mz"))
def _(spark, d):
    rows = plotdata.mosaic(model.ftna(_e(spark, d)).weights, "to_state", "from_state", "weight")
    return _rounded(rows, "width", "height", "residual")


@query("plot_weight_histogram", _sql(E, E_FREQ, "b AS (SELECT min(weight) AS lo, max(weight) AS hi FROM w WHERE weight > 0)", "h AS (SELECT least(floor((weight - lo) / ((hi - lo) / 10.0)), 9) AS bin, count(*) AS n FROM w CROSS JOIN b WHERE weight > 0 GROUP BY 1)",
    select="SELECT CAST(k.bin AS INTEGER) AS bin, round(lo + k.bin * ((hi - lo) / 10.0), 9) AS low, round(lo + (k.bin + 1) * ((hi - lo) / 10.0), 9) AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS bin) k CROSS JOIN b LEFT JOIN h ON h.bin = k.bin"))
def _(spark, d):
    return _rounded(plotdata.histogram(model.ftna(_e(spark, d)).weights, bins=10), "low", "high")


_TWO = O + ", " + O_REL.replace("w AS (", "w1 AS (").replace("k AS (", "k1 AS (").replace("JOIN k ", "JOIN k1 ").replace("k.f", "k1.f").replace("k.t", "k1.t").replace("l AS (", "l1 AS (").replace("FROM l a CROSS JOIN l b", "FROM l1 a CROSS JOIN l1 b") + ", " + _full("o", _pairs("o", "b.p = a.p + 1", back=True))


@query("plot_compare_diff", _sql(_TWO, select="SELECT from_state, to_state, round(w1.weight, 9) AS a, round(w.weight, 9) AS b, round(w1.weight - w.weight, 9) AS diff, CAST(sign(w1.weight - w.weight) AS INTEGER) AS sign FROM w1 JOIN w USING (from_state, to_state) WHERE abs(w1.weight - w.weight) > 1e-12"))
def _(spark, d):
    seqs = orders(spark, d)
    return _rounded(plotdata.difference(model.tna(seqs), model.build_model(seqs, "reverse")), "a", "b", "diff")


@query("plot_model_corr", _sql(_TWO, select="SELECT round(corr(w1.weight, w.weight), 9) AS r FROM w1 JOIN w USING (from_state, to_state)"))
def _(spark, d):
    seqs = orders(spark, d)
    return _rounded(plotdata.correlation(model.tna(seqs), model.build_model(seqs, "reverse")), "r")


@query("plot_network_edges", _sql(E, E_REL, "d AS (SELECT * FROM w WHERE weight > 0 AND weight >= 0.19)",
    select="""SELECT a.from_state, a.to_state, round(a.weight, 9) AS weight, b.weight IS NOT NULL AND a.from_state <> a.to_state AS bidirectional, round(0.5 + (a.weight - min(a.weight) OVER ()) / (max(a.weight) OVER () - min(a.weight) OVER ()) * 4.5, 9) AS width
FROM d a LEFT JOIN d b ON b.from_state = a.to_state AND b.to_state = a.from_state"""))  # fmt: skip
def _(spark, d):
    rows = plotdata.network(model.tna(_e(spark, d)), minimum=0.19)
    return _rounded(rows.select("from_state", "to_state", "weight", "bidirectional", "width"), "weight", "width")


@query("plot_frequencies", _sql(E, select=_ends("e", "arg_min")))
def _(spark, d):
    return _rounded(plotdata.frequencies(model.tna(_e(spark, d))), "prob")


@query("plot_network_ci", _sql(O, BOOT, select=f"SELECT from_state, to_state, round(any_value(w), 9) AS weight, round(quantile_cont(x, 0.975) - quantile_cont(x, 0.025), 9) AS ci_width, CASE WHEN (sum({_STABLE}) + 1) / {float(REPS + 1)} < 0.05 THEN 1.0 ELSE 0.3 END::DOUBLE AS alpha FROM bw GROUP BY 1, 2 HAVING any_value(w) > 0"))
def _(spark, d):
    m, again = _boot(spark, d)
    return _rounded(plotdata.network_ci(resample.bootstrap(m, again)), "weight", "ci_width")


@query("plot_permutation_histogram", _sql(O, PERM, _PD, f"pt AS ({_PTEST.format(what='from_state, to_state', n=float(REPS + 1))})", "b AS (SELECT min(p_value) AS lo, max(p_value) AS hi FROM pt)",
    "h AS (SELECT least(floor((p_value - lo) / ((hi - lo) / 7.0) + 1e-6), 6) AS bin, count(*) AS n FROM pt CROSS JOIN b GROUP BY 1)",
    select="SELECT CAST(k.bin AS INTEGER) AS bin, round(lo + k.bin * ((hi - lo) / 7.0), 6) AS low, round(lo + (k.bin + 1) * ((hi - lo) / 7.0), 6) AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(7)) AS bin) k CROSS JOIN b LEFT JOIN h ON h.bin = k.bin"))
def _(spark, d):
    edges = _perm(spark, d)[0]
    return plotdata.permutation_histogram(edges, 7)[0].select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query("plot_centrality_bars", _sql(E, E_REL, "v AS (SELECT from_state AS state, 'OutStrength' AS measure, round(sum(weight) FILTER (WHERE from_state <> to_state), 9) AS value FROM w GROUP BY 1 UNION ALL SELECT to_state, 'InStrength', round(sum(weight) FILTER (WHERE from_state <> to_state), 9) FROM w GROUP BY 1)",
    "x AS (SELECT *, min(value) OVER (PARTITION BY measure) AS lo, max(value) OVER (PARTITION BY measure) AS hi FROM v)",
    select="SELECT state, measure, round(CASE WHEN hi = lo THEN value ELSE (value - lo) / (hi - lo) END, 6) AS value, CAST(row_number() OVER (PARTITION BY measure ORDER BY value DESC, state) AS INTEGER) AS place FROM x"))
def _(spark, d):
    values = _rounded(network.centralities(model.tna(_e(spark, d)), ["OutStrength", "InStrength"]), "value")
    return plotdata.centrality_bars(values, normalize=True).select("state", "measure", (F.round("value", 6) + 0.0).alias("value"), "place")


@query("plot_community_nodes")
def _(spark, d):
    m = model.ftna(orders(spark, d))
    return plotdata.community_nodes(network.communities(m, ("leading_eigen",)), m.inits)


@query("plot_bootstrap_grid", _sql(O, BOOT, select=f"SELECT from_state, to_state, round(any_value(w), 9) AS weight, round(quantile_cont(x, 0.975) - quantile_cont(x, 0.025), 9) AS ci_width, CASE WHEN any_value(w) = 0 THEN 0.5 WHEN (sum({_STABLE}) + 1) / {float(REPS + 1)} < 0.05 THEN 1.0 ELSE 0.0 END::DOUBLE AS significance FROM bw GROUP BY 1, 2"))
def _(spark, d):
    m, again = _boot(spark, d)
    return _rounded(plotdata.bootstrap_grid(resample.bootstrap(m, again)), "weight", "ci_width")




@query("plot_node_sizes", _sql(E, E_REL, "z AS (SELECT from_state AS state, sum(weight) FILTER (WHERE from_state <> to_state) AS v FROM w GROUP BY 1)",
    select="SELECT state, round(800 + (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 2200, 9) AS size FROM z"))
def _(spark, d):
    return _rounded(plotdata.node_sizes(model.tna(_e(spark, d)), "OutStrength"), "size")
