"""Scores, gates, drift, splits and models on orders, line items and labels."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import advice
from ..functions.numeric import round_even
from ..operators import drift, grid, learn, sampling, scores
from ..operators.kpi import drift_by_scenario
from ..operators.manifest import keep_last
from ..settings import Gate, Training
from .registry import Tables, query, r

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def judged_orders(t: Tables) -> DataFrame:
    """Actual class from the priority, predicted from price and key, score columns per class."""
    actual = F.least(F.lit(2), F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("o_orderpriority")).cast("int") - 1)
    guess = F.when(F.col("o_orderkey") % 3 == 0, actual).when(F.col("o_totalprice") < 200000, 0).when(F.col("o_totalprice") < 380000, 1).otherwise(2)
    price = F.round(F.col("o_totalprice") / 500000, 2)
    return t.orders.select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_orderstatus", actual.alias("actual"), guess.alias("predicted"), price.alias("p2"),
        F.round(1 - price, 2).alias("p0"), ((F.col("o_orderkey") % 17) / F.lit(17.0)).alias("p1"), F.col("o_totalprice").alias("price"),
    )


JUDGED_SQL = """
a AS (SELECT *, least(2, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END) AS actual FROM orders),
judged AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderstatus, actual,
    CASE WHEN o_orderkey % 3 = 0 THEN actual WHEN o_totalprice < 200000 THEN 0 WHEN o_totalprice < 380000 THEN 1 ELSE 2 END AS predicted,
    round(o_totalprice / 500000, 2) AS p2, round(1 - round(o_totalprice / 500000, 2), 2) AS p0, (o_orderkey % 17) / 17::DOUBLE AS p1, o_totalprice AS price FROM a),
classes AS (SELECT unnest([0, 1, 2]) AS c)"""


def _per_class_sql(group: str) -> str:
    g = f"{group}, " if group else ""
    return f"""per AS (
  SELECT {g}c, count(*) FILTER (WHERE actual = c AND predicted = c) AS hit, count(*) FILTER (WHERE actual = c) AS support,
    count(*) FILTER (WHERE predicted = c) AS named, count(*) AS n FROM judged, classes GROUP BY {g}c),
rated AS (
  SELECT *, coalesce(hit::DOUBLE / nullif(named, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall,
    coalesce(2 * hit::DOUBLE / nullif(support + named, 0), 0) AS f1 FROM per)"""


@query(f"""WITH {JUDGED_SQL} SELECT a.c AS actual, p.c AS predicted, count(j.o_orderkey) AS rows,
  coalesce({r("count(j.o_orderkey)::DOUBLE / (SELECT count(*) FROM judged x WHERE x.actual = a.c)", 4)}, 0) AS row_share
FROM classes a CROSS JOIN classes p LEFT JOIN judged j ON j.actual = a.c AND j.predicted = p.c GROUP BY 1, 2""")
def confusion(t: Tables) -> DataFrame:
    return scores.confusion(judged_orders(t), "actual", "predicted")


@query(f"""WITH {JUDGED_SQL}, {_per_class_sql("")}
SELECT {r("(SELECT sum(hit)::DOUBLE / any_value(n) FROM rated)", 4)} AS accuracy, {r("(SELECT sum(f1) / 3 FROM rated)", 4)} AS macro_f1,
  {r("(SELECT sum(f1 * support) / sum(support) FROM rated)", 4)} AS weighted_f1, c AS class, {r("precision", 4)} AS precision, {r("recall", 4)} AS recall, {r("f1", 4)} AS f1, support FROM rated""")
def class_scores(t: Tables) -> DataFrame:
    return scores.class_scores(judged_orders(t), "actual", "predicted")


GROUP_SQL = f"""{JUDGED_SQL}, {_per_class_sql("date")},
grouped AS (SELECT date, any_value(n) AS rows, {r("sum(f1) FILTER (WHERE support > 0) / count(*) FILTER (WHERE support > 0)", 4)} AS macro_f1, {r("sum(hit)::DOUBLE / any_value(n)", 4)} AS accuracy,
  {r("max(CASE WHEN c = 2 AND support > 0 THEN recall END)", 4)} AS high_stress_recall, (count(*) FILTER (WHERE support > 0))::INTEGER AS classes_present FROM rated GROUP BY 1)"""


@query(f"WITH {GROUP_SQL} SELECT * FROM grouped")
def scores_by_group(t: Tables) -> DataFrame:
    return scores.group_scores(judged_orders(t), ["date"], "actual", "predicted")


@query(f"WITH {GROUP_SQL} SELECT {r('max(macro_f1) - min(macro_f1)', 4)} AS largest_gap FROM grouped")
def score_gap(t: Tables) -> DataFrame:
    return scores.largest_gap(scores.group_scores(judged_orders(t), ["date"], "actual", "predicted"))


_BANDS_SQL = """e AS (SELECT min(price) AS lo, (max(price) - min(price)) / 3 AS w FROM judged),
banded AS (SELECT judged.*, CASE WHEN price <= lo + w THEN 'head' WHEN price <= lo + 2 * w THEN 'middle' ELSE 'tail' END AS reach FROM judged, e)"""


@query(f"""WITH {JUDGED_SQL}, {_BANDS_SQL} SELECT reach, {r("min(price)", 3)} AS low, {r("max(price)", 3)} AS high FROM banded GROUP BY 1""")
def reach_bounds(t: Tables) -> DataFrame:
    return scores.value_bounds(grid.equal_width_bands(judged_orders(t), "price"), "reach", "price")


AUC_SQL = f"""{JUDGED_SQL},
long AS (SELECT o_orderstatus, 0 AS class, p0 AS s, actual = 0 AS hit FROM judged UNION ALL SELECT o_orderstatus, 1, p1, actual = 1 FROM judged UNION ALL SELECT o_orderstatus, 2, p2, actual = 2 FROM judged),
d AS (SELECT o_orderstatus, class, s, count(*) FILTER (WHERE hit) AS pos, count(*) FILTER (WHERE NOT hit) AS neg FROM long GROUP BY 1, 2, 3),
w AS (SELECT *, sum(neg) OVER (PARTITION BY o_orderstatus, class ORDER BY s) - neg / 2::DOUBLE AS below FROM d),
auc AS (SELECT o_orderstatus, class, {r("sum(pos * below) / (sum(pos)::DOUBLE * sum(neg))", 4)} AS auc FROM w GROUP BY 1, 2)"""


def _auc(t: Tables) -> DataFrame:
    return scores.roc_auc(judged_orders(t), "actual", {0: "p0", 1: "p1", 2: "p2"}, ["o_orderstatus"])


@query(f"WITH {AUC_SQL} SELECT * FROM auc")
def roc_auc(t: Tables) -> DataFrame:
    return _auc(t)


@query(f"WITH {AUC_SQL} SELECT o_orderstatus, {r('avg(auc)', 4)} AS macro_auc FROM auc GROUP BY 1")
def macro_auc(t: Tables) -> DataFrame:
    return scores.macro_auc(_auc(t), ["o_orderstatus"])


@query("""WITH n AS (SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY 1)
SELECT l_returnflag, rows, round((SELECT sum(rows) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * rows), 6) AS weight FROM n""")
def class_weights(t: Tables) -> DataFrame:
    return scores.class_weights(t.lineitem, "l_returnflag").withColumn("weight", F.round("weight", 6))


def _candidates(t: Tables) -> DataFrame:
    """Score per order date, against the score of the date before as champion, both rounded."""
    by_date = scores.group_scores(judged_orders(t), ["date"], "actual", "predicted").select("date", F.col("macro_f1").alias("candidate"))
    before = by_date.select(F.date_add("date", 1).alias("date"), F.col("candidate").alias("champion"))
    return by_date.join(before, "date", "left")


@query(f"""WITH {GROUP_SQL}, c AS (SELECT g.date, g.macro_f1 AS candidate, b.macro_f1 AS champion FROM grouped g LEFT JOIN grouped b ON b.date = g.date - 1)
SELECT date, candidate, champion, candidate >= 0.3::DOUBLE AND (champion IS NULL OR candidate >= champion + 0.01::DOUBLE) AS promoted,
  CASE WHEN candidate < 0.3::DOUBLE THEN 'score ' || printf('%.4f', candidate) || ' is under the minimum of 0.3000' WHEN champion IS NULL THEN 'there is no champion yet'
    WHEN candidate >= champion + 0.01::DOUBLE THEN 'score ' || printf('%.4f', candidate) || ' reaches the required ' || printf('%.4f', {r("champion + 0.01::DOUBLE", 4)})
    ELSE 'score ' || printf('%.4f', candidate) || ' is under the required ' || printf('%.4f', {r("champion + 0.01::DOUBLE", 4)}) END AS reason FROM c""")
def gate_verdict(t: Tables) -> DataFrame:
    return scores.gate_verdict(_candidates(t), "candidate", "champion", Gate(min_score=0.3, min_improvement=0.01))


@query(f"""WITH {JUDGED_SQL}, m AS (
  SELECT o_orderstatus, 'status_a' AS model, 0 AS priority, {r("avg((actual = predicted)::INTEGER)", 2)} AS score FROM judged GROUP BY 1
  UNION ALL SELECT o_orderstatus, 'status_b', 1, {r("avg((actual = o_orderkey % 3)::INTEGER)", 2)} FROM judged GROUP BY 1
  UNION ALL SELECT o_orderstatus, 'status_c', 2, {r("avg((actual = predicted)::INTEGER)", 2)} FROM judged GROUP BY 1)
SELECT o_orderstatus, arg_max(model, (score, -priority)) AS best_model, max(score) AS best_score FROM m GROUP BY 1""")
def best_model(t: Tables) -> DataFrame:
    """Three models scored per order status; the third repeats the first, so ties are decided by priority."""
    judged = judged_orders(t)
    rights = {"status_a": F.col("predicted"), "status_b": F.col("o_orderkey") % 3, "status_c": F.col("predicted")}
    one = judged.groupBy("o_orderstatus").agg(*[round_even(F.avg((F.col("actual") == p).cast("int")), 2).alias(m) for m, p in rights.items()])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("priority"), F.col(m).alias("score")) for i, m in enumerate(rights)])
    return scores.best_model(one.select("o_orderstatus", F.inline(rows)), "model", "score", "priority", ["o_orderstatus"])


_LATENCY_COLUMNS = f"""count(*) AS requests, count(*) FILTER (WHERE value > 150) AS errors, {r("(count(*) FILTER (WHERE value > 150))::DOUBLE / count(*)", 4)} AS error_rate,
  {r("count(*)::DOUBLE / 3600", 2)} AS throughput_rps, {r("quantile_cont(value, 0.5)", 1)} AS p50, {r("quantile_cont(value, 0.95)", 1)} AS p95, {r("quantile_cont(value, 0.99)", 1)} AS p99, {r("max(value)", 1)} AS max"""


@query(f"""SELECT event_type AS request, {_LATENCY_COLUMNS} FROM events GROUP BY 1 UNION ALL SELECT 'overall', {_LATENCY_COLUMNS} FROM events""")
def latency_summary(t: Tables) -> DataFrame:
    return scores.latency_summary(t.events, "event_type", "value", F.col("value") > 150, 3600.0)


DRIFT_COLUMNS = ("l_discount", "l_extendedprice", "l_linenumber", "l_quantity", "l_tax")
SPLIT = date(1999, 1, 1)
_WIDE = ", ".join(f"('{c}', {c})" for c in DRIFT_COLUMNS)


# The series of the Kolmogorov distribution, from the same counts.
_LAM = "sqrt(reference_rows::DOUBLE * current_rows / (reference_rows::DOUBLE + current_rows)) * ks"
P_VALUE = f"""CASE WHEN {_LAM} < 0.2::DOUBLE THEN 1::DOUBLE ELSE least(greatest(2 * list_sum(list_transform(range(1, 101),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2::DOUBLE * k * k * ({_LAM}) * ({_LAM})))), 0::DOUBLE), 1::DOUBLE) END"""


def drift_sql(current: str) -> str:
    """Distances between the rows before the split and ``current``, from ordered distinct values."""
    return f"""
reference AS (SELECT {", ".join(f"{c}::DOUBLE AS {c}" for c in DRIFT_COLUMNS)} FROM lineitem WHERE l_shipdate < DATE '{SPLIT}'),
current_rows AS ({current}),
sides AS (SELECT 1 AS ref, * FROM reference UNION ALL SELECT 0, * FROM current_rows),
long AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, ref FROM sides" for c in DRIFT_COLUMNS)}),
n AS (SELECT feature, value, sum(ref) AS rn, sum(1 - ref) AS cn FROM long GROUP BY 1, 2),
cdf AS (SELECT feature, value, abs(sum(rn) OVER w / (sum(rn) OVER p)::DOUBLE - sum(cn) OVER w / (sum(cn) OVER p)::DOUBLE) AS gap, lead(value) OVER w - value AS step,
   sum(rn) OVER p AS rt, sum(cn) OVER p AS ct FROM n WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)),
spread AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, stddev_pop({c}) AS sd FROM reference" for c in DRIFT_COLUMNS)}),
distance AS (SELECT feature, max(rt)::BIGINT AS reference_rows, max(ct)::BIGINT AS current_rows, max(gap) AS ks, sum(gap * step) AS wasserstein FROM cdf GROUP BY 1),
scored AS (SELECT feature, 'Wasserstein distance (normed)' AS test, {r("wasserstein / greatest(sd, 0.001::DOUBLE)", 4)} AS score, 0.1::DOUBLE AS threshold,
   wasserstein / greatest(sd, 0.001::DOUBLE) > 0.1::DOUBLE AS drift, {r("wasserstein / greatest(sd, 0.001::DOUBLE)", 4)} AS distance, {r(P_VALUE, 4)} AS p_value
   FROM distance JOIN spread USING (feature))"""


_LATER = f"SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in DRIFT_COLUMNS)} FROM lineitem WHERE l_shipdate >= DATE '{SPLIT}'"
SHIFT = {"l_quantity": 20.0, "l_tax": -0.1, "l_linenumber": 0.05}
_SHIFTED = f"SELECT {', '.join(f'{c}::DOUBLE + {SHIFT.get(c, 0.0)}::DOUBLE AS {c}' for c in DRIFT_COLUMNS)} FROM lineitem WHERE l_shipdate >= DATE '{SPLIT}'"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return sampling.temporal_split(t.lineitem.select("l_shipdate", *DRIFT_COLUMNS), "l_shipdate", SPLIT)


def _drift(t: Tables, shifted: bool) -> DataFrame:
    past, later = _sides(t)
    return drift.drift_scores(past, drift.shifted(later, SHIFT) if shifted else later, DRIFT_COLUMNS)


@query(f"WITH {drift_sql(_LATER)} SELECT * FROM scored")
def drift_wasserstein(t: Tables) -> DataFrame:
    return _drift(t, False)


@query(f"WITH {drift_sql(_SHIFTED)} SELECT * FROM scored")
def drift_simulated(t: Tables) -> DataFrame:
    return _drift(t, True)


@query(f"WITH {drift_sql(_SHIFTED)} SELECT feature, score FROM scored WHERE drift ORDER BY score DESC, feature")
def drift_ranked(t: Tables) -> DataFrame:
    return drift.drifted_by_score(_drift(t, True)).select("feature", "score")


@query(f"WITH {drift_sql(_SHIFTED)} SELECT feature, reference_rows, current_rows, round(ks, 6) AS ks FROM distance")
def drift_ks(t: Tables) -> DataFrame:
    past, later = _sides(t)
    stats = drift.two_sample_statistics(past, drift.shifted(later, SHIFT), DRIFT_COLUMNS)
    return stats.select("feature", "reference_rows", "current_rows", F.round("ks", 6).alias("ks"))


@query(f"""WITH {drift_sql(_SHIFTED)}, s AS (SELECT {r("avg(drift::INTEGER)", 4)} AS drifted_share FROM scored)
SELECT drifted_share, 0.3::DOUBLE AS drift_share_alert, drifted_share >= 0.3::DOUBLE AS drift_detected, drifted_share >= 0.3::DOUBLE AS retrain_recommended FROM s""")
def drift_share(t: Tables) -> DataFrame:
    return drift.drift_summary(_drift(t, True))


@query(f"""WITH {drift_sql(_SHIFTED)}, moved AS (SELECT unnest({list(SHIFT)!r}) AS feature), flagged AS (SELECT feature FROM scored WHERE drift)
SELECT feature, 'flagged' AS outcome FROM moved WHERE feature IN (FROM flagged) UNION ALL SELECT feature, 'missed' FROM moved WHERE feature NOT IN (FROM flagged)
UNION ALL SELECT feature, 'false_alarm' FROM flagged WHERE feature NOT IN (FROM moved)""")
def drift_flags(t: Tables) -> DataFrame:
    moved = t.spark.createDataFrame([(c,) for c in SHIFT], "feature string")
    return drift.flagged_sets(_drift(t, True), moved)


@query(f"""WITH {drift_sql(_LATER)}, a AS (SELECT {r("avg(drift::INTEGER)", 4)} AS s FROM scored)
SELECT 'published' AS scenario, s AS drifted_share FROM a UNION ALL
SELECT 'simulated', (WITH {drift_sql(_SHIFTED)} SELECT {r("avg(drift::INTEGER)", 4)} FROM scored)""")
def drift_scenarios(t: Tables) -> DataFrame:
    return drift_by_scenario({"published": drift.drift_summary(_drift(t, False)), "simulated": drift.drift_summary(_drift(t, True))})


_HALF = "(o_orderkey * 2654435761 + 42) % 4294967296 < 2147483648"
_ORDERS = "SELECT o_totalprice::DOUBLE AS o_totalprice, (o_orderkey % 97)::DOUBLE AS k97 FROM orders"


def _halves_sql(scenario: str, shift: float) -> str:
    """Scores of the second half of all orders, shifted, against the first."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, ref FROM sides" for c in ("o_totalprice", "k97"))
    return f"""SELECT '{scenario}' AS scenario, scored.* FROM (WITH reference AS ({_ORDERS} WHERE {_HALF}),
sides AS (SELECT 1 AS ref, * FROM reference UNION ALL SELECT 0, o_totalprice + {shift}::DOUBLE, k97 FROM ({_ORDERS} WHERE NOT {_HALF})), long AS ({long}),
n AS (SELECT feature, value, sum(ref) AS rn, sum(1 - ref) AS cn FROM long GROUP BY 1, 2),
cdf AS (SELECT feature, value, abs(sum(rn) OVER w / (sum(rn) OVER p)::DOUBLE - sum(cn) OVER w / (sum(cn) OVER p)::DOUBLE) AS gap, lead(value) OVER w - value AS step,
   sum(rn) OVER p AS rt, sum(cn) OVER p AS ct FROM n WINDOW w AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)),
spread AS (SELECT 'o_totalprice' AS feature, stddev_pop(o_totalprice) AS sd FROM reference UNION ALL SELECT 'k97', stddev_pop(k97) FROM reference),
d AS (SELECT feature, max(rt)::BIGINT AS reference_rows, max(ct)::BIGINT AS current_rows, max(gap) AS ks, sum(gap * step) AS wasserstein FROM cdf GROUP BY 1)
SELECT feature, 'Wasserstein distance (normed)' AS test, {r("wasserstein / greatest(sd, 0.001::DOUBLE)", 4)} AS score, 0.1::DOUBLE AS threshold,
  wasserstein / greatest(sd, 0.001::DOUBLE) > 0.1::DOUBLE AS drift, {r("wasserstein / greatest(sd, 0.001::DOUBLE)", 4)} AS distance, {r(P_VALUE, 4)} AS p_value FROM d JOIN spread USING (feature)) AS scored"""


@query(f"{_halves_sql('control', 0.0)} UNION ALL {_halves_sql('simulated', 90000.0)}")
def drift_sensitivity(t: Tables) -> DataFrame:
    """Control and simulated scores on two halves of all orders."""
    rows = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 97).cast("double").alias("k97"))
    half = _draw("o_orderkey") < (1 << 31)
    both = drift.sensitivity(rows, ["o_orderkey"], ["o_totalprice", "k97"], shift={"o_totalprice": 90000.0}, half=half)
    return both["control"].withColumn("scenario", F.lit("control")).unionByName(both["simulated"].withColumn("scenario", F.lit("simulated")))


@query()
def drift_halves(t: Tables) -> DataFrame:
    """Control and simulated scores on the two halves that the operator's own draw makes of all orders."""
    rows = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 97).cast("double").alias("k97"))
    both = drift.sensitivity(rows, ["o_orderkey"], ["o_totalprice", "k97"], shift={"o_totalprice": 90000.0})
    return both["control"].withColumn("scenario", F.lit("control")).unionByName(both["simulated"].withColumn("scenario", F.lit("simulated")))


@query("SELECT l_shipdate < DATE '1999-01-01' AS past, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def temporal_split(t: Tables) -> DataFrame:
    past, later = sampling.temporal_split(t.lineitem, "l_shipdate", SPLIT)
    return past.withColumn("past", F.lit(True)).unionByName(later.withColumn("past", F.lit(False))).groupBy("past").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def _draw(column: str):
    """A draw both engines can compute: a multiplicative hash of the key."""
    return F.pmod(F.col(column) * F.lit(2654435761) + F.lit(42), F.lit(1 << 32))


@query("""WITH k AS (SELECT l_suppkey, (l_suppkey * 2654435761 + 42) % 4294967296 AS draw FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
t AS (SELECT l_suppkey, row_number() OVER (ORDER BY draw, l_suppkey) <= ceil((SELECT count(*) FROM k) * 0.25::DOUBLE) AS is_test FROM k)
SELECT l_suppkey, is_test, count(*) AS rows FROM lineitem JOIN t USING (l_suppkey) GROUP BY 1, 2""")
def group_holdout(t: Tables) -> DataFrame:
    flagged = sampling.group_holdout(t.lineitem.select("l_suppkey"), "l_suppkey", draw=_draw("l_suppkey"))
    return flagged.groupBy("l_suppkey", "is_test").agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_orderkey * 2654435761 + 42) % 4294967296, o_orderkey LIMIT 500""")
def fixed_sample(t: Tables) -> DataFrame:
    return sampling.fixed_sample(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500, draw=_draw("o_orderkey"))


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)) = 1""")
def first_per_class(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    keyed = rows.withColumn("_order", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return sampling.first_per_class(keyed, "l_returnflag", "_order").drop("_order")


@query(f"""SELECT l_orderkey, {r("l_linenumber + 0.05::DOUBLE", 4)} AS l_linenumber, l_partkey, l_suppkey, {r("l_quantity + 20", 4)} AS l_quantity, {r("l_tax - 0.1::DOUBLE", 4)} AS l_tax FROM lineitem""")
def scenario_shift(t: Tables) -> DataFrame:
    moved = drift.shifted(t.lineitem, SHIFT)
    return moved.select("l_orderkey", "l_partkey", "l_suppkey", *[round_even(c, 4).alias(c) for c in SHIFT])


ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Models on whole line items: what a return flag looks like from the numbers of a line.
MODEL_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
QUERY_TRAINING = Training(split=SPLIT, features=MODEL_COLUMNS, target="target", forest_trees=10, forest_depth=5, boost_rounds=4, boost_depth=3)
# One tree with a candidate at every value fits the two-input target exactly, cutting half-way between values.
EXACT_TREE = replace(QUERY_TRAINING, forest_trees=1, max_bins=64)
_TARGET = "CASE WHEN l_quantity < 20 THEN 0 WHEN l_discount < 0.05::DOUBLE THEN 1 ELSE 2 END"


def model_rows(t: Tables) -> DataFrame:
    """Class 2 for large discounted lines, 1 for the rest of the large ones, 0 else."""
    target = F.when(F.col("l_quantity") < 20, 0).when(F.col("l_discount") < 0.05, 1).otherwise(2)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("date"), *MODEL_COLUMNS[:-1], target.alias("target"))




def one_per_key(rows: DataFrame) -> DataFrame:
    """One row per key, by a total order of all its columns."""
    return keep_last(rows, ROW_KEY, [F.col(c).asc() for c in sorted(set(rows.columns) - set(ROW_KEY))])  # a struct would move every column twice


def _forest(t: Tables):
    return learn.train(model_rows(t), "forest", MODEL_COLUMNS, "target", QUERY_TRAINING)


_KEY_SQL = ", ".join(ROW_KEY).replace("l_linenumber", "l_linenumber::DOUBLE AS l_linenumber")  # model inputs are doubles


def _exact_tree(t: Tables):
    return learn.train(model_rows(t), "forest", MODEL_COLUMNS, "target", EXACT_TREE)


@query(f"SELECT {_KEY_SQL}, {_TARGET} AS target, {_TARGET} AS stress_code, 1::DOUBLE AS confidence FROM lineitem")
def forest_scores(t: Tables) -> DataFrame:
    return learn.score(_exact_tree(t), model_rows(t), MODEL_COLUMNS).select(*ROW_KEY, "target", "stress_code", "confidence")


@query(f"SELECT {_KEY_SQL}, {_TARGET} AS target, {_TARGET} AS stress_code FROM lineitem")
def boosted_scores(t: Tables) -> DataFrame:
    model = learn.train(model_rows(t), "boosted_light", MODEL_COLUMNS, "target", EXACT_TREE)
    return learn.score(model, model_rows(t), MODEL_COLUMNS).select(*ROW_KEY, "target", "stress_code")


@query()
def forest_importances(t: Tables) -> DataFrame:
    return learn.importances(_forest(t), MODEL_COLUMNS, t.spark).limit(10)


_UNIQUE_SQL = f"""u AS (SELECT *, {_TARGET} AS target FROM lineitem QUALIFY row_number() OVER (PARTITION BY {", ".join(ROW_KEY)}
  ORDER BY l_shipdate, l_discount, l_extendedprice, l_quantity, l_tax) = 1),
m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d FROM u),
v AS (SELECT u.*, CASE WHEN m.q < 19.5::DOUBLE THEN 0 WHEN l_discount < 0.045::DOUBLE THEN 1 ELSE 2 END AS by_quantity,
  CASE WHEN l_quantity < 19.5::DOUBLE THEN 0 WHEN m.d < 0.045::DOUBLE THEN 1 ELSE 2 END AS by_discount FROM u, m)"""


_PARTS = ", ".join(f"{{'feature': '{c}', 'value': {c}::DOUBLE, 'i': {i}}}" for c, i in (
    ("l_discount", "(by_discount <> target)::INTEGER"), ("l_quantity", "(by_quantity <> target)::INTEGER"), ("l_extendedprice", "0"), ("l_linenumber", "0"), ("l_tax", "0"),
))


@query(f"""WITH {_UNIQUE_SQL}, p AS (SELECT {_KEY_SQL}, target AS class, unnest([{_PARTS}]) AS e FROM v),
d AS (SELECT {", ".join(ROW_KEY)}, class, e.feature AS feature, e.value AS value, e.i AS i, sum(e.i) OVER k AS total, row_number() OVER (k ORDER BY -e.i, e.feature) AS rank
  FROM p WINDOW k AS (PARTITION BY {", ".join(ROW_KEY)})),
f AS (SELECT {", ".join(ROW_KEY)}, class, rank, feature, feature AS label, {r("value", 3)} AS value, CASE WHEN total = 0 THEN 0::DOUBLE ELSE {r("i * 100::DOUBLE / total", 1)} END AS impact_pct,
  CASE WHEN i > 0 THEN 'increases_stress' ELSE 'mitigates_stress' END AS direction, CASE WHEN i > 0 THEN '↑' ELSE '↓' END AS arrow FROM d WHERE rank <= 4)
SELECT *, arrow || ' ' || label || ' (' || printf('%.2f', value) || '): ' || impact_pct || '% of the impact on ' || ['LOW', 'MODERATE', 'HIGH'][class + 1] AS summary FROM f""")
def attribution_topk(t: Tables) -> DataFrame:
    rows = one_per_key(model_rows(t))
    return learn.top_drivers(learn.impacts(_exact_tree(t), rows, ROW_KEY, MODEL_COLUMNS, learn.means_row(rows, MODEL_COLUMNS)), ROW_KEY)


@query(f"""WITH {_UNIQUE_SQL}, a AS (SELECT 'l_quantity' AS feature, avg(abs((target = 2)::INTEGER - (by_quantity = 2)::INTEGER)) AS i FROM v
  UNION ALL SELECT 'l_discount', avg(abs((target = 2)::INTEGER - (by_discount = 2)::INTEGER)) FROM v
  UNION ALL SELECT unnest(['l_extendedprice', 'l_tax', 'l_linenumber']), 0)
SELECT feature, {r("i", 6)} AS mean_abs_impact FROM a""")
def global_attribution(t: Tables) -> DataFrame:
    rows = one_per_key(model_rows(t))
    return learn.global_attribution(_exact_tree(t), rows, ROW_KEY, MODEL_COLUMNS, learn.means_row(rows, MODEL_COLUMNS), by_key=True)


@query()
def three_way_test(t: Tables) -> DataFrame:
    """All three models at their published sizes."""
    settings = Training(split=SPLIT, features=MODEL_COLUMNS, target="target", label_inputs=("l_discount",))
    return learn.three_way_test(model_rows(t), settings, group="l_orderkey", when="date")


def _titles_sql() -> str:
    cases = " ".join(f"WHEN rule = {n} AND language = '{lang}' THEN '{told[lang][1]}'" for n, told in advice.TEXTS.items() for lang in ("en", "mr", "hi"))
    return f"CASE {cases} END"


@query(f"""WITH q AS (SELECT p_partkey, p_size::DOUBLE AS size, (p_partkey % 10) / 100::DOUBLE AS discount, p_partkey % 9 AS rain, ['en', 'mr', 'hi'][p_partkey % 3 + 1] AS language FROM part),
c AS (SELECT *, CASE WHEN size < 19.5::DOUBLE THEN 0 WHEN discount < 0.045::DOUBLE THEN 1 ELSE 2 END AS stress_code FROM q),
n AS (SELECT *, CASE WHEN stress_code = 2 AND size >= 33 THEN 1 WHEN stress_code = 2 THEN 2 WHEN stress_code = 1 AND rain > 5 THEN 3 WHEN stress_code = 1 THEN 4 ELSE 5 END AS rule FROM c)
SELECT p_partkey, stress_code, 1::DOUBLE AS confidence, CASE rule WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 3 END AS priority, {_titles_sql()} AS title, language FROM n""")
def what_if_scores(t: Tables) -> DataFrame:
    """Every part as a scenario: scored, advised and told in its own language."""
    requests = t.part.select(
        "p_partkey", F.col("p_size").cast("double").alias("l_quantity"), ((F.col("p_partkey") % 10) / F.lit(100.0)).alias("l_discount"),
        F.col("p_size").cast("double").alias("temp_max_c"), F.lit(30.0).alias("et0_8day_sum"), (F.col("p_partkey") % 9).cast("double").alias("rainfall_8day"),
    )
    language = F.element_at(F.array(F.lit("en"), F.lit("mr"), F.lit("hi")), (F.col("p_partkey") % 3 + 1).cast("int"))
    told = learn.what_if(_exact_tree(t), requests, MODEL_COLUMNS, language)
    return told.select("p_partkey", "stress_code", "confidence", F.col("advisory.priority").alias("priority"), F.col("advisory.title").alias("title"), F.col("advisory.language").alias("language"))
