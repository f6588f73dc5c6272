"""Cache simulations over the embeddings table and over a workload of whole families with their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwright.functions.text import acronym_slots, normalise_answer, number_slots, word_set
from bandwright.operators import cachesim, windows
from bandwright.operators.pairs import embed
from bandwright.plans.base import PAIRS, kept, pairs, r6, strip_sql, with_
from bandwright.plans.decision import _ACR, _NUM, tuned_on_all
from bandwright.session import cut, load
from bandwright.streaming import events

TAUS = [0.2, 0.25, 0.3]
TEXT_TAUS = [0.85, 0.9, 0.95]
#: Orders of cache_sim and order_sensitivity, which the recursive SQL beside them walks too.
ORDERS = 3
#: The reference's numbers of orders: of the text workload (RQ3b), of the pilot, of sweeps and architectures.
TEXT_ORDERS, PILOT_ORDERS, SWEEP_ORDERS = 500, 200, 50
CAPACITIES = [(p, c) for p in ("fifo", "lru") for c in (50, 150, 300)]
SIZES = (100, 500, 1000, 2500, 5231)
WORKLOAD = 5000
ENCODERS = ("table", "trigrams", "words")
#: A threshold at which other families' entries are served.
CONFUSING = 0.3
SETTING = ["tau", "rule", "policy", "capacity", "alpha"]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the embeddings table as items; the label is the answer key."""
    rows = load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"), F.col("label").cast("string").alias("key"))
    return windows.number_rows(rows, [F.col("vec_id")], "item").withColumn("item", F.col("item").cast("int"))


def workload(spark: SparkSession, d: str) -> DataFrame:
    """A sample of whole families (until WORKLOAD pairs): each family's seed question and variations, with vectors, keys, answers and documents.

    Only pairs with a vector, of seeds whose question has one, are there to be sampled, so what is drawn is what is simulated.

    The key of a seed question and of a HIT variation is the seed, of a MISS variation its own id.
    """

    def make():
        v = load(spark, d, "pair_vectors").filter(F.exists("vec", lambda e: e != 0))
        p = pairs(spark, d).select("id", "seed_id", "seed_question", "variation", "answer", "axis", "hit")
        asked, asking = (v.filter(f"field = '{f}'").filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("vec").alias("vec")) for f, k in (("variation", "id"), ("seed_question", "seed_id")))
        rows = windows.family_sample(p.join(asked, "id").join(asking.select("seed_id"), "seed_id", "left_semi"), "seed_id", WORKLOAD)
        doc = load(spark, d, "t02_seeds").groupBy("seed_id").agg(F.min("doc_id").alias("doc"))
        ans = normalise_answer(F.col("answer"))
        variations = rows.select(
            "seed_id", "id", F.col("variation").alias("text"), "vec", "axis", F.when(F.col("hit") == 1, "HIT").otherwise("MISS").alias("kind"), F.when(F.col("hit") == 1, ans).alias("ans")
        )
        seeds = rows.groupBy("seed_id").agg(F.min(F.struct("id", "seed_question", "answer")).alias("s")).join(asking, "seed_id")
        seeds = seeds.select("seed_id", F.lit("").alias("id"), F.col("s.seed_question").alias("text"), "vec", F.lit("seed").alias("axis"), F.lit("seed").alias("kind"), normalise_answer(F.col("s.answer")).alias("ans"))
        items = windows.number_rows(seeds.unionByName(variations), [F.col("seed_id"), F.col("id")], "item").withColumn("item", F.col("item").cast("int"))
        text = F.coalesce("text", F.lit(""))
        slots = F.concat_ws("|", F.concat_ws(",", number_slots(text)), F.concat_ws(",", acronym_slots(text)))
        full = items.join(doc, "seed_id", "left").withColumn("key", F.when(F.col("kind") == "MISS", F.col("id")).otherwise(F.col("seed_id")))
        return full.select("item", "vec", "key", F.col("seed_id").alias("family"), "kind", "axis", "doc", "ans", text.alias("text"), word_set(text).alias("words"), slots.alias("slots"))

    return kept(spark, d, "workload", make)


def _rates(served: DataFrame, items: DataFrame) -> DataFrame:
    out = cut(cachesim.outcome(served, items).select(*SETTING, "order_id", "item", "got", "hit", "wrong"))  # read twice, walked once
    return cachesim.rates(out).select(*SETTING, "arrivals", *r6("hit", "hit_std", "wrong", "sensitivity"))


def cache_sim(spark: SparkSession, d: str) -> DataFrame:
    served = cachesim.simulate(vectors(spark, d), cachesim.settings(spark, TAUS, ORDERS))
    return served.select("tau", "order_id", "pos", "item", "stored")


def order_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    items = vectors(spark, d)
    return _rates(cachesim.simulate(items, cachesim.settings(spark, TAUS, ORDERS)), items).drop("rule", "policy", "capacity", "alpha")


def index_keyed_sim(spark: SparkSession, d: str) -> DataFrame:
    """The same arrivals with the item itself as the key: any serve is another item's."""
    items = vectors(spark, d).withColumn("key", F.col("item").cast("string"))
    return _rates(cachesim.simulate(items, cachesim.settings(spark, TAUS, PILOT_ORDERS)), items).drop("rule", "policy", "capacity", "alpha")


def cache_sim_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Every arrival with bounded caches: the entry stored first or used longest ago goes."""
    served = cachesim.simulate(vectors(spark, d), cachesim.settings(spark, [0.25], ORDERS, policies=CAPACITIES))
    return served.select("policy", "capacity", "order_id", "pos", "item", "stored")


def cache_sim_verified(spark: SparkSession, d: str) -> DataFrame:
    """Every arrival with a verifier that is asked about an entry more similar than tau."""
    served = cachesim.simulate(vectors(spark, d), cachesim.settings(spark, TAUS, ORDERS, rules=["V"]))
    return served.select("tau", "order_id", "pos", "item", "stored")


def cache_sim_eviction(spark: SparkSession, d: str) -> DataFrame:
    policies = [("none", 0), *CAPACITIES]
    items = vectors(spark, d)
    return _rates(cachesim.simulate(items, cachesim.settings(spark, [0.25], SWEEP_ORDERS, policies=policies)), items).drop("rule", "alpha")


def cache_sim_zipf(spark: SparkSession, d: str) -> DataFrame:
    items = vectors(spark, d)
    return _rates(cachesim.simulate(items, cachesim.settings(spark, [0.25], SWEEP_ORDERS, alphas=[0.6, 0.8, 1.0, 1.2], length=5000)), items).drop("rule", "policy", "capacity")


def cache_sim_size(spark: SparkSession, d: str) -> DataFrame:
    """The first n items as smaller workloads: the cache's behaviour by size."""
    items = vectors(spark, d)
    total, out = items.count(), None
    for n in sorted({min(n, total) for n in SIZES}):  # a smaller table ends at its own size
        part = items.filter(F.col("item") < n)
        r = _rates(cachesim.simulate(part, cachesim.settings(spark, [0.25], SWEEP_ORDERS)), part).select(F.lit(n).alias("items"), "tau", "arrivals", "hit", "hit_std", "wrong", "sensitivity")
        out = r if out is None else out.unionByName(r)
    return out


def cache_sim_text(spark: SparkSession, d: str) -> DataFrame:
    items = workload(spark, d)
    return _rates(cachesim.simulate(items, cachesim.settings(spark, TEXT_TAUS, TEXT_ORDERS)), items).drop("rule", "policy", "capacity", "alpha")


def arch_rules(spark: SparkSession, d: str) -> DataFrame:
    """Threshold, cross scorer with its tuned threshold, and slots, over the same orders."""
    items, tuned = workload(spark, d), tuned_on_all(spark, d).first()
    cross = 0.5 if tuned is None or tuned.t_ce is None else tuned.t_ce
    return _rates(cachesim.simulate(items, cachesim.settings(spark, [0.9], SWEEP_ORDERS, rules=["A", "B", "D"]), cross=cross), items).drop("policy", "capacity", "alpha")


def serve_classes(spark: SparkSession, d: str) -> DataFrame:
    items = workload(spark, d)
    served = cachesim.simulate(items, cachesim.settings(spark, TEXT_TAUS, TEXT_ORDERS))
    return cachesim.serve_counts(cachesim.classify(served, items)).drop("rule", "policy", "capacity", "alpha")


def answer_text_keys(spark: SparkSession, d: str) -> DataFrame:
    """The same simulation keyed by normalised answer text where there is one."""
    items = workload(spark, d).withColumn("key", F.coalesce("ans", "key"))
    return _rates(cachesim.simulate(items, cachesim.settings(spark, TEXT_TAUS, TEXT_ORDERS)), items).drop("rule", "policy", "capacity", "alpha")


def seed_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Families that are served each other's answers, at a threshold low enough for that to happen."""
    items = workload(spark, d)
    served = cachesim.simulate(items, cachesim.settings(spark, [CONFUSING], TEXT_ORDERS))
    return cachesim.confusion(cachesim.classify(served, items))


def _encoded(items: DataFrame, encoder: str) -> DataFrame:
    """``items`` with the vectors of an encoder: the table's own, hashed trigrams, or hashed words."""
    if encoder == "table":
        return items
    if encoder == "trigrams":
        part = embed(items.select("text")).select("text", F.conv("bucket", 16, 10).cast("int").alias("k"), F.col("v").cast("double").alias("v"))
    else:
        words = items.select("text", "words").distinct().select("text", F.explode("words").alias("w"))
        part = words.groupBy("text", F.pmod(F.xxhash64("w"), F.lit(256)).cast("int").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    by = part.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("by"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0.0)))
    none = F.create_map().cast("map<int,double>")
    return items.drop("vec").join(by, "text", "left").withColumn("by", F.coalesce("by", none)).withColumn("vec", vec).drop("by")


def cache_sim_encoders(spark: SparkSession, d: str) -> DataFrame:
    """Rates over thresholds 0.80 to 0.98 with three encoders, on the first 2,500 items of the workload."""
    items, out = workload(spark, d).filter("item < 2500"), None
    taus = [round(0.8 + 0.02 * k, 2) for k in range(10)]
    for encoder in ENCODERS:
        own = cut(_encoded(items, encoder))
        r = _rates(cachesim.simulate(own, cachesim.settings(spark, taus, SWEEP_ORDERS)), own).select(F.lit(encoder).alias("encoder"), "tau", "arrivals", "hit", "hit_std", "wrong", "sensitivity")
        out = r if out is None else out.unionByName(r)
    return out


def served_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of what is served in three orders, at a threshold at which families mix and at one at which they don't."""
    items = workload(spark, d)
    served = cachesim.simulate(items, cachesim.settings(spark, [CONFUSING, 0.85], ORDERS))
    return cachesim.serve_counts(cachesim.classify(served, items)).drop("rule", "policy", "capacity", "alpha")


def served_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of families that are served each other's answers in three orders."""
    items = workload(spark, d)
    return cachesim.confusion(cachesim.classify(cachesim.simulate(items, cachesim.settings(spark, [CONFUSING], ORDERS)), items))


def served_answers(spark: SparkSession, d: str) -> DataFrame:
    """Rates keyed by normalised answer text, in three orders."""
    items = workload(spark, d).withColumn("key", F.coalesce("ans", "key"))
    return _rates(cachesim.simulate(items, cachesim.settings(spark, [CONFUSING, 0.85], ORDERS)), items).drop("rule", "policy", "capacity", "alpha")


def served_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rates of threshold alone and of threshold with equal slots, over the same three orders."""
    items = workload(spark, d)
    return _rates(cachesim.simulate(items, cachesim.settings(spark, [0.85], ORDERS, rules=["A", "D"])), items).drop("policy", "capacity", "alpha")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by type in tumbling hours."""
    return events.tumbling(load(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return events.sliding(load(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "users")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events less than 30 minutes apart."""
    return events.sessions(load(spark, d, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def event_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Users' mean and longest gap between events, in seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    return load(spark, d, "events").withColumn("gap", gap).groupBy("user_id").agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 3).alias("mean"), F.round(F.max("gap"), 3).alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        cache_sim, cache_sim_capacity, cache_sim_verified, order_sensitivity, index_keyed_sim, cache_sim_eviction, cache_sim_zipf, cache_sim_size, cache_sim_encoders, cache_sim_text, arch_rules, serve_classes,
        answer_text_keys, seed_confusion, served_classes, served_confusion, served_answers, served_rules, event_windows, event_sliding, event_sessions, event_gaps,
    )
}

_SIM = f"""WITH RECURSIVE items AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS item, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS VARCHAR) AS key FROM embeddings),
m AS (SELECT list(x ORDER BY item) AS xs FROM items),
g AS (SELECT tau, o FROM (SELECT unnest([{", ".join(f"{t!r}e0" for t in TAUS)}]) AS tau) CROSS JOIN range(0, {ORDERS}) r(o)),
arr AS (SELECT o, item, x, row_number() OVER (PARTITION BY o ORDER BY substring(md5(o || ':' || item), 1, 15), item) - 1 AS pos FROM items CROSS JOIN range(0, {ORDERS}) r(o)),
step AS (
  SELECT tau, o, CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS st, CAST(NULL AS BIGINT) AS item, CAST(NULL AS BIGINT) AS stored FROM g
  UNION ALL
  SELECT tau, o, pos, CASE WHEN best > tau THEN st ELSE list_append(st, item) END, item, CASE WHEN best > tau THEN st[list_position(sims, best)] END
  FROM (SELECT *, list_max(sims) AS best FROM (SELECT s.tau, s.o, a.pos, s.st, a.item, list_transform(s.st, lambda j: list_dot_product(a.x, m.xs[j + 1])) AS sims
        FROM step s JOIN arr a ON a.o = s.o AND a.pos = s.pos + 1, m))),
served AS (SELECT tau, o AS order_id, pos, s.item, s.stored, a.key AS own, coalesce(b.key, a.key) AS got FROM step s JOIN items a ON s.item = a.item LEFT JOIN items b ON s.stored = b.item WHERE pos >= 0)"""

#: The same with what the cache does at a step left open: the state after it, and whether the entry is served.
_EMBEDDED = "items AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS item, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS VARCHAR) AS key, '' AS slots FROM embeddings)"


def _steps(grid: str, keep: str, serve: str, keys: str, orders: int = ORDERS, items: str = _EMBEDDED) -> str:
    k = keys.split(", ")
    return f"""WITH RECURSIVE {items},
m AS (SELECT list(x ORDER BY item) AS xs, list(key ORDER BY item) AS keys, list(slots ORDER BY item) AS slots FROM items), g AS (SELECT {keys}, o FROM {grid} CROSS JOIN range(0, {orders}) r(o)),
arr AS (SELECT o, item, x, row_number() OVER (PARTITION BY o ORDER BY substring(md5(o || ':' || item), 1, 15), item) - 1 AS pos FROM items CROSS JOIN range(0, {orders}) r(o)),
step AS (
  SELECT {keys}, o, CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS st, CAST(NULL AS BIGINT) AS item, CAST(NULL AS BIGINT) AS stored FROM g
  UNION ALL
  SELECT {keys}, o, pos, CASE WHEN yes THEN {keep} ELSE {{miss}} END, item, CASE WHEN yes THEN j END FROM (
    SELECT *, coalesce({serve}, false) AS yes FROM (
      SELECT *, list_max(sims) AS best, st[list_position(sims, list_max(sims))] AS j FROM (
        SELECT {", ".join(f"s.{c}" for c in k)}, s.o, a.pos, s.st, a.item, m.keys, m.slots, list_transform(s.st, lambda j: list_dot_product(a.x, m.xs[j + 1])) AS sims FROM step s JOIN arr a ON a.o = s.o AND a.pos = s.pos + 1, m))))
SELECT {keys}, CAST(o AS INT) AS order_id, CAST(pos AS INT) AS pos, CAST(item AS INT) AS item, CAST(stored AS INT) AS stored FROM step WHERE pos >= 0"""


def _rates_sql(steps: str, keys: str, own: str = "i.key", got: str = "j.key") -> str:
    """The rates of the steps by their keys."""
    k = keys.split(", ")
    return f"""{steps[: steps.rindex("SELECT ")]}, out AS ({steps[steps.rindex("SELECT ") :]}),
s AS (SELECT {", ".join(f"t.{c}" for c in k)}, t.order_id, t.item, t.stored, {own} AS own, coalesce({got}, {own}) AS got FROM out t JOIN items i ON t.item = i.item LEFT JOIN items j ON t.stored = j.item),
per AS (SELECT {keys}, order_id, count(*) AS n, avg(CAST(stored IS NOT NULL AS INT)) AS h, avg(CAST(own <> got AS INT)) AS w FROM s GROUP BY ALL),
u AS (SELECT {keys}, avg(CAST(c > 1 AS INT)) AS sensitivity FROM (SELECT {keys}, item, count(DISTINCT got) AS c FROM s GROUP BY ALL) GROUP BY {keys})
SELECT {", ".join(f"p.{c}" for c in k)}, CAST(sum(n) AS BIGINT) AS arrivals, round(avg(h), 6) AS hit, round(stddev_pop(h), 6) AS hit_std, round(avg(w), 6) AS wrong, round(any_value(u.sensitivity), 6) AS sensitivity
FROM per p JOIN u ON {" AND ".join(f"p.{c} = u.{c}" for c in k)} GROUP BY {", ".join(f"p.{c}" for c in k)}"""


_TAU_GRID = f"(SELECT unnest([{', '.join(f'{t!r}e0' for t in TAUS)}]) AS tau)"
_CAPS = "(VALUES " + ", ".join(f"('{p}', CAST({c} AS INT){{0}})" for p, c in CAPACITIES) + ") v(policy, capacity)"
_USED, _ROOM = "CASE policy WHEN 'lru' THEN list_append(list_filter(st, lambda y: y <> j), j) ELSE st END", "list_append(CASE WHEN capacity > 0 AND len(st) >= capacity THEN st[2:] ELSE st END, item)"

_ANS = strip_sql(rf"regexp_replace(regexp_replace(lower(answer), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s\p{{Z}}]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')")
_SLOTS = "array_to_string(" + _NUM("text") + ", ',') || '|' || array_to_string(" + _ACR("text") + ", ',')"
_WORKLOAD = f"""{PAIRS},
v AS (SELECT * FROM pair_vectors WHERE list_sum(list_transform(vec, lambda y: abs(y))) > 0),
asked AS (SELECT id, min(vec) AS vec FROM v WHERE field = 'variation' AND id IS NOT NULL GROUP BY id), asking AS (SELECT seed_id, min(vec) AS vec FROM v WHERE field = 'seed_question' AND seed_id IS NOT NULL GROUP BY seed_id),
base AS (SELECT p.*, a.vec FROM pairs p JOIN asked a ON p.id = a.id WHERE p.seed_id IN (SELECT seed_id FROM asking)),
size AS (SELECT seed_id, count(*) AS n FROM base GROUP BY seed_id), before AS (SELECT seed_id, coalesce(sum(n) OVER (ORDER BY substring(md5('family:' || seed_id), 1, 15) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM size),
drawn AS (SELECT * FROM base WHERE seed_id IN (SELECT seed_id FROM before WHERE b < {WORKLOAD})),
doc AS (SELECT seed_id, min(doc_id) AS doc FROM t02_seeds GROUP BY seed_id),
rows AS (SELECT seed_id, id, coalesce(variation, '') AS text, vec, axis, CASE WHEN hit = 1 THEN 'HIT' ELSE 'MISS' END AS kind, CASE WHEN hit = 1 THEN {_ANS} END AS ans FROM drawn
  UNION ALL SELECT d.seed_id, '', coalesce(seed_question, ''), a.vec, 'seed', 'seed', {_ANS} FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY id) AS r FROM drawn) d JOIN asking a ON d.seed_id = a.seed_id WHERE r = 1),
items AS (SELECT row_number() OVER (ORDER BY r.seed_id, id) - 1 AS item, list_transform(vec, lambda y: CAST(y AS DOUBLE) / sqrt(list_sum(list_transform(vec, lambda z: CAST(z AS DOUBLE) * z)))) AS x, CASE WHEN kind = 'MISS' THEN id ELSE r.seed_id END AS key,
  r.seed_id AS family, kind, axis, doc.doc, ans, {_SLOTS} AS slots FROM rows r LEFT JOIN doc ON r.seed_id = doc.seed_id)"""
_LOW_HIGH = f"(SELECT unnest([{CONFUSING!r}e0, 0.85e0]) AS tau)"
_CLASSED = """, out AS ({0}), c AS (SELECT t.tau, i.family AS fi, j.family AS fj, i.kind AS ki, j.kind AS kj, j.axis AS aj, i.doc IS NOT DISTINCT FROM j.doc AS doc, CASE WHEN i.key = j.key THEN 'right'
  WHEN i.family = j.family THEN CASE WHEN i.kind = 'MISS' AND j.kind = 'MISS' THEN CASE WHEN i.axis = j.axis THEN 'miss_miss_same_axis' ELSE 'miss_miss_other_axis' END ELSE 'within_label' END
  WHEN i.ans IS NULL OR j.ans IS NULL THEN 'cross_unverified' WHEN i.ans = j.ans THEN 'cross_verified_same' ELSE 'cross_verified_other' END AS class FROM out t JOIN items i ON t.item = i.item JOIN items j ON t.stored = j.item)
"""


def _classed(grid: str) -> str:
    steps = _steps(grid, "st", "best > tau", "tau", ORDERS, _WORKLOAD).replace("{miss}", "list_append(st, item)")
    at = steps.rindex("SELECT ")
    return steps[:at] + _CLASSED.format(steps[at:])


_SIZED = _steps(f"(SELECT DISTINCT least(n, (SELECT count(*) FROM embeddings)) AS items FROM (VALUES {', '.join(f'({n})' for n in SIZES)}) v(n))", "st", "best > 0.25e0", "items", SWEEP_ORDERS).replace("{miss}", "list_append(st, item)")
_SIZED = _SIZED.replace("arr AS (SELECT o, item, x, row_number() OVER (PARTITION BY o ORDER", "arr AS (SELECT g.items AS of, g.o, item, x, row_number() OVER (PARTITION BY g.items, g.o ORDER").replace(f"substring(md5(o || ':' || item), 1, 15), item) - 1 AS pos FROM items CROSS JOIN range(0, {SWEEP_ORDERS}) r(o))", "substring(md5(g.o || ':' || item), 1, 15), item) - 1 AS pos FROM items JOIN g ON item < g.items)").replace("ON a.o = s.o AND a.pos", "ON a.of = s.items AND a.o = s.o AND a.pos")

ORACLES = {
    "cache_sim_size": _rates_sql(_SIZED, "items").replace("SELECT p.items,", "SELECT CAST(p.items AS INT) AS items, 0.25e0 AS tau,"),
    "served_classes": _classed(_LOW_HIGH) + """SELECT tau, class, count(*) AS serves, count(*) FILTER (WHERE fi <> fj AND doc) AS same_doc, count(*) FILTER (WHERE kj = 'MISS') AS stored_miss,
count(*) FILTER (WHERE kj = 'MISS' AND aj IN ('N1', 'N2')) AS stored_slope, count(*) FILTER (WHERE ki = 'seed' OR kj = 'seed') AS seed_involved FROM c GROUP BY tau, class""",
    "served_confusion": _classed(f"(SELECT {CONFUSING!r}e0 AS tau)") + "SELECT least(fi, fj) AS seed_a, greatest(fi, fj) AS seed_b, count(*) AS n FROM c WHERE class = 'cross_verified_other' GROUP BY ALL",
    "served_answers": _rates_sql(_steps(_LOW_HIGH, "st", "best > tau", "tau", ORDERS, _WORKLOAD).replace("{miss}", "list_append(st, item)"), "tau", "coalesce(i.ans, i.key)", "coalesce(j.ans, j.key)"),
    "served_rules": _rates_sql(_steps("(VALUES ('A', 0.85e0), ('D', 0.85e0)) v(rule, tau)", "st", "best > tau AND (rule = 'A' OR slots[item + 1] = slots[j + 1])", "rule, tau", ORDERS, _WORKLOAD).replace("{miss}", "list_append(st, item)"), "rule, tau"),
    "cache_sim_capacity": _steps(_CAPS.format(""), _USED, "best > 0.25e0", "policy, capacity").replace("{miss}", _ROOM),
    "cache_sim_eviction": _rates_sql(_steps(_CAPS.format("").replace("(VALUES ", "(VALUES ('none', CAST(0 AS INT)), "), _USED, "best > 0.25e0", "policy, capacity", SWEEP_ORDERS).replace("{miss}", _ROOM), "policy, capacity").replace("SELECT p.policy, p.capacity,", "SELECT 0.25e0 AS tau, p.policy, p.capacity,"),
    "cache_sim_verified": _steps(_TAU_GRID, "st", "best > tau AND (keys[item + 1] = keys[j + 1]) <> (substring(md5('verify:' || item || ':' || j), 1, 1) = '0')", "tau").replace("{miss}", "list_append(st, item)"),
    "index_keyed_sim": _rates_sql(_steps(_TAU_GRID, "st", "best > tau", "tau", PILOT_ORDERS).replace("{miss}", "list_append(st, item)"), "tau", "CAST(i.item AS VARCHAR)", "CAST(j.item AS VARCHAR)"),
    "cache_sim": _SIM + "SELECT tau, CAST(order_id AS INT) AS order_id, CAST(pos AS INT) AS pos, CAST(item AS INT) AS item, CAST(stored AS INT) AS stored FROM served",
    "order_sensitivity": _SIM + """, per AS (SELECT tau, order_id, count(*) AS n, avg(CAST(stored IS NOT NULL AS INT)) AS h, avg(CAST(own <> got AS INT)) AS w FROM served GROUP BY ALL),
k AS (SELECT tau, avg(CAST(c > 1 AS INT)) AS sensitivity FROM (SELECT tau, item, count(DISTINCT got) AS c FROM served GROUP BY ALL) GROUP BY tau)
SELECT p.tau, CAST(sum(n) AS BIGINT) AS arrivals, round(avg(h), 6) AS hit, round(stddev_pop(h), 6) AS hit_std, round(avg(w), 6) AS wrong, round(any_value(k.sensitivity), 6) AS sensitivity FROM per p JOIN k ON p.tau = k.tau GROUP BY p.tau""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "event_sliding": "WITH e AS (SELECT user_id, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM e GROUP BY s",
    "event_sessions": with_("g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)", "s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)", "c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL)") + "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    "event_gaps": with_("g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events)") + "SELECT user_id, count(gap) AS n, round(avg(gap), 3) AS mean, round(max(gap), 3) AS longest FROM g GROUP BY user_id",
}
