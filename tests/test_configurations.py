from bandwright.operators import decision
from bandwright.plans import decision as plans


def test_in_sample_has_every_configuration(spark, data):
    got = {r.config: r for r in plans.in_sample_metrics(spark, data).collect()}
    assert set(got) == {*decision.CONFIGS, "E"}
    rows = plans.verified(spark, data)
    tau = decision.best_tau(rows, []).first().tau
    n, wrong = rows.filter("hit = 0").count(), rows.filter(f"hit = 0 AND sim > {tau}").count()
    assert got["A"].false_hit == round(wrong / n, 6)


def test_learned_configuration(spark, data):
    got = plans.learned_metrics(spark, data).collect()
    assert [r.config for r in got] == ["E"]
    rows = decision.logistic(plans.verified(spark, data), plans.FEATURES, plans.FOLDS).select("hit", "p").toPandas()
    miss = rows[rows["hit"] == 0]
    assert got[0].false_hit == round(float((miss["p"] > 0.5).mean()), 6)


def test_replicates_of_the_reference(spark, data, monkeypatch):
    asked = []
    made = plans.bootstrap.replicates
    monkeypatch.setattr(plans.bootstrap, "replicates", lambda rows, key, counts, reps, keys: asked.append(reps) or made(rows, key, counts, 5, keys))
    plans.c4_bootstrap(spark, data)
    assert asked == [2000]


def test_all_metrics_hold_the_others(spark, data):
    got = {(r.config, r.metric): r for r in plans.all_metrics(spark, data).collect()}
    assert len(got) == 7 * len(decision.RATIOS)
    for table in (plans.config_metrics, plans.learned_metrics):
        for r in table(spark, data).collect():
            assert all(got[r.config, m].value == r[m] or r[m] != r[m] for m in decision.RATIOS)
    assert all(r.lo <= r.value <= r.hi for r in got.values() if r.lo is not None and r.value == r.value and r.hi > r.lo)
    assert {r.config for r in plans.all_reductions(spark, data).collect()} == {*decision.CONFIGS[1:], "E"}
