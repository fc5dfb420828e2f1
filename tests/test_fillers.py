"""Best fillers by threshold over impact-ordered blocks, and the one-pass sweep, against the whole lists."""

import random
import re
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventfit.plans import fillers, sweep
from eventfit.plans import thematic as tf
from eventfit.sources import catalog as cat

SF = "/root/testdata/sf0.001"


def invented(spark, n_words=120, hot=4_000):
    """Bigrams of which one context holds more than a third, most of them rare, with many ties."""
    r = random.Random(11)
    pairs = {}
    for i in range(hot):
        pairs["give@V@ROOT", f"w{i}@N@{r.choice(['OBJ', 'OBJ', 'OBL:on', 'NSUBJ'])}"] = float(int(r.paretovariate(1.2)) if r.random() < 0.9 else 1)
    for _ in range(hot // 2):
        a, b = r.randrange(n_words), r.randrange(hot)
        pairs[f"v{a}@V@ROOT", f"w{b}@N@{r.choice(['OBJ', 'OBL:on'])}"] = float(r.randint(1, 6))
    pairs["x@N@OBJ", "x@N@OBJ"] = 3.0
    freqs = {}
    for (a, b), f in pairs.items():
        for x in (a, b):
            freqs[x.rsplit("@", 1)[0]] = freqs.get(x.rsplit("@", 1)[0], 0.0) + f
    freqs.pop("w7@N", None)
    bigrams = spark.createDataFrame([(a, b, f) for (a, b), f in pairs.items()], "a1 string, a2 string, freq double")
    lemma_pos = spark.createDataFrame(list(freqs.items()), "lemma_pos string, freq double")
    vectors = spark.createDataFrame([(f"w{i}", [float(i % 7), 1.0]) for i in range(0, hot, 9)], "word string, vec array<double>")
    return tf.TFInputs(None, bigrams, lemma_pos, vectors)


@pytest.mark.parametrize("weight", ["lmi", "ppmi"])
def test_best_fillers_equal_whole_lists_and_read_less(spark, weight):
    inp = invented(spark)
    probes = spark.createDataFrame([("give@V@ROOT", "OBJ"), ("give@V@ROOT", "OBL"), ("give@V@ROOT", "NSUBJ"), ("w3@N@OBJ", "ROOT"), ("x@N@OBJ", "OBJ"),
                                    *[(f"v{i}@V@ROOT", "OBJ") for i in range(0, 120, 7)], ("unseen@V@ROOT", "OBJ")], "w string, t_role string")
    index, dropped = fillers.candidate_index(inp.bigrams, inp.lemma_pos_freqs, tf.vector_words(inp.vectors), lambda c: tf.filler_vkey(c, False))
    index = fillers._written(index, "index")
    assert {r.filler for r in dropped.collect()} == {"w7@N"}
    best, blocks = fillers.best_fillers(index, fillers.block_headers(index), probes, inp.lemma_pos_freqs, weight, 20, 5)
    lists = tf.filler_lists(probes, inp, tf.TFParams(weight=weight)).cache()
    cols = ["w", "t_role", "rk", "filler", "role", "weight"]
    assert rows(best.where("family = 'all'"), *cols) == rows(tf.ranked_top(lists, 20), *cols)
    space = tf.first_m_in_space(lists, inp.vectors, 5, False)
    assert rows(best.where("family = 'space'"), "w", "t_role", "rk", "filler", "weight") == rows(space, "w", "t_role", "r", "filler", "weight")
    hot = {r.read: r.n for r in blocks.where("w = 'give@V@ROOT' and t_role = 'OBJ' and family = 'all'").groupBy("read").agg(F.sum("n").alias("n")).collect()}
    whole = lists.where("w = 'give@V@ROOT' and t_role = 'OBJ'").count()
    # rare fillers of one context tie for the highest positive association, and all ties are read
    assert sum(hot.values()) == whole and hot[True] < whole / (8 if weight == "lmi" else 1.5)


def test_headers_are_few(spark):
    inp = invented(spark)
    index, _ = fillers.candidate_index(inp.bigrams, inp.lemma_pos_freqs, tf.vector_words(inp.vectors), lambda c: tf.filler_vkey(c, False))
    heads = fillers.block_headers(index)
    assert heads.where("w = 'give@V@ROOT'").count() < 300
    assert heads.agg(F.sum("n")).first()[0] == index.count()


SETTINGS = [tf.TFParams(list_length=n, n_centroid=m, update=u, exact_mean=e)
            for n, m, u, e in ((3, 2, "prod", False), (8, 5, "add", True), (200, 20, "prod", False), (200, 1, "add", False), (1, 20, "prod", True))]


def test_sweep_equals_each_setting_alone(spark):
    inp = cat.tf_inputs(spark, SF)
    model = fillers._written(cat.tf_models(spark, SF, SETTINGS), "model")
    scored = fillers._written(sweep.scores(tf.item_keys(inp.items_wide), model, inp.vectors), "scored")
    lists = cat.tf_lists(spark, SF)
    for i, p in enumerate(SETTINGS):
        pr = tf.prototypes(inp, p, lists)
        mine = model.where(F.col("setting") == i)
        assert rows(mine.select("ctx_key", "operation", "nl")) == rows(pr.ops.select("ctx_key", "operation", "nl"))
        assert rows(mine.select("ctx_key", F.inline("chosen"))) == rows(pr.chosen)
        assert rows(scored.where(F.col("setting") == i).select("item_id", F.col("score").cast("string"))) == rows(
            tf.tf_scores(inp, p, pr).select("item_id", F.col("score").cast("string")))


def test_sweep_shuffles(spark):
    from eventfit.registry import QUERIES
    df = QUERIES["tf_param_sweep"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan"):plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert len(re.findall(r"^[ :+*()0-9-]*Exchange (?:hash|range|Round|Single)", plan, re.M)) <= 15
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_other_fallback_is_refused(spark):
    with pytest.raises(ValueError):
        cat.tf_models(spark, SF, [replace(SETTINGS[0], fallback="nonempty")])
