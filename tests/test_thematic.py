"""Thematic fit (P3-P10) on an invented world, against a direct Python
evaluation of the same rules (brute force: every item scans every bigram)."""

import math

import pytest
from pyspark.sql import functions as F

from eventfit.plans import thematic as tf

BIGRAMS = {
    ("cop@N@NSUBJ", "arrest@V@ROOT"): 10.0, ("arrest@V@ROOT", "thief@N@OBJ"): 8.0,
    ("arrest@V@ROOT", "robber@N@OBJ"): 5.0, ("arrest@V@ROOT", "suspect@N@OBJ"): 3.0,
    ("cop@N@NSUBJ", "thief@N@OBJ"): 4.0, ("cop@N@NSUBJ", "robber@N@OBJ"): 1.0,
    ("cop@N@NSUBJ", "car@N@OBL:in"): 2.0, ("arrest@V@ROOT", "station@N@OBL:at"): 2.0,
    ("arrest@V@ROOT", "station@N@OBL:in"): 1.0, ("dog@N@NSUBJ", "bark@V@ROOT"): 5.0,
    ("bark@V@ROOT", "bark@V@ROOT"): 1.0, ("cop@N@NSUBJ", "suspect@N@OBJ"): 6.0,
}
VECTORS = {"thief": [1.0, 0.0, 1.0], "robber": [0.9, 0.1, 1.0], "car": [0.0, 1.0, 0.0],
           "station": [0.2, 1.0, 0.1], "cop": [1.0, 1.0, 0.0], "arrest": [0.5, 0.5, 0.5]}
ITEMS = {
    1: ["cop@N@NSUBJ", "arrest@V@ROOT", "thief@N@OBJ"],        # update
    2: ["ghost@N@NSUBJ", "arrest@V@ROOT", "robber@N@OBJ"],     # one list
    3: ["ghost@N@NSUBJ", "ghost@V@ROOT", "thief@N@OBJ"],       # no fillers
    4: ["cop@N@NSUBJ", "arrest@V@ROOT", "station@N@OBL:in"],   # empty intersection, repeated filler
    5: ["cop@N@NSUBJ", "arrest@V@ROOT", "unknown@N@OBJ"],      # target without vector
    6: ["dog@N@NSUBJ", "bark@V@ROOT", "thief@N@OBJ"],          # attested but empty lists
    7: ["cop@N@NSUBJ", "arrest@V@ROOT", "car@N@OBJ", "station@N@OBL:in"],  # three contexts
    8: ["cop@N@NSUBJ", "arrest@V@ROOT", "suspect@N@OBJ"],      # intersection mostly out of space
}


def strip(a):
    return a.rsplit("@", 1)[0]


def lemma_freqs():
    f = {}
    for (a1, a2), c in BIGRAMS.items():
        for a in (a1, a2):
            f[strip(a)] = f.get(strip(a), 0.0) + c
    return f


def brute(n, m, update):
    lf = lemma_freqs()
    n_all = sum(v for k, v in lf.items() if k.endswith("@V"))
    seen = {a for pair in BIGRAMS for a in pair}
    out, ops = {}, {}
    for item, slots in ITEMS.items():
        ctx, tgt = slots[:-1], slots[-1]
        t_lemma, _, t_role = tgt.split("@")
        t_role = t_role.split(":")[0]
        lists = []
        for w in ctx:
            if w not in seen:
                continue
            lst = []
            for (a1, a2), c in BIGRAMS.items():
                other = a2 if a1 == w else (a1 if a2 == w else None)
                if other is None or not other.split("@")[2].startswith(t_role):
                    continue
                weight = round(math.log2(c * n_all / (lf[strip(a1)] * lf[strip(a2)])) * c, 9)
                lst.append((strip(other), other.split("@")[2], weight))
            lst.sort(key=lambda x: (-x[2], x[0], x[1]))
            lists.append(lst)

        def first_m(lst):
            return [fl for fl in lst if fl[0].split("@")[0] in VECTORS][:m]

        if not lists:
            op, chosen = "no_fillers", []
        elif len(lists) == 1:
            op, chosen = "one_filler_list", first_m(lists[0])
        else:
            dicts = []
            for lst in lists:
                d = {}
                for fl in lst[:n]:
                    d[fl[0]] = fl[2]
                dicts.append(d)
            common = set(dicts[0]).intersection(*dicts[1:])
            upd = []
            for w in common:
                ws = [d[w] for d in dicts]
                upd.append((w, "", round(math.prod(ws) if update == "prod" else sum(ws), 9)))
            upd.sort(key=lambda x: (-x[2], x[0]))
            chosen = first_m(upd)
            op = "update" if chosen else "intersection_empty_get_verbfillers"
            if not chosen:
                chosen = first_m(lists[1])
        vecs = [VECTORS[fl[0].split("@")[0]] for fl in chosen]
        if not vecs:
            score = 0.0
        else:
            cent = vecs[0] if len(vecs) == 1 else [sum(x) / m for x in zip(*vecs)]
            tv = VECTORS.get(t_lemma)
            if tv is None:
                score = None
            else:
                dot = sum(a * b for a, b in zip(tv, cent))
                score = dot / (math.sqrt(sum(a * a for a in tv)) * math.sqrt(sum(b * b for b in cent)))
        out[item], ops[item] = score, op
    return out, ops


@pytest.fixture(scope="module")
def inputs(spark):
    items = spark.createDataFrame(
        [(k, [(i, s.split("@")[0], s.split("@")[1], s.split("@")[2]) for i, s in enumerate(v)]) for k, v in ITEMS.items()],
        "item_id long, slots array<struct<slot:int, lemma:string, pos:string, role:string>>")
    bg = spark.createDataFrame([(a1, a2, c) for (a1, a2), c in BIGRAMS.items()], "a1 string, a2 string, freq double")
    lp = spark.createDataFrame(list(lemma_freqs().items()), "lemma_pos string, freq double")
    vec = spark.createDataFrame(list(VECTORS.items()), "word string, vec array<double>")
    return tf.TFInputs(items, bg, lp, vec)


@pytest.mark.parametrize("n,m,update", [(200, 20, "prod"), (2, 2, "prod"), (1, 1, "add"), (2, 1, "add")])
def test_tf_scores_match_brute_force(spark, inputs, n, m, update):
    p = tf.TFParams(list_length=n, n_centroid=m, update=update)
    pr = tf.prototypes(inputs, p)
    got = {r.item_id: r.score for r in tf.tf_scores(inputs, p, pr).collect()}
    ops = {r.item_id: r.operation for r in pr.item_keys.join(pr.ops, "ctx_key").collect()}
    exp, exp_ops = brute(n, m, update)
    assert ops == exp_ops
    for k, v in exp.items():
        if v is None:
            assert got[k] is None, k
        else:
            assert got[k] == pytest.approx(v, abs=1e-6), k


def test_all_operations_reached(spark, inputs):
    _, ops = brute(200, 20, "prod")
    assert set(ops.values()) == {"update", "one_filler_list", "no_fillers", "intersection_empty_get_verbfillers"}


def test_repeated_filler_kept_in_fallback(spark, inputs):
    pr = tf.prototypes(inputs, tf.TFParams(list_length=200, n_centroid=20))
    ex = {r.item_id: r for r in tf.explain_prototype(pr).collect()}
    assert ex[4].operation == "intersection_empty_get_verbfillers"
    assert ex[4].fillers.count("station@N") == 2


def test_both_directions_counts_self_pair_once(spark, inputs):
    adj = tf.both_directions(inputs.bigrams)
    assert adj.where((F.col("w") == "bark@V@ROOT") & (F.col("o") == "bark@V@ROOT")).count() == 1


def test_sdm_null_rules(spark, inputs):
    out = {r.item_id: r for r in tf.sdm_scores(inputs, tf.TFParams(list_length=200, n_centroid=20)).collect()}
    assert out[3].cos_lc is None and out[3].cos_ac is None and out[3].score is None   # both parts missing
    r = out[2]                                                                           # both parts present
    assert r.score == pytest.approx(r.cos_lc + r.cos_ac, abs=2e-6)
    assert out[5].score is None                                                          # target out of space


def test_partition_count_does_not_change_results(spark, inputs):
    p = tf.TFParams(list_length=2, n_centroid=2)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(tf.tf_scores(inputs, p).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = sorted(tf.tf_scores(inputs, p).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_nonempty_fallback_option(spark, inputs):
    # item 6: both contexts attested, no OBJ fillers at all -> still 0.0;
    # item 4: the second list has fillers -> same as the reference rule
    ref = {r.item_id: r.score for r in tf.tf_scores(inputs, tf.TFParams()).collect()}
    alt = {r.item_id: r.score for r in tf.tf_scores(inputs, tf.TFParams(fallback="nonempty")).collect()}
    assert alt[6] == 0.0 and alt[4] == pytest.approx(ref[4])
