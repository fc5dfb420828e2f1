"""Reports and scores of the items: their files are small, as ids and repeated words pack well, and their rows are many.
The planner goes by the size of files, so it would send all items through the driver."""

import re

import pytest
from conftest import SF_SMALL, rows
from pyspark.sql import functions as F
from test_skew import SKEW_CONF

import __spark_entry__ as entry
from eventfit import registry
from eventfit.plans import fillers as fl
from eventfit.plans import ppmi, sweep
from eventfit.plans import thematic as tf

SLOTS = "array<struct<slot:int, lemma:string, pos:string, role:string>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcast_scans(df) -> list[str]:
    """The scans below the broadcast exchanges of a plan."""
    lines, found = plan(df).split("\n== Initial Plan ==")[-1].split("\n"), []
    depth = lambda line: len(re.match(r"[\s:|+*-]*", line)[0])
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1:]:
                if depth(below) <= depth(line):
                    break
                if "FileScan" in below:
                    found.append(below.split("Batched")[0])
    return found


def stored(spark, data, schema, name):
    return fl._written(spark.createDataFrame(data, schema), f"test_{name}")


def slots(subj, verb, obj):
    return [(0, subj, "N", "NSUBJ"), (1, verb, "V", "ROOT"), (2, obj, "N", "OBJ")]


@pytest.fixture(scope="module")
def items(spark):
    made = [(i, slots(f"s{i % 3}", f"v{i % 2}", f"o{i % 5}")) for i in range(60)]
    made += [(7, slots("s1", "v1", "o2")), (7, slots("s0", "v0", "o3")), (None, slots("s0", "v0", "o1")), (100, slots("s0", "v0", None))]
    return stored(spark, made, f"item_id long, slots {SLOTS}", "items")


@pytest.fixture(scope="module")
def vectors(spark):
    return stored(spark, [(f"o{i}", [1.0 + i, 2.0, 0.5 * i]) for i in range(4)], "word string, vec array<double>", "vectors")


def model_of(spark, items, only=("s0", "s1")):
    """Keys of ``s2`` have no prototype; two settings."""
    keys = sorted({r.ctx_key for r in tf.item_keys(items).select("ctx_key").collect()})
    made = [(s, m, False, k, "update" if any(x in k for x in only) else "no_fillers", 2, 2,
             [(j + 1, f"o{(j + s) % 4}@N", 1.5 - j) for j in range(m)] if any(x in k for x in only) else []) for k in keys for s, m in ((0, 2), (1, 1))]
    return stored(spark, made, "setting int, n_centroid int, exact_mean boolean, ctx_key string, operation string, nl long, n_in_space long,"
                               "chosen array<struct<r:int, filler:string, weight:double>>", "model")


def prototypes(items, model):
    ik, one = tf.item_keys(items), model.where("setting = 0")
    return tf.Prototypes(tf.distinct_keys(ik), ik, None, None, one.select("ctx_key", "operation", "nl", "n_in_space"), one.select("ctx_key", F.inline("chosen")), None)


def test_explained_items_are_not_broadcast(spark, items):
    out = tf.explain_prototype(prototypes(items, model_of(spark, items)))
    assert not broadcast_scans(out) and "SortMergeJoin" in plan(out)
    got = out.collect()
    assert len(got) == items.count()
    fillers = {r.item_id: (r.fillers, r.operation) for r in got if r.item_id is not None}
    assert fillers[0] == ("o0@N (1.5),o1@N (0.5)", "update") and fillers[2] == ("", "no_fillers") and fillers[100] == fillers[0]


def test_items_of_a_frequent_key_are_split(spark):
    made = spark.range(6000).select(F.col("id").alias("item_id"), F.array(*[
        F.struct(F.lit(i).alias("slot"), F.when(F.col("id") % 3 == 0, f"hot{i}").otherwise(F.concat(F.lit(f"x{i}"), F.col("id") % 900)).alias("lemma"),
                 F.lit(p).alias("pos"), F.lit(r).alias("role")) for i, (p, r) in enumerate((("N", "NSUBJ"), ("V", "ROOT"), ("N", "OBJ")))]).alias("slots"))
    items = fl._written(made, "test_hot_items")
    pr = prototypes(items, model_of(spark, items, ("hot",)))
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        out = tf.explain_prototype(pr)
        got = rows(out)
        final = plan(out).split("\n+- == Initial Plan ==")[0]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    joins = [line for line in final.splitlines() if "SortMergeJoin" in line]
    assert joins and all("skew=true" in line for line in joins), final
    assert [r[0] for r in got] == list(range(6000))
    assert {r[1:] for r in got if r[0] % 3 == 0} == {("o0@N (1.5),o1@N (0.5)", "update")}


def test_reported_items_are_not_broadcast(spark, items):
    triples = stored(spark, [("v0@V", "s0@N", "NSUBJ", 3.0), ("v1@V", "o2@N", "OBJ", 2.0)], "head string, dep string, role string, freq double", "triples")
    rep = ppmi.report_ppmi(items, triples)
    assert not [x for x in broadcast_scans(rep) if "slots" in x]
    got = [tuple(r) for r in rep.collect()]
    # three lines share an id: each has the parts of all, as before
    assert sum(r[0] == 7 for r in got) == 3 and {len(r[2].split(",")) for r in got if r[0] == 7} == {6}
    assert len(got) == items.count() - 1 and {r[1] for r in got if r[0] == 0} == {"s0 v0 o0"}


@pytest.mark.parametrize("key", ["explain_tf_file", "report_ppmi_file", "explain_prototype", "report_ppmi", "tf_param_sweep"])
def test_queries_broadcast_no_items(spark, monkeypatch, key):
    monkeypatch.setattr(registry, "_ordered_report", lambda spark, name, df, line, keys: df)
    out = entry.queries()[key](spark, SF_SMALL)
    assert not [x for x in broadcast_scans(out) if "slots" in x or "item_id" in x]


def test_scored_items_are_not_broadcast_and_travel_once(spark, items, vectors):
    model = model_of(spark, items)
    out = sweep.scores(tf.item_keys(items), model, vectors)
    assert not [x for x in broadcast_scans(out) if "slots" in x]
    last = out._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    moved = re.search(r"Project \[(.*)\]", last)[1]
    assert moved.startswith("item_id") and "proto" not in moved and "setting" not in moved
    for setting in (0, 1):
        p = tf.TFParams(n_centroid=2 - setting)
        one = model.where(F.col("setting") == setting)
        pr = tf.Prototypes(None, tf.item_keys(items), None, None, None, one.select("ctx_key", F.inline("chosen")), None)
        text = lambda df: sorted(map(repr, df.select("item_id", "score").collect()))
        want = text(tf.tf_scores(tf.TFInputs(items, None, None, vectors), p, pr))
        assert text(out.where(F.col("setting") == setting)) == want and len(want) == items.count()
    assert [r.score for r in out.where("item_id = 100").collect()] == [None, None]


def test_parts_are_not_broadcast_and_base_is_counted_once(spark):
    from eventfit.sources import catalog as cat
    from eventfit.sources import fixtures as fx
    assert not [x for x in broadcast_scans(fx.base_counts(spark, SF_SMALL)) if "p_partkey" in x]
    kept = fx.bigrams_from(cat.base_counts(spark, SF_SMALL), cat.role_map(spark, SF_SMALL))
    assert "l_partkey" not in plan(kept)
    assert rows(cat.bigrams(spark, SF_SMALL)) == rows(fx.bigrams(spark, SF_SMALL))


def test_lines_are_numbered_without_a_shuffle_of_lines(spark, tmp_path):
    from eventfit.sources import readers as rd
    for name, n in (("part-99999.txt", 700), ("part-100000.txt", 3), ("part-00002.txt", 0), ("notes.txt", 2)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    (tmp_path / "part-00007.txt").write_text("\nx\nx\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # blocks inside a file
        out = rd.read_numbered_lines(spark, str(tmp_path))
        got = dict(out.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [f"notes.txt {i}" for i in range(2)] + ["", "x", "x"] + [f"part-99999.txt {i}" for i in range(700)] + [f"part-100000.txt {i}" for i in range(3)]
    assert got == dict(enumerate(want))
    assert dict(out.dtypes) == {"line_no": "bigint", "line": "string"}
    moved = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Repartition" in line or "Sort" in line]
    assert not moved and "LogicalRDD" not in plan(out) and "Scan ExistingRDD" not in plan(out)
