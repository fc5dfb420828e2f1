"""Text functions (F1-F12) and text-format readers (S1-S14) on invented rows."""

from pyspark.sql import functions as F

from eventfit.functions import text as tx
from eventfit.plans import reports as rp
from eventfit.session import scratch_path
from eventfit.sources import readers as rd

from conftest import rows


def test_normalise_sentence_edge_cases(spark):
    data = [("The cop arrests the thief .",), ("No final period",), ("Two periods..",),
            ("Trailing blank ",), ("One.",), ("word",)]
    df = spark.createDataFrame(data, "text string").select(
        "text", tx.normalise_sentence(F.col("text")).alias("p"))
    out = dict(rows(df.select("text", "p", tx.sentence_valid(F.col("p")).alias("ok")).select("text", F.struct("p", "ok").alias("s")), "text", "s"))
    assert tuple(out["The cop arrests the thief ."]) == ("The cop arrests the thief.", True)
    assert tuple(out["No final period"]) == ("No final period.", True)
    assert tuple(out["Two periods.."]) == ("Two periods..", True)
    assert tuple(out["Trailing blank "]) == ("Trailing blank .", False)
    assert tuple(out["word"]) == ("word.", True)


def test_word_functions(spark):
    df = spark.createDataFrame([("a  b c.", 1), ("solo.", -1), ("x y", 5)], "t string, p int")
    out = rows(df.select("t", tx.word_count(F.col("t")).alias("n"), tx.target_word(F.col("t"), F.col("p")).alias("w"),
                         tx.strip_final_periods(F.lit("end...")).alias("s")))
    assert out == [("a  b c.", 3, "b", "end"), ("solo.", 1, "solo", "end"), ("x y", 2, None, "end")]


def test_parse_item_and_roles(spark):
    df = spark.createDataFrame([("cop@N@NSUBJ",), ("patient@N@OBL:on",)], "s string")
    out = rows(df.select(tx.parse_item(F.col("s")).alias("p"), tx.item_lemma(F.col("s")).alias("l"),
                         tx.role_of(F.col("s")).alias("r"), tx.strip_role(F.col("s")).alias("k")).select(
        "p.base_role", "p.key", "l", "r", "k"))
    assert out == [("NSUBJ", "cop@N", "cop", "NSUBJ", "cop@N"), ("OBL", "patient@N", "patient", "OBL:on", "patient@N")]


def _write(spark, name, lines):
    path = scratch_path(spark, name)
    # one file, like the hand-written reference files
    rp.write_lines(spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1), F.col("v"), path)
    return path


def test_role_map_last_line_wins(spark):
    # 'nsubj' is listed twice: the later line decides; 'dobj' once
    path = _write(spark, "rm", ["NSUBJ nsubj,nsubj:xsubj", "OBJ dobj", "AGENT nsubj"])
    spark.read.text(path)  # exists
    out = dict(rows(rd.read_role_map(spark, path)))
    # within one written file the line order is kept
    assert out["dobj"] == "OBJ" and out["nsubj:xsubj"] == "NSUBJ"
    assert out["nsubj"] == "AGENT"


def test_triples_reader_mapping_min_freq_and_collision(spark):
    rm = spark.createDataFrame([("nsubj", "NSUBJ"), ("nsubj:xsubj", "NSUBJ"), ("dobj", "OBJ")], "raw_rel string, role string")
    lines_ = ["arrest@V cop@N nsubj\t24", "arrest@V cop@N nsubj:xsubj\t6",   # collision: later wins
              "arrest@V thief@N dobj\t1",                                        # below min frequency
              "arrest@V thief@N iobj\t9",                                        # unmapped label
              "arrest@V arrest@V dobj\t3"]                                       # head = dep
    path = scratch_path(spark, "tri")
    df = spark.createDataFrame([(x,) for x in lines_], "v string").coalesce(1)
    rp.write_lines(df, F.col("v"), path, compression="gzip")
    out = rows(rd.read_triples(spark, path, rm, min_freq=2))
    assert out == [("arrest@V", "arrest@V", "OBJ", 3.0), ("arrest@V", "cop@N", "NSUBJ", 6.0)]


def test_lemma_sum_and_bigrams(spark):
    p1 = _write(spark, "lem", ["cop\t2", "cop\t3", "cop thief\t1"])
    out = rows(rd.read_lemma_sum(spark, p1).select(F.array_join("words", "+").alias("w"), "freq", "n_total"))
    assert out == [("cop", 5.0, 6.0), ("cop+thief", 1.0, 6.0)]
    rm = spark.createDataFrame([("nsubj", "NSUBJ"), ("HEAD", "ROOT")], "raw_rel string, role string")
    p2 = _write(spark, "bg", ["cop@N@nsubj arrest@V@HEAD\t4", "cop@N@obl arrest@V@HEAD\t9"])
    assert rows(rd.read_bigrams(spark, p2, rm)) == [("cop@N@NSUBJ", "arrest@V@ROOT", 4.0)]


def test_vectors_reader(spark):
    p = _write(spark, "vec", ["3 4", "cop 1 2 3 4", "new york 5 6 7 8", "bad 1 x 3 4"])
    full = {r.word: r.vec for r in rd.read_vectors(spark, p).collect()}
    assert full == {"cop": [1.0, 2.0, 3.0, 4.0], "new york": [5.0, 6.0, 7.0, 8.0]}
    vocab = spark.createDataFrame([("cop",)], "word string")
    last2 = {r.word: r.vec for r in rd.read_vectors(spark, p, vocab=vocab, k=2, from_end=True).collect()}
    first2 = {r.word: r.vec for r in rd.read_vectors(spark, p, k=2).collect()}
    assert last2 == {"cop": [3.0, 4.0]} and first2["new york"] == [5.0, 6.0]


def test_surprisal_reader_drops_junk(spark):
    p = _write(spark, "surp", ["sentence_id\ttoken_id\ttoken\tsurprisal", "1\t1\tThe\t0.0", "1\t2\tcop\t16.5",
                               "\u001b[0m"])
    assert rows(rd.read_surprisal(spark, p)) == [(1, 1, "The", 0.0), (1, 2, "cop", 16.5)]


def test_score_matrix_file_names(spark):
    base = scratch_path(spark, "matrix")
    for name, lines_ in (("ev1.gpt2.sentence-LL.txt", ["0\tA cop.\t-5.0\t4\t2"]),
                         ("ev1.gpt2.sentence-LL.average_byNrWords.txt", ["0\tA cop.\t-2.5\t4\t2"]),
                         ("ev1.bert.verb-PLL.txt", ["0\tA cop.\tNone"])):
        d = spark.createDataFrame([(x,) for x in lines_], "v string").coalesce(1)
        tmp = scratch_path(spark, "one")
        rp.write_lines(d, F.col("v"), tmp)
        import glob
        import shutil
        import os
        os.makedirs(base, exist_ok=True)
        src = [f for f in glob.glob(tmp + "/part-*") if not f.endswith(".crc")][0]
        shutil.copy(src, os.path.join(base, name))
    out = rows(rd.read_score_matrix(spark, base).select("model", "metric", "norm", "score", "n_tokens"))
    assert out == [("bert", "verb-PLL", "none", None, None), ("gpt2", "sentence-LL", "average_byNrWords", -2.5, 4),
                   ("gpt2", "sentence-LL", "none", -5.0, 4)]


def _files(spark, folder, files):
    import os
    os.makedirs(folder, exist_ok=True)
    for name, lines_ in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write("".join(x + "\n" for x in lines_))
    return folder


def test_last_line_wins_over_many_split_files(spark):
    """Part 100000 follows part 99999, whatever the order of paths, and blocks of a file follow their offset."""
    keys = [f"key{i:03d}" for i in range(60)]
    parts = {f"part-{n}-x.txt": [f"{k} N\t{n}.{j:03d}" for j in range(40) for k in keys] for n in (99999, 100000, 9, 10)}
    folder = _files(spark, scratch_path(spark, "parts"), parts)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = rd.lines(spark, folder)
        assert raw.rdd.getNumPartitions() > 20
        assert {r.freq for r in rd.read_lemma_pos(spark, folder).collect()} == {100000.039}
        back = rd.read_numbered_lines(spark, folder)
        got = [r.line for r in back.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [x for n in (9, 10, 99999, 100000) for x in parts[f"part-{n}-x.txt"]]
    assert sorted(r.line_no for r in back.select("line_no").collect()) == list(range(len(got)))


def test_vector_header_is_the_first_line(spark):
    one = {r.word: r.vec for r in rd.read_vectors(spark, _write(spark, "vec1", ["3 1", "3 1", "7 2", "cop 4"])).collect()}
    assert one == {"3": [1.0], "7": [2.0], "cop": [4.0]}  # only the first of two equal lines is the header
    many = _files(spark, scratch_path(spark, "vecs"), {"part-10.txt": ["c 5 6"], "part-9.txt": ["a 3 4"], "part-2.txt": ["2 2", "2 2 1"]})
    assert {r.word: r.vec for r in rd.read_vectors(spark, many).collect()} == {"c": [5.0, 6.0], "a": [3.0, 4.0], "2": [2.0, 1.0]}
    import pytest
    with pytest.raises(ValueError):
        rd.read_vectors(spark, _write(spark, "vec2", ["cop 1 2"]))
    assert rd.read_vectors(spark, _write(spark, "vec3", [])).collect() == []


def test_score_matrix_reads_only_the_folders_asked_for(spark):
    base = scratch_path(spark, "tree")
    rows_ = [("007", "m", f"metric{i}", n, i, f"text {i}", i / 2, 4, 2) for i in range(3) for n in ("none", "byNrWords")]
    df = spark.createDataFrame(rows_, "dataset string, model string, metric string, norm string, id long, text string, score double, n_tokens int, n_words int")
    rp.write_sentence_scores(df, base)
    rp.write_word_scores(df.where("id = 1").withColumn("metric", F.lit("word")), base, mode="append")
    every = rd.read_score_matrix(spark, base)
    assert {r.dataset for r in every.collect()} == {"007"}
    assert rows(every.where("metric = 'word'").select("id", "score", "n_tokens")) == [(1, 0.5, None)] * 2
    one = every.where("metric = 'metric2' and norm = 'none'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "metric2" in plan[plan.index("PartitionFilters"):].split("\n")[0]
    assert rows(one.select("id", "score", "n_words")) == [(2, 1.0, 2)]
    assert len(one.inputFiles()) == len(every.inputFiles()) or one.count() == 1


def test_ordered_reports_keep_their_order_over_files(spark):
    df = spark.range(500).selectExpr("(id * 7919) % 500 as k", "concat('line ', (id * 7919) % 500) as t").repartition(5)
    path = rp.write_ordered(df, F.col("t"), ["k"], scratch_path(spark, "ordered"))
    back = rd.read_numbered_lines(spark, path)
    assert rows(back) == [(i, f"line {i}") for i in range(500)]


def test_dropped_candidates_are_observed(spark):
    from pyspark.sql import Observation

    from eventfit.plans import thematic as tf
    bigrams = spark.createDataFrame([("a@N@OBJ", "v@V@ROOT", 2.0), ("b@N@OBJ", "v@V@ROOT", 1.0), ("c@N@OBJ", "u@V@ROOT", 1.0)],
                                    "a1 string, a2 string, freq double")
    freqs = spark.createDataFrame([("a@N", 2.0), ("v@V", 3.0)], "lemma_pos string, freq double")
    probes = spark.createDataFrame([("v@V@ROOT", "OBJ"), ("u@V@ROOT", "OBJ")], "w string, t_role string")
    seen = (Observation("p"), Observation("c"))
    lists = tf.filler_lists(probes, tf.TFInputs(None, bigrams, freqs, None), tf.TFParams(), seen)
    assert [r.filler for r in lists.collect()] == ["a@N"]
    assert seen[0].get == {"seen": 2, "dropped": 1} and seen[1].get == {"seen": 2, "dropped": 1}
