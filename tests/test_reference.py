"""Sequence, metric, resampling, similarity, grouping and model operators on small tables."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import sequence as X
from strandlake.operators import audit, grouping, metrics, models, resample, similarity, substring
from strandlake.sources import fasta

WORDS = ["ACDE", "ACDF", "ACDEF", "WYV", "WYVA", "KLMN", "KLMNP", "A", "GGGG", "GGGA", "AAAA", "WWYV"]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(list(enumerate(WORDS)), "row_idx long, sequence string").withColumn("length", F.length("sequence"))


def test_parse_edges(spark):
    text = "noise\n\n>a one\r\nac de\n\nfg\n>b\n>c\nKK"
    got = {r["record"]: (r["header"], r["sequence"]) for r in fasta.parse(spark.createDataFrame([(1, text), (2, None), (3, "")], "file long, content string")).collect()}
    assert got == {1: ("a one", "ACDEFG"), 2: ("b", ""), 3: ("c", "KK")}


def test_strict_parse_raises(spark):
    with pytest.raises(Exception, match="before the first header"):
        fasta.parse(spark.createDataFrame([(1, "noise\n>a\nAC")], "file long, content string"), strict=True).collect()


@pytest.mark.parametrize(("header", "last", "first"), [("1neg|Set|0", 0, 1), ("0_neg_5", 0, 0), ("x|1", 1, 1), ("pos_1", 0, None)])
def test_label_rules(spark, header, last, first):
    d = spark.createDataFrame([(header,)], "h string")
    r = d.select(fasta.label_last_field(F.col("h")).alias("a"), fasta.label_first_char(F.col("h")).alias("b")).first()
    assert (r["a"], r["b"]) == (last, first)


def test_features(spark):
    d = spark.createDataFrame([("ACDK",), ("",), ("A",)], "s string").select("s", X.composition(F.col("s")).alias("c"), X.pair_composition(F.col("s")).alias("p"), X.gravy(F.col("s")).alias("g"), X.molecular_weight(F.col("s")).alias("w"), X.permutations(F.col("s")).alias("n")).collect()
    assert d[0]["c"][0] == 0.25 and sum(d[0]["c"]) == 1 and math.isclose(sum(d[0]["p"]), 1)
    assert sum(d[1]["c"]) == 0 and d[1]["g"] is None and sum(d[2]["p"]) == 0
    assert d[0]["n"] == 23 and math.isclose(d[2]["w"], 89.0932)


def brute_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 200).tolist(), np.round(rng.random(200), 1).tolist()
    d = spark.createDataFrame([(0, a, b, 2.0) for a, b in zip(y, p)] + [(1, 1, 0.5, 1.0), (0, None, 0.5, 1.0), (0, 1, None, 1.0), (0, 1, float("nan"), 1.0)], "k int, label int, score double, w double")
    got = {r["k"]: r for r in metrics.metrics(d, ["k"]).collect()}
    assert math.isclose(got[0]["auc"], brute_auc(y, p)) and got[1]["auc"] is None and got[1]["specificity"] is None
    assert math.isclose(metrics.auc_by_rank(d.where("k = 0"), ["k"]).first()["auc"], got[0]["auc"])
    weighted = metrics.metrics(d.where("k = 0"), ["k"], weight="w").first()
    for name in ("auc", "average_precision", "brier", "mcc"):
        assert math.isclose(weighted[name], got[0][name], abs_tol=1e-12)
    tp = sum(a and b >= 0.5 for a, b in zip(y, p))
    assert got[0]["tp"] == tp


def test_width_bins_use_edge_doubles(spark):
    d = spark.createDataFrame([(0.3,), (0.6,), (0.7,), (1.0,), (0.0,)], "p double")
    assert [r[0] for r in d.select(metrics.width_bin(F.col("p"), 10)).collect()] == [2, 5, 6, 9, 0]


def test_bootstrap_keeps_classes_and_pairs(spark):
    d = spark.createDataFrame([(k, k % 3 == 0, k / 30) for k in range(30)], "row_idx long, b boolean, score double").selectExpr("row_idx", "cast(b as int) label", "score", "score rival")
    b = resample.bootstrap(d, 4, 1)
    assert {(r["replicate"], r["label"]): r["count"] for r in b.groupBy("replicate", "label").count().collect()} == {(k, c): 10 if c else 20 for k in range(4) for c in (0, 1)}
    assert all(r["low"] == r["high"] == 0 for r in resample.paired_deltas(d, "score", "rival", 4, 1).collect())


def test_matching_and_split(spark):
    d = spark.createDataFrame([(k, k % 2, k % 5 if k < 20 else 9) for k in range(23)], "row_idx long, label int, length int")
    m = resample.matched(d, "length", 3, 5)
    for r in m.groupBy("replicate", "length").agg(F.sum("label").alias("p"), F.count("*").alias("n"), F.countDistinct("row_idx").alias("u")).collect():
        assert r["n"] == 2 * r["p"] == r["u"]
    assert resample.split(d, 0.9, 1).where("part = 'test'").count() >= 2


def test_shuffles_keep_composition(spark, nodes):
    for r in resample.shuffles(nodes, 3, 2).collect():
        assert sorted(r["sequence"]) == sorted(r["shuffled"]) and 0 <= r["distance"] <= len(r["sequence"])
    for key, group in itertools.groupby(sorted(map(tuple, resample.unique_shuffles(nodes, 5, 1).collect())), lambda r: r[0]):
        group = [g[2] for g in group]
        assert len(set(group)) == len(group) and WORDS[key] not in group
        assert len(group) == min(5, math.factorial(len(WORDS[key])) // math.prod(math.factorial(WORDS[key].count(c)) for c in set(WORDS[key])) - 1)


def test_generator_draws_repeat():
    a = resample.generator_bootstrap([0, 1, 1, 0], 3, 7)
    assert (a == resample.generator_bootstrap([0, 1, 1, 0], 3, 7)).all() and set(a[0][:2]) <= {1, 2}


@settings(max_examples=60, deadline=None)
@given(st.text("ACDK", max_size=8), st.text("ACDK", max_size=8))
def test_common_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert similarity.common_length(a, b) == t[-1][-1]


def test_similarity_joins_lose_no_pair(spark, nodes):
    want = {(i, j) for i, j in itertools.combinations(range(len(WORDS)), 2) if similarity.indel_ratio(WORDS[i], WORDS[j]) >= 60}
    assert {(r[0], r[1]) for r in similarity.ratio_join(nodes).collect()} == want
    ok = lambda x: x[3] >= 0.6 - 1e-12 and x[4] >= 0.8 - 1e-12
    want = {(i, j) for i, j in itertools.combinations(range(len(WORDS)), 2) if ok(similarity.align(WORDS[i], WORDS[j]))}
    assert {(r[0], r[1]) for r in similarity.alignment_join(nodes).collect()} == want
    assert similarity.ratio_join(nodes.limit(0)).count() == 0


def test_nearest(spark, nodes):
    got = {r["l_idx"]: r for r in similarity.nearest(nodes.where("row_idx < 3"), nodes.where("row_idx >= 3")).collect()}
    for i in range(3):
        own = [(*similarity.align(WORDS[i], WORDS[j])[3:], similarity.align(WORDS[i], WORDS[j])[0], -j) for j in range(3, len(WORDS)) if similarity.align(WORDS[i], WORDS[j])[0] > 0]
        assert (got[i]["identity"], got[i]["coverage"], got[i]["score"], -got[i]["r_idx"]) == max(own)


def test_contains_any(spark):
    d = spark.createDataFrame([("abc",), (None,), ("",), ("xyz",)], "text string")
    n = spark.createDataFrame([("bc",), ("q",)], "text string")
    assert [r["contained"] for r in substring.contains_any(d, n).collect()] == [True, False, False, False]
    assert not any(r["contained"] for r in substring.contains_any(d, n.limit(0)).collect())


def test_groups_follow_the_sequential_rules(spark, nodes):
    e = similarity.ratio_join(nodes)
    pairs = {(r[0], r[1]) for r in e.collect()}
    near = lambda a, b: (min(a, b), max(a, b)) in pairs
    leader = {}
    for i in sorted(range(len(WORDS)), key=lambda k: (-len(WORDS[k]), WORDS[k], k)):
        if i not in leader:
            for j in range(len(WORDS)):
                if j not in leader and (j == i or near(i, j)):
                    leader[j] = i
    assert {r["row_idx"]: r["leader"] for r in grouping.leader_groups(nodes, e).collect()} == leader
    c = {r["row_idx"]: (r["first_index"], r["group_index"]) for r in grouping.components(nodes, e).collect()}
    for i, j in pairs:
        assert c[i] == c[j]
    firsts = sorted({f for f, _ in c.values()})
    assert all(firsts.index(f) == g for f, g in c.values())


def test_folds_never_split_groups(spark):
    d = spark.createDataFrame([(k, k % 7, k % 3 == 0) for k in range(70)], "row_idx long, group_index long, b boolean").selectExpr("row_idx", "group_index", "cast(b as int) label")
    a = grouping.fold_audit(grouping.group_folds(d, 3, 5)).collect()
    assert sum(r["valid_n"] for r in a) == 70 and all(r["shared_groups"] == 0 and r["train_n"] + r["valid_n"] == 70 for r in a)


def test_audit(spark, nodes):
    assert math.isclose(audit.fisher_exact(8, 2, 1, 5)[1], 0.034965, abs_tol=1e-5)
    with pytest.raises(ValueError, match="break the contract"):
        audit.require(nodes.withColumn("label", F.lit(3)))
    with pytest.raises(ValueError):
        audit.drift(nodes, nodes.withColumn("length", F.col("length") + 1), ["row_idx"], "length", 0.5)
    b = audit.balance(nodes.withColumn("label", (F.col("row_idx") % 2).cast("int")), ["length"], {"plain": F.lit(1.0)}).first()
    odd, even = [len(w) for w in WORDS[1::2]], [len(w) for w in WORDS[::2]]
    assert math.isclose(b["smd"], (np.mean(odd) - np.mean(even)) / np.sqrt((np.var(odd) + np.var(even)) / 2), abs_tol=1e-9)


def test_models(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 2, float(k % 2 + rng.normal()), float(rng.normal()), k % 4) for k in range(200)]
    d = spark.createDataFrame(rows, "row_idx long, label int, a double, b double, fold int")
    p = models.probability(models.logistic(d, ["a", "b"]), d).collect()
    x = np.array([[r["a"], r["b"]] for r in p])
    x = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    y, w = np.array([r["label"] for r in p], float), np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T * (q * (1 - q)) @ x + np.eye(3), x.T @ (q - y) + w)
    assert np.abs(1 / (1 + np.exp(-x @ w)) - [r["probability"] for r in p]).max() < 1e-4
    intercept, slope = models.calibration_line(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, rng.random(200))], "label int, score double"))
    assert abs(intercept) < 1 and abs(slope) < 1


def test_kernels_of_many_pairs():
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ACDEKLWZé") for _ in range(rng.randint(0, 30)))
    a = [word() for _ in range(400)] + ["", "A" * 80, "A" * 64]
    b = [x[:5] + word()[:4] + x[5:] if rng.random() < 0.6 else word() for x in a[:400]] + ["", "A" * 70, "A" * 64]
    assert similarity.ratios(a, b).tolist() == [similarity.indel_ratio(x, y) for x, y in zip(a, b, strict=True)]
    got = similarity.align_many(a, b)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        assert tuple(got.iloc[k]) == pytest.approx(similarity.align(x, y))


def test_nearest_and_removal_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    monkeypatch.setattr(similarity, "POOL_BLOCK", 4)
    rows = spark.createDataFrame(list(enumerate(WORDS)), "row_idx long, sequence string")
    train, test = rows.where("row_idx >= 4"), rows.where("row_idx < 4")
    got = {r["row_idx"]: r for r in similarity.similarity_removal(train, test).collect()}
    for k, s in enumerate(WORDS[4:], 4):
        all_ = [(j, *similarity.align(s, t)) for j, t in enumerate(WORDS[:4])]
        all_ = [x for x in all_ if x[1] > 0]
        hits = [x for x in all_ if x[4] >= 0.6 and x[5] >= 0.8]
        r = got[k]
        assert r["removed"] == bool(hits)
        if hits:
            want = min(hits, key=lambda x: (-x[4], -x[5], -x[1], x[0]))
        elif all_:
            want = min(all_, key=lambda x: (-x[4] * x[5], -x[4], -x[5], -x[1], x[0]))
        else:
            assert (r["nearest_idx"], r["identity"], r["score"]) == (None, 0, 0)
            continue
        assert (r["nearest_idx"], r["score"]) == (want[0], want[1]) and r["identity"] == pytest.approx(want[4])


def test_calibration_line_of_each_key(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(p), int(rng.random() < p ** (1 + k))) for k in (0, 1) for p in rng.random(400)] + [(2, 0.3, 1), (3, 0.2, 0), (3, 0.2, 1)]
    d = spark.createDataFrame(rows, "k int, score double, label int")
    got = {r["k"]: r for r in models.calibration_lines(d, ["k"]).collect()}
    for k in (0, 1):
        a, b = models.calibration_line(d.where(F.col("k") == k))
        assert got[k]["intercept"] == pytest.approx(a, abs=1e-6) and got[k]["slope"] == pytest.approx(b, abs=1e-6)
    assert got[2]["slope"] is None and got[3]["slope"] is None


def test_header_tokens(spark):
    d = spark.createDataFrame([("positive_set|0", 0, 1), ("x_pos|3", 1, 1), ("Non-Antioxidant 3", None, 0), ("a|0|pos", 1, 1), ("non-x", None, None), (" 1neg ", None, 0), ("neg", 0, 0)], "h string, d int, t int")
    for r in d.select("*", fasta.label_delimited(F.col("h")).alias("gd"), fasta.label_tokens(F.col("h")).alias("gt")).collect():
        assert (r["gd"], r["gt"]) == (r["d"], r["t"])
    with pytest.raises(Exception, match="no label"):
        d.select(fasta.label_tokens(F.col("h"), strict=True)).collect()


def test_tables_in_and_out(spark, tmp_path):
    import hashlib
    import json

    from strandlake.sources import tables

    d = spark.createDataFrame([(1, "a"), (2, None)], "n long, s string")
    tables.write_csv(d, f"{tmp_path}/c", single=True)
    assert tables.read_csv(spark, f"{tmp_path}/c", "n long, s string").orderBy("n").collect() == d.orderBy("n").collect()
    tables.write_json(d, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").columns == ["n", "s"]
    np.save(f"{tmp_path}/m.npy", np.arange(6.0).reshape(3, 2))
    assert [r["values"] for r in tables.import_matrix(spark, f"{tmp_path}/m.npy").orderBy("row_idx").collect()] == [[0, 1], [2, 3], [4, 5]]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.txt").write_text("abc")
    (tmp_path / "f" / "y.txt").write_text("abd")
    good = hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "m.json").write_text(json.dumps({"files": {"x.txt": {"bytes": 3, "sha256": good}, "y.txt": {"bytes": 3, "sha256": good}, "z.txt": {"bytes": 1, "sha256": good}, "w": {"bytes": 9, "sha256": ""}}}))
    (tmp_path / "f" / "w").write_text("1")
    assert {r["name"]: r["status"] for r in audit.file_integrity(spark, f"{tmp_path}/f", tables.read_manifest(spark, f"{tmp_path}/m.json")).collect()} == {"x.txt": "ok", "y.txt": "hash", "z.txt": "missing", "w": "size"}
    assert audit.same_rows(d, d, ["n", "s"]) and not audit.same_rows(d, d.limit(1), ["n"])


def test_trees_stacks_and_weights(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=240) * 0.5 > 0).astype(int)
    rows = spark.createDataFrame([(k, float(a), float(b), int(c), k % 3, k % 4 % 2) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "row_idx long, a double, b double, label int, fold int, inner int")
    for model in (models.forest(rows, ["a", "b"], trees=8), models.boosted(rows, ["a", "b"], trees=4)):
        assert metrics.metrics(models.probability(model, rows, "score"), []).first()["auc"] > 0.9
    fit = lambda f: lambda t: models.logistic(t, [f])
    out = models.nested_stack(rows, {"a": fit("a"), "b": fit("b")}, 3, 2)
    assert out.count() == 240 and metrics.metrics(out.withColumn("score", F.col("p_stack")), []).first()["auc"] > 0.88
    w = models.best_weight(out, "p_a", "p_b")
    assert 0.5 < w <= 1


def test_running_sums_and_tiles(spark):
    from strandlake.operators import ranked

    rows = [(k, None if k % 3 == 0 else k % 3, float(k * 7 % 101), k % 5) for k in range(101)]
    d = spark.createDataFrame(rows, "i int, g int, p double, v long")
    got = {r["i"]: r for r in ranked.running(d, ["g"], [F.desc("p")], ["v"]).collect()}
    for i, g, p, _ in rows:
        assert got[i]["run_v"] == sum(v for _, h, q, v in rows if h == g and q >= p)
    for r in ranked.numbered(d, ["g"], ["p"]).select("*", ranked.tile(F.col("k"), F.col("m"), 10).alias("b"), F.expr("ntile(10) OVER (PARTITION BY g ORDER BY p) - 1").alias("n"), F.expr("row_number() OVER (PARTITION BY g ORDER BY p) - 1").alias("w")).collect():
        assert r["k"] == r["w"] and r["b"] == r["n"] and r["m"] == (34 if r["g"] in (None, 1) else 33)
    few = ranked.numbered(d.where("i < 7"), [], ["p"]).select(ranked.tile(F.col("k"), F.col("m"), 10).alias("b")).collect()
    assert sorted(r["b"] for r in few) == list(range(7))


def test_refits_controls_and_saved_models(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=150) * 0.3 > 0).astype(int)
    rows = spark.createDataFrame([(k, float(a), float(b), int(c), k % 3, "AC" * (1 + c) + "D" * (k % 4)) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "row_idx long, a double, b double, label int, fold int, s string")
    fit = lambda *f: lambda t: models.logistic(t, list(f))
    out = models.refit_predict(rows.where("fold < 2"), rows.where("fold = 2"), {"a": fit("a"), "b": fit("b")}, 2).collect()
    assert len(out) == 50 and all(0 < r[c] < 1 for r in out for c in ("p_a", "p_b", "p_mean", "p_stack"))
    got = {(r["evaluation"], r["model"]): r["auc"] for r in models.control_suite(rows, {"a": fit("a"), "ab": fit("a", "b")}, 3, test=rows, linear={"both": ["a", "b"]}).collect()}
    assert got["out_of_fold", "ab"] > got["out_of_fold", "a"] > 0.7 and len(got) == 6
    assert abs(got["out_of_fold", "both"] - got["out_of_fold", "ab"]) < 1e-12 and abs(got["test", "both"] - got["test", "ab"]) < 1e-12
    runs = models.repeated_runs(rows, [42, 43], lambda t, seed: t.agg(F.sum("label").alias("v")))
    assert sorted(r["seed"] for r in runs.collect()) == [42, 43]
    grams = models.ngram_logistic(rows.where("row_idx % 2 = 0"), "s")
    found = models.probability(grams, rows.where("row_idx % 2 = 1"), "score")
    assert metrics.metrics(found, []).first()["auc"] > 0.99 and "CountVectorizer" in " ".join(models.parameters(grams))
    models.save(grams, f"{tmp_path}/g", spark)
    again = models.probability(models.load(f"{tmp_path}/g", spark), rows.where("row_idx % 2 = 1"), "score")
    assert audit.drift(found.select("row_idx", "score"), again.select("row_idx", "score"), ["row_idx"], "score", 1e-12) <= 1e-12
    one = models.logistic(rows, ["a", "b"])
    models.save(one, f"{tmp_path}/l", spark)
    assert np.allclose(models.load(f"{tmp_path}/l", spark, "logistic").weights, one.weights)
    pc = models.principal_components(rows, ["a", "b"], 2).select(F.variance("pc1").alias("u"), F.variance("pc2").alias("v"), F.corr("pc1", "pc2").alias("c")).first()
    assert pc["u"] >= pc["v"] and abs(pc["c"]) < 1e-9 and math.isclose(pc["u"] + pc["v"], 2, rel_tol=1e-6)


def test_load_sets(spark):
    files = lambda t: spark.createDataFrame([("f", t)], "file string, content string")
    got = fasta.load_sets({"dev": (files(">a x\nAC\n>b\nDE"), 1), "test": (files(">c|0\nKL"), None)}, {"dev": 2, "test": 1}).collect()
    assert {(r["split"], r["record_id"], r["sequence"], r["label"]) for r in got} == {("dev", "a", "AC", 1), ("dev", "b", "DE", 1), ("test", "c|0", "KL", 0)}
    for t, n in ((">a\nAZ", 1), (">a\nAC", 2), (">a\n", 1)):
        with pytest.raises(ValueError):
            fasta.load_sets({"dev": (files(t), 1)}, {"dev": n})


def test_audit_items_and_ids(spark):
    rows = [(0, 0, "x|1", "AC", 1, True), (1, 0, "x|0", "AC", 0, False), (2, 1, "x|0", "AC", 1, False), (3, 1, "none", "A?", 0, True), (4, 1, "x|1", "DE", 1, True)]
    m = audit.label_manifest(spark.createDataFrame(rows, "row_idx long, split int, header string, sequence string, label int, found boolean"), fasta.label_delimited(F.col("header")))
    got = {r["item"]: r["value"] for r in audit.label_audit_items(m, {"first": 0, "second": 1}, "second", (2, 3)).collect()}
    assert len(got) == 21
    assert (got["header_label_mismatches"], got["nonstandard_rows"], got["within_split_duplicate_rows"], got["overlap_sequences"], got["conflicting_label_rows"], got["counts_are_transposed"]) == ("1", "1", "2", "1", "3", "true")
    assert (float(got["odds_ratio"]), float(got["fisher_p"])) == (2.0, 1.0)
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, record_id string")
    assert [r["record_id"] for r in fasta.unique_record_ids(ids).orderBy("row_idx").collect()] == ["a", "b"]
    assert [r["record_id"] for r in fasta.unique_record_ids(ids.withColumn("record_id", F.lit("a"))).orderBy("row_idx").collect()] == ["record_00000", "record_00001"]
