"""Queries of whole suites: calibration bundles, weighted and cutoff bootstraps, matching summaries, label audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, grouping, metrics, models, resample, similarity
from ..sources import fasta
from .catalog import _BOOT, _EDGES, _HEADS, _REPLICATES, _SHUFFLE, _bench_sequences, _metric_sql, _sequences, query, r, rounded
from ..functions.sequence import unit_hash
from .frames import SCORED, scored, table

_LABELLED = "l AS (SELECT * FROM d WHERE label IS NOT NULL)"


def _bundle_sql(source: str, keys: str, name: str) -> str:
    """CTEs that end in name: keys, metric, value; Newton's rounds are steps of a recursion."""
    join = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    own = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    c = "greatest(least(score, 1 - 1e-6), 1e-6)"
    return f"""{name}_z AS (SELECT {keys}, ln({c} / (1 - {c})) AS z, count(*) AS n, sum(label)::DOUBLE AS y FROM {source} GROUP BY ALL),
    {name}_it AS (SELECT 0 AS k, {keys}, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 1.0::DOUBLE AS moved FROM {name}_z GROUP BY {keys} HAVING sum(y) > 0 AND sum(y) < sum(n) AND min(z) < max(z)
        UNION ALL SELECT k + 1, {keys}, a + da / greatest(1, far), b + db / greatest(1, far), far FROM (SELECT *, greatest(abs(da) / greatest(1, abs(a)), abs(db) / greatest(1, abs(b))) AS far FROM (
            SELECT k, {keys}, a, b, (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS da, (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS db FROM (
                SELECT k, {keys}, a, b, sum(w) AS h0, sum(w * z) AS h1, sum(w * z * z) + 1e-8 AS h2, sum(g) AS g0, sum(g * z) - 1e-8 * b AS g1 FROM (
                    SELECT k, {own("i")}, a, b, z, n / (1 + exp(-(a + b * z))) * (1 - 1 / (1 + exp(-(a + b * z)))) AS w, y - n / (1 + exp(-(a + b * z))) AS g FROM {name}_it i JOIN {name}_z x ON {join("i", "x")} WHERE k < 160 AND moved > 1e-8)
                GROUP BY k, {keys}, a, b)))),
    {name}_w AS (SELECT {keys}, sum(n * coalesce(gap, 0)) / sum(n) AS e FROM (SELECT {keys}, len(list_filter([{_EDGES}], lambda e: e <= score AND e < 1.0)) AS bin, count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM {source} GROUP BY ALL) GROUP BY {keys}),
    {name}_f AS (SELECT {keys}, sum(n * gap) / sum(n) AS e FROM (SELECT {keys}, bin, count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM (SELECT {keys}, score, label, ntile(10) OVER (PARTITION BY {keys} ORDER BY score, row_idx, label) AS bin FROM {source}) GROUP BY ALL) GROUP BY {keys}),
    {name}_m AS (SELECT {keys}, avg(pow({c} - label, 2)) AS brier, avg(-ln(CASE WHEN label = 1 THEN {c} ELSE 1 - {c} END)) AS log_loss FROM {source} GROUP BY {keys}),
    {name} AS (SELECT {own("m")}, unnest(['brier', 'log_loss', 'ece_width', 'ece_frequency', 'calibration_intercept', 'calibration_slope']) AS metric, unnest([brier, log_loss, w.e, f.e, i.a, i.b]) AS value
        FROM {name}_m m JOIN {name}_w w ON {join("m", "w")} JOIN {name}_f f ON {join("m", "f")} LEFT JOIN (SELECT {keys}, arg_max(a, k) AS a, arg_max(b, k) AS b FROM {name}_it GROUP BY {keys}) i ON {join("m", "i")})"""


@query(f"WITH RECURSIVE {SCORED}, {_LABELLED}, {_bundle_sql('l', 'split', 'p')} SELECT split, metric, {r('value')} AS value FROM p")
def calibration_bundle(spark, sf_dir):
    """Six calibration figures of every split, lines by Newton's method."""
    return rounded(models.calibration_bundle(scored(spark, sf_dir).where("label IS NOT NULL"), ["split"]))


_SPLIT_SEED = "sha256('7' || chr(0) || 'calibration' || chr(0) || split)"


@query(f"""WITH RECURSIVE {SCORED}, {_LABELLED}, {_bundle_sql('l', 'split', 'p')},
    nn AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY row_idx) - 1 AS k, count(*) OVER (PARTITION BY split, label) AS m, ('0x' || {_SPLIT_SEED}[7:8] || {_SPLIT_SEED}[5:6] || {_SPLIT_SEED}[3:4] || {_SPLIT_SEED}[1:2])::BIGINT AS seed FROM l),
    dd AS (SELECT rep AS replicate, split, label, floor(('0x' || substr(md5(seed || '|' || rep || '|' || label || '|' || k), 1, 8))::BIGINT / 4294967296.0 * m)::BIGINT AS k FROM nn, range({_REPLICATES}) t(rep)),
    bb AS (SELECT dd.replicate, nn.* FROM dd JOIN nn ON dd.split = nn.split AND dd.label = nn.label AND dd.k = nn.k), {_bundle_sql('bb', 'split, replicate', 'q')}
    SELECT p.split, p.metric, {r('any_value(p.value)')} AS estimate, {r('quantile_cont(q.value, 0.025)')} AS low, {r('quantile_cont(q.value, 0.975)')} AS high FROM p LEFT JOIN q ON p.split = q.split AND p.metric = q.metric GROUP BY p.split, p.metric""")
def calibration_intervals(spark, sf_dir):
    """The calibration bundle with bootstrap limits, each split by a stable seed of its own."""
    return rounded(models.calibration_intervals(scored(spark, sf_dir).where("label IS NOT NULL"), ["split"], _REPLICATES, 7))


@query(f"""WITH {SCORED}, {_BOOT}, bl AS (SELECT replicate, label, weight, unnest(['score', 'rival']) AS model, unnest([score, rival]) AS v FROM b), {_metric_sql('v', 'model, replicate', weight='weight', source='bl')},
    o AS (SELECT model, unnest(['auc', 'average_precision', 'brier']) AS metric, unnest([area / nullif(P_ * N_, 0), prec / nullif(P_, 0), se / (P_ + N_)]) AS v FROM m)
    SELECT model, metric, {r('quantile_cont(v, 0.025)')} AS low, {r('quantile_cont(v, 0.5)')} AS median, {r('quantile_cont(v, 0.975)')} AS high FROM o GROUP BY ALL""")
def weighted_intervals(spark, sf_dir):
    """Bootstrap limits of weighted metrics; weights travel with the rows drawn."""
    return rounded(resample.bootstrap_intervals(scored(spark, sf_dir).where("label IS NOT NULL"), ["score", "rival"], _REPLICATES, 7, weight="weight"))


_CUTOFFS = (0.0, 0.4, 0.6)


@query(f"""WITH {SCORED}, {_LABELLED}, e AS (SELECT l.*, c AS identity_cutoff, 31 + i AS seed, rival < c AS kept FROM l, (SELECT unnest({list(_CUTOFFS)})::DOUBLE AS c, unnest(range({len(_CUTOFFS)})) AS i)),
    cc AS (SELECT identity_cutoff, count(*) FILTER (kept) AS n, count(*) FILTER (kept AND label = 1) AS positive_n, count(*) FILTER (kept AND label = 0) AS negative_n, avg(kept::INT) AS retained_fraction FROM e GROUP BY 1),
    h AS (SELECT e.* FROM e JOIN cc USING (identity_cutoff) WHERE kept AND positive_n > 0 AND negative_n > 0),
    nn AS (SELECT *, row_number() OVER (PARTITION BY identity_cutoff, label ORDER BY row_idx) - 1 AS k, count(*) OVER (PARTITION BY identity_cutoff, label) AS mm FROM h),
    dd AS (SELECT rep AS replicate, identity_cutoff, label, floor(('0x' || substr(md5(seed || '|' || rep || '|' || label || '|' || k), 1, 8))::BIGINT / 4294967296.0 * mm)::BIGINT AS k FROM nn, range({_REPLICATES}) t(rep)),
    bl AS (SELECT dd.replicate, nn.* FROM dd JOIN nn ON dd.identity_cutoff = nn.identity_cutoff AND dd.label = nn.label AND dd.k = nn.k UNION ALL SELECT -1, * FROM nn), {_metric_sql('score', 'identity_cutoff, replicate', source='bl')},
    o AS (SELECT identity_cutoff, replicate, unnest(['auc', 'average_precision', 'brier']) AS metric, unnest([area / nullif(P_ * N_, 0), prec / nullif(P_, 0), se / (P_ + N_)]) AS v FROM m),
    su AS (SELECT identity_cutoff, metric, max(v) FILTER (replicate < 0) AS estimate, quantile_cont(v, 0.025) FILTER (replicate >= 0) AS low, quantile_cont(v, 0.975) FILTER (replicate >= 0) AS high FROM o GROUP BY ALL)
    SELECT identity_cutoff, coalesce(metric, 'not_estimable') AS metric, {r('estimate')} AS estimate, {r('low')} AS low, {r('high')} AS high, n, positive_n, negative_n, {r('retained_fraction')} AS retained_fraction FROM cc LEFT JOIN su USING (identity_cutoff)""")
def cutoff_sensitivity(spark, sf_dir):
    """Metrics of rows below each cutoff, with limits; the first cutoff leaves no row."""
    return rounded(resample.cutoff_sensitivity(scored(spark, sf_dir), "rival", _CUTOFFS, _REPLICATES, 31))


_MATCHED = f"""ct AS (SELECT length, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS take FROM d WHERE label IS NOT NULL GROUP BY length),
    xx AS (SELECT rep AS replicate, d.*, take, row_number() OVER (PARTITION BY rep, length, label ORDER BY ('0x' || substr(md5('11|' || rep || '|' || row_idx), 1, 8))::BIGINT, row_idx) AS k FROM d JOIN ct USING (length), range({_REPLICATES}) t(rep) WHERE label IS NOT NULL AND take > 0),
    mt AS (SELECT * FROM xx WHERE k <= take)"""


@query(f"""WITH {SCORED}, {_MATCHED}, t AS (SELECT row_idx, count(*) AS times FROM mt GROUP BY 1) SELECT row_idx, coalesce(times, 0) AS times_selected, {r(f'coalesce(times, 0) / {_REPLICATES}.0')} AS selection_fraction FROM d LEFT JOIN t USING (row_idx) WHERE label IS NOT NULL""")
def match_frequency(spark, sf_dir):
    """How often each row is selected over the matchings."""
    return rounded(resample.match_frequency(scored(spark, sf_dir).where("label IS NOT NULL"), "length", _REPLICATES, 11))


@query(f"""WITH {SCORED}, {_MATCHED}, {_metric_sql('score', 'replicate', source='mt')},
    o AS (SELECT unnest(['auc', 'average_precision', 'brier', 'mcc']) AS metric, unnest([area / nullif(P_ * N_, 0), prec / nullif(P_, 0), se / (P_ + N_), coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)]) AS v FROM m)
    SELECT metric, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS sd, {r('quantile_cont(v, 0.025)')} AS low, {r('quantile_cont(v, 0.5)')} AS median, {r('quantile_cont(v, 0.975)')} AS high FROM o GROUP BY 1""")
def match_summary(spark, sf_dir):
    """Mean, deviation and limits of metrics over the matchings."""
    return rounded(resample.match_summary(scored(spark, sf_dir).where("label IS NOT NULL"), "length", _REPLICATES, 11))


def _manifest(spark, sf_dir):
    d = scored(spark, sf_dir).select("row_idx", (F.col("split") % 2).alias("split"), F.col("toxic").alias("label"))
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.md5("text").alias("sequence"))
    head = F.concat(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("row_idx") % len(_HEADS) + 1).cast("int")), F.lit("|"), F.col("row_idx").cast("string"))
    found = F.coalesce(F.col("sequence").endswith("0"), F.lit(False))
    return audit.label_manifest(d.join(t, "row_idx").where("label IS NOT NULL").withColumns({"header": head, "found": found}), fasta.label_delimited(F.col("header")), "0123456789abcdef")


_MANIFEST = f"""t AS (SELECT row_idx, split % 2 AS split, toxic AS label, md5(text) AS sequence, ({list(_HEADS)})[row_idx % {len(_HEADS)} + 1] || '|' || row_idx AS header FROM d JOIN documents ON doc_id = row_idx WHERE toxic IS NOT NULL),
    u AS (SELECT *, CASE WHEN regexp_matches(lower(header), '{fasta.DELIMITED % "(?:1|pos)"}') THEN 1 WHEN regexp_matches(lower(header), '{fasta.DELIMITED % "(?:0|neg)"}') THEN 0 END AS header_label FROM t),
    man AS (SELECT 'row_' || lpad(row_idx::VARCHAR, greatest(5, length(row_idx::VARCHAR))::INT, '0') AS row_id, row_idx, split, header, sequence, length(sequence)::INT AS length, label, header_label, header_label IS NOT NULL AS header_label_available, coalesce(header_label = label, true) AS header_label_consistent,
        coalesce(regexp_matches(sequence, '^[0-9a-f]+$'), false) AS valid_alphabet, count(*) OVER (PARTITION BY split, sequence) > 1 AS duplicated_within_split, coalesce(min(split) OVER (PARTITION BY sequence) <> max(split) OVER (PARTITION BY sequence), false) AS cross_split_overlap,
        coalesce(min(label) OVER (PARTITION BY sequence) <> max(label) OVER (PARTITION BY sequence), false) AS conflicting_label, coalesce(sequence LIKE '%0', false) AS found_elsewhere FROM u)"""


@query(f"WITH {SCORED}, {_MANIFEST} SELECT * FROM man")
def label_manifest(spark, sf_dir):
    """Q1: every labelled document with its header's label and the marks of the audit."""
    return _manifest(spark, sf_dir)


_FIRST, _SECOND = "split = 0", "split = 1"
_ITEMS = {
    "first_n": f"count(*) FILTER ({_FIRST})", "first_positive": f"count(*) FILTER ({_FIRST} AND label = 1)", "first_negative": f"count(*) FILTER ({_FIRST} AND label = 0)",
    "second_n": f"count(*) FILTER ({_SECOND})", "second_positive": f"count(*) FILTER ({_SECOND} AND label = 1)", "second_negative": f"count(*) FILTER ({_SECOND} AND label = 0)",
    "total_n": "count(*)", "total_positive": "count(*) FILTER (label = 1)", "total_negative": "count(*) FILTER (label = 0)",
    "header_label_mismatches": f"count(*) FILTER ({_SECOND} AND NOT header_label_consistent)", "nonstandard_rows": "count(*) FILTER (NOT valid_alphabet)", "within_split_duplicate_rows": "count(*) FILTER (duplicated_within_split)",
    "overlap_sequences": "count(DISTINCT sequence) FILTER (cross_split_overlap)", "conflicting_label_rows": "count(*) FILTER (conflicting_label)",
    "found_positive": "count(*) FILTER (found_elsewhere AND label = 1)", "found_negative": "count(*) FILTER (found_elsewhere AND label = 0)", # Fixed values: counts that the audited report gives.
    "reported_positive": "1528", "reported_negative": "1509", "counts_are_transposed": "count(*) FILTER (label = 1) = 1509 AND count(*) FILTER (label = 0) = 1528",
}


_LF = lambda x: f"lgamma({x} + 1)"
#: Fisher's two-sided test of being found against the label, in logarithms of factorials; null without any found.
_FISHER = f"""ft AS (SELECT count(*) FILTER (found_elsewhere AND label = 1) AS a, count(*) FILTER (NOT found_elsewhere AND label = 1) AS b, count(*) FILTER (found_elsewhere AND label = 0) AS c, count(*) FILTER (NOT found_elsewhere AND label = 0) AS d FROM man),
    fl AS (SELECT *, {_LF('a + b')} + {_LF('c + d')} + {_LF('a + c')} + {_LF('b + d')} - {_LF('a + b + c + d')} - {_LF('x')} - {_LF('a + b - x')} - {_LF('a + c - x')} - {_LF('d - a + x')} AS lp FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM ft)),
    fi AS (SELECT a * d / (b * c) AS odds_ratio, least(1, sum(exp(lp)) FILTER (lp <= own + 1e-7)) AS fisher_p FROM (SELECT *, max(lp) FILTER (x = a) OVER () AS own FROM fl) GROUP BY a, b, c, d)"""


@query(f"""WITH {SCORED}, {_MANIFEST}, {_FISHER}, one AS (SELECT {', '.join(f"({v})::VARCHAR AS {k}" for k, v in _ITEMS.items())}, (SELECT printf('%.6f', odds_ratio) FROM fi) AS odds_ratio, (SELECT printf('%.6f', fisher_p) FROM fi) AS fisher_p FROM man)
    SELECT * FROM (UNPIVOT one ON COLUMNS(*) INTO NAME item VALUE value)""")
def label_audit(spark, sf_dir):
    """The counts of the audit's report, with the odds ratio and p value of being found elsewhere."""
    items = audit.label_audit_items(_manifest(spark, sf_dir), {"first": 0, "second": 1}, "second", (1528, 1509))
    shown = F.when(F.col("item").isin("odds_ratio", "fisher_p"), F.format_string("%.6f", F.expr("try_cast(value AS double)"))).otherwise(F.col("value"))
    return items.withColumn("value", shown)


@query(f"""WITH {SCORED}, i AS (SELECT row_idx, 'id' || (row_idx % 7) AS record_id FROM d), m AS (SELECT row_idx, CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM i GROUP BY record_id)) > 1 THEN 'record_' || lpad(row_idx::VARCHAR, greatest(5, length(row_idx::VARCHAR))::INT, '0') ELSE record_id END AS record_id FROM i)
    SELECT * FROM m""")
def unique_record_ids(spark, sf_dir):
    """Ids rewritten where any repeats."""
    d = scored(spark, sf_dir).select("row_idx", F.concat(F.lit("id"), (F.col("row_idx") % 7).cast("string")).alias("record_id"))
    return fasta.unique_record_ids(d)


@query(f"""WITH {SCORED}, {_metric_sql(keys='source')}, o AS (SELECT source, unnest(['auc', 'brier', 'mcc', 'log_loss']) AS metric, unnest([area / nullif(P_ * N_, 0), se / (P_ + N_), coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), ll / (P_ + N_)]) AS value FROM m)
    SELECT source, metric, round(value, 4) AS value FROM o WHERE metric IN ('auc', 'mcc') AND value IS NOT NULL""")
def figure_frame(spark, sf_dir):
    """The rows behind a figure: chosen metrics of every source, nulls dropped, rounded for display."""
    wide = metrics.metrics(scored(spark, sf_dir), ["source"])
    long = wide.select("source", F.expr("stack(4, 'auc', auc, 'brier', brier, 'mcc', mcc, 'log_loss', log_loss) AS (metric, value)"))
    return long.where(F.col("metric").isin("auc", "mcc")).na.drop(subset=["value"]).withColumn("value", F.round("value", 4))


def _two_sets(spark, sf_dir):
    """Sequences of the benchmark by the item they first occur in: a fifth of the items are the test set."""
    rows = _bench_sequences(spark, sf_dir)
    tested = F.shiftright("row_idx", 32) % 5 == 0
    return rows.where(~tested), rows.where(tested)


@query(f"""WITH {SCORED}, p AS (SELECT row_idx, unnest(['half', 'score', 'spoilt']) AS model, unnest([0.5, score, CASE row_idx % 7 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 1 + score WHEN 3 THEN '-Infinity'::DOUBLE ELSE rival END]) AS v FROM d)
    SELECT model, count(*) AS n, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (isnan(v) OR isinf(v)) AS non_finite, count(*) FILTER (NOT isnan(v) AND NOT isinf(v) AND (v < 0 OR v > 1)) AS outside, (SELECT count(*) - count(DISTINCT row_idx) FROM d) AS repeated FROM p GROUP BY model""")
def prediction_contract(spark, sf_dir):
    """what breaks the contract of prediction vectors, in good ones and in one that is spoilt here."""
    d = scored(spark, sf_dir)
    k = F.col("row_idx") % 7
    spoilt = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, 1 + F.col("score")).when(k == 3, float("-inf")).otherwise(F.col("rival"))
    return audit.prediction_counts(d.select("row_idx", "score", F.lit(0.5).alias("half"), spoilt.alias("spoilt")), ["half", "score", "spoilt"])


@query()
def nearest_hits(spark, sf_dir):
    """Of every test sequence the nearest training sequence, and the nearest of enough coverage."""
    train, test = _two_sets(spark, sf_dir)
    return rounded(similarity.nearest(test, train))


@query()
def nearest_sequences(spark, sf_dir):
    """J8 on all documents: of every test sequence the nearest among all sequences of the documents."""
    return rounded(similarity.nearest(_two_sets(spark, sf_dir)[1], grouping._written(_sequences(spark, sf_dir), "sequences")))


@query()
def similar_sequences(spark, sf_dir):
    """J6 on all documents: pairs of all their distinct sequences with an insertion-deletion ratio of 92.5 or more."""
    return rounded(similarity.signature_join(grouping._written(_sequences(spark, sf_dir), "sequences"), cutoff=92.5))


@query()
def identity_sensitivity(spark, sf_dir):
    """Metrics of test sequences whose nearest training sequence lies below each identity."""
    train, test = _two_sets(spark, sf_dir)
    near = similarity.nearest(test, train).select(F.col("l_idx").alias("row_idx"), F.col("eligible_identity").alias("identity"))
    scores = test.join(near, "row_idx").select("row_idx", (F.length("sequence") % 2).alias("label"), unit_hash(F.lit("o"), "sequence").alias("score"), "identity")
    return rounded(resample.cutoff_sensitivity(grouping._written(scores, "identities"), "identity", (0.0, 0.4, 0.5, 0.6), _REPLICATES, 70877))


@query()
def similarity_removal(spark, sf_dir):
    """Training sequences with their nearest test sequence, and whether they are too near."""
    train, test = _two_sets(spark, sf_dir)
    return rounded(similarity.similarity_removal(train, test))


@query(f"""WITH {_SHUFFLE}, og AS (SELECT row_idx, length(sequence) % 2 AS label, ('0x' || substr(md5('o|' || sequence), 1, 8))::BIGINT / 4294967296.0 AS score FROM q),
    sh AS (SELECT row_idx, count(*) AS shuffles, avg(('0x' || substr(md5('o|' || shuffled), 1, 8))::BIGINT / 4294967296.0) AS mean_score FROM y GROUP BY 1),
    bo AS (SELECT * FROM og JOIN sh USING (row_idx)), lo AS (SELECT unnest(['a', 'b']) AS model, label, unnest([score, mean_score]) AS v FROM bo), {_metric_sql('v', 'model', source='lo')},
    au AS (SELECT max(area / (P_ * N_)) FILTER (model = 'a') AS auc, max(area / (P_ * N_)) FILTER (model = 'b') AS auc_shuffled FROM m)
    SELECT count(*) AS originals, sum(shuffles)::BIGINT AS shuffles, {r('corr(score, mean_score)')} AS correlation, {r('avg(abs(mean_score - score))')} AS mean_absolute_change, {r('avg(mean_score - score) FILTER (label = 1)')} AS positive_change,
    {r('avg(mean_score - score) FILTER (label = 0)')} AS negative_change, {r('any_value(auc)')} AS auc, {r('any_value(auc_shuffled)')} AS auc_shuffled, {r('any_value(auc - auc_shuffled)')} AS auc_drop FROM bo, au""")
def shuffle_effect(spark, sf_dir):
    """Scores of shuffled sequences averaged by original, and what they change."""
    s = _sequences(spark, sf_dir)
    own = s.select("row_idx", (F.length("sequence") % 2).alias("label"), unit_hash(F.lit("o"), "sequence").alias("score"))
    shuffled = resample.shuffles(s, 4, 5).select("row_idx", unit_hash(F.lit("o"), "shuffled").alias("score"))
    return rounded(resample.shuffle_effect(own, shuffled))


@query()
def control_models(spark, sf_dir):
    """Out-of-fold metrics of models of simple representations."""
    return models.document_controls(spark, sf_dir)
