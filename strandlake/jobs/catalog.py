"""Queries over the driver's tables, one for each operator, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as X
from ..operators import audit, crossfit, features, grouping, metrics, models, quantiles, resample, similarity, substring
from ..sources import fasta, tables
from .frames import LOWER, SCORED, UPPER, raw_words, scored, table, words, words_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(x: str) -> str:
    return f"round(({x})::DOUBLE, {DIGITS})"


# Sources, headers, validation


def _files(spark, sf_dir):
    s = scored(spark, sf_dir).select("row_idx", "label", "split")
    head = F.concat(F.lit(">"), F.coalesce(F.col("label").cast("string"), F.lit("x")), F.lit("|doc_"), F.col("row_idx").cast("string"), F.lit(" split|"), F.col("split").cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text").join(s, "row_idx").select(F.col("row_idx").alias("file"), F.concat(F.lit("dropped\n"), head, F.coalesce("text", F.lit("")), F.lit("\r\n>empty\n")).alias("content"))


@query(f"""WITH {SCORED}, f AS (SELECT row_idx AS file, coalesce(label::VARCHAR, 'x') || '|doc_' || row_idx || ' split|' || split AS header,
        replace(array_to_string(list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x)), ''), ' ', '') AS s FROM d JOIN documents ON doc_id = row_idx)
    SELECT file, 1::BIGINT AS record, header, string_split_regex(header, '\\s+')[1] AS record_id, length(s)::INT AS n, md5(s) AS digest FROM f
    UNION ALL SELECT file, 2, 'empty', 'empty', 0, md5('') FROM f""")
def fasta_scan(spark, sf_dir):
    """Records of many files, text before a first header dropped."""
    p = fasta.parse(_files(spark, sf_dir), keep_case=True)
    return p.select("file", "record", "header", fasta.record_id(F.col("header")).alias("record_id"), F.length("sequence").alias("n"), F.md5("sequence").alias("digest"))


#: Beginnings of headers that the label rules read differently.
_HEADS = ("1neg", "neg_1", "positive_set", "Antioxidant-7", "nonanox_3", "_pos_x", "x|NEG", "non-antioxidant", "sample", "0|pos", "posneg-1")


def _any_sql(tokens: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower(h), '{t}')" for t in tokens)


@query(f"""WITH {SCORED}, h AS (SELECT row_idx, ({list(_HEADS)})[row_idx % {len(_HEADS)} + 1] || '|set' || split || '|' || CASE WHEN split < 2 THEN '0' WHEN split = 2 THEN '1' ELSE 'none' END AS h FROM d)
    SELECT row_idx, h AS header, CASE WHEN split_part(h, '|', -1) IN ('0', '1') THEN split_part(h, '|', -1)::INT WHEN h[1] IN ('0', '1') THEN h[1]::INT ELSE 0 END AS last_field,
    CASE WHEN h[1] IN ('0', '1') THEN h[1]::INT ELSE list_filter(string_split(h, '|'), lambda x: x IN ('0', '1'))[1]::INT END AS first_char,
    CASE WHEN {_any_sql(fasta.NEGATIVE_TOKENS)} THEN 0 WHEN {_any_sql(fasta.POSITIVE_TOKENS)} THEN 1 END AS tokens,
    CASE WHEN regexp_matches(lower(h), '{fasta.DELIMITED % "(?:1|pos)"}') THEN 1 WHEN regexp_matches(lower(h), '{fasta.DELIMITED % "(?:0|neg)"}') THEN 0 END AS delimited FROM h""")
def header_labels(spark, sf_dir):
    """S5, X4a-X4e: labels from headers by every rule, on headers that tell the rules apart."""
    d = scored(spark, sf_dir)
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("row_idx") % len(_HEADS) + 1).cast("int"))
    h = F.concat(head, F.lit("|set"), F.col("split").cast("string"), F.lit("|"), F.when(F.col("split") < 2, "0").when(F.col("split") == 2, "1").otherwise("none"))
    c = F.col("header")
    return d.select("row_idx", h.alias("header")).select("row_idx", "header", fasta.label_last_field(c).alias("last_field"), fasta.label_first_char(c).alias("first_char"), fasta.label_tokens(c).alias("tokens"), fasta.label_delimited(c).alias("delimited"))


@query(f"""WITH {words_sql()} SELECT doc_id % 5 AS split, count(*) AS n, count(*) FILTER (regexp_matches(word, '^[{X.RESIDUES}]+$')) AS valid_words, count(*) FILTER (sequence <> '') AS valid_sequences,
    count(*) FILTER (length(sequence) BETWEEN 2 AND 20) AS of_length, min(length(sequence))::INT AS shortest, max(length(sequence))::INT AS longest FROM w GROUP BY 1""")
def validity(spark, sf_dir):
    """Alphabet and length checks of every word."""
    w = words(spark, sf_dir)
    n = F.length("sequence")
    return w.groupBy((F.col("doc_id") % 5).alias("split")).agg(F.count("*").alias("n"), F.count_if(X.valid(F.col("word"))).alias("valid_words"), F.count_if(X.valid(F.col("sequence"))).alias("valid_sequences"), F.count_if(n.between(2, 20)).alias("of_length"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


# Composition and descriptors


@query(f"""WITH {words_sql()}, s AS (SELECT doc_id, string_agg(sequence, '' ORDER BY pos) AS s FROM w GROUP BY doc_id),
    l AS (SELECT doc_id, length(s) AS n, s, unnest(string_split('{X.RESIDUES}', '')) AS residue FROM s WHERE s <> '')
    SELECT doc_id, residue, {r('(n - length(replace(s, residue, chr(0)[1:0]))) / n')} AS share FROM l""".replace("chr(0)[1:0]", "''"))
def composition(spark, sf_dir):
    """Residue shares of every document's letters."""
    s = table(spark, sf_dir, "documents").select("doc_id", X.residues_of(F.col("text")).alias("s")).where("s != ''")
    return rounded(s.select("doc_id", F.posexplode(X.composition(F.col("s"))).alias("k", "share")).select("doc_id", F.substring(F.lit(X.RESIDUES), F.col("k") + 1, F.lit(1)).alias("residue"), "share"))


@query(f"""WITH {words_sql()}, g AS (SELECT sequence[i:i + 1] AS pair FROM (SELECT sequence, unnest(range(1, length(sequence))) AS i FROM w))
    SELECT pair, count(*) AS n, {r('count(*) / (SELECT count(*) FROM g)')} AS share FROM g GROUP BY pair""")
def pair_composition(spark, sf_dir):
    """Overlapping pairs of residues over all words."""
    g = words(spark, sf_dir).groupBy("sequence").agg(F.count("*").alias("w")).select("w", F.explode(X.bigrams(F.col("sequence"))).alias("pair")).groupBy("pair").agg(F.sum("w").alias("n"))
    total = g.agg(F.sum("n").alias("t"))  # one row
    return rounded(g.join(F.broadcast(total)).select("pair", "n", (F.col("n") / F.col("t")).alias("share")))


@query(f"""WITH t AS (SELECT doc_id AS row_idx, regexp_replace(translate(coalesce(text, ''), '{LOWER}', '{UPPER}'), '[^{X.RESIDUES}]', '', 'g') AS s FROM documents),
    p AS (SELECT row_idx, pair, count(*) AS n FROM (SELECT row_idx, unnest(list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1])) AS pair FROM (SELECT row_idx, string_split(s, '') AS l FROM t WHERE s <> '')) GROUP BY ALL)
    SELECT row_idx, position(pair[1] IN '{X.RESIDUES}') * 20 + position(pair[2] IN '{X.RESIDUES}') - 1 AS place, {r('n / sum(n) OVER (PARTITION BY row_idx)')} AS share FROM p
    UNION ALL SELECT row_idx, i - 1, {r("(length(s) - length(replace(s, rs[i], ''))) / length(s)")} FROM (SELECT row_idx, s, rs, unnest(range(1, 21)) AS i FROM (SELECT row_idx, s, string_split('{X.RESIDUES}', '') AS rs FROM t)) WHERE contains(s, rs[i])
    UNION ALL SELECT row_idx, 420, length(s)::DOUBLE FROM t WHERE s <> ''""")
def feature_vectors(spark, sf_dir):
    """What is not zero of the 421-wide vectors, residues, pairs and length, of every document."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), X.residues_of(F.coalesce("text", F.lit(""))).alias("sequence"))
    v = features.handcrafted(t).select("row_idx", F.posexplode(features.vector()).alias("place", "share"))
    return rounded(v.where("share != 0").select("row_idx", F.col("place").cast("long").alias("place"), "share"))


def _sum_sql(weights: dict) -> str:
    return " + ".join(f"(length(sequence) - length(replace(sequence, '{k}', ''))) * ({v})" for k, v in weights.items())


def _charge_sql() -> str:
    plus, minus = (lambda pk: f"1 / (1 + pow(10.0, 7.0 - ({pk})))"), (lambda pk: f"1 / (1 + pow(10.0, ({pk}) - 7.0))")
    case = lambda c, m, e: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + f" ELSE {e} END"
    count = lambda k: f"(length(sequence) - length(replace(sequence, '{k}', '')))"
    return plus(case("sequence[1]", X.PK_N_END, 7.5)) + " - " + minus(case("sequence[-1]", X.PK_C_END, 3.55)) + "".join(f" + {count(k)} * {plus(v)}" for k, v in X.PK_POSITIVE.items()) + "".join(f" - {count(k)} * {minus(v)}" for k, v in X.PK_NEGATIVE.items())


@query(f"""WITH {words_sql()}, s AS (SELECT sequence, count(*) AS occurrences FROM w WHERE sequence <> '' GROUP BY 1)
    SELECT sequence, occurrences, length(sequence)::INT AS length, {r(f'({_sum_sql(X.HYDROPATHY)}) / length(sequence)')} AS gravy, {r(f'{_sum_sql(X.MASS)} - (length(sequence) - 1) * {X.WATER}')} AS weight, {r(_charge_sql())} AS charge FROM s""")
def descriptors(spark, sf_dir):
    """Hydropathy, mass and charge, once for each distinct sequence."""
    s = raw_words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")).select(X.residues_of(F.col("word")).alias("sequence"), "n").where("sequence != ''").groupBy("sequence").agg(F.sum("n").alias("occurrences"))
    c = F.col("sequence")
    return rounded(s.select("sequence", "occurrences", F.length("sequence").alias("length"), X.gravy(c).alias("gravy"), X.molecular_weight(c).alias("weight"), X.charge(c).alias("charge")))


_SEED = "sha256('7' || chr(0) || doc_id || chr(0) || 'lists')"


@query(f"""WITH {words_sql()} SELECT doc_id, sha256(string_agg(sequence || chr(0), '' ORDER BY pos))[1:16] AS digest,
    ('0x' || {_SEED}[7:8] || {_SEED}[5:6] || {_SEED}[3:4] || {_SEED}[1:2])::BIGINT AS seed, count(DISTINCT sequence) AS kinds FROM w GROUP BY doc_id""")
def list_hashes(spark, sf_dir):
    """Hashes of every document's sequence list, stable seeds, distinct counts."""
    w = X.word_list(F.col("text"))
    s = table(spark, sf_dir, "documents").select("doc_id", F.transform(w, X.residues_of).alias("s")).where("size(s) > 0")
    return s.select("doc_id", X.sequence_list_hash(F.col("s")).alias("digest"), X.stable_seed(7, "doc_id", F.lit("lists")).alias("seed"), F.size(F.array_distinct("s")).cast("long").alias("kinds"))


_COUNTS = [f"(length(sequence) - length(replace(sequence, '{c}', '')))" for c in X.RESIDUES]


@query(f"""WITH {words_sql()}, s AS (SELECT DISTINCT sequence, length(sequence)::INT AS n FROM w WHERE sequence <> '')
    SELECT sequence, CASE WHEN n <= 20 THEN (factorial(least(n, 20)) // {" // ".join(f"factorial(least({c}, 20)::INT)" for c in _COUNTS)} - 1)::BIGINT END AS orders,
    {r("(lgamma(n + 1) - " + " - ".join(f"lgamma({c} + 1)" for c in _COUNTS) + ") / ln(10)")} AS log_orders FROM s""")
def permutation_counts(spark, sf_dir):
    """Distinct orders of every sequence of the documents, exact to 20 residues, by logarithm at any length."""
    s = raw_words(spark, sf_dir).select("word").distinct().select(X.residues_of(F.col("word")).alias("sequence")).where("sequence != ''").distinct()
    return rounded(s.select("sequence", X.permutations(F.col("sequence")).alias("orders"), X.log_permutations(F.col("sequence")).alias("log_orders")))


# Summaries, joins, windows


@query(f"WITH {SCORED} SELECT split, label, count(*) AS n, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 0) AS negatives, {r('avg(length)')} AS mean_length FROM d GROUP BY split, label")
def dataset_summary(spark, sf_dir):
    """A1, A2, X20."""
    return rounded(audit.summary(scored(spark, sf_dir), ["split", "label"], label="toxic"))


@query(f"""WITH {SCORED}, c AS (SELECT source, count(*) FILTER (label = 0) AS negative, count(*) FILTER (label = 1) AS positive FROM d WHERE label IS NOT NULL GROUP BY 1),
    g AS (SELECT source, count(*) AS size, min(row_idx) AS first_index, min(length)::INT AS shortest, max(length)::INT AS longest FROM d GROUP BY 1)
    SELECT source, size, first_index, shortest, longest, coalesce(negative, 0) AS negative, coalesce(positive, 0) AS positive, coalesce(least(negative, positive), 0) AS shared, coalesce(least(negative, positive) > 0, false) AS "both" FROM g LEFT JOIN c USING (source)""")
def group_table(spark, sf_dir):
    """Group summary joined with its class counts."""
    d = scored(spark, sf_dir)
    g = d.groupBy("source").agg(F.count("*").alias("size"), F.min("row_idx").alias("first_index"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    return g.join(audit.class_table(d, "source"), "source", "left").na.fill({"negative": 0, "positive": 0, "shared": 0, "both": False})


@query("""WITH t AS (SELECT doc_id AS row_idx, doc_id % 5 AS split, text, quality::INT AS label FROM documents LEFT JOIN labels USING (doc_id))
    SELECT row_idx, count(*) OVER (PARTITION BY split, text) > 1 AS duplicate, coalesce(min(label) OVER (PARTITION BY text) <> max(label) OVER (PARTITION BY text), false) AS conflict,
    coalesce(min(split) OVER (PARTITION BY text) <> max(split) OVER (PARTITION BY text), false) AS crosses, row_number() OVER (PARTITION BY text ORDER BY row_idx) = 1 AS "first" FROM t""")
def label_integrity(spark, sf_dir):
    """Duplicates, conflicts and overlaps of whole texts."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), (F.col("doc_id") % 5).alias("split"), F.xxhash64("text").alias("h"), F.md5("text").alias("sequence"))
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_idx"), F.col("quality").cast("int").alias("label"))
    return audit.integrity(t.join(l, "row_idx", "left")).select("row_idx", "duplicate", "conflict", "crosses", "first")


@query(f"""WITH {words_sql()} SELECT sequence, min(doc_id * 4294967296 + pos) AS row_idx, count(*) AS n, count(DISTINCT doc_id) AS documents FROM w WHERE sequence <> '' AND sequence NOT IN (
    SELECT regexp_replace(translate(unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^{X.RESIDUES}]', '', 'g') FROM benchmark) GROUP BY sequence""")
def unseen_sequences(spark, sf_dir):
    """Sequences of documents that no benchmark item has, with their first place."""
    w = words(spark, sf_dir).where("sequence != ''").withColumn("at", F.col("doc_id") * (1 << 32) + F.col("pos"))
    own = w.groupBy("sequence").agg(F.min("at").alias("row_idx"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))
    return own.join(words(spark, sf_dir, "benchmark", "item_id").select("sequence").distinct(), "sequence", "left_anti")


@query("SELECT doc_id, coalesce(bool_or(contains(d.text, b.text)), false) AS contained FROM documents d LEFT JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id")
def substring_overlap(spark, sf_dir):
    """Documents that contain a benchmark item."""
    return substring.contains_any(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "contained")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def substring_matches(spark, sf_dir):
    """Every document with every benchmark item that occurs in it."""
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    pairs = substring.substring_pairs(d, b)
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    return d.select("doc_id", digest).join(pairs, "digest").join(b.select("item_id", F.col("text").alias("needle")), "needle").select("doc_id", "item_id")


@query(f"""WITH {words_sql()}, s AS (SELECT DISTINCT sequence FROM w WHERE sequence <> ''), {words_sql("benchmark", "item_id").replace("w AS", "v AS", 1)}, n AS (SELECT DISTINCT sequence AS needle FROM v WHERE sequence <> '')
    SELECT needle, count(*) AS sequences, sum(length(sequence))::BIGINT AS residues FROM n JOIN s ON contains(sequence, needle) GROUP BY needle""")
def contained_sequences(spark, sf_dir):
    """For every sequence of the benchmark, the distinct sequences of the documents that contain it: needles of any length."""
    s = raw_words(spark, sf_dir).select("word").distinct().select(X.residues_of(F.col("word")).alias("sequence")).where("sequence != ''").distinct()
    n = words(spark, sf_dir, "benchmark", "item_id").select("sequence").where("sequence != ''").distinct()
    s = grouping._written(s, "sequences")
    pairs = substring.substring_pairs(s, n, "sequence", "sequence")
    own = s.select(F.unhex(F.sha2("sequence", 256)).alias("digest"), F.length("sequence").cast("long").alias("k"))
    return pairs.join(own, "digest").groupBy("needle").agg(F.count("*").alias("sequences"), F.sum("k").alias("residues"))


@query(f"WITH {SCORED}, a AS (SELECT text FROM documents WHERE doc_id % 5 = 0), b AS (SELECT text FROM documents WHERE doc_id % 5 <> 0) SELECT 'both' AS side, count(*) AS n FROM (SELECT text FROM a INTERSECT SELECT text FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT text FROM a EXCEPT SELECT text FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT text FROM b EXCEPT SELECT text FROM a)")
def split_overlap(spark, sf_dir):
    """Set operations between the texts of split 0 and those of all others; split_overlaps has every pair."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("t"))
    a, b = (t.where(c).select("t") for c in (F.col("doc_id") % 5 == 0, F.col("doc_id") % 5 != 0))
    n = lambda df, s: df.agg(F.lit(s).alias("side"), F.count("*").alias("n"))
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "left")).unionByName(n(b.subtract(a), "right"))


@query("""WITH t AS (SELECT DISTINCT doc_id % 5 AS split, text FROM documents WHERE doc_id IS NOT NULL), s AS (SELECT split, count(*) AS n FROM t GROUP BY 1),
    j AS (SELECT a.split AS l, b.split AS r, count(*) AS n FROM t a JOIN t b ON a.text IS NOT DISTINCT FROM b.text AND a.split < b.split GROUP BY 1, 2),
    p AS (SELECT x.split AS l, y.split AS r, x.n AS ln, y.n AS rn, coalesce(j.n, 0) AS b FROM s x JOIN s y ON x.split < y.split LEFT JOIN j ON j.l = x.split AND j.r = y.split)
    SELECT l AS left_split, r AS right_split, unnest(['both', 'left', 'right']) AS side, unnest([b, ln - b, rn - b]) AS n FROM p""")
def split_overlaps(spark, sf_dir):
    """Set operations between the texts of every pair of splits, over all documents."""
    t = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("split"), F.sha2("text", 256).alias("sequence"))
    return audit.overlaps(t)


@query("""WITH e AS (SELECT label, d, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM (SELECT label, vec_id AS d, embedding FROM embeddings))
    SELECT label, k::INT AS dim, round(avg(v::DOUBLE), 6) AS mean_pool, round(max(v)::DOUBLE, 6) AS max_pool FROM e GROUP BY 1, 2""")
def pooled_embeddings(spark, sf_dir):
    """Mean and maximum of each dimension."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return rounded(e.groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("mean_pool"), F.max("v").cast("double").alias("max_pool")))


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {r('avg(l_quantity)')} AS mean, {r('stddev_samp(l_quantity)')} AS sd, {r('quantile_cont(l_extendedprice, 0.025)')} AS low, {r('quantile_cont(l_extendedprice, 0.5)')} AS median,
    {r('quantile_cont(l_extendedprice, 0.975)')} AS high, {r('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem GROUP BY 1, 2""")
def repeated_metric_summary(spark, sf_dir):
    """Mean, sample deviation, exact quantiles and correlation of a group."""
    q = lambda p: F.percentile("l_extendedprice", F.lit(p))
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"), q(0.025).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"), F.corr("l_quantity", "l_extendedprice").alias("r")))


@query(f"""WITH {SCORED}, u AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labelled, (SELECT count(*) FROM d WHERE label = 1) AS positive, (SELECT count(DISTINCT text) FROM documents) AS distinct_texts)
    SELECT * FROM (UNPIVOT (SELECT documents::VARCHAR AS documents, labelled::VARCHAR AS labelled, positive::VARCHAR AS positive, distinct_texts::VARCHAR AS distinct_texts FROM u) ON documents, labelled, positive, distinct_texts INTO NAME item VALUE value)""")
def audit_items(spark, sf_dir):
    """Item and value report."""
    d = scored(spark, sf_dir)
    t = table(spark, sf_dir, "documents").agg(F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"))  # one row
    return audit.items(d.agg(F.count("*").alias("documents"), F.count("label").alias("labelled"), F.count_if(F.col("label") == 1).alias("positive")).join(F.broadcast(t)))


@query(f"""SELECT l_returnflag, l_linestatus, unnest([0.025, 0.5, 0.975])::DOUBLE AS share, {r('unnest([quantile_cont(l_extendedprice, 0.025), quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.975)])')} AS quantile FROM lineitem GROUP BY 1, 2
    UNION ALL SELECT NULL, NULL, 0.9, {r('quantile_cont(length(text), 0.9)')} FROM documents""")
def group_quantiles(spark, sf_dir):
    """Exact quantiles of groups, and of one group of all documents, by narrowing ranges."""
    q = quantiles.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.025, 0.5, 0.975], few=500)
    one = quantiles.quantiles(table(spark, sf_dir, "documents").select(F.length("text").alias("n")), [], "n", [0.9], few=100)
    return rounded(q.unionByName(one, allowMissingColumns=True))


@query(f"WITH {SCORED} SELECT cutoff, row_idx, score FROM d, (SELECT unnest([0.4, 0.5, 0.6])::DOUBLE AS cutoff) WHERE score < cutoff")
def retained_by_cutoff(spark, sf_dir):
    """rows whose value lies strictly below each cutoff."""
    d = scored(spark, sf_dir).select("row_idx", "score")
    return d.select(F.explode(F.array(F.lit(0.4), F.lit(0.5), F.lit(0.6))).alias("cutoff"), "row_idx", "score").where("score < cutoff")


@query(f"WITH {SCORED} SELECT row_idx, lower(trim(' ' || CASE WHEN label = 1 THEN 'Yes' WHEN label = 0 THEN 'TRUE' ELSE 'no' END || ' ')) IN ('true', '1', 'yes') AS flag, coalesce(lang, '') || '_x' AS suffixed FROM d")
def parsed_flags(spark, sf_dir):
    """Truth from text, value maps and suffixes."""
    t = F.concat(F.lit(" "), F.when(F.col("label") == 1, "Yes").when(F.col("label") == 0, "TRUE").otherwise("no"), F.lit(" "))
    return scored(spark, sf_dir).select("row_idx", tables.true_text(t).alias("flag"), F.concat(F.coalesce("lang", F.lit("")), F.lit("_x")).alias("suffixed"))


@query(f"""WITH {SCORED}, a AS (SELECT row_idx, [score, rival] AS v FROM d), b AS (SELECT row_idx, [weight] AS v FROM d), n AS (SELECT max(row_idx) + 1 AS n FROM d)
    SELECT row_idx, unnest(list_concat(a.v, b.v)) AS value, unnest(range(3))::INT AS dim FROM a JOIN b USING (row_idx) UNION ALL SELECT row_idx + n, unnest(a.v), unnest(range(2))::INT FROM a, n""")
def stacked_matrices(spark, sf_dir):
    """Matrices joined column-wise by row, and stacked with shifted rows."""
    d = scored(spark, sf_dir)
    a, b = d.select("row_idx", F.array("score", "rival").alias("v")), d.select("row_idx", F.array("weight").alias("w"))
    n = d.agg((F.max("row_idx") + 1).alias("n"))  # one row
    wide = a.join(b, "row_idx").select("row_idx", F.concat("v", "w").alias("v"))
    below = a.join(F.broadcast(n)).select((F.col("row_idx") + F.col("n")).alias("row_idx"), "v")
    return wide.unionByName(below).select("row_idx", F.posexplode("v").alias("dim", "value"))


@query(f"""WITH {SCORED}, g AS (SELECT source, {r('avg(score) FILTER (split = 3)')} AS s3, {r('avg(score) FILTER (split = 0)')} AS s0, {r('avg(score) FILTER (split = 1)')} AS s1 FROM d GROUP BY source)
    SELECT source, s3, s0, s1, (CASE source WHEN 'src2' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END)::INT AS place FROM g""")
def pivoted_protocols(spark, sf_dir):
    """Mean by model and protocol as a pivot with given columns, and rows' places in a given order."""
    p = scored(spark, sf_dir).groupBy("source").pivot("split", [3, 0, 1]).agg(F.avg("score"))
    place = F.coalesce(F.nullif(F.array_position(F.array(F.lit("src2"), F.lit("src0")), F.col("source")), F.lit(0)) - 1, F.lit(2)).cast("int")
    return rounded(p.select("source", F.col("3").alias("s3"), F.col("0").alias("s0"), F.col("1").alias("s1"), place.alias("place")))


@query("""WITH t AS (SELECT doc_id, md5(text) AS k, quality::INT AS label, n_chars FROM documents LEFT JOIN labels USING (doc_id))
    SELECT k, arg_min(coalesce(label, -1), doc_id) AS first_label, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(doc_id), 6) AS sd FROM t GROUP BY k""")
def repeated_rows(spark, sf_dir):
    """Of rows that share an original, the first one's label, count, mean and sample deviation."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"), "n_chars")
    l = table(spark, sf_dir, "labels").select("doc_id", F.coalesce(F.col("quality").cast("int"), F.lit(-1)).alias("label"))
    j = t.join(l, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    return rounded(j.groupBy("k").agg(F.min_by("label", "doc_id").alias("first_label"), F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.stddev_samp("doc_id").alias("sd")))


# Metrics and calibration


def _metric_sql(score: str = "score", keys: str = "split", weight: str = "1.0", source: str = "d") -> str:
    return f"""x AS (SELECT {keys}, label AS y, {score} AS p, {weight} AS w FROM {source} WHERE label IN (0, 1) AND {score} IS NOT NULL),
    s AS (SELECT {keys}, p, sum(w * y) AS wp, sum(w * (1 - y)) AS wn, sum(w * w) AS ww, count(*) AS n, sum(y) AS np, sum(w * pow(greatest(least(p, 1 - 1e-6), 1e-6) - y, 2)) AS se,
        sum(-w * ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 1e-6), 1e-6) ELSE 1 - greatest(least(p, 1 - 1e-6), 1e-6) END)) AS ll FROM x GROUP BY {keys}, p),
    c AS (SELECT *, sum(wp) OVER (PARTITION BY {keys} ORDER BY p DESC) AS cp, sum(wn) OVER (PARTITION BY {keys} ORDER BY p DESC) AS cn FROM s),
    g AS (SELECT {keys}, sum(n)::BIGINT AS n, sum(np)::BIGINT AS positives, sum(wp) AS P_, sum(wn) AS N_, sum(wn * (cp - wp / 2)) AS area, sum(wp * cp / (cp + cn)) AS prec, coalesce(sum(wp) FILTER (p >= 0.5), 0) AS tp, coalesce(sum(wn) FILTER (p >= 0.5), 0) AS fp, sum(ww) AS ww, sum(se) AS se, sum(ll) AS ll FROM c GROUP BY {keys}),
    m AS (SELECT *, P_ - tp AS fn, N_ - fp AS tn FROM g)"""


def _metric_out(keys: str = "split") -> str:
    return f"""SELECT {keys}, n, positives, n - positives AS negatives, {r('pow(P_ + N_, 2) / ww')} AS effective_n, {r('area / nullif(P_ * N_, 0)')} AS auc, {r('prec / nullif(P_, 0)')} AS average_precision,
    {r('(tp + tn) / (P_ + N_)')} AS accuracy, {r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS "precision", {r('coalesce(tp / nullif(P_, 0), 0)')} AS recall, {r('tn / nullif(N_, 0)')} AS specificity, {r('(coalesce(tp / nullif(P_, 0), 0) + tn / nullif(N_, 0)) / 2')} AS balanced_accuracy, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1,
    {r('coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)')} AS mcc, {r('se / (P_ + N_)')} AS brier, {r('ll / (P_ + N_)')} AS log_loss, {r('tp')} AS tp, {r('fp')} AS fp, {r('tn')} AS tn, {r('fn')} AS fn FROM m"""


@query(f"WITH {SCORED}, {_metric_sql()} {_metric_out()}")
def metrics_by_split(spark, sf_dir):
    """Every metric of a score."""
    return rounded(metrics.metrics(scored(spark, sf_dir), ["split"]))


@query(f"WITH {SCORED}, {_metric_sql(weight='weight')} {_metric_out()}")
def weighted_metrics(spark, sf_dir):
    """Weighted metrics and effective size."""
    return rounded(metrics.metrics(scored(spark, sf_dir), ["split"], weight="weight"))


@query(f"""WITH {SCORED}, x AS (SELECT split, label, (rank() OVER (PARTITION BY split ORDER BY score)) + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS k FROM d WHERE label IS NOT NULL)
    SELECT split, {r('(sum(k) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * sum(1 - label), 0)')} AS auc FROM x GROUP BY split""")
def rank_auc(spark, sf_dir):
    """AUC from average ranks."""
    return rounded(metrics.auc_by_rank(scored(spark, sf_dir), ["split"]))


_EDGES = ", ".join(map(repr, metrics.width_edges(10)))
_BINS = f"""wb AS (SELECT split, 'width' AS scheme, len(list_filter([{_EDGES}], lambda e: e <= score AND e < 1.0)) - 1 AS bin, score, label FROM d WHERE label IS NOT NULL),
    fb AS (SELECT split, 'frequency' AS scheme, ntile(10) OVER (PARTITION BY split ORDER BY score, row_idx) - 1 AS bin, score, label FROM d WHERE label IS NOT NULL),
    ob AS (SELECT split, scheme, bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS observed_rate FROM (SELECT * FROM wb UNION ALL SELECT * FROM fb) GROUP BY ALL),
    eb AS (SELECT split, 'width' AS scheme, unnest(range(10)) AS bin FROM (SELECT DISTINCT split FROM d WHERE label IS NOT NULL)),
    tb AS (SELECT coalesce(ob.split, eb.split) AS split, coalesce(ob.scheme, eb.scheme) AS scheme, coalesce(ob.bin, eb.bin) AS bin, coalesce(n, 0) AS n, mean_score, observed_rate, abs(mean_score - observed_rate) AS gap FROM ob FULL JOIN eb ON ob.split = eb.split AND ob.scheme = eb.scheme AND ob.bin = eb.bin)"""


@query(f"WITH {SCORED}, {_BINS} SELECT split, scheme, bin::INT AS bin, n, {r('mean_score')} AS mean_score, {r('observed_rate')} AS observed_rate, {r('gap')} AS gap FROM tb")
def calibration_bins(spark, sf_dir):
    """Bin tables of both schemes."""
    return rounded(metrics.bin_table(scored(spark, sf_dir), ["split"]))


@query(f"WITH {SCORED}, {_BINS} SELECT split, scheme, {r('sum(n * coalesce(gap, 0)) / sum(n)')} AS ece FROM tb GROUP BY ALL")
def calibration_error(spark, sf_dir):
    """Y8, Y9."""
    return rounded(metrics.ece(metrics.bin_table(scored(spark, sf_dir), ["split"]), ["split"]))


@query(f"WITH {SCORED} SELECT row_idx, {r('ln(greatest(least(score, 1 - 1e-6), 1e-6) / (1 - greatest(least(score, 1 - 1e-6), 1e-6)))')} AS z, {r('1 / (1 + exp(-(0.1 + 0.7 * ln(greatest(least(score, 1 - 1e-6), 1e-6) / (1 - greatest(least(score, 1 - 1e-6), 1e-6))) + 0.4 * ln(greatest(least(rival, 1 - 1e-6), 1e-6) / (1 - greatest(least(rival, 1 - 1e-6), 1e-6))))))')} AS fused, {r('2 * abs(score - 0.5)')} AS confidence, (score >= 0.5)::INT AS prediction FROM d")
def fused_scores(spark, sf_dir):
    """Logits, frozen fusion, confidence and prediction."""
    z = lambda c: X.logit(F.col(c))
    return rounded(scored(spark, sf_dir).select("row_idx", z("score").alias("z"), X.sigmoid(0.1 + 0.7 * z("score") + 0.4 * z("rival")).alias("fused"), (2 * F.abs(F.col("score") - 0.5)).alias("confidence"), (F.col("score") >= 0.5).cast("int").alias("prediction")))


# Balance and resampling


@query(f"""WITH {SCORED}, f AS (SELECT label, unnest([1.0, weight]) AS w, unnest(['plain', 'weighted']) AS scheme, length, score FROM d WHERE label IS NOT NULL),
    l AS (SELECT scheme, label, w, 'length' AS feature, length::DOUBLE AS x FROM f UNION ALL SELECT scheme, label, w, 'score', score FROM f),
    g AS (SELECT scheme, feature, label, sum(w * x) / sum(w) AS mean, greatest(sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2), 0) AS var FROM l GROUP BY ALL)
    SELECT scheme, feature, {r('max(mean) FILTER (label = 1)')} AS positive_mean, {r('max(mean) FILTER (label = 0)')} AS negative_mean, {r('coalesce((max(mean) FILTER (label = 1) - max(mean) FILTER (label = 0)) / nullif(sqrt((max(var) FILTER (label = 1) + max(var) FILTER (label = 0)) / 2), 0), 0)')} AS smd FROM g GROUP BY ALL""")
def balance_table(spark, sf_dir):
    """Standardised mean differences under two weightings."""
    return rounded(audit.balance(scored(spark, sf_dir), ["length", "score"], {"plain": F.lit(1.0), "weighted": F.col("weight")}))


_REPLICATES = 20
_BOOT = f"""n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_idx) - 1 AS k, count(*) OVER (PARTITION BY label) AS m FROM d WHERE label IS NOT NULL),
    dr AS (SELECT rep AS replicate, label, floor(('0x' || substr(md5('7|' || rep || '|' || label || '|' || k), 1, 8))::BIGINT / 4294967296.0 * m)::BIGINT AS k FROM n, range({_REPLICATES}) t(rep)),
    b AS (SELECT replicate, n.* FROM dr JOIN n ON dr.label = n.label AND dr.k = n.k)"""


@query(f"""WITH {SCORED}, {_BOOT}, bl AS (SELECT replicate, label, unnest(['score', 'rival']) AS model, unnest([score, rival]) AS v FROM b), {_metric_sql('v', 'model, replicate', source='bl')},
    o AS (SELECT model, unnest(['auc', 'average_precision', 'brier']) AS metric, unnest([area / nullif(P_ * N_, 0), prec / nullif(P_, 0), se / (P_ + N_)]) AS v FROM m)
    SELECT model, metric, {r('quantile_cont(v, 0.025)')} AS low, {r('quantile_cont(v, 0.5)')} AS median, {r('quantile_cont(v, 0.975)')} AS high FROM o GROUP BY ALL""")
def bootstrap_intervals(spark, sf_dir):
    """Intervals of two models' metrics over common class-stratified draws."""
    return rounded(resample.bootstrap_intervals(scored(spark, sf_dir).where("label IS NOT NULL"), ["score", "rival"], _REPLICATES, 7))


@query(f"""WITH {SCORED}, {_BOOT}, bl AS (SELECT replicate, label, unnest(['a', 'b']) AS model, unnest([score, rival]) AS v FROM b), {_metric_sql('v', 'model, replicate', source='bl')},
    o AS (SELECT model, replicate, unnest(['auc', 'brier']) AS metric, unnest([area / nullif(P_ * N_, 0), se / (P_ + N_)]) AS v FROM m),
    q AS (SELECT metric, replicate, max(v) FILTER (model = 'a') - max(v) FILTER (model = 'b') AS v FROM o GROUP BY ALL)
    SELECT metric, {r('quantile_cont(v, 0.025)')} AS low, {r('quantile_cont(v, 0.5)')} AS median, {r('quantile_cont(v, 0.975)')} AS high FROM q GROUP BY ALL""")
def paired_deltas(spark, sf_dir):
    """Intervals of the difference of two models on the same draws."""
    return rounded(resample.paired_deltas(scored(spark, sf_dir).where("label IS NOT NULL"), "score", "rival", _REPLICATES, 7))


@query(f"""WITH {SCORED}, c AS (SELECT length, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS take FROM d WHERE label IS NOT NULL GROUP BY length),
    x AS (SELECT rep AS replicate, d.*, take, row_number() OVER (PARTITION BY rep, length, label ORDER BY ('0x' || substr(md5('11|' || rep || '|' || row_idx), 1, 8))::BIGINT, row_idx) AS k FROM d JOIN c USING (length), range(5) t(rep) WHERE label IS NOT NULL AND take > 0)
    SELECT replicate::INT AS replicate, row_idx, label, length::INT AS length FROM x WHERE k <= take""")
def length_matched(spark, sf_dir):
    """Rows of exactly matched lengths, drawn without replacement in each replicate."""
    d = scored(spark, sf_dir).where("label IS NOT NULL")
    return resample.matched(d, "length", 5, 11).select("replicate", "row_idx", "label", "length")


@query(f"""WITH {SCORED} SELECT length::INT AS length, count(*) FILTER (label = 0) AS available_negative, count(*) FILTER (label = 1) AS available_positive, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS selected_per_class,
    least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) > 0 AS shared FROM d WHERE label IS NOT NULL GROUP BY 1""")
def length_match_counts(spark, sf_dir):
    """Rows available and selected of each length."""
    return resample.match_counts(scored(spark, sf_dir).where("label IS NOT NULL"), "length")


def _bench_sequences(spark, sf_dir):
    w = words(spark, sf_dir, "benchmark", "item_id").where("sequence != ''")
    return w.groupBy("sequence").agg(F.min(F.col("item_id") * (1 << 32) + F.col("pos")).alias("row_idx"))


def _sequences(spark, sf_dir):
    """(sequence, row_idx): every sequence of the documents with its first place."""
    w = raw_words(spark, sf_dir).groupBy("word").agg(F.min(F.col("doc_id") * (1 << 32) + F.col("pos")).alias("row_idx"))
    return w.select(X.residues_of(F.col("word")).alias("sequence"), "row_idx").where("sequence != ''").groupBy("sequence").agg(F.min("row_idx").alias("row_idx"))


_SHUFFLE = f"""{words_sql()}, q AS (SELECT sequence, min(doc_id * 4294967296 + pos) AS row_idx FROM w WHERE sequence <> '' GROUP BY 1), z AS (SELECT row_idx, sequence, rep, list_transform(list_sort(list_transform(range(len(sequence)), lambda i: md5('5|' || row_idx || '|' || rep || '|' || i) || sequence[i + 1])), lambda x: x[33]) AS a FROM q, range(4) t(rep)),
    y AS (SELECT row_idx, rep::INT AS replicate, sequence, array_to_string(a, '') AS shuffled, len(list_filter(range(len(sequence)), lambda i: sequence[i + 1] <> a[i + 1])) AS distance FROM z)"""


@query(f"WITH {_SHUFFLE} SELECT row_idx, replicate, sequence, shuffled, distance::INT AS distance, row_number() OVER (PARTITION BY row_idx, shuffled ORDER BY replicate) > 1 AS repeated FROM y")
def shuffle_ledger(spark, sf_dir):
    """Orders of each sequence's own characters."""
    return resample.shuffles(_sequences(spark, sf_dir), 4, 5).select("row_idx", "replicate", "sequence", "shuffled", "distance", "repeated")


@query(f"WITH {_SHUFFLE}, l AS (SELECT *, row_number() OVER (PARTITION BY row_idx, shuffled ORDER BY replicate) > 1 AS repeated FROM y) SELECT count(*) AS draws, count(*) FILTER (sequence = shuffled) AS unchanged, count(*) FILTER (repeated) AS repeats, {r('avg(distance)')} AS mean_distance, {r('quantile_cont(distance, 0.5)')} AS median_distance, {r('quantile_cont(distance, 0.025)')} AS low, {r('quantile_cont(distance, 0.975)')} AS high FROM l")
def shuffle_geometry(spark, sf_dir):
    """A16."""
    return rounded(resample.shuffle_summary(resample.shuffles(_sequences(spark, sf_dir), 4, 5)))


@query()
def unique_shuffles(spark, sf_dir):
    """Distinct orders other than the sequence."""
    return resample.unique_shuffles(_sequences(spark, sf_dir), 10, 3)


@query(f"""WITH {words_sql()}, s AS (SELECT sequence, min(doc_id * 4294967296 + pos) AS row_idx, any_value(length(sequence))::INT AS n FROM w WHERE sequence <> '' GROUP BY 1)
    SELECT row_idx, least(10, CASE WHEN n <= 20 THEN (factorial(least(n, 20)) // {" // ".join(f"factorial(least({c}, 20)::INT)" for c in _COUNTS)} - 1)::BIGINT WHEN replace(sequence, sequence[1], '') = '' THEN 0 ELSE 10 END) AS shuffles,
    least(10, CASE WHEN n <= 20 THEN (factorial(least(n, 20)) // {" // ".join(f"factorial(least({c}, 20)::INT)" for c in _COUNTS)} - 1)::BIGINT WHEN replace(sequence, sequence[1], '') = '' THEN 0 ELSE 10 END) AS kinds, 0::BIGINT AS unchanged, 0::BIGINT AS strangers FROM s""")
def unique_shuffle_counts(spark, sf_dir):
    """Of every sequence the orders drawn, the distinct ones, those equal to it and those of other residues."""
    s = grouping._written(_sequences(spark, sf_dir), "sequences")
    u = resample.unique_shuffles(s, 10, 3).withColumnRenamed("row_idx", "r")
    j = s.join(u, F.col("row_idx") == F.col("r"), "left")
    residues = lambda c: F.array_sort(F.split(c, ""))
    return j.groupBy("row_idx").agg(F.count("shuffled").alias("shuffles"), F.countDistinct("shuffled").alias("kinds"), F.count_if(F.col("shuffled") == F.col("sequence")).alias("unchanged"), F.count_if(residues("shuffled") != residues("sequence")).alias("strangers"))


@query(f"""WITH {SCORED} SELECT row_idx, label, CASE WHEN percent_rank() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('13|' || row_idx), 1, 8))::BIGINT, row_idx) < 0.9 THEN 'train' ELSE 'test' END AS part FROM d WHERE label IS NOT NULL""")
def stratified_split(spark, sf_dir):
    """R12."""
    return resample.split(scored(spark, sf_dir).where("label IS NOT NULL"), 0.9, 13).select("row_idx", "label", "part")


# Similarity, groups, folds


@query()
def similar_pairs(spark, sf_dir):
    """Pairs of the benchmark's words with an insertion-deletion ratio of 60 or more."""
    return rounded(similarity.ratio_join(_bench_sequences(spark, sf_dir)))


@query()
def aligned_pairs(spark, sf_dir):
    """Pairs of the benchmark's words that align with identity .6 and coverage .8."""
    return rounded(similarity.alignment_join(_bench_sequences(spark, sf_dir)))


@query()
def similarity_groups(spark, sf_dir):
    """Greedy leaders and connected components of similar words."""
    n = grouping._written(_bench_sequences(spark, sf_dir).withColumn("length", F.length("sequence")), "nodes")
    e = grouping._written(similarity.ratio_join(n, cutoff=75.0), "edges")
    return grouping.components(n, e).join(grouping.leader_groups(n, e), "row_idx")


@query()
def fold_audit(spark, sf_dir):
    """Stratified folds that keep every source together, and their audit."""
    d = scored(spark, sf_dir).where("label IS NOT NULL")
    return grouping.fold_audit(grouping.group_folds(d, 5, 70877, group="source"), group="source")


# Models


@query(f"""WITH RECURSIVE {SCORED}, l AS (SELECT row_idx, split::INT AS fold, label, coalesce(length, 0)::DOUBLE AS x FROM d WHERE label IS NOT NULL),
    k AS (SELECT unnest(range(5))::INT AS f), st AS (SELECT f, avg(x) AS m, stddev_pop(x) AS s FROM k JOIN l ON fold <> f GROUP BY f),
    tr AS MATERIALIZED (SELECT f, (x - m) / s AS z, count(*) AS n, sum(label)::DOUBLE AS y FROM st JOIN l ON fold <> f GROUP BY ALL),
    it AS (SELECT 0 AS i, f, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b, 1.0::DOUBLE AS moved FROM k UNION ALL
        SELECT i + 1, f, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb), greatest(abs((hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb)), abs((hww * gb - hwb * gw) / (hww * hbb - hwb * hwb))) FROM (
            SELECT i, f, w, b, sum((n * p - y) * z) + w AS gw, sum(n * p - y) + b AS gb, sum(n * p * (1 - p) * z * z) + 1 AS hww, sum(n * p * (1 - p) * z) AS hwb, sum(n * p * (1 - p)) + 1 AS hbb FROM (
                SELECT i, it.f, w, b, z, n, y, 1 / (1 + exp(-(b + w * z))) AS p FROM it JOIN tr ON tr.f = it.f WHERE i < 60 AND moved > 1e-11) GROUP BY i, f, w, b)),
    fin AS (SELECT f, arg_max(w, i) AS w, arg_max(b, i) AS b FROM it GROUP BY f)
    SELECT row_idx, fold, label, {r('1 / (1 + exp(-(b + w * (x - m) / s)))')} AS probability FROM l JOIN st ON st.f = fold JOIN fin ON fin.f = fold""")
def length_cross_fit(spark, sf_dir):
    """M2, M9: out-of-fold probabilities of a penalised logistic model of length, all folds in one go."""
    rows = scored(spark, sf_dir).where("label IS NOT NULL").select("row_idx", F.col("split").cast("int").alias("fold"), "label", F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length"))
    own, _ = crossfit.cross_fits(rows, {"length": ["length"]}, 5)
    return rounded(own.select("row_idx", "fold", "label", F.col("p_length").alias("probability")))


@query()
def cross_fitted_scores(spark, sf_dir):
    """M2, M9: out-of-fold probabilities of a penalised logistic model of length and composition."""
    return models.document_oof(spark, sf_dir)


@query()
def external_scores(spark, sf_dir):
    """A model learnt in splits 1 to 4 and applied to split 0: branches and fusions, out of fold and on the test set."""
    rows, names = models._documents(spark, sf_dir)
    rows = grouping._written(rows.withColumn("fold", F.col("fold") - 1), "external")
    fits = {"length": names[:1], "composition": names[1:], "both": names}
    own, test = crossfit.external(rows.where("fold >= 0"), rows.where("fold < 0"), fits, ("length", "composition"), 4)
    columns = [f"p_{m}" for m in fits] + ["p_mean", "p_logit"]
    long = lambda df, which, c: df.select("row_idx", "label", F.lit(which).alias("evaluation"), F.expr(f"stack({len(c)}, {', '.join(f'"{x[2:]}", {x}' for x in c)}) AS (model, score)"))
    every = grouping._written(long(own, "out_of_fold", columns).unionByName(long(test, "test", [*columns, "p_stack"])), "scores")
    out = metrics.metrics(every, ["evaluation", "model"])
    return out.select("evaluation", "model", "n", "positives", *(F.round(c, 4).alias(c) for c in ("auc", "average_precision", "brier", "log_loss", "mcc")))


@query()
def overlap_balance(spark, sf_dir):
    """M8, Q2: overlap weights from a propensity model, and the balance that they give."""
    return models.document_overlap(spark, sf_dir)


from . import suites as _suites  # noqa: E402, F401  # adds its queries
