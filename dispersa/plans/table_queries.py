"""Queries on sequences, intervals, partitions and windows, bound to documents, line items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispersa.functions import stats
from dispersa.operators import qc, sequences, states
from dispersa.plans.registry import register, rounded
from dispersa.session import read_table
from dispersa.sources.matrices import table_fingerprint

#: Letters of texts as bases, by one translation.
LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"
#: A short matrix of scores, in place of a motif.
MOTIF = [{"A": 0.5, "C": -1.0, "G": -1.5, "T": 1.0}, {"A": 1.25, "C": -0.5, "G": -2.0, "T": 0.25}, {"A": -1.0, "C": 0.75, "G": 0.5, "T": -0.25}]


def bases(spark: SparkSession, sf: str) -> DataFrame:
    only = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return read_table(spark, sf, "documents").select("doc_id", F.translate(only, LETTERS, BASES).alias("seq"))


BASES_SQL = f"WITH s AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents)"


@register("s6_unknown_bases", "SELECT CAST(doc_id AS VARCHAR) AS seqid, md5(regexp_replace(upper(text), '[^ACGTN]', 'N', 'g')) AS seq, length(upper(text)) - length(regexp_replace(upper(text), '[^ACGTN]', '', 'g')) AS replaced FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM documents)")
def unknown(spark, sf):
    plain = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("seqid"), F.regexp_replace("text", "[^ -~]", "").alias("seq"))
    return sequences.unknown_bases(plain).select("seqid", F.md5("seq").alias("seq"), F.col("replaced").cast("long").alias("replaced"))


@register("p1_reverse_complement", f"{BASES_SQL} SELECT doc_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS rc FROM s")
def reverse(spark, sf):
    return bases(spark, sf).select("doc_id", F.md5(sequences.reverse_complement(F.col("seq"))).alias("rc"))


_SCORE = " + ".join("CASE substr(seq, CAST(p + {} AS INT), 1) {} END".format(i, " ".join(f"WHEN '{b}' THEN {v}" for b, v in row.items())) for i, row in enumerate(MOTIF))


@register("p2_motif_scores", f"""{BASES_SQL}, p AS (SELECT doc_id, seq, unnest(range(50, least(200, length(seq) - 2) + 1)) AS p FROM s), q AS (SELECT doc_id, p, {_SCORE} AS score FROM p),
b AS (SELECT doc_id, score, p AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p) AS r FROM q) SELECT s.doc_id, b.score, b.pos FROM s LEFT JOIN b ON s.doc_id = b.doc_id AND r = 1""")
def motifs(spark, sf):
    return sequences.motif_scores(bases(spark, sf), "doc_id", MOTIF, 50, 200).select("doc_id", "score", F.col("pos").cast("long").alias("pos"))


@register("p3_longest_run", f"""{BASES_SQL}, r AS (SELECT doc_id, seq, regexp_extract_all(seq, '(A+|T+)') AS runs FROM s), m AS (SELECT *, coalesce(list_max([length(x) for x in runs]), 0) AS run FROM r)
SELECT doc_id, run, CASE WHEN run > 0 THEN instr(seq, list_filter(runs, lambda x: length(x) = run)[1]) END AS place FROM m""")
def runs(spark, sf):
    return sequences.longest_run(bases(spark, sf), "doc_id").select("doc_id", F.col("run").cast("long").alias("run"), F.col("place").cast("long").alias("place"))


@register("p4_score_table", f"""{BASES_SQL}, p AS (SELECT doc_id, seq, unnest(range(50, least(200, length(seq) - 2) + 1)) AS p FROM s), q AS (SELECT doc_id, p, {_SCORE} AS score FROM p),
b AS (SELECT doc_id, score, p AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p) AS r FROM q), k AS (SELECT doc_id, seq, regexp_extract_all(seq, '(A+|T+)') AS runs FROM s),
m AS (SELECT *, coalesce(list_max([length(x) for x in runs]), 0) AS run FROM k), o AS (SELECT doc_id, run, CASE WHEN run > 0 THEN instr(seq, list_filter(runs, lambda x: length(x) = run)[1]) END AS place FROM m)
SELECT s.doc_id, length(seq) AS prom_len, length(seq) < 50 AS prom_extended, score AS tata_score, length(seq) - pos + 1 AS tata_pos, CASE WHEN pos IS NOT NULL THEN substr(seq, CAST(pos AS INT), 3) END AS tata_motif,
  run AS polyat_len, length(seq) - place + 1 AS polyat_pos, CASE WHEN place IS NOT NULL THEN substr(seq, CAST(place AS INT), CAST(run AS INT)) END AS polyat_tract
FROM s LEFT JOIN b ON s.doc_id = b.doc_id AND r = 1 JOIN o ON s.doc_id = o.doc_id""")
def scores(spark, sf):
    s = bases(spark, sf)
    motif = sequences.motif_scores(s, "doc_id", MOTIF, 50, 200).withColumn("width", F.lit(len(MOTIF)))
    got = sequences.score_table(s.withColumn("extended", F.length("seq") < 50), "doc_id", motif, sequences.longest_run(s, "doc_id"))
    return got.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in got.dtypes])


@register("p6_tiles", f"{BASES_SQL}, t AS (SELECT doc_id, seq, unnest(range(1, length(seq) + 1, 500)) AS core_start FROM s WHERE length(seq) > 0) SELECT CAST(doc_id AS VARCHAR) AS seqid, (core_start - 1) // 500 AS tile, core_start, md5(substr(seq, greatest(1, core_start - 70), core_start + 570 - greatest(1, core_start - 70))) AS piece FROM t")
def tiled(spark, sf):
    s = bases(spark, sf).where(F.length("seq") > 0).select(F.col("doc_id").cast("string").alias("seqid"), "seq")
    return sequences.tiles(s, 500, 70).select("seqid", F.col("tile").cast("long").alias("tile"), F.col("core_start").cast("long").alias("core_start"), F.md5("piece").alias("piece"))


_GENES = "WITH g AS (SELECT l_orderkey * 10 + l_linenumber AS gene, l_suppkey AS seqid, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS start_, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + l_quantity AS BIGINT) AS end_, CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS strand FROM lineitem)"


def genes(spark, sf):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gene"), F.col("l_suppkey").alias("seqid"), day.cast("long").alias("start"),
        (day + F.col("l_quantity")).cast("long").alias("end"), F.when(F.col("l_returnflag") == "A", "+").otherwise("-").alias("strand"),
    )


_BOUNDS = f"""{_GENES}, b AS (SELECT *, max(end_) OVER (PARTITION BY seqid ORDER BY start_ RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(start_) OVER (PARTITION BY seqid ORDER BY end_ RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM g)"""


@register("w1_nearest_bounds", f"{_BOUNDS} SELECT gene, seqid, start_ AS start, end_ AS \"end\", strand, before, after FROM b")
def bounds(spark, sf):
    return sequences.nearest_bounds(genes(spark, sf))


@register("p1_promoters", f"""{_BOUNDS}, r AS (SELECT *, CASE WHEN strand = '+' THEN start_ - 1 - coalesce(before, 0) ELSE coalesce(after - 1, 1099511627776) - end_ END AS room FROM b), s AS (SELECT *, greatest(least(room, 300), 50) AS size FROM r)
SELECT gene, seqid, strand, CASE WHEN strand = '+' THEN greatest(1, start_ - size) ELSE end_ + 1 END AS p_start, CASE WHEN strand = '+' THEN start_ - 1 ELSE end_ + size END AS p_end, room < 50 AS extended FROM s""")
def promoters(spark, sf):
    return sequences.promoter_intervals(genes(spark, sf))


@register("l6_adjusted_rand", """WITH x AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS c FROM orders GROUP BY ALL), t AS (SELECT sum(c) AS n, sum(c * (c - 1) / 2) AS x FROM x), ra AS (SELECT sum(c * (c - 1) / 2) AS ra FROM (SELECT sum(c) AS c FROM x GROUP BY a)), rb AS (SELECT sum(c * (c - 1) / 2) AS rb FROM (SELECT sum(c) AS c FROM x GROUP BY b))
SELECT CAST(n AS BIGINT) AS n, round((x - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 6) AS ari FROM t, ra, rb""")
def rand(spark, sf):
    return rounded(states.adjusted_rand(read_table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


_RANKED = "WITH g AS (SELECT p_type AS k, p_size AS rank, count(*) AS v FROM part GROUP BY ALL)"


def _ranked(spark, sf):
    return read_table(spark, sf, "part").groupBy(F.col("p_type").alias("k"), F.col("p_size").alias("rank")).agg(F.count("*").alias("v"))


@register("w2_last_drop", f"{_RANKED}, d AS (SELECT *, v - lead(v) OVER (PARTITION BY k ORDER BY rank) AS d FROM g) SELECT k, max(CASE WHEN d > 2 THEN rank END) + 1 AS elbow FROM d GROUP BY k")
def drops(spark, sf):
    return states.last_drop(_ranked(spark, sf), ["k"], "v", 2)


@register("w3_plateaus", f"{_RANKED}, b AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY k ORDER BY rank) <> v THEN 1 ELSE 0 END AS n FROM g) SELECT k, rank, v, CAST(sum(n) OVER (PARTITION BY k ORDER BY rank) AS BIGINT) AS run FROM b")
def flats(spark, sf):
    return states.plateaus(_ranked(spark, sf), ["k"], "rank", "v")


@register("w4_equal_bins", "SELECT c_custkey, CAST(ceil(row_number() OVER (ORDER BY c_acctbal, c_custkey) / count(*) OVER () * 7) AS BIGINT) AS bin FROM customer")
def bins(spark, sf):
    return states.equal_bins(read_table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 7, "c_custkey").select("c_custkey", "bin")


@register("i0_name_hash", """WITH n AS (SELECT DISTINCT p_brand AS name FROM part) SELECT name, list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(ascii(c) AS BIGINT) for c in string_split(name, '')]), lambda h, c: (131 * h + c) % 2147483647) AS h FROM n""")
def hashed(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct().withColumn("h", stats.name_hash("name"))


@register("i25_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS m FROM lineitem GROUP BY l_returnflag")
def wmean(spark, sf):
    return rounded(read_table(spark, sf, "lineitem").groupBy("l_returnflag").agg(stats.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("m")))


@register("q18_normalise_ids", """WITH al AS (SELECT p_brand AS alias, p_partkey AS ord, concat('X.', p_size) AS feature FROM part), f AS (SELECT alias, min_by(feature, ord) AS f FROM al GROUP BY alias), i AS (SELECT DISTINCT p_type AS id FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT 'none')
SELECT id, CASE WHEN regexp_matches(id, '^[A-Z]+$') THEN id ELSE replace(f, '.', '-') END AS feature FROM i LEFT JOIN f ON id = alias""")
def ids(spark, sf):
    part = read_table(spark, sf, "part")
    aliases = part.select(F.col("p_brand").alias("alias"), F.col("p_partkey").alias("ord"), F.concat(F.lit("X."), F.col("p_size")).alias("feature"))
    names = part.select(F.col("p_type").alias("id")).union(part.select("p_brand")).union(spark.sql("SELECT 'none'")).distinct()
    return qc.normalise_ids(names, aliases, "^[A-Z]+$")


@register("s13_fingerprint")
def fingerprint(spark, sf):
    return table_fingerprint(read_table(spark, sf, "part")).withColumn("h", F.col("h").cast("string"))
