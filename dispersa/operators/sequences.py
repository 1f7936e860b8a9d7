"""Intervals along sequences and scores of their windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def nearest_bounds(genes: DataFrame) -> DataFrame:
    """genes (gene, seqid, start, end) with `before`, the greatest end of genes that begin strictly before, and `after`, the least start of genes that end strictly after.

    Both are running extremes over a range frame whose bound leaves the own place out.
    """
    up = Window.partitionBy("seqid").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("seqid").orderBy("end").rangeBetween(1, Window.unboundedFollowing)
    return genes.withColumn("before", F.max("end").over(up)).withColumn("after", F.min("start").over(down))


def promoter_intervals(genes: DataFrame, longest: int = 300, shortest: int = 50) -> DataFrame:
    """(gene, seqid, strand, p_start, p_end, extended): up to `longest` bases upstream, up to the nearest gene, at least `shortest`."""
    g = nearest_bounds(genes)
    plus = F.col("strand") == "+"
    room = F.when(plus, F.col("start") - 1 - F.coalesce("before", F.lit(0))).otherwise(F.coalesce(F.col("after") - 1, F.lit(1 << 40)) - F.col("end"))
    size = F.greatest(F.least(room, F.lit(longest)), F.lit(shortest))
    low = F.when(plus, F.greatest(F.lit(1), F.col("start") - size)).otherwise(F.col("end") + 1)
    high = F.when(plus, F.col("start") - 1).otherwise(F.col("end") + size)
    return g.select("gene", "seqid", "strand", low.alias("p_start"), high.alias("p_end"), (room < shortest).alias("extended"))


def cut_sequences(intervals: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """(gene, seq): the intervals' bases, reverse-complemented on the minus strand."""
    cut = F.expr("substring(seq, CAST(p_start AS INT), CAST(p_end - p_start + 1 AS INT))")
    return intervals.join(chromosomes, "seqid").select("gene", F.when(F.col("strand") == "-", reverse_complement(cut)).otherwise(cut).alias("seq"))


def motif_scores(seqs: DataFrame, key: str, pwm: list[dict[str, float]], first: int, last: int) -> DataFrame:
    """(key, score, pos): best sum of per-position scores of a motif whose start lies in first..last, the most upstream of equals.

    Starts are exploded and scored by map look-ups; places with a base outside the matrix have no score.
    """
    width = len(pwm)
    starts = seqs.select(key, "seq", F.explode(F.sequence(F.lit(first), F.greatest(F.lit(first), F.least(F.lit(last), F.length("seq") - width + 1)))).alias("pos"))
    maps = [F.create_map(*[F.lit(x) for kv in row.items() for x in kv]) for row in pwm]
    score = sum((F.element_at(m, F.substring(F.col("seq"), F.col("pos") + i, F.lit(1))) for i, m in enumerate(maps)), F.lit(0.0))
    scored = starts.where(F.length("seq") >= F.col("pos") + width - 1).withColumn("score", score).where("score IS NOT NULL")
    best = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("b"))
    return seqs.select(key).join(best, key, "left").select(key, F.col("b.score").alias("score"), (-F.col("b.p")).alias("pos"))


def score_table(seqs: DataFrame, key: str, motif: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, prom_len, prom_extended, tata_score, tata_pos, tata_motif, polyat_len, polyat_pos, polyat_tract): scores of upstream sequences by their distances.

    seqs (key, seq, extended) end next to the gene; motif (key, score, pos, width) and runs (key, run, place) count places from the far
    end, the table counts from the gene: the last base is at 1. A sequence without a score or a run keeps its row with nulls there,
    an unstated `extended` is false.
    """
    size = F.length("seq")
    out = seqs.join(motif.select(key, "score", "pos", "width"), key, "left").join(runs.select(key, "run", "place"), key, "left")
    bases = lambda at, n: F.when(F.col(at).isNotNull(), F.substring(F.col("seq"), F.col(at).cast("int"), F.col(n).cast("int")))
    return out.select(
        key, size.alias("prom_len"), F.coalesce("extended", F.lit(False)).alias("prom_extended"), F.col("score").alias("tata_score"), (size - F.col("pos") + 1).alias("tata_pos"),
        bases("pos", "width").alias("tata_motif"), F.col("run").alias("polyat_len"), (size - F.col("place") + 1).alias("polyat_pos"), bases("place", "run").alias("polyat_tract"),
    )


def longest_run(seqs: DataFrame, key: str, bases: tuple[str, str] = ("A", "T")) -> DataFrame:
    """(key, run, place): length of the longest run of one of two bases and its first place from 1; 0 and null without any."""
    pattern = f"({bases[0]}+|{bases[1]}+)"
    runs = F.regexp_extract_all("seq", F.lit(pattern), F.lit(1))
    longest = F.array_max(F.transform(runs, lambda r: F.length(r)))
    first = F.filter(runs, lambda r: F.length(r) == F.col("_n"))[0]
    out = seqs.withColumn("_n", F.coalesce(longest, F.lit(0))).withColumn("_r", first)
    return out.select(key, F.col("_n").alias("run"), F.when(F.col("_n") > 0, F.instr("seq", F.col("_r"))).alias("place"))


def tiles(chromosomes: DataFrame, core: int, flank: int) -> DataFrame:
    """(seqid, tile, core_start, piece): overlapping windows of long sequences; the core of each is what a scorer keeps."""
    each = chromosomes.select("seqid", "seq", F.posexplode(F.sequence(F.lit(1), F.length("seq"), F.lit(core))).alias("tile", "core_start"))
    low = F.greatest(F.lit(1), F.col("core_start") - flank)
    return each.select("seqid", "tile", "core_start", F.substring(F.col("seq"), low, F.col("core_start") + core + flank - low).alias("piece"))


def unknown_bases(chromosomes: DataFrame) -> DataFrame:
    """(seqid, seq, replaced): upper-case sequences with N for every code outside ACGTN, and how many were replaced."""
    seq = F.upper("seq")
    clean = F.regexp_replace(seq, "[^ACGTN]", "N")
    return chromosomes.select("seqid", clean.alias("seq"), F.length(F.regexp_replace(seq, "[ACGTN]", "")).alias("replaced"))


def divergence(a: DataFrame, b: DataFrame, key: str, values: list[str], flip: list[str] = ()) -> DataFrame:
    """(key, <value>_delta): differences of two score tables, with the sign turned for some."""
    both = a.select(key, *[F.col(v).alias(f"_a_{v}") for v in values]).join(b.select(key, *[F.col(v).alias(f"_b_{v}") for v in values]), key)
    return both.select(key, *[((F.col(f"_b_{v}") - F.col(f"_a_{v}")) if v in flip else (F.col(f"_a_{v}") - F.col(f"_b_{v}"))).alias(f"{v}_delta") for v in values])


def partial_association(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """(n, estimate, r2_partial): slope of x in log(y) ~ x + log(z), and what x adds to R^2; from one set of sums."""
    ok = df.where((F.col(y) > 0) & (F.col(z) > 0) & F.col(x).isNotNull() & ~F.isnan(x)).select(F.ln(y).alias("y"), F.col(x).cast("double").alias("x"), F.ln(z).alias("z"))
    s = ok.agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "zz", "yy", "xz", "xy", "zy")])
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    bx, bz = (F.col("zz") * F.col("xy") - F.col("xz") * F.col("zy")) / det, (F.col("xx") * F.col("zy") - F.col("xz") * F.col("xy")) / det
    full, less = (bx * F.col("xy") + bz * F.col("zy")) / F.col("yy"), F.col("zy") * F.col("zy") / (F.col("zz") * F.col("yy"))
    return s.select("n", bx.alias("estimate"), (full - less).alias("r2_partial"))


def sign_concordance(df: DataFrame, delta: str, est: str, predicted: int) -> DataFrame:
    """(n, concordant, share, p): how often sign(delta) is the predicted sign times sign(est), and the upper binomial tail at one half."""
    ok = df.where(F.col(delta).isNotNull() & F.col(est).isNotNull() & (F.col(delta) != 0) & (F.col(est) != 0))
    s = ok.agg(F.count("*").alias("n"), F.count_if(F.signum(delta) == predicted * F.signum(est)).alias("concordant"))
    from dispersa.operators.classes import log_factorials

    n = s.first()["n"]
    lf = log_factorials(df.sparkSession, n)
    each = s.withColumn("k", F.explode(F.sequence("concordant", "n")))
    each = each.join(lf.select(F.col("n").alias("k"), F.col("v").alias("fk")), "k").withColumn("_r", F.col("n") - F.col("k")).join(lf.select(F.col("n").alias("_r"), F.col("v").alias("fr")), "_r")
    each = each.join(lf.select("n", F.col("v").alias("fn")), "n")
    p = F.sum(F.exp(F.col("fn") - F.col("fk") - F.col("fr") - F.col("n") * F.ln(F.lit(2.0))))
    return each.groupBy("n", "concordant").agg(p.alias("p")).select("n", "concordant", F.try_divide(F.col("concordant"), F.col("n")).alias("share"), F.least(F.lit(1.0), "p").alias("p"))


def concordance_bins(df: DataFrame, delta: str, est: str, predicted: int, bins: int, tiebreak: str) -> DataFrame:
    """(bin, n, concordant, mag_mean, share, ci_lo, ci_hi) in equal-count bins of |delta|, with normal 95 % limits."""
    from dispersa.operators.states import equal_bins

    ok = df.where(F.col(delta).isNotNull() & F.col(est).isNotNull() & (F.col(delta) != 0) & (F.col(est) != 0))
    ok = ok.withColumn("_m", F.abs(delta)).withColumn("_ok", F.signum(delta) == predicted * F.signum(est))
    per = equal_bins(ok, "_m", bins, tiebreak).groupBy("bin").agg(F.count("*").alias("n"), F.count_if("_ok").alias("concordant"), F.avg("_m").alias("mag_mean"))
    share = F.col("concordant") / F.col("n")
    se = F.sqrt(share * (1 - share) / F.col("n"))
    return per.select("bin", "n", "concordant", "mag_mean", share.alias("share"), F.greatest(F.lit(0.0), share - 1.96 * se).alias("ci_lo"), F.least(F.lit(1.0), share + 1.96 * se).alias("ci_hi"))


def top_candidates(df: DataFrame, delta: str, group: str, members: list[str], quantile: float = 0.9) -> DataFrame:
    """Rows of the member groups whose |delta| is at least its quantile among them."""
    rows = df.where(F.col(group).isin(members) & F.col(delta).isNotNull())
    cut = rows.agg(F.percentile(F.abs(delta), quantile).alias("_q"))
    return rows.join(F.broadcast(cut)).where(F.abs(delta) >= F.col("_q")).drop("_q")
