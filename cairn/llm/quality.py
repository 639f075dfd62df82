"""Quality rules with risk-controlled cutoffs, in DataFrame expressions only.

Each rule is a measure (per mille) and a fixed ladder of cutoffs from lenient to
strict; a document above the cutoff is rejected. Labelled good documents are the
holdout: for every stratum and rule the ladder is walked downwards as long as
the exact binomial test rejects "false rejection rate > alpha", that is as long
as P(Bin(n, alpha) <= k) <= delta / (strata * rules) for k false rejections
among n. Walking a fixed order needs no correction within the ladder; the split
of delta (Bonferroni) covers all strata and rules at once. So with probability
1 - delta no stratum loses more than rules * alpha of its good documents. A
stratum with too few labels keeps everything.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stash

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Per mille; lenient to strict.
LADDERS = {
    "symbols": (400, 300, 200, 150, 100, 70, 50, 30, 20, 10),
    "capitals": (700, 600, 500, 400, 300, 200, 150, 100),
    "repeats": (450, 400, 350, 300, 250, 200, 150, 100),
    "copied_lines": (100, 70, 50, 30, 20, 10),
}
ALPHA, DELTA = 0.005, 0.05
#: Cutoffs of up to so many strata are broadcast, else joined by a shuffle.
FEW_STRATA = 10_000


def measures(df: DataFrame) -> DataFrame:
    """Base counts of ``(doc_id, text, stratum)`` and a struct ``row``, if there; null text has no words.

    ``n_repeat_words``: three-word windows are sorted with their positions, so
    equal ones stand side by side; the union of their spans is summed in order.
    Work is n log n in the words of one text, whatever repeats in it.
    """
    text = F.coalesce("text", F.lit(""))
    gone = lambda c, chars: F.char_length(c) - F.char_length(F.translate(c, chars, ""))
    rows = df.withColumn("text", text).withColumn("words", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.char_length(F.translate(x, BLANK, "")) > 0))
    rows = rows.select(
        "doc_id", "stratum", "words", *[c for c in df.columns if c not in ("doc_id", "stratum", "text")],
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", BLANK, "")).cast("long").alias("word_chars"),
        gone(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        gone(F.col("text"), CAPITALS).cast("long").alias("n_capitals"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    short = F.col("n_words") < 3
    rest = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), rest, joined)
    runs = F.zip_with(pairs, F.slice("words", 3, F.greatest(F.size("words") - 2, F.lit(0))), joined)
    rows = rows.withColumn("runs", F.when(short, F.array().cast("array<string>")).otherwise(runs)).drop("words")
    dup = F.size(F.array_distinct("runs")) < F.size("runs")
    placed = F.transform("runs", lambda x, i: F.struct(x.alias("t"), i.alias("i")))
    rows = rows.withColumn("sorted", F.when(dup, F.sort_array(placed)).otherwise(F.array().cast("array<struct<t:string,i:int>>"))).drop("runs")
    at = lambda k: F.get(F.col("sorted"), k).getField("t")
    twice = F.filter("sorted", lambda x, k: (x.getField("t").eqNullSafe(at(k - 1))) | (x.getField("t").eqNullSafe(at(k + 1))))
    rows = rows.withColumn("spots", F.sort_array(F.transform(twice, lambda x: x.getField("i")))).drop("sorted")
    steps = F.transform("spots", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("spots"), k + 1) - p, F.lit(3))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)).drop("spots")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def rule_measures() -> dict[str, Column]:
    """Numerator per mille of denominator, as exact integers (a, b): above t means 1000 a > t b."""
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return {"symbols": (F.col("n_symbols"), chars), "capitals": (F.col("n_capitals"), chars), "repeats": (F.col("n_repeat_words"), words), "copied_lines": (F.col("n_dup_lines"), words)}


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series on x + 8 (error under 1e-12)."""
    z = x.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + F.lit(0.5 * log(2 * pi)) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    for k in range(1, 9):
        series = series - F.log(x.cast("double") + k)
    return series


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k). Terms more than 40 standard deviations below k are under
    double precision and left out; 1 where k reaches the mean."""
    first = F.greatest(F.lit(0).cast("long"), k - F.ceil(F.lit(40.0) * F.sqrt(n * p) + 40).cast("long"))
    term = lambda i: F.exp(log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * log(p) + (n - i) * F.log1p(F.lit(-p)))
    total = F.aggregate(F.sequence(first, k), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``(stratum, rule, cutoff)``: the strictest cutoff certified; uncertified rules are absent.

    All labelled good documents that pass the base rules count. Aggregates are
    partial before the shuffle; a stratum of a third of all rows costs a few
    counters a task. A document labelled twice counts twice.
    """
    good = scored.where("not base_failed").join(labels.where("quality = 1").select("doc_id"), "doc_id")
    rules = [(r, t, a, b) for r, (a, b) in rule_measures().items() for t in LADDERS[r]]
    counts = good.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(1000 * a > t * b).alias(f"{r}_{t}") for r, t, a, b in rules])
    tests = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(t).alias("cutoff"), F.col(f"{r}_{t}").alias("k")) for r, t, _, _ in rules]))
    rows = counts.select("stratum", "n", tests.alias("x")).select("stratum", "n", "x.*")
    strata = counts.agg(F.count("*").alias("strata"))
    rows = rows.join(F.broadcast(strata))  # one row
    level = F.lit(delta) / (F.col("strata") * len(LADDERS))
    rows = rows.withColumn("passed", binomial_at_most(F.col("k"), F.col("n"), alpha) <= level)
    stop = F.max(F.when(~F.col("passed"), F.col("cutoff")))
    sides = rows.groupBy("stratum", "rule").agg(stop.alias("stop"), F.collect_list(F.when(F.col("passed"), F.col("cutoff"))).alias("ok"))
    best = F.array_min(F.filter("ok", lambda t: F.col("stop").isNull() | (t > F.col("stop"))))
    return sides.select("stratum", "rule", best.alias("cutoff")).where("cutoff is not null")


def judged(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, alpha: float, delta: float, whole: bool) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of each row; ``whole``: with the row itself, as a struct.

    The text is scanned once: the counts are written to the shared folder, both
    the cutoffs and the verdicts read them there.
    """
    row = [F.struct(*df.columns).alias("row")] if whole else []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), *row)
    scored, _ = stash(measures(rows), "quality")
    chosen = cutoffs(scored.drop("row"), labels, alpha, delta).groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in LADDERS])
    out = scored.join(F.broadcast(chosen) if chosen.count() <= FEW_STRATA else chosen, "stratum", "left")
    above = [F.coalesce(1000 * a > F.col(r) * b, F.lit(False)) for r, (a, b) in rule_measures().items()]
    hit = above[0]
    for x in above[1:]:
        hit = hit | x
    return out.withColumn("kept", ~F.col("base_failed") & ~hit)


def quality_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every row of ``df``.

    A null stratum is a stratum of its own. Null and empty texts fail the base.
    Rows repeat as they do in ``df``, and a row with a null id is judged like any
    other; other columns are not read. Equal texts of a stratum get equal verdicts.
    A very long text costs memory in proportion to its words in one task. Empty
    tables of documents or labels give an empty result or the base rules alone.
    """
    out = judged(df, labels, id_col, text_col, stratum_col, alpha, delta, whole=False)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Rows of ``df`` that the rules keep, with their columns, whatever these are called.

    Each row is judged by its own text and stratum, so repeated and null ids do
    not matter: the row travels with its measures and nothing is joined by id.
    """
    return judged(df, labels, id_col, text_col, stratum_col, alpha, delta, whole=True).where("kept").select("row.*")
