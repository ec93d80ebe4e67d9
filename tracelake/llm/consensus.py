"""Consensus of several annotators' labels.

Each annotator's verdicts are centred on that annotator's own mean, which takes
out how often a judge says yes by chance. The agreement of two judges is the mean
product of their centred verdicts over the items both judged, divided by their
spreads: the overlap counts are corrected for. The leading eigenvector of this
matrix, found by power iteration with sparse joins, is each judge's reliability:
the correlation of the judge's verdicts with the truth. Agreements count by their
overlap, and a judge's agreement with itself, which is not known, is left out of
the product. The share of right answers follows from the third moment of the
votes along the eigenvector; reliability, yes-rate and that share give how often a
judge says yes to right and to wrong answers, and with them the weight of a yes and
of a no, so that a judge who errs in one direction only counts for what that verdict
is worth. No vote is fed back into the weights.

Defined results: rows without an item or judge are left out; a verdict that is no
known spelling of yes or no is no verdict; a judge's later verdict on an item
replaces the earlier; items without any verdict do not come out; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.plans.cut import cut, drop

#: Spellings of verdicts, lower case.
YES = ("true", "t", "1", "yes", "y", "correct", "right", "верно", "да")
NO = ("false", "f", "0", "no", "n", "incorrect", "wrong", "неверно", "нет")
FIRST_JUDGE = "first"
#: Rounds of the power iteration between two looks at how far it still moves; where it moves less, in the first and in the second iteration, it ends.
ROUNDS, MOST_ROUNDS, BEGUN, STILL = 6, 60, 2e-2, 1e-3
#: No reliability is taken to be above the first, no yes-rate to be under the second.
MOST_RELIABLE, LEAST_RATE = 0.99, 0.005


def verdict(column: Column) -> Column:
    """1, 0 or null for a written verdict."""
    text = F.lower(F.regexp_replace(column.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(text.isin(*YES), 1.0).when(text.isin(*NO), 0.0)


def votes(labels: DataFrame) -> DataFrame:
    """(item, judge, vote): one vote per judge and item, the first judge's original_correct included."""
    said = F.when(F.col("tool") == "rejudge", F.col("rejudged")).otherwise(F.col("rejudge_correct"))
    judge = F.lower(F.regexp_replace("judge", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    when = F.struct("created_at", "vote_id", "vote")
    rows = labels.where("question_id is not null")
    ours = rows.select(F.col("question_id").alias("item"), judge.alias("judge"), verdict(said).alias("vote"), "created_at", "vote_id")
    first = rows.select(F.col("question_id").alias("item"), F.lit(FIRST_JUDGE).alias("judge"), verdict(F.col("original_correct")).alias("vote"), "created_at", "vote_id")
    return ours.unionByName(first).where("vote is not null and judge <> ''").groupBy("item", "judge").agg(F.max(when)["vote"].alias("vote"))


def judges_of(ballots: DataFrame) -> DataFrame:
    """(judge, rate, sd, n_votes): how often each judge says yes, and its spread."""
    stats = ballots.groupBy("judge").agg(F.avg("vote").alias("rate"), F.count(F.lit(1)).alias("n_votes"))
    return stats.select("judge", "rate", F.sqrt(F.col("rate") * (1 - F.col("rate"))).alias("sd"), "n_votes")


def agreement(ballots: DataFrame, judges: DataFrame) -> DataFrame:
    """(a, b, agree, n): overlap-corrected agreement of each pair of judges, both orders, a <> b.

    The products are summed per pair before anything is centred, so that only the sums meet the judges' means.
    """
    other = ballots.select("item", F.col("judge").alias("b"), F.col("vote").alias("w"))
    both = ballots.select("item", F.col("judge").alias("a"), F.col("vote").alias("v")).join(other, "item").where("a < b")
    sums = both.groupBy("a", "b").agg(F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum("v").alias("v"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    spread = judges.where("sd > 0")
    sums = sums.join(spread.select(F.col("judge").alias("a"), F.col("rate").alias("p"), F.col("sd").alias("sd_a")), "a").join(spread.select(F.col("judge").alias("b"), F.col("rate").alias("q"), F.col("sd").alias("sd_b")), "b")
    centred = F.col("vw") - F.col("p") * F.col("w") - F.col("q") * F.col("v") + F.col("n") * F.col("p") * F.col("q")
    pairs = sums.select("a", "b", (centred / F.col("n") / F.col("sd_a") / F.col("sd_b")).alias("agree"), "n")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree", "n"))


def _iterated(matrix: DataFrame, vector: DataFrame, step: Column, still: float) -> tuple[DataFrame, bool]:
    """(judge, weight) of length 1 after rounds of ``step`` on the products of the matrix with the vector, and whether it came to rest."""
    rest, done = False, 0
    while done < MOST_ROUNDS and not rest:
        moved = vector
        for _ in range(ROUNDS):
            moved = matrix.join(moved.withColumnRenamed("judge", "b"), "b").groupBy(F.col("a").alias("judge")).agg(F.coalesce(step, F.lit(0.0)).alias("weight"))
        norm = moved.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
        moved = cut(moved.crossJoin(norm).select("judge", F.coalesce(F.try_divide("weight", "norm"), F.lit(0.0)).alias("weight")))
        most = moved.join(vector.withColumnRenamed("weight", "before"), "judge").agg(F.max(F.abs(F.abs("weight") - F.abs("before")))).first()[0]
        drop(vector)
        vector, done, rest = moved, done + ROUNDS, most is None or most < still
    return vector, rest


def reliability(matrix: DataFrame) -> DataFrame:
    """(judge, weight): the leading eigenvector of the agreement matrix, scaled to the judges' correlations with the truth
    and signed so that the judges' majority is taken as right.

    The first iteration is on the whole matrix, each judge in full agreement with itself. The second starts from its result,
    counts every agreement by its overlap and leaves the judges' own out; its result stands if it comes to rest.
    """
    own = matrix.select("a", F.col("a").alias("b"), F.lit(1.0).alias("agree"), F.lit(0).cast("bigint").alias("n")).distinct()
    start = cut(own.select(F.col("a").alias("judge"), F.lit(1.0).alias("weight")))
    first, _ = _iterated(matrix.unionByName(own), start, F.sum(F.col("agree") * F.col("weight")), BEGUN)
    pull, square = F.sum(F.col("n") * F.col("agree") * F.col("weight")), F.sum(F.col("n") * F.col("weight") * F.col("weight"))
    vector, rest = _iterated(matrix, cut(first), F.try_divide(pull, square), STILL)
    vector = vector if rest else first
    b = vector.select(F.col("judge").alias("b"), F.col("weight").alias("w_b"))
    fit = matrix.join(vector.select(F.col("judge").alias("a"), F.col("weight").alias("w_a")), "a").join(b, "b")
    both = F.col("w_a") * F.col("w_b")
    size = fit.agg(F.try_divide(F.sum(F.col("n") * F.col("agree") * both), F.sum(F.col("n") * both * both)).alias("size")).crossJoin(vector.agg(F.when(F.sum("weight") < 0, -1.0).otherwise(1.0).alias("sign")))
    scaled = F.col("sign") * F.col("weight") * F.sqrt(F.greatest(F.coalesce("size", F.lit(0.0)), F.lit(0.0)))
    return vector.crossJoin(size).select("judge", F.least(F.greatest(scaled, F.lit(-MOST_RELIABLE)), F.lit(MOST_RELIABLE)).alias("weight"))


def right_share(ballots: DataFrame, judges: DataFrame) -> DataFrame:
    """One row ``share``: how many of the items are right, from the votes' third moment along the reliabilities.

    Over triples of different judges the products of standardised votes are as skewed as the truth; the sum over all
    triples of an item follows from the sums of its votes' powers. One half where no item has three votes.
    """
    a, q = (F.col("vote") - F.col("rate")) / F.col("sd") * F.col("weight"), F.col("weight") * F.col("weight")
    sums = [F.sum(x**k).alias(f"{name}{k}") for name, x in (("a", a), ("q", q)) for k in (1, 2, 3)]
    items = ballots.join(judges.where("sd > 0"), "judge").groupBy("item").agg(*sums)
    triples = lambda x: (F.col(f"{x}1") ** 3 - 3 * F.col(f"{x}1") * F.col(f"{x}2") + 2 * F.col(f"{x}3")) / 6
    few = F.sum(triples("q"))
    skew = items.agg(F.when(few > 1e-9, F.sum(triples("a")) / few).alias("skew"))
    share = 0.5 * (1 - F.coalesce("skew", F.lit(0.0)) / F.sqrt(4 + F.coalesce("skew", F.lit(0.0)) ** 2))
    return skew.select(F.least(F.greatest(share, F.lit(0.01)), F.lit(0.99)).alias("share"))


def consensus(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, p, n_votes, agreement) per item and (judge, weight, yes_if_right, yes_if_wrong, n_votes) per judge.

    ``p`` is the probability that the item's answer is right; ``agreement`` is the
    share of its votes that match the consensus.
    """
    ballots = cut(votes(labels))
    stats = cut(judges_of(ballots))
    matrix = cut(agreement(ballots, stats))
    weights = reliability(matrix)
    judges = cut(stats.join(weights, "judge", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))), replaces=matrix)
    drop(stats)
    share = F.col("share")
    within = lambda x: F.least(F.greatest(x, F.lit(LEAST_RATE)), F.lit(1 - LEAST_RATE))
    pull = F.col("weight") * F.col("sd")
    rates = judges.crossJoin(right_share(ballots, judges)).select(
        "judge", "weight", within(F.col("rate") + pull * F.sqrt((1 - share) / share)).alias("yes_if_right"), within(F.col("rate") - pull * F.sqrt(share / (1 - share))).alias("yes_if_wrong"), "n_votes", "share"
    )
    rates = cut(rates, replaces=judges)
    right, wrong = F.col("yes_if_right"), F.col("yes_if_wrong")
    odds = F.when(F.col("vote") == 1, F.ln(right / wrong)).otherwise(F.ln((1 - right) / (1 - wrong)))
    items = ballots.join(rates, "judge").groupBy("item").agg((F.sum(odds) + F.ln(F.max("share") / (1 - F.max("share")))).alias("odds"), F.count(F.lit(1)).alias("n_votes"), F.avg("vote").alias("yes"))
    items = items.select("item", (1 / (1 + F.exp(-F.col("odds")))).alias("p"), "n_votes", F.when(F.col("odds") > 0, F.col("yes")).otherwise(1 - F.col("yes")).alias("agreement"))
    return items, rates.drop("share")
