"""Seats dealt to parties by highest quotients (Sainte-Laguë), for any number of parties.

A party with v votes and k seats so far asks for the next with the quotient v / (2k + 1);
the seats go to the highest quotients, and no party gets more than its cap.  Instead of
handing seats out one by one, the quotient of the last seat is bracketed: for a divisor
d, the quotients above 2d number ``floor(v / d + 1/2)`` a party.  Every round counts
them for about ``FAN`` divisors between the bounds of each group in one aggregation over the
parties, the first round close to the divisor that seats all votes evenly; when few
quotients are left between the bounds, these alone are ordered.

Votes are raised by up to one part in 2**32, by a hash of the party, so that equal quotients
are told apart: ties go by that hash, and the bracket closes whatever number of parties tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import written

FAN = 32
#: Quotients of a group that are ordered at last, at most (more only where doubles cannot tell them apart).
FEW = 256
MOST_ROUNDS = 60
SEED = 20_011


def told_apart(votes: Column, party: Column) -> Column:
    """The votes, raised by less than one part in 2**32."""
    u = F.shiftrightunsigned(F.xxhash64(party, F.lit(SEED)), 32).cast("double")
    return votes * (1 + u / 2.0**64)


def seats_above(divisor: Column) -> Column:
    """Quotients of a party above twice the divisor, within its cap."""
    return F.least(F.col("cap").cast("double"), F.floor(F.col("votes") / divisor + 0.5))


def sainte_lague(parties: DataFrame, seats: DataFrame) -> DataFrame:
    """Adds ``quota`` to the parties (grp, party, votes double, cap long) of groups with so many seats (grp, seats long).

    A group with more seats than its caps allow fills them all; a party without votes or cap gets none.
    """
    voted = F.col("votes").isNotNull() & (F.col("votes") > 0) & (F.coalesce("cap", F.lit(0)) > 0)
    held = parties.select("grp", "party", F.when(voted, told_apart(F.col("votes"), F.col("party"))).alias("votes"), "cap")
    held = written(held, "parties")
    able = held.where("votes is not null")
    bounds = (
        able.groupBy("grp")
        .agg(
            (F.min(F.col("votes") / F.col("cap")) * 0.999).alias("low"),  # here every party fills its cap
            (F.max("votes") * 2.001).alias("high"),  # here none has a seat
            F.sum("cap").cast("double").alias("at_low"),
            F.sum("votes").alias("all"),
        )
        .join(seats.select("grp", F.col("seats").cast("double").alias("seats")), "grp")
        .withColumn("at_high", F.lit(0.0))
        .withColumn("even", F.col("all") / F.greatest("seats", F.lit(1.0)))
        .drop("all")
        .withColumn("seats", F.least("seats", "at_low"))
    )
    bounds = written(bounds, "bounds")
    for turn in range(MOST_ROUNDS):
        open_ = bounds.where((F.col("at_low") - F.col("at_high") > FEW) & (F.col("high") > F.col("low") * (1 + 1e-15)))
        if open_.isEmpty():
            break
        bounds = written(narrowed(able, open_, bounds, divisors(first=not turn)), "bounds")
    return with_quota(held, able, bounds)


def divisors(first: bool) -> list[Column]:
    """Rising divisors within a group's bounds: at first ever closer to the votes for one seat, then at equal ratios."""
    if not first:
        return [F.col("low") * F.pow(F.col("high") / F.col("low"), k / FAN) for k in range(1, FAN)]
    steps = [2.0**-k for k in range(1, FAN // 2)]
    near = [F.col("even") * (1 + s) for s in (*(-s for s in steps), 0.0, *reversed(steps))]
    return [F.least(F.greatest(d, F.col("low")), F.col("high")) for d in near]


def narrowed(able: DataFrame, open_: DataFrame, bounds: DataFrame, inner: list[Column]) -> DataFrame:
    """The bounds after one round: between two neighbours of the divisors that enclose each group's last seat."""
    counts = [F.sum(seats_above(d)).alias(f"c{k}") for k, d in enumerate(inner, 1)]
    counted = able.join(open_.select("grp", "low", "high", "even"), "grp").groupBy("grp").agg(*counts)
    held = counted.select("grp", F.array(*[f"c{k}" for k in range(1, len(inner) + 1)]).alias("counts"))
    all_ = bounds.join(held, "grp", "left").withColumn("inner", F.array(*inner))
    # counts fall as divisors rise: so many of the divisors still seat all
    enough = F.coalesce(F.size(F.filter("counts", lambda c: c >= F.col("seats"))), F.lit(0))
    below, above = F.col("enough") > 0, F.col("counts").isNotNull() & (F.col("enough") < len(inner))
    all_ = all_.withColumn("enough", F.when(F.col("counts").isNotNull(), enough).otherwise(0))
    return all_.select(
        "grp",
        "seats",
        "even",
        F.when(below, F.element_at("inner", F.col("enough"))).otherwise(F.col("low")).alias("low"),
        F.when(below, F.element_at("counts", F.col("enough"))).otherwise(F.col("at_low")).alias("at_low"),
        F.when(above, F.element_at("inner", F.col("enough") + 1)).otherwise(F.col("high")).alias("high"),
        F.when(above, F.element_at("counts", F.col("enough") + 1)).otherwise(F.col("at_high")).alias("at_high"),
    )


def with_quota(held: DataFrame, able: DataFrame, bounds: DataFrame) -> DataFrame:
    """Seats above the upper bound, and of the quotients between the bounds as many as are missing."""
    both = able.join(bounds, "grp").select(
        "grp",
        "party",
        "votes",
        seats_above(F.col("high")).cast("long").alias("sure"),
        seats_above(F.col("low")).cast("long").alias("most"),
        (F.col("seats") - F.col("at_high")).alias("missing"),
    )
    asked = both.where("most > sure").select(
        "grp", "party", "votes", "missing", F.explode(F.sequence("sure", F.col("most") - 1)).alias("k")
    )
    order = Window.partitionBy("grp").orderBy(F.desc(F.col("votes") / (2 * F.col("k") + 1)), "party", "k")
    won = asked.withColumn("nth", F.row_number().over(order)).where("nth <= missing")
    won = won.groupBy("grp", "party").agg(F.count("*").alias("won"))
    quota = both.join(won, ["grp", "party"], "left").select(
        "grp", "party", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota")
    )
    return held.select("grp", "party", "cap").join(quota, ["grp", "party"], "left").fillna(0, ["quota"])
