"""Score columns: source factor, evidence weight, decision tables, confidence, summary text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom import vocab as V

# Weights are summed as decimals so that a score never depends on the order in which
# partitions are merged.
EXACT = "decimal(20,12)"


def four_places(c: Column) -> Column:
    """Rounded half up as a decimal, so binary noise at a tie cannot tip it."""
    return F.round(c.cast(EXACT), 4).cast("double")


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def source_factor(source_type: Column, is_primary: Column) -> Column:
    base = F.lit(V.SOURCE_FACTORS["UNKNOWN"])
    for name, factor in V.SOURCE_FACTORS.items():
        base = F.when(source_type == name, F.lit(factor)).otherwise(base)
    bonus = F.when(is_primary, F.lit(V.PRIMARY_BONUS)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(V.FACTOR_FLOOR), F.least(F.lit(V.FACTOR_CEILING), base + bonus))


def evidence_weight(relevance: Column, factor: Column, temporal: Column, directness: Column) -> Column:
    return unit(relevance) * factor * unit(temporal) * unit(directness)


def penalty_value(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in V.PENALTIES.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def damped(best: Column, total: Column) -> Column:
    """The strongest member in full, the rest at the damping share."""
    return best + F.lit(V.CLUSTER_DAMPING) * (total - best)


def net_score(support: Column, contradiction: Column) -> Column:
    total = support + contradiction
    return F.when(total > 1e-9, (support - contradiction) / total).otherwise(F.lit(0.0))


# Rule number to verdict.
CLAIM_RULES = {
    1: "UNVERIFIED", 2: "OPINION", 3: "SATIRE", 4: "MISLEADING", 5: "PARTLY_TRUE", 6: "VERIFIED",
    7: "LIKELY_TRUE", 8: "FALSE", 9: "LIKELY_FALSE", 10: "PARTLY_TRUE", 11: "UNVERIFIED",
}


def claim_rule(
    claim_type: Column,
    satirical: Column,
    net: Column,
    support: Column,
    contradiction: Column,
    origins: Column,
    penalty: Column,
) -> Column:
    """The number of the first rule that applies."""
    strong = net >= 0.60
    return (
        F.when((support + contradiction < V.MIN_WEIGHT) | (origins == 0), 1)
        .when(claim_type.isin(*V.UNCHECKABLE_CLAIM_TYPES), 2)
        .when(satirical, 3)
        .when(strong & (penalty >= 0.35), 4)
        .when(strong & (penalty > 0), 5)
        .when((net >= 0.75) & (origins >= 3) & (support >= 2.0), 6)
        .when(net >= 0.50, 7)
        .when((net <= -0.75) & (origins >= 2) & (contradiction >= 1.5), 8)
        .when(net <= -0.40, 9)
        .when((support > 0) & (contradiction > 0), 10)
        .otherwise(11)
    )


def rule_verdict(rule: Column) -> Column:
    out = F.lit("UNVERIFIED")
    for number, verdict in CLAIM_RULES.items():
        out = F.when(rule == number, F.lit(verdict)).otherwise(out)
    return out


def coverage(origins: Column) -> Column:
    return F.least(F.lit(1.0), origins / F.lit(float(V.TARGET_ORIGINS)))


def confidence(support: Column, contradiction: Column, origins: Column, best_factor: Column) -> Column:
    total = support + contradiction
    mass = F.least(F.lit(1.0), total / 4.0)
    agreement = F.when(total > 1e-9, 1.0 - F.least(support, contradiction) / total).otherwise(F.lit(0.0))
    source = F.coalesce(
        (best_factor - V.FACTOR_FLOOR) / F.lit(V.FACTOR_CEILING - V.FACTOR_FLOOR), F.lit(0.0)
    )
    return 0.40 * coverage(origins) + 0.25 * mass + 0.20 * agreement + 0.15 * source


def confidence_band(score: Column, verdict: Column) -> Column:
    return (
        F.when(verdict == "UNVERIFIED", "LOW")
        .when(score >= V.CONFIDENCE_HIGH, "HIGH")
        .when(score >= V.CONFIDENCE_MEDIUM, "MEDIUM")
        .otherwise("LOW")
    )


def overall_rule(n: dict[str, Column], total: Column) -> tuple[Column, Column]:
    """(verdict, rule) from the number of considered claims per verdict."""
    substantive = total - n["SATIRE"] - n["OPINION"]
    held = n["VERIFIED"] + n["LIKELY_TRUE"]
    cases = [
        (total == 0, "UNVERIFIED", 0),
        (n["FALSE"] > 0, "FALSE", 1),
        (n["MISLEADING"] > 0, "MISLEADING", 2),
        (n["LIKELY_FALSE"] > 0, "LIKELY_FALSE", 3),
        (n["SATIRE"] == total, "SATIRE", 8),
        (n["OPINION"] == total, "OPINION", 8),
        (n["PARTLY_TRUE"] > 0, "PARTLY_TRUE", 4),
        ((substantive > 0) & (n["VERIFIED"] == substantive), "VERIFIED", 5),
        ((substantive > 0) & (held == substantive), "LIKELY_TRUE", 6),
        ((n["UNVERIFIED"] > 0) & (n["UNVERIFIED"] * 2 >= total), "UNVERIFIED", 7),
        ((held > 0) & (n["UNVERIFIED"] > 0), "PARTLY_TRUE", 4),
    ]
    verdict, rule = F.lit("UNVERIFIED"), F.lit(7)
    for condition, name, number in reversed(cases):
        verdict = F.when(condition, F.lit(name)).otherwise(verdict)
        rule = F.when(condition, F.lit(number)).otherwise(rule)
    return verdict, rule


def overall_band(score: Column, verdict: Column, degraded: Column) -> Column:
    band = confidence_band(score, verdict)
    return F.when(degraded & (band == "HIGH"), "MEDIUM").otherwise(band)


# The sentences of a report summary.
def summary_text(
    claims: Column,
    passages: Column,
    origins: Column,
    supporting: Column,
    contradicting: Column,
    publishers: Column,
) -> Column:
    noun = F.when(claims == 1, "claim").otherwise("claims")
    nothing = F.concat(
        F.lit("We identified "), claims.cast("string"), F.lit(" factual "), noun,
        F.lit(" in this submission and searched our indexed news sources, but found nothing "
              "relevant enough to confirm or contradict "),
        F.when(claims == 1, "it").otherwise("them"),
        F.lit(". That means the claim is unverified — it does not mean it is false. Our coverage "
              "is limited to the sources we index, so absence here is not absence everywhere."),
    )
    head = F.concat(
        F.lit("We identified "), claims.cast("string"), F.lit(" factual "), noun, F.lit(" and examined "),
        passages.cast("string"), F.lit(" passages from "), origins.cast("string"), F.lit(" independent "),
        F.when(origins == 1, "source").otherwise("sources"), F.lit("."),
    )

    def counted(n: Column) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, " passage").otherwise(" passages"))

    finding = (
        F.when(
            (supporting > 0) & (contradicting > 0),
            F.concat(counted(supporting), F.lit(" supported the claims and "),
                     contradicting.cast("string"), F.lit(" contradicted them.")),
        )
        .when(supporting > 0, F.concat(counted(supporting), F.lit(" supported the claims.")))
        .when(contradicting > 0, F.concat(counted(contradicting), F.lit(" contradicted the claims.")))
        .otherwise("The passages we found were related but did not settle the claims either way.")
    )
    named = F.when(
        F.size(publishers) > 0,
        F.concat(F.lit("Sources checked: "), F.array_join(publishers, ", "), F.lit(".")),
    )
    return F.when(passages == 0, nothing).otherwise(F.concat_ws(" ", head, finding, named))
