"""Findings of all analyses in one form: union, de-duplication, chained rules, scores, tiers, reports.

A finding has finding_id, module, method, severity, confidence, vendor_id, invoice_id and amount.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = ["finding_id", "module", "method", "severity", "confidence", "vendor_id", "invoice_id", "amount"]
# Weights of modules and severities in the risk score, and the score from which each tier begins.
MODULE_WEIGHTS = {
    "duplicate_detection": 0.15, "price_creep": 0.12, "phantom_services": 0.18, "vendor_collusion": 0.20, "contract_compliance": 0.10,
    "vendor_behavior": 0.15, "market_price": 0.05, "split_invoicing": 0.05,
}
SEVERITY_WEIGHTS = {"critical": 1.0, "review": 0.6, "informational": 0.2}
TIERS = [("critical", 75.0), ("high", 50.0), ("medium", 25.0), ("low", 0.0)]


def finding(df: DataFrame, module: str, method: str, severity: Column, confidence: Column, amount: Column) -> DataFrame:
    """df (vendor_id, invoice_id, ...) in the common form; the id depends on what is found, so a repeated run gives it again."""
    parts = F.concat_ws("|", F.lit(module), F.lit(method), F.coalesce("vendor_id", F.lit("")), F.coalesce("invoice_id", F.lit("")))
    return df.select(
        F.concat(F.lit("F-"), F.substring(F.sha2(parts, 256), 1, 12)).alias("finding_id"), F.lit(module).alias("module"), F.lit(method).alias("method"), severity.alias("severity"),
        confidence.cast("double").alias("confidence"), "vendor_id", "invoice_id", amount.cast("double").alias("amount"),
    )


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def module_dedup(findings: DataFrame, least: float = 0.5) -> DataFrame:
    """findings of at least that confidence; of one invoice and vendor found by two modules or more only the surest, with the list
    of modules. Ties: the smallest finding_id. Findings of one module alone are all kept."""
    gated = findings.where(F.col("confidence") >= least)
    # one row a key, combined before the shuffle: findings without an invoice, however many, are not gathered into one task
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "finding_id"))["finding_id"].alias("_best")
    keys = gated.groupBy(F.col("invoice_id").alias("_i"), F.col("vendor_id").alias("_v")).agg(F.array_sort(F.collect_set("module")).alias("modules"), best)
    joined = gated.join(keys, F.col("invoice_id").eqNullSafe(F.col("_i")) & F.col("vendor_id").eqNullSafe(F.col("_v")))
    return joined.where((F.size("modules") < 2) | (F.col("finding_id") == F.col("_best"))).drop("_i", "_v", "_best")


def rule_chain(findings: DataFrame) -> DataFrame:
    """findings with their final confidence, suppressed, and corroborated_by, after rules in this order, each seeing the one before:

    damp: a duplicate on an invoice that another module also questions as phantom service loses two fifths of its confidence;
    yield: a split of a vendor whose only behaviour findings are reviews is suppressed; corroborate: a vendor with three
    modules of confidence .75 or more, not suppressed, has its findings marked with their number.
    """
    doubted = findings.where((F.col("module") == "phantom_services") & F.col("invoice_id").isNotNull()).select("invoice_id").distinct().withColumn("_doubted", F.lit(True))
    findings = findings.join(doubted, "invoice_id", "left")
    damped = F.when((F.col("module") == "duplicate_detection") & F.col("_doubted"), F.col("confidence") * 0.6).otherwise(F.col("confidence"))
    out = findings.withColumn("confidence", F.round(damped, 6))
    behaviour = F.col("module") == "vendor_behavior"
    sure = F.when(F.col("confidence") >= 0.75, F.col("module"))
    # one row a vendor, combined before the shuffle: a vendor with very many findings is not gathered into one task
    vendor = out.where("vendor_id is not null").groupBy("vendor_id").agg(
        ((F.max(behaviour.cast("int")) == 1) & (F.max((behaviour & (F.col("severity") != "review")).cast("int")) == 0)).alias("_yields"), F.collect_set(sure).alias("_sure"),
        F.max((sure == "split_invoicing").cast("int")).alias("_split"),
    )
    n = F.size("_sure") - F.when(F.col("_yields"), F.coalesce("_split", F.lit(0))).otherwise(0)
    out = out.join(vendor.select("vendor_id", "_yields", n.alias("_n")), "vendor_id", "left")
    out = out.withColumn("suppressed", (F.col("module") == "split_invoicing") & F.coalesce("_yields", F.lit(False)))
    return out.withColumn("corroborated_by", F.when(~F.col("suppressed") & (F.col("_n") >= 3), F.col("_n")).otherwise(0)).drop("_yields", "_n", "_doubted")


def _weighted(findings: DataFrame) -> Column:
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.col("confidence") * table(SEVERITY_WEIGHTS)[F.col("severity")] * table(MODULE_WEIGHTS)[F.col("module")]


def risk_scores(findings: DataFrame, key: str) -> DataFrame:
    """(key, findings, modules, score, tier): 100 (1 - e ** (-8 raw)) of the weighted sum of confidences."""
    got = findings.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("module").alias("modules"), F.sum(_weighted(findings)).alias("_raw"))
    score = F.round(F.least(F.lit(100.0), 100 * (1 - F.exp(-8 * F.col("_raw")))), 1)
    return got.withColumn("score", score).withColumn("tier", tier(F.col("score"))).drop("_raw")


def tier(score: Column) -> Column:
    out = F.lit(TIERS[-1][0])
    for name, least in reversed(TIERS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def risk_distribution(scores: DataFrame) -> DataFrame:
    """(tier, n) of all tiers, also those without rows."""
    all_ = scores.sparkSession.createDataFrame([(t,) for t, _ in TIERS], "tier string")
    return all_.join(scores.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def top_scores(scores: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n highest scores: a top-k report. Ties: the smallest key."""
    return scores.orderBy(F.col("score").desc(), key).limit(n)


def alert_tier() -> Column:
    """critical, review or informational by severity, confidence and amount."""
    c, a = F.col("confidence"), F.col("amount")
    return F.when((F.col("severity") == "critical") | (c >= 0.85) & (a >= 5000), "critical").when((c >= 0.6) & (a >= 1000) | (c >= 0.85) & (a >= 500), "review").otherwise("informational")


def alert_summary(findings: DataFrame) -> DataFrame:
    """(alert, n, amount, modules, vendors) of each alert tier."""
    return findings.groupBy(alert_tier().alias("alert")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.count_distinct("module").alias("modules"), F.count_distinct("vendor_id").alias("vendors"))


def recovery(findings: DataFrame, least: float = 0.7, n: int = 100) -> DataFrame:
    """The n largest amounts found with at least that confidence: a top-k report. Ties: the smallest finding_id."""
    return findings.where((F.col("confidence") >= least) & (F.col("amount") > 0)).orderBy(F.col("amount").desc(), "finding_id").limit(n).select("finding_id", "module", "vendor_id", "invoice_id", "amount", "confidence")


def feedback_rates(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """(module, verdicts, false_positives, rate, bump): how often findings of a module were judged wrong; a suggestion to raise its
    threshold by .3 of the rate, at most .2, from 5 verdicts and a rate above .2 on. The latest verdict on a finding counts."""
    latest = feedback.groupBy("finding_id").agg(F.max_by("verdict", "given_at").alias("verdict"))
    got = findings.join(latest, "finding_id").groupBy("module").agg(F.count(F.lit(1)).alias("verdicts"), F.count_if(F.col("verdict") == "false_positive").alias("false_positives"))
    rate = F.col("false_positives") / F.col("verdicts")
    return got.withColumn("rate", rate).withColumn("bump", F.when((F.col("verdicts") >= 5) & (F.col("rate") > 0.2), F.least(F.col("rate") * 0.3, F.lit(0.2))).otherwise(0.0))


def suppress_known(findings: DataFrame, feedback: DataFrame, pattern: Column, times: int = 3) -> DataFrame:
    """findings whose pattern was judged wrong `times` times or more are suppressed."""
    wrong = feedback.where("verdict = 'false_positive'").join(findings.select("finding_id", pattern.alias("_pattern")), "finding_id")
    known = wrong.groupBy("_pattern").agg(F.count(F.lit(1)).alias("_wrong")).where(F.col("_wrong") >= times)
    return findings.withColumn("_pattern", pattern).join(known, "_pattern", "left").withColumn("suppressed", F.col("_wrong").isNotNull()).drop("_pattern", "_wrong")


def accuracy(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, total, detected, rate) of known cases (kind, invoice_id), however many findings hit each."""
    hit = truth.join(findings.where("invoice_id is not null").select("invoice_id").distinct(), "invoice_id", "left_semi").groupBy("kind").agg(F.count_distinct("invoice_id").alias("detected"))
    all_ = truth.groupBy("kind").agg(F.count_distinct("invoice_id").alias("total"))
    return all_.join(hit, "kind", "left").select("kind", "total", F.coalesce("detected", F.lit(0)).alias("detected"), (F.coalesce("detected", F.lit(0)) / F.col("total")).alias("rate"))
