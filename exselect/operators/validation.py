"""Before/after comparison of token distributions and log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exselect.operators.scoring import with_scalar

LOG_EPS = 1e-12  # fixed value inside every logarithm


def _counted(value: Column | str, mask: str | None) -> Column:
    """The value where the boolean column `mask` is true (null is false); every value without a mask."""
    value = F.col(value) if isinstance(value, str) else value
    return value if mask is None else F.when(F.col(mask), value)


def document_log_p(tokens: DataFrame, value: str = "log_p", mask: str | None = None) -> DataFrame:
    """(doc_id, log_p): sum over the tokens that `mask` keeps, null without any; sums combine before the shuffle."""
    return tokens.groupBy("doc_id").agg(F.sum(_counted(value, mask)).alias("log_p"))


def delta_log_p(tokens: DataFrame, mask: str | None = None) -> DataFrame:
    """(doc_id, log_p_before, log_p_after, delta_log_p) from per-token log-probabilities of the tokens that `mask` keeps."""
    return (
        tokens.groupBy("doc_id")
        .agg(*[F.sum(_counted(name, mask)).alias(name) for name in ("log_p_before", "log_p_after")])
        .withColumn("delta_log_p", F.col("log_p_after") - F.col("log_p_before"))
    )


def _total(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda total, x: total + x)


def kl(p: Column | str, q: Column | str) -> Column:
    """sum p (ln p - ln(q + eps)), with 0 ln 0 = 0."""
    return _total(F.zip_with(
        p, q, lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(b + LOG_EPS))).otherwise(F.lit(0.0))
    ))


def token_jsd(before: str = "p_before", after: str = "p_after", variant: str = "reference") -> Column:
    """Half-sum of divergences to the mean. "reference" measures the mean against the two sides,
    "standard" the two sides against the mean."""
    middle = F.zip_with(before, after, lambda a, b: (a + b) / 2)
    if variant == "reference":
        return 0.5 * kl(middle, before) + 0.5 * kl(middle, after)
    if variant == "standard":
        return 0.5 * kl(before, middle) + 0.5 * kl(after, middle)
    raise ValueError(f"unknown variant {variant!r}")


def jsd(token_probs: DataFrame, variant: str = "reference", mask: str | None = None) -> DataFrame:
    """(doc_id, jsd), averaged over the tokens of a document that `mask` keeps."""
    return token_probs.groupBy("doc_id").agg(F.avg(_counted(token_jsd(variant=variant), mask)).alias("jsd"))


def kld(token_probs: DataFrame, mask: str | None = None) -> DataFrame:
    """(doc_id, kld) of before against after, averaged over the tokens of a document that `mask` keeps."""
    return token_probs.groupBy("doc_id").agg(F.avg(_counted(kl("p_before", "p_after"), mask)).alias("kld"))


def divergences(token_probs: DataFrame, variant: str = "reference", mask: str | None = None) -> DataFrame:
    """Both averages in one pass."""
    return token_probs.groupBy("doc_id").agg(
        F.avg(_counted(token_jsd(variant=variant), mask)).alias("jsd"),
        F.avg(_counted(kl("p_before", "p_after"), mask)).alias("kld"),
    )


def softmax(column: str) -> Column:
    """Distribution of an array of scores, shifted by its maximum."""
    powers = with_scalar(column, F.array_max(column), lambda x, top: F.exp(x - top))
    return with_scalar(powers, _total(powers), lambda x, total: x / total)


def validation_scores(pairs: DataFrame) -> DataFrame:
    """Selection against random: difference of delta log p, ratio of JSD, difference of KLD."""
    return (
        pairs.withColumn("validation_score_log_p", F.col("delta_log_p_selection") - F.col("delta_log_p_random"))
        .withColumn("validation_score_jsd", F.try_divide("jsd_selection", "jsd_random"))
        .withColumn("validation_score_kld", F.col("kld_selection") - F.col("kld_random"))
    )
