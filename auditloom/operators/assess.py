"""Context assessment as a decision table in columns.

Twelve answers are yes, no or unknown (null). What is unknown is never taken as
favourable: it is listed, and keeps a system from the lowest tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWERS = ("is_ai", "eu_scope", "prohibited_practice", "annex_i_product", "third_party_conformity", "annex_iii_use", "profiling", "narrow_exception", "transparency", "gpai_provider", "personal_data", "solely_automated_significant_decision")
ROLES = ("provider", "deployer", "importer", "distributor", "unknown")


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _no(name: str) -> Column:
    return F.coalesce(~F.col(name), F.lit(False))


def _listed(*pieces: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in pieces]), lambda x: x.isNotNull())


def assess(contexts: DataFrame) -> DataFrame:
    """contexts: intended_purpose, role and the answers. Adds risk_tier, applicable_articles,
    obligations, deadlines, missing_context, rationale and status; keeps all other columns."""
    wrong = contexts.filter(~F.col("role").isin(*ROLES)).limit(1)
    if not wrong.isEmpty():
        raise ValueError(f"unknown role; one of {', '.join(ROLES)}")
    unknown = lambda n: F.col(n).isNull()
    outside = _no("is_ai") | _no("eu_scope")
    within = ~outside
    confirmed = _yes("is_ai") & _yes("eu_scope")
    prohibited = within & _yes("prohibited_practice")
    annex_i = within & _yes("annex_i_product") & _yes("third_party_conformity")
    listed = within & _yes("annex_iii_use")
    excepted = listed & _no("profiling") & _yes("narrow_exception")
    annex_iii = listed & ~excepted
    high = annex_i | annex_iii
    limited = within & _yes("transparency")
    gpai, personal = _yes("gpai_provider"), _yes("personal_data")
    automated = personal & _yes("solely_automated_significant_decision")
    deployer, provider = F.col("role") == "deployer", F.col("role") == "provider"
    # The order of the questions is the order of the list.
    missing = _listed(
        (F.trim(F.coalesce("intended_purpose", F.lit(""))) == "", "intended_purpose"), (F.col("role") == "unknown", "role"),
        *((unknown(n), n) for n in ("is_ai", "eu_scope", "personal_data")),
        *((within & unknown(n), n) for n in ("prohibited_practice", "annex_i_product", "annex_iii_use", "transparency", "gpai_provider")),
        (within & _yes("annex_i_product") & unknown("third_party_conformity"), "third_party_conformity"),
        (listed & unknown("profiling"), "profiling"), (listed & unknown("narrow_exception"), "narrow_exception"),
        (personal & unknown("solely_automated_significant_decision"), "solely_automated_significant_decision"))
    # What bears on the personal data overlay is asked after the lowest tier is decided.
    open_ = F.exists(missing, lambda m: m != "solely_automated_significant_decision")
    tier = F.when(prohibited, "prohibited").when(high, "high_risk").when(limited, "limited_risk").when(confirmed & ~open_, "minimal_risk")
    articles = _listed(
        (outside, "Arts. 2-3"), (prohibited, "Art. 5"), (annex_i, "Art. 6(1), Annex I"), (annex_iii, "Art. 6(2), Annex III"), (excepted, "Art. 6(3)-(4)"),
        (high & deployer, "Art. 26"), (high & deployer, "Art. 27"), (high & provider, "Arts. 9-15"), (high & provider, "Arts. 16-21"), (high & provider, "Arts. 43-49"),
        (limited, "Art. 50"), (gpai, "Arts. 51-55"), (personal, "GDPR Arts. 5, 6, 9, 13-14, 25, 32, 35"), (automated, "GDPR Art. 22"))
    obligations = _listed(
        (prohibited, "Review elements and exceptions of the prohibition before use."),
        (excepted, "Document the exception; profiling rules it out."),
        (high & deployer, "Check instructions, human oversight, logs and the need for a rights assessment."),
        (high & provider, "Prepare risk and quality management, data governance, technical files, logs and oversight."),
        (high & ~deployer & ~provider, "Settle duties along the value chain by role."),
        (limited, "Review notices and marking of generated content."),
        (gpai, "Assess duties of model providers on their own."),
        (personal, "Document legal basis, retention, rights, processors and impact assessment."),
        (automated, "Review safeguards of solely automated decisions."),
        (F.lit(True), "This assessment is provisional and certifies nothing."))
    deadlines = _listed((prohibited, "Art. 5: 2025-02-02"), (annex_i, "Annex I: 2028-08-02"), (annex_iii, "Annex III: 2027-12-02"), (limited, "Art. 50: 2026-08-02"), (gpai, "GPAI: 2025-08-02"))
    reason = (F.when(~confirmed & tier.isNotNull(), "Signals to be confirmed once scope is settled.").when(outside, "Possibly out of scope by the answers given; other law stays untouched.")
              .when(tier == "minimal_risk", "No elevated category by the answers given.").otherwise("Legal classification awaits context and review."))
    return contexts.withColumns({"risk_tier": tier, "applicable_articles": articles, "obligations": obligations, "deadlines": deadlines, "missing_context": missing, "rationale": reason, "status": F.lit("requires_review")})


def provisional(answers: DataFrame) -> DataFrame:
    """Assessment of a short form: q1, q2 and q3 name a prohibited practice, a high-risk use
    and a transparency case, or are `none`. `none` is no denial: it leaves the question open."""
    given = {"prohibited_practice": "q1", "annex_iii_use": "q2", "transparency": "q3"}
    told = {a: (F.when(F.col(given[a]) != "none", F.lit(True)) if a in given else F.lit(None).cast("boolean")) for a in ANSWERS}
    return assess(answers.withColumns({"intended_purpose": F.lit(""), "role": F.lit("unknown"), **told}))
