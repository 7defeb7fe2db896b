"""Score components, hard filters and explanation rules as Spark columns.

All functions work on prepared features (``operators.features``): sorted item
sets, years as doubles, ranks looked up once per job and once per candidate
instead of once per pair. ``size`` and ``array_intersect`` are the only array
work left per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rolefit.functions import text as X
from rolefit.functions import vocab

S = vocab.SENTENCES


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


# --- components ------------------------------------------------------------------

def required_score(matched: Column, total: Column) -> Column:
    ratio = matched / F.greatest(total, F.lit(1))
    return F.when(total == 0, 1.0).when(ratio < 0.5, ratio * 0.75).otherwise(ratio)


def share_score(matched: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(matched / F.greatest(total, F.lit(1)))


def domain_score(matched: Column, total: Column, have: Column) -> Column:
    return (F.when(total == 0, 1.0).when(have == 0, 0.5)
            .otherwise(matched / F.greatest(total, F.lit(1))))


def experience_score(need_given: Column, need: Column, have: Column) -> Column:
    """``need_given`` tells a missing requirement from one that is no number."""
    gap = need - have
    ratio = F.try_divide(have, need)
    return (
        F.when(~need_given, 1.0)
        .when(need.isNull() | have.isNull(), 0.0)
        .when((need <= 0) | (have >= need), 1.0)
        .when(gap <= 1, F.greatest(F.lit(0.75), ratio))
        .when(gap <= 3, F.greatest(F.lit(0.5), ratio * 0.9))
        .otherwise(F.greatest(F.lit(0.0), ratio * 0.75))
    )


def _rank_score(need, need_rank, have, have_rank, have_blank_score, step) -> Column:
    diff = need_rank - have_rank
    return (
        F.when(blank(need), 1.0)
        .when(blank(have), have_blank_score)
        .when(diff.isNull(), 0.5)
        .when(diff <= 0, 1.0)
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(step) * diff))
    )


def education_score(need, need_rank, have, have_rank) -> Column:
    return _rank_score(need, need_rank, have, have_rank, 0.0, 0.35)


def seniority_score(need, need_rank, have, have_rank) -> Column:
    return _rank_score(need, need_rank, have, have_rank, 0.5, 0.4)


def weighted_sum(required: Column, preferred, experience, education, seniority, domain) -> Column:
    """Weighted sum of the components, in this order of additions."""
    w = vocab.WEIGHTS
    return (
        required * w["required_skill_score"]
        + preferred * w["preferred_skill_score"]
        + experience * w["experience_score"]
        + education * w["education_score"]
        + seniority * w["seniority_score"]
        + domain * w["domain_score"]
    )


def capped(score: Column, required: Column) -> Column:
    return (
        F.when(required == 0, F.least(score, F.lit(vocab.CAP_NO_REQUIRED)))
        .when(required < 0.5, F.least(score, F.lit(vocab.CAP_FEW_REQUIRED)))
        .otherwise(score)
    )


def fit_label(score: Column) -> Column:
    label = None
    for limit, name in vocab.FIT_LABELS:
        label = F.when(score >= limit, name) if label is None else label.when(score >= limit, name)
    return label.otherwise(vocab.LOWEST_FIT_LABEL)


# --- hard filters ------------------------------------------------------------------

def experience_check(need_given: Column, need: Column, have: Column) -> Column:
    """passed and gap. The sign of the gap differs when the candidate's years are
    missing; an unreadable requirement fails with no gap."""
    return F.struct(
        F.when(~need_given, True).otherwise(F.coalesce(have >= need, F.lit(False))).alias("passed"),
        F.when(~need_given, 0.0).when(have.isNull(), need).otherwise(have - need).alias("gap"),
    )


def education_check(need, need_rank, have, have_rank) -> Column:
    return F.when(blank(need), True).otherwise(
        F.coalesce(~blank(have) & (have_rank >= need_rank), F.lit(False)))


# --- explanation ---------------------------------------------------------------------

def _say(key: str, **parts: Column) -> Column:
    """A sentence with its placeholders filled from columns."""
    pieces, rest = [], S[key]
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), parts[name]]
    pieces.append(F.lit(rest))
    return F.concat(*pieces)


def _line(test: Column, sentence: Column) -> Column:
    """One-element list where the test holds, else an empty one."""
    return F.when(test, F.array(sentence)).otherwise(X.empty_strings())


def explanation(c: dict[str, Column]) -> Column:
    """Explanation struct of one pair.

    ``c`` holds the matched and missing lists, and the need/have values of
    years, education and seniority. Rules come in a fixed order: required,
    preferred, domain, experience, education, seniority.
    """
    def joined(name):
        return F.array_join(c[name], ", ")

    n_hit, n_miss = F.size(c["matched_required"]), F.size(c["missing_required"])
    n_req = n_hit + n_miss
    has_req = n_req > 0
    all_req = has_req & (n_miss == 0)
    some_req = has_req & (n_miss > 0) & (n_hit * 2 >= n_req)
    few_req = has_req & (n_hit * 2 < n_req)

    p_hit, p_miss = F.size(c["matched_preferred"]), F.size(c["missing_preferred"])
    has_pref = (p_hit + p_miss) > 0
    all_pref, some_pref = has_pref & (p_miss == 0), (p_hit > 0) & (p_miss > 0)
    few_pref = has_pref & (p_hit == 0)

    has_dom = (F.size(c["matched_domains"]) + F.size(c["missing_domains"])) > 0
    hit_dom = F.size(c["matched_domains"]) > 0
    miss_dom = has_dom & ~hit_dom

    need, have = c["need_years"], c["have_years"]
    has_need = need.isNotNull()
    unknown_years = has_need & have.isNull()
    met = F.coalesce(have >= need, F.lit(False))
    short = F.coalesce(have < need, F.lit(False))
    gap = need - have
    years = {"have": X.general_number(have), "need": X.general_number(need)}

    has_edu, edu_known = ~blank(c["need_education"]), ~blank(c["have_education"])
    has_sen, sen_known = ~blank(c["need_seniority"]), ~blank(c["have_seniority"])
    same_sen = has_sen & (X.norm_key(c["need_seniority"]) == X.norm_key(c["have_seniority"]))

    matched, missing = joined("matched_required"), joined("missing_required")
    strengths = [
        _line(all_req, _say("req_all")),
        _line(some_req, _say("req_some", matched=n_hit.cast("string"), total=n_req.cast("string"))),
        _line(~has_req, _say("req_none")),
        _line(all_pref, _say("pref_all")),
        _line(some_pref, _say("pref_some", matched=joined("matched_preferred"))),
        _line(~has_pref, _say("pref_none")),
        _line(hit_dom, _say("dom_match", matched=joined("matched_domains"))),
        _line(~has_dom, _say("dom_none")),
        _line(met, _say("exp_met", **years)),
        _line(~has_need, _say("exp_none")),
        _line(has_edu & edu_known, _say("edu_given", have=c["have_education"])),
        _line(~has_edu, _say("edu_none")),
        _line(same_sen, _say("sen_match", need=c["need_seniority"])),
        _line(~has_sen, _say("sen_none")),
    ]
    points = [
        _line(all_req, _say("req_all_point")),
        _line(some_req, _say("req_some_point")),
        _line(few_req, _say("req_few_point")),
        _line(~has_req, _say("req_none_point")),
        _line(all_pref, _say("pref_all_point")),
        _line(hit_dom, _say("dom_match_point")),
        _line(met, _say("exp_met_point")),
        _line(same_sen, _say("sen_match_point")),
    ]
    gaps = F.concat(
        _line(some_req | few_req, _say("req_gap", missing=missing)),
        _line(miss_dom, _say("dom_gap", missing=joined("missing_domains"))),
        _line(unknown_years, _say("exp_unknown_gap")),
        _line(short, _say("exp_gap", **years)),
        _line(has_edu & ~edu_known, _say("edu_gap")),
    )
    advice = F.concat(
        _line(some_req, _say("req_some_advice", missing=missing)),
        _line(few_req, _say("req_few_advice", missing=missing)),
        _line(some_pref, _say("pref_some_advice", missing=joined("missing_preferred"))),
        _line(few_pref, _say("pref_few_advice", missing=joined("missing_preferred"))),
        _line(miss_dom, _say("dom_advice", missing=joined("missing_domains"))),
        _line(unknown_years, _say("exp_unknown_advice")),
        _line(short & (gap <= 1), _say("exp_small")),
        _line(short & (gap > 1) & (gap <= 3), _say("exp_medium")),
        _line(short & (gap > 3), _say("exp_large")),
        _line(has_edu & ~edu_known, _say("edu_advice")),
        _line(has_sen & ~same_sen & sen_known,
              _say("sen_differs", need=c["need_seniority"], have=c["have_seniority"])),
        _line(has_sen & ~same_sen & ~sen_known, _say("sen_unknown")),
    )
    no_gap = ~((some_req | few_req) | miss_dom | unknown_years | short | (has_edu & ~edu_known))
    summary = (
        F.when(no_gap, S["summary_strong"])
        .when(n_miss > 0, S["summary_required"])
        .otherwise(S["summary_partial"])
    )
    return F.struct(
        summary.alias("recommendation_summary"),
        F.concat(*points).alias("summary_points"),
        F.concat(*strengths).alias("strengths"),
        c["matched_required"].alias("matched_required_skills"),
        c["missing_required"].alias("missing_required_skills"),
        c["matched_preferred"].alias("matched_preferred_skills"),
        c["missing_preferred"].alias("missing_preferred_skills"),
        c["matched_domains"].alias("matched_domains"),
        c["missing_domains"].alias("missing_domains"),
        gaps.alias("gaps"),
        advice.alias("recommendations"),
    )


def with_default_advice(advice: Column) -> Column:
    return F.when(F.size(advice) == 0, F.array(F.lit(S["advice_default"]))).otherwise(advice)
