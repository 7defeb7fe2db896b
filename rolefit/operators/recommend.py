"""Top-k jobs per candidate without looking at every pair.

By definition every job is scored for a candidate and the best k are kept. Three
exact facts make that feasible for many candidates and many jobs:

1. The score depends on a job only through its *signature* (skill and domain
   sets, years, education, seniority), and ties go to the earlier job. So only
   the first k jobs of a signature can ever be recommended, and candidates
   with equal features share one answer. Copies collapse before any join.
2. A pair that shares no skill and no domain scores what its *class* scores
   (years, education, seniority, and which sets are empty). Classes are a small
   fixed vocabulary. Scoring a pair as if it shared nothing never gives more
   than its true score, so the k best jobs by class score are a lower bound:
   the k-th of them is a threshold every other answer has to reach.
3. With each job's items ordered rarest first, the place of the first shared
   item bounds what a pair can reach (a prefix filter). An item's jobs are
   grouped by *shape*: that place, the sizes of their sets, and their class with
   years in whole numbers. What a shape can reach with a class of candidates is
   found once, over both vocabularies. A candidate only meets the shapes of its
   items that reach its threshold: first those with the highest bounds, until
   they hold some jobs, then, with the k-th score of these as the threshold,
   what is left above it.

Preferences that restrict the jobs take the same way. Distinct preferences meet the
distinct values they test, not jobs, and each takes the first k jobs of a
signature among those that pass it; then its candidates choose from these as
others choose from all jobs.

Joins are plain equi-joins on items and shapes. Frequent ones are split on both
sides into blocks (see ``block_join``), so no task gets a hot one whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rolefit.functions import scoring as R
from rolefit.functions import vocab
from rolefit.operators import pairs as P
from rolefit.operators import preferences as Pref
from rolefit.operators.features import CANDIDATE_SIGNATURE, JOB_SIGNATURE
from rolefit.session import merge_join, written
from rolefit.sources.payloads import PREFERENCES

# Rows of one item per block on each side: a block is at most the square of it.
BLOCK_ROWS = 1024
# Scores are rounded to two digits, so a bound may miss by half of the last one.
SLACK = 0.006
# The ``pid`` of groups without a preference that restricts the jobs, and of all jobs.
ANY = -1


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key. Spark limits each group in every task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best_first(order: str) -> list[Column]:
    return [F.desc("score"), F.asc(order)]


# --- signatures ----------------------------------------------------------------------

def _as_key(df: DataFrame) -> DataFrame:
    """Years as text while they are part of a key: a floating-point key is
    normalised by each operator anew, and then shuffled anew."""
    return df.withColumn("j_years", F.col("j_years").cast("string"))


def _as_number(df: DataFrame) -> DataFrame:
    return df.withColumn("j_years", F.col("j_years").cast("double"))


def job_signatures(jobs: DataFrame, signature: list[str], k: int) -> DataFrame:
    """One row per signature: ``sid`` (its first job) and its first k jobs."""
    firsts = top_k(_as_key(jobs.select(*signature, "ord")), signature, [F.asc("ord")], k)
    return _as_number(firsts.groupBy(*signature).agg(
        F.min("ord").alias("sid"), F.sort_array(F.collect_list("ord")).alias("members")))


def with_group(candidates: DataFrame) -> DataFrame:
    """Add ``facets`` (preferences that restrict the jobs, else NULL), the score
    threshold and ``gid``, equal for candidates with equal answers (a threshold
    cuts the end of an answer later)."""
    p = F.col("preferences")
    known = candidates.withColumns({
        "facets": F.when(Pref.restricts_jobs(p), p.dropFields("min_score")),
        "min_score": F.coalesce(p["min_score"], F.lit(0.0)),
    })
    return known.withColumns({"gid": _digest(*CANDIDATE_SIGNATURE, "facets"),
                              "pkey": F.when(F.col("facets").isNotNull(), _digest("facets"))})


def _digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def _expand(best: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best signatures to best jobs: the k best jobs lie in the k best signatures."""
    jobs = best.select(*keys, "score", F.explode("members").alias("ord"))
    return top_k(jobs, keys, _best_first("ord"), k)


# --- classes -------------------------------------------------------------------------

RANK_STATES = [0, -1, 1, 2, 3, 4, 5]  # blank, not a known level, known levels


def _state(value: Column, rank: Column) -> Column:
    return F.when(R.blank(value), 0).otherwise(F.coalesce(rank, F.lit(-1)))


def _from_state(prefix: str, state: str) -> dict[str, Column]:
    s = F.col(state)
    return {prefix: F.when(s != 0, "given"), f"{prefix}_rank": F.when(s > 0, s)}


def job_classes(signatures: DataFrame, k: int) -> DataFrame:
    """One row per preference and class of jobs with its first k jobs."""
    columns = {
        "pid": F.col("pid"),
        "j_need_given": F.col("j_need_given"), "j_years": F.col("j_years"),
        "j_edu_state": _state(F.col("j_edu"), F.col("j_edu_rank")),
        "j_sen_state": _state(F.col("j_sen"), F.col("j_sen_rank")),
        "n_req": F.least(F.size("j_req"), F.lit(1)),
        "n_pref": F.least(F.size("j_pref"), F.lit(1)),
        "n_dom": F.least(F.size("j_dom"), F.lit(1)),
    }
    rows = signatures.select(*[c.alias(n) for n, c in columns.items()],
                             F.explode("members").alias("ord"))
    firsts = top_k(_as_key(rows), list(columns), [F.asc("ord")], k)
    classes = _as_number(firsts.groupBy(*columns).agg(
        F.min("ord").alias("cid"), F.sort_array(F.collect_list("ord")).alias("members")))
    return classes.withColumns({**_from_state("j_edu", "j_edu_state"),
                                **_from_state("j_sen", "j_sen_state")})


CANDIDATE_CLASS = ["pid", "c_years_key", "c_edu_state", "c_sen_state", "n_cand_dom"]


def with_candidate_class(groups: DataFrame) -> DataFrame:
    return groups.withColumns({
        "c_years_key": F.coalesce(F.col("c_years").cast("string"), F.lit("")),
        "c_edu_state": _state(F.col("c_edu"), F.col("c_edu_rank")),
        "c_sen_state": _state(F.col("c_sen"), F.col("c_sen_rank")),
        "n_cand_dom": F.least(F.size("c_dom"), F.lit(1)),
    })


def class_lists(classes: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Best k jobs per preference and candidate class if nothing were shared.

    Each job class is laid out over the fixed levels a candidate can have, which
    makes this an equi-join; both sides are as small as the vocabulary for each
    preference.
    """
    wanted = groups.select(*CANDIDATE_CLASS).distinct()
    laid_out = (
        classes
        .withColumn("c_edu_state", F.explode(F.array(*[F.lit(s) for s in RANK_STATES])))
        .withColumn("c_sen_state", F.explode(F.array(*[F.lit(s) for s in RANK_STATES])))
        .withColumn("n_cand_dom", F.explode(F.array(F.lit(0), F.lit(1))))
    )
    met = merge_join(wanted, laid_out, ["pid", "c_edu_state", "c_sen_state", "n_cand_dom"]).withColumns({
        **_from_state("c_edu", "c_edu_state"), **_from_state("c_sen", "c_sen_state"),
        "c_years": F.col("c_years_key").try_cast("double"),
        "req_hits": F.lit(0), "pref_hits": F.lit(0), "dom_hits": F.lit(0),
    })
    scored = P.score_from_counts(met).select(*CANDIDATE_CLASS, "cid", "members", "score")
    best = top_k(scored, CANDIDATE_CLASS, _best_first("cid"), k)
    return _expand(best, CANDIDATE_CLASS, k).drop("rank")


def thresholds(lists: DataFrame, k: int) -> DataFrame:
    """Score and job of the k-th place per candidate class; below everything where there are fewer than k jobs."""
    full = F.count("*") >= k
    return lists.groupBy(*CANDIDATE_CLASS).agg(
        F.when(full, F.min("score")).otherwise(-1.0).alias("floor"),
        F.when(full, F.max_by("ord", F.struct(-F.col("score"), "ord"))).otherwise(LAST).cast("bigint").alias("floor_ord"))


LAST = (1 << 63) - 1


def _beats_floor(bound: Column, first: Column) -> Column:
    """Whether a job numbered ``first`` or later that scores ``bound`` at most can come before the k-th place.

    Scores have two digits, so a bound less than half a digit above the floor is at best a tie, which the earlier job wins.
    """
    return (bound >= F.col("floor") + 0.004) | ((bound >= F.col("floor") - SLACK) & (first <= F.col("floor_ord")))


# --- items -----------------------------------------------------------------------------

def _blocks(rows: Column) -> Column:
    return F.ceil(rows / F.lit(float(BLOCK_ROWS))).cast("int")


def block_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Equi-join whose frequent keys are cut into blocks on both sides.

    A key with many rows on either side gets a number of blocks from its counts;
    each row belongs to one block of its own side and meets every block of the
    other. Keys on one side only drop out beforehand.
    """
    counts = merge_join(left.groupBy(*keys).agg(F.count("*").alias("__l")),
                        right.groupBy(*keys).agg(F.count("*").alias("__r")), keys)
    counts = counts.select(*keys, _blocks(F.col("__l")).alias("__lb"), _blocks(F.col("__r")).alias("__rb"))

    def blocked(df, own, other, row_id):
        return (merge_join(df, counts, keys)
                .withColumn(f"{own}_no", F.pmod(F.xxhash64(row_id), F.col(own)).cast("int"))
                .withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .drop("__lb", "__rb"))

    # Few bytes can meet in very many pairs, so the number of tasks must not
    # follow the bytes: both sides are laid out over all shuffle partitions.
    on = [*keys, "__lb_no", "__rb_no"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left_blocks = blocked(left, "__lb", "__rb", left_id).repartition(tasks, *on)
    right_blocks = blocked(right, "__rb", "__lb", right_id).repartition(tasks, *on)
    return left_blocks.hint("merge").join(right_blocks, on).drop("__lb_no", "__rb_no")


FAMILIES = {"req": ("j_req", "c_skills"), "pref": ("j_pref", "c_skills"), "dom": ("j_dom", "c_dom")}


def _items(families: dict[str, str]) -> Column:
    """All items of a row as structs of family, item and place in its list."""
    def listed(family, column):
        return F.transform(F.col(column), lambda item, i: F.struct(
            F.lit(family).alias("family"), item.alias("item"), (i + 1).alias("place")))

    return F.concat(*[listed(f, c) for f, c in families.items()])


def by_rarity(signatures: DataFrame) -> DataFrame:
    """Signatures with their item lists ordered rarest first."""
    lists = {family: job for family, (job, _) in FAMILIES.items()}
    items = signatures.select("sid", F.inline(_items(lists)))
    counts = items.groupBy("family", "item").agg(F.count("*").alias("n"))

    def rarest_first(family, column):
        members = F.collect_list(F.when(F.col("family") == family, F.struct("n", "item")))
        return F.sort_array(members)["item"].alias(column)

    ordered = merge_join(items, counts, ["family", "item"]).groupBy("sid").agg(
        *[rarest_first(f, c) for f, c in lists.items()])
    rest = signatures.select("sid", *[c for c in signatures.columns if c not in ("sid", *lists.values())])
    empty = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists.values()}
    return merge_join(rest, ordered, "sid", "left").withColumns(empty)


def job_items(signatures: DataFrame) -> DataFrame:
    """One row per item with what a pair can still reach from there.

    A pair is built at its first shared item: required skills come first, then
    preferred skills, then domains, each rarest first. If that item stands at
    place p of n, at most n - p + 1 items of its list are shared and none of
    the lists before. ``reach`` is the most that skills and domains can then
    add to the score (``reach_no_dom`` for candidates without domains), and
    ``cap`` the limit that holds for it.
    """
    w = {name: 100 * weight for name, weight in vocab.WEIGHTS.items()}
    w_req, w_pref, w_dom = (w["required_skill_score"], w["preferred_skill_score"], w["domain_score"])
    rows = signatures.select("*", F.inline(_items({f: job for f, (job, _) in FAMILIES.items()})))
    n = F.when(F.col("family") == "req", F.col("n_req")).when(
        F.col("family") == "pref", F.col("n_pref")).otherwise(F.col("n_dom"))
    share = (n - F.col("place") + 1) / n
    is_req, is_pref = F.col("family") == "req", F.col("family") == "pref"
    free_req = F.when(F.col("n_req") == 0, w_req).otherwise(0.0)
    free_pref = F.when(F.col("n_pref") == 0, w_pref).otherwise(0.0)
    skills = (
        F.when(is_req, w_req * F.when(share < 0.5, share * 0.75).otherwise(share) + w_pref)
        .when(is_pref, free_req + w_pref * share)
        .otherwise(free_req + free_pref)
    )
    domains = F.when(is_req | is_pref, w_dom).otherwise(w_dom * share)
    no_domains = F.when(F.col("n_dom") > 0, 0.5 * w_dom).otherwise(w_dom)
    cap = (
        F.when(is_req, F.when(share < 0.5, vocab.CAP_FEW_REQUIRED).otherwise(100.0))
        .otherwise(F.when(F.col("n_req") > 0, vocab.CAP_NO_REQUIRED).otherwise(100.0))
    )
    return rows.withColumns({
        "reach": skills + domains, "reach_no_dom": skills + no_domains, "cap": cap})


# --- shapes ----------------------------------------------------------------------------

# Years that shapes and classes tell apart: a shape counts as the step below, a class as the step above or more than all.
YEAR_STEPS, MORE_YEARS = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 13.0, 16.0, 20.0, 30.0, 64.0], 1e12
# Jobs that the shapes opened first hold at least, as a multiple of k.
FIRST_JOBS = 4


def with_shape(items: DataFrame) -> DataFrame:
    """Job items with their ``shape`` and the fields that make it.

    Years are rounded down, as asking for less never lowers a score; what a job can reach is rounded up.
    """
    years = F.lit(0.0)
    for step in YEAR_STEPS:
        years = F.when(F.col("j_years") >= step, step).otherwise(years)
    fields = {
        "s_need": F.col("j_need_given"), "s_years": F.when(F.col("j_years").isNotNull(), years.cast("int")),
        "s_edu": _state(F.col("j_edu"), F.col("j_edu_rank")), "s_sen": _state(F.col("j_sen"), F.col("j_sen_rank")),
        "s_reach": F.ceil(F.col("reach") - 1e-6), "s_reach_no_dom": F.ceil(F.col("reach_no_dom") - 1e-6),
        "s_cap": F.col("cap").cast("int"),
    }
    return items.withColumns(fields).withColumn(
        "shape", F.array_join(F.array(*[F.col(p).cast("string") for p in fields]), "|", ""))


SHAPE = ["s_need", "s_years", "s_edu", "s_sen", "s_reach", "s_reach_no_dom", "s_cap"]


def with_prune_class(groups: DataFrame) -> DataFrame:
    """Groups with ``c_class``; years are rounded up, which never lowers a score either."""
    years = F.lit(MORE_YEARS)
    for step in reversed(YEAR_STEPS):
        years = F.when(F.col("c_years") <= step, step).otherwise(years)
    known = groups.withColumn("c_band", F.when(F.col("c_years").isNotNull(), years))
    parts = [F.col(p).cast("string") for p in ("c_band", "c_edu_state", "c_sen_state", "n_cand_dom")]
    return known.withColumn("c_class", F.array_join(F.array(*parts), "|", ""))


def shape_bounds(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(pid, c_class, shape, bound): the most a pair can score, where it reaches the lowest floor of the class.

    Classes and shapes meet by the fixed levels, as in ``class_lists``. Both are as small as the levels, the whole
    years and the sizes of sets allow for each preference, whatever the number of rows.
    """
    classes = groups.groupBy("pid", "c_class", "c_band", "c_edu_state", "c_sen_state", "n_cand_dom").agg(F.min("floor").alias("least"))
    shapes = items.select("pid", "shape", *SHAPE).distinct()
    laid_out = (
        shapes
        .withColumn("c_edu_state", F.explode(F.array(*[F.lit(s) for s in RANK_STATES])))
        .withColumn("c_sen_state", F.explode(F.array(*[F.lit(s) for s in RANK_STATES])))
        .withColumn("n_cand_dom", F.explode(F.array(F.lit(0), F.lit(1))))
    )
    met = merge_join(classes, laid_out, ["pid", "c_edu_state", "c_sen_state", "n_cand_dom"]).withColumns({
        **_from_state("c_edu", "c_edu_state"), **_from_state("c_sen", "c_sen_state"),
        **_from_state("j_edu", "s_edu"), **_from_state("j_sen", "s_sen"),
        "c_years": F.col("c_band"), "j_need_given": F.col("s_need"), "j_years": F.col("s_years").cast("double"),
        "reach": F.col("s_reach").cast("double"), "reach_no_dom": F.col("s_reach_no_dom").cast("double"),
    })
    bounded = P.settled(met.withColumn("bound", F.least(F.col("s_cap").cast("double"), _most())), "bound")
    return bounded.filter(F.col("bound") >= F.col("least") - SLACK).select("pid", "c_class", "shape", "bound")


def openable(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, family, item, shape, bound, jobs) of the shapes that reach a group's floor."""
    blocks = items.groupBy("pid", "family", "item", "shape").agg(F.count("*").alias("jobs"), F.min("sid").alias("earliest"))
    by_class = merge_join(shape_bounds(items, groups), blocks, ["pid", "shape"])
    asked = candidate_items(groups.select("gid", "pid", "c_class", "floor", "floor_ord", "c_skills", "c_dom"))
    asked = asked.select("gid", "pid", "c_class", "floor", "floor_ord", "family", "item").distinct()
    met = merge_join(asked, by_class, ["pid", "c_class", "family", "item"]).filter(_beats_floor(F.col("bound"), F.col("earliest")))
    return met.select("gid", "family", "item", "shape", "bound", "jobs", "earliest")


def candidate_items(groups: DataFrame) -> DataFrame:
    items = _items({f: have for f, (_, have) in FAMILIES.items()})
    return groups.select("*", F.inline(items)).drop("place")


def _most() -> Column:
    """Upper bound of the score before the cap, one sum with every term once."""
    w = vocab.WEIGHTS
    parts = {
        "experience_score": R.experience_score(F.col("j_need_given"), F.col("j_years"), F.col("c_years")),
        "education_score": R.education_score(F.col("j_edu"), F.col("j_edu_rank"), F.col("c_edu"), F.col("c_edu_rank")),
        "seniority_score": R.seniority_score(F.col("j_sen"), F.col("j_sen_rank"), F.col("c_sen"), F.col("c_sen_rank")),
    }
    profile = 100 * (parts["experience_score"] * w["experience_score"]
                     + parts["education_score"] * w["education_score"]
                     + parts["seniority_score"] * w["seniority_score"])
    return profile + F.when(F.col("n_cand_dom") > 0, F.col("reach")).otherwise(F.col("reach_no_dom"))


def _can_reach_floor() -> Column:
    """The bound against the candidate group's floor, evaluated inside the join before a pair is built."""
    return (F.col("cap") >= F.col("floor")) & _beats_floor(F.least(F.col("cap"), _most()), F.col("sid"))


def _first_shared() -> Column:
    """Whether this is the pair's first shared item, so that it is built once."""
    def first_of(family):
        return F.try_element_at(f"__{family}", F.lit(1)) == F.col("item")

    no_req, no_pref = F.size("__req") == 0, F.size("__pref") == 0
    return (
        F.when(F.col("family") == "req", first_of("req"))
        .when(F.col("family") == "pref", no_req & first_of("pref"))
        .otherwise(no_req & no_pref & first_of("dom")))


def scored_pairs(opened: DataFrame, items: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, pid, sid, score) of the pairs in the opened shapes that reach the group's floor, each at its first shared item."""
    asked = merge_join(opened.select("gid", "family", "item", "shape"), groups, "gid")
    met = block_join(asked, items, ["pid", "family", "item", "shape"], "gid", "sid")
    near = met.filter(_can_reach_floor())
    shared = near.withColumns({f"__{f}": F.array_intersect(job, have)
                               for f, (job, have) in FAMILIES.items()})
    counted = shared.withColumns({
        "__once": _first_shared(), **{f"{f}_hits": F.size(f"__{f}") for f in FAMILIES}})
    once = P.settled(counted, "__once").filter("__once")
    scored = P.settled(P.score_from_counts(once), "score").filter(_beats_floor(F.col("score"), F.col("sid")))
    return scored.select("gid", "pid", "sid", "score")


def sharing_pairs(features: DataFrame, signatures: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Best k signatures per candidate group among the pairs that share an item and
    can reach the group's floor."""
    sized = by_rarity(features.withColumnRenamed("jid", "sid")).withColumns({
        "n_req": F.size("j_req"), "n_pref": F.size("j_pref"), "n_dom": F.size("j_dom")})
    shaped = with_shape(job_items(sized)).withColumnRenamed("sid", "jid")
    items = written(merge_join(signatures.select("pid", "jid", "sid"), shaped, "jid").drop("jid"), "items")
    classed = written(with_prune_class(groups), "classed")
    highest = Window.partitionBy("gid").orderBy(F.desc("bound"), "family", "item", "shape")
    before = F.sum("jobs").over(highest.rowsBetween(Window.unboundedPreceding, -1))
    rows = written(openable(items, classed).withColumn("first", F.coalesce(before, F.lit(0)) < FIRST_JOBS * k), "openable")
    found = written(top_k(scored_pairs(rows.filter("first"), items, classed), ["gid"], _best_first("sid"), k), "first-pairs")
    kth = F.max(F.struct((-F.col("score")).alias("down"), F.col("sid").alias("ord")))
    reached = found.groupBy("gid").agg(F.when(F.count("*") >= k, kth).alias("kth"))
    # The better of both k-th places.
    both = merge_join(classed, reached, "gid", "left").withColumn(
        "kth", F.least("kth", F.struct((-F.col("floor")).alias("down"), F.col("floor_ord").alias("ord"))))
    raised = both.withColumns({"floor": -F.col("kth.down"), "floor_ord": F.col("kth.ord")}).drop("kth")
    left = merge_join(rows.filter(~F.col("first")), raised.select("gid", "floor", "floor_ord"), "gid")
    rest = scored_pairs(left.filter(_beats_floor(F.col("bound"), F.col("earliest"))), items, raised)
    best = top_k(found.drop("rank").unionByName(rest), ["gid"], _best_first("sid"), k)
    return merge_join(best.drop("rank"), signatures.select("pid", "sid", "members"), ["sid", "pid"])


# --- recommendations ---------------------------------------------------------------------

def preference_table(groups: DataFrame) -> DataFrame:
    """(pid, pkey, facets): the distinct preferences that restrict the jobs, numbered."""
    asked = groups.filter(F.col("pkey").isNotNull()).select("pkey", "facets").distinct()
    return written(asked.withColumn("pid", F.monotonically_increasing_id()), "preferences")


def passing_values(preferences: DataFrame, values: DataFrame) -> DataFrame:
    """(pid, fkey) of the values of jobs, distinct ones named by ``fkey``, that pass a preference.

    A preference is looked up by the keys of one of its tests; the other tests follow in the same step.
    """
    keyed_preferences = preferences.withColumn("keys", Pref.preference_keys(F.col("facets"))).select(
        "*", F.explode("keys").alias("key"))
    keyed_values = Pref.with_job_keys(values, keyed_preferences.select("key").distinct())
    met = block_join(keyed_preferences, keyed_values, ["key"], "pid", "fkey")
    # Values may carry several keys of one preference: they are taken at the first.
    first_key = F.try_element_at(F.filter("keys", Pref.key_fits_job), F.lit(1))
    passing = met.filter(Pref.job_passes(F.col("facets"))).filter(F.col("key") == first_key)
    return passing.select("pid", "fkey")


def preferred_signatures(jobs: DataFrame, preferences: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """All signatures (``jid``), and (pid, jid, sid, members): the first k jobs of each among those that pass a
    preference, or among all for ``ANY``."""
    named = job_signatures(jobs, [*JOB_SIGNATURE, *Pref.FACETS], k).withColumns({
        "jkey": _digest(*JOB_SIGNATURE), "fkey": _digest(*Pref.FACETS, "j_dom")})
    named = written(named, "faceted")
    numbers = named.groupBy("jkey").agg(F.min("sid").alias("jid"))
    listed = written(merge_join(named.select("jkey", "fkey", "sid", "members"), numbers, "jkey").drop("jkey"), "listed")
    passing = written(passing_values(preferences, named.select("fkey", *Pref.FACETS, "j_dom").distinct()), "passing")
    met = block_join(passing, listed, ["fkey"], "pid", "sid").select("pid", "jid", "members")
    every = met.unionByName(listed.select(F.lit(ANY).cast("bigint").alias("pid"), "jid", "members"))
    firsts = top_k(every.select("pid", "jid", F.explode("members").alias("ord")), ["pid", "jid"], [F.asc("ord")], k)
    signatures = firsts.groupBy("pid", "jid").agg(
        F.min("ord").alias("sid"), F.sort_array(F.collect_list("ord")).alias("members"))
    features = merge_join(numbers.select("jid"), named.select(F.col("sid").alias("jid"), *JOB_SIGNATURE), "jid")
    return written(features, "features"), signatures


def best_jobs(features: DataFrame, signatures: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(gid, ord, rank): top k over the jobs of each group's ``pid``.

    ``features`` are the signatures by ``jid``, ``signatures`` the first jobs of each for a ``pid``.
    """
    signatures = written(merge_join(signatures, features, "jid"), "signatures")
    lists = written(class_lists(job_classes(signatures, k), groups, k), "class-lists")
    floored = merge_join(groups, thresholds(lists, k), CANDIDATE_CLASS)
    shared = _expand(sharing_pairs(features, signatures, floored, k), ["gid"], k).drop("rank")
    by_class = merge_join(groups.select("gid", *CANDIDATE_CLASS), lists, CANDIDATE_CLASS).select(
        "gid", "score", "ord")
    # A job found both ways counts with its true score, the higher one.
    each = shared.unionByName(by_class).groupBy("gid", "ord").agg(F.max("score").alias("score"))
    return top_k(each, ["gid"], _best_first("ord"), k).drop("score")


# fixed values: limits of a request
MAX_TOP_K = 100
DEFAULT_TOP_K = 10


def recommend(jobs: DataFrame, candidates: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Top-k jobs per candidate with score, filters and explanation.

    ``jobs`` come from ``match_jobs`` with a unique ``ord``, ``candidates`` from
    ``match_candidates``, with a ``preferences`` struct if they have any.
    Filters, components and explanations (``full_result``) are made for the
    survivors only, once per candidate group.
    """
    if not 1 <= k <= MAX_TOP_K:
        raise ValueError(f"top_k must be 1..{MAX_TOP_K}")
    with_preferences = "preferences" in candidates.columns
    if not with_preferences:
        candidates = candidates.withColumn("preferences", F.lit(None).cast(PREFERENCES))
    prepared = candidates.withColumn("preferences", Pref.prepared(F.col("preferences")))
    people = written(with_candidate_class(with_group(prepared)).drop("preferences"), "candidates")
    groups = written(people.drop("candidate_id", "min_score").distinct(), "groups")
    # Several steps read the jobs, which are worked out once.
    jobs = written(Pref.with_facets(jobs) if with_preferences else jobs, "jobs")
    free = groups.filter(F.col("pkey").isNull()).drop("facets", "pkey").withColumn("pid", F.lit(ANY).cast("bigint"))
    if with_preferences:
        preferences = preference_table(groups)
        bound = merge_join(groups.drop("facets"), preferences.select("pkey", "pid"), "pkey").drop("pkey")
        features, signatures = preferred_signatures(jobs, preferences, k)
        chosen = best_jobs(features, signatures, written(free.unionByName(bound), "asked"), k)
    else:
        signatures = written(job_signatures(jobs, JOB_SIGNATURE, k).withColumn("jid", F.col("sid")), "listed")
        all_jobs = signatures.select(F.lit(ANY).cast("bigint").alias("pid"), "jid", "sid", "members")
        chosen = best_jobs(signatures.select("jid", *JOB_SIGNATURE), all_jobs, free, k)
    met = merge_join(written(chosen, "chosen"), groups.select("gid", *CANDIDATE_SIGNATURE), "gid")
    pairs = merge_join(met, jobs, "ord")
    told = P.with_explanation(P.with_hard_filters(P.with_score(pairs)))
    rows = told.select(
        "gid", "rank", "ord", "job_id", "title", "company", "location", "workplace_type",
        "score", "fit_label", "hard_filters_passed",
        F.col("explanation.matched_required_skills").alias("matched_required_skills"),
        F.col("explanation.missing_required_skills").alias("missing_required_skills"),
        F.col("explanation.recommendations").alias("recommendations"),
        F.struct("job_id", *P.result_columns()).alias("full_result"),
    )
    for_people = people.select("candidate_id", "gid", "min_score")
    if with_preferences:
        # A threshold cuts the end of a list: the order does not depend on it.
        matched = merge_join(for_people, P.settled(rows, "score"), "gid").filter(F.col("score") >= F.col("min_score"))
    else:
        matched = merge_join(for_people, rows, "gid")
    return matched.drop("gid", "min_score")
