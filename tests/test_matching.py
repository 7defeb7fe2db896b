import random

import pytest
from pyspark.sql import functions as F

from rolefit.functions import scoring as R
from rolefit.functions import vocab
from rolefit.operators import features as Fe
from rolefit.operators import pairs as P
from rolefit.operators import preferences as Pref
from rolefit.operators import recommend as Rec
from rolefit.sources.payloads import PREFERENCES


def number(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize("need,have,expected", [
    (5, 4, .8), (5, 3, .54), (5, 2, .5), (10, 6, .45), (4, 1, .5), (2, 1, .75), (0, 0, 1.0), (None, 2, 1.0), (3, None, 0.0),
])
def test_experience_score(value, need, have, expected):
    got = value(lambda: R.experience_score(F.lit(need is not None), number(need), number(have)))
    assert round(got, 12) == expected


def rank(table, v):
    return F.lit(table.get(v)).cast("int")


@pytest.mark.parametrize("need,have,expected", [
    ("phd", "bachelor", .3), ("master", "bachelor", .65), ("phd", "high_school", 0.0), ("Master in CS", "master", .5),
    (None, None, 1.0), ("phd", None, 0.0),
])
def test_education_score(value, need, have, expected):
    got = value(lambda: R.education_score(F.lit(need).cast("string"), rank(vocab.EDUCATION_RANK, need),
                                          F.lit(have).cast("string"), rank(vocab.EDUCATION_RANK, have)))
    assert round(got, 12) == expected


@pytest.mark.parametrize("need,have,expected", [
    ("manager", "intern", 0.0), ("senior", "mid", .6), ("lead", "senior", .5), ("senior", None, .5), ("junior", "entry", 1.0),
])
def test_seniority_score(value, need, have, expected):
    got = value(lambda: R.seniority_score(F.lit(need).cast("string"), rank(vocab.SENIORITY_RANK, need),
                                          F.lit(have).cast("string"), rank(vocab.SENIORITY_RANK, have)))
    assert round(got, 12) == expected


@pytest.mark.parametrize("raw,expected", [("6.5", 6), ("-3", 3), ("about ten", None), ("", None)])
def test_candidate_years_from_text(value, raw, expected):
    assert value(lambda c: Fe.years_level(c, False), raw) == expected


def test_candidate_years_from_numbers(value):
    assert value(lambda: Fe.years_level(F.lit(-3), True)) == 0
    assert value(lambda: Fe.years_level(F.lit(None).cast("int"), True)) is None


@pytest.mark.parametrize("raw,expected", [("Master in CS", None), (" MBA ", "master"), ("PhD", "phd"), ("", None)])
def test_candidate_education(value, raw, expected):
    assert value(Fe.education_level, raw) == expected


def candidates(spark, rows):
    """Candidate payload dicts to prepared candidates."""
    names = Fe.CANDIDATE_INPUT.names
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], Fe.CANDIDATE_INPUT)
    return Fe.match_candidates(Fe.candidate_features(Fe.parse_candidates(df)))


def jobs(spark, rows):
    names = Fe.JOB_INPUT.names
    df = spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)],
                               "ord bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in Fe.JOB_INPUT))
    return Fe.match_jobs(df)


DEMO_CANDIDATE = {
    "candidate_id": "cand_1", "full_name": "A B", "current_title": "Data Scientist", "years_experience": 2,
    "education": "Master", "skills": ["Python", "SQL", "machine learning"], "tools": ["git"], "domains": ["ai"],
}


def test_one_pair_in_full(spark):
    job = {"job_id": "j1", "title": "Analyst", "required_skills": ["python", "excel"], "preferred_skills": ["git"],
           "years_experience_required": 3, "education_required": "Master in CS", "seniority": "mid", "domains": ["retail"]}
    pair = spark.createDataFrame([("cand_1", "j1")], "candidate_id string, job_id string")
    df = P.match_result(P.requested_pairs(pair, jobs(spark, [job]), candidates(spark, [DEMO_CANDIDATE])))
    r = df.first().asDict(recursive=True)
    assert r["hard_filters"]["passed"] is False
    assert r["hard_filters"]["experience_check"]["gap"] == -1.0
    assert r["hard_filters"]["education_check"]["passed"] is False
    # .38*.5 + .12*1 + .2*.75 + .08*.5 + .12*.6 + .1*0
    assert r["match_score"]["score"] == 57.2 and r["match_score"]["fit_label"] == "Partial Fit"
    assert r["match_score"]["weights"] == vocab.WEIGHTS
    e = r["explanation"]
    assert e["recommendation_summary"] == "Candidate has important required-skill gaps for this role."
    assert e["summary_points"] == ["Partial required-skill alignment.", "Strong preferred-skill alignment."]
    assert e["strengths"] == ["Candidate matches 1 out of 2 required skills.", "Candidate matches all preferred skills.",
                              "Candidate education is provided (master)."]
    assert e["gaps"] == ["Missing required skills: excel",
                         "Candidate does not show direct domain alignment with: retail.",
                         "Experience gap: candidate has 2 years vs required 3."]
    assert e["recommendations"] == [
        "Highlight or develop missing required skills: excel.", "Add projects or experience related to: retail.",
        "Experience gap is small; strengthen the application with strong project evidence.",
        "Review seniority fit: job expects mid, candidate profile shows entry."]


def test_cap_without_required_skill(spark):
    job = {"job_id": "j", "title": "T", "required_skills": ["excel", "dbt"]}
    pair = spark.createDataFrame([("cand_1", "j")], "candidate_id string, job_id string")
    r = P.with_score(P.requested_pairs(pair, jobs(spark, [job]), candidates(spark, [DEMO_CANDIDATE]))).first()
    assert (r["score"], r["fit_label"]) == (45.0, "Weak Fit")


def test_default_advice(spark):
    pair = spark.createDataFrame([("cand_1", "j")], "candidate_id string, job_id string")
    df = P.with_explanation(P.requested_pairs(pair, jobs(spark, [{"job_id": "j", "title": "T"}]),
                                              candidates(spark, [DEMO_CANDIDATE])))
    assert df.first()["explanation"]["recommendations"] == [vocab.SENTENCES["advice_default"]]


def test_unreadable_requirement(spark):
    df = spark.createDataFrame([(0, "j", "T", "many")], "ord bigint, job_id string, title string, years_experience_required string")
    pair = spark.createDataFrame([("cand_1", "j")], "candidate_id string, job_id string")
    r = P.with_hard_filters(P.with_score(P.requested_pairs(pair, Fe.match_jobs(df), candidates(spark, [DEMO_CANDIDATE])))).first()
    assert (r["experience_score"], r["experience_passed"], r["experience_gap"]) == (0.0, False, None)


def test_listed_requirement_wins_over_extracted(spark):
    df = spark.createDataFrame([("u", "x", None, 4, "", "phd", "mid", "senior")],
                               "job_uid string, job_id string, years_experience_required int, years_experience_extracted int, "
                               "education_required string, education_extracted string, seniority string, seniority_inferred string")
    r = Fe.match_jobs(df).first()
    assert (r["job_id"], r["j_years"], r["j_edu"], r["j_sen"]) == ("u", 4.0, "phd", "mid")


# --- recommendations against brute force ------------------------------------------------

def random_jobs(rng, n, skills):
    def some(values, most):
        return rng.sample(values, rng.randint(0, min(most, len(values))))

    rows = []
    for i in range(n):
        rows.append({
            "job_id": f"j{i}", "title": rng.choice(["Data Engineer", "ML engineer ", "Clerk", "Ünit Lead", ""]) or "X",
            "location": rng.choice(["Paris", "berlin ", "", "Remote"]), "workplace_type": rng.choice(["remote", "Onsite", "", None]),
            "domains": some(["ai", "retail", "health"], 2), "required_skills": some(skills, 4),
            "preferred_skills": some(skills, 3), "years_experience_required": rng.choice([None, 0, 1, 3, 5, 8]),
            "education_required": rng.choice([None, "", "bachelor", "phd", "Master in CS"]),
            "seniority": rng.choice([None, "junior", "mid", "principal", "manager"])})
    # A third of the jobs are copies of one job.
    return rows + [dict(rows[0], job_id=f"copy{i}") for i in range(n // 2)]


def random_candidates(rng, n, skills):
    rows = []
    for i in range(n):
        rows.append({
            "candidate_id": f"c{i}", "current_title": rng.choice(["", "Senior dev", "Clerk"]),
            "education": rng.choice([None, "bachelor", "mba", "phd"]), "years_experience": rng.choice([None, 0, 2, 5, 12]),
            "skills": rng.sample(skills + ["cobol"], rng.randint(0, min(5, len(skills)))),
            "tools": rng.sample(skills, rng.randint(0, min(2, len(skills)))),
            "domains": rng.sample(["ai", "retail", "space"], rng.randint(0, 2)), "seniority": rng.choice([None, "mid", "lead"])})
    return rows + [dict(rows[0], candidate_id=f"same{i}") for i in range(n // 3)]


def brute_force(spark, j, c, k):
    """Every pair scored, filtered and ranked (small fixture only)."""
    scored = P.with_score(c.crossJoin(Pref.with_facets(j)))
    if "preferences" in c.columns:
        scored = Pref.preference_filter(scored, F.col("preferences"))
    rows = sorted(((r["candidate_id"], -r["score"], r["ord"]) for r in scored.collect()))
    out, taken = [], {}
    for cand, neg, ord_ in rows:
        taken[cand] = taken.get(cand, 0) + 1
        if taken[cand] <= k:
            out.append((cand, taken[cand], ord_, -neg))
    return out


def ranked(df):
    return sorted((r["candidate_id"], r["rank"], r["ord"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("seed,k,blocks", [(1, 3, 1024), (2, 10, 2), (3, 1, 7), (4, 100, 16)])
def test_recommendations_equal_brute_force(spark, monkeypatch, seed, k, blocks):
    monkeypatch.setattr(Rec, "BLOCK_ROWS", blocks)
    rng = random.Random(seed)
    skills = ["python", "sql", "excel", "git", "dbt", "spark", "azure"]
    j = jobs(spark, random_jobs(rng, 60, skills))
    c = candidates(spark, random_candidates(rng, 30, skills))
    assert ranked(Rec.recommend(j, c, k)) == brute_force(spark, j, c, k)


def test_weak_thresholds_and_years_of_any_size(spark):
    """Every job requires something, so classes give low thresholds and the first shapes have to raise them."""
    rng = random.Random(21)
    skills = ["python", "sql", "excel", "git", "dbt", "spark"]
    rows = [dict(r, required_skills=r["required_skills"] or [rng.choice(skills)], years_experience_required=rng.choice([7, 11, 63, 64, 65, 400, -2, None]))
            for r in random_jobs(rng, 50, skills)]
    people = [dict(r, years_experience=rng.choice([None, 0, 7, 12, 64, 65, 390, 1000])) for r in random_candidates(rng, 25, skills)]
    j, c = jobs(spark, rows), candidates(spark, people)
    for k in (2, 8):
        assert ranked(Rec.recommend(j, c, k)) == brute_force(spark, j, c, k)


def test_few_jobs_and_no_jobs(spark):
    rng = random.Random(9)
    c = candidates(spark, random_candidates(rng, 5, ["sql"]))
    two = jobs(spark, [
        {"job_id": "a", "title": "A", "required_skills": ["sql"]}, {"job_id": "b", "title": "B", "domains": ["ai"]}])
    assert ranked(Rec.recommend(two, c, 10)) == brute_force(spark, two, c, 10)
    assert Rec.recommend(two.filter("false"), c, 10).count() == 0


def random_preferences(rng):
    def maybe(values):
        return rng.choice([[], [], [rng.choice(values)], rng.sample(values, 2) + [" "]])

    return (maybe(["ENGINEER", "ml", "x", "ünit"]), maybe(["paris", "Berlin", "remote"]), maybe(["remote", "onsite"]),
            maybe(["AI", "health"]), rng.choice([None, "", " Mid", "junior"]), rng.choice([None, 0, 30, 46, 70]))


@pytest.mark.parametrize("seed,blocks", [(5, 1024), (6, 3)])
def test_preferred_recommendations_equal_brute_force(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(Rec, "BLOCK_ROWS", blocks)
    rng = random.Random(seed)
    skills = ["python", "sql", "excel", "git", "dbt"]
    j = jobs(spark, random_jobs(rng, 50, skills))
    people = random_candidates(rng, 40, skills)
    prefs = [(p["candidate_id"], random_preferences(rng)) for p in people if rng.random() < 0.8]
    schema = f"candidate_id string, preferences {PREFERENCES.simpleString()}"
    c = candidates(spark, people).join(spark.createDataFrame(prefs, schema), "candidate_id", "left")
    expected = brute_force(spark, j, c.withColumn("preferences", Pref.prepared(F.col("preferences"))), 4)
    assert ranked(Rec.recommend(j, c, 4)) == expected


def test_candidates_of_one_preference_do_not_each_meet_all_values(spark, monkeypatch):
    """24 kinds of candidates with one wish, and 60 jobs of one signature with a title each: the wish meets the titles once."""
    met, join = [], Rec.block_join

    def counted(left, right, keys, left_id, right_id):
        out = join(left, right, keys, left_id, right_id)
        met.append(out.count())
        return out

    monkeypatch.setattr(Rec, "block_join", counted)
    j = jobs(spark, [{"job_id": f"j{i}", "title": f"Title {i}", "workplace_type": "remote", "required_skills": ["sql"]} for i in range(60)])
    people = [{"candidate_id": f"c{i}", "skills": ["sql"] if i % 2 else ["git"], "years_experience": i} for i in range(24)]
    wish = [(p["candidate_id"], ([], [], ["Remote"], [], None, 10 * (i % 7))) for i, p in enumerate(people)]
    schema = f"candidate_id string, preferences {PREFERENCES.simpleString()}"
    c = candidates(spark, people).join(spark.createDataFrame(wish, schema), "candidate_id", "left")
    expected = brute_force(spark, j, c.withColumn("preferences", Pref.prepared(F.col("preferences"))), 3)
    assert ranked(Rec.recommend(j, c, 3)) == expected
    assert sum(met) < 24 * 60 / 4


def test_score_range_and_order_of_input_rows(spark):
    rng = random.Random(11)
    rows = random_jobs(rng, 40, ["sql", "git"])
    c = candidates(spark, random_candidates(rng, 10, ["sql", "git"]))
    j = jobs(spark, rows)
    scores = [r["score"] for r in P.with_score(c.crossJoin(j)).collect()]
    assert min(scores) >= 0 and max(scores) <= 100
    assert ranked(Rec.recommend(j.orderBy(F.rand(3)), c, 5)) == ranked(Rec.recommend(j, c, 5))


def test_top_k_limits(spark):
    with pytest.raises(ValueError):
        Rec.recommend(None, None, 0)
    with pytest.raises(ValueError):
        Rec.recommend(None, None, 101)


def test_requested_pairs_keep_lists_and_broadcast_nothing(spark):
    from rolefit.operators import pairs as P

    lists = [["a", "b"], [], None, [""], ["x\x1fy", "z"], ["a", None], ["", "q"]]
    candidates = spark.createDataFrame([(f"c{i}", v, 1.0) for i, v in enumerate(lists)], "candidate_id string, c_skills array<string>, c_years double")
    jobs = spark.createDataFrame([("j", ["a"])], "job_id string, j_req array<string>")
    requests = spark.createDataFrame([(f"c{i}", "j") for i in range(len(lists))], "candidate_id string, job_id string")
    out = P.requested_pairs(requests, jobs, candidates)
    assert {r["candidate_id"]: r["c_skills"] for r in out.collect()} == {f"c{i}": v for i, v in enumerate(lists)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" not in plan
