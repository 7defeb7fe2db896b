"""The registered queries: each runs one operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rolefit import fixtures as fx
from rolefit.functions import extraction as E
from rolefit.functions import normalise as N
from rolefit.functions import text as X
from rolefit.functions import vocab
from rolefit.operators import curate as C
from rolefit.operators import dedup as D
from rolefit.operators import enrich as En
from rolefit.operators import evaluation as Ev
from rolefit.operators import features as Fe
from rolefit.operators import pairs as P
from rolefit.operators import preferences as Pref
from rolefit.operators import recommend as Rec
from rolefit.operators import staging as St
from rolefit.operators import taxonomy as Tx
from rolefit.plans import pipelines as Plan
from rolefit.session import counted, fresh_path, merge_join, prepare
from rolefit.sources import datasets as Ds
from rolefit.sources import feeds
from rolefit.sources import payloads as Pay
from rolefit.sources import users as U

INGESTED_AT = "2026-04-06T03:18:32+00:00"
RUN_TS = "2026-04-06T03-18-32"
VERSION = "1.0.0"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# fixed values: queries that explain every pair
EXPLAINED = {"match_explanations", "match_pairs"}


def query(fn: Query) -> Query:
    @wraps(fn)
    def prepared(spark, sf_dir):
        prepare(spark, fn.__name__ in EXPLAINED)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = prepared
    return prepared


def flat(name: str, alias: str | None = None) -> Column:
    """A list column as one text, for comparison across engines."""
    return F.array_join(name, "|").alias(alias or name.split(".")[-1])


# --- shared inputs ---------------------------------------------------------------------

def match_jobs(spark, sf_dir):
    return Fe.match_jobs(fx.jobs(spark, sf_dir))


def features(spark, sf_dir):
    return Fe.candidate_features(Fe.parse_candidates(fx.candidate_payloads(spark, sf_dir)))


def match_candidates(spark, sf_dir):
    return Fe.match_candidates(features(spark, sf_dir))


def pairs(spark, sf_dir):
    return P.requested_pairs(fx.match_requests(spark, sf_dir), match_jobs(spark, sf_dir),
                             match_candidates(spark, sf_dir))


def staged_a(spark, sf_dir):
    return St.postprocess(St.stage_feed_a(fx.feed_a(spark, sf_dir), INGESTED_AT, VERSION))


def staged_b(spark, sf_dir):
    return St.postprocess(St.stage_feed_b(fx.feed_b(spark, sf_dir), INGESTED_AT, VERSION))


def staging(spark, sf_dir):
    return St.unify(staged_a(spark, sf_dir), staged_b(spark, sf_dir))


def texts(spark, sf_dir):
    """Posting text as extraction sees it, with title."""
    rows = C.normalize_postings(staging(spark, sf_dir))
    return rows.select("job_uid", En.posting_title(rows).alias("title"),
                       E.lowered(En.posting_text(rows)).alias("text"))


# --- text ------------------------------------------------------------------------------

@query
def clean_text_docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query
def normalize_text_basic_docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", X.normalize_text_basic(F.col("text")).alias("normalized"))


@query
def stable_hash_docs(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.stable_hash(F.col("text")).alias("hash"))


@query
def html_text_pages(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query
def html_references(spark, sf_dir):
    """Pages with character references of all kinds, one of them on each page."""
    page = F.concat("html", F.lit("<p>.</p>"), fx.pick(list(fx.REFERENCES), F.col("page_id")))
    return fx.table(spark, sf_dir, "pages").select("page_id", X.html_to_text(page).alias("text"))


@query
def clean_html_pages(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", X.clean_html(F.col("html")).alias("text"))


@query
def first_years_postings(spark, sf_dir):
    return staging(spark, sf_dir).select(
        "job_uid", X.first_years_of_experience(F.col("description_clean")).alias("years"))


@query
def list_functions(spark, sf_dir):
    """List normalisation, merging, cell parsing, JSON text and comma text on candidate lists."""
    df = fx.candidate_payloads(spark, sf_dir).withColumn("cell", F.array_join("skills", " ,"))
    return df.select(
        "candidate_id",
        F.array_join(X.item_set(F.col("skills")), "|").alias("item_set"),
        F.array_join(X.clean_items(F.col("skills")), "|").alias("items"),
        F.array_join(X.merge_unique(F.col("domains"), F.col("tools")), "|").alias("merged"),
        F.array_join(X.cell_list(F.col("cell")), "|").alias("cell_items"),
        F.array_join(X.cell_list(X.list_to_json(F.col("tools"))), "|").alias("json_cell_items"),
        F.array_join(X.json_to_list(X.list_to_json(F.col("projects"))), "|").alias("json_round_trip"),
        X.join_list(X.comma_list(F.col("cell"))).alias("comma_text"),
    )


# --- matching ---------------------------------------------------------------------------

@query
def match_scores(spark, sf_dir):
    scored = P.with_score(pairs(spark, sf_dir))
    return scored.select("candidate_id", "job_id", *P.rounded_components(), "score", "fit_label")


@query
def hard_filters(spark, sf_dir):
    return P.with_hard_filters(pairs(spark, sf_dir)).select(
        "candidate_id", "job_id", "required_skills_total",
        flat("required_skills_matched"), flat("required_skills_missing"), "skills_passed",
        "experience_passed", "experience_gap", "education_passed", "hard_filters_passed")


@query
def fit_label_counts(spark, sf_dir):
    scored = P.with_score(pairs(spark, sf_dir))
    return scored.groupBy("fit_label").agg(
        F.count("*").alias("n_pairs"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


# fixed values: names of the lists of an explanation
EXPLANATION_LISTS = [
    "summary_points", "strengths", "matched_required_skills", "missing_required_skills",
    "matched_preferred_skills", "missing_preferred_skills", "matched_domains", "missing_domains",
    "gaps", "recommendations"]


@query
def match_explanations(spark, sf_dir):
    told = P.with_explanation(pairs(spark, sf_dir))
    return told.select(
        "candidate_id", "job_id", F.col("explanation.recommendation_summary").alias("recommendation_summary"),
        *[flat(f"explanation.{name}") for name in EXPLANATION_LISTS])


@query
def match_pairs(spark, sf_dir):
    """The whole nested result per requested pair."""
    result = P.match_result(pairs(spark, sf_dir))
    return result.select(
        "job_id", "candidate_id", F.col("hard_filters.passed").alias("passed"),
        F.col("hard_filters.skill_check.passed").alias("skill_passed"),
        F.col("hard_filters.experience_check.gap").alias("experience_gap"),
        F.col("match_score.score").alias("score"), F.col("match_score.fit_label").alias("fit_label"),
        F.col("match_score.component_scores.experience_score").alias("experience_score"),
        F.col("match_score.weights.required_skill_score").alias("required_weight"),
        F.col("explanation.recommendation_summary").alias("recommendation_summary"),
        flat("explanation.gaps"))


@query
def preference_filter(spark, sf_dir):
    """Requested pairs that pass the candidate's preferences."""
    prefs = fx.preferences(spark, sf_dir)
    jobs = Pref.with_facets(match_jobs(spark, sf_dir))
    candidates = merge_join(match_candidates(spark, sf_dir), prefs, "candidate_id", "left")
    candidates = candidates.withColumn("preferences", Pref.prepared(F.col("preferences")))
    scored = P.with_score(P.requested_pairs(fx.match_requests(spark, sf_dir), jobs, candidates))
    return Pref.preference_filter(scored, F.col("preferences")).select("candidate_id", "job_id", "score")


# fixed values: columns of a recommendation
RECOMMENDATION = ["candidate_id", "rank", "job_id", "title", "company", "location", "workplace_type",
                  "score", "fit_label", "hard_filters_passed"]


def _recommendation(df):
    return df.select(*RECOMMENDATION, flat("matched_required_skills"),
                     flat("missing_required_skills"), flat("recommendations"))


@query
def recommend_topk(spark, sf_dir):
    """Ten best jobs of every candidate, over all jobs."""
    return _recommendation(Rec.recommend(match_jobs(spark, sf_dir), match_candidates(spark, sf_dir), 10))


@query
def recommend_preferences(spark, sf_dir):
    """Five best jobs of every candidate among those the preferences allow."""
    candidates = merge_join(match_candidates(spark, sf_dir), fx.preferences(spark, sf_dir), "candidate_id", "left")
    return _recommendation(Rec.recommend(match_jobs(spark, sf_dir), candidates, 5))


@query
def recommend_full_result(spark, sf_dir):
    """The nested results of the two best jobs of every candidate."""
    best = Rec.recommend(match_jobs(spark, sf_dir), match_candidates(spark, sf_dir), 2)
    r = "full_result"
    return best.select(
        "candidate_id", "rank", f"{r}.job_id", f"{r}.hard_filters.passed", f"{r}.hard_filters.skill_check.required_skills_total",
        flat(f"{r}.hard_filters.skill_check.required_skills_missing"), F.col(f"{r}.hard_filters.experience_check.gap").alias("experience_gap"),
        f"{r}.hard_filters.education_check.job_education", f"{r}.match_score.component_scores.*", flat(f"{r}.explanation.gaps"),
        f"{r}.explanation.recommendation_summary")


@query
def recommend_limited_jobs(spark, sf_dir):
    """Three best of the first 150 jobs."""
    out = Plan.recommend_from_dataset(fx.jobs(spark, sf_dir), fx.candidate_payloads(spark, sf_dir), top_k=3, limit_jobs=150)
    return out.select("candidate_id", "rank", "job_id", "score")


# --- ingestion ------------------------------------------------------------------------------

def _staging_columns(df, drop=()):
    lists = {n for n, kind in df.dtypes if kind.startswith("array")}
    return df.select(*[flat(n) if n in lists else F.col(n) for n in df.columns if n not in drop])


@query
def staging_feed_a(spark, sf_dir):
    return _staging_columns(staged_a(spark, sf_dir), ("ord",))


@query
def staging_feed_b(spark, sf_dir):
    return _staging_columns(staged_b(spark, sf_dir), ("ord",))


@query
def metadata_flatten(spark, sf_dir):
    return fx.feed_a(spark, sf_dir).select("id", St.flatten_metadata(F.col("metadata")).alias("metadata_raw"))


@query
def staging_dedup(spark, sf_dir):
    deduped = D.dedup_staging(fx.with_copies(staging(spark, sf_dir)))
    return deduped.select("ord", "job_uid", "source", "source_company", "source_job_id", "dedupe_key")


@query
def dedup_documents(spark, sf_dir):
    """First document per equal cleaned text."""
    docs = fx.table(spark, sf_dir, "documents").withColumn("hash", X.stable_hash(F.col("text")))
    return D.keep_first(docs, ["hash"], "doc_id").select("doc_id", "hash", "source", "text")


@query
def run_summary(spark, sf_dir):
    raw_a, raw_b = fx.feed_a(spark, sf_dir), fx.feed_b(spark, sf_dir)
    raw = (raw_a.select(F.lit(feeds.FEED_A).alias("source_type"), F.col("board").alias("source_name"))
           .unionByName(raw_b.select(F.lit(feeds.FEED_B).alias("source_type"),
                                     F.col("board").alias("source_name"))))
    silent = spark.createDataFrame([(feeds.FEED_A, "board_silent")], "source_type string, source_name string")
    boards = raw.distinct().unionByName(silent).withColumn("raw_snapshot_path", F.concat_ws(
        "/", F.lit("raw"), F.lit(RUN_TS), "source_type", "source_name"))
    staged = St.unify(St.stage_feed_a(raw_a, INGESTED_AT, VERSION), St.stage_feed_b(raw_b, INGESTED_AT, VERSION))
    return St.run_summary(boards, raw, staged)


@query
def raw_snapshot_round_trip(spark, sf_dir):
    """Both feeds written as raw snapshots, read back and staged."""
    base = fresh_path(spark, "raw")
    feeds.write_raw_snapshot(fx.feed_a(spark, sf_dir), base, feeds.FEED_A, RUN_TS)
    feeds.write_raw_snapshot(fx.feed_b(spark, sf_dir), base, feeds.FEED_B, RUN_TS)
    raw_a = feeds.read_raw_snapshot(spark, base, feeds.FEED_A, RUN_TS)
    raw_b = feeds.read_raw_snapshot(spark, base, feeds.FEED_B, RUN_TS)
    staged = St.unify(St.postprocess(St.stage_feed_a(raw_a, INGESTED_AT, VERSION)),
                      St.postprocess(St.stage_feed_b(raw_b, INGESTED_AT, VERSION)))
    return staged.select("ord", "job_uid", "title_raw", "description_hash", "metadata_raw")


@query
def stage_row_counts(spark, sf_dir):
    """Rows of each stage of the pipeline, observed while the stage is written for the next one."""
    rows, staged = counted(fx.with_copies(staging(spark, sf_dir)), "staged")
    deduped, kept = counted(D.dedup_staging(rows), "deduplicated")
    _, curated = counted(C.curate(deduped), "curated")
    counts = [("staged", staged), ("deduplicated", kept), ("curated", curated)]
    return spark.createDataFrame(counts, "stage string, n_rows bigint")


# --- curation ---------------------------------------------------------------------------------

@query
def title_normalization(spark, sf_dir):
    rows = staging(spark, sf_dir).select("job_uid", "title_raw")
    return rows.select("job_uid", F.col("title_raw"), N.title_record(F.col("title_raw")).alias("t")).select(
        "job_uid", "title_raw", "t.*")


@query
def location_normalization(spark, sf_dir):
    rows = staging(spark, sf_dir).select(
        "job_uid", X.normalize_location_text(F.col("location_raw")).alias("location_normalized"))
    rows = rows.withColumn("country", N.country(F.col("location_normalized")))
    return rows.withColumn("region", N.region(F.col("country")))


@query
def workplace_type(spark, sf_dir):
    return staging(spark, sf_dir).select(
        "job_uid", N.workplace(F.col("location_raw"), F.col("description_clean")).alias("w")
    ).select("job_uid", "w.*")


@query
def curated_jobs(spark, sf_dir):
    return C.curate(staging(spark, sf_dir)).drop("ord")


@query
def curated_dedup(spark, sf_dir):
    """Curation of a table that holds the same postings several times."""
    return C.curate(fx.with_copies(staging(spark, sf_dir))).select("ord", "job_uid", "curated_record_hash")


# --- extraction ---------------------------------------------------------------------------------

@query
def section_split(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "job_uid", E.section_requirements(F.col("text")).alias("requirements"),
        E.section_preferred(F.col("text")).alias("preferred"), F.col("text").alias("other"))


@query
def skill_hits(spark, sf_dir):
    """Hits per posting, skill and label in the whole text."""
    rows = E.with_hits(texts(spark, sf_dir), "hits", F.col("text"), collapsed=True)
    return E.hit_rows(rows, "hits", "job_uid").groupBy("job_uid", "skill", "label").agg(F.count("*").alias("n_hits"))


@query
def skill_hits_by_table(spark, sf_dir):
    """The same hits, with the taxonomy as a table that the words of the texts are joined with."""
    taxonomy = spark.createDataFrame([(s, a) for s, names in vocab.SKILL_ALIASES.items() for a in names], "skill string, alias string")
    rows = Tx.with_hits(texts(spark, sf_dir).drop("title"), "hits", F.col("text"), taxonomy, collapsed=True)
    return E.hit_rows(rows, "hits", "job_uid").groupBy("job_uid", "skill", "label").agg(F.count("*").alias("n_hits"))


@query
def skills_required_preferred(spark, sf_dir):
    rows = E.with_skills(texts(spark, sf_dir), "text", collapsed=True)
    return rows.select("job_uid", flat("required_skills"), flat("preferred_skills"), flat("other_skills_found"))


@query
def years_experience(spark, sf_dir):
    return texts(spark, sf_dir).select("job_uid", E.years_of_experience(F.col("text")).alias("years"))


@query
def education_min(spark, sf_dir):
    return texts(spark, sf_dir).select("job_uid", E.education_required(F.col("text")).alias("education"))


@query
def seniority_inferred(spark, sf_dir):
    years = E.years_of_experience(F.col("text"))
    rows = texts(spark, sf_dir).withColumn("years", years)
    return rows.select("job_uid", E.posting_seniority(
        F.col("title"), F.col("text"), F.col("years")).alias("seniority"))


# fixed values: columns of an enriched posting
ENRICHED = ["job_uid", "title_normalized", "years_experience_extracted", "education_extracted",
            "seniority_inferred"]


@query
def enriched_jobs(spark, sf_dir):
    rows = En.enrich(C.curate(staging(spark, sf_dir)))
    return rows.select(*ENRICHED, flat("required_skills"), flat("preferred_skills"),
                       flat("other_skills_found"))


# --- candidates and users -------------------------------------------------------------------------

@query
def candidate_parse(spark, sf_dir):
    parsed = Fe.parse_candidates(fx.candidate_payloads(spark, sf_dir))
    return _staging_columns(parsed)


@query
def candidate_parse_text(spark, sf_dir):
    """The same profiles given as text: delimited lists, years as words."""
    raw = fx.candidate_payloads(spark, sf_dir)
    as_text = raw.withColumns({
        **{n: F.array_join(n, " / ") for n in Fe.LIST_FIELDS},
        "years_experience": F.concat(F.lit("about "), "years_experience", F.lit(".5 years")),
    })
    return _staging_columns(Fe.parse_candidates(as_text))


@query
def candidate_features(spark, sf_dir):
    return _staging_columns(features(spark, sf_dir))


@query
def skill_term_normalize(spark, sf_dir):
    """Free skill terms of candidates to canonical skills."""
    c = F.regexp_extract("candidate_id", "[0-9]+", 0).cast("bigint")
    terms = F.array(F.initcap(fx.pick(fx.ALIASES, c)), F.upper(fx.pick(fx.ALIASES, 3 * c + 1)),
                    fx.pick(["Power-BI", "Cobol  85", "C++", "rest, api"], c), fx.pick(fx.SKILLS, c))
    return fx.candidate_payloads(spark, sf_dir).select(
        "candidate_id", F.array_join(N.normalize_skill_terms(terms), "|").alias("skills"))


def _profile_changes(spark, sf_dir):
    """One change per order of a user: the profile as saved with that order."""
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    profiles = fx.candidate_payloads(spark, sf_dir)
    changes = orders.withColumn("candidate_id", fx.candidate_id(F.col("o_custkey"))).join(
        profiles, "candidate_id")
    return changes.withColumns({
        "user_id": F.col("o_custkey"), "updated_at": F.col("o_orderdate"), "ord": F.col("o_orderkey"),
        "years_experience": F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 61).cast("int")),
        "summary": F.concat(F.lit("  "), fx.pick(["draft", "", "final"], F.col("o_orderkey"))),
    }).drop("o_orderkey", "o_custkey", "o_orderdate")


@query
def profile_upsert(spark, sf_dir):
    """Profiles after two saves into a bucketed store, the later half of the changes onto the earlier half.

    Every seventh change is sent twice, and every eleventh again without its time and number.
    """
    changes = U.profile_rows(_profile_changes(spark, sf_dir))
    early = F.col("updated_at") < F.lit("1996-01-01").cast("timestamp")
    untimed = changes.filter("ord % 11 = 0").withColumns({
        "updated_at": F.lit(None).cast(changes.schema["updated_at"].dataType), "ord": F.lit(None).cast("bigint")})
    path = fresh_path(spark, "profiles")
    U.save(path, changes.filter(early).unionByName(changes.filter(early & (F.col("ord") % 7 == 0))))
    U.save(path, changes.filter(~early).unionByName(untimed))
    return U.read_store(spark, path).drop("updated_at", "bucket")


@query
def profile_lookup(spark, sf_dir):
    """Stored profiles loaded for every user who ever ordered."""
    stored = U.bucketed(U.upsert(None, U.profile_rows(_profile_changes(spark, sf_dir))))
    users = U.bucketed(fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct())
    return _staging_columns(U.load_profiles(stored, users), ("updated_at",))


def _preference_changes(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    prefs = fx.preferences(spark, sf_dir).select("candidate_id", "preferences.*")
    changes = orders.withColumn("candidate_id", fx.candidate_id(F.col("o_custkey"))).join(
        prefs, "candidate_id", "left")
    return changes.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderkey").alias("ord"), "preferred_titles", "preferred_locations",
        "preferred_workplace_types", "preferred_domains", "preferred_seniority",
        ((F.col("o_orderkey") % 4) * 25).cast("int").alias("min_score"))


@query
def preference_upsert(spark, sf_dir):
    return U.upsert(None, U.preference_rows(_preference_changes(spark, sf_dir))).drop("updated_at")


@query
def preference_lookup(spark, sf_dir):
    stored = U.upsert(None, U.preference_rows(_preference_changes(spark, sf_dir)))
    return _staging_columns(U.load_preferences(stored), ("updated_at",))


# --- datasets and payloads ------------------------------------------------------------------------

@query
def match_ready_jobs(spark, sf_dir):
    """Enriched postings as the matching endpoints read them."""
    enriched = En.lists_as_json(En.enrich(C.curate(staging(spark, sf_dir))))
    return _staging_columns(Ds.match_ready(enriched), ("ord",))


@query
def jobs_preview(spark, sf_dir):
    jobs = Ds.match_ready(fx.jobs(spark, sf_dir))
    return Ds.preview(jobs, 20).select("ord", "job_id", "title", flat("required_skills"))


@query
def payload_violations(spark, sf_dir):
    """Constraint violations of saved-profile payloads."""
    changed = _profile_changes(spark, sf_dir).withColumns({
        "years_experience": (F.col("ord") % 67 - 3).cast("int"),
        "full_name": F.repeat("full_name", (F.col("ord") % 8).cast("int")),
    })
    checked = Pay.with_violations(changed, ["candidate_id"], Pay.PROFILE_RANGES, Pay.PROFILE_LENGTHS)
    return checked.select("ord", flat("violations"))


@query
def recommend_from_latest(spark, sf_dir):
    """Two runs of a dataset are stored, the second one twice; the latest is read, made match-ready and ranked."""
    base = fresh_path(spark, "jobs")
    jobs = fx.jobs(spark, sf_dir)
    older = jobs.withColumn("required_skills", X.empty_strings())
    for run_ts, rows in [("2026-04-05T00-00-00", older), (RUN_TS, older), (RUN_TS, jobs)]:
        Ds.write_version(rows, base, run_ts)
    out = Plan.recommend_from_dataset(Ds.read_latest(spark, base), fx.candidate_payloads(spark, sf_dir), top_k=3)
    return out.select("candidate_id", "rank", "job_id", "score", "fit_label")


@query
def stored_pipeline(spark, sf_dir):
    """Feeds to recommendations through the stored stages, with postings that stand on two boards."""
    base = fresh_path(spark, "pipeline")
    paths = Plan.run_ingestion(fx.feed_a_on_two_boards(spark, sf_dir), fx.feed_b(spark, sf_dir), base, RUN_TS, INGESTED_AT, VERSION)
    Plan.run_curation(spark, paths["staging"], f"{base}/curated", RUN_TS)
    Plan.run_extraction(spark, f"{base}/curated", f"{base}/enriched", RUN_TS)
    out = Plan.recommend_from_dataset(Ds.read_latest(spark, f"{base}/enriched"), fx.candidate_payloads(spark, sf_dir), top_k=2)
    return out.select("candidate_id", "job_id", "rank", "score")


@query
def dataset_text_formats(spark, sf_dir):
    """A dataset written and read back as CSV and as JSON."""
    jobs = fx.jobs(spark, sf_dir).select(
        "job_id", "title", "location", "required_skills", F.col("years_experience_required").alias("years"))
    out = []
    for fmt, items in [("csv", "STRING"), ("json", "ARRAY<STRING>")]:
        base = fresh_path(spark, fmt)
        Ds.write_version(jobs, base, RUN_TS, fmt)
        back = Ds.read_latest(spark, base, fmt, f"job_id STRING, title STRING, location STRING, required_skills {items}, years BIGINT")
        skills = X.json_to_list(F.col("required_skills")) if fmt == "csv" else F.col("required_skills")
        out.append(back.select(F.lit(fmt).alias("format"), "job_id", "title", F.coalesce("location", F.lit("")).alias("location"),
                               F.array_join(skills, "|").alias("required_skills"), "years"))
    return out[0].unionByName(out[1])


@query
def newest_dataset_scan(spark, sf_dir):
    """Of the datasets in two folders the one written last, as the matching endpoints read it."""
    base, jobs = fresh_path(spark, "folders"), fx.jobs(spark, sf_dir)
    Ds.write_version(jobs.withColumn("required_skills", X.empty_strings()), f"{base}/curated", "2026-09-01T00-00-00")
    Ds.write_version(jobs, f"{base}/enriched", RUN_TS)
    newest = Ds.newest_dataset(spark, [f"{base}/curated", f"{base}/enriched", f"{base}/absent"])
    return Ds.match_ready(Ds.read_run(spark, newest)).select("job_id", "title", flat("required_skills"))


@query
def job_payload_scan(spark, sf_dir):
    """Job payloads from a file of JSON lines, some of them broken: rows per list of violations."""
    jobs = fx.jobs(spark, sf_dir)
    titled = jobs.withColumn("title", F.when(F.col("ord") % 10 != 5, F.col("title")))
    line = F.to_json(F.struct(*[c for c in jobs.columns if c != "ord"]))
    path = fresh_path(spark, "payloads")
    titled.select(F.when(F.col("ord") % 10 == 3, F.left(line, F.lit(12))).otherwise(line)).write.text(path)
    checked = Pay.job_payloads(spark, path).select(flat("violations"))
    return checked.groupBy("violations").agg(F.count("*").alias("n_rows"))


@query
def landed_payloads(spark, sf_dir):
    """Both feeds landed as response files, wrapped and bare in turn, read back in their order and staged."""
    base, order = fresh_path(spark, "landed"), Window.partitionBy("source", "source_company").orderBy("ord")
    staged = []
    for feed, rows, stage in [(feeds.FEED_A, fx.feed_a(spark, sf_dir), St.stage_feed_a), (feeds.FEED_B, fx.feed_b(spark, sf_dir), St.stage_feed_b)]:
        feeds.land_payloads(rows, f"{base}/{feed}", feed, 500, wrapped=F.col("page").cast("bigint") % 2 == 0)
        staged.append(St.postprocess(stage(feeds.read_payloads(spark, f"{base}/{feed}", feed), INGESTED_AT, VERSION)))
    return St.unify(*staged).select(
        "job_uid", "title_raw", "description_hash", "metadata_raw", F.row_number().over(order).cast("bigint").alias("place"))


@query
def payload_quarantine(spark, sf_dir):
    """Payloads of every kind, some of them broken: rows accepted, rejected, and quarantined for each reason."""
    base = fresh_path(spark, "settled")
    out = []
    for kind, lines in fx.payload_lines(spark, sf_dir).items():
        path = f"{base}/landed/{kind}"
        lines.write.text(path)
        kept, lost = Pay.settle(spark, path, kind, base)
        counts = spark.createDataFrame([("accepted", kept), ("rejected", lost)], "reason string, n_rows bigint")
        reasons = Pay.quarantined(spark, base, kind).select(F.explode("violations").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))
        out.append(counts.unionByName(reasons).select(F.lit(kind).alias("kind"), "reason", "n_rows"))
    return reduce(DataFrame.unionByName, out)


# --- evaluation -------------------------------------------------------------------------------------

def _eval_rows(spark, sf_dir):
    jobs = fx.jobs(spark, sf_dir)
    predicted = jobs.select(F.col("ord").alias("id"), F.col("required_skills").alias("predicted"))
    truth = jobs.select((F.col("ord") - 1).alias("id"), F.col("required_skills").alias("truth"))
    return Ev.with_prf(Ev.zip_by_id(predicted, truth), "predicted", "truth")


@query
def extraction_prf(spark, sf_dir):
    return _eval_rows(spark, sf_dir).select("id", "precision", "recall", "f1")


@query
def extraction_macro(spark, sf_dir):
    return Ev.macro_average(_eval_rows(spark, sf_dir))


@query
def label_accuracy(spark, sf_dir):
    """Score labels of requested pairs against the hard filter verdict as label."""
    df = P.with_hard_filters(P.with_score(pairs(spark, sf_dir)))
    return Ev.label_accuracy(df.select(
        F.col("fit_label").alias("predicted_label"),
        F.when(F.col("hard_filters_passed"), "Strong Fit").otherwise("Weak Fit").alias("true_label")))


@query
def label_accuracy_documents(spark, sf_dir):
    labels = fx.table(spark, sf_dir, "labels")
    return Ev.label_accuracy(labels.select(
        F.col("quality").cast("string").alias("predicted_label"),
        (1 - F.col("toxic")).cast("string").alias("true_label")))
