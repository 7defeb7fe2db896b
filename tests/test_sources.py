import json

import pytest
from pyspark.sql import functions as F

from rolefit import fixtures as fx
from rolefit.operators import dedup as D
from rolefit.operators import evaluation as Ev
from rolefit.operators import features as Fe
from rolefit.operators import staging as St
from rolefit.plans import pipelines as Plan
from rolefit.sources import datasets as Ds
from rolefit.sources import feeds
from rolefit.sources import payloads as Pay
from rolefit.sources import users as U
from tests.conftest import SF


POST_A = {"id": 7, "absolute_url": "http://x/7", "title": " Data\tEngineer ", "content": "<p>R&amp;D</p>",
          "location": None, "departments": [], "offices": None, "updated_at": "2026-01-01",
          "metadata": [{"name": "b", "value": 1}, {"name": "", "value": 2}, {"name": None, "value": 3},
                       {"name": "a", "value": ["x", None]}, {"name": "b", "value": {"k": "v"}}]}
POST_B = {"id": "p1", "text": "Clerk", "hostedUrl": "http://y/p1", "createdAt": 1700000000123,
          "descriptionPlain": " one ", "additionalPlain": "  ", "listsPlain": "two",
          "categories": {"location": "Rome", "commitment": None}}


def test_feed_a_payload_wrapped_and_bare(spark, tmp_path):
    (tmp_path / "greenhouse_acme_jobs_raw_2026.json").write_text(json.dumps({"jobs": [POST_A, dict(POST_A, id=None)]}, indent=1))
    (tmp_path / "greenhouse_two_words_jobs_raw_2026.json").write_text(json.dumps([POST_A]))
    (tmp_path / "greenhouse_none_jobs_raw_2026.json").write_text("[]")
    rows = feeds.read_payloads(spark, str(tmp_path), feeds.FEED_A)
    staged = St.postprocess(St.stage_feed_a(rows, "now", "1")).orderBy("job_uid").collect()
    assert [r["job_uid"] for r in staged] == ["greenhouse::acme::7", "greenhouse::acme::None", "greenhouse::two_words::7"]
    first = staged[0]
    assert (first["title_raw"], first["description_clean"], first["location_raw"], first["department"]) == (
        "Data Engineer", "R&D", "", "")
    assert first["metadata_raw"] == '{"a":["x",null],"b":{"k":"v"}}'
    assert staged[1]["source_job_id"] == "" and staged[0]["ord"] < staged[1]["ord"]
    assert len(St.STAGING_COLUMNS) == 40


def test_feed_b_payload(spark, tmp_path):
    (tmp_path / "lever_acme_jobs_raw_2026.json").write_text(json.dumps([POST_B, {"id": "p2"}]))
    staged = St.postprocess(St.stage_feed_b(feeds.read_payloads(spark, str(tmp_path), feeds.FEED_B), "now", "1"))
    one, two = staged.orderBy("job_uid").collect()
    assert (one["description_clean"], one["source_updated_at"], one["metadata_raw"], one["employment_type"]) == (
        "one two", "1700000000123", '{"location":"Rome"}', "")
    assert (two["title_raw"], two["metadata_raw"], two["source_url"]) == ("", "{}", "")


def test_dedup_two_steps_in_order(spark):
    # Row 2 falls to row 1 by its ids; only then does row 3 keep its dedupe key from row 2.
    rows = [(1, "u", "s", "c", "1", "k1"), (2, "u", "s", "c", "1", "k2"), (3, "v", "s", "c", "2", "k2"),
            (4, "w", "s", "c", None, "k3"), (5, "w", "s", "c", None, "k4"), (6, "x", "s", "c", "6", "k1")]
    df = spark.createDataFrame(rows, "ord bigint, job_uid string, source string, source_company string, "
                                     "source_job_id string, dedupe_key string")
    kept = D.dedup_staging(df)
    assert sorted(r["ord"] for r in kept.collect()) == [1, 3, 4]
    assert sorted(r["ord"] for r in D.dedup_staging(kept).collect()) == [1, 3, 4]
    no_keys = D.dedup_staging(df.drop("source_job_id"))
    assert sorted(r["ord"] for r in no_keys.collect()) == [1, 2, 4, 5]


def test_pipeline_end_to_end(spark, tmp_path):
    base = str(tmp_path)
    paths = Plan.run_ingestion(fx.feed_a(spark, SF), fx.feed_b(spark, SF), base, "2026-04-06T03-18-32", "t", "1.0.0")
    staging, summary = (Ds.read_latest(spark, paths[n]) for n in ("staging", "run_summary"))
    n = staging.count()
    assert summary.agg(F.sum("records_fetched"), F.sum("records_normalized")).first()[:] == (250, 250) and n == 250
    path = summary.first()["raw_snapshot_path"]
    assert spark.read.text(path).count() == summary.first()["records_fetched"]
    Plan.run_curation(spark, paths["staging"], f"{base}/curated", "r1")
    Plan.run_extraction(spark, f"{base}/curated", f"{base}/enriched", "r2")
    enriched = Ds.read_latest(spark, f"{base}/enriched")
    assert enriched.count() == n and set(enriched.columns) >= {"required_skills", "curated_record_hash"}
    newest = Ds.newest_dataset(spark, [f"{base}/curated", f"{base}/enriched", f"{base}/absent"])
    assert newest.endswith("run_ts=r2")
    people = fx.candidate_payloads(spark, SF)
    best = Plan.recommend_from_dataset(spark.read.parquet(newest), people, top_k=2, limit_jobs=20)
    assert best.count() == 2 * people.count()
    pairs = best.select("candidate_id", "job_id")
    jobs = Ds.match_ready(spark.read.parquet(newest))
    assert Plan.match(pairs, jobs, people).count() == best.count()


def test_text_datasets_keep_values(spark, tmp_path):
    rows = [("a", 'say "hi", x\ny', ["p", 'q"'], None), ("b", "", [], "é")]
    df = spark.createDataFrame(rows, "id string, t string, l array<string>, u string")
    Ds.write_version(df, f"{tmp_path}/csv", "r1", "csv")
    back = Ds.read_latest(spark, f"{tmp_path}/csv", "csv", "id string, t string, l string, u string")
    got = {r["id"]: r for r in back.collect()}
    assert got["a"]["t"] == 'say "hi", x\ny' and json.loads(got["a"]["l"]) == ["p", 'q"'] and got["b"]["u"] == "é"
    Ds.write_version(df, f"{tmp_path}/json", "r1", "json")
    Ds.write_version(df.filter("id = 'b'"), f"{tmp_path}/json", "r2", "json")
    assert Ds.read_latest(spark, f"{tmp_path}/json", "json", "id string, t string, l array<string>, u string").count() == 1
    with pytest.raises(ValueError):
        Ds.read_latest(spark, f"{tmp_path}/json", "json")


def test_latest_version_reads_one_folder(spark, tmp_path):
    for run in ["2026-01-01", "2026-01-02", "2026-01-02", "2026-01-03"]:
        Ds.write_version(spark.range(5), f"{tmp_path}/d", run)
    (tmp_path / "d" / "run_ts=2026-01-03" / "_SUCCESS").unlink()  # as if its writing had not ended
    latest = Ds.read_latest(spark, f"{tmp_path}/d")
    assert latest.count() == 5 and {f.split("/")[-2] for f in latest.inputFiles()} == {"run_ts=2026-01-02"}
    with pytest.raises(FileNotFoundError):
        Ds.read_latest(spark, str(tmp_path))


def test_rerun_replaces_the_run(spark, tmp_path):
    rows = fx.feed_a(spark, SF)
    for part in (rows, rows.filter("board <> 'board_1'")):
        feeds.write_raw_snapshot(part, f"{tmp_path}/raw", feeds.FEED_A, "r1")
        assert feeds.read_raw_snapshot(spark, f"{tmp_path}/raw", feeds.FEED_A, "r1").count() == part.count()


def test_positions_restart_on_each_board(spark, tmp_path):
    """Rows of two boards with equal positions stay apart; a copy inside a board and one across boards go."""
    def post(board, pos, uid, title):
        return (board, pos, uid, f"http://x/{title}", "2026", title, "<p>sql required</p>", None, None, [], [])

    rows = [post("b", 0, 1, "one"), post("b", 1, 2, "two"), post("b", 2, 1, "one"), post("a", 0, 3, "three"), post("a", 1, 4, "two")]
    kinds = ("board string, pos bigint, id bigint, absolute_url string, updated_at string, title string, content string, "
             "location struct<name:string>, metadata array<struct<name:string,value:string>>, departments array<struct<name:string>>, "
             "offices array<struct<name:string>>")
    df = spark.createDataFrame(rows, kinds).withColumn("metadata", F.expr(
        "transform(metadata, m -> struct(m.name AS name, cast(m.value AS variant) AS value))"))
    base = str(tmp_path)
    paths = Plan.run_ingestion(df, None, base, "r1", "t", "1")
    staged = Ds.read_latest(spark, paths["staging"]).orderBy("ord").collect()
    assert [r["job_uid"].split("::", 1)[1] for r in staged] == ["a::3", "a::4", "b::1"] and len({r["ord"] for r in staged}) == 3
    boards = spark.createDataFrame([("greenhouse", "b", 0), ("greenhouse", "a", 1)], "source_type string, source_name string, board_rank bigint")
    paths = Plan.run_ingestion(df, None, base, "r2", "t", "1", boards)
    staged = Ds.read_latest(spark, paths["staging"]).orderBy("ord").collect()
    assert [r["job_uid"].split("::", 1)[1] for r in staged] == ["b::1", "b::2", "a::3"]
    best = Plan.recommend_from_dataset(Ds.read_latest(spark, paths["staging"]), fx.candidate_payloads(spark, SF).limit(1), top_k=2)
    assert sorted(r["rank"] for r in best.collect()) == [1, 2]


def test_missing_dataset(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Ds.newest_dataset(spark, [f"{tmp_path}/nothing"])
    with pytest.raises(FileNotFoundError):
        Ds.newest_dataset(spark, [], f"{tmp_path}/nothing")


def test_match_ready_first_existing_column_decides(spark):
    df = spark.createDataFrame(
        [("u1", " T ", None, "['sql']", None, 5), ("u2", "", "norm", "a, b", 2.0, 5), ("", "x", "y", None, None, 1)],
        "job_uid string, title_raw string, title_normalized string, required_skills string, "
        "years_experience_required double, years_experience_extracted int")
    rows = Ds.match_ready(df).orderBy("job_id").collect()
    assert [(r["job_id"], r["title"], r["required_skills"], r["years_experience_required"]) for r in rows] == [
        ("u1", "T", ["sql"], None), ("u2", "norm", ["a", "b"], 2)]
    assert rows[0]["domains"] == [] and rows[0]["company"] == "" and rows[0]["ord"] != rows[1]["ord"]


def test_payload_scan(spark, tmp_path):
    good = {"candidate_id": "c", "full_name": "n", "current_title": "t", "location": "l", "years_experience": 3}
    lines = [good, dict(good, years_experience=-1), {"candidate_id": "d"}]
    (tmp_path / "c.json").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    checked = Pay.candidate_payloads(spark, str(tmp_path)).cache()
    assert Pay.valid_rows(checked).count() == 1
    found = {tuple(r["violations"]) for r in Pay.rejected_rows(checked).collect()}
    assert ("years_experience below 0",) in found and len(found) == 3
    prefs = spark.createDataFrame([(101,), (0,)], "min_score int")
    assert Pay.rejected_rows(Pay.with_violations(prefs, ranges=Pay.PREFERENCE_RANGES)).count() == 1


def test_upsert_tie_and_default_threshold(spark):
    schema = ("user_id bigint, updated_at string, ord bigint, preferred_titles array<string>, preferred_locations array<string>, "
              "preferred_workplace_types array<string>, preferred_domains array<string>, preferred_seniority string, min_score int")
    rows = [(1, "2026-01-01", 1, ["a"], None, [], [], " ", 10), (1, "2026-01-01", 2, ["b"], None, [], [], " mid ", 0),
            (2, "2026-01-02", 3, [], [], [], [], None, None)]
    stored = U.upsert(None, U.preference_rows(spark.createDataFrame(rows, schema)))
    got = {r["user_id"]: r for r in U.load_preferences(stored).collect()}
    assert (got[1]["preferred_titles"], got[1]["preferred_seniority"], got[1]["min_score"]) == (["b"], "mid", 50)
    assert (got[2]["min_score"], got[2]["preferred_locations"]) == (50, [])
    asked = spark.createDataFrame([(2,), (9,)], "user_id bigint")
    assert [r["user_id"] for r in U.load_preferences(stored, asked).collect()] == [2]


SAVES = "user_id bigint, updated_at string, ord bigint, name string"
ROWS = [
    (1, "2026-01-02", 5, "same"), (1, "2026-01-02", 5, "same"), (1, "2026-01-01", 9, "older"), (2, "2026-01-01", 1, "a"), (2, "2026-01-01", 1, "b"),
    (3, None, 7, "no time"), (3, None, 8, "later"), (4, "2026-01-01", None, "no number"), (5, None, None, None), (5, None, None, None),
    (6, "2026-01-01", None, "no number"), (6, "2026-01-01", 0, "number"), (None, "2026-01-01", 1, "no user")]


def test_one_row_per_user_whatever_is_repeated(spark):
    got = [tuple(r) for r in U.last_write(spark.createDataFrame(ROWS, SAVES)).collect()]
    assert sorted(r[0] or 0 for r in got) == [0, 1, 2, 3, 4, 5, 6]
    by = {r[0]: r[3] for r in got}
    assert (by[1], by[3], by[4], by[5], by[6], by[None]) == ("same", "later", "no number", None, "number", "no user")
    again = [tuple(r) for r in U.last_write(spark.createDataFrame(ROWS[::-1], SAVES).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_a_save_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "store")
    U.save(path, spark.createDataFrame(ROWS, SAVES), buckets=8)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").glob("bucket=*/*.parquet")}
    change = spark.createDataFrame([(2, "2026-02-01", 1, "new"), (2, "2025-01-01", 1, "stale")], SAVES)
    U.save(path, change, buckets=8)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "store").glob("bucket=*/*.parquet")}
    assert len(set(before) - set(after)) == 1 and len(set(before) & set(after)) == len(before) - 1
    got = U.read_store(spark, path).drop("bucket")
    want = U.last_write(spark.createDataFrame(ROWS, SAVES).unionByName(change))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    U.save(path, spark.createDataFrame([], SAVES), buckets=8)
    assert U.read_store(spark, path).count() == 7


def test_bucketed_lookup_moves_no_row(spark):
    stored = U.bucketed(U.last_write(spark.createDataFrame(ROWS, SAVES)), buckets=4)
    asked = U.bucketed(spark.createDataFrame([(2,), (9,), (6,)], "user_id bigint"), buckets=4)
    found = U.asked_rows(stored, asked)
    assert sorted(r["user_id"] for r in found.collect()) == [2, 6]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_keep_first_with_repeated_and_missing_numbers(spark):
    rows = [(1, "t", "x"), (1, "t", "x"), (None, "t", "x"), (None, "t", "y"), (2, "t", "x"), (2, "u", "x"), (None, "v", "a"), (None, "v", "a"), (3, None, "n"), (4, None, "n")]
    got = D.keep_first(spark.createDataFrame(rows, "ord bigint, text string, more string"), ["text"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "t", "x"), (2, "u", "x"), (None, "v", "a"), (3, None, "n")], key=repr)


def test_published_evaluation_figures(spark):
    rows = [(1, ["python", "sql", "pandas"], ["python", "sql", "pandas", "git"]), (2, ["aws", "docker"], ["aws", "azure"])]
    df = Ev.with_prf(spark.createDataFrame(rows, "id int, p array<string>, t array<string>"), "p", "t")
    assert [tuple(r[-3:]) for r in df.orderBy("id").collect()] == [(1.0, .75, .8571), (.5, .5, .5)]
    assert tuple(Ev.macro_average(df).first()) == (.75, .625, .6785)
    labels = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "b")], "predicted_label string, true_label string")
    assert tuple(Ev.label_accuracy(labels).first()) == (.6667, 3, 2)


def test_evaluation_edges(spark):
    rows = [(1, [], []), (2, None, ["a"]), (3, ["a"], []), (4, [" A "], ["a"])]
    df = Ev.with_prf(spark.createDataFrame(rows, "id int, p array<string>, t array<string>"), "p", "t")
    assert [tuple(r[-3:]) for r in df.orderBy("id").collect()] == [(1, 1, 1), (0, 0, 0), (0, 0, 0), (1, 1, 1)]
    assert tuple(Ev.macro_average(df.filter("false")).first()) == (None, None, None)
    empty = spark.createDataFrame([], "predicted_label string, true_label string")
    assert tuple(Ev.label_accuracy(empty).first()) == (None, 0, 0)


def test_candidate_features(spark):
    df = spark.createDataFrame([(None, "VP of Sales", 3, ["Git", "sql"], ["SQL", "excel"], " Hello\n")],
                               "candidate_id string, current_title string, years_experience int, skills array<string>, "
                               "tools array<string>, summary string")
    r = Fe.candidate_features(Fe.parse_candidates(df)).first()
    assert (r["candidate_id"], r["seniority"], r["seniority_rank"], r["skills"], r["keyword_blob"]) == (
        "candidate_001", "manager", 5, ["git", "sql", "excel"], "vp of sales hello git sql excel")


def test_settled_payloads(spark, tmp_path):
    lines = ['{"candidate_id": "a", "top_k": 5}', '{"candidate_id": "b", "top_k": 0, "limit_jobs": 0}', '{"candidate_id": "c", "top_k": "x"}', "{broken", '{"top_k": 100}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text("\n".join(lines))
    base = str(tmp_path / "out")
    for _ in range(2):  # settling again replaces
        assert Pay.settle(spark, str(tmp_path / "in"), "request", base) == (1, 4)
    assert [tuple(r) for r in Pay.accepted(spark, base, "request").collect()] == [("a", 5, None)]
    kept = {tuple(r["violations"]): r["payload"] for r in Pay.quarantined(spark, base, "request").collect()}
    assert kept[("top_k below 1", "limit_jobs below 1")] == '{"candidate_id":"b","top_k":0,"limit_jobs":0}'
    assert kept[("candidate_id missing", "not readable")] == "{broken" and kept[("candidate_id missing",)] == '{"top_k":100}'
    assert kept[("not readable",)] == lines[2]


def test_payload_files_of_a_board_follow_each_other(spark, tmp_path):
    for name, ids in [("lever_acme_jobs_raw_2026-02", ["c"]), ("lever_acme_jobs_raw_2026-01", ["a", "b"]), ("lever_other_jobs_raw_2026-01", ["z"])]:
        (tmp_path / f"{name}.json").write_text(json.dumps([dict(POST_B, id=i) for i in ids]))
    (tmp_path / "lever_broken_jobs_raw_2026-01.json").write_text("no list")
    rows = feeds.read_payloads(spark, str(tmp_path), feeds.FEED_B).orderBy("board", "pos").collect()
    assert [(r["board"], r["id"]) for r in rows] == [("acme", "a"), ("acme", "b"), ("acme", "c"), ("other", "z")]
