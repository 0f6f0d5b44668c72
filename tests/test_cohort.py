"""Cohort rules on small hand-made stays, and invariants."""

from pyspark.sql import functions as F

from cohortlens.operators import cohort as c
from cohortlens.operators import sequential as s
from cohortlens.plans.cohort_extraction import extract_cohort
from cohortlens.sources.stores import write_cohort
from cohortlens.sources.tables import read_dictionary

KEYS = ["dataset", "stay_id"]


def _stays(spark, rows):
    return spark.createDataFrame(rows, "dataset string, stay_id long, start_h long, end_h long, los_h double")


def _wide(spark, hours):
    rows = [("a", stay, h, 1.0) for stay, hs in hours.items() for h in hs]
    return spark.createDataFrame(rows, "dataset string, stay_id long, time_h long, x double")


def test_each_rule_hits_its_stay(spark):
    stays = _stays(
        spark,
        [("a", 1, 0, -2, 10.0), ("a", 2, 0, 30, 3.0), ("a", 3, 0, 30, 30.0), ("a", 4, 0, 90, 90.0), ("a", 5, 0, 30, 30.0), ("a", 6, 0, 20, 20.0)],
    )
    wide = _wide(spark, {2: range(10), 3: [0, 1, 2], 4: [0, 1, 2, 3, 60], 5: [0, 1, 2, 30]})
    lists = c.exclusions(stays, wide, ["x"])
    assert [sorted(r["stay_id"] for r in d.collect()) for d in lists] == [[1], [2], [3], [4]]
    kept, report = c.exclude(stays, lists)
    assert sorted(r["stay_id"] for r in kept.collect()) == [5, 6]
    rows = {r["step"]: r for r in report.collect()}
    left = 6
    for i in range(1, 5):
        assert left - rows[i]["incl_n"] == rows[i]["excl_n"] == 1
        left = rows[i]["incl_n"]


def test_listed_ids_outside_the_cohort_count_only_in_total(spark):
    stays = _stays(spark, [("a", 1, 0, 5, 5.0), ("a", 2, 0, 5, 5.0)])
    first = spark.createDataFrame([("a", 1), ("a", 99)], "dataset string, stay_id long")
    second = spark.createDataFrame([("a", 1)], "dataset string, stay_id long")
    kept, report = c.exclude(stays, [first, second])
    assert [r["stay_id"] for r in kept.collect()] == [2]
    got = sorted((r["step"], r["incl_n"], r["excl_n_total"], r["excl_n"]) for r in report.collect())
    assert got == [(1, 1, 2, 1), (2, 1, 1, 0)]


def test_longest_gap_equals_longest_run_on_the_grid(spark):
    stays = _stays(spark, [("a", i, 0, 40, 40.0) for i in range(1, 6)] + [("a", 6, 0, 0, 0.0)])
    hours = {1: [0, 40], 2: [5, 6, 30], 3: list(range(41)), 4: [50, 60], 6: [0]}
    wide = _wide(spark, hours)
    gap = {r["stay_id"]: r["gap_h"] for r in c.longest_gap(stays, wide).collect()}
    seen = c.n_obs_per_row(c.map_to_grid(stays, wide), ["x"]).withColumn("v", F.col("n") > 0)
    run = {r["stay_id"]: r["lengths"] for r in c.longest_run(seen, "v", False).collect()}
    assert gap == run == {1: 39, 2: 23, 3: 0, 4: 41, 5: 41, 6: 0}


def test_filter_in_windows_against_brute_force(spark):
    ts = [("a", i % 3, h, float(h)) for i in range(3) for h in range(-5, 90, 3)]
    win = [("a", 0, 0, 10), ("a", 0, 8, 60), ("a", 1, 47, 48), ("a", 2, 20, 19)]
    got = c.filter_in_windows(
        spark.createDataFrame(ts, "dataset string, stay_id long, time_h long, x double"),
        spark.createDataFrame(win, "dataset string, stay_id long, start_h long, end_h long"),
    )
    want = [t for t in ts if any(w[1] == t[1] and w[2] <= t[2] <= w[3] for w in win)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rolling_sums_with_padding(spark):
    x = [1.0, None, 2.0, 4.0, None]
    df = spark.createDataFrame([("a", 1, i, v) for i, v in enumerate(x)], "dataset string, stay_id long, time_h long, x double")
    for align, want in (("left", [1.0, 2.0, 6.0, 4.0, 0.0]), ("right", [1.0, 1.0, 2.0, 6.0, 4.0]), ("center", [1.0, 2.0, 6.0, 4.0, 0.0])):
        got = s.pad_rollsum(df, "x", 2, align, "s").orderBy("time_h").collect()
        assert [r["s"] for r in got] == want, align
    strict = s.pad_rollsum(df, "x", 2, "right", "s", na_rm=False).orderBy("time_h").collect()
    assert [r["s"] for r in strict] == [None, None, None, 6.0, None]


def test_gaps_see_holes_and_repeats(spark):
    rows = [("a", 1, h) for h in (0, 1, 2)] + [("a", 2, h) for h in (0, 2)] + [("a", 3, h) for h in (0, 1, 1, 2)]
    df = spark.createDataFrame(rows, "dataset string, stay_id long, time_h long")
    assert {r["stay_id"]: r["has_gaps"] for r in s.gaps(df).collect()} == {1: False, 2: True, 3: True}
    assert s.has_gaps(df) and not s.has_gaps(df.where("stay_id = 1"))


def test_extraction_counts_and_store(spark, tmp_path):
    obs = [("a", 1, "x", h, 1.0) for h in range(0, 400, 5)] + [("b", 2, "x", h, 2.0) for h in range(3)]
    o = spark.createDataFrame(obs, "dataset string, stay_id long, concept string, time_h long, value double")
    sta = spark.createDataFrame([("a", 1, 50), ("b", 2, 60)], "dataset string, stay_id long, age int")
    cohort = extract_cohort(o, sta, ["x"])
    assert cohort.dyn.count() == 337
    assert [r["stay_id"] for r in cohort.sta.collect()] == [1]
    assert {r["stay_id"]: r["end_h"] for r in cohort.patients.collect()} == {1: 395, 2: 2}
    write_cohort(cohort, str(tmp_path / "c"), multi_centre=True)
    dyn = spark.read.parquet(str(tmp_path / "c" / "dyn"))
    assert dyn.agg(F.max("time")).first()[0] == 336 * 3600
    assert not (tmp_path / "c" / "hospital").exists()


def test_dictionary_file(spark, tmp_path):
    head = "VariableID VariableTag VariableName VariableType DatasetVersion OrganSystem TreatmentGroups Unit DataType LowerBound UpperBound Description LogTransform LogTransformEps PossibleValues TreatmentDetailLevel".split()
    rows = [
        ["1", "hr", "Rate", "observation", "v0.0", "c", "None", "bpm", "continuous", "0.0", "300", "d", "FALSE", "None", "None", "None"],
        ["2", "lact", "Lactate", "observation", "v0.0", "c", "None", "x", "continuous", "0", "50", "d", "True", "0.1", "None", "None"],
        ["3", "old", "Old", "observation", "None", "c", "None", "x", "continuous", "0", "50", "d", "True", "0.1", "None", "None"],
    ]
    path = tmp_path / "d.tsv"
    path.write_text("\n".join("\t".join(r) for r in [head, *rows]) + "\n")
    d = {r["VariableTag"]: r for r in read_dictionary(spark, str(path)).collect()}
    assert set(d) == {"hr", "lact"}
    assert d["hr"]["LogTransform"] is False and d["hr"]["LogTransformEps"] is None and d["hr"]["UpperBound"] == 300.0
    assert d["lact"]["LogTransform"] is True and d["lact"]["TreatmentGroups"] is None
