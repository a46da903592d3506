import glob
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from support import SF001
from litsieve.plans.screening import PRIMARY_METHODS, SavedStages, ScreeningConfig, label_overlap, run_screening
from litsieve.schema import papers_view
from litsieve.session import read_table


def test_screening_run_stages_and_audit(spark):
    papers = papers_view(read_table(spark, SF001, "documents"))
    for method in ("exact", "near", "fuzzy", "combined"):
        res = run_screening(papers, ScreeningConfig(dedup=method, dedup_columns=("Title",)))
        summ = {r["stage"]: r for r in res.summary.collect()}
        assert sorted(summ) == [2, 3, 4, 5]
        s2, s3, s4 = summ[2], summ[3], summ[4]
        assert s2["original_count"] == papers.count()
        assert s2["remaining_count"] == s3["matched_count"] + s3["unmatched_count"]
        assert s3["matched_count"] == s4["matched_count"] + s4["unmatched_count"]
        assert res.processed.count() == s4["matched_count"]
        by_stage = {r["unmatched_stage"]: r["n"] for r in
                    res.unmatched.groupBy("unmatched_stage").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert by_stage.get(3, 0) == s3["unmatched_count"] and by_stage.get(4, 0) == s4["unmatched_count"]


def test_screening_rejects_missing_columns(spark):
    df = spark.createDataFrame([(1, "x")], "paper_id long, Title string")
    try:
        run_screening(df)
        raise AssertionError("expected a clear error")
    except ValueError:
        pass


def test_screening_primary_methods_and_ml_stage(spark):
    papers = papers_view(read_table(spark, SF001, "documents"))
    ml = label_overlap("Language", {"en": "the of and", "fr": "le la les"}, ("Title",))
    for method in ("pairs", "keywords", "seeds", "clusters"):
        cfg = ScreeningConfig(dedup="exact", primary=method, seed_terms=("the of", "le la"), clusters=3, ml=ml)
        res = run_screening(papers, cfg)
        summ = {(r["stage"], r["action"]): r for r in res.summary.collect()}
        s2, s3 = summ[(2, "Duplicate removal")], summ[(3, "Primary categorization")]
        assert s2["remaining_count"] == s3["matched_count"] + s3["unmatched_count"]
        assert s3["matched_count"] > 0 and s3["method"] == PRIMARY_METHODS[method]
        assert summ[(5, "ML classification")]["dimension"] == "Language"
        assert "Language" in res.processed.columns


def test_saved_run_goes_on_after_its_last_complete_stage(spark, tmp_path):
    papers = papers_view(read_table(spark, SF001, "documents"))
    cfg = ScreeningConfig(dedup="exact", dedup_columns=("Title",))
    straight, root = run_screening(papers, cfg), str(tmp_path / "run")

    def same(res):
        return all(sorted(map(str, getattr(res, t).collect())) == sorted(map(str, getattr(straight, t).collect()))
                   for t in ("processed", "unmatched", "summary"))

    assert run_screening(papers, cfg, root, last_stage=3) is None
    first = run_screening(papers.repartition(5), cfg, root)  # the same rows in another order
    assert first.stages["resumed"] == [2, 3] and same(first)
    assert run_screening(papers, cfg, root).stages["resumed"] == [2, 3, 4, 5]
    other = replace(cfg, dimensions=dict(list(cfg.dimensions.items())[:1]))
    assert run_screening(papers, other, root).stages["resumed"] == [2, 3, 4]
    assert run_screening(papers, replace(cfg, keep="last"), root).stages["resumed"] == []
    assert run_screening(papers.filter("paper_id > 0"), cfg, root).stages["resumed"] == []
    # a table without its manifest is not complete
    unfinished = str(tmp_path / "cut")
    saved = SavedStages(papers, unfinished)
    saved._manifest = lambda path: None
    saved.keep(2, (cfg.dedup, cfg.dedup_columns, cfg.keep, cfg.fuzzy_threshold), lambda: papers.limit(1))
    for part in glob.glob(f"{unfinished}/stage=2/*/manifest/part-*"):
        open(part, "w").close()
    again = run_screening(papers, cfg, unfinished)
    assert again.stages["resumed"] == [] and same(again)
    with pytest.raises(ValueError):
        run_screening(papers, cfg, last_stage=2)
