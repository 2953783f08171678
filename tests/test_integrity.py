from minuteworks import plans


def test_every_kind_of_issue_arises(spark, sf_dir):
    rows = plans.QUERIES["x17_integrity_all_kinds"](spark, sf_dir).collect()
    codes = {issue.split(":")[0] for r in rows for issue in r.issues.split("|") if issue}
    assert codes == {"glossary_near_match", "glossary_conflict", "missing_provenance", "missing_timestamps", "capture_quality"}
    assert {0, 3} <= {r.n_attempts for r in rows}
    assert all(r.n_issues == len([i for i in r.issues.split("|") if i]) for r in rows)
