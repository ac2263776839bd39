"""Verdicts of the secret scan by repositories and owners."""

from chronogrid.llm.queries import QUERIES


def test_verdict_uses_repositories_and_owners(spark, tmp_path):
    example, mirrored = "ghp_" + "q4Wz8K" * 6, "ghp_" + "x9Zq7T" * 6
    rows = [(k, f"setup: {example} end", "hot") for k in range(1000)]
    rows += [(2000, f"mine {mirrored}", "s1"), (2001, f"mine {mirrored}", "s2")]
    rows += [(3000, "mine ghp_" + "z" * 36, "s1"), (3001, "mine ghp_" + "z" * 36, "s2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_live, r.n_copied, r.spans) for r in QUERIES["op10_ownership_secrets"](spark, str(tmp_path)).collect()}
    assert all(got[k] == (0, 1, "") for k in range(1000))
    assert got[2000] == got[2001] == (1, 0, "forge:5:45")
    assert got[3000] == got[3001] == (0, 0, "")
