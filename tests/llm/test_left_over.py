import corpus_pipeline


def test_short_lines_outlive_a_shared_footer(spark, make, sf):
    footer = "this very line is here again and again"
    rows = [(1, f"own words that nobody else has today\n{footer}"), (2, f"Rose\nis a rose\n{footer}"), (3, f"{footer}\n\n  "), (4, f"これは短い詩です\n{footer}")]
    out = corpus_pipeline.line_dedup(spark, make(rows), sf)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "Rose\nis a rose", 4: "これは短い詩です"}
