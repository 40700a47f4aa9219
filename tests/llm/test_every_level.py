from lexdrift.llm import queries as Q


def test_every_document_gets_a_level(spark, tmp_path):
    easy, hard = "The cat sat. It was fun. ", "Notwithstanding considerable methodological heterogeneity, epistemological presuppositions remain indispensable. "
    rows = [(i, "en", (hard if i % 2 else easy) * 12) for i in range(20)] + [(20, "de", "Kurz."), (21, None, hard * 5), (22, "en", "short"), (23, "en", None)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 3 * (i % 2) + 1) for i in range(20)], "doc_id bigint, level int").write.parquet(f"{tmp_path}/level_labels.parquet")
    every, found = ({r.doc_id: r.level for r in Q.queries()[n](spark, str(tmp_path)).collect()} for n in ("p10_levels", "p10_found"))
    assert set(every) == set(range(24)) and set(found) == set(range(20))
    assert all(every[i] == level for i, level in found.items())
