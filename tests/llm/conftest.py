import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
BENCHMARK = "item_id long, text string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"

#: names that operators use for columns of their own
CLASHING = "lang_pred score bits_per_byte held_out text_hash told found values made hit_id hit_hash gone chosen shared data n_found shard fp cell count bucket term pos item row k size salt values_ made_ told_ found_ h twice node root words".split()


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of tables made of the given rows; clashing: with extra columns of awkward names."""

    def make(documents=(), labels=(), benchmark=(), embeddings=(), clashing=False, name="tables"):
        path = tmp_path / name
        for table, rows, schema in (("documents", documents, DOCUMENTS), ("labels", labels, LABELS), ("benchmark", benchmark, BENCHMARK), ("embeddings", embeddings, EMBEDDINGS)):
            df = spark.createDataFrame(list(rows), schema)
            if clashing:
                df = df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING])
            df.write.parquet(str(path / f"{table}.parquet"))
        return str(path)

    return make


def documents(*texts, lang="en", first=1):
    """Rows of documents; a text may be a pair with its id."""
    rows = []
    for k, t in enumerate(texts, first):
        doc_id, text = t if isinstance(t, tuple) else (k, t)
        rows.append((doc_id, text, lang, "s", None if text is None else len(text)))
    return rows
