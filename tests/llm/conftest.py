import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A frame of documents from texts (doc_id is the place) or from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, parts=3):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else r
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")))
        df = spark.createDataFrame(full, SCHEMA) if full else spark.createDataFrame([], SCHEMA)
        return df.repartition(parts) if full else df

    return make


@pytest.fixture
def folder_of(tmp_path):
    """A folder of tables, as the queries read them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
