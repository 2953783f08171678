"""Every registered query against its SQL on the smallest tables, and its plan's shape."""

import math

import duckdb
import pytest

from minuteworks import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v.isoformat().replace("+00:00", "") if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    assert got
    if name in plans.ORACLES:
        result = duck.execute(plans.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def rows_and_sql(spark, tmp_path, name, texts):
    """Rows of a query over documents of these texts, and those of its SQL."""
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    df = plans.QUERIES[name](spark, str(tmp_path))
    return sorted(map(tuple, df.collect()), key=repr), sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", ["g20_useful_title", "g15_titles_and_expansion", "g21_derive_titles"])
def test_a_title_that_is_cut_after_a_full_stop_and_two_stars(spark, tmp_path, name):
    """As in texts whose words end in three stars: the first 60 characters of these end in ``.**``."""
    text = "Billing service migration with another budget review here.*** said"
    assert text[:60].endswith(".**")
    got, sql = rows_and_sql(spark, tmp_path, name, [text, text, text.replace("here", "now")])
    assert got == sql


def test_transcripts_are_stripped_around_any_text(spark, tmp_path):
    """No text at all, blanks of any kind at its ends, headings of its own, and the headings of the query."""
    texts = ["", None, " ", " a ", "\n", "a\n", "\t a", " a　", "# a", "a\n# b\nc", "\n# ", "a\n## b\n\n\nc", "a\n#### b", "## Kept\na", "a\n## End", "a\r\n# b\r\n", "plain"]
    got, sql = rows_and_sql(spark, tmp_path, "g9_strip_transcript", texts)
    assert got == sql
