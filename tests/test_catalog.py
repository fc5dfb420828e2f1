"""Shared tables built concurrently equal the same fixtures computed directly."""

from eventfit.sources import catalog as cat
from eventfit.sources import fixtures as fx

from conftest import SF_SMALL, rows


def test_prepare_builds_the_same_tables(spark):
    cat.prepare(spark, SF_SMALL, threads=4)
    assert rows(cat.bigrams(spark, SF_SMALL)) == rows(fx.bigrams(spark, SF_SMALL))
    assert rows(cat.items_wide(spark, SF_SMALL)) == rows(fx.items_wide(spark, SF_SMALL))
    assert rows(cat.toks(spark, SF_SMALL)) == rows(fx.toks(spark, SF_SMALL))
    assert rows(cat.vectors(spark, SF_SMALL)) == rows(fx.vectors(spark, SF_SMALL))


def test_changed_files_are_read_after_forgetting(spark, tmp_path):
    for text in ("one two", "three"):
        spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        cat.forget(spark, f"{tmp_path}/")
        assert rows(cat.toks(spark, str(tmp_path)), "tok") == [(w,) for w in sorted(text.split())]
