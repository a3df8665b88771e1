import corpus_pipeline
from sievewright.llm import queries
from sievewright.llm.base import read


def test_stages_and_run(spark, sf):
    docs = read(spark, sf, "documents")
    columns, rows = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).persist()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k < 3:
            assert 0 < docs.count() <= rows
            rows = docs.count()
    got = corpus_pipeline.run(spark, sf)
    assert got.count() == docs.count() and got.where("not round_trip").count() == 0


def test_every_query_returns_its_whole_table(spark, sf):
    docs, pages = (read(spark, sf, t).count() for t in ("documents", "pages"))
    for name, f in queries.QUERIES.items():
        n = f(spark, sf).count()
        if name in ("op5_html_extraction", "op7_url_filters"):
            assert n == pages
        elif name != "op6_chat_formatting":
            assert n == docs, name
