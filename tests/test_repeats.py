"""Registered queries against their SQL where pages share an address."""

import __spark_entry__ as entry


def test_pages_of_one_address_move_one_by_one(spark, tmp_path):
    import duckdb

    urls = ["https://a.example.net/en/1", "https://a.example.net/en/1#top", "https://a.example.net/en/1#7", "https://a.example.org/de/2"]
    pages = [(i, urls[i % 4], f"<title>{'' if i % 9 == 4 else f'T {i}'}</title>") for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["canonical_urls"]).fetchall()
    got = entry.queries()["canonical_urls"](spark, str(tmp_path))
    assert sorted((r.source_id, r.url, r.pos) for r in got.collect()) == sorted(want) and len(want) == 8


def test_proposals_stay_proposals_in_bundles(spark, monkeypatch):
    """What the equivalence query searches has the kinds of its pages, as its SQL does; a bundle holds none."""
    import pytest

    from shelfspark.plans import base, build_queries

    class Searched(Exception):
        pass

    def search(requests, records, **options):
        raise Searched({r.url: r.document_kind for r in records.select("url", "document_kind").collect()})

    monkeypatch.setattr(build_queries.s, "search", search)
    data = "/root/testdata/sf0.001"
    with pytest.raises(Searched) as found:
        build_queries.equivalence(spark, data)
    rows = base.page_records(spark, data).where("url like 'https://%' and docs_locale <> 'es'").select("url", "document_kind").collect()
    want = {r.url: r.document_kind for r in rows}
    assert len(want) == len(rows) and "proposal" in want.values() and found.value.args[0] == want
