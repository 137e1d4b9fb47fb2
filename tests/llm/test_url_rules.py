"""The rules of op1 against the words of its contract."""
import pytest

CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"


def test_rules_are_the_contracts():
    from canopyframe.llm.queries import URL_RULES
    assert [f"{v} {h}{p}" for h, p, v in URL_RULES] == CONTRACT.split(", ")


@pytest.mark.parametrize("host", ["net", "x.net", "adult-x.example.net"])
def test_allowed_rule_beats_the_listed_hosts(spark, tmp_path, host):
    import duckdb

    from canopyframe.llm.queries import ORACLES, QUERIES
    urls = [f"http://{host}/de/1", f"http://{host}/de/8", f"http://{host}/fr/1"]
    spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["op1_url_filter"](spark, str(tmp_path)).select("page_id", "rule", "verdict").collect())
    listed = host.startswith("adult")
    assert got == [(0, "net/de/", "allow"), (1, *(("example.net/de/8", "block") if listed else ("net/de/", "allow"))), (2, None, "block" if listed else "allow")]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(con.sql(ORACLES["op1_url_filter"]).select("page_id, rule, verdict").fetchall()) == got
