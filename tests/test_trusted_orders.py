"""The premises of trusted orders grow with the tables."""

from pyspark.sql import functions as F

from factloom import queries

FOLDER = "/root/testdata/sf0.01"


def test_premises_are_as_many_as_rows(spark, monkeypatch):
    """Suppliers and rich customers of a nation are not paired."""
    seen = {}

    def derived(nodes, premises, given):
        seen["premises"] = premises.count()
        return given

    monkeypatch.setattr(queries.derive, "derived", derived)
    queries.trusted_orders(spark, FOLDER)
    sizes = {t: queries.table(spark, FOLDER, t).count() for t in ("lineitem", "orders", "supplier")}
    rich = queries.table(spark, FOLDER, "customer").where(F.col("c_acctbal") > 9000).count()
    assert seen["premises"] <= sum(sizes.values()) + rich
