"""Every registered query plans without cross joins (Cartesian product or
broadcast nested-loop join)."""

from sf_paths import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def test_no_cross_joins_in_registered_queries(spark):
    import __spark_entry__ as entry
    offenders = {}
    for key, fn in entry.queries().items():
        plan = fn(spark, SF001)._jdf.queryExecution().executedPlan().toString()
        found = [f for f in FORBIDDEN if f in plan]
        if found:
            offenders[key] = found
        spark.catalog.clearCache()
    assert offenders == {}


def test_no_round_robin_exchange_and_no_broadcast_hint(spark):
    """Reads keep the scan's splits; nothing is spread or broadcast by a switch."""
    from docsearch_spark.plans import catalog
    for key in ("chunk_fixed", "embed_texts", "normalize_whitespace", "html_to_text", "topk_batch"):
        plan = catalog.QUERIES[key](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobin" not in plan, key
        assert "ResolvedHint" not in plan, key
