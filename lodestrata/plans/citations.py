"""Citations of orders matched, in order, to works of the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations
from ..sources.tables import load
from .registry import query

_TITLE = "concat('On the making and the keeping of ', {0}, ' in all seasons')"


def tables(spark, sf):
    part = load(spark, sf, "part").where("p_partkey % 3 = 0")
    works = part.selectExpr("concat('W', lpad(p_partkey, 9, '0')) AS work", "concat(p_brand, ' ', p_partkey) AS citation", "CASE WHEN p_size > 20 THEN array(concat('10.9/', p_partkey)) ELSE array() END AS dois", f"{_TITLE.format('p_partkey')} AS title")
    o = load(spark, sf, "orders")
    said = f"CASE WHEN o_orderkey % 5 = 0 THEN {_TITLE.format('o_custkey')} WHEN o_orderkey % 5 = 1 THEN concat('Brand#', o_custkey % 60, ' ', o_custkey) ELSE concat('Note ', o_custkey) END"
    dois = "CASE o_orderkey % 4 WHEN 0 THEN array(concat('https://doi.org/10.9/', o_custkey)) WHEN 1 THEN array(concat('10.9/', o_custkey % 90), concat('10.8/', o_orderkey % 70)) WHEN 2 THEN array(concat('10.8/', o_orderkey % 400, '.')) END"
    return o.selectExpr("o_orderkey AS occurrence", f"{said} AS citation", f"{dois} AS dois"), works


@query()
def citation_matching(spark, sf):
    """No SQL: each match depends on those before; tested against the plain sequence."""
    occurrences, works = tables(spark, sf)
    return citations.match_citations(occurrences, works, 134)
