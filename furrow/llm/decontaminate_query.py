"""Query op5_decontaminate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.llm.decontaminate import contained_items
from furrow.llm.registry import query
from furrow.sources.tables import table

# The words of both sides, shingles as texts, and an exact count of shared ones.
SQL = r"""
WITH word_lists AS (
    SELECT 'd' AS side, doc_id AS id, list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '     abcdefghijklmnopqrstuvwxyz'), ' '), lambda x: x <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT 'i', item_id, list_filter(string_split(translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '     abcdefghijklmnopqrstuvwxyz'), ' '), lambda x: x <> '')
    FROM benchmark WHERE item_id IS NOT NULL
), places AS (
    SELECT side, id, w, unnest(range(1, len(w) - 3)) AS p FROM word_lists
), shingles AS (
    SELECT DISTINCT side, id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] AS s FROM places
), items AS (
    SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE side = 'i'
)
SELECT d.id AS doc_id, i.item_id, i.n_item, count(*) AS n_shared
FROM shingles d JOIN items i ON d.s = i.s
WHERE d.side = 'd'
GROUP BY d.id, i.item_id, i.n_item
HAVING 100 * count(*) >= 80 * i.n_item
"""


@query("op5_decontaminate", SQL)
def op5_decontaminate(spark: SparkSession, base: str) -> DataFrame:
    return contained_items(table(spark, base, "documents"), table(spark, base, "benchmark"))
