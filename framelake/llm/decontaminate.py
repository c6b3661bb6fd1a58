"""Benchmark decontamination: short test items found inside long documents.

Size-partitioned MinHash containment search (containment.py), verified by exact containment of
the item's distinct five-word shingles: a match has at least ``threshold`` (0.8) of them.

Results: items under five words have no shingles and match nothing; so do null and empty texts.
Items with null item_id are items like others; equal items are each reported; repeated documents are each
searched, those of any length whole. An item whose shingles lie scattered over a document, others between them,
is found as if they lay together. Empty tables give no matches; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.containment import contained, without


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, chance: float = 0.9999) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every match of ``benchmark`` (item_id, text)."""
    found = contained(docs, benchmark.select(F.col("item_id").alias("query_id"), "text"), threshold, chance)
    return found.withColumnsRenamed({"query_id": "item_id", "n_query": "n_item"})


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, chance: float = 0.9999) -> DataFrame:
    """``docs`` (any columns; text) without the rows that hold a test item."""
    return without(docs, benchmark.select(F.col("item_id").alias("query_id"), "text"), threshold, chance)
