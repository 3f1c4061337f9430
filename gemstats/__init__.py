"""gemstats: statistics, filters and an inventory ledger for graded-goods
tables (diamonds as the worked preset), written as Spark DataFrame plans."""

__version__ = "0.1.0"
