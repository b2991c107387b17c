"""A stored index for account search.

Postings (kind, value, account) lie in hash buckets of (kind, value), written once and then only for accounts that
change. A search reads the buckets of the values it looks up, and nothing else of the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bankspark.operators import accounts as A
from bankspark.sources.tables import Tables
from bankspark.streaming.keyed import BUCKETS, KeyedStore

# Postings of a value that one task joins; values with more are dealt to more tasks.
POSTINGS = 100_000
_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("account_id", T.LongType()),
    T.StructField("present", T.BooleanType()),
])


class SearchIndex:
    """The index below ``directory``. Versions count up from 0; one that is written again replaces what it wrote."""

    def __init__(self, spark: SparkSession, directory: str, buckets: int = BUCKETS):
        self.store = KeyedStore(spark, directory, _SCHEMA, ["kind", "value", "account_id"], buckets, by=["kind", "value"])

    @staticmethod
    def _postings(rows: DataFrame) -> DataFrame:
        # What no search looks up needs no posting: missing values, and the list of everyone.
        return A.entries(rows).filter("kind <> 'all' AND value IS NOT NULL")

    def build(self, accounts: DataFrame) -> None:
        """Write the postings of all accounts, once."""
        self.store.start(self._postings(accounts).withColumn("present", F.lit(True)))

    def update(self, version: int, before: DataFrame, after: DataFrame) -> None:
        """Take changed accounts in: their rows ``before`` (none for new accounts) and ``after`` (none for removed ones)."""
        old, new = self._postings(before), self._postings(after)
        key = ["kind", "value", "account_id"]
        gone = old.join(new, key, "left_anti").withColumn("present", F.lit(False))
        self.store.put(version, gone.unionByName(new.join(old, key, "left_anti").withColumn("present", F.lit(True))))

    def postings(self, wanted: DataFrame) -> DataFrame:
        """``(kind, value, account_id)`` of the values in ``wanted(kind, value)``."""
        return self.store.latest(wanted).filter("present").drop("present")

    def search(self, db: Tables, requests: DataFrame) -> DataFrame:
        """``accounts.search_accounts`` by the index, for searches with a criterion; others find nothing here.

        ``db.accounts`` are the accounts that the index is up to date with.
        """
        wanted = A.lookups(A.parse_search(requests))
        held = self.postings(wanted)
        # As many salts as a value's postings need, from their counts.
        counts = held.groupBy("kind", "value").agg(F.ceil(F.count(F.lit(1)) / POSTINGS).cast("bigint").alias("salts"))
        salted = held.join(counts, ["kind", "value"]).withColumn("salt", F.pmod(F.xxhash64("account_id"), "salts")).drop("salts")
        asked = wanted.join(counts, ["kind", "value"]).withColumn(
            "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts")
        return A.looked_up(db, asked.join(salted, ["kind", "value", "salt"]))
