"""Weekend cards that follow changes of the catalogue day by day.

Kept are the counts of live assets by day, in parts by month, and the cards.
After a change only the months of its days are counted anew; runs come from the
counts, a row a day; a card is made again if its run is new or holds a changed
day, from the months of its days alone.  The result is that of a rebuild.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions.predicates import event_ts, live
from shelfspark.operators import memories
from shelfspark.sources.catalogue import Catalogue
from shelfspark.sources.versions import Versions

DAYS = "day date, n long"
CARDS = "id string, kind string, title string, subtitle string, asset_count long, cover_asset_id string, place_label string, start_day date, end_day date"


class CardStore:
    def __init__(self, catalogue: Catalogue, folder: str):
        self.catalogue, self.versions = catalogue, Versions(catalogue.spark, folder)

    def cards(self) -> DataFrame:
        return self.versions.read(CARDS, ["cards"])

    def counts(self) -> DataFrame:
        """(day, n) of the days that have live assets."""
        _, parts, _ = self.versions.current()
        return self.versions.read(DAYS, [p for p in parts if p.startswith("days=")])

    def rebuild(self, asset_places: DataFrame) -> int:
        return self._refresh(self.catalogue.months(), None, asset_places)

    def refresh(self, days: DataFrame, asset_places: DataFrame) -> int:
        """Take in changes of assets or places of days(day)."""
        days = days.select(F.to_date("day").alias("day")).where("day is not null").distinct()
        months = [r["m"] for r in days.select(F.date_format("day", "yyyy-MM").alias("m")).distinct().collect()]
        return self._refresh(months, days, asset_places) if months else self.versions.current()[0]

    def _refresh(self, months: list[str], days: DataFrame | None, asset_places: DataFrame) -> int:
        change = self.versions.begin()
        counts = live(self.catalogue.read(months)).where(event_ts().isNotNull()).groupBy(F.to_date(event_ts()).alias("day")).agg(F.count(F.lit(1)).alias("n"))
        for m in months:
            change.drop(f"days={m}")
        change.put_each(counts.withColumn("days", F.date_format("day", "yyyy-MM")).coalesce(1), "days")
        paths = [f"{self.versions.folder}/data/{x}" for p, folders in change.parts.items() if p.startswith("days=") for x in folders]
        spark = self.catalogue.spark
        now = spark.read.schema(DAYS).parquet(*paths) if paths else spark.createDataFrame([], DAYS)
        top = memories.weekend_runs(now).orderBy(F.desc("total"), F.desc("start_day")).limit(S.MAX_WEEKENDS)
        top = spark.createDataFrame(top.collect(), top.schema)  # a row a card
        same = ["start_day", "end_day"]
        kept = self.cards().join(top.select(*same, F.col("total").alias("asset_count")), [*same, "asset_count"], "left_semi")
        if days is None:
            kept = kept.limit(0)
        else:
            spans = kept.select(*same, F.explode(F.sequence(*same)).alias("day"))
            kept = kept.join(spans.join(days, "day", "left_semi").select(*same), same, "left_anti")
        made = top.join(kept.select(*same), same, "left_anti")
        need = made.select(F.explode(F.sequence(*same)).alias("day")).select(F.date_format("day", "yyyy-MM").alias("m")).distinct()
        fresh = memories.weekend_cards(self.catalogue.read([r["m"] for r in need.collect()]), made, asset_places)
        fresh = fresh.join(top.select(*same), "start_day")
        names = [c.split()[0] for c in CARDS.split(", ")]
        change.put("cards", kept.select(*names).unionByName(fresh.select(*names)).coalesce(1))
        return change.commit()
