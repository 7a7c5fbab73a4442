"""Cards after changes against a rebuild."""

import datetime as dt

import pytest
from oracle import SMALL
from pyspark.sql import functions as F
from test_versions import only, rows

from shelfspark.functions.predicates import event_ts, live
from shelfspark.operators import memories
from shelfspark.operators.card_store import CARDS, CardStore
from shelfspark.sources.catalogue import Catalogue
from shelfspark.sources.library import Orders


@pytest.fixture
def library(spark, tmp_path):
    t = Orders(spark, SMALL)
    c = Catalogue(spark, str(tmp_path / "c"), t.assets.schema)
    c.create(t.assets)
    return t, c, CardStore(c, str(tmp_path / "cards"))


def rebuilt(assets, places):
    runs = memories.weekend_runs(live(assets).where(event_ts().isNotNull()).groupBy(F.to_date(event_ts()).alias("day")).agg(F.count(F.lit(1)).alias("n")))
    names = [c.split()[0] for c in CARDS.split(", ")]
    return rows(memories.weekend_cards(assets, runs, places).join(runs.select("start_day", "end_day"), "start_day").select(*names))


def test_cards_follow_changes(spark, library):
    t, c, store = library
    places = t.asset_places
    store.rebuild(places)
    assert rows(store.cards()) == rebuilt(c.read(), places) and store.cards().count() > 3
    card = store.cards().orderBy(F.desc("asset_count"), "start_day").first()
    inside = live(c.read()).where(F.to_date(event_ts()).between(card.start_day, card.end_day)).select("id", F.to_date(event_ts()).alias("day"))
    gone = spark.createDataFrame(inside.collect(), inside.schema)
    c.soft_delete(gone, "2024-05-01")
    store.refresh(gone, places)
    assert rows(store.cards()) == rebuilt(c.read(), places)
    assert card.id not in {r.id for r in store.cards().collect()}
    c.restore(gone)
    store.refresh(gone, places)
    assert rows(store.cards()) == rebuilt(c.read(), places) and card.id in {r.id for r in store.cards().collect()}


def test_only_changed_months_are_read(spark, library):
    t, c, store = library
    store.rebuild(t.asset_places)
    cards = store.cards().collect()
    quiet = sorted(set(c.months()) - {d.strftime("%Y-%m") for r in cards for d in (r.start_day, r.end_day)})[0]
    one = live(c.read([quiet])).select("id", F.to_date(event_ts()).alias("day")).orderBy("id").limit(1)
    one = spark.createDataFrame(one.collect(), one.schema)
    only(c, [quiet])  # all other months can't be read any more
    c.soft_delete(one, "2024-05-01")
    n = store.refresh(one, t.asset_places)
    assert n == 2 and rows(store.cards()) == sorted(map(tuple, cards), key=repr)
    counted = {r.day: r.n for r in store.counts().collect()}
    day = one.first().day
    assert counted.get(day, 0) == live(c.read([quiet])).where(F.to_date(event_ts()) == F.lit(day)).count()
    assert store.refresh(spark.createDataFrame([], "day date"), t.asset_places) == 2
    assert isinstance(day, dt.date)
