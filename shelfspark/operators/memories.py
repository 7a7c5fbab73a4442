"""Memories: this day in past years, weekend runs, a person in a place."""

from __future__ import annotations

from datetime import date, timedelta
from string import Formatter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions.predicates import blank, event_ts, is_screenshot, live, rank_order, rank_score
from shelfspark.sources.work import ship, write_table

QUOTE_CANDIDATES = 16
PROSE_MODEL = "prose-v1"


def rank(assets: DataFrame, take: int = 200) -> DataFrame:
    """(id, rank_score) of live assets: favourite, rating, thumbnail; then newest."""
    return live(assets).orderBy(*rank_order()).limit(take).select("id", rank_score().alias("rank_score"))


def covers(assets: DataFrame, key: str) -> DataFrame:
    """(key, cover_id, cover_thumb): the best asset of each group, screenshots only where there is nothing else."""
    at = F.struct((~is_screenshot()).alias("real"), rank_score().alias("score"), event_ts().alias("at"))
    # of equal ones the least id: ids are compared last, the other way round
    best = assets.groupBy(key).agg(F.max(at).alias("top"))
    rows = assets.withColumn("_at", at).join(best, key).where("_at = top")
    return rows.groupBy(key).agg(F.min(F.struct("id", "thumbnail_path")).alias("c")).select(key, F.col("c.id").alias("cover_id"), F.col("c.thumbnail_path").alias("cover_thumb"))


def on_this_day(assets: DataFrame, as_of: str) -> DataFrame:
    """One row if enough live assets share the day in past years."""
    at = event_ts()
    day = live(assets).where((F.date_format(at, "MM-dd") == as_of[5:10]) & (F.year(at) < int(as_of[:4])))
    n = day.agg(F.count(F.lit(1)).alias("asset_count"), F.countDistinct(F.year(at)).alias("years")).where(F.col("asset_count") >= S.MIN_ON_THIS_DAY)
    cover = covers(day.withColumn("k", F.lit(1)), "k").drop("k")
    text = F.when(F.col("years") <= 1, F.format_string("%d photos from past years", "asset_count")).otherwise(F.format_string("%d photos across %d years", "asset_count", "years"))
    return n.crossJoin(F.broadcast(cover)).select(  # one row each
        F.lit(f"on_this_day:{as_of[5:10]}").alias("id"), F.lit("on_this_day").alias("kind"), F.lit("On this day").alias("title"), text.alias("subtitle"), "asset_count", F.col("cover_id").alias("cover_asset_id")
    )


def day_counts(assets: DataFrame, as_of: str, days: int = 3 * 365) -> DataFrame:
    """(day, n) of the days before as_of, no more than so many back."""
    end = date.fromisoformat(as_of[:10])
    at = event_ts()
    rows = live(assets).where((at >= F.lit(str(end - timedelta(days=days))).cast("timestamp_ntz")) & (at < F.lit(str(end)).cast("timestamp_ntz")))
    return rows.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy runs of one island of consecutive days."""
    pdf = pdf.sort_values("day")
    days, n, out, i = list(pdf["day"]), list(pdf["n"]), [], 0
    while i < len(days):
        j = min(i + 3, len(days) - 1)
        span, total = days[i : j + 1], sum(n[i : j + 1])
        if len(span) >= 2 and total >= S.MIN_WEEKEND and any(d.weekday() >= 5 for d in span):
            out.append((span[0], span[-1], total))
            i = j + 1
        else:
            i += 1
    return pd.DataFrame(out, columns=["start_day", "end_day", "total"]).astype({"total": "int64"} if out else {})


def weekend_runs(days: DataFrame) -> DataFrame:
    """(start_day, end_day, total) from days(day, n): runs of 2 to 4 days with a weekend day and enough assets.

    No run crosses a gap, so each island of consecutive days is folded alone.
    Days are few (one row each), so the one window over all of them is small.
    """
    ship(days.sparkSession)
    w = Window.orderBy("day")
    islands = days.select("day", "n", F.date_sub("day", F.row_number().over(w)).alias("island"))
    return islands.groupBy("island").applyInPandas(_runs, "start_day date, end_day date, total long").orderBy(F.desc("total"), F.desc("start_day"))


def run_assets(assets: DataFrame, runs: DataFrame) -> DataFrame:
    """Live assets with the start_day of the run they fall in: a run has at most four days, an equi-join by day."""
    days = runs.select("start_day", F.explode(F.sequence("start_day", "end_day")).alias("day"))
    return live(assets).withColumn("day", F.to_date(event_ts())).join(days, "day")


def dominant_place(in_run: DataFrame, asset_places: DataFrame) -> DataFrame:
    """(start_day, place_label, n): the label most assets of the run have, the first in the alphabet of equal ones."""
    named = in_run.select("start_day", F.col("id").alias("asset_id")).join(asset_places.where(~blank(F.col("place_label"))), "asset_id")
    n = named.groupBy("start_day", "place_label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("start_day").agg(F.min(F.struct((-F.col("n")).alias("m"), "place_label")).alias("t")).select("start_day", "t.place_label", (-F.col("t.m")).alias("n"))


def weekend_cards(assets: DataFrame, runs: DataFrame, asset_places: DataFrame, limit: int = S.MAX_WEEKENDS) -> DataFrame:
    top = runs.orderBy(F.desc("total"), F.desc("start_day")).limit(limit)
    inside = run_assets(assets, top)
    rows = top.join(dominant_place(inside, asset_places).drop("n"), "start_day", "left").join(covers(inside, "start_day"), "start_day", "left")
    title = F.when(F.col("place_label").isNotNull(), F.concat(F.lit("Weekend in "), "place_label")).otherwise("Weekend trip")
    when = F.concat(F.date_format("start_day", "MMM dd"), F.lit(" – "), F.date_format("end_day", "MMM dd, yyyy"))
    return rows.select(
        F.concat(F.lit("weekend:"), F.date_format("start_day", "yyyy-MM-dd")).alias("id"), F.lit("weekend").alias("kind"), title.alias("title"), F.concat(when, F.lit(" · "), F.col("total").cast("string"), F.lit(" photos")).alias("subtitle"),
        F.col("total").alias("asset_count"), F.col("cover_id").alias("cover_asset_id"), "place_label", F.col("start_day"),
    )


def person_places(faces: DataFrame, people: DataFrame, asset_places: DataFrame, assets: DataFrame, least: int = S.MIN_PERSON_PLACE, limit: int | None = S.MAX_PERSON_PLACES) -> DataFrame:
    """(person_id, name, place_label, n): shown, named people and places with enough assets, most first."""
    shown = people.where(~F.col("ignored") & ~blank(F.col("name"))).select(F.col("id").alias("person_id"), "name").distinct()
    named = asset_places.where(~blank(F.col("place_label"))).select("asset_id", "place_label")
    rows = faces.select("asset_id", "person_id").join(live(assets).select(F.col("id").alias("asset_id")), "asset_id", "left_semi").join(named, "asset_id")
    # all by asset, in as many tasks as faces are dealt in; what is shuffled then are counts
    n = rows.distinct().groupBy("person_id", "place_label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    out = n.join(shown, "person_id").select("person_id", "name", "place_label", "n").orderBy(F.desc("n"), "person_id", "place_label")
    return out.limit(limit) if limit else out


def memories(day: DataFrame, weekends: DataFrame, persons: DataFrame, dismissed: DataFrame | None = None, limit: int = S.LIMIT_MEMORIES) -> DataFrame:
    """(id, kind, title, asset_count, pos): this day, weekends, then people in places, dismissed ones left out."""
    cols = ["ord", "id", "kind", "title", "asset_count", "tie"]
    rows = day.select(F.lit(0).alias("ord"), "id", "kind", "title", "asset_count", F.lit("").alias("tie"))
    rows = rows.union(weekends.select(F.lit(1), "id", "kind", "title", "asset_count", F.lit("")))
    person = persons.select(F.lit(2), F.concat_ws("|", F.concat(F.lit("person_place:"), "person_id"), "place_label"), F.lit("person_place"), F.concat(F.col("name"), F.lit(" in "), F.col("place_label")), F.col("n"), F.concat_ws("|", "person_id", "place_label"))
    rows = rows.union(person).toDF(*cols)
    if dismissed is not None:
        rows = rows.join(dismissed.select(F.col("memory_id").alias("id")), "id", "left_anti")
    # at most limit rows are numbered
    start = F.when(F.col("ord") == 1, F.col("id")).otherwise("")
    top = rows.withColumn("s", start).orderBy("ord", F.desc("asset_count"), F.desc("s"), "tie").limit(max(1, min(limit, S.LIMIT_MEMORIES)))
    pos = F.row_number().over(Window.orderBy("ord", F.desc("asset_count"), F.desc("s"), "tie")) - 1
    return top.select("id", "kind", "title", "asset_count", pos.alias("pos"))


def parse_memory_id(memory_id: str) -> tuple[str, ...]:
    """("on_this_day", "MM-DD"), ("weekend", "YYYY-MM-DD") or ("person_place", person, label)."""
    kind, _, rest = memory_id.partition(":")
    if kind == "on_this_day" and len(rest) == 5 and rest[2] == "-" and rest.replace("-", "").isdigit():
        return kind, rest
    if kind == "weekend":
        return kind, date.fromisoformat(rest).isoformat()
    if kind == "person_place" and "|" in rest:
        return (kind, *rest.split("|", 1))
    raise ValueError(f"no memory id: {memory_id}")


def _stripped(c: Column) -> Column:
    """Without white space at the ends, of any kind."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")


def usable_quote(caption: Column) -> Column:
    """The caption as a quote, null if it is none; lengths are bytes.

    Over 120 bytes it is cut to the characters that end within 117, and an ellipsis.
    """

    def quote(t: Column) -> Column:
        low = F.lower(t)
        junk = (F.octet_length(t) < 8) | low.isin("caption", "what does the image describe?") | low.startswith("<caption")
        # only the first 117 characters can end within 117 bytes
        sizes = F.transform(F.sequence(F.lit(1), F.least(F.length(t), F.lit(117))), lambda i: F.octet_length(F.substring(t, F.lit(1), i)))
        cut = F.concat(F.substring(t, F.lit(1), F.size(F.filter(sizes, lambda n: n <= 117))), F.lit("…"))
        return F.when(junk, None).when(F.octet_length(t) > 120, cut).otherwise(t)

    return F.get(F.transform(F.array(_stripped(caption)), quote), F.lit(0))  # stripped once, not for each of its lengths


def quotes(ranked: DataFrame, captions: DataFrame, key: str) -> DataFrame:
    """(key, quote): the first usable caption among the best 16 of ranked(key, id, pos); no other caption is looked at."""
    best = write_table(ranked.where(F.col("pos") < QUOTE_CANDIDATES), "best")
    own = write_table(best.join(captions.select(F.col("asset_id").alias("id"), "caption"), "id").select(key, "pos", "caption"), "captions")
    rows = own.select(key, "pos", usable_quote(F.col("caption")).alias("quote")).where("quote is not null")
    return rows.groupBy(key).agg(F.min_by("quote", "pos").alias("quote"))


def save_as_album(assets: DataFrame, memory_id: str, title: str, name: str | None = None, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(album(id, name, cover_asset_id), members(album_id, asset_id)) from a memory's ranked assets(id, pos).

    The best 200 become members, the first of them the cover; the name is the
    memory's title if none is given.  A memory without assets makes no album.
    """
    said = (name or "").strip() or title
    if not said:
        raise ValueError("an album needs a name")
    key = F.sha2(F.lit(f"{memory_id}|{said}"), 256)
    top = assets.orderBy("pos", "id").limit(most)
    album = top.agg(F.min_by("id", F.struct("pos", "id")).alias("cover_asset_id")).where("cover_asset_id is not null")
    return album.select(key.alias("id"), F.lit(said).alias("name"), "cover_asset_id"), top.select(key.alias("album_id"), F.col("id").alias("asset_id")).distinct()


def cache_state(built: DataFrame, dirty: DataFrame, today: str) -> DataFrame:
    """(stale): whether the cards must be built again.

    built(built_on, built_at): the last build or none; dirty(at): changes that
    asked for one.  Cards built on an earlier day are stale, for "on this day"
    is another day's.
    """
    last = built.agg(F.max("built_at").alias("at"), F.max(F.col("built_on")).alias("day"))
    asked = dirty.agg(F.max("at").alias("asked"))
    return last.crossJoin(asked).select((F.col("at").isNull() | (F.col("day") != F.lit(today).cast("date")) | F.coalesce(F.col("asked") >= F.col("at"), F.lit(False))).alias("stale"))  # one row each


def rebuild_cache(cards: DataFrame, folder: str, today: str) -> int:
    """Write cards as the next version beside the last one; readers switch when it is whole.

    A version is a folder with Spark's mark of success; lost writers leave one without it.
    """
    n = len(_versions(cards, folder))
    cards.withColumn("built_on", F.lit(today).cast("date")).write.mode("overwrite").parquet(f"{folder}/v{n + 1:08d}")
    return n + 1


def _versions(df: DataFrame, folder: str) -> list[str]:
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(top)]
    return sorted(n for n in names if fs.exists(hadoop.Path(f"{n}/_SUCCESS")))


def cached_cards(like: DataFrame, folder: str) -> DataFrame:
    """The cards of the last whole version; none: like without rows."""
    found = _versions(like, folder)
    return like.sparkSession.read.parquet(found[-1]).drop("built_on") if found else like.where(F.lit(False))


# Sentences of memory cards, by kind (None: any); the first that has all it names is taken.
SENTENCES = [
    (None, "{prose}"),
    ("weekend", "In {place}: “{quote}”"),
    ("person_place", "{person} in {place} — “{quote}”"),
    (None, "“{quote}”"),
    ("weekend", "A weekend in {place}, {when}."),
    ("weekend", "A weekend spent in {place}."),
    ("weekend", "A weekend trip from {when}."),
    ("weekend", "A short trip worth remembering."),
    ("on_this_day", "Looking back at this day across the years."),
    (None, "Moments with {person} in {place}."),
    (None, "People and places that matter."),
]


def insight(kind: Column, place: Column, person: Column, subtitle: Column, quote: Column, prose: Column) -> Column:
    """A card's sentence: prose, else the quote in its setting, else one of its kind; blank is missing."""
    some = lambda c: F.when(~blank(c), F.trim(c))
    first = some(F.split_part(subtitle, F.lit(" · "), F.lit(1)))
    values = {"place": some(place), "person": some(person), "quote": some(quote), "prose": some(prose), "when": F.when(~first.contains("photo"), first)}
    found = []
    for own, sentence in SENTENCES:
        # null where a value is missing
        text = F.concat(*[c for said, name, *_ in Formatter().parse(sentence) for c in (F.lit(said), *([values[name]] if name else []))])
        found.append(F.when(kind == own, text) if own else text)
    return F.coalesce(*found)


def prompt(title: Column, subtitle: Column, quote: Column) -> Column:
    caption = F.coalesce(F.when(~blank(quote), F.trim(quote)), F.lit("(none)"))
    return F.concat(F.lit("Summarize this photo memory in one warm sentence.\nTitle: "), title, F.lit("\nDetails: "), subtitle, F.lit("\nCaption: "), caption, F.lit("\nSentence:"))


def prompt_hash(text: Column, model: str = PROSE_MODEL) -> Column:
    return F.sha2(F.concat(text, F.lit(model)), 256)


def sanitised(prose: Column, title: Column, subtitle: Column) -> Column:
    """The generated line, null if it is too short, too long, a refusal or an echo."""
    t = _stripped(F.btrim(_stripped(prose), F.lit('"')))
    low = F.lower(t)
    # What marks a refusal or a broken line.
    bad = F.lit(False)
    for word in ("i'm sorry", "i cannot", "i can't", "as an ai", "ethical", "against", "<pad>", "<unk>"):
        bad = bad | low.contains(word)
    echo = (low == F.lower(title)) | (low == F.lower(subtitle))
    cut = _stripped(F.regexp_replace(t, "^(Sentence:|Memory:|Summary:)", ""))
    ok = F.octet_length(t).between(12, 280) & ~bad & ~echo & (F.octet_length(cut) >= 12)
    return F.when(ok, cut)


def _diversify(limit: int, lam: float, near: float, penalty: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf.columns[0]
        pdf = pdf.sort_values(["base", "id"], ascending=[False, True]).reset_index(drop=True)
        has = pdf["vector"].notna().to_numpy()
        if not has.any():
            pdf = pdf.head(limit)
            return pd.DataFrame({key: pdf[key], "id": pdf["id"], "pos": np.arange(len(pdf))})
        width = max(len(v) for v in pdf["vector"][has])
        vec = np.zeros((len(pdf), width))
        for i in np.flatnonzero(has):
            v = np.asarray(pdf["vector"][i], dtype=float)
            vec[i, : len(v)] = v if len(v) == width else 0.0
        sims, base, open_, order = np.zeros(len(pdf)), pdf["base"].to_numpy(float), np.ones(len(pdf), bool), []
        while open_.any() and len(order) < limit:
            score = np.where(has, base - lam * sims - np.where(sims >= near, penalty, 0.0), base - 0.5)
            i = int(np.argmax(np.where(open_, score, -np.inf)))
            open_[i] = False
            order.append(i)
            if has[i]:
                sims = np.where(has, np.maximum(sims, vec @ vec[i]), sims)
        return pd.DataFrame({key: pdf[key][order].to_numpy(), "id": pdf["id"][order].to_numpy(), "pos": np.arange(len(order))})

    return run


def diversify(candidates: DataFrame, key: str, limit: int, most: int | None = None, lam: float = 0.65, near: float = 0.92, penalty: float = 12.0) -> DataFrame:
    """(key, id, pos): greedy diverse order of candidates(key, id, base, vector).

    All of a group take part; ``most`` limits them to the best by base, as the
    reference does when it loads them.  A group is held by one task.
    """
    ship(candidates.sparkSession)
    top = candidates.select(key, "id", F.col("base").cast("double").alias("base"), "vector")
    if most is not None:
        w = Window.partitionBy(key).orderBy(F.desc("base"), "id")
        top = top.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    kind = dict(candidates.dtypes)[key]
    return top.groupBy(key).applyInPandas(_diversify(limit, lam, near, penalty), f"{key} {kind}, id string, pos int")
