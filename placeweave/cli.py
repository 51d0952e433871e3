"""Command line over a folder of Parquet tables: places, signals, evidence, reviews and runs.

    python -m placeweave.cli --data DIR ingest --feeds DIR --city CITY ...
    python -m placeweave.cli --data DIR score|tag|resolve|status|review|provenance|explain|itinerary|documents|health ...

`ingest` reads the feeds' folders that there are (google_places and yelp: JSON payloads; blog: a Parquet table of pages(target_id,
url, html); reddit: JSON threads) and replaces the tables by those after the batch. `score`, `tag`, `resolve` and `documents`
write a new table next to the old ones (places_scored, places_tagged, resolved, place_documents), the others print.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators import browse, resolve, scoring, tagging
from placeweave.operators.graph import cut
from placeweave.operators.keywords import keywords, stop_words
from placeweave.plans import documents, ingest, itinerary, report
from placeweave.plans.ingest import conform
from placeweave.sources import cards, comments, feeds, mentions


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, *names: str) -> DataFrame:
        """The first of these tables that there is."""
        for name in names[:-1]:
            try:
                return self.spark.read.parquet(f"{self.path}/{name}")
            except Exception as e:  # noqa: BLE001  the next name is tried
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return self.spark.read.parquet(f"{self.path}/{names[-1]}")

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def has(self, path: str) -> bool:
        at, files = self._files(path)
        return files.exists(at)

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Tables made from those of the same names: all are written beside them first, then each takes its place."""
        for name, df in tables.items():
            self.write(df, f"{name}.next")
        for name in tables:
            old, files = self._files(f"{self.path}/{name}")
            files.delete(old, True)
            if not files.rename(self._files(f"{self.path}/{name}.next")[0], old):
                raise OSError(f"{name}.next could not take the place of {name}")


def now_of(args: argparse.Namespace) -> Column:
    return F.lit(args.now or dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def ingest_feeds(s: Store, args: argparse.Namespace) -> None:
    spark, now, country = s.spark, now_of(args), args.country
    read = {
        "google_places": lambda p: feeds.map_places(feeds.read_maps(spark, p), args.city, country, now),
        "yelp": lambda p: feeds.listing_places(feeds.explode_listings(feeds.read_listings(spark, p)), args.city, country, now),
        "blog": lambda p: cards.card_places(cards.cards(spark.read.parquet(p)), args.city, country),
        "reddit": lambda p: mentions.raw_signals(mentions.aggregate(mentions.extract(comments.documents(comments.read_threads(spark, p))), args.city.lower()), args.city),
    }
    sources = [feeds.Source(name, None, lambda f=f, p=f"{args.feeds}/{name}": f(p)) for name, f in read.items() if s.has(f"{args.feeds}/{name}")]
    found, runs = feeds.run_all(spark, sources, args.city, args.now or dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S"))
    if not found:
        raise SystemExit(f"No feed could be read in {args.feeds}.")
    known = [conform(s.read(n), schema) if s.has(f"{s.path}/{n}") else spark.createDataFrame([], schema) for n, schema in (("places", ingest.PLACES), ("signals", ingest.SIGNALS), ("evidence", ingest.EVIDENCE), ("reviews", ingest.REVIEWS))]
    out = ingest.ingest(feeds.union_sources({n: conform(df, ingest.RAW).drop("source_rank") for n, df in found.items()}), ingest.Tables(*known))
    rows = cut(ingest.run_rows(runs, out.outcomes))
    all_runs = s.read("runs").unionByName(rows, allowMissingColumns=True) if s.has(f"{s.path}/runs") else rows
    s.replace({"places": out.places, "signals": out.signals, "evidence": out.evidence, "reviews": out.reviews, "runs": all_runs})
    for r in ingest.summary_lines(rows).orderBy("source").collect():
        print(r["line"])


def write_documents(s: Store, args: argparse.Namespace) -> None:
    s.write(documents.place_documents(s.read("places_tagged", "places_scored"), s.read("signals")), "place_documents")


def check_health(s: Store, args: argparse.Namespace) -> None:
    print(browse.health(s.spark).first()["status"])


def score(s: Store, args: argparse.Namespace) -> None:
    s.write(scoring.rescore(s.read("places"), s.read("signals"), now_of(args)), "places_scored")


def tag(s: Store, args: argparse.Namespace) -> None:
    places, evidence = s.read("places_scored", "places"), s.read("evidence")
    found = tagging.retag(places, s.read("signals"), evidence, tagging.phrase_table(s.spark), keywords(evidence, places, stop_words()))
    s.write(places.drop("tags").join(found, "place_id"), "places_tagged")


def resolve_records(s: Store, args: argparse.Namespace) -> None:
    s.write(resolve.resolve(s.read("places")), "resolved")


def status(s: Store, args: argparse.Namespace) -> None:
    for name, value in browse.status(s.read("places_tagged", "places_scored", "places"), s.read("signals"), s.read("reviews"), args.city).first().asDict().items():
        print(f"{name:<10} {value}")


def review(s: Store, args: argparse.Namespace) -> None:
    rows = browse.review_queue(s.read("reviews")).limit(args.limit).collect()
    for r in rows:
        print(f"conf={r['confidence']:.2f}  {r['left_id']} | {r['right_id']}")
    if not rows:
        print("No ambiguous merges pending review.")


def provenance(s: Store, args: argparse.Namespace) -> None:
    browse.provenance(s.read("runs").where(F.col("city") == args.city), s.read("signals")).show(truncate=False)


def explain(s: Store, args: argparse.Namespace) -> None:
    places = s.read("places")
    place = report.find_place(places, args.city, args.name).select("place_id", "name").first()
    if place is None:
        raise SystemExit(f"No place matching {args.name!r} in {args.city}.")
    scored = scoring.score_signals(s.read("signals"), places, now_of(args)).where(F.col("place_id") == place["place_id"])
    total = scored.agg(F.sum("weight")).first()[0]
    print(place["name"])
    for r in report.signal_lines(scored, F.lit(total)).orderBy(F.desc("weight")).select("line").collect():
        print("  " + r["line"])
    for r in report.breakdown_lines(scoring.composite(scored)).collect():
        print("  " + r["line"])


def plan(s: Store, args: argparse.Namespace) -> None:
    places = s.read("places_tagged", "places_scored")
    r = itinerary.Request(args.city, dt.date.fromisoformat(args.start), days=args.days, pace=args.pace, tags=tuple(args.tag), avoid=tuple(args.avoid), max_price_tier=args.max_price_tier)
    found = itinerary.itineraries(places, {"trip": r})
    day = None
    for x in report.itinerary_lines(found, places).orderBy("day", "position").collect():
        if x["day"] != day:
            day = x["day"]
            print(f"Day {day} - {r.start + dt.timedelta(days=day - 1)}")
        print(f"  {x['position']}. {x['line']}")
    for line in report.unused_lines(found, places):
        print("- " + line)


COMMANDS = {"ingest": ingest_feeds, "documents": write_documents, "health": check_health, "score": score, "tag": tag, "resolve": resolve_records, "status": status, "review": review, "provenance": provenance, "explain": explain, "itinerary": plan}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data", required=True)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("name", nargs="?")
    p.add_argument("--city", default="")
    p.add_argument("--country")
    p.add_argument("--feeds", default="feeds")
    p.add_argument("--now")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--start", default=dt.date.today().isoformat())
    p.add_argument("--days", type=int, default=3)
    p.add_argument("--pace", default="moderate")
    p.add_argument("--tag", action="append", default=[])
    p.add_argument("--avoid", action="append", default=[])
    p.add_argument("--max-price-tier", type=int, default=4)
    args = p.parse_args(argv)
    COMMANDS[args.command](Store(spark or SparkSession.builder.getOrCreate(), args.data), args)


if __name__ == "__main__":
    main()
