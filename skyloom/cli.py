"""Command line: python -m skyloom.cli [--store DIR] [--sources FILE] COMMAND

run, fetch, sources (list, add, enable, disable, check), stats, feedback (add, list), schedule (install, remove, show), backend.
Exit codes: 0 done, 1 something failed (a source's check, a verdict on an unknown relation, the scheduler, the language
model), 2 a wrong id.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skyloom.plans import backends, daily, schedule
from skyloom.plans.store import Store
from skyloom.schemas import FEEDBACK_KINDS, RATINGS
from skyloom.session import cut, importable
from skyloom.sources import config, feeds


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skyloom", description="news monitoring on Spark")
    p.add_argument("--store", default="store", help="folder of the tables")
    p.add_argument("--sources", default="sources.yaml")
    p.add_argument("--out", default="briefs", help="folder of the briefs")
    p.add_argument("--prompts", default="prompts", help="folder of prompt templates, for a language model")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="the daily run")
    run.add_argument("--hours", type=int, default=24)
    run.add_argument("--top", type=int, default=6)
    commands.add_parser("fetch", help="collect and store only")
    commands.add_parser("stats", help="how many rows the tables have")
    s = commands.add_parser("sources").add_subparsers(dest="action", required=True)
    s.add_parser("list").add_argument("--enabled", action="store_true")
    add = s.add_parser("add")
    for name in ("id", "name", "url"):
        add.add_argument(f"--{name}", required=True)
    for name, kind, default in (("type", str, "rss"), ("language", str, "en"), ("region", str, "global"), ("perspective", str, "unlabeled"), ("weight", float, 1.0), ("fetch-interval", int, 60)):
        add.add_argument(f"--{name}", type=kind, default=default)
    for name in ("enable", "disable"):
        s.add_parser(name).add_argument("id")
    check = s.add_parser("check")
    check.add_argument("--all", action="store_true")
    check.add_argument("--timeout", type=float, default=20)
    f = commands.add_parser("feedback").add_subparsers(dest="action", required=True)
    give = f.add_parser("add")
    give.add_argument("--kind", choices=FEEDBACK_KINDS, required=True)
    give.add_argument("--target", type=int, required=True)
    give.add_argument("--rating", choices=RATINGS, required=True)
    give.add_argument("--note", default="")
    give.add_argument("--ref", default="")
    told = f.add_parser("list")
    told.add_argument("--kind", choices=FEEDBACK_KINDS)
    told.add_argument("--limit", type=int, default=20)
    when = commands.add_parser("schedule", help="the daily run by cron or the Windows scheduler").add_subparsers(dest="action", required=True)
    for name in ("install", "remove", "show"):
        one = when.add_parser(name)
        one.add_argument("--name", default=schedule.NAME)
        if name == "install":
            one.add_argument("--time", default="07:00")
            one.add_argument("--arguments", default="", help="more arguments of the run")
    commands.add_parser("backend", help="asks the configured language model one question")
    return p


def check_backend(backend) -> int:
    """Whether the language model answers a screening question as the run needs it."""
    if backend is None:
        print("no language model is configured; the rules judge")
        return 0
    cards = [{"id": 1, "title": "Earthquake shakes the capital", "text": "Rescue teams are on their way."}, {"id": 2, "title": "A recipe for plum cake", "text": "With almonds."}]
    got = backends.screened(backend, cards)
    print(f"{backend.name} {backend.model}: " + ("no usable answer" if got is None else "; ".join(f"#{r['id']} relevant={r['relevant']} topic={r['topic']} severity={r['severity']}" for r in got)))
    return int(got is None)


def edit_sources(args: argparse.Namespace) -> int:
    """The commands on the source list that need no Spark."""
    known = config.load_sources(args.sources)
    if args.action == "list":
        for s in known:
            if s.enabled or not args.enabled:
                print(f"{s.id:<22} {s.language:<3} {s.region:<12} w={s.weight:<4} {s.perspective:<22} {s.name}{'' if s.enabled else ' [disabled]'}")
        return 0
    found = [s for s in known if s.id == args.id]
    if args.action == "add":
        if found:
            print(f"there is a source {args.id} already", file=sys.stderr)
            return 2
        fields = ("id", "name", "url", "type", "language", "region", "perspective", "weight")
        known.append(config.Source(**{k: getattr(args, k) for k in fields}, fetch_interval_minutes=args.fetch_interval))
    elif not found:
        print(f"there is no source {args.id}", file=sys.stderr)
        return 2
    else:
        found[0].enabled = args.action == "enable"
    config.save_sources(known, args.sources)
    return 0


def check_sources(spark: SparkSession, store: Store, args: argparse.Namespace, now: dt.datetime, fetch_fn=feeds.fetch) -> int:
    frame = config.sources_frame(spark, config.load_sources(args.sources, enabled_only=not args.all))
    timeout = args.timeout
    store.upsert_sources(frame, now)
    items = cut(feeds.collect(frame, lambda url: fetch_fn(url, timeout=timeout, retries=0), error_chars=200))
    store.update_health(feeds.health(items, frame), now + dt.timedelta(seconds=1))
    failed = 0
    for r in items.groupBy("source_id").agg(F.count_if(F.col("error").isNull()).alias("n"), F.first("error", ignorenulls=True).alias("error")).orderBy("source_id").collect():
        failed += r["error"] is not None
        print(f"FAIL  {r['source_id']:<22} {r['error'][:120]}" if r["error"] else f"ok    {r['source_id']:<22} items={r['n']}")
    print(f"checked={frame.count()} failures={failed}")
    return int(failed > 0)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, now: dt.datetime | None = None, fetch_fn=feeds.fetch) -> int:
    args = parser().parse_args(argv)
    if args.command == "sources" and args.action != "check":
        return edit_sources(args)
    if args.command == "schedule":
        code, said = schedule.act(args.action, getattr(args, "time", "07:00"), arguments=getattr(args, "arguments", ""), name=args.name)
        print(said)
        return code
    if args.command == "backend":
        return check_backend(backends.from_environment(lambda name: config.load_prompt(args.prompts, name)))
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    spark = importable(spark or SparkSession.builder.appName("skyloom").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    store = Store(spark, args.store)
    if args.command == "sources":
        return check_sources(spark, store, args, now, fetch_fn)
    if args.command in ("run", "fetch"):
        frame = config.sources_frame(spark, config.load_sources(args.sources, enabled_only=True))
        if args.command == "fetch":
            got = daily.fetch(store, frame, now, fetch_fn)
            print(f"fetched={got['fetched']} new={got['new']} source_errors={len(got['errors'])}")
            for e in got["errors"]:
                print(f"  {e['source_id']}: {e['error']}", file=sys.stderr)
        else:
            backend = backends.from_environment(lambda name: config.load_prompt(args.prompts, name))
            print(daily.run(store, frame, now, args.out, daily.Options(hours=args.hours, top_n=args.top, trigger="cli"), fetch_fn=fetch_fn, backend=backend))
    elif args.command == "stats":
        for r in store.stats().collect():
            print(f"{r['name']:>16}: {r['n']}")
    elif args.action == "add":
        new, applied = store.save_feedback(args.kind, args.target, args.rating, now, args.note, args.ref)
        print(f"feedback #{new} saved{'; the relation has a new status' if applied else ''}")
        return int(args.kind == "event_relation" and args.rating in ("confirm", "reject") and not applied)
    else:
        rows = store.feedback(args.kind, args.limit).collect()
        for r in rows:
            print(f"#{r['id']} {r['created_at']} {r['kind']:<14} target={r['target_id']} rating={r['rating']}" + (f" ref={r['ref']}" if r["ref"] else "") + (f" note={r['note']}" if r["note"] else ""))
        print(f"total={len(rows)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
