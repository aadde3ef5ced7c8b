"""Command line: crawl recorded or live boards, re-parse, and look at results."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from datetime import UTC, datetime

from lodestack.errors import LodestackError

OK, FAILED, USAGE = 0, 1, 2


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname.lower(), "logger": record.name, "event": record.getMessage()})


def configure_logging(level: str = "INFO", as_json: bool = False) -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if as_json else logging.Formatter("%(levelname)s %(name)s %(message)s"))
    logging.basicConfig(level=level, handlers=[handler], force=True)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestack")
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--log-level", default="INFO")
    p.add_argument("--json-logs", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("crawl", "reparse"):
        v = verbs.add_parser(verb)
        v.add_argument("bundle", help="a recorded board, or the description of a live one")
        v.add_argument("--max-pages", type=int)
        v.add_argument("--allow-network", action="store_true")
    for verb in ("stats", "runs"):
        verbs.add_parser(verb).add_argument("--limit", type=int, default=20)
    verbs.add_parser("adapters")
    return p


def main(argv: list[str] | None = None, spark=None, out=print) -> int:
    try:
        args = build_parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code == 0 else USAGE
    configure_logging(args.log_level.upper(), args.json_logs)
    from lodestack.operators import rollups
    from lodestack.plans.pipeline import Store, crawl, reparse
    from lodestack.session import local_session
    from lodestack.sources import adapters, http, recorded
    from lodestack.sources.board_config import BoardConfig

    if args.verb == "adapters":
        out("\n".join(adapters.available()))
        return OK
    now = datetime.now(UTC).replace(tzinfo=None)
    spark = spark or local_session()
    store = Store(spark, args.store)
    try:
        if args.verb in ("crawl", "reparse"):
            live = args.bundle.endswith((".yml", ".yaml"))
            if live and args.verb == "crawl" and not args.allow_network:
                out("live crawls need --allow-network")
                return USAGE
            adapter = adapters.get_adapter("htmlboard", config=BoardConfig.from_yaml(args.bundle)) if live else adapters.get_adapter("fixture", spark=spark, root=args.bundle)
            if args.verb == "crawl":
                fetch = http.fetch if live else lambda f: recorded.answer(f, adapter.recorded())
                result = crawl(store, adapter, fetch, now, max_pages=args.max_pages)
            else:
                result = reparse(store, adapter, now)
            out(result.summary())
            out(result.payload())
            return OK if result.status == "succeeded" else FAILED
        if args.verb == "stats":
            out(rollups.overview(store.read("job_items"), now).toJSON().first())
            for r in rollups.by_source(store.read("job_items")).limit(args.limit).collect():
                out(f"{r['source']}\t{r['n']}")
        else:
            for r in rollups.recent_runs(store.read("crawl_runs"), args.limit).collect():
                out(f"{r['id']}\t{r['adapter']}\t{r['status']}\t{r['items_seen']}")
        return OK
    except LodestackError as e:
        out(f"error: {e}")
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
