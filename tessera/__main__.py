"""python -m tessera {inspect,cleanup,health} --root DIR --model NAME: look at a store, or prune it."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import functions as F

from .config import from_environment
from .errors import TesseraError
from .functions.misc import format_bytes
from .plans import retention, stats
from .session import get_session
from .sources.store import Store


def inspect(store: Store, args) -> None:
    if args.url:
        row = stats.per_document(store.document(args.url), store.chunks.filter(F.col("url") == args.url)).first()
        print("not found" if row is None else "\n".join(f"{k}: {v}" for k, v in row.asDict().items()))
    elif args.tables:
        for name, rows, columns in store.tables():
            print(f"{name:<20} {rows:<10} {columns:<10} {format_bytes(stats.table_bytes(rows, columns))}")
    else:
        row = stats.store_stats(store.documents, store.chunks, store.meta).first().asDict()
        print("\n".join(f"{k}: {v}" for k, v in (row | {"files": format_bytes(store.size_bytes())}).items()))


def cleanup(store: Store, args) -> None:
    if args.days < 0:
        raise TesseraError("days must not be negative")
    cutoff = F.lit(dt.datetime.now(dt.timezone.utc) - dt.timedelta(days=args.days))
    report = retention.dry_run(store.documents, store.chunks, cutoff).first().asDict()
    print(f"{report['documents']} documents, {report['chunks']} chunks, about {format_bytes(report['bytes_saved'])}")
    if report["documents"] and not args.dry_run:
        store.delete_expired(cutoff)
        if args.vacuum:
            store.compact()
        print("removed")


def health(store: Store, args) -> None:
    settings = from_environment()
    print(f"model {settings.embedding_model}, provider {settings.search_provider}, store {store.root}, {store.documents.count()} documents")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("inspect", inspect), ("cleanup", cleanup), ("health", health)):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("--root", required=True)
        sub.add_argument("--model", required=True)
        if name == "inspect":
            sub.add_argument("--url")
            sub.add_argument("--tables", action="store_true")
        if name == "cleanup":
            sub.add_argument("--days", type=int, default=30)
            sub.add_argument("--dry-run", action="store_true")
            sub.add_argument("--vacuum", action="store_true")
    args = parser.parse_args(argv)
    try:
        args.run(Store(get_session(), args.root, args.model), args)
    except TesseraError as e:
        print(f"{e.kind}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
