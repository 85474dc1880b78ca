"""Command line: python -m keyloom.cli --db PATH COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyloom")
    p.add_argument("--db", required=True, help="folder of the database, or a connection string")
    sub = p.add_subparsers(dest="command", required=True)
    commands = {
        "table-list": [], "table-create": ["table", "key_schema", "value_schema"], "table-get": ["table"], "table-delete": ["table"], "table-rename": ["table", "to"],
        "row-browse": ["table"], "row-query": ["table", "query"], "row-get": ["table", "key"], "row-insert": ["table", "key", "value"], "row-put": ["table", "key", "value"],
        "row-delete": ["table", "key"], "index-create": ["table", "index", "members"], "index-list": ["table"], "index-drop": ["table", "index"],
        "index-rebuild": ["table", "index"], "explain": ["table", "query"],
    }
    for name, arguments in commands.items():
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        if name == "index-create":
            c.add_argument("--unique", action="store_true")
        if name == "row-browse":
            c.add_argument("--limit", type=int)
            c.add_argument("--from-key")
            c.add_argument("--to-key")
            c.add_argument("--backward", action="store_true")
    return p


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def run(spark, args: argparse.Namespace):
    from urllib.parse import urlencode

    from keyloom.sources.database import Database
    from keyloom.sources.service import Service

    db = Database.from_connection(spark, args.db) if "=" in args.db else Database(spark, args.db)
    s, c = Service(db), args.command
    if c == "table-list":
        return db.tables()
    if c == "table-create":
        s.create_table(args.table, json.loads(args.key_schema), json.loads(args.value_schema))
    elif c == "table-get":
        return db.descriptor(args.table)
    elif c == "table-delete":
        db.drop(args.table)
    elif c == "table-rename":
        db.rename(args.table, args.to)
    elif c == "row-browse":
        said = {"limit": args.limit, "fromKey": args.from_key, "toKey": args.to_key, "direction": "backward" if args.backward else None}
        return s.get(args.table, urlencode({k: v for k, v in said.items() if v is not None}))
    elif c == "row-query":
        return s.post_query(args.table, json.loads(args.query)) if args.query.lstrip().startswith("{") else s.get(args.table, args.query)
    elif c == "row-get":
        return s.get_row(args.table, _value(args.key))
    elif c in ("row-insert", "row-put"):
        getattr(s, c.removeprefix("row-"))(args.table, [{"key": _value(args.key), "value": json.loads(args.value)}])
    elif c == "row-delete":
        s.delete(args.table, [_value(args.key)])
    elif c == "index-create":
        s.create_index(args.table, args.index, args.members.split(","), args.unique)
    elif c == "index-list":
        return db.descriptor(args.table)["indexes"]
    elif c == "index-drop":
        s.drop_index(args.table, args.index)
    elif c == "index-rebuild":
        s.rebuild_index(args.table, args.index)
    elif c == "explain":
        return s.explain(args.table, args.query)
    db.commit()
    return "done"


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    try:
        out = run(SparkSession.builder.appName("keyloom").getOrCreate(), args)
    except (KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
