"""Command line: ``python -m evenkeel.cli list | run QUERY DIR [--out DIR] | report DIR | digest DOMAIN FILE``.

Results are canonical JSON lines on standard output, errors one such line on standard error.  Exit codes: 0 done,
1 no policy passes (report), 2 wrong usage, 3 input refused, 4 anything else.
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import sys

from .functions import canonical


def plain(value):
    """A row's value as JSON has it: decimals and times as text, integers beyond 2^53 - 1 and odd floats too."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    odd = isinstance(value, decimal.Decimal) or (isinstance(value, int) and abs(value) > canonical.SAFE) or (isinstance(value, float) and value - value != 0)
    return str(value) if odd else value


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="evenkeel")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="rows of a query")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out", help="write Parquet to this folder, which must not exist, in place of printing")
    report = commands.add_parser("report", help="the development report")
    report.add_argument("tables")
    nominate = commands.add_parser("nominate", help="the nomination on the development split")
    nominate.add_argument("tables")
    confirm = commands.add_parser("confirm", help="the confirmation of a nomination on the holdout split")
    confirm.add_argument("tables")
    confirm.add_argument("nomination", help="what nominate printed")
    digest = commands.add_parser("digest", help="domain digest of a JSON document")
    digest.add_argument("domain")
    digest.add_argument("file")
    return parser


def _queries() -> dict:
    from .plans import assess, catalog, chains, collector, control, decisions, logs, manifests, nomination, records, shadow, streams

    return {name: query for part in (catalog, control, assess, nomination, records, chains, decisions, streams, collector, manifests, shadow, logs) for name, query in part.queries().items()}


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("evenkeel").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _run(args, say) -> int:
    if args.command == "list":
        for name in sorted(_queries()):
            say({"query": name})
    elif args.command == "run":
        queries = _queries()
        if args.query not in queries:
            raise KeyError(args.query)
        rows = queries[args.query](_spark(), args.tables)
        if args.out:
            rows.write.mode("errorifexists").parquet(args.out)
        else:
            for row in rows.toLocalIterator():  # a partition at a time
                say(plain(row.asDict(recursive=True)))
    elif args.command == "report":
        from . import report

        spark, queries = _spark(), _queries()
        chosen = queries["select_policy"](spark, args.tables)
        text = report.development(queries["policy_metrics_v1"](spark, args.tables), queries["gates_v1"](spark, args.tables), chosen, {"tables": canonical.domain_digest("evenkeel/tables/1", args.tables)})
        sys.stdout.write(text)
        return 1 if "No policy passes" in text else 0
    elif args.command == "nominate":
        from .plans import nomination

        found = nomination.nominated(_spark(), args.tables)
        say(found["nomination"] or {"status": found["status"]})
        return 0 if found["nomination"] else 1
    elif args.command == "confirm":
        from .plans import nomination
        from .sources import bounded

        with open(args.nomination, "rb") as f:
            artifact = bounded.parse(f.read())
        say(nomination.confirmed(_spark(), args.tables, artifact))
    else:
        from .sources import bounded

        with open(args.file, "rb") as f:
            say({"digest": canonical.domain_digest(args.domain, bounded.parse(f.read()))})
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as end:
        return 2 if end.code else 0
    try:
        return _run(args, lambda row: print(canonical.encode(row)))
    except KeyError:
        code, name = 2, "unknown-query"
    except (ValueError, OSError) as error:
        code, name = 3, getattr(error, "code", None) or "input-refused"
    except Exception:  # noqa: BLE001 - the message may hold input
        code, name = 4, "internal"
    print(canonical.encode({"error": str(name)}), file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
