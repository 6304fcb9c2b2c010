"""python -m plumbline: check a store, plan or make repairs, undo them.

The exit status of a check is the bit-or of its findings' bits, cut to a byte; 128 if it
cannot be made, 129 for wrong arguments; of a repair 0, or 1 if something stays broken.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from plumbline import model
from plumbline.operators import report
from plumbline.plans import store_check, store_repair
from plumbline.sources import store

FLAGS = {
    "strict": "treat warnings as errors", "full": "look into packs too", "connectivity_only": "only follow links", "unreachable": "name what no root reaches",
    "dangling": "name what nothing links to", "reflogs": "histories are roots", "references": "check the refs themselves", "tags": "name what tags point to", "root": "name commits without a parent", "cache": "the index holds roots (it always does)",
    "name_objects": "say how objects can be called",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("plumbline", description=__doc__.split("\n")[0])
    p.add_argument("path", nargs="?", default=".")
    for name, text in FLAGS.items():
        p.add_argument("--" + name.replace("_", "-"), action=argparse.BooleanOptionalAction, default=getattr(model.Options, name), help=text)
    p.add_argument("--dry-run", action="store_true", help="check, and say what a repair would do")
    p.add_argument("--lost-found", action="store_true", help="write what nothing links to under lost-found")
    p.add_argument("--remote", help="another store on this machine to recover from")
    p.add_argument("--undo", metavar="RUN", help="bring back what a repair set aside")
    p.add_argument("--list-runs", action="store_true", help="name the repairs that set something aside")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else model.STATUS_USAGE
    try:
        git_dir = store.discover(args.path)
        if args.list_runs:
            print(*store_repair.runs(git_dir), sep="\n")
            return 0
        if args.undo:
            print(*store_repair.undo(git_dir, args.undo), sep="\n")
            return 0
        spark = SparkSession.builder.appName("plumbline").getOrCreate()
        if args.lost_found:
            print(*store_repair.write_lost_found(spark, args.path), sep="\n")
            return 0
        if args.dry_run:
            found = store_check.check(spark, args.path, model.Options(**{k: getattr(args, k) for k in FLAGS})).persist()
            for r in report.ordered(found).toLocalIterator():
                print(r["text"])
            for r in store_repair.described(store_repair.plan(spark, args.path, args.remote)).orderBy("oid").toLocalIterator():
                print(r["line"])
            return store_check.status(found) & 255
        result = store_repair.repair(spark, args.path, args.remote)
        for what in ("recovered", "refs", "unrecovered"):
            for name in getattr(result, what):
                print(what, name)
        return 0 if result.ok else 1
    except (OSError, ValueError) as e:
        print(f"fatal: {e}", file=sys.stderr)
        return model.STATUS_FATAL


if __name__ == "__main__":
    sys.exit(main())
