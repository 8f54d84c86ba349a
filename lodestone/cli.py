"""Command line: index, search, context, status, roots, rebuild, remove-root, upgrade, watch."""

from __future__ import annotations

import argparse
import json
import sys

from lodestone.functions.text import parse_types, terminal_text
from lodestone.operators.search import DEFAULT_LIMIT, Scope
from lodestone.plans import context
from lodestone.plans.index import Index
from lodestone.plans.roots import resolve_scope
from lodestone.plans.session import SearchSession
from lodestone.session import session
from lodestone.streaming import watch
from lodestone.streaming.source import folder_events


def _scope(index: Index, args: argparse.Namespace) -> Scope:
    types = tuple(parse_types(args.type)) if args.type else ()
    if not args.root:
        return Scope(types)
    meta = index.meta
    root, subtree = resolve_scope(list(meta["roots"]), [tuple(x) for x in meta["ignore_scopes"]], dict(meta["history"]), args.root)
    return Scope(types, root, subtree)


def main(argv: list[str] | None = None) -> int:
    """0: done; 2: misuse; 3: the index is incomplete."""
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("--store", required=True, help="folder of the index")
    parser.add_argument("--master", default="local[*]")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("index", "rebuild", "remove-root"):
        verbs.add_parser(verb).add_argument("folder")
    for verb in ("search", "context"):
        one = verbs.add_parser(verb)
        one.add_argument("query")
        one.add_argument("--type")
        one.add_argument("--root")
        one.add_argument("--all-terms", action="store_true")
        one.add_argument("--page", type=int, default=1)
        one.add_argument("--page-size", type=int, default=DEFAULT_LIMIT)
    verbs.choices["context"].add_argument("--select", help="positions of the page's results, such as 1,3; all of them if not given")
    watching = verbs.add_parser("watch")
    watching.add_argument("--debounce-ms", type=int, default=watch.DEBOUNCE_MS)
    watching.add_argument("--background", action="store_true")
    watching.add_argument("--seconds", type=float, help="ends after so long; without it, with the process")
    verbs.add_parser("upgrade")
    verbs.add_parser("status")
    verbs.add_parser("roots")
    args = parser.parse_args(argv)
    index = Index.open(session(args.master), args.store)
    try:
        if args.verb in ("index", "rebuild"):
            report = index.sync(args.folder, rebuild=args.verb == "rebuild")
            print(json.dumps(report, ensure_ascii=False))
            return 0 if report["complete"] else 3
        if args.verb == "remove-root":
            print(index.remove_root(args.folder))
        elif args.verb == "search":
            page = SearchSession(index, args.query, all_terms=args.all_terms, scope=_scope(index, args)).page(args.page, args.page_size)
            print(f"{page.start}-{page.end} / {page.total}")
            for r in page.rows.collect():
                print(f"{r['position']}. [{r['reason']}] {terminal_text(r['path'])}\n   {terminal_text(r['snippet']['text'])}")
        elif args.verb == "context":
            found = SearchSession(index, args.query, all_terms=args.all_terms, scope=_scope(index, args))
            rows = found.page(args.page, min(args.page_size, context.MOST_SELECTED)).rows.collect()
            wanted = {int(k) for k in args.select.split(",")} if args.select else {r["position"] for r in rows}
            chosen = [(args.query, r["reference"]) for r in rows if r["position"] in wanted]
            print(context.markdown(context.prepare(index, chosen, all_terms=args.all_terms, scope=_scope(index, args)), [args.query]))
        elif args.verb == "upgrade":
            print(index.store.upgrade())
        elif args.verb == "watch":
            folder = f"{index.store.folder}/watch"
            roots = lambda: list(index.store.meta()["roots"])
            told = lambda row, error: print(json.dumps({"root": row["root"], "paths": row["paths"], "state": row["state"], "failures": row["failures"], "error": error}, ensure_ascii=False), flush=True)
            events = folder_events(index.store.spark, roots(), f"{folder}/listings")
            how = watch.Settings.of(debounce_ms=args.debounce_ms, background=args.background)
            query = watch.watch(index.store.spark, events, lambda root, paths: index.apply(root, paths), folder, roots, how=how, on_work=told)
            query.awaitTermination(args.seconds) if args.seconds else query.awaitTermination()
            query.stop()
        elif args.verb == "roots":
            print(json.dumps(index.meta["roots"], ensure_ascii=False, indent=1))
        else:
            meta = index.meta
            print(json.dumps({"snapshot": index.number, "format": index.store.format_status(), "ready": index.number > 0 and all(r.get("complete") for r in meta["roots"].values()), "roots": meta["roots"]}, ensure_ascii=False))
            for name, frame in index.status().items():
                print(json.dumps({name: [r.asDict() for r in frame.collect()]}, ensure_ascii=False))
    except (ValueError, LookupError) as error:
        print(error, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
