"""Command line: `verify` re-checks a store, `evidence` writes its bundle for an auditor.

Exit code 0 if every claim holds, 1 if one fails, 2 without a command.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .engine import Engine
from .operators.erase import evidence_markdown


def verify(engine: Engine, user: str | None = None, deep: bool = False) -> int:
    """Report the chain, and with `user` whether that subject is erased: a tombstone and nothing left."""
    found = engine.verify_audit(deep)
    print(f"{'content' if deep else 'chain'}: {'ok' if found.ok else f'broken at {found.broken_at}'}, {found.entries} entries")
    if user is None:
        return 0 if found.ok else 1
    left, gone = engine.timeline(user).count(), engine.is_forgotten(user)
    state = "not erased" if not gone else f"incomplete, {left} facts left" if left else "erased"
    print(f"subject {user}: {state}")
    return 0 if found.ok and state == "erased" else 1


def write_evidence(engine: Engine, out: str = ".", deep: bool = False) -> int:
    """Write evidence.json and EVIDENCE.md into the folder `out`, which is made if absent."""
    summary, erasures = engine.evidence(deep), engine.erasures().collect()  # one row for each erased subject
    certificates = engine.certificates().collect()  # as many as erasures
    bundle = summary.asDict() | {"deep": deep, "register": [e.asDict() for e in erasures], "certificates": [c.asDict() for c in certificates]}
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "evidence.json").write_text(json.dumps(bundle, indent=2, default=lambda t: t.isoformat()) + "\n")
    (folder / "EVIDENCE.md").write_text(evidence_markdown(summary, erasures, certificates))
    print(f"{'ok' if summary.ok else 'FAILED'}: {len(erasures)} erasures, {summary.entries} entries, written to {folder}")
    return 0 if summary.ok else 1


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chronofact")
    commands = parser.add_subparsers(dest="command")
    for name in ("verify", "evidence"):
        command = commands.add_parser(name)
        command.add_argument("--path", default="chronofact-store", help="folder of the store")
        command.add_argument("--deep", action="store_true", help="derive the contents' hashes again, too")
    commands.choices["verify"].add_argument("--user", help="check this subject's erasure, too")
    commands.choices["evidence"].add_argument("--out", default=".", help="folder for the bundle")
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 2
    if engine is None:
        from pyspark.sql import SparkSession

        engine = Engine(SparkSession.builder.getOrCreate(), args.path)
    return verify(engine, args.user, args.deep) if args.command == "verify" else write_evidence(engine, args.out, args.deep)


if __name__ == "__main__":
    raise SystemExit(main())
