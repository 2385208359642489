"""Command line: scan, docgen, assess, keygen, verify and ui.

    python -m auditloom scan PATH [--format sarif] [--output F] [--articles 5 14] [--fail-on high_risk]

Exit codes: 0 passes, 1 findings break the gate or a bundle is invalid, 2 the input can't be used.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.errors import PySparkException

from .plans import report as rp
from .plans.rules import TIERS


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("auditloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="auditloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "docgen"):
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--output")
        s.add_argument("--articles", nargs="*")
        s.add_argument("--rules-dir")
    scan, docgen = sub.choices["scan"], sub.choices["docgen"]
    scan.add_argument("--format", choices=("terminal", "json", "markdown", "sarif"), default="terminal")
    scan.add_argument("--fail-on", choices=TIERS, help="strictest tier that still passes; without it any finding fails")
    scan.add_argument("--sign", type=Path, help="private key; writes a signed bundle instead")
    scan.add_argument("--signer", default="")
    docgen.add_argument("--system", default="AI system")
    docgen.add_argument("--version", default="1.0.0")
    a = sub.add_parser("assess", help="answers as a JSON object; without a file they are asked for")
    a.add_argument("answers", type=Path, nargs="?")
    u = sub.add_parser("ui", help="console over HTTP on this machine")
    u.add_argument("path", nargs="?", default=".")
    u.add_argument("--port", type=int, default=8765)
    k = sub.add_parser("keygen")
    k.add_argument("folder", type=Path)
    k.add_argument("name")
    v = sub.add_parser("verify")
    v.add_argument("bundle", type=Path)
    v.add_argument("public_key", type=Path)
    return p


def _out(text: str, path: str | None) -> None:
    if path:
        rp.write_report(path, text)
    else:
        print(text)


def _scan(args) -> int:
    from .plans import evidence
    from .plans import rules as rl
    from .plans import scan as sc

    catalog = rl.builtin().plus(rl.from_dir(args.rules_dir)) if args.rules_dir else None
    report = sc.scan_path(_session(), args.path, catalog, articles=args.articles)
    if args.command == "docgen":
        _out(rp.to_dossier(report, args.system, args.version), args.output)
        return 0
    if args.sign:
        _out(json.dumps(evidence.sign_report(report, args.sign, args.signer), indent=2), args.output)
    else:  # a terminal table written to a file is Markdown
        _out(rp.RENDERERS["markdown" if args.output and args.format == "terminal" else args.format](report), args.output)
    return sc.exit_code(report, args.fail_on or report.effective_config["enforce_risk_tier"])


def _assess(args) -> int:
    from .plans import console

    if args.answers is None:
        print(console.to_text(console.assessed(_session(), console.asked(input))))
    else:
        print(json.dumps(console.assessed(_session(), json.loads(args.answers.read_text(encoding="utf-8"))), indent=2))
    return 0


def _ui(args) -> int:
    from .plans import console

    served = console.Console(_session(), args.path)
    served.warm()
    with console.serve(served, args.port) as server:
        print(f"http://127.0.0.1:{server.server_address[1]}/")
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command in ("scan", "docgen"):
            return _scan(args)
        if args.command == "assess":
            return _assess(args)
        if args.command == "ui":
            return _ui(args)
        from .plans import evidence

        if args.command == "keygen":
            print(*evidence.generate_keypair(args.folder, args.name))
            return 0
        valid, reason = evidence.verify_bundle(args.bundle, args.public_key)
        print(reason)
        return int(not valid)
    except (ValueError, OSError, PySparkException) as e:  # readers fail inside Spark
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
