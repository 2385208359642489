"""Signed evidence: a report, its canonical bytes, and a signature over them."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from datetime import UTC, datetime
from pathlib import Path

from ..functions import ed25519
from ..functions.strict import load_json
from ..operators.findings import EMPTY
from ..sources.srctree import read_stable
from .scan import Report

VERSION, ALGORITHM = "1.0", "Ed25519"
FIELDS = {"version", "algorithm", "signer", "signed_at", "public_key_fingerprint", "report", "signature"}


def key_fingerprint(public: bytes) -> str:
    return "SHA256:" + hashlib.sha256(public).hexdigest()


def canonical(bundle: dict) -> bytes:
    """What is signed: everything but the signature, keys sorted, compact, ASCII."""
    return json.dumps({k: v for k, v in bundle.items() if k != "signature"}, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()


def _key(key: Path | bytes) -> bytes:
    """A Path is read; bytes are the key itself."""
    data = read_stable(str(key.absolute()), 4096) if isinstance(key, Path) else key
    if len(data) != 32:
        data = bytes.fromhex(data.decode("ascii").strip())
    if len(data) != 32:
        raise ValueError("a key has 32 bytes")
    return data


def generate_keypair(folder: Path, name: str) -> tuple[Path, Path]:
    """name.key and name.pub, only if neither is there; the private one for its owner alone."""
    if not name or "/" in name or name.startswith("."):
        raise ValueError("a key needs a plain name")
    seed = ed25519.new_key()
    made: list[Path] = []
    try:
        for suffix, mode, data in ((".key", 0o600, seed), (".pub", 0o644, ed25519.public_key(seed))):
            path = folder / (name + suffix)
            fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, mode)
            made.append(path)
            with os.fdopen(fd, "w") as f:
                f.write(data.hex() + "\n")
    except BaseException:
        for path in made:
            path.unlink()
        raise
    return made[0], made[1]


def sign_report(report: Report, key: Path | bytes, signer: str) -> dict:
    if not signer.strip():
        raise ValueError("a signer needs a name")
    seed = _key(key)
    bundle = {"version": VERSION, "algorithm": ALGORITHM, "signer": signer, "signed_at": datetime.now(UTC).isoformat(), "public_key_fingerprint": key_fingerprint(ed25519.public_key(seed)), "report": report.as_dict()}
    return bundle | {"signature": base64.b64encode(ed25519.sign(seed, canonical(bundle))).decode()}


def _scan_id(findings: list[dict]) -> str:
    return hashlib.sha256(("|".join(sorted(f["id"] for f in findings)) or EMPTY).encode()).hexdigest()


def verify_bundle(bundle: dict | str | Path, public: Path | bytes) -> tuple[bool, str]:
    """(valid, reason). Whatever is malformed is invalid; nothing is repaired."""
    try:
        if isinstance(bundle, Path):
            bundle = read_stable(str(bundle.absolute()), 64 << 20).decode("utf-8")
        if isinstance(bundle, str):
            bundle = load_json(bundle)
        if not isinstance(bundle, dict) or set(bundle) != FIELDS:
            return False, "fields"
        if bundle["version"] != VERSION or bundle["algorithm"] != ALGORITHM:
            return False, "version or algorithm"
        if not isinstance(bundle["signer"], str) or not bundle["signer"].strip():
            return False, "signer"
        if datetime.fromisoformat(bundle["signed_at"]).tzinfo is None:
            return False, "time without zone"
        report = Report(**bundle["report"])
        if report.as_dict() != bundle["report"]:
            return False, "report"
        key = _key(public)
        if bundle["public_key_fingerprint"] != key_fingerprint(key):
            return False, "key"
        if report.scan_id != _scan_id(report.findings):
            return False, "scan id"
        signature = base64.b64decode(bundle["signature"], validate=True)
        if len(signature) != 64 or base64.b64encode(signature).decode() != bundle["signature"]:
            return False, "signature's form"
        return (True, "valid") if ed25519.verify(key, canonical(bundle), signature) else (False, "signature")
    except (ValueError, TypeError, KeyError, OSError) as e:
        return False, f"malformed: {type(e).__name__}"
