"""A console over HTTP for one project on this machine, and questions on a terminal.

Operations are functions of a request's values; a table says which path and method leads
to which. A request is bounded before it is read, its JSON before it is used, a job by a
clock, and an answer before it is sent: what exceeds a limit is refused, never cut.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import NamedTuple
from urllib.parse import parse_qs, urlsplit

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ..functions.strict import load_json
from ..operators import assess as asm
from . import evidence
from . import report as rp
from . import scan as sc

#: Bytes of a request and of an answer, depth and nodes of a request's JSON, seconds of a job, requests at once.
LIMITS = {"request": 2 << 20, "answer": 8 << 20, "depth": 32, "nodes": 100_000, "seconds": 30.0, "connections": 8}
_TYPES = {"json": "application/json", "sarif": "application/sarif+json", "markdown": "text/markdown; charset=utf-8", "html": "text/html; charset=utf-8"}
_HEADERS = {"X-Content-Type-Options": "nosniff", "Cache-Control": "no-store", "Content-Security-Policy": "default-src 'none'; style-src 'unsafe-inline'", "X-Frame-Options": "DENY"}


class Refused(Exception):
    def __init__(self, status: int, why: str) -> None:
        super().__init__(why)
        self.status = status


class Answer(NamedTuple):
    status: int
    kind: str
    body: bytes


def bounded_json(data: bytes) -> dict:
    """A JSON object of a request, within depth and nodes."""
    try:
        value = load_json(data.decode("utf-8"))
    except (ValueError, RecursionError) as e:
        raise Refused(400, "not JSON of the accepted form") from e
    if not isinstance(value, dict):
        raise Refused(400, "an object is needed")
    level, seen, depth = [value], 0, 0
    while level:
        seen, depth = seen + len(level), depth + 1
        if seen > LIMITS["nodes"] or depth > LIMITS["depth"]:
            raise Refused(413, "too many values or levels")
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
    return value


def assessed(spark: SparkSession, answers: dict) -> dict:
    """One context's assessment; unknown names and values that are no answer are refused."""
    known = {"intended_purpose": str, "role": str, "system_name": str, **dict.fromkeys(asm.ANSWERS, bool)}
    for k, v in answers.items():
        if k not in known or not (v is None or isinstance(v, known[k])):
            raise ValueError(f"unknown answer {k}")
    row = (answers.get("intended_purpose") or "", answers.get("role") or "unknown", *(answers.get(a) for a in asm.ANSWERS))
    schema = "intended_purpose string, role string, " + ", ".join(f"{a} boolean" for a in asm.ANSWERS)
    out = asm.assess(spark.createDataFrame([row], schema)).first().asDict()
    return {k: v for k, v in out.items() if k not in asm.ANSWERS}


class Console:
    """The operations on one project; root is all that a request can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, os.path.abspath(root)
        self.jobs = ThreadPoolExecutor(LIMITS["connections"])
        self.routes: dict[tuple[str, str], Callable[[dict], Answer]] = {
            ("GET", "/"): self.listing, ("GET", "/api/scan"): self.scan, ("POST", "/api/scan"): self.scan,
            ("POST", "/api/docgen"): self.docgen, ("POST", "/api/assess"): self.assess, ("POST", "/api/verify"): self.verify,
        }

    def _within(self, seconds: float, operation: Callable[[dict], Answer], values: dict) -> Answer:
        """The operation's answer in time. One that is late is ended: its running Spark jobs are cancelled,
        and those that it would still start are refused."""
        sc_, group = self.spark.sparkContext, f"console-{uuid.uuid4().hex}"

        def run() -> Answer:
            sc_.setJobGroup(group, "console", interruptOnCancel=True)
            return operation(values)

        job = self.jobs.submit(run)
        try:
            return job.result(seconds)
        except Late:
            job.cancel()
            sc_._jsc.sc().cancelJobGroupAndFutureJobs(group)
            raise

    def warm(self) -> None:
        """One scan, so that the first request does not wait for the session's first plans."""
        try:
            self._report({})
        except (ValueError, OSError, PySparkException):
            pass  # requests say what is wrong with the project

    def _report(self, values: dict) -> sc.Report:
        path = os.path.abspath(os.path.join(self.root, str(values.get("path") or ".")))
        if path != self.root and not path.startswith(self.root + os.sep):
            raise Refused(403, "outside the project")
        articles = values.get("articles")
        return sc.scan_path(self.spark, path, articles=[str(a) for a in articles] if isinstance(articles, list) else None)

    def listing(self, values: dict) -> Answer:
        return Answer(200, "html", rp.to_html(self._report({})).encode())

    def scan(self, values: dict) -> Answer:
        form = values.get("format") or "json"
        if form not in ("json", "sarif", "markdown"):
            raise Refused(400, "unknown format")
        return Answer(200, form, rp.RENDERERS[form](self._report(values)).encode())

    def docgen(self, values: dict) -> Answer:
        return Answer(200, "markdown", rp.to_dossier(self._report(values), str(values.get("system") or "AI system"), str(values.get("version") or "1.0.0")).encode())

    def assess(self, values: dict) -> Answer:
        return Answer(200, "json", json.dumps(assessed(self.spark, values)).encode())

    def verify(self, values: dict) -> Answer:
        if set(values) != {"bundle", "public_key"} or not isinstance(values["bundle"], dict) or not isinstance(values["public_key"], str):
            raise Refused(400, "a bundle and a public key are needed")
        try:
            key = bytes.fromhex(values["public_key"])
        except ValueError as e:
            raise Refused(400, "the key is 32 bytes in hexadecimal") from e
        valid, reason = evidence.verify_bundle(values["bundle"], key)
        return Answer(200, "json", json.dumps({"valid": valid, "reason": reason}).encode())

    def answer(self, method: str, target: str, body: bytes = b"") -> Answer:
        """A request's answer; whatever goes wrong becomes a status and one line."""
        try:
            parts = urlsplit(target)
            operation = self.routes.get((method, parts.path))
            if operation is None:
                raise Refused(405 if any(p == parts.path for _, p in self.routes) else 404, "no such operation")
            if len(body) > LIMITS["request"]:
                raise Refused(413, "request too large")
            values = bounded_json(body) if method == "POST" else {k: v[-1] for k, v in parse_qs(parts.query).items()}
            out = self._within(LIMITS["seconds"], operation, values)
            if len(out.body) > LIMITS["answer"]:
                raise Refused(413, "answer too large")
            return out
        except Refused as e:
            status, why = e.status, str(e)
        except Late:
            status, why = 503, "the job takes too long"
        except (ValueError, OSError, PySparkException) as e:
            status, why = 422, (str(e) or type(e).__name__).splitlines()[0]
        return Answer(status, "json", json.dumps({"error": rp.display(why)[:300]}).encode())


def serve(console: Console, port: int = 0) -> ThreadingHTTPServer:
    """A server on this machine's loopback address; the caller runs and closes it."""
    free = threading.BoundedSemaphore(LIMITS["connections"])

    class Handler(BaseHTTPRequestHandler):
        timeout = 10

        def _handle(self) -> None:
            if not free.acquire(blocking=False):
                return self._send(Answer(503, "json", b'{"error": "busy"}'))
            try:
                self._send(self._answered())
            finally:
                free.release()

        def _answered(self) -> Answer:
            refuse = lambda status, why: Answer(status, "json", json.dumps({"error": why}).encode())
            # Pages of other origins can neither name this host nor send JSON unasked.
            if self.headers.get("Host", "").rsplit(":", 1)[0] not in ("127.0.0.1", "localhost"):
                return refuse(403, "unknown host")
            if self.command == "GET":
                return console.answer("GET", self.path)
            length = self.headers.get("Content-Length", "")
            if not length.isdigit() or int(length) > LIMITS["request"]:
                return refuse(413 if length.isdigit() else 411, "a bounded length is needed")
            if self.headers.get("Content-Type", "").split(";")[0].strip() != "application/json":
                return refuse(415, "JSON is needed")
            return console.answer("POST", self.path, self.rfile.read(int(length)))

        def _send(self, answer: Answer) -> None:
            self.send_response(answer.status)
            for k, v in {**_HEADERS, "Content-Type": _TYPES[answer.kind], "Content-Length": str(len(answer.body)), "Connection": "close"}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(answer.body)
            self.close_connection = True

        do_GET = do_POST = _handle

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


# -- questions on a terminal ------------------------------------------------

_QUESTIONS = {
    "is_ai": "Is it an AI system?", "eu_scope": "Is it placed on the market or used in the EU?", "prohibited_practice": "Does it serve a practice that Art. 5 prohibits?",
    "annex_i_product": "Is it a product of Annex I, or a safety component of one?", "third_party_conformity": "Does that product need a third party's conformity assessment?", "annex_iii_use": "Is its use listed in Annex III?",
    "profiling": "Does it profile natural persons?", "narrow_exception": "Does it only do a narrow or preparatory task?", "transparency": "Does it talk with people or generate content?",
    "gpai_provider": "Do you provide a general-purpose model?", "personal_data": "Does it process personal data?", "solely_automated_significant_decision": "Does it decide on persons by itself, with significant effect?",
}
_REPLIES = {"y": True, "yes": True, "n": False, "no": False, "?": None, "": None}


def asked(ask: Callable[[str], str]) -> dict:
    """Answers by asking; `?` or nothing leaves one open, anything else asks again."""
    out: dict = {"intended_purpose": ask("Intended purpose: ").strip(), "role": ask(f"Role ({', '.join(asm.ROLES)}): ").strip().lower() or "unknown"}
    while out["role"] not in asm.ROLES:
        out["role"] = ask(f"One of {', '.join(asm.ROLES)}: ").strip().lower() or "unknown"
    for name, question in _QUESTIONS.items():
        reply = ask(f"{question} (y/n/?) ").strip().lower()
        while reply not in _REPLIES:
            reply = ask("y, n or ? ").strip().lower()
        out[name] = _REPLIES[reply]
    return out


def to_text(assessment: dict) -> str:
    """An assessment for a terminal."""
    lists = {"Articles": "applicable_articles", "Obligations": "obligations", "Dates": "deadlines", "Open questions": "missing_context"}
    out = [f"Tier: {assessment['risk_tier'] or 'not determined'}", assessment["rationale"]]
    out += [f"{title}:" + "".join(f"\n  - {rp.display(x)}" for x in assessment[k]) for title, k in lists.items() if assessment[k]]
    return "\n".join([*out, f"Status: {assessment['status']}"])
