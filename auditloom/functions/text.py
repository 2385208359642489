"""Column expressions for lines, suppressions, expressions, paths and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marker of an inline suppression; a parameter of scans.
MARKER = "auditloom:ignore"
#: What ends a line: the boundaries that Python's splitlines knows.
_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def lines(text: Column) -> Column:
    """Lines of a text; a final line end opens no further line, the empty text has none."""
    cut = F.split(F.regexp_replace(text, rf"(?:{_END})\z", ""), _END, -1)
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def suppressed(line: Column, marker: str = MARKER, strip: str = ",;") -> Column:
    """Rule ids that a line suppresses, in capitals. The ids stand apart by blanks; a list
    joined by bare commas is one token and so suppresses nothing (kept as users know it)."""
    rest = F.get(F.split(line, re.escape(marker), -1), F.lit(1))
    edge = f"[{re.escape(strip)}]"
    tokens = F.transform(F.split(F.trim(rest), r"(?U)\s+"), lambda t: F.upper(F.regexp_replace(t, f"^{edge}+|{edge}+$", "")))
    return F.coalesce(F.array_distinct(F.filter(tokens, lambda t: t != "")), F.array().cast("array<string>"))


def java_regex(pattern: str) -> str:
    """A Python pattern for Java: Unicode classes, and \\s with the unit separator."""
    flags = re.match(r"\(\?([aiLmsux]+)\)", pattern)
    body = pattern[flags.end() :] if flags else pattern
    return f"(?{(flags[1] if flags else '')}U)" + _blank(body)


def _blank(body: str) -> str:
    out, i, inside = [], 0, False
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            out.append((r"\s\x1f" if inside else r"[\s\x1f]") if body[i + 1] == "s" else body[i : i + 2])
            i += 2
            continue
        inside = (inside or c == "[") and not (inside and c == "]")
        out.append(c)
        i += 1
    return "".join(out)


def match_start(line: Column, pattern: str) -> Column:
    """Zero-based code point at which the first match begins."""
    flags = re.match(r"\(\?[A-Za-z]+\)", pattern)
    head, body = (flags[0], pattern[flags.end() :]) if flags else ("", pattern)
    return F.length(F.regexp_extract(line, f"{head}(?s:^(.*?))(?:{body})", 1))


def match_length(line: Column, pattern: str) -> Column:
    return F.length(F.regexp_extract(line, pattern, 0))


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression; a star also crosses slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            body, i = glob[i:end].replace("\\", "\\\\"), end + 1
            out.append(f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]")
        else:
            out.append(re.escape(c))
    return rf"(?s)\A(?:{''.join(out)})(?![\s\S])"  # an end that Java and Python both know


def excluded(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        for p in (g.replace("\\", "/"), "*/" + g.replace("\\", "/")):
            out = out | path.rlike(glob_regex(p)) | F.concat(path, F.lit("/")).rlike(glob_regex(p))
    return out


def json_string(value: Column) -> Column:
    """A JSON string literal in ASCII, as a compact canonical encoder writes it."""
    named = {'"': r"\"", "\\": r"\\", "\n": r"\n", "\r": r"\r", "\t": r"\t", "\b": r"\b", "\f": r"\f"}

    def one(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        out = F.when(c.rlike(r"\A[\x20-\x7E]\z"), c).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))
        for k, v in named.items():
            out = F.when(c == k, F.lit(v)).otherwise(out)
        return out

    plain = value.rlike(r"\A[\x20\x21\x23-\x5B\x5D-\x7E]*\z")
    return F.concat(F.lit('"'), F.when(plain, value).otherwise(F.array_join(F.transform(F.split(value, ""), one), "")), F.lit('"'))


def finding_hash(rule_id: Column, path: Column, start: Column, end: Column, target: Column, snippet: Column) -> Column:
    """Identity of a finding: SHA-256 over its sorted-key JSON."""
    clean = strip(F.regexp_replace(snippet, "\r\n?", "\n"))
    pairs = [("end_line", end.cast("string")), ("file_path", json_string(strip(F.replace(path, F.lit("\\"), F.lit("/"))))), ("rule_id", json_string(F.upper(strip(rule_id)))),
             ("snippet_normalized", json_string(clean)), ("start_line", start.cast("string")), ("target", json_string(strip(target)))]
    parts: list[Column] = []
    for i, (k, v) in enumerate(pairs):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{k}": '), v]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def strip(value: Column) -> Column:
    """Without blanks at either end, Unicode ones included."""
    return F.regexp_replace(value, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def package_name(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "[-_.]+", "-"))
