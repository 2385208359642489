"""From matches to findings, and what is summed over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import finding_hash, json_string
from ..plans.rules import SEVERITIES, TIERS, Catalog, rules_table
from ..sources.tables import stored

#: What the scan id of a scan without findings is a digest of; a parameter.
EMPTY = "EMPTY_CLEAN_SCAN"


def rank(tier: Column) -> Column:
    """0 for the strictest tier."""
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier).cast("int") - 1


def identified(matches: DataFrame, catalog: Catalog) -> DataFrame:
    """Matches with their rule's attributes and the finding's id."""
    attributes = rules_table(matches.sparkSession, catalog).drop("rule_id")
    df = matches.join(F.broadcast(attributes), "rule_ord")
    return df.withColumn("id", finding_hash(F.col("rule_id"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("target"), F.col("snippet")))


def first_of_each(found: DataFrame) -> DataFrame:
    """One finding for each rule, file and first line: that of the first engine, rule, pattern and fact."""
    w = W.partitionBy("rule_id", "path", "start_line").orderBy("engine", "rule_ord", "pattern_ord", "ord", "id")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def path_key(path: Column) -> Column:
    """What paths are ordered by: their parts."""
    return F.split(path, "/")


def report_order() -> list[Column]:
    """Files by path parts, then the order in which engines report."""
    late = F.when(F.col("engine").isin(1, 4), F.col("start_line")).otherwise(0)
    return [path_key(F.col("path")), F.col("engine"), late, F.when(F.col("engine") == 1, F.col("id")), F.col("rule_ord"), F.col("pattern_ord"), F.col("ord")]


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy(*report_order())


def counts_by(found: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, value, findings for every tier or severity, zero where there are none."""
    values = TIERS if column == "risk_tier" else SEVERITIES
    sums = [F.count_if(F.col(column) == v).alias(v) for v in values]
    wide = found.groupBy(*keys).agg(*sums) if keys else found.agg(*sums)
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias(column), F.col(v).alias("findings")) for v in values])))


def overall_risk(found: DataFrame, *keys: str) -> DataFrame:
    """keys, risk_tier: the strictest tier; without findings the least."""
    worst = F.coalesce(F.min(rank(F.col("risk_tier"))), F.lit(len(TIERS) - 1))
    out = found.groupBy(*keys).agg(worst.alias("r")) if keys else found.agg(worst.alias("r"))
    return out.select(*keys, F.get(F.array(*[F.lit(t) for t in TIERS]), F.col("r")).alias("risk_tier"))


def gate(found: DataFrame, allowed: str | None, *keys: str) -> DataFrame:
    """keys, passes: no finding at all, or with `allowed` none in a stricter tier."""
    breaks = F.count("*") if allowed is None else F.count_if(rank(F.col("risk_tier")) < TIERS.index(allowed))
    out = found.groupBy(*keys).agg(breaks.alias("n")) if keys else found.agg(breaks.alias("n"))
    return out.select(*keys, (F.col("n") == 0).alias("passes"))


def _in_order(rows: DataFrame, keys: tuple[str, ...], order: list[Column], piece: Column, name: str, around: tuple[str, str, str], empty: str | None = None) -> DataFrame:
    """keys, and in `name` the SHA-256 of each key's pieces in order, opened, separated and closed by `around`.
    The rows of a key stream through its task, which holds one batch of them and a state of the
    digest; the sort before it spills to disk. Without keys there is always one row."""
    opened, between, closed = (x.encode() for x in around)
    names = [f"_k{i}" for i in range(len(keys))]
    cols = [F.col(k).alias(n) for k, n in zip(keys, names)] + [c.alias(f"_o{i}") for i, c in enumerate(order)]
    df, by = rows.select(*cols, piece.alias("_piece"), F.lit(True).alias("_real")), [f"_o{i}" for i in range(len(order))]
    if keys:
        df = df.repartition(*names).sortWithinPartitions(*names, *by)
    else:  # a row of nulls stands for the table, which may be empty
        none = rows.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema[:-1]], F.lit(False).alias("_real"))
        df = df.unionByName(none).repartition(1).sortWithinPartitions(*by)
    df = df.select(*names, "_piece", "_real")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n = None, hashlib.sha256(), 0

        def ended() -> tuple:
            text = empty.encode() if not n and empty is not None else closed if n else opened + closed
            state.update(text)
            return (*(now or ()), state.hexdigest())

        for batch in batches:
            out = []
            own = list(zip(*(batch.column(i).to_pylist() for i in range(len(names))))) if names else [()] * batch.num_rows
            for key, piece, real in zip(own, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                if now is not None and key != now:
                    out.append(ended())
                    state, n = hashlib.sha256(), 0
                now = key
                if real:
                    state.update((between if n else opened) + (piece or "").encode())
                    n += 1
            if out:
                yield _rows(out)
        if now is not None:
            yield _rows([ended()])

    schema = StructType([StructField(n, rows.schema[k].dataType) for n, k in zip(names, keys)] + [StructField(name, StringType())])
    arrow = to_arrow_schema(schema)

    def _rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, arrow.field(i).type) for i, v in enumerate(zip(*found))], schema=arrow)

    return df.mapInArrow(run, schema).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], name)


def scan_id(found: DataFrame, *keys: str, empty: str = EMPTY) -> DataFrame:
    """keys, scan_id: digest of the sorted finding ids. It is a digest of one sequence, so a scan's ids stream
    through one task, in bounded memory; `merkle.tree` has a digest for which no task sees all of them."""
    return _in_order(found, keys, [F.col("id")], F.col("id"), "scan_id", ("", "|", ""), empty)


def manifest(raw: DataFrame) -> DataFrame:
    """path, sha256, size_bytes of sources (path, content)."""
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"))


def manifest_entry() -> Column:
    """An entry of the manifest as compact canonical JSON."""
    return F.concat(F.lit('{"path":'), json_string(F.col("path")), F.lit(',"sha256":"'), "sha256", F.lit('","size_bytes":'), F.col("size_bytes").cast("string"), F.lit("}"))


def manifest_fingerprint(entries: DataFrame, *keys: str) -> DataFrame:
    """Digest of the manifest as compact canonical JSON, files in order of their paths' parts; entries of
    one scan stream through one task, as in scan_id."""
    return _in_order(entries, keys, [path_key(F.col("path")), manifest_entry()], manifest_entry(), "manifest_hash", ("[", ",", "]"))


def placed(found: DataFrame, *keys: str, order: list[Column] | None = None) -> DataFrame:
    """found with `place`, its number from 1 within keys in the given order (that of reports by default).
    Rows are dealt to ranges of the order and sorted there; a range's rows are numbered on their own, and
    what the ranges before it have of the same key is added from a table of counts. No key meets in one task."""
    order = report_order() if order is None else order
    by = [f"_o{i}" for i in range(len(order))]
    df = found.withColumns({n: c for n, c in zip(by, order)})
    dealt = df.repartitionByRange(*[F.col(k) for k in (*keys, *by)]).sortWithinPartitions(*keys, *by).drop(*by)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed-rows")
    dealt = dealt.withColumns({"_range": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at")
    counts = dealt.groupBy("_range", *keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k_{k}") for k in keys], (F.coalesce(upto, F.lit(0)) - F.col("_first") + 1).alias("_start"))
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return dealt.join(starts, on).select(*found.columns, (F.col("_row") + F.col("_start")).alias("place"))


def rule_index(found: DataFrame, *keys: str) -> DataFrame:
    """keys, rule_id, rule_index: rules in the order in which the findings first name them.
    found: needs `place`, an orderable column."""
    first = found.groupBy(*keys, "rule_id").agg(F.min("place").alias("place"))
    return first.select(*keys, "rule_id", (F.row_number().over(W.partitionBy(*keys).orderBy("place")) - 1).alias("rule_index"))


def baseline_diff(actual: DataFrame, reviewed: DataFrame, columns: tuple[str, ...] = ("id", "rule_id", "path", "start_line")) -> DataFrame:
    """Multiset differences: change (`new` or `gone`) and the columns, as often as they differ."""
    a, b = actual.select(*columns), reviewed.select(*columns)
    return a.exceptAll(b).withColumn("change", F.lit("new")).unionByName(b.exceptAll(a).withColumn("change", F.lit("gone")))


#: How many lines a finding may have moved to be taken for the same.
BAND = 50


def aligned_diff(actual: DataFrame, reviewed: DataFrame, band: int = BAND, what: tuple[str, ...] = ("rule_id", "path", "target", "snippet"), line: str = "start_line") -> DataFrame:
    """Differences by `what` and line, where a finding that only moved is `moved`, not gone and new: change (`new`,
    `gone` or `moved`), the columns of `what`, line and old_line (null where there is none).

    Findings that are the same in both are taken out first, as often as they are in both. Of the rest, those
    with equal `what` are aligned: each looks for the nearest of the other side, up to band lines away (the upper
    one of two at the same distance), by an as-of look at its neighbours in line order; two that choose each
    other are one that moved. Pairs found are taken out, and the rest tries again until no pair is left to
    find. `baseline_diff` is the exact form, and stays the default of reviews."""
    keys = [*what, line]
    left = lambda a, b: a.select(*keys).exceptAll(b.select(*keys)).select(*what, F.col(line).alias("at"))
    number = F.row_number().over(W.partitionBy(*what, "at").orderBy(F.lit(0)))
    sides = left(actual, reviewed).withColumn("new", F.lit(True)).unionByName(left(reviewed, actual).withColumn("new", F.lit(False)))
    open_ = stored(sides, "diff-open")
    pairs: DataFrame | None = None
    while True:
        met = stored(_mutual(open_.select(*what, "at", "new").withColumn("n", number), what, band), "diff-pairs")
        if met.isEmpty():
            break
        pairs = met if pairs is None else pairs.unionByName(met)
        used = met.select(*what, F.col("at"), F.lit(True).alias("new")).unionByName(met.select(*what, F.col("old").alias("at"), F.lit(False).alias("new")))
        open_ = stored(open_.exceptAll(used), "diff-open")
    out = open_.select(F.when(F.col("new"), "new").otherwise("gone").alias("change"), *what, F.when(F.col("new"), F.col("at")).alias(line), F.when(~F.col("new"), F.col("at")).alias("old_line"))
    if pairs is not None:
        out = out.unionByName(pairs.select(F.lit("moved").alias("change"), *what, F.col("at").alias(line), F.col("old").alias("old_line")))
    return out


def _mutual(rows: DataFrame, what: tuple[str, ...], band: int) -> DataFrame:
    """what, at, old of rows that choose each other. Rows at one line are numbered, and the n-th is one line for itself."""
    order = W.partitionBy(*what).orderBy("at", "n", "new")
    above, below = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    me = F.struct("at", "n")
    theirs = lambda side, pick, w: pick(F.when(F.col("new") == side, me), ignorenulls=True).over(w)
    up = F.when(F.col("new"), theirs(False, F.last, above)).otherwise(theirs(True, F.last, above))
    down = F.when(F.col("new"), theirs(False, F.first, below)).otherwise(theirs(True, F.first, below))
    df = rows.withColumns({"up": up, "down": down})
    far = lambda c: F.abs(F.col("at") - F.col(f"{c}.at"))
    nearer = F.col("down").isNull() | (F.col("up").isNotNull() & (far("up") <= far("down")))
    df = df.withColumn("choice", F.when(nearer, F.col("up")).otherwise(F.col("down"))).filter(F.abs(F.col("at") - F.col("choice.at")) <= band)
    side = lambda new, name: df.filter(F.col("new") == new).select(*[F.col(w).alias(f"{name}_{w}") for w in what], F.struct("at", "n").alias(f"{name}_me"), F.col("choice").alias(f"{name}_choice"))
    on = (F.col("a_me") == F.col("b_choice")) & (F.col("b_me") == F.col("a_choice"))
    for w in what:
        on = on & F.col(f"a_{w}").eqNullSafe(F.col(f"b_{w}"))
    met = side(True, "a").join(side(False, "b"), on)
    return met.select(*[F.col(f"a_{w}").alias(w) for w in what], F.col("a_me.at").alias("at"), F.col("b_me.at").alias("old"))


def changed_files(actual: DataFrame, reviewed: DataFrame) -> DataFrame:
    """path, change of files that are new, gone or of other content."""
    a, b = actual.select("path", F.col("sha256").alias("x")), reviewed.select("path", F.col("sha256").alias("y"))
    met = a.join(b, "path", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
    return met.select("path", F.when(F.col("y").isNull(), "new").when(F.col("x").isNull(), "gone").otherwise("changed").alias("change"))


def published_differences(artifacts: DataFrame, published: DataFrame) -> DataFrame:
    """artifacts: filename, sha256; published: filename, sha256, yanked (null: not). filename, problem of every artifact
    that an index does not serve as it is: `missing`, `yanked` (whatever its digest) or `changed`. A file that is
    published several times is judged by its worst entry."""
    p = published.groupBy("filename").agg(F.max(F.coalesce("yanked", F.lit(False))).alias("yanked"), F.min("sha256").alias("low"), F.max("sha256").alias("high"), F.lit(True).alias("there"))
    met = artifacts.alias("a").join(p.alias("p"), "filename", "left")
    same = F.col("low").eqNullSafe(F.col("a.sha256")) & F.col("high").eqNullSafe(F.col("a.sha256"))
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("yanked"), "yanked").when(~same, "changed")
    return met.select("filename", problem.alias("problem")).filter("problem IS NOT NULL")


#: Release lists of package indexes: the JSON of a version (`urls`, `digests`) and the simple index (`files`, `hashes`).
_RELEASES = "struct<urls:array<struct<filename:string,yanked:string,digests:struct<sha256:string>>>,files:array<struct<filename:string,yanked:string,hashes:struct<sha256:string>>>>"


def published_files(answers: DataFrame, *keys: str, payload: str = "payload") -> DataFrame:
    """keys, filename, sha256, yanked of every file that index answers (JSON texts) list. A reason, which simple
    indexes give in place of true, counts as yanked, also an empty one; an answer that is no JSON lists nothing."""
    r = F.from_json(payload, _RELEASES)
    each = lambda files, digests: F.transform(F.coalesce(files, F.array().cast(_files(digests))), lambda f: F.struct(f["filename"].alias("filename"), f[digests]["sha256"].alias("sha256"), (f["yanked"].isNotNull() & (f["yanked"] != "false")).alias("yanked")))
    return answers.select(*keys, F.inline(F.concat(each(r["urls"], "digests"), each(r["files"], "hashes"))))


def _files(digests: str) -> str:
    return f"array<struct<filename:string,yanked:string,{digests}:struct<sha256:string>>>"


def detection_quality(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """truth: case_id, expected; predicted: case_id. One row: tp, fp, tn, fn, precision, recall, f1."""
    p = predicted.select("case_id").distinct().withColumn("hit", F.lit(True))
    j = truth.join(p, "case_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    n = j.agg(*[F.count_if((F.col("expected") == e) & (F.col("hit") == h)).alias(k) for k, e, h in (("tp", True, True), ("fp", False, True), ("tn", False, False), ("fn", True, False))])
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    n = n.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})
    total = F.col("precision") + F.col("recall")
    return n.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


_SARIF = "struct<runs:array<struct<results:array<struct<ruleId:string>>,invocations:array<struct<executionSuccessful:boolean>>>>>"


def sarif_counts(logs: DataFrame, *keys: str) -> DataFrame:
    """logs: keys, sarif. keys, findings_count, completed: results of all runs, and whether every run
    says that it succeeded. A log that is none, or has no run, is not completed."""
    runs = F.from_json("sarif", _SARIF)["runs"]
    n = F.aggregate(runs, F.lit(0), lambda a, r: a + F.greatest(F.size(r["results"]), F.lit(0)))
    ok = (F.size(runs) > 0) & F.forall(runs, lambda r: (F.size(r["invocations"]) > 0) & F.forall(r["invocations"], lambda i: F.coalesce(i["executionSuccessful"], F.lit(False))))
    return logs.select(*keys, F.coalesce(n, F.lit(0)).alias("findings_count"), F.coalesce(ok, F.lit(False)).alias("completed"))


def ci_outputs(spark: SparkSession, code: int, sarif: str | None = None, form: str = "sarif") -> dict[str, str]:
    """What a build step publishes of a scan that ended with code (0 or 1; others are errors):
    scan_status, findings_count and sarif_ready. Only a complete SARIF log tells the count."""
    failed = {"scan_status": "error", "findings_count": "", "sarif_ready": "false"}
    if code not in (0, 1):
        return failed
    if form != "sarif":
        return {**failed, "scan_status": ("completed", "violations_found")[code]}
    n, complete = sarif_counts(spark.createDataFrame([(sarif,)], "sarif string")).first()
    if not complete or code and not n:
        return failed
    return {"scan_status": "violations_found" if n else "no_findings", "findings_count": str(n), "sarif_ready": "true"}


def result_counts(spark: SparkSession, sarif: str) -> dict:
    return sarif_counts(spark.createDataFrame([(sarif,)], "sarif string")).first().asDict()
