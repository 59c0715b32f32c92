"""Secret scans over an incremental ledger of blobs, in DataFrame functions alone.

Every version of every path is addressed by the SHA-256 of its content. A ledger has a row for
each (blob, rule, rule version) that was ever scanned, with its spans. A run scans only the pairs
that the ledger lacks, each blob once however many paths hold it, and joins the findings back to
all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: Pieces into which the copies of one blob are dealt when findings are joined back.
SALT = 16


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    hint: str | None = None  # a plain string that every match holds


# The rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----", 0, 20, hint="PRIVATE KEY-----"),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, hint="gh"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, hint="eyJ"),
)
RULES = BASE_RULES + MORE_RULES


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> in code points, end exclusive.

    The pieces between matches and the matches themselves come in the same order, so a running
    sum of their lengths gives the places.
    """
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, pattern, 0), F.length)
    kept = F.transform(F.regexp_extract_all(text, pattern, rule.group), F.length) if rule.group else found
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("n"), kept.alias("kept"))
    walk = F.aggregate(
        F.slice(rows, 1, F.size(found)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["n"]).alias("at"),
            F.when(
                m["kept"] >= rule.least,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["n"]).alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    hit = text.rlike(rule.pattern) if rule.hint is None else text.contains(rule.hint) & text.rlike(rule.pattern)
    return F.when(hit, walk).otherwise(none)


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(paths: DataFrame, ledger: DataFrame | None = None, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, kind, version, spans) of the pairs that ``ledger`` lacks.

    ``paths`` may hold any number of versions of a path as rows. Equal texts are one blob; a null
    text is the empty blob. An empty table gives no rows.
    """
    blobs = paths.select(content_address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is not None:
        # Blobs that every rule version has seen go before their texts are shuffled.
        want = F.array(*[F.concat_ws(":", F.lit(r.kind), F.lit(r.version)) for r in rules])
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", F.col("version").cast("string"))).alias("_seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("_todo", F.array_except(want, F.coalesce("_seen", F.array().cast("array<string>")))).filter(F.size("_todo") > 0)
    else:
        blobs = blobs.withColumn("_todo", F.lit(None).cast("array<string>"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"), F.first("_todo").alias("_todo"))
    wanted = lambda r: F.col("_todo").isNull() | F.array_contains("_todo", f"{r.kind}:{r.version}")
    # A pair that the ledger has is null here, and its spans are never looked for.
    found = F.array(*[F.when(wanted(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules])
    rows = blobs.select("blob", F.explode(found).alias("f"))
    return rows.filter("f is not null").select("blob", "f.kind", "f.version", "f.spans")


def findings_by_path(paths: DataFrame, ledger: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``paths`` and ``_found``: kind, start and end of each finding, by start, then kind as listed.

    Only blobs with findings are joined, and the paths of a blob are dealt over ``SALT`` keys, so
    a content that a third of the paths hold does not meet in one task.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    rank = order[F.concat_ws(":", "kind", F.col("version").cast("string"))]
    hits = (
        ledger.withColumn("_rank", rank).filter(F.col("_rank").isNotNull() & (F.size("spans") > 0))
        .select("blob", F.explode("spans").alias("s"), "_rank", "kind")
        .groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("s.start", F.col("_rank").alias("rank"), "s.end", "kind"))).alias("_found"))
        .withColumnRenamed("blob", "_blob").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    )
    # A hash of the row and no random number: a task that runs again deals as before.
    own = [f.name for f in paths.schema if f.name != text_col and isinstance(f.dataType, AtomicType)]
    salted = paths.withColumn("_blob", content_address(F.col(text_col))).withColumn("_salt", F.pmod(F.xxhash64(F.lit(7), *own), F.lit(SALT)).cast("int"))
    return salted.join(hits, ["_blob", "_salt"], "left").drop("_salt", "_blob")


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_findings(docs: DataFrame, ledger: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of each row; ``spans`` has those of all rules.

    Null and empty texts have none. Repeated rows each give a row. Other columns are ignored.
    With a ``ledger``, what it already has is not scanned again.
    """
    new = scan_blobs(docs.select(text_col), ledger, text_col=text_col, rules=rules)
    everything = new if ledger is None else ledger.select("blob", "kind", "version", "spans").unionByName(new)
    found = findings_by_path(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), everything, text_col="_text", rules=rules)
    found = found.withColumn("_found", F.coalesce("_found", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))
    base = F.filter("_found", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("_id").alias(id_col), *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_found")).alias("spans"),
    )


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding replaced by ``mask``; overlapping findings are masked once. Null stays null.

    All rows and columns stay, whatever the columns are called.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    column = f"c{docs.columns.index(text_col)}"
    ledger = scan_blobs(plain.select(column), text_col=column, rules=rules)
    found = findings_by_path(plain, ledger, text_col=column, rules=rules)
    text = F.col(column)
    state = "struct<at:int,text:string>"
    masked = F.aggregate(
        F.col("_found"), F.struct(F.lit(0).alias("at"), F.lit("").alias("text")).cast(state),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["text"]).otherwise(F.concat(acc["text"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).alias("text"),
        ).cast(state)),
        lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return found.withColumn(column, F.when(F.col("_found").isNull(), text).otherwise(masked)).select(*plain.columns).toDF(*docs.columns)


__all__ = ["BASE_RULES", "RULES", "Rule", "findings_by_path", "redact", "scan_blobs", "secret_findings", "spans"]
