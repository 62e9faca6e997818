"""Secret scans over a ledger of content-addressed versions.

A version of a file is addressed by the SHA-256 of its content. The ledger
keeps, for every (blob, rule, rule version), the spans found, and also that
nothing was found. A scan reads each blob that lacks some current rule once,
however many paths and versions have it, adds the missing pairs to the ledger,
and joins the ledger back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from faultlens.llm.common import slices
from faultlens.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern, a test of its matches, and a version that changes when either does. ``base`` rules are the contract's."""

    name: str
    version: int
    pattern: re.Pattern
    keep: Callable[[re.Match], bool]
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: Base rules in the order in which they are listed. A run of 32 or more of the same characters is what is left of all runs.
RULES = (
    Rule("assign", 1, re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[1]) >= 8, True),
    Rule("access", 1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16, True),
    Rule("hex", 1, re.compile("[0-9a-f]{32,}"), lambda m: True, True),
    Rule("private_key", 1, re.compile("-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----"), lambda m: True),
    Rule("web_token", 1, re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"), lambda m: True),
)
#: What a text must contain for a rule to match at all.
_NEEDS = {"assign": (":", "="), "access": ("AKIA",), "private_key": ("-----BEGIN",), "web_token": ("eyJ",)}

_LEDGER = "blob string, rule string, version int, spans array<struct<first:int,last:int>>"


def rule_spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    needs = _NEEDS.get(rule.name)
    if needs and not any(n in text for n in needs):
        return []
    return [m.span() for m in rule.pattern.finditer(text) if rule.keep(m)]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty one if there is none yet."""
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


#: Blobs of a task that are remembered as scanned.
REMEMBERED = 1 << 16


def unseen(history: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, content, missing): each blob that lacks a pair, once, with the keys of the rules it lacks."""
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("done"))
    every = F.array(*[F.lit(r.key) for r in rules])
    # One path stands for a blob; texts move once, dealt out by path, so a blob at very many paths is no hot group.
    first = history.groupBy("blob").agg(F.min(F.struct("path")).alias("least")).select("blob", F.col("least.path").alias("path"))
    lacking = first.join(done, "blob", "left").select(
        F.col("blob").alias("wanted"), F.col("path").alias("at"), F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))).alias("missing")
    )
    lacking = lacking.filter(F.size("missing") > 0)
    same = history["path"].eqNullSafe(lacking["at"]) & (history["blob"] == lacking["wanted"])
    return history.join(lacking, same).select("blob", "content", "missing")


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    by_key = {r.key: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        seen: set[str] = set()
        for batch in slices(batches, "content"):
            rows = []
            for blob, text, missing in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                # Equal rows come to one task by the join, and are scanned once.
                if blob in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(blob)
                for key in missing:
                    rule = by_key[key]
                    rows.append((blob, rule.name, rule.version, [{"first": a, "last": b} for a, b in rule_spans(text or "", rule)]))
            kinds = (pa.string(), pa.string(), pa.int32(), span)
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["blob", "rule", "version", "spans"])

    return blobs.mapInArrow(run, _LEDGER)


def scan(versions: DataFrame, path: str, content: str, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at ``ledger_path`` up to date and return path, blob and ``findings`` of every row of ``versions``.

    ``findings`` are (kind, first, last) of the current rule versions by start,
    then in the order of ``rules``; code points, end exclusive. A null content
    is empty. Equal rows, equal contents and null paths are allowed. The blobs
    scanned are appended in one committed write: a job that is lost and run
    again leaves no half of it, and pairs written twice count once.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    history = versions.select(F.col(path).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("content"))
    spark = versions.sparkSession
    fresh = _scanned(unseen(history, read_ledger(spark, ledger_path), rules), rules)
    fresh.write.mode("append").option("compression", "zstd").parquet(ledger_path)

    current = F.concat_ws("@", "rule", F.col("version").cast("string")).isin([r.key for r in rules])
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    hits = read_ledger(spark, ledger_path).filter(current & (F.size("spans") > 0)).select("blob", "rule", F.explode("spans").alias("s"))
    hits = hits.select("blob", F.struct(F.col("s.first").alias("first"), rank[F.col("rule")].alias("rank"), F.col("s.last").alias("last"), F.col("rule").alias("kind")).alias("hit"))
    found = hits.groupBy("blob").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    found = found.select("blob", F.transform("hits", lambda h: F.struct(h["kind"].alias("kind"), h["first"].alias("first"), h["last"].alias("last"))).alias("findings"))
    return history.select("path", "blob").join(found, "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.array().cast("array<struct<kind:string,first:int,last:int>>")).alias("findings")
    )


def document_secrets(documents: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and blob of every row of ``documents``.

    Counts and hash are those of the base rules. Without a ``ledger_path`` the
    ledger is a new one in the shared folder.
    """
    ledger_path = ledger_path or scratch_path(documents.sparkSession, "secret-ledger")
    found = scan(documents.select("doc_id", "text"), "doc_id", "text", ledger_path, rules)
    base = [r.name for r in rules if r.base]

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")

    of_base = F.filter("findings", lambda s: s["kind"].isin(base))
    kinds = F.transform("findings", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select(
        F.col("path").cast("long").alias("doc_id"), *counts, F.sha2(text(of_base), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"), "blob"
    )
