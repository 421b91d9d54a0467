"""Secret scans over an incremental ledger of content-addressed blobs.

A blob is one text, named by its SHA-256. The ledger is a Parquet dataset whose rows tell which rule versions
have scanned a blob, and what they found. A scan reads every version of every path, keeps one copy of each
blob, runs on it only the rules whose present version the ledger lacks, appends that, and joins the ledger's
findings back to all paths that hold the blob. DataFrame functions only.

Texts are first tested where they are read. A text that no rule can match is not shuffled: its blob enters the
ledger by name, as scanned and clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, exists, free_name, scratch
from larkspur.llm.spans import find_spans, let, replace_spans

#: A blob, the rule versions that scanned it, and their spans; ``value`` is the length of the secret, which ends the span.
FOUND = "array<struct<key:string,start:bigint,end:bigint,value:bigint>>"
LEDGER = f"blob string, keys array<string>, spans {FOUND}"


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, the least such length, and strings of which a match holds one."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()
    base: bool = True

    @property
    def key(self) -> str:
        """The rule's name and version: a hash of all that decides what it finds, so an edited rule scans anew."""
        return f"{self.name}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:12]}"

    def may_match(self, text: Column) -> Column:
        """Whether the pattern is in the text; plain strings are looked for before the pattern."""
        found = text.rlike(self.pattern)
        return reduce(Column.__or__, [F.contains(text, F.lit(n)) for n in self.needs]) & found if self.needs else found


#: Fixed values of the contract, written so that Java's matcher needs no backtracking over long runs: a run
#: of the class shorter than the least length fails as a whole, so counted repeats find the same spans.
#: The keywords' case is folded as the SQL folds it: the long s and the Kelvin sign are case forms of s and k.
RULES = (
    Rule("assign", r"""(?i:(pa[sſ][sſ]word|pa[sſ][sſ]wd|[sſ]ecret|to[kK]en|api_?[kK]ey))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", 2, 6, (":", "=")),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", needs=("AKIA",)),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,10} ){0,2}PRIVATE KEY-----", needs=("PRIVATE KEY-----",), base=False),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", needs=(".eyJ",), base=False),
)


def blob_id(text: Column) -> Column:
    """Content address of a text; a null text is the empty blob."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def may_match(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether any rule's pattern is in the text; false for null."""
    return F.coalesce(reduce(Column.__or__, [r.may_match(text) for r in rules]), F.lit(False))


def _found(rule: Rule) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(rule.key).alias("key"), s["start"].alias("start"), s["end"].alias("end"), F.length(s["part"]).cast("bigint").alias("value"))


def _long_enough(least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(s["part"]) >= least


def unseen(docs: DataFrame, ledger: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, text, due)``: every blob of ``docs`` that the ledger lacks under some rule version, and which those are.

    ``text`` is null where no rule can match. Copies are combined before the shuffle where they meet.
    """
    text = F.col(text_col).cast("string")
    blobs = docs.select(blob_id(text).alias("blob"), F.when(may_match(text, rules), text).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("seen"))
    due = F.array_except(F.lit([r.key for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", due.alias("due")).where(F.size("due") > 0)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``(blob, text, due)``: each blob under the rule versions that are due."""
    none = F.array().cast(FOUND)
    each = []
    for r in rules:
        spans = find_spans(F.col("text"), r.pattern, r.group)
        spans = F.filter(spans, _long_enough(r.least)) if r.least else spans
        each.append(F.when(F.array_contains("due", r.key), F.transform(spans, _found(r))).otherwise(none))
    return blobs.select("blob", F.col("due").alias("keys"), F.concat(*each).cast(FOUND).alias("spans"))


def scan_incremental(spark: SparkSession, docs: DataFrame, ledger_path: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger_path`` lacks, append it there, and return the whole ledger.

    The ledger is in shared storage; an interrupted append leaves no committed rows, and the next call scans the
    same pairs again. A missing ledger is an empty one. Two appends at once may scan a pair twice; readers count
    it once.
    """
    ledger = spark.read.schema(LEDGER).parquet(ledger_path) if exists(spark, ledger_path) else spark.createDataFrame([], LEDGER)
    scan(unseen(docs, ledger, text_col, rules), rules).write.mode("append").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, findings)`` of the blobs in which present rule versions found something, each finding once.

    It is stored, so a blob that very many paths share is hot on the side of the paths only, whose partitions
    Spark can split.
    """
    own = F.filter("spans", lambda s: F.array_contains(F.lit([r.key for r in rules]), s["key"]))
    found = ledger.select("blob", own.alias("spans")).where(F.size("spans") > 0).groupBy("blob")
    once = lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, i - 1)))
    return cut_lineage(found.agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("all")).select("blob", let(F.col("all"), once).alias("findings")))


def join_findings(versions: DataFrame, ledger: DataFrame, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` by ``path_cols``, which name its path and version, with its blob's ``findings``.

    Null stands for no finding. The path columns may have any names but ``findings``.
    """
    blob = free_name(versions, "blob")
    paths = versions.select(*[F.col(f"`{c}`") for c in path_cols], blob_id(F.col(text_col)).alias(blob))
    return paths.join(findings(ledger, rules).withColumnRenamed("blob", blob), blob, "left").drop(blob)


def scan_secrets(docs: DataFrame, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """Findings of every row of ``docs``, through the ledger at ``ledger_path``; without one, through a new ledger.

    Every distinct text is scanned once and whole, in time that grows as its length. Null and empty texts have no
    findings; repeated rows and null ids keep their rows; ties cannot arise, as findings are a set of spans; an
    empty table gives an empty result; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ledger = scan_incremental(spark, docs, ledger_path or f"{scratch(spark, 'secrets')}/ledger", text_col, rules)
    return join_findings(docs, ledger, path_cols, text_col, rules)


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger_path: str | None = None) -> DataFrame:
    """``docs``, same rows and columns, with each finding in the text replaced by ``[rule name]``.

    Of an assignment only the value goes; of findings that overlap, the first is named and all go. Texts without
    findings, null and empty ones included, stay as they are and are not shuffled. Repeated rows stay; very long
    texts take time as their length; an empty table gives an empty one; columns may have any names.
    """
    spark = docs.sparkSession
    ledger = scan_incremental(spark, docs, ledger_path or f"{scratch(spark, 'secrets')}/ledger", text_col, rules)
    blob, found, text = free_name(docs, "blob"), free_name(docs, "findings"), F.col(f"`{text_col}`")
    hits = findings(ledger, rules).toDF(blob, found)
    some = may_match(text.cast("string"), rules)
    own = docs.where(some).withColumn(blob, blob_id(text)).join(hits, blob, "left")
    spans = F.transform(found, lambda s: F.struct((s["end"] - s["value"]).alias("start"), s["end"].alias("end"), F.substring_index(s["key"], "@", 1).alias("kind")))
    whole = own.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(replace_spans(text, F.array_sort(spans)))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.where(~some).union(whole)
