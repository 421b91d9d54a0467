"""Personal data by candidate generation and gradient boosted trees. DataFrame functions only.

Generators with high recall propose spans, which may overlap. The contract's patterns, with their checks,
give the base spans, which always count. A candidate's weak label comes from what its format proves: check digits,
ranges of parts, a country prefix, a domain; what proves neither (obfuscated addresses, numbers of unusual length or
prefix) has no label. None of these checks is a feature: the boosted trees see lengths, separators and the words
around, so they tell the label from format and context, and decide about candidates with and without one alike. They
learn from every different candidate of all texts but a fifth, which is held out to calibrate a threshold for each
kind; candidates of the same features are one row with a weight. Candidates that
reach it are added, and redaction takes out both. The trees are written out as one Spark expression, so scoring is
map-side and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, free_name
from larkspur.llm.spans import SPANS, blocks_of, cut, find_spans, free_of, let, replace_spans

KINDS = ("email", "ip", "card", "phone")
#: Different candidates of ``labelled_sample`` at most: of each kind and label those whose content hashes lowest.
SAMPLE = 6_000
#: Precision on held-out candidates that a threshold must reach.
PRECISION = 0.995

#: Fixed values of the contract. Possessive repeats, and starts only where a run starts or the last match
#: ended, find the same matches as the plain patterns in time linear in the text.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind has neither base spans nor candidates.
NEEDS = {"email": r"@|[\[(](?i:at)[\])]", "ip": r"[0-9][.,:][0-9]", "card": r"[0-9]", "phone": r"[0-9]"}
PROPOSED = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(](?i:at)[\])]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]{1,63}+){0,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:[.,:][0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{16}|[0-9](?:[\x20.-]?[0-9]){11,19})(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\+[0-9]{1,3}\x20?\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20-][0-9]{4}|(?:\+|00|\()?\(?[0-9][0-9().\x20-]{5,20}[0-9])(?![0-9])",
}
#: Words before a candidate that speak for its kind, in the corpus' languages.
CONTEXT = {
    "email": r"(?i)(mail|write|contact|correo|courriel|schreib)",
    "ip": r"(?i)(\bip\b|host|server|addr|login|client)",
    "card": r"(?i)(card|visa|pay|karte|tarjeta|carte)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|anruf|llam|appel)",
}
#: Code points before and after a candidate that are its context.
BEFORE, AFTER = 24, 4
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(digits_of(hit))
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The contract's spans of one kind."""
    return F.filter(find_spans(text, BASE[kind]), lambda s: _valid(kind, s["hit"]))


def _label(kind: str, hit: Column, digits: Column) -> Column:
    """1 for a candidate that its format proves, 0 for one that it refutes, null for one left open."""
    n = F.length(digits)
    if kind == "email":
        domain = hit.rlike(r"\.[A-Za-z]{2,}$")
        return F.when(hit.rlike(r"[\[(]") | ~hit.rlike("@"), None).when(domain, 1).otherwise(0)
    if kind == "ip":
        octets = hit.rlike(rf"^{OCTET}(?:[.,:]{OCTET}){{3}}$")
        return F.when(~octets, 0).when(hit.rlike("[,:]"), None).otherwise(1)
    if kind == "card":
        passes = F.when(n.between(12, 20), luhn(digits)).otherwise(F.lit(False))
        return F.when(~passes | (hit.rlike(r"\.") & hit.rlike("[ -]")), 0).when(n.between(16, 19) & ~hit.rlike(r"\."), 1)
    plus = F.startswith(hit, F.lit("+"))
    return F.when(n.between(8, 15) & plus, 1).when(~F.startswith(hit, F.lit("00")) & ~F.startswith(hit, F.lit("(")), 0)


def _features(kind: str, hit: Column, digits: Column, before: Column, after: Column) -> Column:
    """Format and context as an array of doubles; none of them is what the label is taken from."""
    count = lambda p: F.regexp_count(hit, F.lit(p))
    numbers = [
        F.length(hit), F.length(digits), count("[0-9]+"), count("[ -]"), count(r"\."), count("[A-Za-z]"), count("[()]"), count("[,:]"),
        F.length(F.regexp_extract(hit, r"([A-Za-z0-9]+)$", 1)), F.length(F.regexp_extract(hit, r"([A-Za-z0-9]+)", 1)), F.length(F.regexp_extract(before, r"(\S*)\s*$", 1)),
    ]
    flags = [before.rlike(CONTEXT[kind]), before.rlike(r"[:=]\s*$"), before.rlike(r"[A-Za-z]\s*$"), before.rlike(r"\s$"), before.rlike(r"[0-9]\s*$"), after.rlike(r"^\s"), after.rlike(r"^\s*[A-Za-z]"), after.rlike(r"^\s*[0-9]")]
    return F.array(F.lit(float(KINDS.index(kind))), *[x.cast("double") for x in (*numbers, *flags)])


def candidates(text: Column, kind: str) -> Column:
    """Proposed spans of one kind with features (array of doubles) and weak label (1, 0 or null)."""

    def describe(blocks: Column) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            before, after = cut(blocks, F.greatest(s["start"] - BEFORE, F.lit(0)), s["start"]), cut(blocks, s["end"], s["end"] + AFTER)
            parts = F.struct(s.alias("span"), digits_of(s["hit"]).alias("digits"), before.alias("before"), after.alias("after"))
            return let(parts, known)

        return one

    def known(x: Column) -> Column:
        """Features and label of what is computed once for both."""
        s, hit = x["span"], x["span"]["hit"]
        features, label = _features(kind, hit, x["digits"], x["before"], x["after"]), _label(kind, hit, x["digits"])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), hit.alias("hit"), features.alias("features"), label.cast("double").alias("label"))

    whole = lambda found: let(blocks_of(text), lambda blocks: F.transform(found, describe(blocks)))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string,features:array<double>,label:double>>")
    return let(find_spans(text, PROPOSED[kind]), lambda found: F.when(F.size(found) > 0, whole(found)).otherwise(none))


def _with_kind(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["hit"].alias("hit"), c["features"].alias("features"), c["label"].alias("label"))


def _scored(model: GBTClassificationModel, kind: str) -> Callable[[Column], Column]:
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), model_score(model, c["features"]).alias("score"))


def labelled_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(kind, hit, features, label, order)`` of every different labelled candidate of all texts; copies count once."""
    text = F.col(text_col).cast("string")
    each = F.concat(*[F.when(text.rlike(NEEDS[k]), F.transform(candidates(text, k), _with_kind(k))).otherwise(F.array()) for k in KINDS])
    rows = docs.where(text.rlike("[0-9@]")).select(F.explode(each).alias("c")).select("c.*").where("label is not null")
    order = F.xxhash64("kind", "hit", F.array_join(F.col("features").cast("array<string>"), ","))
    return rows.withColumn("order", order).distinct()


def labelled_sample(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` different labelled candidates of all texts, with a tenth-number, to look at; ``fit`` takes all.

    Copies count once. Kinds and labels take turns, each in the order of its candidates' hashes, so that a rare one
    is whole before a common one takes its place. ``total`` has the number of different candidates of the row's
    kind and label in all texts.
    """
    rows = labelled_candidates(docs, text_col)
    place = F.row_number().over(Window.partitionBy("kind", "label").orderBy("order", "hit"))
    taken = rows.withColumn("place", place).where(F.col("place") <= sample).orderBy("place", "order", "kind", "hit").limit(sample)
    totals = rows.groupBy("kind", "label").agg(F.count("*").alias("total"))
    return taken.join(F.broadcast(totals), ["kind", "label"]).select("kind", "features", "label", F.pmod(F.col("order"), F.lit(10)).alias("tenth"), "total")


def _tree(node, features: Column) -> Column:
    """One regression tree as a Spark expression."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    test = F.get(features, F.lit(split.featureIndex())) <= float(split.threshold())
    return F.when(test, _tree(node.leftChild(), features)).otherwise(_tree(node.rightChild(), features))


def model_score(model: GBTClassificationModel, features: Column) -> Column:
    """Probability of the positive class, as the library computes it: a logistic of twice the weighted sum."""
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        total = total + F.lit(float(weight)) * _tree(tree._call_java("rootNode"), features)
    return 1 / (1 + F.exp(-2 * total))


def fit(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> tuple[GBTClassificationModel | None, dict[str, float]]:
    """The trees and a threshold for each kind, from all texts; no trees where the candidates lack one of the classes.

    A kind's threshold is the least score, in hundredths, from which the held-out fifth of its different
    candidates is positive in the asked share; a kind without held-out candidates adds no span. In training each kind
    and label weighs the same, however many candidates it has, so that the rare ones are learned too.
    """
    counts = labelled_candidates(docs, text_col).groupBy("kind", "label", "features", (F.pmod(F.col("order"), F.lit(10)) < 2).alias("held")).agg(F.count("*").alias("n"))
    rows = cut_lineage(counts)
    learned = rows.where("not held")
    totals = learned.groupBy("kind", "label").agg(F.sum("n").alias("total"))
    if totals.select("label").distinct().count() < 2:
        return None, {}
    weighted = learned.join(F.broadcast(totals), ["kind", "label"]).withColumn("weight", F.col("n") * F.lit(1000.0) / F.col("total")).withColumn("vector", array_to_vector("features"))
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=8, maxDepth=3, stepSize=0.3, seed=7).fit(weighted)
    scored = rows.where("held").select("kind", "label", "n", F.floor(100 * model_score(model, F.col("features"))).alias("bin"))
    thresholds: dict[str, float] = {}
    bins = scored.groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("n").alias("n")).orderBy("kind", F.desc("bin")).collect()
    sums: dict[str, tuple[float, float]] = {}
    for r in bins:  # at most four kinds times 101 bins
        hits, n = sums.get(r["kind"], (0.0, 0.0))
        hits, n = sums[r["kind"]] = hits + r["hits"], n + r["n"]
        if hits >= precision * n:
            thresholds[r["kind"]] = r["bin"] / 100
    return model, thresholds


def _spans(text: str, names: dict[str, str], fitted: tuple) -> tuple[dict[str, Column], Column]:
    """Base spans by column name, and (kind, start, end, score) of what the trees add beside the columns ``names``."""
    model, thresholds = fitted
    t = F.col(f"`{text}`")
    base = {names[k]: F.when(t.rlike(NEEDS[k]), base_spans(t, k)).otherwise(F.array().cast(SPANS)) for k in KINDS}
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    added, known = [none], F.concat(*[F.col(f"`{n}`") for n in names.values()])
    for k, least in thresholds.items() if model is not None else ():
        reach = F.filter(F.transform(candidates(t, k), _scored(model, k)), _at_least(max(least, 0.5)))
        added.append(F.when(t.rlike(NEEDS[k]), free_of(reach, known)).otherwise(none))
    return base, F.concat(*added)


def _at_least(threshold: float) -> Callable[[Column], Column]:
    return lambda c: c["score"] >= threshold


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: tuple | None = None) -> DataFrame:
    """``(doc_id, email, ip, card, phone, added)`` for every row of ``docs``.

    The four columns hold base spans (start, end, hit, part); ``added`` holds (kind, start, end, score) of
    candidates that reach their kind's threshold and overlap no base span, such as numbers that the base
    patterns lose in a longer run of digits. ``fitted`` is an earlier result of ``fit``; without it the trees are
    fitted on ``docs``. Null and empty texts have no spans; very long texts and very many matches take time as their
    length; spans of one kind do not overlap, so none tie; repeated rows and null ids keep their rows; an empty
    table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base, added = _spans("text", {k: k for k in KINDS}, fitted or fit(docs, text_col))
    return own.withColumns(base).select("doc_id", *KINDS, added.alias("added"))


def redact_pii(docs: DataFrame, text_col: str = "text", fitted: tuple | None = None) -> DataFrame:
    """``docs``, same rows and columns, with base and added spans of the text replaced by ``[kind]``; no shuffle.

    Of spans that overlap, the first is named and all go. Texts without spans, null and empty ones included, stay
    as they are; repeated rows stay; an empty table gives an empty one; columns may have any names.
    """
    names = {k: free_name(docs, f"pii_{k}") for k in KINDS}
    more, text = free_name(docs, "pii_added"), F.col(f"`{text_col}`")
    base, added = _spans(text_col, names, fitted or fit(docs, text_col))
    shape = lambda kind: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind"))
    named = lambda k: F.transform(F.col(names[k]), shape(lambda s: F.lit(k)))
    found = docs.withColumns(base).withColumn(more, added)
    spans = F.array_sort(F.concat(*[named(k) for k in KINDS], F.transform(more, shape(lambda s: s["kind"]))))
    return found.withColumn(text_col, F.when(text.isNotNull(), replace_spans(text, spans))).select(*[F.col(f"`{c}`") for c in docs.columns])
