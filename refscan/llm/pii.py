"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans: e-mail addresses (also written with at and dot), dotted and
plain numbers, and opaque tokens. Boosted trees rate each by its format and its context; a threshold for each
kind, calibrated for precision on candidates that the trees have not learned from, selects redactions. The
strict base patterns are always redacted.

The labels come from evidence that no feature holds:

- an address is right if it is a base one, and wrong if it has no domain with a dot. Features see it with at and dot
  written as signs, so written addresses, whose truth is unknown, are rated by the shape of the others;
- a number is right if it is a base one: the checksum, the value range of an address's parts and the leading plus
  and country code are hidden from the features. Numbers that fail are wrong; local phone numbers are unknown;
- a token is right if a word like key or password stands before it, which the features don't see, and wrong if
  nothing is assigned there; tokens assigned to other names are unknown.

Unknown candidates are never learned from and never count in calibration. Wrong ones are never redacted.

Only DataFrame functions are used: spans are arrays within a document's row, and the fitted trees are
compiled to CASE expressions, so scoring takes one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, sampled, temporary, written

KINDS = ("email", "ip", "card", "phone", "secret")
#: Documents whose candidates the trees learn from, at the most (in expectation); of small tables FIT_SHARE.
TRAIN_DOCS, FIT_SHARE = 40_000, 0.75
PRECISION = 0.9
CONTEXT = 24  # characters on either side, up to the next candidate
BLOCK = 256  # spans whose places are added up at a time

# Possessive forms and the look-behinds give the leftmost longest matches of the plain patterns, without their backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

AT, DOT = r"(?i) ?[(\[]at[)\]] ?", r"(?i) ?[(\[]dot[)\]] ?"
WRITTEN_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]++)*+"
NUMBER = r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){6,}+"
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"
ASSIGNED = r"""(?i)(?:token|secret|key|passw(?:or)?d|pwd|auth)\s*[:=]\s*["']?$"""
ASSIGNS = r"""[:=]\s*["']?$"""
PERSONAL = r"(?i)\b(?:tel|phone|call|mobile|fax|card|visa|iban|ssn|mail|contact|address|ip|host)\b"

SPANS = "array<struct<m:string,start:int,end:int,left:string,right:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, pattern: str) -> Column:
    """Array of (m, start, end, left, right) of all leftmost non-overlapping matches, in code points, with context.

    Places are sums of lengths, made block by block, so that no long array grows one by one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["g"])
        end = at + F.length(x["m"])
        span = F.struct(x["m"].alias("m"), at.alias("start"), end.alias("end"), F.right(x["g"], F.lit(CONTEXT)).alias("left"), F.left(x["a"], F.lit(CONTEXT)).alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def moved(acc: Column, x: Column) -> Column:
        shifted = F.transform(x["out"], lambda s: F.struct(s["m"].alias("m"), (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["left"].alias("left"), s["right"].alias("right")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], shifted).alias("out"))

    def placed(each: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(each) - 1, 8)), lambda b: F.aggregate(F.slice(each, b * BLOCK + 1, F.lit(BLOCK)), start, one))
        return F.when(F.size(each) > 0, F.aggregate(blocks, start, moved, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))

    def zipped(x: Column) -> Column:
        n = F.size(x["f"])
        return F.zip_with(x["f"], F.zip_with(F.slice(x["g"], F.lit(1), n), F.slice(x["g"], F.lit(2), n), lambda g, a: F.struct(g.alias("g"), a.alias("a"))), lambda m, c: F.struct(m.alias("m"), c["g"].alias("g"), c["a"].alias("a")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("g"))
    return bound(bound(both, zipped), placed)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    figures = F.transform(F.split(F.reverse(digits(text)), ""), lambda d: d.cast("int"))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The strict spans of each kind: array of (m, start, end)."""
    none = F.array().cast(SPANS)
    size = lambda m: F.length(digits(m))
    part = lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3
    small = lambda m: F.forall(F.split(m, r"\."), lambda p: part(p) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255))
    any_digit = text.rlike("[0-9]")
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP), lambda s: small(s["m"]))).otherwise(none),
        "card": F.when(any_digit, F.filter(spans(text, CARD), lambda s: size(s["m"]).between(12, 19) & luhn(s["m"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), lambda s: size(s["m"]).between(9, 15))).otherwise(none),
    }


def first_after(sorted_spans: Column, at: Column) -> Column:
    """The first of sorted spans that don't overlap each other that ends after ``at``, by binary search; null if none does."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(sorted_spans) + 1)).cast("int")))

    def halved(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        after = F.get(sorted_spans, mid)["end"] > at
        more = acc["lo"] < acc["hi"]
        return F.struct(F.when(more & ~after, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(more & after, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(sorted_spans).alias("hi")), halved, lambda acc: F.get(sorted_spans, acc["lo"]))


def met(sorted_spans: Column, s: Column) -> Column:
    """Whether any of the spans overlaps ``s``."""
    return F.coalesce(first_after(sorted_spans, s["start"])["start"] < s["end"], F.lit(False))


FEATURES = ("length", "digits", "letters", "dots", "dashes", "gaps", "parens", "hex", "groups", "longest", "assigns", "personal", "quoted", "bounded", "generator")


def shape(m: Column) -> Column:
    """A candidate as the features see it: at and dot as signs, no country code."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(m, AT, "@"), DOT, "."), r"^\+[0-9]{1,3}[ .-]?", "")


def features(m: Column, left: Column, right: Column, generator: int) -> list[Column]:
    flag = lambda c: c.cast("double")

    def of(s: Column) -> Column:
        count = lambda what: (F.length(s) - F.length(F.regexp_replace(s, what, ""))).cast("double")
        runs = F.transform(F.split(s, "[^0-9]+"), lambda r: F.length(r))
        format_ = [F.length(s).cast("double"), count("[0-9]"), count("[A-Za-z]"), count(r"\."), count("-"), count(" "), count("[()]"), count("[0-9a-f]") / F.greatest(F.length(s), F.lit(1)), F.size(F.filter(runs, lambda n: n > 0)).cast("double"), F.array_max(runs).cast("double")]
        context = [flag(left.rlike(ASSIGNS)), flag(left.rlike(PERSONAL)), flag(left.rlike("[\"']$") & right.rlike("^[\"']")), flag(~left.rlike("[A-Za-z0-9]$") & ~right.rlike("^[A-Za-z0-9]"))]
        return F.array(*format_, *context, F.lit(float(generator)))

    return bound(shape(m), of)


def kind_of(s: Column, generator: int) -> Column:
    if generator == 0:
        return F.lit("email")
    if generator == 2:
        return F.lit("secret")
    n = F.length(digits(s))
    return F.when(s.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip").when((n >= 12) & ~s.startswith("+"), "card").otherwise("phone")


GENERATORS = 3


def generated(text: Column) -> list[Column]:
    """Spans of each generator."""
    none = F.array().cast(SPANS)
    has_digit = text.rlike("[0-9]")
    return [
        F.when(F.contains(text, F.lit("@")) | text.rlike(r"(?i)[(\[]at[)\]]"), spans(text, WRITTEN_EMAIL)).otherwise(none),
        F.when(has_digit, spans(text, NUMBER)).otherwise(none),
        F.when(has_digit, spans(text, TOKEN)).otherwise(none),
    ]


def described(s: Column, generator: int) -> Column:
    """kind, start, end, base (overlaps a base span), truth (1 right, 0 wrong, null unknown) and f (features) of a span of a generator."""
    kind = kind_of(s["m"], generator)
    own = {k: met(F.col(f"b_{k}"), s) for k in KINDS[:4]}
    base = reduce(lambda a, b: a | b, own.values())
    right = F.lit(1.0)
    if generator == 0:
        truth = F.when(own["email"], right).when(~shape(s["m"]).rlike(r"@.+[.]") | s["m"].contains("@"), 0.0)
    elif generator == 1:
        n = F.length(digits(s["m"]))
        phone = F.when(own["phone"], right).when(s["m"].startswith("+") | ~n.between(9, 15), 0.0)
        truth = F.when(kind == "ip", own["ip"].cast("double")).when(kind == "card", own["card"].cast("double")).otherwise(phone)
    else:
        truth = F.when(base, F.lit(None)).when(s["left"].rlike(ASSIGNED), right).when(~s["left"].rlike(ASSIGNS), 0.0)
    return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), truth.alias("truth"), features(s["m"], s["left"], s["right"], generator).alias("f"))


def compiled(node, weight: float, f: Column) -> Column:
    """A fitted tree as a CASE expression over the features' array."""
    if node.numDescendants() == 0:
        return F.lit(weight * node.prediction())
    split = node.split()
    return F.when(f[split.featureIndex()] <= split.threshold(), compiled(node.leftChild(), weight, f)).otherwise(compiled(node.rightChild(), weight, f))


class Boosted:
    def __init__(self, model):
        self.parts = [(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]

    def margin(self, f: Column) -> Column:
        return reduce(lambda a, b: a + b, (compiled(node, w, f) for node, w in self.parts))


def learned(rows: DataFrame, train_docs: int) -> tuple[Boosted, dict[str, float]] | None:
    """Trees, and the threshold of each kind; None if candidates of both labels are missing. ``rows``: doc_id, text, c_0 to c_2 (candidates).

    The trees learn from a sample of documents; the thresholds are found on the candidates of all others."""
    spark = rows.sparkSession
    chosen = sampled(FIT_SHARE * min(1.0, train_docs / max(1, rows.select("doc_id").count())), "doc_id", "text")
    each = lambda df: df.select(F.explode(F.concat(*(f"c_{g}" for g in range(GENERATORS)))).alias("c")).where("c.truth IS NOT NULL")
    with temporary(spark):
        train = written(each(rows.where(chosen)).select(F.col("c.truth").alias("label"), *(F.col("c.f")[i].alias(name) for i, name in enumerate(FEATURES))), "pii-train")
        fit_on = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train).repartition(6).cache()
        try:
            if fit_on.select("label").distinct().count() < 2:
                return None
            trees = Boosted(GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=7).fit(fit_on))
        finally:
            fit_on.unpersist()
    rated = each(rows.where(~chosen)).select("c.kind", F.col("c.truth").alias("truth"), F.round(trees.margin(F.col("c.f")), 2).alias("margin"))
    margins = rated.groupBy("kind", "margin").agg(F.sum("truth").alias("good"), F.count("*").alias("n")).collect()  # of margins with two decimals
    thresholds = {}
    for kind in KINDS:
        good = total = 0
        for r in sorted((r for r in margins if r["kind"] == kind), key=lambda r: -r["margin"]):
            good, total = good + r["good"], total + r["n"]
            if good >= PRECISION * total:
                thresholds[kind] = r["margin"]
    return trees, thresholds


def joined(found: Column) -> Column:
    """kind:start:end of spans (start, order, end, kind), by start and then kind."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(kind: Column, s: Column) -> Column:
    order = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    return F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), kind.alias("kind"))


def found_spans(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, base and p_0 to p_2 (what is picked of each generator; arrays of start, order, end, kind) and the base counts of each row of ``docs``."""
    text = F.col("text")
    rows = id_and_text(docs).withColumns({f"b_{k}": v for k, v in base_spans(text).items()} | {f"g_{g}": v for g, v in enumerate(generated(text))})
    each = lambda g: F.transform(f"g_{g}", lambda s: described(s, g))
    rows = rows.withColumns({f"c_{g}": each(g) for g in range(GENERATORS)})
    tagged = lambda k: F.transform(f"b_{k}", lambda s: ordered(F.lit(k), s))
    model = learned(rows, train_docs)

    def picked(g: int) -> Column:
        if model is None:
            return F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
        trees, thresholds = model
        least = lambda c: reduce(lambda out, k: F.when(c["kind"] == k, thresholds[k]).otherwise(out), thresholds, F.lit(float("inf")))
        return F.transform(F.filter(f"c_{g}", lambda c: ~c["base"] & F.coalesce(c["truth"] > 0, F.lit(True)) & (F.round(trees.margin(c["f"]), 2) >= least(c))), lambda c: ordered(c["kind"], c))

    return rows.select("doc_id", "text", F.concat(*map(tagged, KINDS[:4])).alias("base"), *(picked(g).alias(f"p_{g}") for g in range(GENERATORS)), *(F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]))


def outermost(g: int) -> Column:
    """What is picked of a generator but for spans that lie within one of another generator (of equal ones the first generator's stays)."""

    def inside(a: Column, h: int) -> Column:
        longer = lambda b: (b["end"] - b["start"] > a["end"] - a["start"]) | F.lit(h < g)
        return bound(first_after(F.col(f"p_{h}"), a["start"]), lambda b: F.coalesce((b["start"] <= a["start"]) & (a["end"] <= b["end"]) & longer(b), F.lit(False)))

    return F.filter(f"p_{g}", lambda a: ~reduce(lambda x, y: x | y, (inside(a, h) for h in range(GENERATORS) if h != g)))


def redactions(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans; one row for each row of ``docs``.

    Positions count code points, ends are exclusive. Added spans never overlap base ones; those that lie within another
    added one are left out. Null and empty texts have no spans (the digest of the empty text, and ''); null or
    repeated ids are scanned like others; very long texts are scanned whole; an empty table gives an empty result;
    if no candidate is known to be right, or none wrong, nothing is added; other columns are ignored."""
    rows = found_spans(docs, train_docs)
    added = [outermost(g) for g in range(GENERATORS)]
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", *added)).alias("spans"), (F.size("base") + sum(map(F.size, added), F.lit(0))).cast("long").alias("n_spans"))


def redacted(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id and text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    rows = found_spans(docs, train_docs).select("doc_id", "text", F.array_sort(F.concat("base", *(f"p_{g}" for g in range(GENERATORS)))).alias("all"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return rows.select("doc_id", F.aggregate("all", start, put, end).alias("text"))
