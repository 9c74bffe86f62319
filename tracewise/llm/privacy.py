"""Personal data by candidate gradient boosting, with DataFrame functions only.

The *base* rules find e-mail addresses, IP addresses, card numbers and telephone numbers by fixed patterns and checks; what
they find always stays. Beside them, looser generators propose every span that could be one of the four: addresses spelled
out ("name at host dot org"), numbers of seven to nineteen digits with any marks between, groups of hexadecimal digits with
colons. Proposals may overlap. Boosted trees judge them by their format (digits, groups, marks, length) and context (the
characters next to them, the words before), without the checks of the base rules. They learn on the proposals of all
documents that can be decided, counted by their features: those that overlap a base span are positives, the others
are decided by checks of their own (``decided``), as what the trees could add is by its nature none of the base. What no check
decides is in neither the fit nor the threshold. The threshold of a kind is the lowest at which nine tenths of its accepted
proposals of held-out documents are positives. The fitted trees are turned into a column expression, so that scoring is
part of the projection that finds the spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.words import text_key
from tracewise.session import forget, keep

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
TREES, DEPTH, LEAF = 12, 3, 10
PRECISION = 0.9
CONTEXT = 24
_OPEN, _CLOSE = "\u0001", "\u0002"

# Possessive: the same matches as with plain quantifiers, as nothing that follows could use what is given back, but
# without a step back for each character of a long run. The look-behinds skip starts within a run that has just failed.
BASE_PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# texts in which a pattern could match at all
_MAYBE = ("@", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9]")
LOOSE_EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(]at[\])]\x20?|\x20at\x20|@)[A-Za-z0-9-]{1,63}"
               r"(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,4}")
LOOSE_NUMBER = r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"
LOOSE_HEX = r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])"
CUES = r"(?i)(mail|contact|write|phone|tel|call|fax|mobil|numb|nummer|card|visa|account|konto|ip|addr|host|server)"
CALLS = r"(?i)(phone|tel|call|fax|mobil)"
CARDS = r"(?i)(card|visa|karte|carte|tarjeta)"
MAILS = r"(?i)(mail|contact|write|addr|kontakt|schreib)"
FEATURES = ("is_email", "is_ip", "is_card", "digits", "length", "groups", "dots", "spaces", "dashes", "spelled", "gap", "cue", "tight_left", "tight_right")
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_PROPOSAL = "array<struct<start:int,kind:int,end:int,m:string,before:string>>"


# ------------------------------------------------------------------ spans as columns

def _found(text: Column, pattern: str, maybe: Column, wanted: Callable[[Column], Column], made: Callable[..., Column], kind: str) -> Column:
    """Array of ``made(start, end, match, before)`` for the matches of a pattern that are ``wanted``.

    Matches are wrapped in two control characters, the text is split behind each match, and the parts are walked with the
    running length. A text's own such characters are replaced by another one first: lengths stay, and no pattern has them.
    """
    marked = F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{_OPEN}$1{_CLOSE}"))

    def step(acc: Column, part: Column) -> Column:
        at = F.instr(part, _OPEN)
        match = F.substring(part, at + 1, F.length(part))
        start = acc["pos"] + at - 1
        one = F.array(made(start, start + F.length(match), match, F.substring(part, F.greatest(at - CONTEXT, F.lit(1)), F.least(at - 1, F.lit(CONTEXT)))))
        return F.struct((acc["pos"] + F.length(part) - F.when(at > 0, 1).otherwise(0)).cast("int").alias("pos"),
                        F.when((at > 0) & wanted(match), F.concat(acc["out"], one.cast(kind))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("int").alias("pos"), F.array().cast(kind).alias("out"))
    walked = F.aggregate(F.split(marked, _CLOSE), start, step, lambda acc: acc["out"])
    return F.when(maybe, walked).otherwise(F.array().cast(kind))


def _plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "\u0003\u0003")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the base rules, ordered by start, then kind."""
    n = lambda m: F.length(_digits(m))
    wanted = (lambda m: F.lit(True), lambda m: m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
              lambda m: n(m).between(14, 19) & F.call_function("luhn_check", _digits(m)), lambda m: n(m).between(10, 15))
    parts = []
    for kind, (pattern, check) in enumerate(zip(BASE_PATTERNS, wanted, strict=True)):
        maybe = text.contains("@") if kind == EMAIL else text.rlike(_MAYBE[kind])
        made = lambda s, e, m, b, kind=kind: F.struct(s.alias("start"), F.lit(kind).alias("kind"), e.alias("end"))
        parts.append(_found(text, pattern, maybe, check, made, _SPAN))
    return F.array_sort(F.concat(*parts))


def proposals(text: Column) -> Column:
    """Spans of the loose generators with their match and what stands before it."""
    def made(kind: Callable[[Column], Column]):
        return lambda s, e, m, b: F.struct(s.alias("start"), kind(m).alias("kind"), e.alias("end"), m.alias("m"), b.alias("before"))

    any_ = lambda m: F.lit(True)
    number = lambda m: (F.when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), IP).when(F.length(_digits(m)) >= 13, CARD).otherwise(PHONE))
    return F.concat(
        _found(text, LOOSE_EMAIL, text.contains("@") | text.rlike(r"[\[(]at[\])]|\x20dot\x20"), any_, made(lambda m: F.lit(EMAIL)), _PROPOSAL),
        _found(text, LOOSE_NUMBER, text.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"), any_, made(number), _PROPOSAL),
        _found(text, LOOSE_HEX, text.rlike(r"[0-9A-Fa-f]:{1,2}[0-9A-Fa-f]{1,4}:{1,2}[0-9A-Fa-f]"), any_, made(lambda m: F.lit(IP)), _PROPOSAL))


def _features(c: Column, text: Column) -> dict[str, Column]:
    flag = lambda x: x.cast("double")
    core = F.regexp_replace(c["m"], "^[^0-9A-Za-z]+", "")  # a plus sign would give the base rule away
    count = lambda chars: F.length(core) - F.length(F.translate(core, chars, ""))
    values = (flag(c["kind"] == EMAIL), flag(c["kind"] == IP), flag(c["kind"] == CARD), flag(F.length(_digits(c["m"]))), flag(F.length(core)),
              flag(F.size(F.split(core, "[^0-9A-Za-z]+"))), flag(count(".")), flag(count(" ")), flag(count("-")),
              flag(c["m"].rlike(r"[\[(\x20](?:at|dot)[\])\x20]")), flag(c["m"].contains("::")), flag(c["before"].rlike(CUES)),
              flag(F.substring(c["before"], -1, 1).rlike(r"[^\s(\[\"']")),
              flag(F.substring(text, c["end"] + 1, F.lit(1)).rlike(r"[^\s.,;:!?)\]\"']")))
    return dict(zip(FEATURES, values, strict=True))


def _overlaps(base: Column, c: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def decided(c: Column) -> Column:
    """1.0, 0.0 or null: whether a proposal that overlaps no base span is personal data, as far as its form and the words before say so.

    An address spelled out has marks or words for both signs, or a cue. Of hexadecimal groups an IPv6 address has eight, or fewer and
    one gap. A card's number has its check digit and a cue. A telephone's has a cue, and no other number's form.
    """
    m, before = c["m"], c["before"]
    digits = _digits(m)
    n = F.length(digits)
    named = m.rlike(r"[A-Za-z]{2,24}$")  # as the last part of any host's name
    marked = m.rlike(r"[\[(]at[\])]") | m.rlike(r"\x20at\x20") & m.rlike(r"[\])\x20]dot[\[(\x20]|[\[(]dot[\])]")
    email = F.when(~named, 0.0).when(marked | before.rlike(MAILS), 1.0)
    groups = F.size(F.split(m, "::?"))
    gaps = F.size(F.split(m, "::")) - 1
    ip = F.when(m.contains(":"), F.when((gaps == 0) & (groups == 8) | (gaps == 1) & (groups <= 7), 1.0).otherwise(0.0)).otherwise(0.0)
    luhn = F.call_function("luhn_check", digits)
    calls = before.rlike(CALLS)
    card = F.when(luhn & before.rlike(CARDS), 1.0).when(~luhn & ~calls & ~m.rlike(r"^(?:\+|\(?00)"), 0.0)
    date = m.rlike(r"^(?:(?:19|20)[0-9]{2}([.-])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([.-])[0-3]?[0-9]\2(?:19|20)[0-9]{2})$")
    phone = F.when(date, 0.0).when(calls & n.between(7, 15), 1.0).when(m.rlike(r"^[0-9]+$|^[0-9]+\.[0-9]+$"), 0.0)
    return F.when(c["kind"] == EMAIL, email).when(c["kind"] == IP, ip).when(c["kind"] == CARD, card).otherwise(phone)


# ------------------------------------------------------------------ boosted trees

def tree_expression(described: str, feature: Callable[[int], Column]) -> Column:
    """Weighted sum of the trees of a fitted model, read from its description, as one column."""
    total: Column | None = None
    lines = [line.strip() for line in described.splitlines()]
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        _, _, number, sign, bound = line.rstrip(")").replace("(", "").split()
        if sign != "<=":
            raise ValueError(line)
        low = node()
        at += 1  # the other half of the condition
        high = node()
        return F.when(feature(int(number)) <= float(bound), low).otherwise(high)

    while at < len(lines):
        line = lines[at]
        at += 1
        if line.startswith("Tree "):
            weight = float(line.split("weight")[1].strip(" ):"))
            one = node() * weight
            total = one if total is None else total + one
    return total if total is not None else F.lit(0.0)


class Judge:
    """Description of the fitted trees and the threshold of their sum for each kind; without trees, the checks alone decide."""

    def __init__(self, described: str = "", thresholds: dict[int, float] | None = None):
        self.described, self.thresholds = described, thresholds or {}

    def accepts(self, c: Column, text: Column) -> Column:
        if not self.described:
            return F.coalesce(decided(c) == 1, F.lit(False))
        values = list(_features(c, text).values())
        least = F.element_at(F.array(*(F.lit(self.thresholds[k]) for k in range(len(KINDS)))), c["kind"] + 1)
        return tree_expression(self.described, lambda i: values[i]) >= least


def lowest(bins: list[tuple[float, float, int]]) -> float:
    """The lowest positive score at which ``PRECISION`` of what scores as much is good, from (score, good, all)."""
    good = total = 0.0
    least = float("inf")
    for s, some, n in sorted(bins, reverse=True):
        good, total = good + some, total + n
        if good >= PRECISION * total and s > 0:
            least = s
    return least


def learn(docs: DataFrame) -> Judge:
    """Fit on the proposals of all documents. Equal ones are counted, and a row of the fit weighs as many as it stands for."""
    named = docs.where(F.col("text").isNotNull()).select(text_key("doc_id", "text").alias("row"), _plain(F.col("text")).alias("text"))
    named = named.withColumn("base", base_spans(F.col("text"))).withColumn("c", F.explode(proposals(F.col("text"))))
    y = F.when(_overlaps(F.col("base"), F.col("c")), 1.0).otherwise(decided(F.col("c")))
    rows = named.select((F.col("row") % 5 == 0).alias("held"), y.alias("y"), F.col("c.kind").alias("kind"),
                        *(v.alias(k) for k, v in _features(F.col("c"), F.col("text")).items())).where("y is not null")
    rows = keep(rows.groupBy("held", "y", "kind", *FEATURES).agg(F.count("*").cast("double").alias("n")), "proposals")
    try:
        fit, held = rows.where("not held"), rows.where("held")
        kinds = {r.y: r.n for r in fit.groupBy("y").agg(F.sum("n").alias("n")).collect()}
        if len(kinds) < 2:
            return Judge()
        total = sum(kinds.values())
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(fit.orderBy("y", "kind", *FEATURES))
        # a leaf has LEAF proposals at least, however few rows they are
        model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="n", maxIter=TREES, maxDepth=DEPTH if total >= 2 * LEAF else 0, minInstancesPerNode=1,
                              minWeightFractionPerNode=min(0.4999, (LEAF - 0.5) / total), seed=7).fit(vectors)
        score = tree_expression(model.toDebugString, lambda i: F.col(FEATURES[i]))
        bins = held.select("kind", (F.floor(score * 50) / 50).alias("s"), "y", "n").groupBy("kind", "s").agg(F.sum(F.col("y") * F.col("n")).alias("good"), F.sum("n").alias("all"))
        bins = [(r.kind, r.s, r.good, r["all"]) for r in bins.collect()]  # some hundred
        least = {k: lowest([x[1:] for x in bins if x[0] == k]) for k in range(len(KINDS))}
        # a kind of which no positive was held out is judged by the threshold of all
        shown = {k for k, _, good, _ in bins if good}
        return Judge(model.toDebugString, {k: x if k in shown else lowest([x[1:] for x in bins]) for k, x in least.items()})
    finally:
        forget(rows)


def all_spans(base: Column, text: Column, judge: Judge) -> Column:
    """Base spans and the accepted proposals beside them."""
    more = F.filter(proposals(text), lambda c: ~_overlaps(base, c) & judge.accepts(c, text))
    plain = F.transform(more, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.array_distinct(F.concat(base, plain)))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of ``docs`` (doc_id, text, any more columns).

    Counts and hash are of the base spans, ``spans`` has all. A null text is empty and has none. Each row is read by itself, so
    repeated rows get equal results, and an empty table gives no rows. Where documents show only positives or only negatives, no
    trees are fitted and what the checks call personal data is added.
    """
    judge = learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _plain(F.col("text")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("all", all_spans(F.col("base"), F.col("text"), judge))
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, as in ``[EMAIL]``, and ``n_chars``, if there, counted anew.

    Of spans that overlap, the first names the kind and all are covered. A null text stays null.
    """
    judge = learn(docs)
    text, names = F.col("text"), F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    spans = all_spans(base_spans(_plain(text)), _plain(text), judge)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        piece = F.array(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text)))
    out = docs.withColumn("text", F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
