"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans; five labelers (form, cue words, marks around the span, shape, word likeness) vote on each; expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is; a logistic regression trained on the resulting
soft labels judges the spans, by the votes and by what the span looks like (length, share of digits, letter case). The base kinds (email, ip,
card, phone) are fixed by their patterns and always stay; the classifier adds spans of the other kinds (account, secret).

Counts are over all documents. Each kind weighs alike in the maximisation, whatever its number of spans, and inside a kind a pattern weighs by
its count: cards are a hundred times as many as keys and would settle every labeler's reliability for them. The number of patterns is bounded
by construction (kinds, 3 to the power of the labelers, and the steps of length, digits and case), so what reaches the driver is too.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stage

# The base patterns. Possessive quantifiers and the look-behinds keep the matches and make the search linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Not base: long runs of letters, digits and signs, which may be keys.
KEY = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+"

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["account", "secret"]
LABELERS = ["form", "cue", "mark", "shape", "wordlike"]
#: What the classifier sees of a span besides the votes: whole powers of two of its length (12 at most), quarters of its digits, its letters' case.
TRAITS = ["size", "digits", "case"]

#: Gazetteer: words that announce personal data, in the corpus's languages.
CUES = {
    "account": "account|iban|konto|cuenta|compte|customer|kunde|cliente|client|card|karte|tarjeta|carte",
    "secret": "token|key|secret|password|passwd|passwort|auth|bearer|credential|api|contraseña|passe",
    "email": "mail|contact|kontakt|contacto|write",
    "ip": "ip|host|server|address|from|login",
    "card": "card|karte|tarjeta|carte|visa|pay",
    "phone": "phone|tel|call|fax|mobil|handy|llame|appel",
}
#: Known forms of credentials.
SECRET_FORMS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once a row and use it as often as body likes (a lambda's variable is never computed again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """What combine makes of all values before each position (zero at the first), over blocks, so the cost is not the square of the length."""

    def over(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / block).cast("int")
        fold = lambda a: F.aggregate(a, zero, combine)
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(v, b * block + 1, F.lit(block))))
        ahead = lambda s: F.transform(s, lambda _, i: fold(F.slice(s, F.lit(1), i)))
        return let(let(sums, ahead), lambda before: F.transform(v, lambda _, i: combine(F.element_at(before, F.floor(i / block).cast("int") + 1), fold(F.slice(v, F.floor(i / block).cast("int") * block + 1, (i % block).cast("int"))))))

    return let(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, needs: Column) -> Column:
    """All leftmost non-overlapping matches: array of (s, e, m, left, right); offsets in code points, e exclusive, and the text around.

    The pieces between the matches give the offsets. `needs` is a cheap test without which there can be no match.
    """

    def build(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g))

        def one(before: Column) -> Column:
            def at(m: Column, i: Column) -> Column:
                gap, after = F.element_at(gaps, i + 1), F.element_at(gaps, i + 2)
                start = F.element_at(before, i + 1) + F.length(gap)
                return F.struct(start.cast("int").alias("s"), (start + F.length(m)).cast("int").alias("e"), m.alias("m"), F.right(gap, F.lit(24)).alias("left"), F.left(after, F.lit(2)).alias("right"))

            return F.transform(found, at)

        return let(running(lengths, F.lit(0), lambda a, b: a + b), one)

    empty = F.array().cast("array<struct<s:int,e:int,m:string,left:string,right:string>>")
    whole = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: build(found, gaps))).otherwise(empty))
    return F.when(needs, whole).otherwise(empty)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """True where the digits of a match pass the Luhn test."""
    def total(d: Column) -> Column:
        each = F.transform(F.split(F.reverse(d), ""), lambda c, i: let(c.cast("int"), lambda x: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)))
        return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, b: a + b) % 10 == 0

    return let(digits_of(m), total)


def ip_parts_fit(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda d: (F.length(d) < 3) | ((F.length(d) == 3) & (d <= "255"))))


def candidates(docs: DataFrame, text: str = "text", found: str = "found") -> DataFrame:
    """Add a column (`found` unless named otherwise, replaced where it is there): per document an array of (kind, s, e, the labelers' votes, the traits), by kind as listed, then start.

    A null text is read as empty and has none. Votes are 1 (personal), -1 (not) or 0 (no opinion).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has_digit = t.rlike("[0-9]")

    def spans(kind: str, raw: Column, keep: Callable[[Column], Column], form: Callable[[Column], Column]) -> Column:
        def shape(m: Column, share: Column) -> Column:
            """Keys mix digits and letters; the form of a base kind is its shape; an account's digits say nothing."""
            if kind == "secret":
                return F.when((share > 0.1) & (share < 0.95) & m.rlike("[0-9][A-Za-z]") & m.rlike("[A-Za-z][0-9]"), 1).otherwise(-1)
            return F.lit(0 if kind == "account" else 1)

        def votes(x: Column) -> Column:
            m, left = x["m"], F.lower(x["left"])
            share = F.length(digits_of(m)) / F.length(m)
            return F.struct(
                F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
                form(x).cast("int").alias("form"),
                F.when(left.rlike(CUES[kind]), 1).otherwise(0).alias("cue"),
                F.when(F.right(x["left"], F.lit(1)).isin('"', "'", "=", ":", "<") | F.left(x["right"], F.lit(1)).isin('"', "'", ">"), 1).otherwise(0).alias("mark"),
                shape(m, share).alias("shape"),
                F.when(m.rlike(r"^[A-Za-z]+[-_/]?[A-Za-z]*[0-9]*$") & ~m.rlike(r"^[A-Z0-9]+$"), -1).otherwise(0).alias("wordlike"),
                F.least(F.lit(12), F.floor(F.log2(F.length(m)))).cast("int").alias("size"),
                F.floor(share * 4).cast("int").alias("digits"),
                (F.when(m.rlike("[A-Z]"), 1).otherwise(0) + F.when(m.rlike("[a-z]"), 2).otherwise(0)).alias("case"),
            )

        return F.transform(F.filter(raw, keep), votes)

    # long digit runs are read once: they are cards or, failing that, candidate accounts
    n_digits = lambda x: F.length(digits_of(x["m"]))
    is_card = lambda x: let(n_digits(x), lambda n: (n >= 13) & (n <= 19) & luhn(x["m"]))
    yes, no = (lambda x: F.lit(1)), (lambda x: F.lit(-1))
    digit_runs = matches(t, DIGITS, has_digit)
    spotted = let(
        F.struct(matches(t, EMAIL, F.instr(t, "@") > 0).alias("email"), matches(t, IP, t.rlike(r"[0-9]\.[0-9]")).alias("ip"), F.filter(digit_runs, lambda x: n_digits(x) >= 9).alias("digits"), matches(t, PHONE, F.instr(t, "+") > 0).alias("phone"), matches(t, KEY, has_digit).alias("key")),
        lambda r: F.concat(
            spans("email", r["email"], lambda x: F.lit(True), yes),
            spans("ip", r["ip"], lambda x: ip_parts_fit(x["m"]), yes),
            spans("card", r["digits"], is_card, yes),
            spans("phone", r["phone"], lambda x: n_digits(x).between(9, 15), yes),
            spans("account", r["digits"], lambda x: ~is_card(x), no),
            spans("secret", r["key"], lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]") & (F.instr(x["m"], "/") == 0), lambda x: F.when(x["m"].rlike(SECRET_FORMS), 1).otherwise(0)),
        ),
    )
    return docs.withColumn(found, spotted)


#: Spans that each kind counts for in the maximisation.
WEIGHT_OF_A_KIND = 1000.0


@dataclass
class PiiModel:
    """Labeler reliabilities and the classifier's weights, by feature name."""

    prior: float
    reliability: dict[str, dict[int, tuple[float, float]]]  # labeler -> vote -> (chance if personal, chance if not)
    weights: dict[str, float]


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]], list[float]]:
    """Two-class Dawid-Skene over counted vote patterns: prior, each labeler's vote chances in both classes, each pattern's posterior."""
    labelers = len(patterns[0][0]) if patterns else 0
    post = [min(0.95, max(0.05, 0.5 + 0.25 * sum(v))) for v, _ in patterns]
    prior, table = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        yes = sum(p * n for p, (_, n) in zip(post, patterns, strict=True))
        prior = (yes + 1) / (total + 2)
        table = []
        for k in range(labelers):
            chance = {}
            for vote in (-1, 0, 1):
                a = sum(p * n for p, (v, n) in zip(post, patterns, strict=True) if v[k] == vote)
                b = sum((1 - p) * n for p, (v, n) in zip(post, patterns, strict=True) if v[k] == vote)
                chance[vote] = ((a + 0.5) / (yes + 1.5), (b + 0.5) / (total - yes + 1.5))
            table.append(chance)
        post = []
        for v, _ in patterns:
            a = math.log(prior) + sum(math.log(table[k][x][0]) for k, x in enumerate(v))
            b = math.log(1 - prior) + sum(math.log(table[k][x][1]) for k, x in enumerate(v))
            post.append(1 / (1 + math.exp(min(60.0, max(-60.0, b - a)))))
    return prior, table, post


def _features(kind: str, votes: tuple[int, ...], traits: tuple[int, ...]) -> list[str]:
    return ["bias", f"kind={kind}", *(f"{name}={v}" for name, v in zip(LABELERS, votes, strict=True) if v), *(f"{name}={v}" for name, v in zip(TRAITS, traits, strict=True))]


def fit(docs: DataFrame, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3, found: str = "found") -> PiiModel:
    """Train on all candidates of a table with `found`: one count for each pattern of kind, votes and traits comes to the driver."""
    counted = docs.select(F.explode(found).alias("x")).groupBy(*[F.col(f"x.{c}").alias(c) for c in ("kind", *LABELERS, *TRAITS)]).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r["kind"], tuple(r[c] for c in LABELERS), tuple(r[c] for c in TRAITS), float(r["n"])) for r in counted.collect())
    if not rows:
        return PiiModel(0.5, {}, {})
    of_kind: dict[str, float] = {}
    for kind, _, _, n in rows:
        of_kind[kind] = of_kind.get(kind, 0.0) + n
    counts = [WEIGHT_OF_A_KIND * n / of_kind[kind] for kind, _, _, n in rows]
    votes: dict[tuple[int, ...], float] = {}
    for (_, v, _, _), n in zip(rows, counts, strict=True):
        votes[v] = votes.get(v, 0.0) + n
    prior, table, post = expectation_maximisation(sorted(votes.items()))
    belief = dict(zip(sorted(votes), post, strict=True))
    w: dict[str, float] = {}
    total = sum(counts)
    for _ in range(rounds):
        step: dict[str, float] = {}
        for (kind, v, t, _), n in zip(rows, counts, strict=True):
            names = _features(kind, v, t)
            z = sum(w.get(f, 0.0) for f in names)
            miss = n / total * (belief[v] - 1 / (1 + math.exp(-z)))
            for f in names:
                step[f] = step.get(f, 0.0) + miss
        for f, d in step.items():
            w[f] = w.get(f, 0.0) + rate * 4 * (d - l2 * w.get(f, 0.0))
    return PiiModel(prior, dict(zip(LABELERS, table, strict=True)), w)


def classify(docs: DataFrame, model: PiiModel, threshold: float = 0.5, found: str = "found", spans: str = "spans") -> DataFrame:
    """Replace the column of candidates by one of spans: array of (kind, s, e), base kinds whole, added kinds where the classifier says at least threshold."""
    weight = model.weights
    limit = math.log(threshold / (1 - threshold))

    def keep(x: Column) -> Column:
        parts = [F.lit(weight.get("bias", 0.0))]
        parts += [F.when(x["kind"] == k, weight[f"kind={k}"]).otherwise(0.0) for k in ADDED_KINDS if f"kind={k}" in weight]
        parts += [F.when(x[c] == v, weight[f"{c}={v}"]).otherwise(0.0) for c in LABELERS for v in (-1, 1) if f"{c}={v}" in weight]
        parts += [F.when(x[c] == v, weight[f"{c}={v}"]).otherwise(0.0) for c in TRAITS for v in range(13) if f"{c}={v}" in weight]
        return x["kind"].isin(*BASE_KINDS) | (reduce(lambda a, b: a + b, parts) >= limit)

    kept = F.transform(F.filter(found, keep), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return docs.withColumn(spans, kept).drop(found)


def mask(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Put [KIND] in the place of every span; spans that overlap become one, named after the first."""
    t = F.col(text)

    def rewrite(sorted_spans: Column) -> Column:
        def pieces(reach: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                done = F.element_at(reach, i + 1)
                mark = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
                return F.when(x["s"] >= done, F.concat(F.substr(t, done + 1, x["s"] - done), mark)).otherwise(F.lit(""))

            last = F.array_max(F.transform(sorted_spans, lambda x: x["e"]))
            return F.concat(F.array_join(F.transform(sorted_spans, one), ""), F.substr(t, last + 1))

        return let(running(F.transform(sorted_spans, lambda x: x["e"]), F.lit(0), lambda a, b: F.greatest(a, b)), pieces)

    order = F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).when(a["e"] != b["e"], b["e"] - a["e"]).when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0))
    return docs.withColumn(text, F.when(F.size(spans) > 0, let(order, rewrite)).otherwise(t))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans.

    A null or empty text has no spans (its digest is that of the empty string); an empty table gives no rows; repeated rows are read
    alike; no other column is read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = stage(candidates(docs).drop("text"), "pii")
    done = classify(found, fit(found))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return done.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
