"""Personal data by weak supervision, in DataFrame functions only.

Expressions propose candidate spans, also such as turn out to be none (digit chains that fail their check
sum, dotted numbers beyond 255). Four labelers vote on each (yes, no, or silent): its strict form, a
gazetteer (top-level domains, issuer digits, calling codes, country codes, given names), cue words just
before it, and its border. Expectation-maximisation over the table of vote patterns estimates how far each
labeler can be trusted on each kind, starting from and held by what is known beforehand (a failed check sum
settles a case, a border says little). The resulting probabilities train the span classifier, a logistic
model of the votes by kind and of what labelers don't look at: length, digits, separators and capitals of
the span, digits and sign before it. The base kinds (email, ip, card, phone) are fixed definitions and
always stay; candidates of the other kinds are added when the classifier says so.

The table of vote patterns has at most kinds * 3^4 rows, whatever the input; only it reaches the driver. The
classifier is fitted on at most TRAIN_ROWS candidates and on that table, so it also knows patterns that the
documents lack.

Positions: an expression marks its matches in the text, the marked text is cut at the marks, and lengths
add up. Expressions start only where a match can start, so long runs cost linear time.

Defined results: a null or empty text has no spans. Positions count code points, ends are exclusive.
Repeated rows get equal results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakeline.llm.common import whole_text
from wakeline.session import saved

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "name")
BASE = KINDS[:4]
LABELERS = ("form", "gazetteer", "cue", "border")
CONTEXT = 40
MARK = "\u0001"

#: Candidate expressions. Card: a whole chain of digits with single separators, of 13 to 19 digits.
_FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?",
}
#: A text without this has no match of the kind.
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}

#: Public code lists the gazetteer labeler knows.
_DOMAINS = "com org net edu gov info io de fr es uk eu it nl ch at be pl ru cn jp in br us ca au"
_COUNTRIES = "DE FR ES GB IT NL BE CH AT PT IE SE NO DK FI PL CZ HU GR LU"
_GIVEN = "Anna Maria John James Mary Robert Michael David Thomas Peter Paul Laura Julia Sarah Jean Marie Pierre José Juan Carmen Hans Klaus Sabine"
_CUES = {
    "email": "mail|contact|write|courriel|correo|kontakt", "ip": "ip|host|server|address|adresse", "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "tel|phone|call|mobile|fax|telefon|teléfono", "iban": "iban|account|bank|konto|compte|cuenta", "ssn": "ssn|social|security", "name": "name|signed|dear|by",
}
_AGAINST = "version|release|section|chapter|isbn|serial|order|invoice"


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


def _spans(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, value, before>> of the matches of one kind, from left to right."""
    cut = F.split(F.regexp_replace(text, f"({_FORMS[kind]})", f"{MARK}$1{MARK}"), MARK)
    item = "struct<kind: string, start: bigint, end: bigint, value: string, before: string>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("hit"), F.lit("").alias("last"), F.array().cast(f"array<{item}>").alias("found"))

    def step(a: Column, piece: Column) -> Column:
        end = a["at"] + F.length(piece)
        new = F.struct(F.lit(kind).alias("kind"), a["at"].alias("start"), end.alias("end"), piece.alias("value"), F.right(a["last"], F.lit(CONTEXT)).alias("before"))
        return F.struct(end.alias("at"), (~a["hit"]).alias("hit"), piece.alias("last"), F.when(a["hit"], F.concat(a["found"], F.array(new))).otherwise(a["found"]).alias("found"))

    found = F.aggregate(cut, start, step, lambda a: a["found"])
    worth = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike(_FORMS[kind])
    return F.when(worth, found).otherwise(F.array().cast(f"array<{item}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    digit = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    add = lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    moved = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substr(moved, i, F.lit(1)))
    add = lambda a, i: F.when(code(i) < 58, a * 10 + code(i) - 48).otherwise(a * 100 + code(i) - 55) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _valid(s: Column) -> Column:
    """Whether a base candidate fulfils its kind's definition; candidates of other kinds pass."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    n = F.length(_digits(s["value"]))
    return (F.when(s["kind"] == "ip", s["value"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(s["kind"] == "card", _luhn(s["value"])).when(s["kind"] == "phone", n.between(9, 15)).otherwise(True))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidate spans of every row of ``docs(doc_id, text)``, valid or not, by kind, then start."""
    text = F.regexp_replace(whole_text(F.col("text").cast("string")), MARK, "\u0003")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return slim.select("doc_id", F.concat(*[_spans(kind, F.col("text")) for kind in KINDS]).alias("found"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(s: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 yes, -1 no, 0 silent."""
    kind, value, before = s["kind"], s["value"], F.lower(s["before"])
    of = lambda cases: F.coalesce(*[F.when(kind == k, c) for k, c in cases.items()], F.lit(False))
    strict = of({"email": value.rlike(r"\.[A-Za-z]{2,}$"), "ip": _valid(s) & ~value.rlike(r"(?:^|\.)0[0-9]"), "card": _valid(s),
                 "phone": _valid(s) & value.rlike(r"^\+[1-9]"), "iban": _mod97(value), "ssn": ~value.rlike("^(?:000|666|9)|-00-|-0000$"), "name": value.rlike(r"\p{Lu}\p{Ll}+\x20\p{Lu}")})
    known = of({"email": value.rlike(rf"\.{_any(_DOMAINS)}$"), "card": value.rlike("^[3-6]"), "phone": value.rlike(r"^\+(?:1|3[0-9]|4[0-9])"),
                "iban": value.rlike(f"^{_any(_COUNTRIES)}"), "name": value.rlike(_any(_GIVEN))})
    odd = of({"ip": value.rlike(r"^(?:0|127|255)\."), "iban": ~value.rlike(f"^{_any(_COUNTRIES)}"), "card": ~value.rlike("^[3-6]"), "name": ~value.rlike(_any(_GIVEN))})
    cue = of({k: before.rlike(rf"\b(?:{w})") for k, w in _CUES.items()})
    inside = before.rlike(r"[\p{L}\p{N}]$")
    return {"form": _vote(strict, ~strict), "gazetteer": _vote(known, odd), "cue": _vote(cue, before.rlike(rf"\b(?:{_AGAINST})")), "border": _vote(~inside, inside)}


#: What is known beforehand: chances of the votes (no, silent, yes) on true and on false candidates. A form that
#: is a check sum or a rule of issue settles a case, other forms are met by many false candidates too.
_CHECKED, _RULED, _SHAPED = ((0.005, 0.015, 0.98), (0.9, 0.05, 0.05)), ((0.005, 0.025, 0.97), (0.2, 0.02, 0.78)), ((0.05, 0.05, 0.9), (0.25, 0.15, 0.6))
_FORM_TRUST = {"ip": _CHECKED, "card": _CHECKED, "iban": _CHECKED, "ssn": _RULED, "email": _SHAPED, "phone": _SHAPED, "name": _SHAPED}
_TRUST = {"gazetteer": ((0.1, 0.3, 0.6), (0.5, 0.35, 0.15)), "cue": ((0.1, 0.3, 0.6), (0.5, 0.35, 0.15)), "border": ((0.05, 0.02, 0.93), (0.28, 0.02, 0.7))}
#: Share of true candidates. All this weighs KNOWN_ROWS candidates and half of those counted, so that labelers which
#: never disagree, or a kind that has only good candidates, can't turn it round. Check sums and rules aren't estimated.
_PRIOR = {"email": 0.5, "ip": 0.5, "card": 0.5, "phone": 0.5, "iban": 0.35, "ssn": 0.35, "name": 0.35}
KNOWN_ROWS = 30


class Trust:
    """Chances of each labeler's votes by kind, and the share of true candidates of each kind."""

    def __init__(self) -> None:
        self.prior = dict(_PRIOR)
        self.chance = {(kind, i): self.known(kind, i) for kind in KINDS for i in range(len(LABELERS))}

    @staticmethod
    def known(kind: str, i: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
        return _FORM_TRUST[kind] if LABELERS[i] == "form" else _TRUST[LABELERS[i]]

    def probability(self, kind: str, vote: tuple[int, ...]) -> float:
        """That a candidate with these votes is personal data."""
        odds = math.log(self.prior[kind] / (1 - self.prior[kind]))
        for i, v in enumerate(vote):
            true, false = self.chance[kind, i]
            odds += math.log(true[v + 1] / false[v + 1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> Trust:
    """Expectation-maximisation over (kind, votes, count) patterns; what is known beforehand weighs half as much as the counts."""
    trust = Trust()
    for _ in range(rounds):
        p = [trust.probability(kind, v) for kind, v, _ in patterns]
        for kind in {k for k, _, _ in patterns}:
            own = [(v, n, q) for (k, v, n), q in zip(patterns, p) if k == kind]
            rows = sum(n for _, n, _ in own)
            held = KNOWN_ROWS + rows / 2
            trust.prior[kind] = (sum(n * q for _, n, q in own) + held * _PRIOR[kind]) / (rows + held)
            for i, labeler in enumerate(LABELERS):
                if labeler == "form" and _FORM_TRUST[kind] is not _SHAPED:
                    continue
                sides = []
                for side, known in enumerate(Trust.known(kind, i)):
                    share = [held * c for c in known]
                    for v, n, q in own:
                        share[v[i] + 1] += n * (1 - q if side else q)
                    sides.append(tuple(x / sum(share) for x in share))
                trust.chance[kind, i] = tuple(sides)
    return trust


#: Candidates that the classifier is fitted on, lowest in a hash.
TRAIN_ROWS = 20_000
CONTEXTS = ("length", "digits", "capitals", "breaks", "digits_before", "sign_before")
#: Features: each vote of each kind, each kind, and the context.
VOTED = [f"{kind}_{labeler}_{vote}" for kind in KINDS for labeler in LABELERS for vote in ("yes", "no")]
FEATURES = [*VOTED, *[f"is_{kind}" for kind in KINDS], *CONTEXTS]


@dataclass(frozen=True)
class SpanModel:
    """Weights of the span classifier by feature name."""

    weights: dict[str, float]
    bias: float

    def score(self, s: Column) -> Column:
        z = F.lit(self.bias)
        for name, value in _features(s).items():
            if self.weights.get(name):
                z = z + value * self.weights[name]
        return 1 / (1 + F.exp(-z))


def _context(s: Column) -> dict[str, Column]:
    """What the labelers don't look at, in numbers of about the same size."""
    value, before = s["value"], s["before"]
    share = lambda text, kind: F.length(F.regexp_replace(text, f"[^{kind}]", "")) / F.greatest(F.length(text), F.lit(1))
    return {"length": F.log2(F.length(value).cast("double")) / 5, "digits": share(value, "0-9"), "capitals": share(value, r"\p{Lu}"), "breaks": share(value, r"\x20.-"),
            "digits_before": share(before, "0-9"), "sign_before": F.when(before.rlike(r"[:=(#]\x20?$"), 1.0).otherwise(0.0)}


def _features(s: Column) -> dict[str, Column]:
    """Numbers the classifier sees, in the order of FEATURES."""
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    cast = votes(s)
    found = {f"{kind}_{labeler}_{word}": one((s["kind"] == kind) & (cast[labeler] == vote)) for kind in KINDS for labeler in LABELERS for word, vote in (("yes", 1), ("no", -1))}
    return found | {f"is_{kind}": one(s["kind"] == kind) for kind in KINDS} | _context(s)


def _examples(spark: SparkSession, rows: DataFrame, trust: Trust) -> DataFrame:
    """Features, label and weight: each candidate once as true and once as false, and so each pattern of votes there can be."""
    every = [(kind, *v, trust.probability(kind, v)) for kind in KINDS for v in product((-1, 0, 1), repeat=len(LABELERS))]
    table = spark.createDataFrame(every, "kind string, " + ", ".join(f"{k} int" for k in LABELERS) + ", p double").coalesce(1)
    # broadcast: kinds * 3^4 rows
    real = rows.join(F.broadcast(table), ["kind", *LABELERS]).select(*[F.col(f"x.{c}").alias(c) for c in FEATURES], "p", F.lit(1.0).alias("n"))
    means = rows.agg(*[F.coalesce(F.avg(f"x.{c}"), F.lit(0.0)).alias(c) for c in CONTEXTS]).first()
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    thought = table.select(*[one((F.col("kind") == kind) & (F.col(labeler) == vote)).alias(f"{kind}_{labeler}_{word}") for kind in KINDS for labeler in LABELERS for word, vote in (("yes", 1), ("no", -1))],
                           *[one(F.col("kind") == kind).alias(f"is_{kind}") for kind in KINDS], *[F.lit(float(means[c])).alias(c) for c in CONTEXTS], "p", F.lit(0.5).alias("n"))
    sides = F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p") + 1e-9).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p")) + 1e-9).alias("weight")))
    return real.unionByName(thought).select(*FEATURES, F.inline(sides))


def train(found: DataFrame) -> SpanModel:
    """Span classifier from the candidates of ``found(doc_id, found)``; without candidates it is what is known beforehand."""
    spark: SparkSession = found.sparkSession
    spans = found.select("doc_id", F.explode("found").alias("s"))
    rows = spans.select("doc_id", "s", F.col("s.kind").alias("kind"), *[v.alias(k) for k, v in votes(F.col("s")).items()])
    counted = rows.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).orderBy("kind", *LABELERS).collect()
    trust = estimate([(r["kind"], tuple(r[k] for k in LABELERS), r["n"]) for r in counted])
    lot = F.xxhash64("doc_id", "s.kind", "s.start")
    sample = rows.orderBy(lot, "doc_id", "s").limit(TRAIN_ROWS)
    sample = saved(sample.select("kind", *LABELERS, F.struct(*[v.cast("double").alias(k) for k, v in _features(F.col("s")).items()]).alias("x")), "spans")
    examples = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_examples(spark, sample, trust))
    model = LogisticRegression(weightCol="weight", regParam=1e-5, standardization=False, maxIter=100).fit(saved(examples.select("features", "label", "weight"), "examples"))
    return SpanModel(dict(zip(FEATURES, map(float, model.coefficients))), float(model.intercept))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found array<struct<kind, start, end, value, score>>`` by kind, then start."""
    found = saved(candidates(docs), "candidates")
    model = train(found)
    item = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), model.score(s).alias("score"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE) & _valid(s))
    added = F.filter(F.transform(F.filter("found", lambda s: ~s["kind"].isin(*BASE)), item), lambda s: s["score"] >= 0.5)
    return found.select("doc_id", F.concat(F.transform(base, item), added).alias("found"))
