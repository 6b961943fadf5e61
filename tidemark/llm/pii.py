"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the votes, a classifier decides.

Everything that touches texts is DataFrame functions. A candidate is a match of one of the kinds below. Each labeler
(a strict pattern, a checksum or range, a gazetteer, the words before it, the shape) votes 1, 0 or abstains. How often
each combination of votes occurs over the whole corpus is counted; from these counts, at most a few hundred rows,
expectation-maximisation (two classes, labelers independent given the class) estimates how reliable each labeler is and
how likely a combination is personal data. Those probabilities label the spans softly, and a naive Bayes classifier over
the span's features is trained on sums of them over all spans. A span is reported if its base rule holds or if the
classifier gives at least CUT.

A text is first cut into segments at safe places, so work and memory follow its length: after a line's end, after a
character that is in no pattern, and between a letter and a space. No pattern matches across such a place, and none that
looks at its neighbours sees a difference there. A stretch without one stays whole, so matches are those of the whole text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, id_and_text, private, stored

CUT = 0.5
ROUNDS = 60
CONTEXT = 24
SEGMENT = 2000  # characters from which a segment ends at the next safe place
BASE_KINDS = ("email", "ip", "card", "phone")
# The patterns of the kinds. Possessive quantifiers and the look-behind give the same leftmost matches
# without going back over long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "handle": r"(?<![A-Za-z0-9._%+@-])@[A-Za-z][A-Za-z0-9_]{2,30}+(?![A-Za-z0-9_@.-])",
    "key": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{16,64}+|ghp_[A-Za-z0-9]{20,64}+)(?![A-Za-z0-9_-])",
    "local": r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = tuple(PATTERNS)
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": ".", "handle": "@", "phone": "+"}
# Words that speak for and against personal data just before a span, and the gazetteer of mail domains' ends.
FOR_WORDS = r"(?i)\b(?:e-?mail|mail|contact|write|call|phone|tel|mobile|fax|ssn|social|card|visa|credit|pay|key|secret|token|password|from|ip|host|address|reach|cc|account)\b[^A-Za-z]*$"
AGAINST_WORDS = r"(?i)\b(?:version|release|v|section|figure|table|chapter|isbn|issn|page|order|build|eq|no)\b[.\s#:]*$"
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
LABELERS = ("rule", "gazetteer", "context", "shape")
SAFE = r"(?:(?<=[^A-Za-z0-9._%+@\x20()-])|(?<=[A-Za-z])(?=\x20))"
CANDIDATE = "array<struct<kind:string,order:int,start:int,end:int,base:boolean,votes:int,size:int,digits:int,before:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(x)
    total = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda s, i: s + F.when((n - i) % 2 == 0, F.substring(x, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(x, i, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def _base_rule(kind: str, match: Column) -> Column:
    """The rule a span of a base kind must meet; kinds beyond the base have none."""
    digits = _digits(match)
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(False)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """2: for, 1: against, 0: abstains."""
    out = F.when(F.coalesce(yes, F.lit(False)), 2)
    return (out.when(F.coalesce(no, F.lit(False)), 1) if no is not None else out).otherwise(0)


def _votes(kind: str, match: Column, before: Column, base: Column) -> Column:
    """The four votes as one number in base 3, in the order of LABELERS."""
    digits = _digits(match)
    end = F.lower(F.substring_index(match, ".", -1))
    rule = _vote(base, ~base) if kind in BASE_KINDS else _vote(F.lit(kind in ("key", "secret", "ssn")))
    gazetteer = {
        "email": _vote(end.isin(*DOMAIN_ENDS), ~end.rlike("^[a-z]{2,}$")),
        "ip": _vote(match.rlike(r"^(?:10|127|172|192)\."), match.rlike(r"^0\.|\.0\.0\.0$")),
        "card": _vote(digits.rlike("^(?:4|5[1-5]|3[47]|6(?:011|5))"), digits.rlike("^[0789]")),
        "phone": _vote(digits.rlike("^(?:1|33|34|44|49)"), digits.rlike("^0")),
        "local": _vote(digits.rlike("^[2-9]"), digits.rlike("^[01]")),
        "ssn": _vote(F.lit(False), digits.rlike("^(?:000|666|9)")),
    }.get(kind, F.lit(0))
    context = _vote(before.rlike(FOR_WORDS), before.rlike(AGAINST_WORDS))
    shape = {
        "card": _vote(F.length(digits) == 16, ~F.length(digits).between(13, 19)),
        "ip": _vote(F.length(match) >= 9, match.rlike(r"^[0-9](?:\.[0-9]){3}$")),
        "phone": _vote(F.length(digits).between(11, 13), ~F.length(digits).between(8, 15)),
        "handle": _vote(match.rlike("[0-9_]"), F.length(match) < 5),
    }.get(kind, _vote(F.length(match) >= 8))
    return rule * 27 + gazetteer * 9 + context * 3 + shape


def segments(text: Column) -> Column:
    """Array of {text, at, context}: the segments of a text, their starts in code points and what stands before them."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{{SEGMENT},}}?{SAFE}|.+"), F.lit(0))
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
    starts = F.aggregate(cut, start, lambda acc, x: F.struct(F.concat(acc["starts"], F.array(acc["at"])).alias("starts"), (acc["at"] + F.length(x)).alias("at")), lambda acc: acc["starts"])
    return F.transform(F.arrays_zip(cut.alias("text"), starts.alias("at")), lambda s, i: F.struct(s["text"].alias("text"), s["at"].alias("at"), F.when(i > 0, F.right(F.try_element_at(cut, i), F.lit(CONTEXT))).otherwise("").alias("context")))


def candidates(segment: Column) -> Column:
    """All candidate spans of a segment, of every kind, as an array; positions are code points within the segment."""
    return F.concat(*(_candidates_of(kind, segment["text"], segment["context"]) for kind in KINDS))


def _candidates_of(kind: str, text: Column, context: Column) -> Column:
    pattern = F.lit(PATTERNS[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    # A match begins after the gaps and matches before it; the gaps are what the pattern splits the text into.
    gaps = F.split(text, PATTERNS[kind], -1)
    ends = F.aggregate(
        F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["gap"] + x["size"])),
    )
    spans = F.zip_with(matches, F.slice(ends, 2, F.greatest(F.size(matches), F.lit(0))), lambda m, e: F.struct(m.alias("match"), (e - F.length(m)).alias("start"), e.alias("end")))
    if kind in ("card", "ip"):  # most runs of digits are short
        spans = F.filter(spans, lambda s: F.length(s["match"]) >= (13 if kind == "card" else 7))

    def described(s: Column) -> Column:
        near = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        before = F.when(s["start"] < CONTEXT, F.right(F.concat(context, near), F.lit(CONTEXT))).otherwise(near)
        base = _base_rule(kind, s["match"])
        digits = F.length(_digits(s["match"]))
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("order"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"),
            base.alias("base"), _votes(kind, s["match"], before, base).cast("int").alias("votes"), F.length(s["match"]).cast("int").alias("size"), digits.cast("int").alias("digits"),
            F.when(before == "", "^").when(before.rlike(r"[\s]$"), " ").when(before.rlike("[A-Za-z0-9]$"), "a").otherwise("-").alias("before"),
        )

    found = F.transform(spans, described).cast(CANDIDATE)
    test = text.contains(HINTS[kind]) if kind in HINTS else text.rlike({"card": "[0-9](?:[ -]?[0-9]){12}", "key": "AKIA|sk-|ghp_", "local": "[0-9]{3}[-.][0-9]{4}", "secret": "[0-9a-f]{32}", "ssn": "-[0-9]{2}-"}[kind])
    return F.when(test, found).otherwise(F.array().cast(CANDIDATE))


def estimate(counts: list[tuple[str, int, int]], rounds: int = ROUNDS) -> dict[tuple[str, int], float]:
    """(kind, votes) -> probability that it is personal data, from how often each occurs: expectation-maximisation.

    A class-conditional table of each labeler's three votes is estimated for each class over all kinds, with the share of
    the class for each kind. The start favours votes for; a little is added to every count, so nothing becomes 0 or 1.
    """
    def split(v: int) -> tuple[int, ...]:
        return v // 27 % 3, v // 9 % 3, v // 3 % 3, v % 3

    posterior = {(k, v): (lambda a: 1 / (1 + math.exp(-(2 * a.count(2) - 2 * a.count(1)))))(split(v)) for k, v, _ in counts}
    for _ in range(rounds if counts else 0):
        table = [[[0.5] * 3 for _ in LABELERS] for _ in range(2)]
        share: dict[str, list[float]] = {}
        for k, v, n in counts:
            p = posterior[k, v]
            s = share.setdefault(k, [1.0, 2.0])
            s[0] += n * p
            s[1] += n
            for c, weight in ((1, n * p), (0, n * (1 - p))):
                for labeler, vote in enumerate(split(v)):
                    table[c][labeler][vote] += weight
        logs = [[[math.log(x / sum(votes)) for x in votes] for votes in side] for side in table]
        for k, v, _ in counts:
            prior = share[k][0] / share[k][1]
            odds = math.log(prior / (1 - prior)) + sum(logs[1][i][vote] - logs[0][i][vote] for i, vote in enumerate(split(v)))
            posterior[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior


FEATURES = ("size", "digits", "before")


def _feature_keys(kind: Column, size: Column, digits: Column, before: Column) -> list[Column]:
    return [
        F.concat(kind, F.lit("|size|"), F.least(F.floor(size / 3), F.lit(15)).cast("string")),
        F.concat(kind, F.lit("|digits|"), F.least(F.floor(digits / 2), F.lit(12)).cast("string")),
        F.concat(kind, F.lit("|before|"), before),
    ]


def classifier(spans: DataFrame) -> tuple[dict[tuple[str, int], float], dict[str, float]]:
    """(probabilities of vote combinations, log odds of features and kinds), from grouped counts of all spans.

    spans: rows of candidates. The groups are kinds, votes and coarse features: their number doesn't grow with the corpus.
    """
    size, digits = F.least(F.floor(F.col("size") / 3), F.lit(15)), F.least(F.floor(F.col("digits") / 2), F.lit(12))
    groups = spans.groupBy("kind", "votes", size.cast("int").alias("size"), digits.cast("int").alias("digits"), "before").agg(F.count("*").alias("n")).collect()
    seen: dict[tuple[str, int], int] = {}
    for g in groups:
        seen[g.kind, g.votes] = seen.get((g.kind, g.votes), 0) + g.n
    posterior = estimate([(k, v, n) for (k, v), n in sorted(seen.items())])
    sums: dict[str, list[float]] = {}
    for g in groups:
        p = posterior[g.kind, g.votes]
        for key in (f"{g.kind}", f"{g.kind}|size|{g.size}", f"{g.kind}|digits|{g.digits}", f"{g.kind}|before|{g.before}", f"{g.kind}|votes|{g.votes}"):
            s = sums.setdefault(key, [0.5, 0.5])
            s[0] += g.n * p
            s[1] += g.n * (1 - p)
    odds = {k: math.log(a / b) for k, (a, b) in sums.items()}
    return posterior, {k: x if "|" not in k else x - odds[k.split("|")[0]] for k, x in odds.items()}


def _probability(span: Column, odds: dict[str, float]) -> Column:
    """The naive Bayes classifier: the kind's log odds and those of its features and votes."""
    table = F.create_map(*[x for k, v in sorted(odds.items()) for x in (F.lit(k), F.lit(float(v)))]) if odds else F.create_map().cast("map<string,double>")
    keys = [span["kind"], *_feature_keys(span["kind"], span["size"], span["digits"], span["before"]), F.concat(span["kind"], F.lit("|votes|"), span["votes"].cast("string"))]
    total = sum((F.coalesce(F.try_element_at(table, k), F.lit(0.0)) for k in keys), F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    first = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(first)


def _accepted(spans: Column, odds: dict[str, float]) -> Column:
    """Base spans, and what the classifier adds."""
    return F.filter(spans, lambda s: s["base"] | (~s["kind"].isin(*BASE_KINDS) & (_probability(s, odds) >= CUT)))


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): ordered arrays of {start, order, end, kind}; `spans` also has what the classifier adds.

    A null or empty text has no spans. Repeated rows are found alike and count each time. A null doc_id stays null; an
    empty table gives no rows. Spans of different kinds may overlap; those of one kind don't.
    """
    def of_text(segment: Column) -> Column:
        moved = lambda s: s.withField("start", s["start"] + segment["at"]).withField("end", s["end"] + segment["at"])
        return F.transform(candidates(segment), moved)

    docs = id_and_text(docs).select("doc_id", segments(F.coalesce("text", F.lit(""))).alias("segments"))
    found = stored(docs.select("doc_id", F.flatten(F.transform("segments", of_text)).alias("spans")), "pii-candidates")
    _, odds = classifier(found.select(F.inline("spans")))
    return found.select("doc_id", _ordered(F.filter("spans", lambda s: s["base"])).alias("base"), _ordered(_accepted(F.col("spans"), odds)).alias("spans"))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document; see personal_spans()."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return personal_spans(docs).select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each personal span replaced by its kind in angle brackets, and n_chars, if there, set to the new length.

    Of overlapping spans the first in order is replaced and the others' remainder too. All rows and columns stay, whatever
    their names; a null text stays null, and an empty table stays empty.
    """
    docs = private(docs)
    held = free_name("segments", docs.columns)
    rows = docs.withColumn(held, F.transform(segments(F.coalesce("text", F.lit(""))), lambda s: F.struct(s["text"].alias("text"), candidates(s).alias("spans"))))
    found = stored(rows, "pii-documents")
    _, odds = classifier(found.select(F.explode(held).alias("s")).select(F.inline("s.spans")))

    def clean(segment: Column) -> Column:
        text = segment["text"]

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
            return F.struct(F.concat(acc["out"], gap, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.when(F.size(segment["spans"]) == 0, text).otherwise(F.aggregate(segment["spans"], start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))

    accepted = F.transform(held, lambda s: F.struct(s["text"].alias("text"), _ordered(_accepted(s["spans"], odds)).alias("spans")))
    changed = F.exists(held, lambda s: F.size(_accepted(s["spans"], odds)) > 0)
    found = found.withColumn("text", F.when(changed, F.array_join(F.transform(accepted, clean), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)
