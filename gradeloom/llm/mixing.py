"""Mixing a corpus to target token weights when the domain of most documents is unknown.

A naive Bayes classifier, fitted on the documents of a labelled table, gives every document a
posterior over the domains (soft membership). Each document then gets a nonnegative rate, the
expected number of its copies, such that the expected tokens per domain meet the targets in the
least-squares sense. The rates are found by projected gradient steps from rate 1.

A step needs one small sum per domain over all documents. The metric of the steps is the
document's token count on one side and the inverse of the domains' token overlap on the other,
so the step size is 1 and few steps are needed. A rate is a function of the document's own
posterior and the list of past steps: it is computed in place, never stored or joined.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored, unused

# Strings whose counts tell languages and styles apart.
MARKS = ("e", "a", "t", "i", "o", "n", "s", "r", "h", "d", "l", "u", "th", "ch", "ei", "ou",
         "é", "è", "ç", "ä", "ö", "ü", "ß", "ñ", "ó", "í", "%", "|", "!")
# The marks of one text are not independent, so a long text counts as at most this many. Which of
# these numbers is right is decided by the likelihood of labelled rows the classifier has not seen;
# the first one also stands where there are none.
EVIDENCE = (20.0, 2.5, 5.0, 10.0, 40.0, 80.0, 160.0, 640.0)
STEPS, TOLERANCE = 50, 1e-7


@dataclass
class Domains:
    """Log-probabilities of a fitted classifier."""

    names: list[str]
    prior: list[float]
    log_p: list[list[float]]
    evidence: float = EVIDENCE[0]


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def mark_counts(text: Column) -> Column:
    """How often each mark occurs, as an array of integers."""
    text = F.coalesce(text, F.lit(""))
    return F.array(*[
        ((F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)).cast("int") for m in MARKS])


def _sum(terms: list[Column]) -> Column:
    """Terms added pairwise, so that the expression stays flat."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2:]
    return terms[0] if terms else F.lit(0.0)


def fit_domains(labelled: DataFrame, names: list[str], counts: str = "marks") -> Domains:
    """Fit on ``labelled`` (domain, array of mark counts); all its rows count, other domains do not.

    A fit on the rows of one half, by a hash of the counts, chooses ``evidence`` on the other.
    """
    rows = stored(labelled.where(F.col("domain").isin(names)).select(
        "domain", F.col(counts).alias("marks"), F.pmod(F.xxhash64(counts), F.lit(2)).alias("half")))
    sums = rows.groupBy("domain", "half").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col("marks")[i].cast("double")).alias(f"m{i}") for i in range(len(MARKS))]).collect()
    part = _domains(names, [r for r in sums if r.half == 0])
    held_out = stored(rows.where("half = 1").select(
        F.array_position(F.lit(names), F.col("domain")).cast("int").alias("at"),
        F.array(*_evidence(part, F.col("marks"))).alias("sums"), _size(F.col("marks")).alias("size")))

    def likelihood(evidence: float) -> Column:
        packed = _exponents([F.lit(x) + _scale(evidence, F.col("size")) * F.col("sums")[i]
                             for i, x in enumerate(part.prior)])
        share = F.element_at(packed, F.col("at")) / F.aggregate(packed, F.lit(0.0), lambda a, x: a + x)
        return F.sum(F.log(F.greatest(share, F.lit(1e-300))))
    found = held_out.agg(*[likelihood(e) for e in EVIDENCE]).first()
    model = _domains(names, sums)
    if found[0] is not None:
        model.evidence = EVIDENCE[int(np.argmax(found))]
    return model


def _domains(names: list[str], rows: list) -> Domains:
    total = sum(r.n for r in rows)
    prior, log_p = [], []
    for name in names:
        own = [r for r in rows if r.domain == name]
        sums = np.array([sum(r[f"m{i}"] for r in own) for i in range(len(MARKS))], float)
        prior.append(float(np.log((sum(r.n for r in own) + 1) / (total + len(names)))))
        log_p.append([float(x) for x in np.log((sums + 1) / (sums.sum() + len(MARKS)))])
    return Domains(names, prior, log_p)


def _size(counts: Column) -> Column:
    return _sum([counts[i].cast("double") for i in range(len(MARKS))])


def _scale(evidence: float, size: Column) -> Column:
    return F.lit(evidence) / F.greatest(size, F.lit(evidence))


def _evidence(model: Domains, counts: Column) -> list[Column]:
    return [_sum([counts[i] * F.lit(x) for i, x in enumerate(log_p)]) for log_p in model.log_p]


def _exponents(scores: list[Column]) -> Column:
    # The lambda's variable holds the scores, so that they are computed once.
    return F.transform(F.array(F.array(*scores)), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]


def posterior(model: Domains, counts: Column) -> Column:
    """Unscaled probabilities of the domains, an array; a text without marks has the prior."""
    scale = _scale(model.evidence, _size(counts))
    return _exponents([F.lit(x) + scale * e for x, e in zip(model.prior, _evidence(model, counts), strict=True)])


@dataclass
class Rates:
    """Past steps; ``of`` gives a document's rate from its posterior."""

    steps: list[list[float]] = field(default_factory=list)
    residual: list[float] = field(default_factory=list)

    def of(self, p: list[Column]) -> Column:
        rate = F.lit(1.0)
        for step in self.steps:
            rate = F.greatest(F.lit(0.0), rate - _sum([c * F.lit(float(x)) for c, x in zip(p, step, strict=True)]))
        return rate


def target_tokens(current: Mapping[str, float], weights: Mapping[str, float] | None, power: float) -> list[float]:
    """Tokens per domain: the total split by ``weights``, or by the current sizes to a power."""
    sizes = np.array([current[n] for n in current])
    share = np.array([weights[n] for n in current], float) if weights else np.where(sizes > 0, sizes, 0) ** power
    return [float(x) for x in sizes.sum() * share / share.sum()] if share.sum() > 0 else [0.0] * len(sizes)


def fit_rates(table: DataFrame, columns: list[str], target) -> Rates:
    """Rates for ``table`` (tokens, one posterior column per domain); ``target`` maps sums to targets."""
    p = [F.col(c) for c in columns]
    tokens = F.col("tokens").cast("double")
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    first = table.agg(
        *[F.coalesce(F.sum(tokens * c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(p)],
        *[F.coalesce(F.sum(tokens * p[i] * p[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((n, n))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = first[f"g{i}_{j}"]
    current = np.array([first[f"s{i}"] for i in range(n)])
    goal = np.array(target(current))
    inverse = np.linalg.pinv(gram)
    rates = Rates()
    scale = max(1.0, float(np.abs(goal).max(initial=0)))
    last = np.inf
    for _ in range(STEPS):
        gap = current - goal
        size = float(np.abs(gap).max(initial=0)) / scale
        loss = float(gap @ inverse @ gap)
        if size < TOLERANCE or last - loss < TOLERANCE * max(loss, 1e-12):
            break
        last = loss
        rates.steps.append([float(x) for x in inverse @ gap])
        rate = rates.of(p)
        row = table.agg(*[F.sum(tokens * rate * c).alias(f"s{i}") for i, c in enumerate(p)]).first()
        current = np.array([row[f"s{i}"] for i in range(n)])
    rates.residual = [float(x) for x in current - goal]
    return rates


@dataclass
class Mixture:
    """A fitted classifier and its rates."""

    domains: Domains
    rates: Rates
    target: list[float]


def _split(packed: Column, n: int) -> list[Column]:
    return [packed[i] / F.aggregate(packed, F.lit(0.0), lambda a, x: a + x) for i in range(n)]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, u, tokens, marks) of every row. ``u`` is a fixed number in [0, 1) of the row."""
    return docs.select("doc_id", uniform().alias("u"), token_count(F.col("text")).alias("tokens"),
                       mark_counts(F.col("text")).alias("marks"))


def uniform() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), "doc_id", "text"), 11) / F.lit(float(1 << 53))


def with_posteriors(table: DataFrame, model: Domains) -> DataFrame:
    """Replace ``marks`` by one posterior column ``p0``, ``p1``, ... per domain."""
    n = len(model.names)
    return table.withColumn("_e", posterior(model, F.col("marks"))).withColumns(
        {f"p{i}": c for i, c in enumerate(_split(F.col("_e"), n))}).drop("_e", "marks")


def fit_mixture(
    table: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5
) -> tuple[Mixture, DataFrame]:
    """Fit classifier and rates on a measured table and a labelled table (doc_id, domain).

    Returns them with the table of posteriors. ``weights`` names the domains and their share of
    the tokens; without it the domains are those of ``labelled`` (a few, as many as a query can
    list) and the shares are their present sizes to ``power``.
    """
    known = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").select("doc_id", "domain").distinct()
    names = sorted(weights) if weights else sorted(r.domain for r in known.select("domain").distinct().collect())
    if not names:
        return Mixture(Domains([], [], []), Rates(), []), table.drop("marks")
    model = fit_domains(table.join(known, "doc_id"), names)
    scored = stored(with_posteriors(table, model))
    goal: list[float] = []

    def target(sizes):
        goal[:] = target_tokens(dict(zip(names, sizes, strict=True)), weights, power)
        return goal
    rates = fit_rates(scored, [f"p{i}" for i in range(len(names))], target)
    return Mixture(model, rates, goal), scored


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5
) -> DataFrame:
    """(doc_id, tokens, domain, membership, rate, copies) of every row of ``docs`` (doc_id, text).

    ``domain`` is the likeliest one (the first of equal ones) and ``membership`` its posterior.
    ``copies`` is the rate rounded up or down by a number fixed for the row, so its mean is the
    rate. A null or empty text has no tokens and the posterior of the prior; a row with a null
    doc_id takes part like any other but is never labelled; repeated rows are rated alike. If
    nothing is labelled, the domain is null and the rate 1.
    """
    mixture, scored = fit_mixture(stored(measured(docs)), labelled, weights, power)
    names = mixture.domains.names
    p = [F.col(f"p{i}") for i in range(len(names))]
    best = F.greatest(*p) if len(p) > 1 else p[0] if p else F.lit(None).cast("double")
    domain = F.coalesce(*[F.when(c == best, F.lit(n)) for c, n in zip(p, names, strict=True)],
                        F.lit(None).cast("string"))
    rate = mixture.rates.of(p)
    return scored.select("doc_id", "tokens", domain.alias("domain"), best.alias("membership"),
                         rate.alias("rate"), F.floor(rate + F.col("u")).cast("long").alias("copies"))


def mixed(
    docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.5
) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; all columns kept.

    Rates are computed from the text again, where it is, instead of moving texts for a join.
    """
    mixture, _ = fit_mixture(stored(measured(docs)), labelled, weights, power)
    n = len(mixture.domains.names)
    if not mixture.rates.steps:
        return docs
    marks, u, e, p, copies, copy = (unused(docs, f"_{x}") for x in ("marks", "u", "e", "p", "copies", "copy"))
    named = docs.withColumns({marks: mark_counts(F.col("text")), u: uniform()}).withColumn(
        e, posterior(mixture.domains, F.col(marks))).withColumn(p, F.array(*_split(F.col(e), n)))
    times = F.floor(mixture.rates.of([F.col(p)[i] for i in range(n)]) + F.col(u)).cast("int")
    # No filter on the number of copies: it would be pushed down, and everything computed twice.
    return named.withColumn(copies, times).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.explode(F.array_repeat(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
