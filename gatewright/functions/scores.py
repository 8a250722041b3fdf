"""Column functions on distributions over a closed candidate set.

A distribution is ``ARRAY<STRUCT<candidate STRING, probability DOUBLE>>`` in the order in
which the candidates were listed; position decides ties, the first listed wins. Everything
here is built-in expressions in the JVM; functions on arrays are interpreted row by row, so
each value is computed once a row (``bound``) and the work is linear in the candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are clamped from below before a logarithm is taken.
FLOOR = 1e-12
#: How far the sum of a distribution may be from 1.
TOLERANCE = 1e-6


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def distribution(candidates: Column | str, probabilities: Column | str) -> Column:
    """Pair candidates and probabilities by position."""
    return F.zip_with(_c(candidates), _c(probabilities), lambda c, p: F.struct(c.alias("candidate"), p.cast("double").alias("probability")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, and not once for each element of a lambda inside."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(logits: Column | str) -> Column:
    """Stable softmax of an array."""
    powers = lambda x: bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return normalised(bound(_c(logits), powers))


def normalised(weights: Column | str) -> Column:
    return bound(_c(weights), lambda w: bound(_total(w), lambda t: F.transform(w, lambda v: v / t)))


def candidate_softmax(candidates: Column | str, logits: Column | str) -> Column:
    return distribution(candidates, softmax(logits))


def prior_corrected(task: Column | str, neutral: Column | str, alpha: float = 1.0) -> Column:
    """Task log-probabilities less alpha times the neutral ones; alpha must not be negative."""
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    return F.zip_with(_c(task), _c(neutral), lambda t, n: t - F.lit(float(alpha)) * n)


def temperature_scaled(scores: Column | str, temperature: float | Column) -> Column:
    """Softmax of ln(p) / T, with p clamped at the floor; an empty distribution stays empty."""
    if not isinstance(temperature, Column):
        if not temperature > 0:
            raise ValueError("the temperature must be positive")
        temperature = F.lit(float(temperature))
    # the temperature is computed once a row, too
    logits = lambda s: bound(temperature, lambda t: F.transform(s, lambda x: F.log(F.greatest(x["probability"], F.lit(FLOOR))) / t))
    scaled = lambda s: distribution(F.transform(s, lambda x: x["candidate"]), softmax(logits(s)))
    return bound(_c(scores), scaled)


def next_up(x: Column) -> Column:
    """The next larger double."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), x.cast("double")).cast("double")


def structured_choice(candidate: Column | str, confidence: Column | str, candidates: Column | str) -> Column:
    """A distribution from one chosen candidate and a confidence in [0, 1]; others share the rest.

    The chosen one gets at least the uniform share, and a little more than that if it would
    be level with the others. NULL if the candidate is not listed or the confidence invalid.
    """
    chosen, conf, listed = _c(candidate), _c(confidence).cast("double"), _c(candidates)
    k = F.size(listed)
    share = F.lit(1.0) / k
    p = F.when(k == 1, F.lit(1.0)).when(conf > share, conf).otherwise(next_up(share))
    rest = F.when(k > 1, (F.lit(1.0) - p) / F.greatest(k - 1, F.lit(1))).otherwise(F.lit(0.0))
    made = F.transform(listed, lambda c: F.struct(c.alias("candidate"), F.when(c == chosen, p).otherwise(rest).alias("probability")))
    return F.when(F.array_contains(listed, chosen) & conf.between(0.0, 1.0), made)


def uniform(candidates: Column | str) -> Column:
    c = _c(candidates)
    return F.transform(c, lambda x: F.struct(x.alias("candidate"), (F.lit(1.0) / F.size(c)).alias("probability")))


def parse_choice(text: Column | str, candidates: Column | str) -> Column:
    """STRUCT(candidate, confidence) from the text between its first and last brace.

    A confidence that is not there is 1; a number in quotes counts as one, null does not. NULL if
    there is no JSON object, the candidate is not listed or the confidence is no number in [0, 1].
    """
    body = F.try_parse_json(F.regexp_extract(_c(text), r"(?s)\{.*\}", 0))
    given = F.schema_of_variant(F.try_variant_get(body, "$.confidence", "variant"))
    said = F.try_variant_get(body, "$.confidence", "string")
    flag = F.try_variant_get(body, "$.confidence", "boolean").cast("double")
    number = F.when(given == "BOOLEAN", flag).when(given != "VOID", said.try_cast("double"))
    conf = F.when(given.isNull(), F.lit(1.0)).otherwise(number)
    candidate = F.try_variant_get(body, "$.candidate", "string")
    good = F.coalesce(body.isNotNull() & F.array_contains(_c(candidates), candidate) & conf.between(0.0, 1.0) & ~F.isnan(conf), F.lit(False))
    return F.when(good, F.struct(candidate.alias("candidate"), conf.alias("confidence")))


def _ranked(scores: Column) -> Column:
    """Candidates by probability, the first listed before others of the same."""
    keyed = F.transform(scores, lambda s, i: F.struct((-s["probability"]).alias("k"), i.alias("i"), s["candidate"].alias("candidate"), s["probability"].alias("probability")))
    return F.array_sort(keyed)


def top1(scores: Column | str) -> Column:
    """STRUCT(candidate, probability) of the best candidate."""
    keyed = F.transform(_c(scores), lambda s, i: F.struct(s["probability"].alias("probability"), (-i).alias("i"), s["candidate"].alias("candidate")))
    best = F.array_max(keyed)
    return F.struct(best["candidate"].alias("candidate"), best["probability"].alias("probability"))


def runner_up(scores: Column | str) -> Column:
    """The second-best probability, 0 for a single candidate."""
    return F.coalesce(F.try_element_at(_ranked(_c(scores)), F.lit(2))["probability"], F.lit(0.0))


def probability_of(scores: Column | str, candidate: Column | str) -> Column:
    """The probability of a candidate, NULL if it is not listed."""
    return F.try_element_at(F.filter(_c(scores), lambda s: s["candidate"] == _c(candidate)), F.lit(1))["probability"]


def _broken(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that do not hold; one that cannot be decided does not hold."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())


def violations(candidates: Column | str, scores: Column | str, *, lengths: bool = True, sums: bool = True) -> Column:
    """What is wrong with a distribution: ``candidate_set``, ``length``, ``probability``, ``sum``; empty if nothing.

    Null arrays, candidates and probabilities are wrong, as are probabilities outside [0, 1].
    """
    listed, s = _c(candidates), _c(scores)
    named = F.transform(s, lambda x: x["candidate"])
    rules = [("candidate_set", (F.size(F.array_except(listed, named)) > 0) | (F.size(F.array_except(named, listed)) > 0) | (F.size(s) < 1))]
    if lengths:
        rules.append(("length", F.size(listed) != F.size(named)))
    outside = F.exists(s, lambda x: F.coalesce(F.isnan(x["probability"]) | ~x["probability"].between(0.0, 1.0), F.lit(True)))
    rules.append(("probability", outside))
    if sums:
        rules.append(("sum", F.abs(_total(F.transform(s, lambda x: x["probability"])) - 1.0) > TOLERANCE))
    return _broken(rules)


def request_violations(decision_type: Column | str, candidates: Column | str) -> Column:
    c = _c(candidates)
    return _broken([("decision_type", F.coalesce(_c(decision_type), F.lit("")) == ""), ("no_candidates", F.coalesce(F.size(c), F.lit(0)) <= 0), ("repeated_candidates", F.size(c) != F.size(F.array_distinct(c)))])


def bin_of(confidence: Column | str, bins: int = 10) -> Column:
    """The equal-width bin, by comparison with its edges, so that edges fall right; 1.0 is in the last."""
    edges = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    return F.size(F.filter(edges, lambda e: _c(confidence) >= e))


def reversed_and_rotated(candidates: Column | str) -> Column:
    """The orders to try: reversed, and rotated by one if that is another order."""
    c = _c(candidates)
    turned = F.concat(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, F.lit(1), F.lit(1)))
    back = F.reverse(c)
    named = F.array(F.struct(F.lit("reverse").alias("name"), back.alias("candidates")), F.struct(F.lit("rotate_left_1").alias("name"), turned.alias("candidates")))
    return F.filter(named, lambda v: (v["candidates"] != c) & ((v["name"] == "reverse") | (v["candidates"] != back)))


def words_of(text: Column | str) -> Column:
    """Distinct lower-case runs of ASCII letters, digits and underscores."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(text), F.lit("([A-Za-z0-9_]+)"), 1), lambda w: F.lower(w)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """The similarity of two arrays without repetitions; 0 if both are empty."""
    x, y = _c(a), _c(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(x) + F.size(y) - both), F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
