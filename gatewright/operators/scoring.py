"""Scorers as operators: anything that turns requests into distributions.

A *scorer* is a function DataFrame -> DataFrame that sets ``scores`` (and may set
``latency_ms``, ``tokens``, ``parse_valid``). Expressions and lookups stay in the JVM; a model
is wrapped by ``batch_scorer``, which hands Arrow batches to a Python object that is made
once in each worker.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.canonical import same_value

Scorer = Callable[[DataFrame], DataFrame]


def lookup_scorer(table: DataFrame) -> Scorer:
    """Recorded probabilities (case_id, candidate, probability); a candidate without one fails the job."""

    def score(cases: DataFrame) -> DataFrame:
        maps = table.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("candidate", F.col("probability").cast("double")))).alias("_p"))
        joined = cases.join(maps, "case_id", "left")
        found = F.transform("candidates", lambda c: F.struct(c.alias("candidate"), F.coalesce(F.try_element_at("_p", c), F.raise_error(F.concat(F.lit("no score for "), c)).cast("double")).alias("probability")))
        return joined.withColumn("scores", found).drop("_p")

    return score


def rule_scorer(context: Column | str) -> Scorer:
    """The demonstration rules over ``intent`` of the context (JSON text): 0.9 for what its words point at.

    Where they point at nothing, or at no candidate, or there is only one, all candidates are alike.
    """
    text = F.lower(F.coalesce(F.get_json_object(context if isinstance(context, Column) else F.col(context), "$.intent"), F.lit("")))
    hint = F.when(text.contains("metric") | text.contains("cpu"), "read_metrics").when(text.contains("log") | text.contains("error"), "read_logs")

    def score(cases: DataFrame) -> DataFrame:
        k = F.size("candidates")
        known = F.coalesce(F.array_contains("candidates", hint), F.lit(False)) & (k > 1)
        share = lambda c: F.when(~known, 1.0 / k).when(c == hint, F.lit(0.9)).otherwise(0.1 / F.greatest(k - 1, F.lit(1)))
        return cases.withColumn("scores", F.transform("candidates", lambda c: F.struct(c.alias("candidate"), share(c).cast("double").alias("probability"))))

    return score


def logit_scorer(logits: str = "logits", alpha: float = 0.0, neutral: str | None = None) -> Scorer:
    """Softmax over recorded log-probabilities, less ``alpha`` times those of a neutral prompt."""

    def score(cases: DataFrame) -> DataFrame:
        values = S.prior_corrected(logits, neutral, alpha) if neutral else F.col(logits)
        return cases.withColumn("scores", S.candidate_softmax("candidates", values))

    return score


def structured_scorer(text: str = "text", *, strict: bool = False) -> Scorer:
    """Distributions from structured model text; what does not parse is uniform, or fails the job if strict."""

    def score(cases: DataFrame) -> DataFrame:
        parsed = cases.withColumn("_c", S.parse_choice(text, "candidates"))
        made = S.structured_choice("_c.candidate", "_c.confidence", "candidates")
        fallback = F.raise_error(F.lit("a structured choice does not parse")).cast("array<struct<candidate:string,probability:double>>") if strict else S.uniform("candidates")
        return parsed.withColumn("parse_valid", F.col("_c").isNotNull()).withColumn("scores", F.coalesce(made, fallback)).drop("_c")

    return score


def batch_scorer(make: Callable[[], object], columns: list[str], schema: str = "scores array<struct<candidate:string,probability:double>>, latency_ms double, tokens long, parse_valid boolean") -> Scorer:
    """A model: ``make()`` is called once in a worker and its result gets pandas batches of ``columns``.

    It returns a frame of the schema, row for row.
    """

    @F.pandas_udf(schema)
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield model(b)

    def score(cases: DataFrame) -> DataFrame:
        out = cases.withColumn("_s", scored(F.struct(*columns)))
        names = [part.split()[0] for part in ("scores latency_ms tokens parse_valid").split() if f"{part} " in schema]
        return out.withColumns({n: F.col(f"_s.{n}") for n in names}).drop("_s")

    return score


def request_key(decision_type: str = "decision_type", candidates: str = "candidates", context: str = "context") -> Column:
    """What makes two requests the same: type, candidates in their order, context whatever its spacing."""
    return F.sha2(F.to_json(F.struct(F.col(decision_type).alias("t"), F.col(candidates).alias("c"), same_value(context).alias("x"))), 256)


def cached(score: Scorer, key: Column | None = None) -> Scorer:
    """Score each distinct request once and give its result, latency and tokens to all its cases.

    The distinct requests are found by an aggregation that combines map-side; the join back is by key.
    """

    def run(cases: DataFrame) -> DataFrame:
        keyed = cases.withColumn("_key", request_key() if key is None else key)
        used = [c for c in cases.columns if c != "case_id"]
        once = keyed.groupBy("_key").agg(*[F.first(c).alias(c) for c in used])
        results = score(once)
        made = [c for c in results.columns if c not in used and c != "_key"]
        return keyed.join(results.select("_key", *made), "_key").drop("_key")

    return run


#: A calibrator turns the column of a distribution into that of another one.
Calibrator = Callable[[Column], Column]


def identity() -> Calibrator:
    """Scores as they are."""
    return lambda scores: scores


def temperature(t: float) -> Calibrator:
    return lambda scores: S.temperature_scaled(scores, t)


def calibrated(score: Scorer, by: float | Calibrator) -> Scorer:
    """The same scorer with scores that a calibrator (or a temperature) changed; latency and tokens are those of the scorer."""
    change = by if callable(by) else temperature(by)
    return lambda cases: score(cases).withColumn("scores", change(F.col("scores")))


class CandidateLogprobs:
    """A model for ``batch_scorer``: log-probabilities of the candidates as continuations of a prompt, softmaxed.

    ``logprobs(prompt, candidates)`` gives one number for each of a list of candidates; it is called
    for at most ``candidate_batch_size`` at a time, so memory does not grow with the candidates. With
    ``tokens(text)`` it also gives the tokens of a text: values are divided by a candidate's tokens if
    ``length_normalize``, and the tokens of prompts and candidates are counted.
    """

    def __init__(self, logprobs: Callable[[str, list[str]], list[float]], tokens: Callable[[str], list] | None = None, candidate_batch_size: int | None = None, length_normalize: bool = True):
        if candidate_batch_size is not None and candidate_batch_size <= 0:
            raise ValueError("a batch has at least one candidate")
        self.logprobs, self.tokens, self.size, self.normalize = logprobs, tokens, candidate_batch_size, length_normalize and tokens is not None

    def of(self, prompt: str, candidates: list[str]) -> tuple[list[float], int | None]:
        """Values of the candidates and the tokens that the model read."""
        if not candidates:
            raise ValueError("there are no candidates")
        lengths = [len(self.tokens(c)) for c in candidates] if self.tokens else None
        if lengths and not all(lengths):
            raise ValueError("a candidate has no tokens")
        step, values = self.size or len(candidates), []
        for a in range(0, len(candidates), step):
            part = candidates[a : a + step]
            found = list(self.logprobs(prompt, part))
            if len(found) != len(part):
                raise ValueError("the model gave another number of values than candidates")
            values += found
        if self.normalize:
            values = [v / n for v, n in zip(values, lengths)]
        return values, len(self.tokens(prompt)) * len(candidates) + sum(lengths) if self.tokens else None

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        """Scores, latency and tokens of the rows of (prompt, candidates)."""
        out = []
        for prompt, candidates in zip(batch["prompt"], batch["candidates"]):
            began = time.perf_counter()
            listed = list(candidates)
            values, tokens = self.of(prompt, listed)
            top = max(values)
            weights = [math.exp(v - top) for v in values]
            total = sum(weights)
            out.append(([{"candidate": c, "probability": w / total} for c, w in zip(listed, weights)], 1000 * (time.perf_counter() - began), tokens, None))
        return pd.DataFrame(out, columns=["scores", "latency_ms", "tokens", "parse_valid"])


class GeneratedChoice:
    """A model for ``batch_scorer``: text that is generated for a structured prompt, parsed to a choice.

    ``generate(prompt)`` gives (text, tokens); what does not parse gives equal scores and is not valid.
    """

    def __init__(self, generate: Callable[[str], tuple[str, int | None]]):
        self.generate = generate

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for prompt, candidates in zip(batch["prompt"], batch["candidates"]):
            began = time.perf_counter()
            text, tokens = self.generate(prompt)
            listed = list(candidates)
            scores = choice_scores(text, listed)
            out.append((scores or [{"candidate": c, "probability": 1 / len(listed)} for c in listed], 1000 * (time.perf_counter() - began), tokens, scores is not None))
        return pd.DataFrame(out, columns=["scores", "latency_ms", "tokens", "parse_valid"])


def choice_scores(text: str, candidates: list[str]) -> list[dict] | None:
    """What ``scores.parse_choice`` and ``structured_choice`` give, for one text in Python."""
    a, b = text.find("{"), text.rfind("}")
    try:
        said = json.loads(text[a : b + 1]) if 0 <= a < b else None
        chosen, confidence = str(said["candidate"]), float(said.get("confidence", 1.0))
    except (ValueError, TypeError, KeyError, AttributeError):
        return None
    if chosen not in candidates or not 0 <= confidence <= 1:
        return None
    k = len(candidates)
    share = 1 / k
    p = 1.0 if k == 1 else confidence if confidence > share else math.nextafter(share, 1)
    return [{"candidate": c, "probability": p if c == chosen else (1 - p) / (k - 1)} for c in candidates]


def with_priors(task: DataFrame, prior: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Cases (case_id, candidates, logits) with scores corrected by the neutral log-probability of each candidate.

    prior: prompt-independent rows (candidate, neutral), one for each; the correction is an
    equi-join by candidate, which Spark broadcasts if the rows are few. A candidate without prior
    fails the job.
    """
    if alpha < 0:
        raise ValueError("alpha must not be negative")
    spread = task.select("case_id", F.posexplode(F.arrays_zip("candidates", "logits")).alias("i", "x")).select("case_id", "i", F.col("x.candidates").alias("candidate"), F.col("x.logits").alias("logit"))
    found = spread.join(prior, "candidate", "left")
    value = F.col("logit") - F.lit(float(alpha)) * F.coalesce("neutral", F.raise_error(F.concat(F.lit("no prior for "), "candidate")).cast("double"))
    rows = found.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("i", "candidate", value.alias("v")))).alias("x"))
    return rows.select("case_id", F.transform("x", lambda e: e["candidate"]).alias("candidates"), S.candidate_softmax(F.transform("x", lambda e: e["candidate"]), F.transform("x", lambda e: e["v"])).alias("scores"))


# --- prompts ---------------------------------------------------------------------------------


def _part(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _context_lines(context: Column) -> Column:
    """The sorted context under its heading, each line ended; nothing for an empty one."""
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(context)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    return F.when(F.coalesce(F.size(context), F.lit(0)) > 0, F.concat(F.lit("Context:\n"), lines)).otherwise(F.lit(""))


# fixed texts of the prompts
CHOOSE, BEST = "Choose exactly one candidate:\n", "Best matching candidate: "
STRUCTURED = "Choose exactly one candidate from the allowed set. Return only one JSON object with candidate and confidence.\n"
FORMAT = 'Format: {"candidate":"<allowed>","confidence":0.0}\n'
NEUTRAL = "Context:\ntask_evidence: unavailable\n"


def _kind(decision_type: Column | str) -> Column:
    return F.concat(F.lit("Decision type: "), _part(decision_type), F.lit("\n"))


def default_prompt(decision_type: Column | str, candidates: Column | str, context: Column | str) -> Column:
    """Type, candidates and the sorted context (a map of strings)."""
    return F.concat(_kind(decision_type), F.lit("Candidates: "), F.array_join(_part(candidates), ", "), F.lit("\n"), _context_lines(_part(context)), F.lit(CHOOSE))


def compact_prompt(decision_type: Column | str, context: Column | str) -> Column:
    """Without the candidates, so that its length does not depend on their number."""
    return F.concat(_kind(decision_type), _context_lines(_part(context)), F.lit(BEST))


def neutral_prompt(decision_type: Column | str) -> Column:
    """Without request, for the prior of each candidate."""
    return F.concat(_kind(decision_type), F.lit(NEUTRAL), F.lit(BEST))


def structured_prompt(decision_type: Column | str, candidates: Column | str, context: Column | str) -> Column:
    """Asks for a JSON object with a choice and a confidence."""
    return F.concat(F.lit(STRUCTURED), _kind(decision_type), F.lit("Allowed candidates: "), F.array_join(_part(candidates), ", "), F.lit("\n"), _context_lines(_part(context)), F.lit(FORMAT))


def embedding_text(name: Column | str, server: Column | str, description: Column | str, upstream_name: Column | str | None = None, source_path: Column | str | None = None) -> Column:
    """What is embedded of a tool; parts that are empty or null are left out."""

    def line(label: str, x: Column | str | None) -> Column:
        return F.lit(None).cast("string") if x is None else F.concat(F.lit(f"{label}: "), F.nullif(_part(x), F.lit("")))

    named = [F.concat(F.lit("canonical_name: "), _part(name)), F.concat(F.lit("server: "), _part(server))]
    return F.concat_ws("\n", *named, line("upstream_tool_name", upstream_name), line("description", description), line("source_path", source_path))
