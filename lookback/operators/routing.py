"""Rules that turn probabilities into decisions. Thresholds are arguments, so that another policy is another call."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import casefolded
from ..functions.probability import certainty


@dataclass(frozen=True)
class Policy:
    on_topic: float = 0.5
    evidence: float = 0.5
    injection: float = 0.5
    trust_report: float = 0.34
    trust_personal: float = 0.2
    gate_on_topic: float = 0.5
    gate_method: float = 0.3
    gate_evidence: float = 0.3
    keep: float = 0.6
    review_band: float = 0.1
    min_certainty: float = 0.5
    bears_on: float = 0.5
    checkable: float = 0.5
    novelty: float = 0.34
    support: float = 0.5
    bridge: float = 0.8

    def with_(self, **changes: float) -> Policy:
        """A policy of other values under the same names."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown or not all(isinstance(v, (int, float)) and abs(v) < float("inf") for v in changes.values()):
            raise ValueError(f"not thresholds: {sorted(unknown) or changes}")
        return replace(self, **changes)


def too_short(kind: Column, chars: Column) -> Column:
    """No text to judge: never for feeds, under 40 characters for repositories, else under 200."""
    return F.when(kind == "feed", F.lit(False)).when(kind == "github", chars < 40).otherwise(chars < 200)


def passing(p_on_topic: Column, policy: Policy) -> Column:
    """Places (from 0) of the questions whose probability passes."""
    return F.filter(F.transform(p_on_topic, lambda p, i: F.when(p >= policy.on_topic, i)), lambda i: i.isNotNull())


def prefilter(p_on_topic: Column, policy: Policy) -> Column:
    return F.struct((F.size(passing(p_on_topic, policy)) > 0).alias("accept"), F.array_max(p_on_topic).alias("score"))


def triage(evidence: Column, injection: Column, policy: Policy) -> Column:
    return F.struct(((evidence >= policy.evidence) & (injection < policy.injection)).alias("accept"), F.least(evidence, 1 - injection).alias("score"))


def trust(position: Column, level: Column, policy: Policy) -> Column:
    floor = F.when(level == "personal", F.lit(min(policy.trust_report, policy.trust_personal))).otherwise(F.lit(policy.trust_report))
    return F.struct((position >= floor).alias("accept"), position.alias("score"))


def weighted(overlap: Column, strength: Column, novelty: Column) -> Column:
    return 0.5 * overlap + 0.3 * strength + 0.2 * novelty


def gates(on_topic: Column, method: Column, evidence: Column, policy: Policy) -> Column:
    return (on_topic >= policy.gate_on_topic) & (method >= policy.gate_method) & (evidence >= policy.gate_evidence)


def route(short: Column, judged: Column, gates_pass: Column, score: Column, sure: Column, policy: Policy) -> Column:
    """incomplete, unjudged, keep, review or drop."""
    low, high = policy.keep - policy.review_band, policy.keep + policy.review_band
    return (
        F.when(short, "incomplete")
        .when(~judged, "unjudged")
        .when(~gates_pass | (score < low), "drop")
        .when(score >= high, "keep")
        .when((score < policy.keep) | (sure < policy.min_certainty), "review")
        .otherwise("keep")
    )


def review_distance(score: Column, policy: Policy) -> Column:
    return F.abs(score - policy.keep)


def detection(p_advances: Column, p_contradicts: Column, p_checkable: Column, policy: Policy) -> Column:
    bears = p_advances + p_contradicts
    accept = (bears >= policy.bears_on) & (p_checkable >= policy.checkable)
    return F.struct(accept.alias("accept"), F.least(bears, p_checkable).alias("score"), (p_contradicts > p_advances).alias("contradiction"))


def supported(source_text: Column, claim: Column, p_support: Column, policy: Policy) -> Column:
    """The claim's words are in the source, by folded case and whatever the white space, or the judged choice says so."""
    plain = lambda c: casefolded(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    return F.contains(plain(source_text), plain(claim)) | F.coalesce(p_support >= policy.support, F.lit(False))


def accept_screen(gates_pass: Column, score: Column, policy: Policy) -> Column:
    """The screening's own verdict: no band and no certainty, unlike route."""
    return F.struct((gates_pass & (score >= policy.keep)).alias("accept"), score.alias("score"))


def review_reason(score: Column, sure: Column, policy: Policy) -> Column:
    """borderline below the cut, else low-certainty."""
    return F.when(score < policy.keep, F.format_string("borderline %.2f < %.2f", score, F.lit(policy.keep))).otherwise(F.format_string("low certainty %.2f < %.2f", sure, F.lit(policy.min_certainty)))


def bridge(p: Column, policy: Policy) -> Column:
    return F.struct((p >= policy.bridge).alias("accept"), p.alias("score"))


def novelty_verdict(decisions: Column) -> Column:
    """novel, duplicate or unjudged from a claim's decisions for its questions: one rejection is a duplicate, none unjudged is novel."""
    return F.when(F.array_contains(decisions, "reject"), "duplicate").when(F.array_contains(decisions, "unjudged"), "unjudged").otherwise("novel")


def moved(position: Column, policy: Policy) -> Column:
    return F.struct((position >= policy.novelty).alias("accept"), position.alias("score"))


# Names of movements by level.
MOVEMENTS = ("none", "new_evidence_same_answer", "answer_changed")


def movement_name(level: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, MOVEMENTS)), (level + 1).cast("int"))


def floors_cleared(score: Column, levels: Column, policy: Policy) -> Column:
    """Places (from 0) of the questions, by their trust levels, whose floor a score clears."""
    places = F.transform(levels, lambda level, i: F.when(trust(score, level, policy)["accept"], i))
    return F.filter(places, lambda i: i.isNotNull())


def all_axes(*positions: Column, least: float = 0.5) -> Column:
    """Every axis reaches the threshold; the score is the least, null where one is missing."""
    there = F.greatest(*[p.isNull() for p in positions])
    low = F.when(~there, F.least(*positions))
    return F.struct((low >= least).alias("accept"), low.alias("score"))


def report_rubric(readability: Column, coherence: Column, unsupported: Column, least: float = 0.5, most: float = 0.7) -> Column:
    there = readability.isNotNull() & coherence.isNotNull() & unsupported.isNotNull()
    accept = (readability >= least) & (coherence >= least) & (unsupported < most)
    return F.struct(accept.alias("accept"), F.when(there, F.least(readability, coherence, 1 - unsupported)).alias("score"))


def fidelity(exceeds: Column, most: float = 0.7) -> Column:
    return F.struct((exceeds < most).alias("accept"), (1 - exceeds).alias("score"))


def health_reasons(run: dict[str, Column], unjudged_share: float = 0.5, failure_chars: int = 120) -> Column:
    """The reasons for which a line's run is degraded, most actionable first; none is healthy.

    run: writer_refused, failed_drafts (a list of what failed, in order), drafts, unverified, failed_pairs, pairs, questions, claims, review, cited,
    previous_cited (null: no earlier report), failed_fetches (a list), capped.
    """
    c = run
    share = F.try_divide(c["failed_pairs"], c["pairs"])
    asked = c["questions"] > 0
    listed = F.array(
        F.when(c["writer_refused"], F.lit("writer refused")),
        F.when(F.size(c["failed_drafts"]) > 0, F.format_string("prose failed %d/%d drafts (%s)", F.size(c["failed_drafts"]), c["drafts"], F.left(F.try_element_at(c["failed_drafts"], F.lit(1)), F.lit(failure_chars)))),
        F.when(c["unverified"] > 0, F.format_string("prose unverified (rubric judge failed) in %d section(s)", c["unverified"])),
        F.when(share >= unjudged_share, F.format_string("unjudged %d/%d pairs (%d%%)", c["failed_pairs"], c["pairs"], F.bround(share * 100).cast("int"))),
        F.when(asked & (c["claims"] == 0) & (c["review"] == 0), F.lit("empty note (no claim, no review)")),
        F.when(asked & (c["cited"] == 0) & (c["previous_cited"] == 0), F.lit("no citation 2 runs in a row")),
        F.when(F.size(c["failed_fetches"]) > 0, F.concat(F.lit("fetch failed: "), F.array_join(F.array_distinct(c["failed_fetches"]), ", "))),
        F.when(c["capped"], F.lit("cost cap reached (partial note)")),
    )
    return F.filter(listed, lambda r: r.isNotNull())


def decide(score: Column, accept: Column, failed: Column) -> Column:
    """accept, reject or unjudged; a failed or missing judgment is never an acceptance."""
    return F.when(failed | accept.isNull() | score.isNull(), "unjudged").when(accept, "accept").otherwise("reject")


def staged_outcome(p: DataFrame, policy: Policy, out: str) -> DataFrame:
    """Adds what a policy does with a pair: prefilter, safe, unasked, keep, review or drop.

    Reads on_topic, evidence, injection, trust, level, method, overlap, strength, novelty (null: not judged).
    """
    c = F.col
    score = weighted(c("overlap"), c("strength"), c("novelty"))
    screened = route(F.lit(False), score.isNotNull(), gates(c("on_topic"), c("method"), c("evidence"), policy), score, certainty(c("strength"), c("overlap")), policy)
    tri, tru = triage(c("evidence"), c("injection"), policy), trust(c("trust"), c("level"), policy)
    outcome = (
        F.when(c("on_topic").isNull(), "unasked")
        .when(c("on_topic") < policy.on_topic, "prefilter")
        .when(c("evidence").isNull() | c("injection").isNull(), "unasked")
        .when(~tri["accept"], "safe")
        .when(c("trust").isNull(), "unasked")
        .when(~tru["accept"], "safe")
        .when(score.isNull(), "unasked")
        .otherwise(screened)
    )
    return p.withColumn(out, outcome)
