"""Stored judgments and what they were asked: known wordings, states built anew until a hash matches, orders of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import states


def with_form(judgments: DataFrame, forms: DataFrame) -> DataFrame:
    """judgments (function, bundle_sha256) with form and earlier of the wording that they were asked in, null if none is known.

    forms is the table of wording.form_table(), which is as small as the list of wordings and broadcast.
    """
    known = F.broadcast(forms.select("function", "bundle_sha256", "form", "earlier"))
    return judgments.join(known, ["function", "bundle_sha256"], "left")


def readable(judgments: DataFrame, forms: DataFrame, answers: list[str], earlier: bool = False) -> DataFrame:
    """with_form(), with answers only where they may be read: under a known wording, and an earlier one only if that is asked for."""
    found = with_form(judgments, forms)
    fine = F.col("form").isNotNull() & (F.lit(earlier) | ~F.coalesce("earlier", F.lit(True)))
    return found.withColumns({a: F.when(fine, F.col(a)) for a in answers})


def tried(rows: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """Each row once for each named state: place (the order of trying), variant, state (canonical JSON), state_sha256.

    Rows that give a null state have no such variant.
    """
    kinds = rows.select(*[v.alias(n) for n, v in variants.items()]).schema
    made = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("variant"), states.canonical_json(v, kinds[n].dataType).alias("state")) for i, (n, v) in enumerate(variants.items())]
    each = rows.select(*rows.columns, F.explode(F.array(*made)).alias("_v")).select(*rows.columns, "_v.*").filter(F.col("state").isNotNull())
    return each.withColumn("state_sha256", states.input_hash(F.col("state")))


def rebuilt(judgments: DataFrame, variants: DataFrame, on: list[str], key: str = "judgment") -> DataFrame:
    """judgments with variant and state of the first variant of their subject that has the stored hash; null if none has.

    judgments: key (unique), the columns `on`, state_sha256. variants: `on`, place, variant, state, state_sha256 (see tried).
    Both meet by subject and hash, so that no state is compared with another, and a subject's variants may be many.
    """
    same = judgments.select(key, *on, "state_sha256").join(variants.select(*on, "place", "variant", "state", "state_sha256"), [*on, "state_sha256"])
    first = same.groupBy(key).agg(F.min_by(F.struct("variant", "state"), "place").alias("_v")).select(key, "_v.*")
    return judgments.join(first, key, "left")


def share_rebuilt(found: DataFrame, by: list[str], of: str = "state") -> DataFrame:
    """by, hit, tried and share of judgments whose state was found."""
    counts = found.groupBy(*by).agg(F.count(of).alias("hit"), F.count("*").alias("tried"))
    return counts.withColumn("share", F.col("hit") / F.col("tried"))


def recovered_orders(judgments: DataFrame, recorded: DataFrame, versions: DataFrame, line: Column, source: Column, key: str = "judgment", bound: int = 10_000) -> DataFrame:
    """judgments with asked, the ids of the questions behind q0, q1, ... : as recorded, else of the version whose state matches.

    judgments: key (unique), day, n (questions asked), state_sha256, and what `line` and `source` read. recorded: day, n,
    asked. versions: place (the newest first), questions, a list of struct(id, title, brief, not). Only judgments without a
    record are tried, each against the versions of as many questions; versions, a file's history, are broadcast while they are
    at most `bound`.
    """
    listed = recorded.groupBy("day", "n").agg(F.first("asked").alias("_recorded"))
    known = judgments.join(listed, ["day", "n"], "left")
    small = versions.select("place", "questions", F.size("questions").alias("n"))
    small = F.broadcast(small) if small.limit(bound + 1).count() <= bound else small
    open_ = known.filter(F.col("_recorded").isNull()).join(small, "n")
    shown = states.with_json(open_, "_state", states.prefilter(line, F.col("questions"), source))
    match = shown.filter(states.input_hash(F.col("_state")) == F.col("state_sha256"))
    first = match.groupBy(key).agg(F.min_by(F.transform("questions", lambda q: q["id"]), "place").alias("_matched"))
    return known.join(first, key, "left").withColumn("asked", F.coalesce("_recorded", "_matched")).drop("_recorded", "_matched")


def judgment_id(function: Column, subjects: Column, model: Column, state_sha256: Column, bundle_sha256: Column) -> Column:
    """The id under which an answer is stored: all that it depends on."""
    parts = F.struct(bundle_sha256.alias("bundle"), function.alias("function"), model.alias("model"), state_sha256.alias("state"), subjects.alias("subjects"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def replayed(asks: DataFrame, stored: DataFrame, bundles: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(asks with judgment and answer where a stored one has them; what must still be asked, with how many asks wait for it).

    asks: ask (unique), function, subjects, state_sha256. stored: judgment (an id of judgment_id()), answer. bundles: function,
    place, bundle_sha256: the forms under which an answer counts, the first place before others; as many as there are
    wordings, broadcast. Asks of one function, subjects and state are one request, under the function's first form.
    """
    forms = F.broadcast(bundles.select("function", "place", "bundle_sha256"))
    ids = asks.join(forms, "function").withColumn("judgment", judgment_id(F.col("function"), F.col("subjects"), F.lit(model), F.col("state_sha256"), F.col("bundle_sha256")))
    hit = ids.select("ask", "place", "judgment").join(stored.select("judgment", "answer").dropDuplicates(["judgment"]), "judgment")
    first = hit.groupBy("ask").agg(F.min_by(F.struct("judgment", "answer"), "place").alias("r")).select("ask", "r.*")
    found = asks.join(first, "ask", "left")
    today = ids.groupBy("ask").agg(F.min_by("judgment", "place").alias("request"))
    open_ = found.filter(F.col("judgment").isNull()).select("ask", "function", "subjects", "state_sha256").join(today, "ask")
    return found, open_.groupBy("request").agg(*[F.min(c).alias(c) for c in ("function", "subjects", "state_sha256")], F.count("*").alias("waiting"))


def named_fetches(records: DataFrame, queries: DataFrame, days: DataFrame, net: str = "keyword") -> DataFrame:
    """records with the adapter and text of the query that each answered, null where none gives its key.

    records: input_sha256 and more. queries: adapter, text. days: day, those that records are of. A record's key is the hash
    of its adapter, net, text and day: the keys of all queries on all days are made, and meet records by the hash.
    """
    asked = queries.select("adapter", "text").distinct().crossJoin(F.broadcast(days.select("day").distinct()))  # a line's queries and days
    body = F.struct(F.col("adapter").alias("adapter"), F.lit(net).alias("net"), F.col("text").alias("query"), F.col("day").cast("string").alias("run_date"))
    keyed = states.with_json(asked, "_json", body).select(states.input_hash(F.col("_json")).alias("input_sha256"), F.col("adapter").alias("_adapter"), F.col("text").alias("_text"))
    known = records.select("input_sha256").distinct().join(keyed, "input_sha256")
    named = records.join(known, "input_sha256", "left")
    return named.select(*records.columns, F.col("_adapter").alias("adapter"), F.col("_text").alias("text"))
