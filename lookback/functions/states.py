"""What a judge was shown, as nested values, and their canonical JSON, by whose hash a stored answer names them.

Field names are fixed values: a state that is built anew must give the hash that was stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .keys import excerpt

#: Control characters whose escape has a letter: JSON writers differ in its case.
_LETTERED = [f"{c:04x}" for c in range(32) if any(x in "abcdef" for x in f"{c:04x}")]


def _ordered(value: Column, kind: DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in code-point order, at every depth."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        inner = F.struct(*[_ordered(value.getField(f.name), f.dataType).alias(f.name) for f in fields]) if fields else value
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, MapType):
        names = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(names, F.transform(names, lambda k: _ordered(F.element_at(value, k), kind.valueType)))
    return value


def canonical_json(value: Column, kind: DataType) -> Column:
    """Compact JSON of a value of that type: keys in order at every depth, nulls written, no letter escaped that needn't be.

    Fractions are written as Spark writes them; states hold texts, whole numbers, booleans, lists and objects.
    """
    text = F.to_json(_ordered(value, kind), {"ignoreNullFields": "false"})

    def lowered(t: Column) -> Column:
        for code in _LETTERED:
            t = F.regexp_replace(t, rf"(?<!\\)((?:\\\\)*)\\u{code[:2]}{code[2:].upper()}", rf"$1\\u{code}")
        return t

    # as an array's element the text is one value, however often it is read
    return F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("\\u00")), lowered(t)).otherwise(t))[0]


def with_json(df: DataFrame, out: str, value: Column) -> DataFrame:
    """df with the canonical JSON of a struct, list or map as column `out`."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    return df.withColumn(out, canonical_json(value, kind))


def input_hash(json: Column) -> Column:
    return F.sha2(json, 256)


# parts of states


def line(name: Column, vocabulary: Column) -> Column:
    return F.struct(name.alias("name"), vocabulary.alias("vocabulary"))


def source(title: Column, url: Column, adapter: Column, published: Column, text: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """The view of a source with an excerpt around a place (the start, where none is given); published is a date or null."""
    none = F.lit(None).cast("int")
    shown = excerpt(text, none if start is None else start, none if end is None else end)
    return F.struct(title.alias("title"), url.alias("url"), adapter.alias("adapter"), published.cast("string").alias("published"), shown.alias("excerpt"))


def full_source(title: Column, url: Column, adapter: Column, text: Column) -> Column:
    return F.struct(title.alias("title"), url.alias("url"), adapter.alias("adapter"), text.alias("text"))


def question(title: Column, brief: Column) -> Column:
    return F.struct(title.alias("title"), brief.alias("brief"))


# the state of each function of the judge


def prefilter(line: Column, questions: Column, source: Column) -> Column:
    """questions: an ordered list of struct(title, brief, not); they are asked as q0, q1, ..."""
    names = F.transform(questions, lambda q, i: F.concat(F.lit("q"), i.cast("string")))
    shown = F.transform(questions, lambda q: F.struct(q["title"].alias("title"), q["brief"].alias("brief"), q["not"].alias("not")))
    return F.struct(line.alias("line"), F.map_from_arrays(names, shown).alias("questions"), source.alias("source"))


def triage(line: Column, full_source: Column) -> Column:
    return F.struct(line.alias("line"), full_source.alias("source"))


def trust(source: Column) -> Column:
    return F.struct(source.alias("source"))


def screening(line: Column, question: Column, source: Column, evidence: Column) -> Column:
    """question: struct(title, brief, method, evidence, not)."""
    return F.struct(line.alias("line"), question.alias("question"), source.alias("source"), evidence.alias("evidence_set"))


def detection(question: Column, unit: Column, title: Column) -> Column:
    return F.struct(question.alias("question"), F.struct(unit.alias("text"), title.alias("source_title")).alias("unit"))


def novelty(question: Column, claim: Column, evidence: Column) -> Column:
    return F.struct(question.alias("question"), claim.alias("claim"), evidence.alias("evidence_set"))


def support(claim: Column, source: Column) -> Column:
    """source: the view around the place where the claim's longest words first occur."""
    return F.struct(claim.alias("claim"), source.alias("source"))


def movement(question: Column, today: Column, evidence: Column) -> Column:
    return F.struct(question.alias("question"), today.alias("today"), evidence.alias("evidence_set"))


def claim_rubric(line: Column, claim: Column, source: Column, context: Column, similar: Column) -> Column:
    return F.struct(line.alias("line"), claim.alias("claim"), source.alias("source"), context.alias("report_context"), similar.alias("stored_similar"))


def report_rubric(line: Column, prose: Column, claims: Column, known: Column | None = None) -> Column:
    """known, the question's evidence, is only part of a state that has some."""
    fields = [line.alias("line"), prose.alias("prose"), claims.alias("claims")]
    return F.struct(*fields, *([] if known is None else [known.alias("known")]))


def fidelity(title: Column, paragraph: Column, claims: Column) -> Column:
    return F.struct(title.alias("question"), paragraph.alias("paragraph"), claims.alias("claims"))


def ordering(line: Column, claim: Column) -> Column:
    return F.struct(line.alias("line"), claim.alias("claim"))
