"""Wordings of a judge's functions, the forms they were asked in, and the table of hashes that stored answers carry."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FORMS = "function string, bundle_sha256 string, form string, version string, earlier boolean"


@dataclass(frozen=True)
class Wording:
    """How a function is asked: all that its hash covers. wire: how the request is rendered; null in the oldest form."""

    function: str
    version: str
    instructions: str
    schema: dict[str, Any]
    levels: dict[str, list[str]] = field(default_factory=dict)
    wire: str | None = None

    @property
    def sha256(self) -> str:
        parts: dict[str, Any] = {"function": self.function, "version": self.version, "instructions": self.instructions, "schema": self.schema, "levels": self.levels}
        if self.wire is not None:
            parts["wire"] = self.wire
        return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def batched(self, subject: str, note: str) -> Wording:
        """The same questions about several subjects at once; note is added, with {subject} filled in."""
        each = self.instructions.replace(f"`{subject}`", f"every `{subject}s.sN`")
        return replace(self, version=f"{self.version}_batch", instructions=f"{each}\n\n{note.format(subject=subject)}")


def forms(today: Wording, wires: Sequence[str | None] = (), subject: str = "source", note: str = "", before: Iterable[Wording] = ()) -> list[tuple[str, str, str, str, bool]]:
    """(function, bundle_sha256, form, version, earlier) of all forms in which stored answers may have been asked.

    form is today, batched, legacy or legacy_batched (in one of the older `wires`); earlier marks those of the wordings
    `before`, which had the same questions. Where two give one hash, the first counts.
    """
    out: dict[str, tuple[str, str, str, str, bool]] = {}
    for wording, earlier in [(today, False), *((w, True) for w in before)]:
        for old, form in [(False, wording), *((True, replace(wording, wire=w)) for w in wires if w != wording.wire)]:
            for name, asked in (("", form), ("batched", form.batched(subject, note))):
                kind = "_".join(p for p in ("legacy" if old else "", name) if p) or "today"
                out.setdefault(asked.sha256, (wording.function, asked.sha256, kind, asked.version, earlier))
    return list(out.values())


def form_table(spark: SparkSession, listed: Iterable[tuple[str, str, str, str, bool]]) -> DataFrame:
    """The dimension of known forms: as many rows as wordings have forms."""
    return spark.createDataFrame(list(listed), FORMS)
