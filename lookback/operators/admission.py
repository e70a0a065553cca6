"""Which requests of a day go out, under budgets of nets, sources that have gone quiet and a cap of credits at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

#: Why a request is held back.
REASONS = ("quiet", "pool quiet", "budget", "credits")


def admitted(requests: DataFrame, group: list[str], order: str, budgets: dict[str, int], credits: int, quiet: frozenset[str] = frozenset()) -> DataFrame:
    """requests with held, why each is held back (null: it goes out).

    requests: group, order, net, adapter, cost (credits of the metered pool; 0: not metered), limited (whether its reply says
    that a rate limit is reached). In order: a request is held back if its net or net/adapter is quiet; if it is metered and
    the pool is quiet; if its net's budget is used up (nets without one send none); if it is metered and the credits are.
    One that is held back uses nothing up. One that goes out uses its net's budget and its credits, the last one perhaps
    more than is left, and if it is limited its net/adapter, or the pool if it is metered, is quiet from then on.

    What is held back follows from all that went before, so a group is one fold; its state is a count a net and the quiet
    sources. Groups lie one behind the other in a task, which holds one group's state. Rows of one group and order are taken
    by net and adapter.
    """
    rows = requests.repartition(*group).sortWithinPartitions(*group, order, "net", "adapter")
    at = {n: requests.columns.index(n) for n in ("net", "adapter", "cost", "limited", *group)}
    schema = rows.select("*").schema.add("held", "string")

    def run(batches):
        own, sent, spent, silent, pool = None, {}, 0, set(quiet), False
        for batch in batches:
            out = []
            column = lambda n: batch.column(at[n]).to_pylist()
            for key, net, adapter, cost, limited in zip(zip(*map(column, group)), *map(column, ("net", "adapter", "cost", "limited"))):
                if key != own:
                    own, sent, spent, silent, pool = key, {}, 0, set(quiet), False
                source, cost = f"{net}/{adapter}", cost or 0
                if net in silent or source in silent:
                    out.append("quiet")
                elif cost and pool:
                    out.append("pool quiet")
                elif sent.get(net, 0) >= budgets.get(net, 0):
                    out.append("budget")
                elif cost and spent >= credits:
                    out.append("credits")
                else:
                    out.append(None)
                    sent[net], spent = sent.get(net, 0) + 1, spent + cost
                    if limited and cost:
                        pool = True
                    elif limited:
                        silent.add(source)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "held"])

    return rows.mapInArrow(run, schema)
