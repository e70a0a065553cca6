"""Spelling variant grouping (operator 12): a self-join of the vocabulary's trie with active-node sets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Runs of letters, least code points and occurrences of a word, and how much more frequent its form is.
RUN, LEAST_LENGTH, LEAST_COUNT, TIMES = r"[A-Za-zÀ-ÿ]+", 6, 5, 5
#: One of so many occurrences loses a letter.
MISSPELT = 199
#: Words below one prefix (or above one suffix) that a task joins at once; more are dealt out by longer ones.
GROUP = 2_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["size", "start", "end", "prefix", "suffix"]


def misspelt(run: Column, doc_id: Column, rate: int = MISSPELT) -> Column:
    """The run without its code point crc32('<doc_id>:<run>') % length, where rate divides that crc32; else the run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % rate == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the runs of letters of all whole texts, A-Z lower-cased, some misspelt, that are long and frequent enough.

    Null texts have none; a null doc_id counts as the empty text. Occurrences are summed up in each task before they are
    shuffled.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    lowered = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    found = lowered.select(misspelt(F.col("run"), F.col("doc_id")).alias("word")).filter(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def placed(words: DataFrame) -> DataFrame:
    """Each word in two halves of two sizes: as a word of its own size, and as one that lacks a letter of the next.

    A pair's longer word has `size` letters, and the letter that differs is in one half of it: then the words have the
    other half in common, as prefix (the trie of words read forwards) or as suffix (the trie of words read backwards).
    """
    m = F.length("word")
    sized = words.select("word", "n", F.explode(F.array(m, m + 1)).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("start"), half.alias("end")), F.struct(half.alias("start"), F.col("size").alias("end"))))
    return sized.select("word", "n", "size", ends.alias("w")).select("word", "n", "size", "w.start", "w.end")


def keyed(windows: DataFrame) -> DataFrame:
    """With the letters before and behind the window [start, end) of the size; a word that lacks one has it in the window."""
    tail = F.col("size") - F.col("end")
    prefix = F.substring(F.col("word"), F.lit(1), F.col("start"))
    suffix = F.substring(F.col("word"), F.length("word") - tail + 1, tail)
    return windows.select("word", "n", "size", "start", "end", prefix.alias("prefix"), suffix.alias("suffix"))


def partitions(words: DataFrame, most: int = GROUP) -> DataFrame:
    """Every word in its partitions of the tries, none of which has more than `most` words unless its window is one letter.

    A partition with more words is dealt out again by the two halves of its window, those in which the first half is
    common and those in which the second is. At one letter it has no more words than there are letters.
    """
    out, rows = None, shared.materialize(keyed(placed(words)), "trie-partitions")
    while True:
        large = shared.materialize(rows.groupBy(*KEY).agg(F.count("*").alias("_n")).filter((F.col("_n") > most) & (F.col("end") - F.col("start") > 1)).drop("_n"), "large-partitions")
        if large.isEmpty():
            return rows if out is None else out.unionByName(rows)
        small = rows.join(large, KEY, "left_anti")
        out = small if out is None else out.unionByName(small)
        middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("start"), middle.alias("end")), F.struct(middle.alias("start"), F.col("end"))))
        again = rows.join(large, KEY, "left_semi").select("word", "n", "size", halves.alias("w"))
        rows = shared.materialize(keyed(again.select("word", "n", "size", "w.start", "w.end")), "trie-partitions")


class Trie:
    """Nodes by number: children by letter, and the entry that ends there (or -1)."""

    def __init__(self, strings: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.entry = [-1]
        for k, s in enumerate(strings):
            node = 0
            for c in s:
                below = self.children[node].get(c)
                if below is None:
                    below = self.children[node][c] = len(self.entry)
                    self.children.append({})
                    self.entry.append(-1)
                node = below
            self.entry[node] = k

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of entries at edit distance one, the first one smaller.

        Each node carries its active nodes, those whose strings are at distance one (only the node itself is at none). A
        child's are: its parent (a letter deleted), its siblings (replaced), its own children (inserted), and what its
        letter leads to from its parent's active nodes.
        """
        children, entry = self.children, self.entry
        open_ = [(0, list(children[0].values()))]
        while open_:
            node, active = open_.pop()
            own = entry[node]
            if own >= 0:
                for other in active:
                    if entry[other] > own:
                        yield own, entry[other]
            for letter, child in children[node].items():
                found = {node, *children[child].values()}
                found.update(s for s in children[node].values() if s != child)
                found.update(children[a][letter] for a in active if letter in children[a])
                found.discard(child)
                if found:
                    open_.append((child, list(found)))


def joined(words: list[tuple[str, int]], size: int, start: int, end: int) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, near word, its n), both ways, of one partition's pairs whose longer word has `size` letters.

    A letter left out of a run of equal ones could be any of them: it counts as the last, so that a pair is found in one
    partition alone.
    """
    if len(words) < 2:
        return
    cut = [w[start : end - size + len(w)] for w, _ in words]
    # a short word's window may equal the beginning of a long one's, never a whole one: strings are unique by their length
    for i, j in Trie(cut).pairs():
        (a, n), (b, k) = words[i], words[j]
        if len(a) != len(b):
            long, short, behind = (a, cut[j], end) if len(a) > len(b) else (b, cut[i], end)
            if long[start : behind - 1] == short and behind < size and long[behind] == long[behind - 1]:
                continue
        elif len(a) != size:
            continue
        yield a, n, b, k
        yield b, k, a, n


def near_pairs(words: DataFrame, most: int = GROUP) -> DataFrame:
    """word, n, near, near_n: all pairs of words at edit distance one, both ways, each once.

    Partitions lie one behind the other in a task, which holds one of them at a time.
    """
    rows = partitions(words, most).repartition(*[F.col(k) for k in KEY]).sortWithinPartitions(*KEY).select("size", "start", "end", "prefix", "suffix", "word", "n")

    def run(batches):
        key, held, out = None, [], []

        def table() -> pa.RecordBatch:
            columns = zip(*out) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n", "near", "near_n"])

        for batch in batches:
            for size, start, end, prefix, suffix, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                if (size, start, end, prefix, suffix) != key:
                    if key is not None:
                        out.extend(joined(held, *key[:3]))
                    key, held = (size, start, end, prefix, suffix), []
                held.append((word, n))
                if len(out) >= 20_000:
                    yield table()
                    out = []
        if key is not None:
            out.extend(joined(held, *key[:3]))
        yield table()

    return rows.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for every row (word, form): the end of the chain of forms.

    Every round doubles how far a word looks. As a form is more frequent than its word by a factor, chains are short.
    """
    jumps = shared.materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        found = shared.materialize(jumps.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "roots")
        jumps = found.select("word", "root")
        if found.filter("_moved").isEmpty():
            return jumps


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, most: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of all long and frequent words of the whole texts.

    Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form is its most frequent
    near word (ties: the first in code-point order), if that is `times` as frequent, else null. Its root is the end of the
    chain of forms, the word itself where there is none. Null and empty texts have no words, copies of a text and rows that
    repeat a doc_id count each, a null doc_id counts as the empty text, an empty table gives an empty one, and other
    columns are not read. A word may be as long as a text: a partition holds whole words.
    """
    words = shared.materialize(vocabulary(docs, least_length, least_count), "vocabulary")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    every = near_pairs(words, most).unionByName(alone).groupBy("word", "n").agg(F.count("near").alias("n_near"), F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    formed = shared.materialize(every.select("word", "n", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    found = formed.join(roots(formed.filter("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))


#: crc32 goes by a table of 256 entries that is made here by the rule of the polynomial.
OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT)] || CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, k, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(len(x) // 2), lambda j: CAST('0x' || substr(x, CAST(2 * j + 1 AS INTEGER), 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h FROM d, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON x.cut = v.word
  UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON x.cut = v.word),
g AS (SELECT word, n, count(*) AS n_near, min({'a': -near_n, 'b': near}) AS best FROM p GROUP BY word, n),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 5 * v.n THEN best.b END AS form, CASE WHEN -best.a >= 5 * v.n THEN -best.a END AS form_n FROM v LEFT JOIN g USING (word)),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.at AS root FROM c JOIN f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN e USING (word)
"""
