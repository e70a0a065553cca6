"""Scoring texts by a probabilistic suffix tree over words (operator 5), beside a unigram base."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The most frequent words are symbols of their own; as next symbols all others share OTHER, within which the root tells
#: them apart. In contexts every word stands for itself. STOP fills a context beyond its end: it ends at the start of its
#: text and where it is known to occur less than LEAST times.
SYMBOLS = 4_096
OTHER, END, START, STOP = range(SYMBOLS, SYMBOLS + 4)
BASE = SYMBOLS + 4
#: Longest context in symbols. One is tested if it occurs LEAST times, the fewest from which one can be left out.
DEPTH, LEAST = 5, 2
#: A context is kept if it foretells its own next symbols, each left out in turn, by so many nats better than the longest
#: kept context within it.
DIVERGENCE = 8.0
#: Contexts that occur so often, and as a share of all tokens, are counted apart and their rows sent to every task: at
#: most 1 / HOT_SHARE of each length.
HOT, HOT_SHARE = 1_000_000, 1 / 4_096
#: Tokens of one bucket of contexts, least buckets, tokens that a task reads at once, and bits of a group of documents.
BUCKET, BUCKETS, CHUNK, GROUP_BITS = 500_000, 128, 700_000, 12
#: Tokens go to their buckets in so many shares, by the word before; a share's shuffle files are deleted before the next one's.
SHARES = 3
#: Most frequent words, whose counts every task has; the counts of others come by a join.
HEAD = 200_000
#: Words whose numbers a worker keeps. Speed only.
KEEP = 250_000

_ZSTD = pa.Codec("zstd", compression_level=1)
_TINY = 1e-300


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; bytes split at [\\x20\\x09-\\x0D] and know no other case."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes) and n: how often each word occurs in all the documents."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens_of(text))
                if len(counts) > 500_000:
                    yield out()
                    counts = Counter()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Root:
    """Word counts with absolute discounting. What the counts leave is shared alike by the words that training lacks, of which
    there are `unseen` by estimate."""

    def __init__(self, tokens: int, distinct: int, ends: int, discount: float, head: dict[bytes, int], symbols: int, unseen: float = 1.0, whole: bool = True) -> None:
        self.tokens, self.distinct, self.ends, self.discount, self.head, self.unseen = tokens, distinct, ends, discount, head, unseen
        self.whole, self.beyond = whole, whole and min(head.values(), default=0) >= LEAST  # words beyond the head occur at most as often as its last
        top = list(head)[:symbols]
        self.symbols = {w: k for k, w in enumerate(top)}
        p = np.zeros(BASE)
        p[: len(top)] = [self.share(head[w]) for w in top]
        p[END] = self.share(ends)
        p[OTHER] = max(_TINY, 1.0 - p.sum()) if tokens else 1.0
        self.p = p

    def share(self, n: int) -> float:
        return ((n - self.discount) if n else self.discount * self.distinct / self.unseen) / self.tokens if self.tokens else 1.0

    def base(self, n: int) -> float:
        return math.log10((n + 1) / (self.tokens + self.distinct + 1))

    def inner(self, n: int) -> float:
        """log10 of the share that a word which occurs n times has of OTHER."""
        return math.log10(self.share(n) / self.p[OTHER])

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """inner and base of each word of the head."""
        different = {n: (self.inner(n), self.base(n)) for n in set(self.head.values())}
        both = np.array([different[n] for n in self.head.values()]).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def beyond_head(self, word: bytes) -> int:
        """What stands for a word beyond the head in contexts: 63 bits of a hash; STOP where none occurs LEAST times, as no
        context with it can be kept. For an OTHER word of the head it is its place."""
        return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | 1 << 63 if self.beyond else STOP


def learn_root(words: DataFrame, ends: int, head: int, symbols: int, whole: bool) -> Root:
    once = lambda k: F.coalesce(F.sum((F.col("n") == k).cast("long")), F.lit(0))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), once(1).alias("n1"), once(2).alias("n2")).first()
    discount = min(0.9, max(0.1, sums["n1"] / (sums["n1"] + 2 * sums["n2"]) if sums["n1"] else 0.5))
    # Chao's estimate of how many words there are beside those that occur, from those that occur once and twice
    unseen = max(1.0, sums["n1"] * (sums["n1"] - 1) / (2 * (sums["n2"] + 1)))
    top = words.orderBy(F.desc("n"), "word").limit(head).toArrow()
    known = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist()))
    return Root(sums["n"] + ends, sums["v"] + (ends > 0), ends, discount, known, symbols, unseen, whole)


class Numbers(dict):
    """Word to its number; by number its symbol, what stands for it in contexts if that is OTHER, what it adds to scores by
    itself, and whether its count is at hand."""

    def __init__(self, root: Root, places: dict[bytes, int]) -> None:
        self.root, self.places, self.missing, self.word = root, places, [], np.zeros(0, np.uint64)
        self.symbol, self.inner, self.base, self.at_hand = np.zeros(0, np.uint16), np.zeros(0), np.zeros(0), np.zeros(0, bool)
        self.counts, (self.inners, self.bases) = np.fromiter(root.head.values(), np.int64, len(root.head)), root.logs()

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.symbol) + len(self.missing)
        self.missing.append(word)
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.missing:
            r = self.root
            place = np.array([self.places.get(w, -1) for w in self.missing])
            known, other = place >= 0, (place < 0) | (place >= len(r.symbols))
            word, inner, base = np.zeros(len(place), np.uint64), np.zeros(len(place)), np.zeros(len(place))
            for i in np.flatnonzero(~known):
                word[i] = r.beyond_head(self.missing[i])
            at, base[known] = known & other, self.bases[place[known]]
            word[at] = np.where(r.whole & (self.counts[place[at]] >= LEAST), BASE + place[at], STOP)
            inner[at] = self.inners[place[at]]
            for name, more in (("symbol", np.where(other, OTHER, place).astype(np.uint16)), ("word", word), ("inner", inner), ("base", base), ("at_hand", known)):
                setattr(self, name, np.concatenate([getattr(self, name), more]))
            self.missing = []
        return ids


def read_symbols(docs: DataFrame, learns: Column, root: Root) -> DataFrame:
    """By row: its symbols (2 bytes each, END last), what stands for its OTHER words in contexts, scores and known words as
    far as the head's counts go, the other words.

    Rows are numbered by partition and place: write the result down before using it twice.
    """
    sent = docs.sparkSession.sparkContext.broadcast(root)
    names = ["row", "doc_id", "learns", "n_tokens", "n_known", "base_score", "inner", "rest", "symbols", "words"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.binary(), pa.binary()]

    def run(batches):
        r = sent.value
        places = {w: k for k, w in enumerate(r.head)}
        numbers, row = Numbers(r, places), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in shared.slices([t or "" for t in texts], 1_000_000):
                if len(numbers) > KEEP:
                    numbers = Numbers(r, places)
                found = [tokens_of(t) for t in texts[a:b]]
                flat = [w for ws in found for w in ws]
                ids = numbers.of(flat)
                lengths = np.array([len(w) for w in found])
                owner = np.repeat(np.arange(len(found)), lengths)
                known = numbers.at_hand[ids]
                rest: list[list[bytes]] = [[] for _ in found]
                for i in np.flatnonzero(~known):
                    rest[owner[i]].append(flat[i])
                ends = np.cumsum(lengths)
                symbols = np.insert(numbers.symbol[ids], ends, END) if len(found) else numbers.symbol[ids]
                stops = np.cumsum(lengths + 1)
                others = numbers.symbol[ids] == OTHER
                word = np.split(numbers.word[ids[others]], np.cumsum(np.bincount(owner[others], minlength=len(found)))[:-1])
                columns = [
                    np.arange(row, row + len(found)), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lengths + 1,
                    np.bincount(owner, known, len(found)).astype(np.int64) + (r.ends > 0), np.bincount(owner, numbers.base[ids], len(found)) + r.base(r.ends),
                    np.bincount(owner, numbers.inner[ids], len(found)), rest, [symbols[e - n : e].astype("<u2").tobytes() for e, n in zip(stops, lengths + 1)],
                    [packed(w) for w in word],
                ]
                row += len(found)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    schema = "row long, doc_id long, learns boolean, n_tokens long, n_known long, base_score double, inner double, rest array<binary>, symbols binary, words binary"
    return docs.select("doc_id", F.coalesce(learns, F.lit(False)).alias("learns"), "text").mapInArrow(run, schema)


def windows(words: np.ndarray, lengths: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """The contexts of the words of texts that lie one behind the other, or of those at some places, one in each column: the
    word before it, the one before that, and so on; STOP from where a context ends."""
    back = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at, back = (np.arange(len(words)), back) if at is None else (at, back[at])
    out, open_ = np.empty((depth, len(at)), words.dtype), np.ones(len(at), bool)
    for k in range(depth):
        before = np.where(back > k, words[np.maximum(at - k - 1, 0)], np.where(back == k, START, STOP).astype(words.dtype))
        open_ &= before != STOP
        out[k] = np.where(open_, before, STOP)
    return out


def code_of(context: np.ndarray) -> np.ndarray:
    """Contexts as far as they consist of symbols, as a number: the symbol before is the highest digit."""
    code, open_ = np.zeros(context.shape[1], np.int64), np.ones(context.shape[1], bool)
    for word in context:
        open_ &= (word < BASE) & (word != STOP)
        code = code * BASE + np.where(open_, word, STOP).astype(np.int64)
    return code


class Tree:
    """The part of the tree that every task has: all contexts of one symbol, and longer ones that are hot.

    levels[k] has the hot contexts of k + 2 symbols: their codes in order, kept or not, what they leave, how often they
    occur; and by (place of the context, next symbol) how often that follows.
    """

    def __init__(self, root: np.ndarray, discount: float, depth: int) -> None:
        self.root, self.discount, self.depth = root, discount, depth
        self.add_keys, self.add, self.left, self.often = np.zeros(0, np.int64), np.zeros(0), np.ones(BASE), np.zeros(0, np.int64)
        self.levels: list[tuple] = []
        self._first = self._often = None

    def first_level(self, keys: np.ndarray, n: np.ndarray) -> None:
        """keys: context symbol * BASE + next symbol."""
        context, symbol = keys // BASE, keys % BASE
        kept, left, total = tested(context, n, self.root[symbol], BASE, self.discount)
        self.left = np.where(kept, left, 1.0)
        mine = kept[context]
        self.add_keys, self.add = keys[mine].astype(np.int32), (n[mine] - self.discount) / total[context[mine]]
        self.often = keys[n >= LEAST].astype(np.int32)

    def ready(self) -> None:
        if self._first is None:
            table = np.multiply.outer(self.left.astype(np.float32), self.root.astype(np.float32)).ravel()
            table[self.add_keys] += self.add.astype(np.float32)
            self._first, self._often = table, np.zeros(BASE * BASE, bool)
            self._often[self.often] = True

    def probability(self, code: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each next symbol in the longest kept context of the part at hand, and how many symbols of its context are at hand."""
        self.ready()
        one = code // BASE ** (self.depth - 1)
        level = (one != STOP).astype(np.int8)
        p = np.where(level > 0, self._first[one * BASE + symbol], self.root[symbol]).astype(np.float64)
        for k, (codes, kept, left, total, keys, n) in enumerate(self.levels):
            at = np.flatnonzero(level == k + 1)
            j, there = within(codes, code[at] // BASE ** (self.depth - k - 2))
            at, j = at[there], j[there]
            level[at] = k + 2
            at, j = at[kept[j]], j[kept[j]]
            i, seen = within(keys, j * BASE + symbol[at])
            p[at] = p[at] * left[j] + np.where(seen, (n[np.where(seen, i, 0)] - self.discount) / total[j], 0.0)
        return p, level

    def shortened(self, context: np.ndarray) -> np.ndarray:
        """Contexts up to where two symbols follow one another less than LEAST times: none that goes on can be kept."""
        self.ready()
        open_ = np.ones(context.shape[1], bool)
        for one, two in zip(context, context[1:]):
            at = np.flatnonzero((one < BASE) & (two < BASE) & (one != STOP) & (two != STOP))
            open_[at] &= self._often[two[at].astype(np.int64) * BASE + one[at].astype(np.int64)]
            two[~open_] = STOP
        return context


def within(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values would be in sorted_values, and whether they are there."""
    if not len(sorted_values):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    k = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return k, sorted_values[k] == values


def tested(context: np.ndarray, n: np.ndarray, above: np.ndarray, contexts: int, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By context: kept or not, what it leaves to the shorter one, how often it occurs.

    Rows are different next symbols of contexts with their numbers of occurrences and their probability in the longest
    kept context within. A context's divergence is the sum over its occurrences of log(p without that occurrence / that
    probability): an occurrence that is the only one of its symbol counts against the context.
    """
    total = np.bincount(context, n, contexts)
    kinds = np.bincount(context, n > 0, contexts)
    one_less = np.maximum(total - 1, 1)[context]
    without = np.where(n > 1, n - 1 - discount, 0.0) / one_less + discount * (kinds[context] - (n == 1)) / one_less * above
    gain = np.where(n > 0, n * np.log(np.maximum(without, 1e-30) / np.maximum(above, _TINY)), 0.0)
    kept = (total >= LEAST) & (np.bincount(context, gain, contexts) >= DIVERGENCE)
    return kept, discount * kinds / np.maximum(total, 1), np.maximum(total, 1)


def grown(code: np.ndarray, symbol: np.ndarray, learns: np.ndarray, tree: Tree, context: np.ndarray | None = None) -> np.ndarray:
    """log10 p of each symbol behind its context, by a tree grown from those that are learned.

    Contexts are given by windows(), or by code alone where all their words are symbols. All occurrences of the contexts
    that are one word longer than what the tree has must be here.
    """
    if not len(code):
        return np.zeros(0)
    if context is None:
        context = np.stack([code // BASE ** (tree.depth - 1 - k) % BASE for k in range(tree.depth)])
    p, level = tree.probability(code, symbol)
    words, hashed = context.astype(np.int64), context.astype(np.uint64) >> np.uint64(63) > 0
    width = int(words.max()) + 1  # hashes of words are negative here, and get the numbers that follow
    different, number = np.unique(words[hashed], return_inverse=True)
    words[hashed], width = width + number, width + len(different)
    at, place = np.arange(len(code)), np.zeros(len(code), np.int64)
    for size in range(1, tree.depth + 1):
        word = words[size - 1, at]
        at, place, word = (x[word != STOP] for x in (at, place, word))
        if not len(at):
            break
        place = np.unique(place * width + word, return_inverse=True)[1]
        often, waits = np.bincount(place, learns[at])[place] >= LEAST, level[at] >= size  # what the tree has is waited for
        own, mine = at[often & ~waits], place[often & ~waits]
        if len(own):
            kinds, where = np.unique(mine * BASE + symbol[own], return_inverse=True)
            mine, count, above = kinds // BASE, np.bincount(where, learns[own]), np.empty(len(kinds))
            above[where] = p[own]
            kept, left, total = tested(mine, count, above, int(mine[-1]) + 1, tree.discount)
            p[own] = np.where(kept[mine], np.maximum(count - tree.discount, 0.0) / total[mine] + left[mine] * above, above)[where]
        at, place = at[often | waits], place[often | waits]
    return np.log10(np.maximum(p, _TINY))


def packed(a: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True) if raw else b""


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def chunks(batches):
    """(row, learns, symbols, words) of about CHUNK tokens at a time."""
    held, size = [], 0
    for batch in batches:
        for item in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(item)
            size += len(item[2]) // 2
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def as_arrays(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, learns, raw = list(zip(*held))[:3]
    return np.array(rows, np.int64), np.array(learns, bool), np.frombuffer(b"".join(raw), "<u2"), np.array([len(x) // 2 for x in raw])


def whole_words(held: list, symbols: np.ndarray) -> np.ndarray:
    """What stands for each word in contexts."""
    words = symbols.astype(np.uint64)
    words[symbols == OTHER] = np.concatenate([unpacked(item[3], "<u8") for item in held])
    return words


def next_counts(first: DataFrame, codes: np.ndarray | None, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the context * BASE + next symbol) and its number, in order: of all contexts of one symbol, or of those in codes."""
    size = 1 if codes is None else depth
    sent = first.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        for held in chunks(batches):
            _, _, symbols, lengths = as_arrays(held)
            code = code_of(windows(np.where(symbols == OTHER, np.uint16(STOP), symbols), lengths, size))
            k, there = (code, code != STOP) if sent.value is None else within(sent.value, code)
            keys, n = np.unique((k * BASE + symbols)[there], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    counted = first.filter("learns").select("row", "learns", "symbols").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # at most BASE rows a context
    keys, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def learn_tree(first: DataFrame, root: Root, depth: int, hot: int) -> Tree:
    """The tree's part for every task: contexts of one symbol, then, length by length, the hot ones."""
    tree = Tree(root.p, root.discount, depth)
    least = max(hot, int(root.tokens * HOT_SHARE))
    keys, n = next_counts(first, None, depth)
    tree.first_level(keys, n)
    codes = np.arange(BASE)
    for size in range(2, depth + 1):
        # a hot context of this length is one of the length before and a symbol that often follows it
        fits = (n >= least) & (keys % BASE != OTHER) & (keys % BASE != END)
        codes = np.sort(keys[fits] % BASE * BASE ** (size - 1) + codes[keys[fits] // BASE])
        if not len(codes):
            break
        keys, n = next_counts(first, codes, size)
        context, symbol = keys // BASE, keys % BASE
        padded = codes[context]
        for _ in range(depth - size):
            padded = padded * BASE + STOP
        kept, left, total = tested(context, n, tree.probability(padded, symbol)[0], len(codes), root.discount)
        tree.levels.append((codes, kept, left, total, keys, n))
    tree._first = tree._often = None
    return tree


def share_of(word: np.ndarray, shares: int) -> np.ndarray:
    """The share that tokens behind a word are in; its hash has nothing to do with that of buckets."""
    return (word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(shares)


def routed(first: DataFrame, tree: Tree, buckets: int, share: int = 0, shares: int = 1) -> DataFrame:
    """bucket, a group of rows, and a block: a share's tokens whose context goes on beyond the tree at hand, dealt by its next
    longer context; and, with any bucket, the sums by row of log10 p of the share's others."""
    sent = first.sparkSession.sparkContext.broadcast(tree)
    names = ["bucket", "row", "sums", "code", "rare", "symbol", "place"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches):
        t = sent.value
        for held in chunks(batches):
            rows, learns, symbols, lengths = as_arrays(held)
            words = whole_words(held, symbols)
            own = np.flatnonzero(share_of(windows(words, lengths, 1)[0], shares) == share)
            context, owner, symbols = t.shortened(windows(words, lengths, t.depth, own)), np.repeat(np.arange(len(rows)), lengths)[own], symbols[own]
            p, level = t.probability(code_of(context), symbols.astype(np.int64))
            go = (level < t.depth) & (context[np.minimum(level, t.depth - 1), np.arange(len(level))] != STOP)
            sums = np.bincount(owner[~go], np.log10(np.maximum(p[~go], _TINY)), len(rows))
            groups = rows >> GROUP_BITS
            out = [[int(g) % buckets, int(g) << GROUP_BITS, sum_block(rows[groups == g], sums[groups == g]), b"", b"", b"", b""] for g in np.unique(groups)]
            at = np.flatnonzero(go)
            h = np.zeros(len(at), np.uint64)
            for k in range(t.depth):
                h = np.where(level[at] >= k, (h ^ context[k, at]) * np.uint64(0x9E3779B97F4A7C15), h)
                h ^= h >> np.uint64(32)
            bucket = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            at = at[np.argsort(bucket, kind="stable")]
            edges = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]
            place = (rows[owner] - rows[0]).astype(np.uint32) * np.uint32(2) + learns[owner]
            for b in np.flatnonzero(np.diff(edges)):
                own = at[edges[b] : edges[b + 1]]
                words = context[:, own].ravel()
                rare = words >= BASE
                code = np.where(rare, OTHER, words).astype("<u2")
                out.append([b, int(rows[0]), b"", packed(code), packed(words[rare].astype("<u8")), packed(symbols[own].astype("<u2")), packed(place[own].astype("<u4"))])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return first.select("row", "learns", "symbols", "words").mapInArrow(run, "bucket int, row long, sums binary, code binary, rare binary, symbol binary, place binary")


def read_contexts(code: bytes, rare: bytes, depth: int) -> np.ndarray:
    words = unpacked(code, "<u2").astype(np.uint64)
    words[words == OTHER] = unpacked(rare, "<u8")
    return words.reshape(depth, -1)


def sum_block(rows: np.ndarray, sums: np.ndarray) -> bytes:
    """Sums of rows of one group, the rows by their place in it; small sums in single precision."""
    width = 4 if np.abs(sums).max(initial=0) < 100 else 8
    return (rows & ((1 << GROUP_BITS) - 1)).astype("<u2").tobytes() + sums.astype(f"<f{width}").tobytes() + bytes([width])


def read_sums(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = raw[-1]
    n = (len(raw) - 1) // (2 + width)
    return np.frombuffer(raw, "<u2", n), np.frombuffer(raw, f"<f{width}", n, 2 * n)


def tree_scores(first: DataFrame, tree: Tree, tokens: int) -> DataFrame:
    """row and the sum of log10 p of its symbols.

    Buckets of contexts are trees of their own below what every task has; each grows its part and scores all tokens behind
    its contexts. A bucket has about BUCKET tokens, or as many as its most frequent context, which has
    less than HOT or HOT_SHARE of all: beyond that a context is in every task.
    """
    buckets = max(BUCKETS, -(-tokens // BUCKET))
    sent = first.sparkSession.sparkContext.broadcast(tree)

    def grow(key, blocks):
        out = [(r >> GROUP_BITS, x) for r, x in zip(blocks.column("row").to_pylist(), blocks.column("sums").to_pylist()) if x]
        taken = [x for x in zip(*(blocks.column(k).to_pylist() for k in ("row", "code", "rare", "symbol", "place"))) if x[1]]
        if taken:
            context = np.concatenate([read_contexts(c, w, sent.value.depth) for _, c, w, _, _ in taken], axis=1)
            symbol = np.concatenate([unpacked(s, "<u2") for *_, s, _ in taken])
            place = [unpacked(q, "<u4") for *_, q in taken]
            row = np.concatenate([r + (q >> 1).astype(np.int64) for (r, *_), q in zip(taken, place)])
            log_p = grown(code_of(context), symbol.astype(np.int64), np.concatenate(place) & 1, sent.value, context)
            different, where = np.unique(row, return_inverse=True)
            sums, groups = np.bincount(where, log_p), different >> GROUP_BITS
            edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True])
            out += [(int(groups[i]), sum_block(different[i:j], sums[i:j])) for i, j in zip(edges[:-1], edges[1:])]
        return pa.table({"group": pa.array([g for g, _ in out], pa.int64()), "sums": pa.array([x for _, x in out], pa.binary())})

    def add(key, blocks):
        start, total = key[0].as_py() << GROUP_BITS, np.zeros(1 << GROUP_BITS)
        seen = np.zeros(len(total), bool)
        for raw in blocks.column("sums").to_pylist():
            rows, sums = read_sums(raw)
            total += np.bincount(rows, sums, len(total))
            seen[rows] = True
        at = np.flatnonzero(seen)
        return pa.table({"row": pa.array(start + at, pa.int64()), "tree": pa.array(total[at])})

    parts = []
    for share in range(SHARES):
        grown_parts = routed(first, tree, -(-buckets // SHARES), share, SHARES).groupBy("bucket").applyInArrow(grow, "group long, sums binary")
        parts.append(shared.materialize(grown_parts.groupBy("group").applyInArrow(add, "row long, tree double"), "tree-sums"))
    return reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("tree").alias("tree"))


def score(docs: DataFrame, learns: Column, head: int = HEAD, symbols: int | None = None, depth: int = DEPTH, hot: int = HOT, common: int = SYMBOLS) -> DataFrame:
    """doc_id, learns, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learned from the rows where learns holds.

    Tokens are the words of a text and one end. A word that training lacks has an equal share, by an estimate of how many
    such words there are, of the probability that discounted counts leave: one that is made up costs more than most that
    occur. Contexts are of any words; next symbols are the `common` most frequent words, the end, and all others, within
    which the root tells them apart. A caller who gives `symbols` chooses an alphabet of so many words instead: contexts
    then end at any other word. The driver and every task hold `head` words, up to (common + 4) squared numbers of next symbols, and the next symbols of contexts that occur `hot` times and
    as the HOT_SHARE of all tokens; a bucket holds all tokens behind its contexts, so up to BUCKET or that share of them.
    score is log10 of the probability of the text: each token's, in the state of the longest kept context before it, of up
    to depth symbols (BASE ** depth must fit 63 bits). A kept context gives a next symbol (n - discount) / N and, times
    what it leaves, its probability in the longest kept context within. base_score sums log10((c + 1) / (N + V + 1)).
    Null texts are empty and have the end alone; a null learns is false. Rows that repeat a doc_id, or have none, are
    scored each by its text. Without training rows every token has probability 1, in both scores. An empty
    table gives an empty one. Other columns are not read.
    """
    if not 1 < depth or BASE**depth >= 1 << 63:
        raise ValueError("contexts of this depth don't fit")
    with shared.shuffles_freed(docs.sparkSession):
        words = shared.materialize(word_counts(docs.filter(learns)), "words")
        root = learn_root(words, docs.filter(learns).count(), head, min(common if symbols is None else symbols, SYMBOLS), symbols is None)
        first = shared.materialize_at(read_symbols(docs, learns, root), "symbols", compression="zstd")[0]
        tokens = first.agg(F.sum("n_tokens")).first()[0] or 0
        tree = learn_tree(first, root, depth, hot)
        sums = tree_scores(first, tree, tokens)
    rest = first.select("row", F.explode("rest").alias("word")).join(words, "word", "left")
    n = F.coalesce("n", F.lit(0))
    base = F.log10((n + 1) / F.lit(float(root.tokens + root.distinct + 1)))
    share = F.when(n > 0, (n - root.discount) / float(root.tokens or 1)).otherwise(F.lit(root.share(0)))
    rest = rest.groupBy("row").agg(F.sum(base).alias("_base"), F.sum(F.log10(share / F.lit(float(root.p[OTHER])))).alias("_inner"), F.count("n").alias("_known"))
    whole = first.drop("rest", "symbols", "words").join(rest, "row", "left").join(sums, "row", "left")
    added = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return whole.select("doc_id", "learns", "n_tokens", added("n_known", "_known").alias("n_known"), F.lit(root.tokens).cast("long").alias("train_tokens"), added("base_score", "_base").alias("base_score"), (added("inner", "_inner") + F.coalesce("tree", F.lit(0.0))).alias("score"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, shared.crc_remainder(F.col("doc_id"), 7) != 2)
    return found.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
