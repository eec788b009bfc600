"""Spelling variants: words one edit apart, and the common form that each rarer one stands for.

Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its
near word of the largest count (ties: the smallest in code-point order), if that count is at least ``ratio``
times its own; its root is what following forms leads to.

1. ``count_words`` counts the words of all texts in the JVM; counts are summed in every task before they move.
2. ``build_shards`` range-partitions the counted words by code point, and each task turns its sorted words into
   compact tries of at most SHARD_CHARS code points (a longer word is a shard of its own): labels of all nodes in
   level order as one byte string, the first child of each node, and the rank of the word that ends there.
3. The shards are broadcast, at most PASS_BYTES at a time, and every word's Levenshtein automaton of distance
   one meets each of them depth-first. A state is whether no edit was made yet and a set of three offsets of
   positions after one edit, so a node is entered once at most, whatever letters repeat; without an edit all
   children are followed, afterwards those of three letters at most. A task reduces what the shards of a pass
   accept to a count and a best word; passes are added up by word.
4. Roots come from pointer doubling over joins. Counts grow ``ratio``-fold at each step, so 27 steps, or five
   doublings, are the most that 64-bit counts allow for a ratio of 5.

The driver holds the shards of one pass, never all words. Passes grow with the vocabulary, so work grows with
words times passes; a pass costs little where the first letters already fail. Each pass and each doubling is
written to the shared folder, and a lost task is run again from there.

Null texts and texts without letters have no words; a null id is the empty string in the key that decides
deletions. Very long texts are counted whole, very long words are words like any other. Repeated rows count each
time. An empty table, or one without a frequent word, gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import shared_table

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_ONE_IN = 6, 5, 5, 199
SHARD_CHARS, PASS_BYTES, TASK_WORDS = 2_000_000, 64 << 20, 8_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_SCHEMA = "shard long, words long, bytes long, labels binary, first binary, rank binary, counts binary"


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """word, n: runs of at least LEAST_LENGTH letters, seen at least LEAST_COUNT times.

    Only A-Z are lowered. Where the CRC-32 h of ``<key>:<run>`` is a multiple of ``drop_one_in`` (0: never), the
    run loses its code point h % length.
    """
    runs = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"),
        F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(f"([a-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}})"), 1)).alias("run"),
    )
    word = F.col("run")
    if drop_one_in:
        h = F.crc32(F.concat_ws(":", "k", "run").cast("binary"))
        at = F.pmod(h, F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % drop_one_in == 0, shorter).otherwise(word)
    counts = runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


class Trie:
    """A compact trie: node 0 is the root, a node's children lie together and sorted, levels follow each other."""

    def __init__(self, labels: bytes, first: bytes, rank: bytes, counts: bytes):
        # Words are of code points up to 255, so a label is a byte.
        self.labels = labels.decode("latin-1")
        self.first, self.rank, self.counts = array("i", first), array("i", rank), array("q", counts)

    @staticmethod
    def pack(words: list[str], counts: list[int]) -> tuple[bytes, bytes, bytes, bytes]:
        """words: sorted and distinct."""
        labels, first, rank = ["\0"], array("i"), array("i")
        ranges = [(0, len(words))] if words else [(0, 0)]
        level, depth = ranges, 0
        made = 1
        while level:
            below = []
            for lo, hi in level:
                first.append(made + len(below))
                ends = lo < hi and len(words[lo]) == depth
                rank.append(lo if ends else -1)
                lo += ends
                while lo < hi:
                    letter, end = words[lo][depth], lo + 1
                    while end < hi and words[end][depth] == letter:
                        end += 1
                    labels.append(letter)
                    below.append((lo, end))
                    lo = end
            made += len(below)
            level, depth = below, depth + 1
        first.append(made)
        return "".join(labels).encode("latin-1"), first.tobytes(), rank.tobytes(), array("q", counts).tobytes()

    def word_at(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.labels[node])
            node = bisect_right(self.first, node) - 1
            # Leaves before the parent share its first child's number; the parent is the last of them.
        return "".join(reversed(letters))

    def near(self, word: str) -> list[int]:
        """Nodes of the words exactly one edit away.

        Offsets after an edit, as bits: 1 the trie holds a letter more, 2 a letter was replaced, 4 one was deleted.
        """
        labels, first, rank, size = self.labels, self.first, self.rank, len(word)  # no label but the root's is \0
        find, out = labels.find, []
        stack = [(0, 0, True, 0)]
        pop, push = stack.pop, stack.append
        while stack:
            node, depth, exact, bits = pop()
            if exact and depth < size:
                bits |= 4
            left = size - depth
            if rank[node] >= 0 and ((bits & 1 and left == -1) or (bits & 2 and left == 0) or (bits & 4 and left == 1)):
                out.append(node)
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                continue
            depth += 1
            a = word[depth - 2] if bits & 1 and left >= 0 else ""
            b = word[depth - 1] if left > 0 else ""
            c = word[depth] if bits & 4 and left > 1 else "\0"
            if exact:
                after = word[depth] if left > 1 else ""
                for child in range(lo, hi):
                    x = labels[child]
                    if x == b:
                        push((child, depth, True, 5 if x == c else 1))
                    elif x == c:
                        push((child, depth, False, 7))
                    elif left < 2 or find(b, first[child], first[child + 1]) >= 0 or find(after, first[child], first[child + 1]) >= 0:
                        # Others lead nowhere: after a letter more comes b, after a replaced one what follows b.
                        push((child, depth, False, 3 if b else 1))
                continue
            b = b if bits & 2 else ""
            if a:
                child = find(a, lo, hi)
                if child >= 0:
                    push((child, depth, False, 1 | (2 if b == a else 0) | (4 if c == a else 0)))
            if b and b != a:
                child = find(b, lo, hi)
                if child >= 0:
                    push((child, depth, False, 2 | (4 if c == b else 0)))
            if c != a and c != b:
                child = find(c, lo, hi)
                if child >= 0:
                    push((child, depth, False, 4))
        return out


def build_shards(words: DataFrame, total_chars: int, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(word, n) -> the packed tries; none holds more than ``shard_chars`` code points, but for a single longer word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        counts: list[int] = []
        chars = 0

        def out() -> pa.RecordBatch:
            packed = Trie.pack(held, counts)
            cells = [[hash_of(held[0])], [len(held)], [sum(map(len, packed))], *([x] for x in packed)]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(cells, [pa.int64()] * 3 + [pa.binary()] * 4)], "shard words bytes labels first rank counts".split()
            )
            held.clear(), counts.clear()
            return batch

        for batch in batches:
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if held and chars + len(word) > shard_chars:
                    yield out()
                    chars = 0
                held.append(word), counts.append(n)
                chars += len(word)
        if held:
            yield out()

    parts = max(1, math.ceil(total_chars / shard_chars))
    ordered = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(run, SHARD_SCHEMA)


def hash_of(word: str) -> int:
    """A shard's name: the digest of its first word, which no other shard holds."""
    import hashlib

    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big", signed=True)


def passes(shards: DataFrame, pass_bytes: int = PASS_BYTES) -> list[list[int]]:
    """Names of the shards of each pass; a row for each shard reaches the driver, without its trie."""
    groups, size = [], 0
    for r in shards.select("shard", "bytes").orderBy("shard").collect():
        if not groups or size + r["bytes"] > pass_bytes:
            groups.append([])
            size = 0
        groups[-1].append(r["shard"])
        size += r["bytes"]
    return groups


def meet(words: DataFrame, packed: list[tuple], tasks: int) -> DataFrame:
    """word, n_near, form_n, form: what one pass's shards hold near each word, form being the most frequent."""
    shared = words.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie(*x) for x in shared.value]
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                near, best = 0, None
                for t in tries:
                    nodes = t.near(word)
                    if nodes:
                        near += len(nodes)
                        n, _, node = max((t.counts[t.rank[x]], -t.rank[x], x) for x in nodes)
                        if best is None or n >= best[0]:
                            form = t.word_at(node)
                            if best is None or n > best[0] or form < best[1]:
                                best = n, form
                if best:
                    rows.append((word, near, *best))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n_near", "form_n", "form"])

    return words.select("word").repartition(tasks, "word").mapInArrow(run, "word string, n_near long, form_n long, form string")


def roots(links: DataFrame) -> DataFrame:
    """(word, form) without circles -> word, root, by pointer doubling."""
    at = shared_table(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = shared_table(step, "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variant_groups(words: DataFrame, ratio: int = RATIO, shard_chars: int = SHARD_CHARS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """words: word, n, distinct, of code points up to 255. word, form, root, n, n_near, form_n."""
    words = shared_table(words.select("word", F.col("n").cast("long").alias("n")), "words")
    total, chars = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    shards = shared_table(build_shards(words, chars, shard_chars), "tries")
    tasks = max(1, math.ceil(total / TASK_WORDS))
    found = []
    for names in passes(shards, pass_bytes):
        packed = [tuple(r) for r in shards.where(F.col("shard").isin(names)).select("labels", "first", "rank", "counts").collect()]
        found.append(shared_table(meet(words, packed, tasks), "near"))
    if not found:
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    near = found[0]
    if len(found) > 1:
        for more in found[1:]:
            near = near.unionByName(more)
        best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
        near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), "b.form")
    known = words.join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    strong = F.col("form_n") >= ratio * F.col("n")
    known = known.withColumns({"form": F.when(strong, F.col("form")), "form_n": F.when(strong, F.col("form_n"))})
    known = shared_table(known, "variants")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
