"""Near-duplicate documents by DartMinHash.

A document is a weighted set of word shingles, each weighing as often as it
occurs; two documents' similarity is the weighted Jaccard one.  Each element throws hashed
darts: along a rank axis they arrive at rate one for each unit of weight, the
same for every document that holds the element, and those up to a rank that
yields about k ln k + 2k darts in all are kept.  A dart's hash names one of k
coordinates; the earliest dart of a coordinate is its sample, and two
documents' samples are equal with the probability of their weighted Jaccard
similarity.  Coordinates are banded; documents that share a band are compared
exactly on their shingles.

Equal texts are one node.  Links are sought round by round: in every bucket all
members are compared with its least member only, and what links becomes one
class.  Where a bucket then still holds several classes, members of different
classes are compared by their sketches (a byte of each sample); members that
have a partner whose sketch does not rule the similarity out (four deviations)
bring their texts to the bucket, where such pairs are compared exactly unless
links found there have made them one class already.  Only those links leave, so
fewer than the bucket has members.  Buckets with too many such comparisons fall
into finer ones (two bands together, then three) in which the round begins
again; that only makes classes fewer.  In the end all members of the large
buckets that still hold several classes are dealt into blocks, and every two
blocks of a bucket are compared as a bucket of their own.  So no link between
classes is given up, and no group is expanded into rows for its pairs.  Buckets
whose texts are too long to be held together send their likely pairs to the
texts instead.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, forget, written
from .op1_langid import letters

SHINGLE, SIMILARITY = 5, 0.8
COORDINATES, ROWS = 80, 4
#: Members of a bucket, and comparisons between its classes, beyond which it is made finer, then compared in blocks.
MEMBERS, COMPARED = 65_536, 8_000_000
#: Characters of a bucket's texts that a task holds together.
HELD = 16_000_000
#: A key with more rows than this, and than this share of all rows, is hot: its rows are joined where they are. So many keys are
#: at most (the inverse of the share), which bounds what is broadcast.
HOT, KEYS = 1000, 50_000

_word: np.ndarray | None = None
_powers = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = both[0], both[1]
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word (letters, digits and _, in lower case), in order."""
    global _word
    if _word is None:
        _word = letters() | np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
        _word[ord("_")] = True
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _word[code]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts = edge[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(code))
    value = np.where(inside, (code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], np.uint64(0))
    return _mix(np.add.reduceat(value, starts) * down[starts])


def shingles(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of n words, each once, and how often each occurs; of a shorter text all its words as one."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words, np.zeros(0)
    m = max(1, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(min(n, len(words))):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + m]
    elements, counts = np.unique(_mix(out), return_counts=True)
    return elements, counts.astype(np.float64)


def darts(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The sample of each of k coordinates: the hash of its earliest dart.

    An element of weight w covers ceil(w) unit strips; a dart of the last strip
    counts if its height in it is under what is left of the weight.
    """
    strips = np.ceil(weights).astype(np.int64)
    element = np.repeat(elements, strips)
    strip = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
    left = np.repeat(weights, strips) - strip
    element = _mix(element + strip.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    limit = (k * math.log(k) + 2 * k) / max(float(weights.sum()), 1e-9)
    while True:
        alive, at, base, rank, ident = element, left, np.zeros(len(element)), [], []
        j = 0
        many = int(limit + 3 * math.sqrt(limit)) + 1
        while len(alive):
            steps = np.arange(j, j + many, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
            h = _mix(alive[:, None] ^ _mix(steps + np.uint64(0x5851F42D4C957F2D))[None, :])
            when = base[:, None] + np.cumsum(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53), axis=1)
            ok = when <= limit
            h2 = _mix(h + np.uint64(0x2545F4914F6CDD1D))
            hit = ok & (((h2 >> np.uint64(40)).astype(np.float64) / 2.0**24) < at[:, None])
            rank.append(when[hit])
            ident.append(h2[hit])
            more = ok[:, -1]
            alive, at, base, j = alive[more], at[more], when[more, -1], j + many
        order = np.argsort(np.concatenate(rank), kind="stable")
        found = np.concatenate(ident)[order]
        where, first = np.unique(found % np.uint64(k), return_index=True)
        if len(where) == k:
            return found[first]
        limit *= 2


def signature(text: str | None, k: int = COORDINATES, rows: int = ROWS) -> tuple[list[int], bytes]:
    """A signed 64-bit key for each band, and the sketch; nothing for a text without a word."""
    elements, weights = shingles(text)
    if not len(elements):
        return [], b""
    found = darts(elements, weights, k)
    sample = found.reshape(-1, rows)
    key = np.arange(1, len(sample) + 1, dtype=np.uint64)
    for r in range(rows):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + sample[:, r])
    return key.astype(np.int64).tolist(), (found >> np.uint64(32)).astype(np.uint8).tobytes()


def agreement(least: float, k: int = COORDINATES) -> int:
    """Samples that sketches of so similar texts share but for four deviations."""
    return max(1, math.floor(k * (least - 4 * math.sqrt(least * (1 - least) / k))))


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The hot keys of a written table; None without any."""
    total = rows.count()
    if total <= HOT:
        return None
    found = written(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > max(HOT, total // KEYS)).select(key), "hot")
    if found.isEmpty():
        forget(found)
        return None
    return found


def spread(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with table, which has a key once, hot keys without a shuffle of their rows (how: inner or left)."""
    if hot is None:
        return rows.join(table, key, how)
    hot = F.broadcast(hot)
    few = F.broadcast(table.join(hot, key, "left_semi"))  # a row of each hot key at most
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))


def likely(pairs: DataFrame, nodes: DataFrame, least: float, hot: DataFrame | None = None) -> DataFrame:
    """Those pairs (a, b) whose sketches do not rule the similarity out; hot: those of b."""
    need = agreement(least)
    sides = [nodes.select(F.col("key").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]

    def each(got, _):
        x, y = (np.frombuffer(b"".join(got[f"sketch_{s}"]), np.uint8).reshape(-1, COORDINATES) for s in "ab")
        keep = np.flatnonzero((x == y).sum(1) >= need)
        return {s: [got[s][i] for i in keep] for s in "ab"}

    return by_batch(spread(pairs.join(sides[0], "a"), sides[1], "b", hot).select("a", "b", "sketch_a", "sketch_b"), each, "a binary, b binary")


def by_bucket(rows: DataFrame, columns: tuple[str, ...], each, schema: str) -> DataFrame:
    """each(*columns as lists) of whole buckets of rows(bucket, ...), in their
    order; it returns a list of lists for the columns of schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if x.endswith("bigint") else pa.binary() for x in schema.split(", ")]
    at = columns.index("bucket")

    def run(batches):
        kept: list[list] = [[] for _ in columns]
        for batch in batches:
            for k, c in zip(kept, columns):
                k += batch.column(c).to_pylist()
            end = len(kept[at])
            while end and kept[at][end - 1] == kept[at][-1]:  # the last bucket may go on
                end -= 1
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(each(*(k[:end] for k in kept)), kinds)], names)
                kept = [k[end:] for k in kept]
        if kept[at]:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(each(*kept), kinds)], names)

    return rows.select(*columns).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _ends(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each bucket."""
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(bucket)]]))


def _codes(label: list[bytes]) -> np.ndarray:
    return np.unique(np.array(label, dtype=object).astype("S16") if label else np.zeros(0, "S16"), return_inverse=True)[1]


def _likely_pairs(bucket: np.ndarray, label: np.ndarray, sketch: np.ndarray, need: int):
    """Indexes of rows of one bucket and different classes whose sketches agree, in bounded pieces."""
    starts, size = _ends(bucket)
    of = np.repeat(size, size)
    for d in range(1, min(64, int(size.max(initial=1)))):  # all small buckets at once
        i = np.flatnonzero((bucket[d:] == bucket[:-d]) & (of[d:] <= 64) & (label[d:] != label[:-d]))
        for at in range(0, len(i), 100_000):
            part = i[at : at + 100_000]
            hit = part[(sketch[part] == sketch[part + d]).sum(1) >= need]
            yield hit, hit + d
    for start, m in zip(starts[size > 64], size[size > 64]):
        s, lab = sketch[start : start + m], label[start : start + m]
        step = max(1, 500_000 // m)
        for at in range(0, m, step):
            x = s[at : at + step]
            ok = (lab[at : at + step, None] != lab[None, :]) & (np.arange(at, at + len(x))[:, None] < np.arange(m)[None, :])
            i, j = np.nonzero(ok)
            for c in range(0, len(i), 100_000):
                a, b = i[c : c + 100_000], j[c : c + 100_000]
                good = (x[a] == s[b]).sum(1) >= need
                yield start + at + a[good], start + b[good]


def _sketches(sketch: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, COORDINATES)


def across(rows: DataFrame, least: float) -> DataFrame:
    """Those of rows(bucket, key, label, sketch) with a likely partner of another class in the bucket."""
    need = agreement(least)

    def marked(bucket, key, label, sketch):
        keep = np.zeros(len(key), bool)
        for i, j in _likely_pairs(np.array(bucket, np.int64), _codes(label), _sketches(sketch), need):
            keep[i] = keep[j] = True
        at = np.flatnonzero(keep).tolist()
        return [[c[i] for i in at] for c in (bucket, key, label, sketch)]

    return by_bucket(rows, ("bucket", "key", "label", "sketch"), marked, "bucket bigint, key binary, label binary, sketch binary")


def across_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Likely pairs (a, b) of different classes in a bucket of rows(bucket, key, label, sketch)."""
    need = agreement(least)

    def found(bucket, key, label, sketch):
        a, b = [], []
        for i, j in _likely_pairs(np.array(bucket, np.int64), _codes(label), _sketches(sketch), need):
            for x, y in zip(i.tolist(), j.tolist()):
                a.append(min(key[x], key[y]))
                b.append(max(key[x], key[y]))
        return [a, b]

    return by_bucket(rows, ("bucket", "key", "label", "sketch"), found, "a binary, b binary").distinct()


def joined(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the classes of each bucket of rows(bucket, key, label, sketch, text).

    A row is compared exactly with all likely later ones that are not of its
    class by then; a link makes two classes one.
    """
    need = agreement(least)

    def of_bucket(key, lab, sketch, own):
        size = np.array([w.sum() for _, w in own])
        many = np.array([len(e) for e, _ in own])
        dense = np.unique(np.concatenate([e for e, _ in own]), return_inverse=True)[1]
        ids = np.split(dense, np.cumsum(many)[:-1])
        mine = np.zeros(int(dense.max(initial=0)) + 1)
        for i in range(len(key) - 1):
            others = i + 1 + np.flatnonzero(lab[i + 1 :] != lab[i])
            for at in range(0, len(others), 4096):
                part = others[at : at + 4096]
                part = part[(lab[part] != lab[i]) & ((sketch[part] == sketch[i]).sum(1) >= need) & (np.minimum(size[part], size[i]) >= least * np.maximum(size[part], size[i]) - 1e-9)]
                if not len(part):
                    continue
                mine[ids[i]] = own[i][1]
                least_of = np.minimum(mine[np.concatenate([ids[j] for j in part])], np.concatenate([own[j][1] for j in part]))
                both = np.add.reduceat(least_of, np.cumsum(many[part]) - many[part])
                mine[ids[i]] = 0
                for j in part[both / (size[part] + size[i] - both) >= least - 1e-9].tolist():
                    if lab[j] != lab[i]:
                        lab[lab == lab[j]] = lab[i]
                        yield key[i], key[j]

    def found(bucket, key, label, sketch, text):
        code, s = _codes(label), _sketches(sketch)
        links = []
        for start, m in zip(*(x.tolist() for x in _ends(np.array(bucket, np.int64)))):
            one = slice(start, start + m)
            links += of_bucket(key[one], code[one], s[one], [shingles(t) for t in text[one]])
        return [[a for a, _ in links], [b for _, b in links]]

    return by_bucket(rows, ("bucket", "key", "label", "sketch", "text"), found, "a binary, b binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' shingles: the sum of the lesser counts over that of the greater."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / max(a[1].sum() + b[1].sum() - both, 1)


def linked(pairs: DataFrame, texts: DataFrame, least: float, hot: DataFrame | None = None) -> DataFrame:
    """Those pairs (a, b) of keys whose texts' shingles are at least so similar; hot: those of b."""
    sides = [texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
    both = spread(pairs.join(sides[0], "a"), sides[1], "b", hot)

    def each(got, memo):
        out = {"a": [], "b": []}

        def of(text):
            if text not in memo:
                if len(memo) > 256:
                    memo.clear()
                memo[text] = shingles(text)
            return memo[text]

        for a, b, x, y in zip(got["a"], got["b"], got["text_a"], got["text_b"]):
            x, y = of(x), of(y)
            if min(x[1].sum(), y[1].sum()) >= least * max(x[1].sum(), y[1].sum()) - 1e-9 and similarity(x, y) >= least - 1e-9:
                out["a"].append(a)
                out["b"].append(b)
        return out

    return by_batch(both.select("a", "b", "text_a", "text_b"), each, "a binary, b binary", dict)


def components(edges: DataFrame) -> DataFrame:
    """key, label of every node of edges(a, b): the least key it reaches.

    A node takes the least label around it, then that label's own label, until
    nothing changes; paths halve, so rounds are few.
    """
    ways = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "ways")
    now = written(ways.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("near")).select("key", F.least("key", "near").alias("label")), "labels")
    hubs = hot_keys(ways, "b")
    while True:
        seen = spread(ways, now.withColumnsRenamed({"key": "b", "label": "other"}), "b", hubs).groupBy(F.col("a").alias("key")).agg(F.min("other").alias("other"))
        step = written(now.join(seen, "key").select("key", F.col("label").alias("old"), F.least("label", "other").alias("label")), "step")
        hot = hot_keys(step, "label")
        jump = now.select(F.col("key").alias("label"), F.col("label").alias("next"))  # every label is the key of a node
        new = written(spread(step, jump, "label", hot).select("key", "old", F.least("label", "next").alias("label")), "labels")
        changed = not new.where("old != label").isEmpty()
        for done in (now, step, hot):
            if done is not None:
                forget(done)
        now = new.select("key", "label")
        now._tabulark_path = new._tabulark_path
        if not changed:
            for done in (ways, hubs):
                if done is not None:
                    forget(done)
            return now


def _of(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """nodes with label: that of their class, else their own key."""
    if labels is None:
        return nodes.withColumn("label", F.col("key"))
    return nodes.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def near_classes(docs: DataFrame, least: float = SIMILARITY, compared: int = COMPARED) -> DataFrame:
    """doc_id, key (md5 of the text), class_id of each row of docs(doc_id, text, ...).

    class_id is the least doc_id of the texts that links join.  Null texts are
    empty; texts without a word are alike only if equal; repeated rows and rows
    of one doc_id with different texts each keep their row; a class whose ids
    are all null has a null class_id; other columns are ignored; an empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("key", F.unhex(F.md5("text")))

    def sign(got, _):
        both = [signature(t) for t in got["text"]]
        return {"doc_id": got["doc_id"], "key": got["key"], "bands": [b for b, _ in both], "sketch": [s for _, s in both]}

    signed = written(by_batch(base, sign, "doc_id bigint, key binary, bands array<bigint>, sketch binary"), "signed")
    every = written(signed.groupBy("key").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least_id")), "nodes")
    nodes = every.where("size(bands) > 0").select("key", "bands", "sketch")
    labels: DataFrame | None = None
    whole: DataFrame | None = None  # the large buckets of one band, all members
    rows = nodes.select("key", F.explode("bands").alias("bucket"))
    for depth in range(3):
        # members of buckets of two or more, with the least member
        met = rows.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("size")).where("size > 1")
        held = written(rows.join(met.drop("size"), "bucket"), "held")
        if not depth:  # one row of each text that shares a bucket; finer buckets hold no other
            once = base.dropDuplicates(["key"]).select("key", "text")
            texts = written(once.join(held.select("key").distinct(), "key", "left_semi").withColumn("chars", F.length("text")), "texts")
        stars = held.where("key != head")
        if depth:  # not those that are one class already
            heads = _of(stars.select(F.col("head").alias("key")).distinct(), labels).withColumnsRenamed({"key": "head", "label": "head_label"})
            stars = _of(stars, labels).join(heads, "head").where("label != head_label")
        stars = written(stars.select(F.col("key").alias("a"), F.col("head").alias("b")).distinct(), "stars")
        hot = hot_keys(stars, "b")
        labels = _with(linked(likely(stars, nodes, least, hot), texts, least, hot), labels)
        forget(stars)
        # comparisons between classes: all pairs less those inside a class
        classed = _of(held, labels)
        counted = classed.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("classes"))
        mixed = counted.where("classes > 1").select("bucket", ((F.col("n") > MEMBERS) | ((F.col("n") * F.col("n") - F.col("same")) / 2 > compared)).alias("large"))
        open_ = written(classed.join(mixed, "bucket").select("bucket", "key", "label", "large"), "open")
        forget(held)
        labels = _settled(open_.where("not large"), nodes, texts, labels, least)
        large = open_.where("large").select("key", "bucket")
        if not depth and not large.isEmpty():
            whole = written(large, "large")
        if depth == 2 or large.isEmpty():
            forget(open_)
            break
        # finer buckets: with each other band of the document
        rows = written(large.join(nodes, "key").select("key", F.explode(F.transform(F.filter("bands", lambda x: x != F.col("bucket")), lambda x: F.xxhash64(F.least(x, F.col("bucket")), F.greatest(x, F.col("bucket"))))).alias("bucket")).distinct(), "finer")
        forget(open_)
    if whole is not None:
        blocks = written(_blocks(_of(whole, labels), compared), "blocks")
        labels = _settled(blocks, nodes, texts, labels, least)
        forget(blocks)
        forget(whole)
    # classes of texts first, then of their copies
    named = written(_of(every.select("key", "least_id"), labels), "named")
    ids = named.groupBy("label").agg(F.min("least_id").alias("class_id"))
    classes = written(spread(named, ids, "label", hot_keys(named, "label")).select("key", "class_id"), "classes")
    forget(named)
    return spread(signed.select("doc_id", "key"), classes, "key", hot_keys(signed, "key")).select("doc_id", "key", "class_id")


def _blocks(classed: DataFrame, compared: int) -> DataFrame:
    """bucket, key, label: every two blocks of each bucket of classed(bucket, key, label) as one.

    Buckets of one class are left out; the others have two blocks at least, each
    small enough that two of them have about `compared` pairs.
    """
    size = max(1, math.isqrt(compared // 2))
    many = classed.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("classes"))
    many = many.where("classes > 1").select("bucket", F.greatest(F.lit(2), F.ceil(F.col("n") / size)).cast("int").alias("blocks"))
    dealt = classed.join(many, "bucket").withColumn("mine", F.pmod(F.xxhash64("key", "bucket"), "blocks").cast("int"))
    each = dealt.select("bucket", "key", "label", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("mine != other")
    return each.select(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "key", "label")


def _settled(now: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame | None, least: float):
    """The labels after the members of each bucket of now(bucket, key, label) are compared."""
    near = written(across(now.join(nodes.select("key", "sketch"), "key"), least), "near")
    if not near.isEmpty():
        # equal sets of members are compared once
        sets = near.join(texts.select("key", "chars"), "key").groupBy("bucket").agg(F.bit_xor(F.xxhash64("key")).alias("set"), F.count("*").alias("n"), F.sum("chars").alias("chars"))
        sets = written(sets.groupBy("set", "n", "chars").agg(F.min("bucket").alias("bucket")), "sets")
        light = near.join(sets.where(F.col("chars") <= HELD).select("bucket"), "bucket", "left_semi")
        labels = _with(joined(light.join(texts, "key"), least), labels)
        long = sets.where(F.col("chars") > HELD)
        if not long.isEmpty():
            rest = near.drop("label").join(long.select("bucket"), "bucket", "left_semi")
            labels = _with(linked(across_pairs(_of(rest, labels), least), texts, least), labels)
        forget(sets)
    forget(near)
    return labels


def _with(links: DataFrame, labels: DataFrame | None):
    """The labels after more links; only links between classes count, as links of their labels."""
    between = _of(_of(links.withColumnRenamed("a", "key"), labels).select(F.col("label").alias("a"), F.col("b").alias("key")), labels).select("a", F.col("label").alias("b"))
    found = written(between.where("a != b").distinct(), "edges")
    if found.isEmpty():
        forget(found)
        return labels
    joined_ = components(found)
    if labels is None:
        new = joined_
    else:
        moved = spread(labels, joined_.select(F.col("key").alias("label"), F.col("label").alias("next")), "label", hot_keys(labels, "label"), "left").select("key", F.coalesce("next", "label").alias("label"))
        new = written(moved.union(joined_.join(labels, "key", "left_anti").select("key", "label")), "labels")
        forget(joined_)
        forget(labels)
    forget(found)
    return new


def representatives(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class: that of its least doc_id, all columns kept whatever
    their names.  Of equal rows, and of rows of that doc_id and text, one stays;
    null texts are empty; an empty table gives an empty result."""
    there, mark = {c.lower() for c in docs.columns}, "_kept"
    while any(c.startswith(mark) for c in there):
        mark = "_" + mark
    kid, key, n = (f"{mark}_{x}" for x in ("id", "key", "n"))
    kept = near_classes(docs, least).where("doc_id <=> class_id").groupBy(F.col("doc_id").alias(kid), F.col("key").alias(key)).agg(F.count("*").alias(n))
    kept = written(kept, "kept")
    own = [F.col(f"`{c}`") for c in docs.columns]
    both = docs.join(kept, docs["doc_id"].eqNullSafe(kept[kid]) & (F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))) == kept[key]))
    once = both.where(F.col(n) == 1).select(*own)
    return once.unionByName(both.where(F.col(n) > 1).dropDuplicates([kid, key]).select(*own))


def query(spark, sf_dir: str) -> DataFrame:
    got = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


SQL = None
