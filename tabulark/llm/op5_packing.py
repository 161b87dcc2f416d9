"""Best-fit packing of token sequences by linear grouping.

Lengths are at most the capacity, so their histogram is bounded however many
documents there are, and the whole plan is made from it: large lengths are
sorted into groups of equal cardinality and rounded up to their group's
largest; the few sizes' best configurations come from a linear program (column
generation, a knapsack for each new configuration) rounded down; actual
lengths take the configurations' slots; what is left over and all small
lengths are placed by best fit, decreasing.  The plan is a list of runs: so
many pieces of one length into so many consecutive sequences at one offset.
Executors look up each piece's run by its length and its rank in that length.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, written

CAPACITY, END_ID = 4096, 1
#: Large lengths are over capacity / SMALL; groups of them; rows of a ranking window.
SMALL, GROUPS, ROWS = 8, 24, 500
#: Words whose ids a worker keeps from task to task (twice as many, half of them older); characters of texts whose new
#: words are learned together.
CACHE, TOGETHER = 250_000, 1_000_000
#: Letters that are their own NFC form and have one lower case; what else than they, ASCII, spaces and line ends is odd.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
ODD = re.compile(f"[^ \\n!-~{LETTERS}]|<\\|")
#: What the tokenizer cuts plain text in lower case into (fixed by its vocabulary file): endings, words, digits, marks.
UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^ \\n{LETTERS}0-9]+")


class ChunkEncoder:
    """Ids of texts, as little-endian 32-bit words, unit by unit.

    The tokenizer lowers the case, cuts a text into units and joins nothing
    across them.  Units of plain text are found by one pattern and looked up; a
    stretch between spaces that holds anything else is a unit of its own, which
    goes through the whole tokenizer.  New units of many texts are learned together.
    """

    def __init__(self, path: str, mark: str = "<|startoftext|>", word_end: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.mark = Tokenizer.from_file(path), mark
        self.known, self.older = {"": b""}, {}
        self.mark_id = self.tokenizer.token_to_id(mark)
        # the same merges without the steps that change nothing in lower-case words of WORD's letters
        self.words = Tokenizer.from_file(path)
        self.words.normalizer, self.words.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.words.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(word_end)]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the vocabulary writes a byte as one character, most bytes of these letters as the same in Latin-1
        self.written = {chr(x).encode().decode("latin-1"): level.pre_tokenize_str(chr(x))[0][0] for x in range(0xDF, 0x100) if x != 0xF7}
        self.written = {a: b for a, b in self.written.items() if a != b}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def odd_units(self, text: str) -> list[str]:
        """The units of any text; a stretch with odd characters is one, after a space."""
        out = []
        for chunk in text.replace("\n", " ").split(" "):
            if ODD.search(chunk.lower()):
                out.append(" " + chunk)
            else:
                out += UNIT.findall(chunk.lower())
        return out

    def _found(self, split: list[list[str]]) -> tuple[dict[str, bytes], set[str]]:
        """All units with their ids, and those not known; older ones become known again."""
        there = list(set().union(*split))
        ids = dict(zip(there, map(self.known.get, there)))
        new = {u for u, found in ids.items() if found is None}
        kept = {u: self.older[u] for u in new.intersection(self.older)}
        self.known.update(kept)
        ids.update(kept)
        return ids, new.difference(kept)

    def learn(self, units: set[str]) -> None:
        """Words of letters are encoded many at a time and told apart by the
        tokens that end a word; all other units with a mark token between them."""
        known = self.known
        new = list(filter(str.isalpha, units))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            text = " ".join(part).encode().decode("latin-1")
            for a, b in self.written.items():
                text = text.replace(a, b)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))))
            else:
                known.update((w, self._encode(w).tobytes()) for w in part)
        rest = units.difference(new)
        plain = [u for u in rest if "<|" not in u]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = self._encode(f" {self.mark} ".join(part))
            ends = [*np.flatnonzero(ids == self.mark_id), len(ids)]
            if len(ends) == len(part):
                for u, start, end in zip(part, [-1, *ends], ends):
                    known[u] = ids[start + 1 : end].tobytes()
            else:
                known.update((u, self._encode(u).tobytes()) for u in part)
        known.update((u, self._encode(u).tobytes()) for u in rest.difference(plain))

    def __call__(self, text: str) -> bytes:
        return next(self.each([text]))

    def each(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; new units of many texts are learned in one go."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            if len(self.known) > CACHE:
                self.known, self.older = {"": b""}, self.known
            split = [UNIT.findall(t.lower()) for t in texts[at:end]]
            ids, new = self._found(split)
            if ODD.search(" ".join(new)):
                split = [self.odd_units(t) for t in texts[at:end]]
                ids, new = self._found(split)
            if new:
                self.learn(new)
                ids.update((u, self.known[u]) for u in new)
            for units in split:
                yield b"".join(map(ids.__getitem__, units))
            at = end


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a vocabulary."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each document's ids."""
    end = np.array([end_id], "<u4").tobytes()

    def each(got, encode):
        out = defaultdict(list)
        for doc, ids in zip(got["doc_id"], encode.each([t or "" for t in got["text"]])):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                for name, v in (("doc_id", doc), ("piece", k), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                    out[name].append(v)
        return out

    return by_batch(docs.select("doc_id", "text"), each, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", lambda: encoder(path))


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of sizes within capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fit = np.where(sizes <= c, values + best[np.maximum(c - sizes, 0)], -1.0)
        k = int(fit.argmax())
        best[c], last[c] = (fit[k], k) if fit[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    counts, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole multiplicities, rounded down from the best mix."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * k):
        x = np.linalg.solve(basis, demand.astype(float))
        dual = np.linalg.solve(basis.T, np.ones(k))
        value, column = _knapsack(sizes, dual, capacity)
        if value <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, i].astype(int), int(math.floor(x[i] + 1e-7))) for i in range(k) if x[i] >= 1 - 1e-7]


class Plan:
    """Runs (length, rank, n, sequence, per_sequence, offset) and the number of sequences."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.sequences = capacity, 0
        self.left, self.rank = dict(counts), dict.fromkeys(counts, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free: (first sequence, count)
        self._free: list[int] = []
        self._large(groups)
        for length in sorted((n for n, c in self.left.items() if c), reverse=True):
            self._best_fit(length)

    def _take(self, length: int, n: int, first: int, per: int, used: int) -> None:
        self.runs.append((length, self.rank[length], n, first, per, used))
        self.rank[length] += n
        self.left[length] -= n

    def _gap(self, free: int, first: int, count: int) -> None:
        if free > 0 and count > 0:
            if not self.gaps[free]:
                heapq.heappush(self._free, free)
            self.gaps[free].append((first, count))

    def _large(self, groups: int) -> None:
        lengths = sorted((n for n, c in self.left.items() if c and self.capacity // SMALL < n <= self.capacity), reverse=True)
        total = sum(self.left[n] for n in lengths)
        if not total:
            return
        parts: list[list[int]] = [[]]
        seen = 0
        for n in lengths:
            if parts[-1] and seen >= total * len(parts) / groups:
                parts.append([])
            parts[-1].append(n)
            seen += self.left[n]
        sizes = np.array([p[0] for p in parts])
        demand = np.array([sum(self.left[n] for n in p) for p in parts])
        queue = [list(p) for p in parts]
        for column, times in configurations(sizes, demand, self.capacity):
            blocks = [(self.sequences, times, 0)]  # first sequence, count, used
            self.sequences += times
            for g in np.flatnonzero(column):
                for _ in range(column[g]):
                    after = []
                    for first, count, used in blocks:
                        while count and queue[g]:
                            n = queue[g][0]
                            k = min(count, self.left[n])
                            if k:
                                self._take(n, k, first, 1, used)
                                after.append((first, k, used + n))
                                first, count = first + k, count - k
                            if not self.left[n]:
                                queue[g].pop(0)
                        if count:
                            after.append((first, count, used))
                    blocks = after
            for first, count, used in blocks:
                self._gap(self.capacity - used, first, count)

    def _best_fit(self, length: int) -> None:
        for free in sorted(f for f in self.gaps if f >= length and self.gaps[f]):
            if not self.left[length]:
                return
            self._fill(free, self.gaps.pop(free), length)
        if n := self.left[length]:
            count = -(-n // (self.capacity // length))
            blocks = [(self.sequences, count)]
            self.sequences += count
            self._fill(self.capacity, blocks, length)

    def _fill(self, free: int, blocks: list[tuple[int, int]], length: int) -> None:
        per, used = free // length, self.capacity - free
        for first, count in blocks:
            full = min(count, self.left[length] // per)
            if full:
                self._take(length, full * per, first, per, used)
                self._gap(free - per * length, first, full)
                first, count = first + full, count - full
            if count and 0 < (n := self.left[length]) < per:
                self._take(length, n, first, n, used)
                self._gap(free - n * length, first, 1)
                first, count = first + 1, count - 1
            self._gap(free, first, count)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each piece of docs(doc_id, text, ...) with its sequence_id and offset.

    Null texts are empty and still hold the end id; repeated rows are packed like
    any other; other columns are ignored; an empty table gives an empty result.
    """
    cut = written(pieces(docs, path, capacity, end_id), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs) or [(0, 0, 0, 0, 1, 0)], dtype=np.int64)
    # ranks in a length, in parts of about ROWS rows: the parts' sizes are summed, no window holds a whole length
    parts = F.lit([max(1, -(-counts.get(n, 0) // ROWS)) for n in range(capacity + 1)])
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(parts, (F.col("length") + 1).cast("int"))).cast("int"))
    before = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1).join(before, ["length", "part"])
    shared = docs.sparkSession.sparkContext.broadcast(runs)  # bounded by the capacity, not by the data

    def each(got, _):
        table = shared.value
        length = np.array(got["length"], dtype=np.int64)
        rank = np.array(got["rank"], dtype=np.int64) + np.array(got["before"], dtype=np.int64)
        at = np.searchsorted((table[:, 0] << 48) | table[:, 1], (length << 48) | rank, side="right") - 1
        run = table[at]
        place = rank - run[:, 1]
        return {n: got[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": run[:, 3] + place // run[:, 4], "offset": run[:, 5] + place % run[:, 4] * length}

    return by_batch(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before"), each, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())


SQL = None
