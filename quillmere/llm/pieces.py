r"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut where no piece can span (two neighbouring characters that occur in no piece side by side), which makes
segments: mostly words. The distinct segments of the corpus, with counts, are one relation. Their substrings are exploded,
at each place up to the longest piece that begins with the two characters there, and equi-joined to the piece table (a
fixed vocabulary, so broadcast); the matches are the edges of each segment's lattice, grouped by the segment's hash
without another shuffle. A higher-order aggregate folds the lattice from left to right, keeping for each prefix the last
piece of its best path, and a second fold walks the path back.

The vocabularies here are merge-ordered (BPE), for which the sum of scores is not what defines the encoding. The fold
therefore runs over pairs of neighbouring edges that merging itself would leave apart: a sequence of pieces is the
encoding exactly if each neighbouring pair is the encoding of its own concatenation, so each prefix has one best path.
Which pairs are so is decided once per pair of pieces, by undoing merges on both sides of the border.

Documents are encoded from the table of segments. Its most frequent rows, up to ``broadcast_bytes``, are broadcast as
packed arrays, by 64-bit hashes; documents with rarer segments look those up in a join that shuffles hashes. A character without a piece becomes the
pieces of its UTF-8 bytes. A first space is put before each text, as the vocabulary demands, and taken off in decoding.

Cases: null and empty texts have no pieces, and decode to an empty text; U+2581 is encoded as a space, so a text that
contains it decodes to one with spaces; repeated rows are encoded alike; a very long text is cut as any other; a
segment that can't be cut is encoded whole whatever its length (up to 2 ** 31 characters, as long as an array of its edges
fits in memory), by one task and in proportion to its length; only the column text is read, and a column named ids is
replaced; an empty table stays empty.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, mix64, trim, written

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BROADCAST_BYTES = 96 << 20
STEP = 1 << 18
#: Segments that one task takes, so that their lattices are grouped by hash in bounded memory.
HASH_GROUPS = 16_384
ODD = np.uint64(0x9E3779B97F4A7C17)
#: Steps of a fold whose state is copied from step to step.
FOLD = 512
#: Characters of a segment from which substrings are taken at once.
WINDOW = 4096


def read_model(path: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """The pieces by id, their scores, and what they are: 0 text, 1 byte, 2 control or unknown."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    kinds = [1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0 for i in ids]
    return [m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], kinds


class Vocabulary:
    """The pieces, where texts may be cut, and which pairs of pieces stay apart."""

    def __init__(self, pieces: tuple[str, ...], scores: tuple[float, ...], kinds: tuple[int, ...]):
        self.pieces, self.kinds = pieces, kinds
        text = {p: i for i, p in enumerate(pieces) if kinds[i] == 0}
        order = {s: r for r, s in enumerate(sorted({scores[i] for p, i in text.items() if len(p) > 1}, reverse=True))}
        self.rank = {p: order[scores[i]] if len(p) > 1 else -1 for p, i in text.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        self.ids = {p: i for p, i in text.items() if len(p) == 1 or self._reachable(p)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == 1}
        self.codes, self.flags = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        letters = {c: k + 1 for k, c in enumerate(sorted({c for p in text if len(p) > 1 for c in p}))}
        self.classes = np.zeros(0x110000, dtype=np.uint16)
        for c, k in letters.items():
            self.classes[ord(c)] = k
        inside = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        for p in text:
            for a, b in zip(p, p[1:], strict=False):
                inside[letters[a], letters[b]] = True
        self.inside = np.packbits(inside, axis=1, bitorder="little")

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text: the best-ranked neighbouring pair is merged first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            k = best[1]
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _reachable(self, piece: str) -> bool:
        return self.merged(piece) == [piece]

    def stays_apart(self, left: str, right: str) -> bool:
        """Whether merging leaves left and right as they are when they stand side by side."""
        if left.endswith(MARK * 2) or right.startswith(MARK * 2):  # runs share one rank, so the order of merges counts
            return self.merged(left + right) == [left, right]
        limit = 1 << 60
        while True:
            if self.rank.get(left + right, limit) < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a > b:
                limit, left = a, self.halves[left][1]
            elif b >= 0:
                limit, right = b + 1, self.halves[right][0]
            else:
                return True

    def pairs_apart(self, codes: np.ndarray) -> np.ndarray:
        """stays_apart for pairs of ids, coded left << 32 | right."""
        unique, inverse = np.unique(codes, return_inverse=True)
        new = np.setdiff1d(unique, self.codes, assume_unique=True)
        if len(new):
            flags = np.array([self.stays_apart(self.pieces[c >> 32], self.pieces[c & 0xFFFFFFFF]) for c in new.tolist()], dtype=bool)
            at = np.searchsorted(self.codes, new)
            self.codes, self.flags = np.insert(self.codes, at, new), np.insert(self.flags, at, flags)
        return self.flags[np.searchsorted(self.codes, unique)][inverse]

    def cut(self, texts: list[str]):
        """Characters of all texts (as code points), starts and hashes of their segments, and each text's first segment."""
        joined = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(j) for j in joined], dtype=np.int64)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        kind = self.classes[points]
        cut = np.ones(len(points) + 1, dtype=bool)
        after = kind[1:]
        cut[1:-1] = (self.inside[kind[:-1], after >> 3] >> (after & 7).astype(np.uint8)) & 1 == 0
        cut[firsts] = True
        starts = np.flatnonzero(cut[:-1])
        weights = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        weights = (weights ^ (weights >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
        up, down = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(weights * up[: len(points)], out=sums[1:])
        bounds = np.append(starts, len(points))
        hashes = mix64((sums[bounds[1:]] - sums[bounds[:-1]]) * down[bounds[:-1]] + (bounds[1:] - bounds[:-1]).astype(np.uint64))
        return points, bounds, hashes.view(np.int64), np.searchsorted(starts, firsts)


@lru_cache(maxsize=1)
def vocabulary(pieces: tuple[str, ...], scores: tuple[float, ...], kinds: tuple[int, ...]) -> Vocabulary:
    return Vocabulary(pieces, scores, kinds)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (int(ODD), pow(int(ODD), -1, 1 << 64)):
            row = np.full(max(n, STEP * 2), base, dtype=np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers[0], _powers[1]


def steps(column: pa.Array, limit: int = STEP):
    """The texts of a column in runs of about limit characters, so that the work arrays stay small."""
    run, size = [], 0
    for text in column:
        t = text.as_py() or ""
        if size and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def spelled(points: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> list[str]:
    """The segments at these places, as strings."""
    return [points[bounds[k] : bounds[k + 1]].tobytes().decode("utf-32-le", "surrogatepass") for k in at.tolist()]


@contextmanager
def hash_groups(spark: SparkSession, n: int):
    """Lets a task collect lists for n groups by hash before it sorts; the setting is put back afterwards."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


NODE = "array<struct<id:int,s:int>>"


def best_paths(pairs: Column, longest: int) -> Column:
    """The fold: of each place of a segment, from 0, the last piece of its best path (id, and s, where it starts).

    A fold copies its state at each step, so a long segment is folded in runs of FOLD pairs: the state of a run begins with
    the last `longest` places before it, which is as far as a piece reaches back, and what a run adds is put aside.
    """
    first = F.struct(F.lit(-1).alias("id"), F.lit(0).alias("s"))

    def step(base: Column):
        def grow(state: Column, x: Column) -> Column:
            fits = (F.size(state) + base == x["e"]) & (F.get(state, x["s"] - base)["id"] == x["before"])
            return F.when(fits, F.concat(state, F.array(F.struct(x["id"].alias("id"), x["s"].alias("s"))))).otherwise(state)

        return grow

    def run(state: Column, some: Column) -> Column:
        def kept(grown: Column) -> Column:
            more = F.slice(grown, F.size(state["tail"]) + 1, F.size(grown))
            gone = F.greatest(F.size(grown) - (longest + 1), F.lit(0))
            return F.struct((state["base"] + gone).alias("base"), F.slice(grown, gone + 1, F.size(grown)).alias("tail"), F.concat(state["runs"], F.array(more)).alias("runs"))

        return let(F.aggregate(some, state["tail"], step(state["base"])), kept)

    begin = F.struct(F.lit(0).alias("base"), F.array(first).cast(NODE).alias("tail"), F.array(F.array(first)).cast(f"array<{NODE}>").alias("runs"))
    whole = F.aggregate(pairs, F.array(first), step(F.lit(0)))
    return F.when(F.size(pairs) <= FOLD, whole).otherwise(F.flatten(F.aggregate(runs_of(pairs), begin, run)["runs"]))


def runs_of(values: Column) -> Column:
    """An array cut into arrays of FOLD."""
    last = F.floor((F.size(values) - 1) / FOLD).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * FOLD + 1, F.lit(FOLD)))


def walked_back(best: Column) -> Column:
    """The ids of the whole segment's best path, by a fold from the last place to the first, in runs too."""
    n = F.size(best) - 1

    def walk(at: Column, j: Column) -> Column:
        last = F.get(best, j)
        return F.when(at["pos"] == j, F.struct(last["s"].alias("pos"), F.concat(at["ids"], F.array(last["id"])).alias("ids"))).otherwise(at)

    def from_place(at: Column, places: Column) -> Column:
        return F.aggregate(places, F.struct(at.alias("pos"), F.array().cast("array<int>").alias("ids")), walk)

    def run(state: Column, places: Column) -> Column:
        return let(from_place(state["pos"], places), lambda x: F.struct(x["pos"].alias("pos"), F.concat(state["runs"], F.array(x["ids"])).alias("runs")))

    places = F.sequence(n, F.lit(1), F.lit(-1))
    begin = F.struct(n.alias("pos"), F.array().cast("array<array<int>>").alias("runs"))
    long = F.flatten(F.aggregate(runs_of(places), begin, run)["runs"])
    return F.reverse(F.when(n <= FOLD, from_place(n, places)["ids"]).otherwise(long))


class Encoder:
    """Encodes with one model; path names the model file on the driver."""

    def __init__(self, path: str = MODEL, broadcast_bytes: int = BROADCAST_BYTES):
        pieces, scores, kinds = read_model(path)
        self.key = (tuple(pieces), tuple(scores), tuple(kinds))
        self.broadcast_bytes = broadcast_bytes
        self.longest = max(len(p) for p, k in zip(pieces, kinds, strict=True) if k == 0)

    def segments(self, docs: DataFrame) -> DataFrame:
        """The distinct segments of all texts: segment, h (its hash), n, and alone (a character without a piece)."""
        key = docs.sparkSession.sparkContext.broadcast(self.key)

        def run(batches):
            words = vocabulary(*key.value)
            for batch in batches:
                known, names, keys, sums = np.zeros(0, np.int64), [], [], []
                for texts in steps(batch.column(0)):
                    points, bounds, hashes, _ = words.cut(texts)
                    unique, first, n = np.unique(hashes, return_index=True, return_counts=True)
                    at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
                    new = known[at] != unique if len(known) else np.ones(len(unique), dtype=bool)
                    names += spelled(points, bounds, first[new])
                    keys.append(unique[new])
                    sums.append((unique, n))
                    known = np.sort(np.concatenate([known, unique[new]]))
                keys = np.concatenate(keys) if keys else known
                place = np.argsort(keys)
                total = np.zeros(len(keys), dtype=np.int64)
                for unique, n in sums:
                    total[place[np.searchsorted(known, unique)]] += n
                alone = pa.array([len(s) == 1 and s not in words.ids for s in names], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys), pa.array(total), alone], ["segment", "h", "n", "alone"])
                del names, keys, total, sums, known, alone
                trim()

        parts = docs.select("text").mapInArrow(run, "segment string, h bigint, n bigint, alone boolean")
        return parts.groupBy("segment", "h", "alone").agg(F.sum("n").alias("n"))

    def lattice(self, segments: DataFrame) -> DataFrame:
        """Per segment (h, n) with pieces its edges in order, each coded end << 28 | length << 20 | id."""
        spark, words = segments.sparkSession, vocabulary(*self.key)
        table = spark.createDataFrame(pa.table({"piece": list(words.ids), "id": list(words.ids.values())}), "piece string, id bigint")
        reach: dict[str, int] = {}
        for piece in words.ids:
            if len(piece) > 1:
                reach[piece[:2]] = max(len(piece), reach.get(piece[:2], 0))
        reach = spark.createDataFrame(pa.table({"two": list(reach), "most": list(reach.values())}), "two string, most bigint")
        size = F.length("segment").cast("bigint")
        windows = segments.select("segment", "h", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / WINDOW))).alias("w"))
        windows = windows.select("h", "n", (F.col("w") * WINDOW).alias("at"), F.substring("segment", (F.col("w") * WINDOW + 1).cast("int"), F.lit(WINDOW + self.longest)).alias("part"))
        here = F.least(F.length("part"), F.lit(WINDOW))
        starts = windows.select("h", "n", "at", "part", F.explode(F.sequence(F.lit(1), here)).alias("k"))
        starts = starts.select("h", "n", (F.col("at") + F.col("k") - 1).alias("s"), F.substring("part", F.col("k"), F.lit(self.longest)).alias("rest"))
        starts = starts.withColumn("two", F.substring("rest", 1, 2)).join(F.broadcast(reach), "two", "left")
        lengths = F.sequence(F.lit(1), F.least(F.coalesce("most", F.lit(1)), F.length("rest")).cast("int"))
        spans = starts.select("h", "n", "s", "rest", F.explode(lengths).alias("l"))
        spans = spans.select("h", "n", "s", "l", F.substring("rest", F.lit(1), F.col("l")).alias("piece"))
        edges = spans.join(F.broadcast(table), "piece")
        code = (F.col("s") + F.col("l")) * (1 << 28) + F.col("l").cast("bigint") * (1 << 20) + F.col("id")
        return edges.groupBy("h", "n").agg(F.sort_array(F.collect_list(code)).alias("edges"))

    def encoded_segments(self, segments: DataFrame) -> DataFrame:
        """h, n and the piece ids of each segment."""
        key = segments.sparkSession.sparkContext.broadcast(self.key)
        kind = pa.struct([(x, pa.int32()) for x in ("e", "s", "before", "id")])

        @F.arrow_udf("array<struct<e:int,s:int,before:int,id:int>>")
        def pairs(edges: pa.Array) -> pa.Array:
            words = vocabulary(*key.value)
            flat = edges.flatten().to_numpy(zero_copy_only=False)
            end, piece = flat >> 28, flat & 0xFFFFF
            start = end - (flat >> 20 & 0xFF)
            word = np.repeat(np.arange(len(edges)), pa.compute.list_value_length(edges).to_numpy(zero_copy_only=False))
            ends, starts = word << 36 | end, word << 36 | start  # the edges are in the order of their ends
            low, high = np.searchsorted(ends, starts, "left"), np.searchsorted(ends, starts, "right")
            count = np.where(start > 0, high - low, 0)
            right = np.repeat(np.arange(len(flat)), count)
            left = np.arange(len(right)) - np.repeat(np.cumsum(count) - count - low, count)
            apart = words.pairs_apart(piece[left] << 32 | piece[right])
            first = np.flatnonzero(start == 0)
            right = np.concatenate([first, right[apart]])
            before = np.concatenate([np.full(len(first), -1), piece[left[apart]]])
            order = np.argsort(ends[right], kind="stable")
            right, before = right[order], before[order]
            trim()
            fields = [pa.array(x.astype(np.int32)) for x in (end[right], start[right], before, piece[right])]
            offsets = np.searchsorted(word[right], np.arange(len(edges) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(kind)))

        folded = self.lattice(segments.where("not alone")).withColumn("pairs", pairs("edges"))
        folded = folded.select("h", "n", let(best_paths(F.col("pairs"), self.longest), walked_back).alias("ids"))
        # a character without a piece is a segment of its own
        low = vocabulary(*self.key).bytes[0]
        code = F.hex(F.encode("segment", "UTF-8"))
        spelt = F.transform(F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int") + low)
        return folded.unionByName(segments.where("alone").select("h", "n", spelt.alias("ids")))

    def encoded(self, docs: DataFrame) -> DataFrame:
        """docs with ids, the piece ids of each text."""
        context = docs.sparkSession.sparkContext
        segments = written(self.segments(docs))
        tasks = segments.count() // HASH_GROUPS + 1
        with hash_groups(docs.sparkSession, 2 * HASH_GROUPS):
            table = written(self.encoded_segments(segments.repartition(tasks, "h")))
        wide = len(self.key[0]) > 1 << 16
        weight = F.size("ids") * (4 if wide else 2) + 16  # as packed: a hash, an offset, and the ids
        total = table.agg(F.sum(weight).alias("b"), F.count("*").alias("n")).first()
        head = table if (total["b"] or 0) <= self.broadcast_bytes else table.orderBy(F.desc("n"), "h").limit(int(self.broadcast_bytes / (total["b"] / total["n"])))
        arrays = pack(head.select("h", id_bytes(F.col("ids"), wide).alias("b")).orderBy("h").toArrow(), wide)
        trim()
        packed = context.broadcast(arrays)
        del arrays
        trim()
        key = context.broadcast(self.key)

        @F.arrow_udf("struct<ids:array<int>,rare:array<bigint>>")
        def encode(column: pa.Array) -> pa.Array:
            words, (known, offsets, flat) = vocabulary(*key.value), packed.value
            ids, ends, rare, rare_ends = [], [0], [], [0]
            for texts in steps(column):
                points, bounds, hashes, firsts = words.cut(texts)
                unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
                hit = known[at] == unique if len(known) else np.zeros(len(unique), dtype=bool)
                sizes = np.where(hit, offsets[at + 1] - offsets[at], 1)[inverse] if len(known) else np.ones(len(inverse), np.int64)
                stops = np.cumsum(sizes)
                begin = np.where(hit, offsets[at], 0)[inverse] if len(known) else np.zeros(len(inverse), np.int64)
                source = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - sizes - begin, sizes)
                out = flat[np.minimum(source, max(len(flat) - 1, 0))].astype(np.int32) if len(flat) else np.zeros(len(source), np.int32)
                missing = np.flatnonzero(~hit[inverse])
                text_of = np.searchsorted(firsts, missing, "right") - 1
                edges = np.concatenate([[0], stops])[firsts]
                counts = np.bincount(text_of, minlength=len(texts))
                rank = np.arange(len(missing)) - np.repeat(np.cumsum(counts) - counts, counts)
                out[stops[missing] - 1] = -1 - rank
                ids.append(out)
                ends += (ends[-1] + edges[1:]).tolist()
                rare.append(hashes[missing])
                rare_ends += (rare_ends[-1] + np.cumsum(counts)).tolist()
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            del ids
            trim()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            return pa.StructArray.from_arrays([lists, pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)))], ["ids", "rare"])

        out = docs.withColumn("__x", encode(F.coalesce(F.col("text"), F.lit(""))))
        if (total["b"] or 0) <= self.broadcast_bytes:
            return out.withColumn("ids", F.col("__x.ids")).drop("__x")
        return self._filled(written(out), table)

    @staticmethod
    def _filled(rows: DataFrame, table: DataFrame) -> DataFrame:
        """Puts the ids of rare segments, from a join by their hashes, in the places left for them.

        Rows are named by two hashes of what they hold; only those with rare segments are shuffled.
        """
        names = ["__k1", "__k2"]
        whole = rows.where(F.size("__x.rare") == 0).withColumn("ids", F.col("__x.ids")).drop("__x")
        rows = rows.where(F.size("__x.rare") > 0)
        for k, name in enumerate(names):
            rows = rows.withColumn(name, F.xxhash64(F.lit(k), "__x.rare", "__x.ids"))
        known = rows.select(*names, "__x.rare").dropDuplicates(names)
        known = known.select(*names, F.posexplode("rare").alias("k", "h")).join(table.select("h", F.col("ids").alias("found")), "h")
        known = known.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "found"))), lambda x: x["found"]).alias("__found"))
        ids = F.flatten(F.transform(F.col("__x.ids"), lambda i: F.when(i >= 0, F.array(i)).otherwise(F.get(F.col("__found"), -1 - i))))
        filled = rows.join(known, names).withColumn("ids", ids).drop("__x", "__found", *names)
        return whole.unionByName(filled)

    def decoded(self, ids: Column) -> Column:
        """The text of an array of piece ids."""
        pieces, _, kinds = self.key
        spelt = ["" if k == 2 else p[3:5] if k == 1 else p.replace(MARK, " ").encode().hex() for p, k in zip(pieces, kinds, strict=True)]
        table = F.split(F.lit(",".join(spelt)), ",")  # one literal for the driver, folded to the array
        text = F.decode(F.unhex(F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.get(table, i)), "")), "UTF-8")
        return F.when(text.startswith(" "), F.substring(text, 2, (1 << 31) - 1)).otherwise(text)


def id_bytes(ids: Column, wide: bool) -> Column:
    """Ids as one binary, 2 or 4 bytes each, high byte first."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 8 if wide else 4, "0")), ""))


def pack(table: pa.Table, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments in the order of their hashes: the hashes, offsets into their ids, and the ids."""
    kind = np.dtype("u4" if wide else "u2")
    known, ends, flat, at = np.empty(len(table), np.int64), np.zeros(len(table) + 1, np.int64), [], 0
    for batch in table.to_batches():
        column, n = batch.column(1), len(batch)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int32)
        known[at : at + n] = batch.column(0).to_numpy()
        ends[at + 1 : at + n + 1] = ends[at] + (offsets[1:] - offsets[0]) // kind.itemsize
        if n:
            flat.append(np.frombuffer(column.buffers()[2], kind.newbyteorder(">"))[offsets[0] // kind.itemsize : offsets[-1] // kind.itemsize].astype(kind))
        at += n
    return known, ends, np.concatenate(flat) if flat else np.zeros(0, kind)
