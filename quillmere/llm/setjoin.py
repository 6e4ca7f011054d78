r"""Exact Jaccard join of shingle sets by set relations, reduced to links and connected components.

Equal sets are one class. Candidates: two linked sets of sizes a <= b differ in at most ``a * (1 - t) / t`` elements, so if
the hash space is cut into more parts than that, some part is equal in both. Sets share a table of parts by size interval,
and each emits the hashes of its parts for its own interval and the one below. A part says little if it holds no element
or one: so a set whose parts of ``FILLED`` elements or more outnumber its possible differences emits these only, since
then one of the equal parts is such. A set that fails this in one cut of the space emits its filled parts there and is
cut again by another hash, up to ``CUTS`` times: of two linked sets, one of which passes at some cut, the other has
emitted its filled parts there too, and if neither ever passes, both emit parts of one element and empty ones at the end.
Each cut has a few parts to spare, so the chance of a set to come that far falls as a power of ``CUTS``: empty parts don't
make candidates of unrelated sets, whatever their number. Where parts would hold under 8 elements the space is cut finer,
to MEAN elements a part at the top of an interval.

Sets that share a part are candidate neighbours, and the connected components of these are the units of work. Sets that
share a passage and nothing else can be chained to one large component, by parts that hold passage elements only. So the
sets of a component above ``WHOLE`` blocks of ``block`` sets are looked at again, by a prefix filter (`refined`): in the order of how many of
them have an element, a set keeps as many of its rarest elements as a linked set must share one of. Elements that no other
set has come first, and where they fill the prefix the set is linked with nothing. Sets that share a prefix element make
finer components. Of each either the sets are cut into blocks, each pair of blocks being a unit, as in smaller components, or each
prefix element makes a unit of the sets that have it, and a pair counts in the unit of its first common element; whichever
sends fewer sets. The second way grows in proportion to the sets, whatever chains them. So no group ever meets in one task,
and nothing is capped.

Within a unit the join skips by set relations. Index lists are kept in blocks of equal size and position. Of a set's lists
only the blocks are read whose size and position leave enough elements for ``1 - 2 * (1 - t)`` of similarity: by the
triangle inequality of the Jaccard distance, these hold all answers of the set and of all sets that are linked with it.
So once a set's overlaps are computed, those of each linked set are derived from them: only the lists of the elements in
which the two differ are read. Units return a spanning forest of the links and the number of links of each set, never all
pairs.

Shingles, sets and parts are identified by 64-bit hashes. Cases: null or empty texts have an empty set and link with
nothing; texts of fewer words than a shingle are one shingle; equal ids are rows of one document, judged by row; a null
id is never the name of a component unless all its members' are null; a very long text is one set, of 8 bytes a word in
memory; only doc_id and text are read, so other columns' names can't clash; an empty table stays empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_filter, maybe_in, mix64, same, spread_join, written
from .graph import components
from .wordhash import WordHasher, pieces, shingles

WIDTH, NUM, DEN = 3, 90, 100
BLOCK = 1024
#: Elements a part at the top of a size interval, where the hash space is cut finer.
MEAN = 2.5
#: Candidate documents up to this number (16 bytes each) are broadcast to find their texts; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
SALT = np.uint64(0x5851F42D4C957F2D)
#: Blocks of a component whose pairs are compared without a further look: 10 pairs at most.
WHOLE = 4
#: Elements of sets that a task explodes at once.
ELEMENTS = 1 << 20
#: Elements that a telling part has at least, and how often a set is cut anew for enough of them.
FILLED, CUTS = 2, 8


def sets_of(texts: list[bytes], hasher: WordHasher, width: int):
    """The sorted distinct shingle hashes of each text."""
    for a, b in pieces(texts):
        words, at = hasher.words(texts[a:b])
        for k in range(b - a):
            yield np.unique(shingles(words[at[k] : at[k + 1]], width))


def intervals(largest: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """Size intervals (from, to, parts) from the least size that can link with another set."""
    low = -(-num // (den - num))
    out = []
    while not out or out[-1][1] < largest:
        high = max(low, low * den // num)
        parts = high * (den - num) // num + 1
        if num < 8 * (den - num):
            parts = max(parts, int(high / MEAN))
        else:
            # parts to spare for those that chance leaves with fewer than FILLED elements
            load = high / parts
            poor = parts * math.exp(-load) * (1 + load)
            parts += int(poor + 4 * math.sqrt(poor))
        out.append((low, high, parts))
        low = high + 1
    return out


def part_hashes(values: np.ndarray, table: list[tuple[int, int, int]], tops: np.ndarray, num: int, den: int) -> np.ndarray:
    """The hashes of the parts that a sorted set emits in its own interval and the one below."""
    n, out = len(values), []
    own = int(np.searchsorted(tops, n))
    # the most elements in which a linked set can differ, the smaller of the two lying in interval k
    open_in = [(own, n * (den - num) // num)] + ([(own - 1, (n + table[own - 1][1]) * (den - num) // (den + num))] if own else [])
    for cut in range(CUTS):
        if cut:
            values = np.sort(mix64(values ^ SALT))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix64(values ^ SALT), out=sums[1:])
        left = []
        for k, most in open_in:
            parts = table[k][2]
            edges = (np.arange(parts + 1, dtype=np.float64) * (2.0**64 / parts)).clip(0, 2.0**64 - 2048).astype(np.uint64)
            at = np.searchsorted(values, edges)
            at[0], at[-1] = 0, n
            name = np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((k + 1) * CUTS + cut)
            hashes, held = mix64(mix64(sums[at[1:]] - sums[at[:-1]]) + mix64(name)), np.diff(at)
            filled = held >= FILLED
            if np.count_nonzero(filled) > most:
                out.append(hashes[filled])
            elif cut < CUTS - 1:
                out.append(hashes[filled])
                left.append((k, most))
            else:
                out.append(hashes[held >= 1] if np.count_nonzero(held) > most else hashes)
        open_in = left
        if not open_in:
            break
    return np.concatenate(out)


def summaries(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, th (the text's hash), n_shingles, node (the set's hash), parts. A set met before in its batch emits no parts again."""
    least = -(-num // (den - num))

    def run(batches):
        hasher, table, tops = WordHasher(), [], np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).fill_null(b"").to_pylist()
            sizes, nodes, parts, ends, seen = [], [], [], [0], set()
            for values in sets_of(texts, hasher, width):
                n = len(values)
                if n and (not table or table[-1][1] < n):
                    table = intervals(n, num, den)
                    tops = np.array([t[1] for t in table])
                node = int(mix64(mix64(values).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).view(np.int64)[0])
                sizes.append(n)
                nodes.append(node)
                if n >= least and node not in seen:
                    seen.add(node)
                    parts.append(part_hashes(values, table, tops, num, den))
                    ends.append(ends[-1] + len(parts[-1]))
                else:
                    ends.append(ends[-1])
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), lists], ["doc_id", "th", "n_shingles", "node", "parts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th bigint, n_shingles bigint, node bigint, parts array<bigint>")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of all runs from starts to ends, one after another."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)


class Index:
    """The inverted lists of a unit's sets, in blocks of equal size and position."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.order = np.array(sorted(range(len(sets)), key=lambda k: len(sets[k])))
        self.sizes = np.array([len(sets[k]) for k in self.order])
        tokens, inverse, df = np.unique(np.concatenate([sets[k] for k in self.order]), return_inverse=True, return_counts=True)
        rank = np.empty(len(tokens), dtype=np.int64)
        rank[np.argsort(df, kind="stable")] = np.arange(len(tokens))
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.rows = [np.sort(rank[inverse[starts[k] : starts[k + 1]]]) for k in range(len(self.order))]
        token, owner = np.concatenate(self.rows), np.repeat(np.arange(len(self.order)), self.sizes)
        place = np.arange(len(token)) - np.repeat(starts[:-1], self.sizes)
        by = np.lexsort((place, self.sizes[owner], token))
        token, place, self.owner = token[by], place[by], owner[by]
        size = self.sizes[self.owner]
        first = np.ones(len(token), dtype=bool)
        first[1:] = (token[1:] != token[:-1]) | (size[1:] != size[:-1]) | (place[1:] != place[:-1])
        self.block = np.append(np.flatnonzero(first), len(token))
        self.block_size, self.block_place = size[first], place[first]
        self.lists = np.searchsorted(token, np.arange(len(tokens) + 1))
        self.blocks = np.searchsorted(token[first], np.arange(len(tokens) + 1))

    def reached(self, k: int, places: int, num: int, den: int) -> np.ndarray:
        """The owners in the blocks of the first places of set k's lists that can reach a similarity of num / den."""
        row = self.rows[k][:places]
        n, low, high = len(self.rows[k]), self.blocks[row], self.blocks[row + 1]
        at, i = spans(low, high), np.repeat(np.arange(len(row)), high - low)
        size, j = self.block_size[at], self.block_place[at]
        most = np.minimum(i, j) + 1 + np.minimum(n - i - 1, size - j - 1)
        at = at[(den + num) * most >= num * (n + size)]
        return self.owner[spans(self.block[at], self.block[at + 1])]

    def counts(self, elements: np.ndarray) -> np.ndarray:
        """How many of the elements each set has."""
        return np.bincount(self.owner[spans(self.lists[elements], self.lists[elements + 1])], minlength=len(self.rows))

    def answers(self):
        """Of each set with candidates, its place and those of the sets linked with it, itself included."""
        num, den = self.num, self.den
        done = np.zeros(len(self.rows), dtype=bool)

        def hits(k: int, overlap: np.ndarray) -> np.ndarray:
            done[k] = True
            return np.flatnonzero(den * overlap >= num * (self.sizes + len(self.rows[k]) - overlap))

        for k, row in enumerate(self.rows):
            if done[k] or not (self.reached(k, len(row) - -(-num * len(row) // den) + 1, num, den) != k).any():
                continue
            # whole for all sets that a set linked with k can be linked with
            overlap = np.bincount(self.reached(k, len(row), max(1, 2 * num - den), den), minlength=len(self.rows))
            near = hits(k, overlap)
            yield k, near
            for y in near[~done[near]].tolist():
                derived = overlap
                if len(gone := np.setdiff1d(row, self.rows[y], assume_unique=True)):
                    derived = derived - self.counts(gone)
                if len(come := np.setdiff1d(self.rows[y], row, assume_unique=True)):
                    derived = derived + self.counts(come)
                yield y, hits(y, derived)


def linked_sets(sets: list[np.ndarray], num: int, den: int, weights: np.ndarray, sides: np.ndarray, prefixes: list | None = None, bucket: int = 0) -> tuple[Forest, np.ndarray]:
    """The forest of the links among sets, and each set's links to sets of another side, each counted by its weight.

    With prefixes, a link counts only where bucket is the first element that both prefixes have.
    """
    index, forest, n_links = Index(sets, num, den), Forest(len(sets)), np.zeros(len(sets), dtype=np.int64)
    for k, near in index.answers():
        me, others = int(index.order[k]), index.order[near]
        others = others[others != me]
        for other in others.tolist():
            forest.join(me, other)
        others = others[sides[others] != sides[me]]
        if prefixes is not None:
            first = [prefixes[me][np.isin(prefixes[me], prefixes[other]).argmax()] for other in others.tolist()]
            others = others[np.array(first, dtype=np.int64) == bucket]
        n_links[me] = weights[others].sum()
    return forest, n_links


def units(base: DataFrame, block: int) -> DataFrame:
    """Per set with candidates: node, unit, blocks, and the row that shows its text (doc_id, th), with its copies."""
    parts = base.select("node", F.explode("parts").alias("part"))
    hubs = written(parts.groupBy("part").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    # parts of one set only are dropped before they are shuffled again
    shared = maybe_in(parts, F.col("part"), key_filter(hubs.select(F.col("part").alias("h")))).where("__maybe").select("node", "part")
    stars = spread_join(shared, hubs, "part").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    stars = components(stars)
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("unit")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("unit")).distinct())
    members = written(members)
    sizes = written(members.groupBy("unit").agg(F.count("*").alias("n")))
    members = spread_join(members, sizes, "unit").select("node", "unit", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    first = base.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("shown"), F.count("*").alias("copies"))
    return written(members.join(first, "node").select("node", "unit", "blocks", "shown.doc_id", "shown.th", "copies"))


def elements_of(sets: DataFrame) -> DataFrame:
    """Per element of each set: node, size, h, which tells the element and the unit."""

    def run(batches):
        for batch in batches:
            flat, units, nodes = [], batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = [np.frombuffer(b, dtype=np.uint64) for b in batch.column(2).to_pylist()]
            salts, held, low = mix64(units.view(np.uint64)), 0, 0
            for k, row in enumerate(rows):
                flat.append(mix64(row ^ salts[k]))
                held += len(row)
                if held > ELEMENTS or k == len(rows) - 1:
                    sizes = np.array([len(r) for r in rows[low : k + 1]])
                    columns = [np.repeat(nodes[low : k + 1], sizes), np.repeat(sizes, sizes), np.concatenate(flat).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "size", "h"])
                    flat, held, low = [], 0, k + 1

    return sets.select("unit", "node", "elements").mapInArrow(run, "node bigint, size bigint, h bigint")


def refined(sets: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Of the sets (unit, node, elements) of large units: node, unit, bucket, blocks, prefix; sets without candidates are left out.

    bucket is 0 and prefix null in the units of a component. In those of a prefix element, bucket is that element and
    prefix has the set's prefix in the common order.
    """
    rows = written(elements_of(sets))
    counts = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    shared = maybe_in(rows, F.col("h"), key_filter(counts.select("h"))).where("__maybe").drop("__maybe")
    by_set = spread_join(shared, counts, "h").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("x"))
    # a linked set shares num / den of the elements or more, so one of so many; the elements of no other set come first
    left = F.col("size") - F.ceil(F.col("size") * num / den) + 1 - (F.col("size") - F.size("x"))
    cut = by_set.withColumn("left", left.cast("int")).where("left > 0")
    prefixes = written(cut.select("node", F.transform(F.slice("x", F.lit(1), F.col("left")), lambda e: e["h"]).alias("prefix")))
    entries = prefixes.select("node", F.explode("prefix").alias("h"))
    hubs = written(entries.groupBy("h").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    entries = written(spread_join(entries, hubs, "h"))
    stars = components(entries.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct())
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("unit")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("unit")).distinct())
    # how many sets either way sends: each to all blocks, or to the units of its elements
    sent = entries.groupBy("node").agg(F.sum(F.ceil(F.col("n") / block)).alias("sent"))
    members = written(members.join(sent, "node"))
    sizes = members.groupBy("unit").agg(F.count("*").alias("n"), F.sum("sent").alias("sent"))
    blocks = F.ceil(F.col("n") / block)
    sizes = written(sizes.select("unit", "n", blocks.cast("int").alias("blocks"), (F.col("n") * blocks > F.col("sent")).alias("apart")))
    members = written(spread_join(members.select("node", "unit"), sizes, "unit").select("node", "unit", "blocks", "apart"))
    whole = members.where("not apart").select("node", "unit", F.lit(0).cast("bigint").alias("bucket"), "blocks", F.lit(None).cast("array<bigint>").alias("prefix"))
    alone = entries.join(members.where("apart").select("node"), "node").join(prefixes, "node")
    return whole.unionByName(alone.select("node", F.col("h").alias("unit"), F.col("h").alias("bucket"), F.ceil(F.col("n") / block).cast("int").alias("blocks"), "prefix"))


def unit_sets(docs: DataFrame, base: DataFrame, width: int, num: int, den: int, block: int) -> DataFrame:
    """The sets with candidates, once for each of their units: unit, bucket, blocks, prefix, node, copies, elements."""
    chosen = units(base, block)
    n, most = chosen.agg(F.count("*"), F.max("blocks")).first()
    small = n <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    if not small:
        texts = maybe_in(texts, F.xxhash64("doc_id", "th"), key_filter(chosen.select(F.xxhash64("doc_id", "th").alias("h")))).where("__maybe").drop("__maybe")
        texts = texts.dropDuplicates(["doc_id", "th"])  # repeats of a row are dropped before the shuffle
    hits = texts.join(F.broadcast(chosen) if small else chosen, same(texts, chosen, ["doc_id", "th"]))

    def values(batches):
        hasher, seen = WordHasher(), set()
        for batch in batches:
            batch = batch[~batch["node"].duplicated() & ~batch["node"].isin(seen)]
            seen.update(batch["node"])
            texts = batch["text"].map(lambda t: (t or "").encode("utf-8", "surrogatepass")).tolist()
            sets = list(sets_of(texts, hasher, width))
            nodes = [int(mix64(mix64(v).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(v))).view(np.int64)[0]) for v in sets]
            out = batch[["unit", "blocks", "node", "copies"]].assign(elements=[v.tobytes() for v in sets])
            yield out[[a == b for a, b in zip(nodes, batch["node"], strict=True)]]

    sets = hits.select("unit", "blocks", "node", "copies", "text").mapInPandas(values, "unit bigint, blocks int, node bigint, copies bigint, elements binary")
    sets, whole = sets.dropDuplicates(["node"]), {"bucket": F.lit(0).cast("bigint"), "prefix": F.lit(None).cast("array<bigint>")}
    if not most or most <= WHOLE:
        return sets.withColumns(whole)
    sets = written(sets)
    small, large = F.col("blocks") <= WHOLE, F.col("blocks") > WHOLE
    again = refined(sets.where(large), num, den, block)
    return sets.where(small).withColumns(whole).unionByName(sets.where(large).drop("unit", "blocks").join(again, "node"))


def links(docs: DataFrame, base: DataFrame, width: int, num: int, den: int, block: int) -> DataFrame:
    """Rows (u, v, links): star edges between the nodes of linked sets, or of one node u its links in one unit."""
    sets = unit_sets(docs, base, width, num, den, block)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    cut = sets.withColumn("own", own).withColumn("pair", F.explode(pairs)).select("unit", "bucket", "pair.i", "pair.j", "own", "node", "copies", "elements", "prefix")

    def join(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].to_numpy()
        if len(nodes) < 2:
            return pd.DataFrame({"u": [], "v": [], "links": []}, dtype="int64")
        # between two blocks, only the links across count; within one, all
        sides = group["own"].to_numpy() if group["i"].iat[0] != group["j"].iat[0] else np.arange(len(nodes))
        sets = [np.frombuffer(b, dtype=np.uint64) for b in group["elements"]]
        prefixes = list(group["prefix"]) if group["bucket"].iat[0] else None
        forest, n_links = linked_sets(sets, num, den, group["copies"].to_numpy(), sides, prefixes, group["bucket"].iat[0])
        roots = np.array([forest.root(k) for k in range(len(nodes))])
        some = (roots != np.arange(len(nodes))) | (n_links > 0)
        return pd.DataFrame({"u": nodes[some], "v": nodes[roots[some]], "links": n_links[some]})

    return cut.groupBy("unit", "bucket", "i", "j").applyInPandas(join, "u bigint, v bigint, links bigint")


def classes(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, block: int = BLOCK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, n_links (other rows whose sets are linked with its own)."""
    base = written(summaries(docs, width, num, den))
    found = written(links(docs, base, width, num, den, block))
    edges = components(found.select("u", "v"))
    least = F.min("doc_id").alias("doc_id")
    nodes = base.where("n_shingles > 0").groupBy("node").agg(least, F.count("*").alias("n"))
    nodes = nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    nodes = nodes.join(found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    # of sets that stand alone neither the name nor the links need a join
    linked = written(nodes.where("root is not null or links is not null or n > 1").withColumn("root", F.coalesce("root", "node")))
    names = written(linked.groupBy("root").agg(F.min("doc_id").alias("name"), F.count("*").alias("n")))
    named = spread_join(linked.select("node", "root", "links", F.col("n").alias("copies")), names, "root")
    table = written(named.select("node", "name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n")))
    rows = spread_join(base.select("doc_id", "n_shingles", "node"), table, "node", "left")
    full = F.col("n_shingles") > 0
    own = F.when(full, F.coalesce("name", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.when(full, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
