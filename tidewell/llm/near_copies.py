"""Near copies by word shingles, for the pipeline's near-dedup stage: five words, Jaccard similarity 0.8 or more.

Two sets with similarity 0.8 share one of their prefixes, the fifth (and one more) of their shingles with the least hashes; so
texts meet under the hashes of their prefixes, and nothing else is compared. Keys with the same texts count once. What meets is
sorted out by SimHash over the distinct shingles, 256 bits wide: two sets with similarity 0.8 differ in about 39 bits (48 for the
smallest ones, four shingles and five), texts with nothing in common in 128; RADIUS lies beyond the one by more than three standard
deviations and below the other by seven. At such a radius vantage points can't tell apart texts that have nothing in common, which is
why the prefixes, and not the upper levels of a tree, name the shards. Within a shard the search is a vantage-point tree: a node takes
one of its own texts as vantage point and the distance from it that leaves least to compare; pairs across that distance lie, by the
triangle inequality, in the two bands within RADIUS of it. So a group of near copies is told from others without comparing them, and no
pair within RADIUS is lost. Nodes of few pairs, and those that no vantage point splits, compare outright. Keys of up to FEW texts are
leaves, joined with themselves; a key of more is dealt into shards of bounded size, and a shard returns a spanning forest.

A candidate is linked only after its shingles themselves have been compared. At first only the forest of a large key's candidates
is, nearest pairs first; where each of its pairs holds, the group is settled, so that a group of many near copies costs as many
checks as it has members. Groups with a pair that doesn't hold are dealt into shards with their members' texts, where all
candidates that aren't linked yet are compared by them; a shard returns a spanning forest of what holds, and no candidate is left out.

Defined cases: as in simhash; texts with equal sets of shingles are near copies, so empty and null texts are each other's; a very
long text is held by a task in whole, and its prefix is a fifth of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import numbered, text_batches, written
from tidewell.llm.graph import components

#: Words of a shingle, Jaccard similarity of near copies as a fraction, the hash's seed.
SHINGLE, SIMILAR, SEED = 5, (4, 5), 42
#: 64-bit words of a fingerprint, the most bits that differ in the first word and in all.
WORDS, FIRST, RADIUS = 4, 24, 70
#: Texts of a key that is joined with itself; members of a part of which two make a shard, without and with their texts.
FEW, GROUP, OPEN_GROUP = 32, 20_000, 10_000
#: Pairs that a node of the vantage-point tree compares outright; vantage points tried for a node, and the part of its comparisons that a
#: split may leave at most.
LEAF, VANTAGES, WORTH = 1 << 16, 3, 0.9
#: Pairs compared at once; candidates held before they are thinned out to a forest.
BLOCK, HELD = 1 << 20, 1 << 20
PRINT = [f"f{k}" for k in range(WORDS)]


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Shingles of a text in order; one of all its words where they are fewer."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return [b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    parts = shingles(text)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, [SEED] * len(parts)), np.uint64, len(parts)))


def similar(a: str | None, b: str | None) -> bool:
    """Are both texts near copies? Compares the shingles themselves."""
    x, y = set(shingles(a)), set(shingles(b))
    shared = len(x & y)
    return x == y or SIMILAR[1] * shared >= SIMILAR[0] * (len(x) + len(y) - shared)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of WORDS words over distinct shingle hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):
        h = hashes[at : at + 255, None] + np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def prefix(hashes: np.ndarray) -> np.ndarray:
    """Least of the sorted distinct hashes, one of which every similar set has among its own."""
    n = len(hashes)
    return hashes[: n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1] if n else hashes


def with_prints(docs: DataFrame) -> DataFrame:
    """row, size (distinct shingles), h1, h2 (of their set), keys (its prefix) and the fingerprint's words of docs (row, text)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, sums, fps, keys = [], [], [], []
            for text in b["text"]:
                h = shingle_hashes(text)
                sizes.append(len(h))
                sums.append(divmod(xxhash.xxh3_128_intdigest(h.tobytes()), 1 << 64))
                fps.append(fingerprint(h))
                keys.append(prefix(h).view(np.int64))
            both, words = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64), np.array(fps, np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pd.DataFrame({"row": b["row"], "size": np.array(sizes, np.int64), "h1": both[:, 0], "h2": both[:, 1], "keys": keys} | {c: words[:, k] for k, c in enumerate(PRINT)})

    return docs.select("row", "text").mapInPandas(of, "row long, size long, h1 long, h2 long, keys array<long>, " + ", ".join(f"{c} long" for c in PRINT))


def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in both arrays of fingerprints and bits between them, of pairs within the radii."""
    i, j = np.nonzero(np.bitwise_count(a[:, 0][:, None] ^ b[:, 0][None, :]) <= FIRST)
    d = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64)
    near = d <= RADIUS
    return i[near], j[near], d[near]


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of pairs that link what all pairs link, without a circle; near pairs first."""
    root, order, kept = np.arange(n), np.argsort(d, kind="stable"), []
    while True:
        ri, rj = root[i[order]], root[j[order]]
        apart = ri != rj
        if not apart.any():
            return np.concatenate(kept) if kept else order[:0]
        order, high, low = order[apart], np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart]
        ends, first = np.unique(high, return_index=True)
        kept.append(order[first])
        root = root.copy()
        root[ends] = low[first]
        while not np.array_equal(root, up := root[root]):
            root = up


def split(fp: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray | None]] | None:
    """The parts of a node of the vantage-point tree, which hold all its pairs within RADIUS, each once; None where no vantage point and
    distance tried leaves much less to compare. a, b: places, b None where pairs within a are looked for."""
    best, whole = None, len(a) * len(a) / 2 if b is None else len(a) * len(b)
    for k in range(1, VANTAGES + 1):
        v = fp[a[len(a) * k // (VANTAGES + 1)]]
        da, db = (None if x is None else np.bitwise_count(fp[x] ^ v).sum(axis=1, dtype=np.int64) for x in (a, b))
        # up to each distance: how many are near, how many of these within RADIUS of the far side, and the reverse
        mid = np.arange(64 * WORDS + 1)
        near, inner, outer = zip(*([np.searchsorted(d, at, "right") for at in (mid, mid - RADIUS, mid + RADIUS)] for x in (da, db) if x is not None for d in [np.sort(x)]), strict=True)
        n, edge, beyond = near[0], near[0] - inner[0], outer[0] - near[0]
        if b is None:
            cost = n * n / 2 + (len(a) - n) ** 2 / 2 + edge * beyond
        else:
            m, edge_b, beyond_b = near[1], near[1] - inner[1], outer[1] - near[1]
            cost = n * m + (len(a) - n) * (len(b) - m) + edge * beyond_b + beyond * edge_b
        at = int(np.argmin(cost))
        if cost[at] <= WORTH * whole and (best is None or cost[at] < best[0]):
            best = cost[at], at, da, db
    if best is None:
        return None
    _, mid, da, db = best
    na, edge, beyond = da <= mid, da > mid - RADIUS, da <= mid + RADIUS
    if b is None:
        return [(a[na], None), (a[~na], None), (a[na & edge], a[~na & beyond])]
    nb, edge_b, beyond_b = db <= mid, db > mid - RADIUS, db <= mid + RADIUS
    return [(a[na], b[nb]), (a[~na], b[~nb]), (a[na & edge], b[~nb & beyond_b]), (a[~na & beyond], b[nb & edge_b])]


def leaves(fp: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Left and right places, the same where pairs within them are meant, that are compared outright."""
    nodes = [(a, b)]
    while nodes:
        a, b = nodes.pop()
        right = a if b is None else b
        if len(a) and len(right) and (b is not None or len(a) > 1):
            parts = split(fp, a, b) if len(a) * len(right) > LEAF else None
            if parts is None:
                yield a, right
            else:
                nodes += parts


def near_blocks(rows: pd.DataFrame, crossing: bool) -> Iterator[np.ndarray]:
    """Left places, right places and bits of the candidates of different groups among a shard's rows (size, group, side, fingerprint),
    sorted by size, in blocks: a vantage-point tree over the fingerprints says what is compared."""
    size, group = (rows[c].to_numpy(np.int64) for c in ("size", "group"))
    fp, side = rows[PRINT].to_numpy(np.int64).view(np.uint64), rows["side"].to_numpy()
    for left, right in leaves(fp, np.nonzero(side == 0)[0], np.nonzero(side == 1)[0] if crossing else None):
        at = 0
        while at < len(left):
            own = left[at : at + max(1, BLOCK // len(right))]
            at += len(own)
            lo = -(-size[own[0]] * SIMILAR[0] // SIMILAR[1])
            window = right[np.searchsorted(size[right], lo) : np.searchsorted(size[right], size[own[-1]] * SIMILAR[1] // SIMILAR[0], "right")]
            if right is left:
                window = window[window > own[0]]
            i, j, d = close(fp[own], fp[window])
            i, j = own[i], window[j]
            ok = (group[i] != group[j]) & (np.minimum(size[i], size[j]) * SIMILAR[1] >= np.maximum(size[i], size[j]) * SIMILAR[0])
            if right is left:
                ok &= i < j
            yield np.stack((i[ok], j[ok], d[ok]))


def spanning(rows: pd.DataFrame, blocks: Iterator[np.ndarray]) -> pd.DataFrame:
    """a, b: nodes of a spanning forest of the pairs in blocks, thinned out while they come."""
    found, held = [np.zeros((3, 0), np.int64)], 0
    for block in blocks:
        found.append(block)
        held += block.shape[1]
        if held > HELD:
            whole = np.concatenate(found, axis=1)
            found = [whole[:, forest(len(rows), *whole)]]
            held = found[0].shape[1]
    i, j, d = np.concatenate(found, axis=1)
    k, node = forest(len(rows), i, j, d), rows["node"].to_numpy(np.int64)
    return pd.DataFrame({"a": node[i[k]], "b": node[j[k]]})


def holding(rows: pd.DataFrame, blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Of the pairs in blocks those whose shingles (hashes) are similar enough."""
    sets = list(rows["hashes"])
    bounds = np.cumsum([0, *map(len, sets)])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(ids), bool)
    for i, j, d in blocks:
        shared = np.zeros(len(i), np.int64)
        for k in np.unique(i):
            at = slice(*np.searchsorted(i, (k, k + 1)))  # left places come in order
            own[ids[bounds[k] : bounds[k + 1]]] = True
            shared[at] = [own[ids[bounds[x] : bounds[x + 1]]].sum() for x in j[at]]
            own[ids[bounds[k] : bounds[k + 1]]] = False
        both = np.diff(bounds)[i] + np.diff(bounds)[j]
        ok = SIMILAR[1] * shared >= SIMILAR[0] * (both - shared)
        yield np.stack((i[ok], j[ok], d[ok]))


def dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows (key, m, node, ...) in shards (key, i, j, side): the parts of each key by hash, of which any two meet."""
    parts = rows.withColumn("parts", F.ceil(F.col("m") / most)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return parts.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("parts", "own", "other", "m")


def candidates(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """a, b of nodes (node, size, fingerprint) that meet under one of keys (h, node, size) and are within the radii: those of small
    keys, and of each large key a forest."""
    groups = keys.groupBy("h").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).filter("m > 1")
    chosen = groups.groupBy("m", "x", "y").agg(F.min("h").alias("h")).select("h", "m")
    shared = written(keys.join(chosen, "h"), "shared-keys")

    # keys of few texts
    few = shared.filter(F.col("m") <= FEW)
    a, b = (few.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "size"))) for x in "ab")
    near = (F.least("size_a", "size_b") * SIMILAR[1] >= F.greatest("size_a", "size_b") * SIMILAR[0]) & (F.col("node_a") < F.col("node_b"))
    met = a.join(b, "h").filter(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    for x in "ab":
        met = met.join(nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in PRINT)), x)
    bits = [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in PRINT]
    met = met.filter((bits[0] <= FIRST) & (sum(bits[1:], bits[0]) <= RADIUS)).select("a", "b")

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(group=rows["node"]).sort_values(["size", "node"], ignore_index=True)
        return spanning(rows, near_blocks(rows, int(key[1]) != int(key[2])))

    many = shared.filter(F.col("m") > FEW).drop("size").join(nodes.select("node", "size", *PRINT), "node")
    return met.unionByName(dealt(many, "h", GROUP).groupBy("h", "i", "j").applyInPandas(solve, "a long, b long")).distinct()


def verified(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: a forest of the links between different groups of nodes (root, m, node, size, group, fingerprint) with the same root."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "node"], ignore_index=True)
        rows["hashes"] = [shingle_hashes(t) for t in rows.pop("text")]
        return spanning(rows, holding(rows, near_blocks(rows, int(key[1]) != int(key[2]))))

    own = texts.select(F.col("row").alias("node"), "text").join(nodes.select("node"), "node", "left_semi")
    return dealt(nodes.join(own, "node"), "root", OPEN_GROUP).groupBy("root", "i", "j").applyInPandas(solve, "a long, b long")


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, holds of pairs (a, b): are their texts (row, text) near copies?"""
    pairs = written(pairs, "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    needed = written(texts.select("row", "text").join(ids, "row", "left_semi"), "candidate-texts")
    both = pairs.join(needed.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").join(needed.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "holds": [similar(x, y) for x, y in zip(p["text_a"], p["text_b"], strict=True)]})

    with text_batches(texts.sparkSession):
        return written(both.select("a", "b", "text_a", "text_b").mapInPandas(of, "a long, b long, holds boolean"), "checked")


def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b of pairs with the roots (node, root) of their nodes, which are their own where they have none."""
    for x in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias("r")), x, "left").withColumn(x, F.coalesce("r", x)).drop("r")
    return pairs.select("a", "b").filter("a != b")


def with_roots(pairs: DataFrame) -> DataFrame:
    """node, root of the components of pairs, the roots among the nodes."""
    found = components(pairs)
    return found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()


def groups_of(nodes: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root of the nodes (node, size, fingerprint) that are near copies of others, by comparison of their texts (row, text)."""
    first = checked(candidates(nodes, keys), texts)
    tight = written(with_roots(first.filter("holds").select("a", "b")), "settled")
    bad = written(rooted(first.filter("not holds").select("a", "b"), tight), "unsettled")
    if bad.isEmpty():
        return tight
    # groups that pairs which don't hold tie together are compared as one
    open_ = with_roots(bad).select(F.col("node").alias("group"), F.col("root").alias("open"))
    named = nodes.join(tight, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root").join(open_, "group").withColumnRenamed("open", "root")
    named = written(named, "open")
    again = named.join(named.groupBy("root").agg(F.count("*").alias("m")), "root")
    more = with_roots(rooted(verified(again, texts), tight)).select(F.col("node").alias("group"), F.col("root").alias("top"))
    every = tight.unionByName(more.select(F.col("group").alias("node"), F.col("group").alias("root"))).dropDuplicates(["node"])
    return every.join(more, F.col("root") == F.col("group"), "left").select("node", F.coalesce("top", "root").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """row, component of each row of docs (row, text)."""
    with text_batches(docs.sparkSession):
        prints = written(with_prints(docs), "prints")
    sets = prints.groupBy("size", "h1", "h2").agg(F.min("row").alias("node"))
    nodes = written(prints.drop("keys").join(sets.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "sets")
    keys = prints.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.explode("keys").alias("h"), F.col("row").alias("node"), "size")
    roots = groups_of(nodes.filter("size > 0"), written(keys, "keys"), docs)
    named = nodes.join(roots, "node", "left").select("size", "h1", "h2", F.coalesce("root", "node").alias("component"))
    return prints.select("row", "size", "h1", "h2").join(named, ["size", "h1", "h2"]).select("row", "component")


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each group only the row with its smallest doc_id, nulls last, the first on a tie."""
    rows = numbered(docs)
    keys = rows.select("row", F.col("doc.doc_id").isNull().alias("last"), F.col("doc.doc_id").alias("id"))
    found = near_copies(rows.select("row", "doc.text"))
    first = found.join(keys, "row").groupBy("component").agg(F.min(F.struct("last", "id", "row")).alias("k")).select(F.col("k.row").alias("row"))
    return rows.join(first, "row", "left_semi").select("doc.*")
