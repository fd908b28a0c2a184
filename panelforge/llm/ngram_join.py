"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Texts of equal words are one node, which has a number.
Candidates come from bands of MinHash values: each node is tied to the smallest node of its
bucket, so edges grow with the nodes and not with their pairs. Edges between clearly different texts are
dropped. Nodes that aren't so close to the smallest one that whatever is close to them must be
tied to it as well stay in the bucket and meet each other: in further rounds with a new smallest
node while it is large, then pair by pair, in blocks. The components of the edges are the groups
within which links are sought.

In a group pairs are compared by their MinHash values a few at a time; once the posterior
probability of reaching the threshold is below a tolerance the pair is dropped. What survives
is verified on the shingle sets. Groups over a block (of texts or of words) are compared with one
text of theirs first: whatever differs little enough from it is linked with each other for sure,
by the triangle inequality, and counted without a comparison. Only blocks that hold unsure pairs
meet each other, so many near copies cost no more than their number, and no task gathers a large
group. Links are counted where they are found and only spanning edges leave the task, so the
classes of many near copies don't need all their pairs.

Defined results: null and wordless texts have no shingles: each is alone in its class, without
links; a text of one to four words is one shingle; repeated rows are in one class; the class id
is the smallest doc_id of the class; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty
from .components import components

HASHES, ROWS = 128, 4
_BLOCK_WORDS = 200_000
_random = np.random.default_rng(5)
_FLIP = _random.integers(0, 1 << 63, HASHES, np.uint64)
_TIMES = _random.integers(0, 1 << 63, HASHES, np.uint64) | np.uint64(1)
_WORD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingles(words: list[list[bytes]], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each n-word window, and the text it is from; shorter texts are one window."""
    count = np.fromiter(map(len, words), np.int64, len(words))
    total = int(count.sum())
    flat = list(chain.from_iterable(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, total)
    text = np.repeat(np.arange(len(words)), count)
    place = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    left = np.repeat(count, count) - place
    first = (left >= n) | (place == 0)
    at = np.flatnonzero(first)
    key = np.zeros(len(at), np.uint64)
    for k in range(n):
        here = np.minimum(at + k, max(total - 1, 0))
        key = np.where(left[at] > k, _mixed(key * _WORD + h[here]), key)
    return key, text[at]


def _signatures(key: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """MinHash values of n texts, each with a window; windows come in the order of texts."""
    starts = np.searchsorted(text, np.arange(n))
    out = np.empty((n, HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((key ^ _FLIP[k]) * _TIMES[k]) >> np.uint64(32), starts)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            words, held, end = [], 0, at
            while end < len(texts) and held < _BLOCK_WORDS:
                words.append(texts[end].encode().split())
                held += len(words[-1])
                end += 1
            solid = [k for k, w in enumerate(words) if w]
            if solid:
                own = [words[k] for k in solid]
                key, text = shingles(own)
                sig = _signatures(key, text, len(own))
                bands = np.zeros((len(own), HASHES // ROWS), np.uint64)
                for r in range(ROWS):
                    bands = _mixed(bands * _WORD + sig[:, r::ROWS])
                bands = _mixed(bands ^ np.arange(HASHES // ROWS, dtype=np.uint64))
                rows = pa.array(bands.view(np.int64).ravel())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(at, end - at).take(pa.array(solid)),
                        "digest": pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in own], pa.binary()),
                        "words": pa.array(list(map(len, own)), pa.int64()),
                        "bands": pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), rows),
                        "sig": pa.array([x.tobytes() for x in (sig & np.uint32(255)).astype(np.uint8)], pa.binary()),
                    }
                )
            at = end


def least_matches(threshold: float, tolerance: float, steps: int = 16) -> list[tuple[int, int]]:
    """(values compared, fewest matches) from which a pair goes on: with a uniform prior on the
    similarity, the posterior of reaching threshold is tolerance or more. Values are kept as
    bytes, so differing values still match once in 256."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(steps, HASHES + 1, steps):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() / weight.sum() >= tolerance:
                out.append((n, m))
                break
    return out


def near_matches(threshold: float, tolerance: float) -> int:
    """Fewest matching values of a node and its hub (HASHES + 1: never) with which the node needs
    no other neighbours: that it has so many, while a text at threshold from it loses its own
    edge to the hub, has a probability of tolerance at most, whatever the similarities are."""
    count = np.arange(HASHES + 1)
    log_choose = np.cumsum(np.log(np.concatenate([[1.0], (HASHES - count[:-1]) / count[1:]])))

    def at_least(s: np.ndarray) -> np.ndarray:
        p = np.clip(s + (1 - s) / 256, 1e-12, 1 - 1e-12)[:, None]
        p = np.exp(log_choose + count * np.log(p) + (HASHES - count) * np.log1p(-p))
        return np.cumsum(p[:, ::-1], axis=1)[:, ::-1]

    s = np.linspace(0, 1, 501)
    fewest = least_matches(2 * threshold - 1, tolerance)[-1][1]
    lost = 1 - at_least(np.maximum(s - (1 - threshold), 0))[:, fewest]
    bad = (at_least(s) * lost[:, None]).max(axis=0)
    return int(np.argmax(bad <= tolerance)) if (bad <= tolerance).any() else HASHES + 1


def _judged(threshold: float, tolerance: float) -> Callable:
    """Edges a, b, x, y whose signatures x and y may be within twice the distance of threshold,
    and whether b needs no neighbours but a."""
    # Two texts that both reach the threshold with a third differ by twice as much at most.
    checks, near = least_matches(2 * threshold - 1, tolerance), near_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            same = np.cumsum(x == y, axis=1)
            live = np.ones(len(x), bool)
            for n, m in checks:
                live &= same[:, n - 1] >= m
            out = pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1), "near": pa.array(same[:, -1] >= near)})
            yield out.filter(pa.array(live))

    return run


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs, those that tie what wasn't tied yet."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for at, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(at)
    return a[keep], b[keep]


def _ties(sig: np.ndarray, rows: np.ndarray, columns: np.ndarray, checks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that tie what plausible pairs of rows x columns tie: row by row, against columns that
    aren't tied to the row yet, so where all are alike the first row settles it."""
    of, out_a, out_b = np.arange(len(sig)), [], []
    own = len(rows) == len(columns) and (rows == columns).all()
    for place, row in enumerate(rows):
        left = columns[place + 1 :] if own else columns
        left = left[of[left] != of[row]]
        matches, done = np.zeros(len(left), np.int64), 0
        for n, m in checks:
            if not len(left):
                break
            matches += (sig[left, done:n] == sig[row, done:n]).sum(axis=1)
            go = matches >= m
            left, matches, done = left[go], matches[go], n
        if len(left):
            parts, first = np.unique(of[left], return_index=True)
            out_a.append(np.full(len(parts), row))
            out_b.append(left[first])
            of[np.isin(of, parts)] = of[row]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _pairwise(threshold: float, tolerance: float) -> Callable:
    """Edges that tie what the plausible pairs of a bucket tie, or of two blocks of a large one."""
    checks = least_matches(threshold, tolerance)

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("k", "ascending"), ("node", "ascending")])
        k, block, nodes = (cell[c].to_numpy() for c in ("k", "block", "node"))
        low, high = cell["low"][0].as_py(), cell["high"][0].as_py()
        sig = np.frombuffer(b"".join(cell["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        found_a, found_b = [], []
        for s, e in zip(edges, edges[1:], strict=False):
            own = np.arange(e - s)
            sides = (own, own) if low == high else (own[block[s:e] == low], own[block[s:e] == high])
            a, b = _spanning(*_pairs(sig[s:e], *sides, checks)) if e - s <= 64 else _ties(sig[s:e], *sides, checks)
            found_a.append(a + s)
            found_b.append(b + s)
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return pa.table({"a": pa.array(nodes[a]), "b": pa.array(nodes[b])})

    return run


def _pairs(sig: np.ndarray, rows: np.ndarray, columns: np.ndarray, checks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows x columns (first before second where both are from one block) that survive the pruning."""
    i, j = np.nonzero(rows[:, None] < columns[None, :]) if len(rows) == len(columns) and (rows == columns).all() else np.indices((len(rows), len(columns))).reshape(2, -1)
    a, b = rows[i], columns[j]
    matches, done = np.zeros(len(a), np.int32), 0
    for n, m in checks:
        matches += (sig[a, done:n] == sig[b, done:n]).sum(axis=1)
        go = matches >= m
        a, b, matches, done = a[go], b[go], matches[go], n
    return a, b


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common shingles of each pair: few pairs one by one, many by matrix products over the
    shingles that two or more sets have."""
    if len(a) <= 3 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, of = (np.cumsum(count > 1) - 1)[column[shared]], of[shared]
    both, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [start, start + width]))
        grid = np.zeros((len(sets), width), np.float32)
        grid[of[part], column[part] - start] = 1
        both += grid @ grid.T
    return both[a, b].astype(np.int64)


def _cell_sets(texts: list[str], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingles of each text, and their numbers."""
    key, text = shingles([t.encode().split() for t in texts], n)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    sets = [np.unique(key[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return sets, np.array(list(map(len, sets)), np.int64)


def _from_hub(threshold: float, n: int) -> Callable:
    """g of each text of a large group, see join(): whole numbers from its distance to the hub."""
    part = round(threshold * 1_000_000)

    def run(cell: pa.Table) -> pa.Table:
        sets, size = _cell_sets(cell["text"].to_pylist(), n)
        hub = cell["is_hub"].to_pylist().index(True)
        common = np.array([len(np.intersect1d(x, sets[hub], True)) for x in sets], np.int64)
        g = (1_000_000 + part) * (size + size[hub] - 2 * common) - (1_000_000 - part) * size
        out = pa.table({"root": cell["root"], "node": cell["node"], "g": pa.array(g)})
        return out.filter(pa.array(~np.array(cell["sent"].to_pylist(), bool)))

    return run


def _links(threshold: float, tolerance: float, n: int) -> Callable:
    checks = least_matches(threshold, tolerance)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        """Links in one cell: small groups as they are, or two blocks (or one) of a large group,
        of which pairs with g + g <= 0 are links already."""
        cell = cell.sort_values(["root", "node"], ignore_index=True)
        nodes, count = cell["node"].tolist(), np.zeros(len(cell), np.int64)
        parent = list(range(len(cell)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if len(cell):
            sets, size = _cell_sets(cell["text"].tolist(), n)
            sig = np.frombuffer(b"".join(map(bytes, cell["sig"])), np.uint8).reshape(-1, HASHES)
            root, g = cell["root"].to_numpy(), cell["g"].to_numpy()
            edges = [0, *(np.flatnonzero(root[1:] != root[:-1]) + 1).tolist(), len(root)]
            block, low, high = cell["block"].to_numpy(), cell["low"].iloc[0], cell["high"].iloc[0]
            for s, e in zip(edges, edges[1:], strict=False):
                own = np.arange(s, e)
                a, b = _pairs(sig, own, own, checks) if low == high else _pairs(sig, own[block[s:e] == low], own[block[s:e] == high], checks)
                open_ = g[a] + g[b] > 0
                a, b = a[open_], b[open_]
                if not len(a):
                    continue
                common = _common(sets[s:e], a - s, b - s)
                # |common| / |union| >= threshold in whole numbers
                linked = common * 1_000_000 >= round(threshold * 1_000_000) * (size[a] + size[b] - common)
                a, b = a[linked], b[linked]
                np.add.at(count, a, 1)
                np.add.at(count, b, 1)
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    x, y = top(x), top(y)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
        return pd.DataFrame({"node": nodes, "n_links": count, "to": [nodes[top(k)] for k in range(len(nodes))]})

    return run


LINKS_SCHEMA = "node long, n_links long, to long"


def _large_groups(known: DataFrame, threshold: float, tolerance: float, block: int, block_words: int) -> DataFrame:
    """node, n_links, to of groups over a block.

    Let D be the number of shingles in which a text differs from the group's hub, and
    g = (1 + t) D - (1 - t) |shingles|. Two texts differ from each other in D + D shingles at most,
    so they are linked for sure where g + g <= 0. Those links are counted from the numbers of
    texts with each g; only blocks of texts, in the order of g, in which some pair isn't sure
    meet each other.
    """
    n_cells = F.ceil(F.greatest(F.col("n") / block, F.col("words") / block_words)).cast("int")
    with_cell = known.select("root", "node", "text", F.pmod(F.xxhash64("node"), n_cells).cast("int").alias("cell"), (F.col("node") == F.col("root")).alias("is_hub"), F.lit(False).alias("sent"))
    hubs = known.where(F.col("node") == F.col("root")).select("root", "node", "text", F.explode(F.sequence(F.lit(0), n_cells - 1)).alias("cell"), F.lit(True).alias("is_hub"), F.lit(True).alias("sent"))
    placed = stored(with_cell.union(hubs).groupBy("root", "cell").applyInArrow(_from_hub(threshold, 5), "root long, node long, g long"))

    # One row for each value of g: no more than texts have shingles.
    values = placed.groupBy("root", "g").agg(F.count(F.lit(1)).alias("same"))
    upto = F.sum("same").over(Window.partitionBy("root").orderBy("g"))
    values = stored(values.withColumn("upto", upto))
    # For each g the largest value of the group that is -g or less, by one pass over both kinds.
    asked = values.select("root", (-F.col("g")).alias("at"), F.lit(None).cast("long").alias("upto"), F.col("g").alias("for"))
    told = values.select("root", F.col("g").alias("at"), "upto", F.lit(None).cast("long").alias("for"))
    reached = F.coalesce(F.last("upto", ignorenulls=True).over(Window.partitionBy("root").orderBy("at")), F.lit(0))
    sure = asked.union(told).withColumn("sure", reached).where(F.col("for").isNotNull()).select("root", F.col("for").alias("g"), "sure")
    least = placed.groupBy("root").agg(F.min(F.struct("g", "node")).alias("low"))
    per_root = known.groupBy("root").agg(F.first(n_cells).alias("blocks"), F.first("n").alias("n"))
    spread = values.join(sure, ["root", "g"]).join(least, "root").join(per_root, "root")
    placed = stored(placed.join(spread, ["root", "g"]))
    counted = placed.select("node", (F.col("sure") - F.when(F.col("g") <= 0, 1).otherwise(0)).alias("n_links"), F.when(F.col("g") + F.col("low.g") <= 0, F.col("low.node")).otherwise(F.col("node")).alias("to"))

    rank = F.col("upto") - F.col("same") + F.pmod(F.xxhash64("node"), F.col("same"))
    placed = placed.select("root", "node", "g", F.least(F.floor(rank * F.col("blocks") / F.col("n")), F.col("blocks") - 1).cast("int").alias("block"))
    tops = placed.groupBy("root", "block").agg(F.max("g").alias("top"))
    tops = stored(tops)
    ends = tops.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("block", "top"))).alias("all"))
    later = F.filter("all", lambda x: (x["block"] >= F.col("block")) & (x["top"] + F.col("top") > 0))
    cells = tops.join(ends, "root").select("root", F.col("block").alias("low"), F.explode(F.transform(later, lambda x: x["block"])).alias("high"))
    sides = cells.select("root", "low", "high", F.col("low").alias("block")).union(cells.where(F.col("low") < F.col("high")).select("root", "low", "high", F.col("high").alias("block")))
    rows = placed.join(sides, ["root", "block"]).join(known.select("node", "text", "sig"), "node").select("node", "root", "text", "sig", "g", "block", "low", "high")
    met = rows.groupBy("root", "low", "high").applyInPandas(_links(threshold, tolerance, 5), LINKS_SCHEMA)
    return counted.union(met)


def candidate_edges(nodes: DataFrame, threshold: float, tolerance: float, block: int = 1024, rounds: int = 8) -> DataFrame:
    """Plausible edges a, b that tie all nodes of a bucket which may reach threshold. Rounds end
    early when a new smallest node settles less than a quarter of what is left."""
    rows = nodes.select("node", F.explode("bands").alias("k"))
    hubs = rows.groupBy("k").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    pool = stored(rows.join(hubs, "k").select("k", "node", "hub").where(F.col("node") != F.col("hub")))
    sig = nodes.select("node", "sig")

    def judged(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(F.col("a") != F.col("b")).distinct()
        known = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
        return stored(known.select("a", "b", "x", "y").mapInArrow(_judged(threshold, tolerance), "a long, b long, near boolean"))

    def stay(pool: DataFrame, edges: DataFrame) -> DataFrame:
        """What is left of each bucket, with how many nodes."""
        tied = edges.where("near").select(F.col("a").alias("hub"), F.col("b").alias("node"))
        left = stored(pool.join(tied, ["hub", "node"], "left_anti").select("k", "node"))
        sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where(F.col("n") > 1)
        return stored(left.join(sizes, "k"))

    out = judged(pool.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    left, small = stay(pool, out), None
    out = out.select("a", "b")
    rows_before = None
    for _ in range(rounds):
        large = left.where(F.col("n") > block)
        rows_left = large.count()
        if not rows_left or rows_before and rows_left > 0.75 * rows_before:
            break
        rows_before = rows_left
        rest = left.where(F.col("n") <= block)
        small = rest if small is None else small.union(rest)
        edges = judged(large.select(F.col("hub").alias("a"), F.col("node").alias("b")))
        left, out = stay(large.where(F.col("node") != F.col("hub")).select("k", "node", "hub"), edges), out.union(edges.select("a", "b"))
    left = left if small is None else left.union(small)
    blocks = F.ceil(F.col("n") / block).cast("int")
    cells = max(1, left.where(F.col("n") <= block).count() // 1024)
    left = left.select("k", "node", blocks.alias("blocks")).join(sig, "node")
    left = left.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("k"), F.lit(cells))).otherwise(F.xxhash64("k", "low", "high"))
    left = left.select("k", "node", "sig", "block", "low", "high", cell.alias("cell"), (F.col("blocks") == 1).alias("small"))
    return out.union(left.groupBy("small", "cell", "low", "high").applyInArrow(_pairwise(threshold, tolerance), "a long, b long"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        words = [t.encode().split() for t in texts]
        nodes = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words]
        yield pa.RecordBatch.from_pydict({"digest": pa.array(nodes, pa.binary()), "text": batch.column(0)})


def join(df: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, tolerance: float = 1e-6, block: int = 512, block_words: int = 400_000) -> DataFrame:
    """One row for each row of df: key, class_id, class_size, n_links (other different texts at
    threshold or more), kept (it is the first of its class)."""
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    features = stored(docs.mapInArrow(_features, f"doc_id {kind}, digest binary, words long, bands array<bigint>, sig binary"))
    nodes = features.groupBy("digest").agg(F.first("words").alias("words"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    groups = components(candidate_edges(nodes, threshold, tolerance))

    placed = groups.join(nodes.select("node", "digest", "words", "sig"), "node")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"))
    members = placed.drop("words").join(sizes, "root")
    large = (F.col("n") > block) | (F.col("words") > block_words)
    # Ids may be null or repeated, so each node brings a text of its own.
    texts = docs.select("text").mapInArrow(_texts, "digest binary, text string").groupBy("digest").agg(F.first("text").alias("text"))
    known, zero = stored(members.join(texts, "digest").drop("digest")), F.lit(0)
    cells = max(1, known.where(~large).count() // 256)
    small = known.where(~large).select("node", "root", "text", "sig", F.lit(1).cast("long").alias("g"), zero.alias("block"), zero.alias("low"), zero.alias("high"), F.pmod(F.xxhash64("root"), F.lit(cells)).alias("cell"))
    found = stored(small.groupBy("cell").applyInPandas(_links(threshold, tolerance, 5), LINKS_SCHEMA))
    if known.where(large).limit(1).count():
        found = found.union(stored(_large_groups(known.where(large), threshold, tolerance, block, block_words)))
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    classes = components(found.where(F.col("node") != F.col("to")).select(F.col("node").alias("a"), F.col("to").alias("b")))
    # Stored sides leave both joins to plain shuffles, whose hot keys Spark splits at run time.
    per_node = stored(links.join(classes, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n_links"))

    of = nodes.select("digest", "node").join(per_node, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    placed = stored(features.select("doc_id", "digest").join(stored(of), "digest").drop("digest"))
    firsts = stored(placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")))
    with_words = placed.join(firsts, "root").select("doc_id", "class_id", "class_size", "n_links")
    wordless = docs.where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    out = with_words.unionByName(wordless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    return out.withColumnRenamed("doc_id", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: near-duplicate classes of all documents."""
    return join(table(spark, sf_dir, "documents"))
