"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are put into partitions, correlated bits together. Thresholds t_i of the partitions sum to the link
distance less the number of partitions plus one, so two fingerprints that link agree in at least one partition to
within its threshold. Dynamic programming allocates the thresholds, unequal where that is cheaper, on candidate counts
estimated from a bounded sample; partitions' number and sizes are chosen the same way. Every fingerprint is then put
into its bucket of each partition, probes the buckets within the partition's threshold, and candidates are verified on
all bits. The sample decides the cost only, never the result.

Copies share a fingerprint and are one candidate. A bucket's homes (the fingerprints that lie in it) and its probers are dealt
into blocks, as many as their numbers ask for, and each block of homes meets each block of probers in one task, so neither a
hot bucket nor one beside it is held whole. Blocks give a spanning forest of the links found, not the pairs. Components follow from
alternating large-star and small-star rounds.

Null and empty texts have fingerprint zero and link like any other. A component's id is its smallest document id;
null ids are larger than any other, and a component of null ids alone has a null id. Repeated rows, and rows that share an id but not
the text, get a row each. Empty tables give empty tables; other columns are not read by ``near_duplicates`` and pass unchanged
through ``one_of_each``, whatever their names. Long texts are hashed a part at a time.

With ``similarity`` set, fingerprints give candidates only: two texts link if the Jaccard similarity of their sets of
shingles (as 64-bit hashes) reaches it, whatever their distance up to ``distance``. Candidates also need sketches that agree: a bit of
the smallest shingle of each of 128 ranges of the hash; of two sets of similarity 0.8 about a tenth of the bits differ, and up to
``sketch_bits`` may. First each text and the few nearest within ``first_distance`` are verified and joined. Then all candidates that are not
joined meet. For them the entries are dealt into blocks by a hash, each two blocks are a task, and buckets and their probes are looked up
within it: at this distance an entry has hundreds of probes, which would take several times the input if each were shuffled. For each component of
candidates in a task, their sets of shingles are brought there once, and pairs are verified in place, nearest first, passing over those
that are joined by then. So a group of near copies makes no row of each of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, discard, mapped, materialise, mix, texts


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 4
    seed: int = 42
    distance: int = 4
    sample: int = 2048
    probe_cost: float = 1.0  # of a row that is shuffled, against that of a pair of fingerprints compared within a block
    candidate_cost: float = 0.0015
    block: int = 4096
    max_listed: int = 500_000
    task_comparisons: float = 2.5e8
    task_entries: float = 1e6
    paired_block: int = 131_072
    max_rounds: int = 60
    similarity: float | None = None
    first_distance: int = 8
    first_nearest: int = 8
    sketch_bits: int = 26


def hashes(text: bytes, p: SimHashParams) -> Iterator[np.ndarray]:
    """The hashes of the shingles, a part of the text at a time; a text of fewer words is a shingle itself."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
    k, digest, seed = p.shingle, xxhash.xxh64_intdigest, p.seed
    if 0 < len(words) <= k:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    for a in range(0, len(words) - k + 1 if words else 0, 1 << 15):
        part = words[a : a + (1 << 15) + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = (ends - [len(w) + 1 for w in part]).tolist()
        yield np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bits that are set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, p: SimHashParams) -> int:
    """Bits that are set in over half of the shingles' hashes."""
    return majority(hashes(text, p))


def fingerprints(docs: DataFrame, params: SimHashParams | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id and fp (64 bits as a long) of every row."""
    p = params or SimHashParams()

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, p) for x in texts(column_of(b, text))], np.uint64)
            yield pa.RecordBatch.from_arrays([column_of(b, id), pa.array(fp.view(np.int64), pa.int64())], names=[id, "fp"])

    return mapped(docs.select(id, text), run, T.StructType([docs.schema[id], T.StructField("fp", T.LongType())]))


@dataclass(frozen=True)
class Plan:
    partitions: list[list[int]]
    thresholds: list[int]


def correlated_groups(bits: np.ndarray, sizes: list[int]) -> list[list[int]]:
    """Greedy: a group starts with the bit least tied to the free ones and takes the bit most tied to it, until it is full."""
    centred = bits - bits.mean(0)
    norm = np.sqrt((centred**2).sum(0)) + 1e-9
    tie = np.abs(centred.T @ centred) / np.outer(norm, norm)
    free, groups = list(range(64)), []
    for size in sizes:
        own = [min(free, key=lambda i: (tie[i, free].sum(), i))]
        free.remove(own[0])
        while len(own) < size:
            best = max(free, key=lambda i: (tie[i, own].sum(), -i))
            own.append(best)
            free.remove(best)
        groups.append(sorted(own))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) that sum to total at least cost; costs[i][t + 1] is partition i's at t."""
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, len(row) - 1):
                got = (c + row[t + 1], [*ts, t])
                if s + t not in step or got < step[s + t]:
                    step[s + t] = got
        best = step
    return best.get(total, (float("inf"), []))


def plan(sample: np.ndarray, n: int, p: SimHashParams) -> Plan:
    """The partitioning and thresholds of least estimated cost for n distinct fingerprints."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, 64))
    best = (float("inf"), [], [])
    for m in range(1, p.distance + 2):
        sizes = [64 // m + (i < 64 % m) for i in range(m)]
        groups, costs = correlated_groups(bits, sizes), []
        for g in groups:
            signs = 2 * bits[:512, g] - 1
            apart = np.round((len(g) - signs @ signs.T) / 2)
            pairs = apart[~np.eye(len(apart), dtype=bool)]
            row = [0.0]
            for t in range(min(4, p.distance) + 1):
                probes = sum(comb(len(g), k) for k in range(t + 1))
                share = max(float((pairs <= t).mean()) if len(pairs) else 0.0, probes / 2.0 ** len(g))
                row.append(p.probe_cost * (probes + 1) + p.candidate_cost * n * share)
            costs.append(row)
        cost, ts = allocate(costs, p.distance - m + 1)
        if cost < best[0]:
            best = (cost, groups, ts)
    return Plan(best[1], best[2])


def _tables(made: Plan) -> list[tuple[int, int, np.ndarray]]:
    """(partition, its bits, flips of them within its threshold, none first)."""
    return [(i, sum(1 << b for b in group), np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(group, k)], np.uint64)) for i, (group, t) in enumerate(zip(made.partitions, made.thresholds)) if t >= 0]


@dataclass(frozen=True)
class Grid:
    """Blocks of homes and of probers by bucket: a number for each partition, and those of the buckets listed (sorted by key)."""

    usual: dict[int, tuple[int, int]]
    listed: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def of(self, part: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = [np.full(len(keys), n, np.int64) for n in self.usual[part]]
        if part in self.listed:
            known, *blocks = self.listed[part]
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            for o, n in zip(out, blocks):
                o[hit] = n[at[hit]]
        return out[0], out[1]


def _grid(distinct: DataFrame, made: Plan, n: int, p: SimHashParams) -> Grid:
    """Buckets with more homes or probers than their partition's mean explains are listed, at most max_listed of them."""
    tables, usual, listed = _tables(made), {}, {}
    size = {i: (n / 2.0 ** mask.bit_count(), n * len(flips) / 2.0 ** mask.bit_count()) for i, mask, flips in tables}
    for i, means in size.items():
        usual[i] = tuple(max(1, -int(-m // p.block)) for m in means)

    def homes(batches):
        for b in batches:
            fps = column_of(b, "fp").to_numpy().view(np.uint64)
            for i, mask, _ in tables:
                keys, counts = np.unique(fps & np.uint64(mask), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["part", "key", "n"])

    def spread(batches):
        of = {i: flips for i, _, flips in tables}
        for b in batches:
            part, key, count = (column_of(b, k).to_numpy() for k in ("part", "key", "n"))
            for i in np.unique(part).tolist():
                own = part == i
                keys = (key[own].view(np.uint64)[:, None] ^ of[i][None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.repeat(count[own], len(of[i])))], names=["part", "key", "n"])

    # few buckets can pass a block without a neighbour, or themselves, that has its share of one
    share = F.lit(0)
    for i, _, flips in tables:
        share = F.when(F.col("part") == i, F.lit(max(1, p.block // len(flips)))).otherwise(share)
    full = materialise(mapped(distinct.select("fp"), homes, "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("n")).where(F.col("n") > share), "full-buckets")
    near = mapped(full, spread, "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("q"))
    both = near.join(full, ["part", "key"], "left").select("part", "key", F.coalesce("n", F.lit(0)).alias("h"), "q")
    more = F.lit(False)
    for i, (h, q) in usual.items():
        more = more | ((F.col("part") == i) & ((F.col("h") > 2 * h * p.block) | (F.col("q") > 2 * q * p.block)))
    rows = both.where(more).select("part", "key", "h", "q", F.greatest("h", "q").alias("m"))
    found = rows.orderBy(F.desc("m"), "part", "key").limit(p.max_listed).toArrow()  # 28 bytes a row, so a few MB at most
    discard(full)
    part, key, h, q = (found[k].to_numpy() for k in ("part", "key", "h", "q"))
    for i in np.unique(part).tolist():
        own = np.flatnonzero(part == i)
        own = own[np.argsort(key[own].view(np.uint64))]
        blocks = (np.maximum(1, -(-(v[own] + p.block) // p.block)) for v in (h, q))
        listed[i] = (key[own].view(np.uint64), *blocks)
    return Grid(usual, listed)


HOME, PROBER, BOTH = 0, 1, 2


def _messages(distinct: DataFrame, made: Plan, grid: Grid, columns: tuple[str, ...]) -> DataFrame:
    """(part, key, a, b, role, held): entries for a pair of blocks of a bucket, as many in a row as a batch has; an entry is its columns' words, fp first."""
    tables, width = _tables(made), len(columns)

    def run(batches):
        for b in batches:
            rows = np.stack([column_of(b, k).to_numpy().view(np.uint64) for k in columns], 1)
            for i, mask, flips in tables:
                for lo in range(0, len(rows), max(1, (1 << 17) // len(flips))):
                    part = rows[lo : lo + max(1, (1 << 17) // len(flips))]
                    yield message(i, part, (part[:, 0] & np.uint64(mask))[:, None] ^ flips[None, :])

    def message(i: int, rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        who = np.repeat(np.arange(len(rows)), keys.shape[1])
        home = np.zeros(keys.shape, bool)
        home[:, 0] = True
        home, keys = home.ravel(), keys.ravel()
        deal = mix(rows[:, 0].copy())[who]
        of_homes, of_probers = grid.of(i, keys)
        a, b = (deal % of_homes.astype(np.uint64)).astype(np.int64), ((deal >> np.uint64(32)) % of_probers.astype(np.uint64)).astype(np.int64)
        one = (of_homes == 1) & (of_probers == 1)
        # probers go to every block of homes; homes that are dealt go to every block of probers, beside what they do as probers
        sent, times = np.arange(len(keys)), np.where(one, 1, of_homes)
        at = np.repeat(sent, times)
        step = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        role = np.where(one[at] & home[at], BOTH, PROBER)
        x, y = np.where(one[at], 0, step), b[at]
        own = np.flatnonzero(home & ~one)
        again = np.repeat(own, of_probers[own])
        step = np.arange(len(again)) - np.repeat(np.cumsum(of_probers[own]) - of_probers[own], of_probers[own])
        at, role, x, y = np.concatenate([at, again]), np.concatenate([role, np.full(len(again), HOME)]), np.concatenate([x, a[again]]), np.concatenate([y, step])
        order = np.lexsort((role, y, x, keys[at]))
        at, role, x, y = at[order], role[order], x[order], y[order]
        key = keys[at]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (role[1:] != role[:-1])]))
        data = np.ascontiguousarray(rows[who[at]])
        offsets = (np.append(new, len(at)) * 8 * width).astype(np.int64)
        held = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(new), i, np.int32)), pa.array(key[new].view(np.int64)), pa.array(x[new].astype(np.int32)), pa.array(y[new].astype(np.int32)), pa.array(role[new].astype(np.int32)), held], names=["part", "key", "a", "b", "role", "held"])

    return mapped(distinct.select(*columns), run, "part int, key long, a int, b int, role int, held binary")


def forest_links(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Rows (smaller, larger) of a spanning forest of the links between two arrays of fingerprints."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    of_a, of_b = inverse[: len(a)], inverse[len(a) :]
    label, out = np.arange(len(nodes)), []
    for k in range(0, len(a), 256):
        near = np.bitwise_count(a[k : k + 256, None] ^ b[None, :]) <= distance
        for i in np.flatnonzero(near.any(1)).tolist():
            own, others = of_a[k + i], of_b[near[i]]
            found, first = np.unique(label[others], return_index=True)
            joined = found != label[own]
            if joined.any():
                out.append(np.stack([np.full(int(joined.sum()), nodes[own]), nodes[others[first[joined]]]], 1))
                together = np.zeros(len(nodes), bool)
                together[found] = together[label[own]] = True
                label[together[label]] = label[own]
    return np.sort(np.concatenate(out), 1) if out else np.zeros((0, 2), np.uint64)


def _dealt(entries: DataFrame, made: Plan, n: int, p: SimHashParams, columns: tuple[str, ...]) -> DataFrame:
    rows = _messages(entries, made, _grid(entries, made, n, p), columns)
    return rows.repartition(_work(made, n, p), "part", "key", "a", "b").sortWithinPartitions("part", "key", "a", "b")


def _work(made: Plan, n: int, p: SimHashParams) -> int:
    """Tasks for a search, by the comparisons and the entries expected: the rows are small for the work that they make."""
    each = [(len(flips), 2.0 ** mask.bit_count()) for _, mask, flips in _tables(made)]
    compared, sent = sum(n * n * f / keys for f, keys in each), sum(n * f for f, _ in each)
    return max(1, ceil(compared / p.task_comparisons), ceil(sent / p.task_entries))


def _blocks(batches, width: int) -> Iterator[tuple[tuple[int, int, int, int], np.ndarray, np.ndarray]]:
    """Each pair of blocks (part, key, a, b) that may hold a pair: its different homes and probers. Rows come sorted by pair of blocks."""
    now, homes, probers = None, [], []

    def whole():
        if homes and probers and (len(homes) > 1 or len(probers) > 1 or homes[0] != probers[0] or len(homes[0]) > 8 * width):
            yield now, *(np.unique(np.frombuffer(b"".join(x), np.uint64).reshape(-1, width), axis=0) for x in (homes, probers))

    for b in batches:
        for key, role, held in zip(zip(*(column_of(b, k).to_pylist() for k in ("part", "key", "a", "b"))), column_of(b, "role").to_pylist(), column_of(b, "held").to_pylist()):
            if key != now:
                yield from whole()
                now, homes, probers = key, [], []
            if role != PROBER:
                homes.append(held)
            if role != HOME:
                probers.append(held)
    yield from whole()


def _longs(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=names)


def links(distinct: DataFrame, made: Plan, n: int, params: SimHashParams | None = None) -> DataFrame:
    """src and dst: links between the n different fingerprints that connect all that link."""
    p = params or SimHashParams()

    def run(batches):
        for _, homes, probers in _blocks(batches, 1):
            found = forest_links(homes[:, 0], probers[:, 0], p.distance)
            if len(found):
                yield _longs(["src", "dst"], found[:, 0], found[:, 1])

    return mapped(_dealt(distinct, made, n, p, ("fp",)), run, "src long, dst long").distinct()


#: Words of an entry: its fingerprint, its node, its two words of sketch, and the group it is joined to.
ENTRY = ("fp", "node", "s0", "s1", "group")


def _near(a: np.ndarray, b: np.ndarray, distance: int, p: SimHashParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a and of b of different nodes that are candidates, and how many bits of their sketches differ, for some rows of a at a time."""
    for k in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[k : k + 256, None, 0] ^ b[None, :, 0]) <= distance)
        i += k
        ok = a[i, 1] != b[j, 1]
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(a[i, 2] ^ b[j, 2]).astype(np.int16) + np.bitwise_count(a[i, 3] ^ b[j, 3])
        ok = apart <= p.sketch_bits
        yield i[ok], j[ok], apart[ok]


def nearest(entries: DataFrame, made: Plan, n: int, p: SimHashParams) -> DataFrame:
    """src and dst: of each node and its few nearest candidates, what joins most."""

    def run(batches):
        for _, homes, probers in _blocks(batches, 4):
            few = []
            for i, j, apart in _near(homes, probers, p.distance, p):
                order = np.lexsort((probers[j, 1], apart, i))
                i, j, apart = i[order], j[order], apart[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
                few.append(np.stack([apart[rank < p.first_nearest].astype(np.uint64), homes[i, 1][rank < p.first_nearest], probers[j, 1][rank < p.first_nearest]], 1))
            pairs = np.concatenate(few) if few else np.zeros((0, 3), np.uint64)
            joined, out = Union(), []
            for _, x, y in pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))].tolist():
                if joined.join(x, y):
                    out.append((min(x, y), max(x, y)))
            if out:
                found = np.array(out, np.uint64)
                yield _longs(["src", "dst"], found[:, 0], found[:, 1])

    return mapped(_dealt(entries, made, n, p, ENTRY[:4]), run, "src long, dst long").distinct()


class Union:
    """Union-find of what one pair of blocks holds."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def paired_blocks(made: Plan, n: int, p: SimHashParams) -> int:
    """Blocks into which n entries are dealt so that each two of them are one task: every entry is sent this often, whatever the thresholds."""
    tasks = sum(n * n * len(flips) / 2.0 ** mask.bit_count() for _, mask, flips in _tables(made)) / p.task_comparisons
    return max(1, ceil(n / p.paired_block), min(16, ceil((2 * tasks) ** 0.5)))


def paired(entries: DataFrame, blocks: int) -> DataFrame:
    """(a, b, role, held), sorted by pair of blocks: entries of a are homes there, those of b probers. Blocks go by a hash of the node, so they are even."""

    def run(batches):
        for batch in batches:
            rows = np.stack([column_of(batch, k).to_numpy().view(np.uint64) for k in ENTRY], 1)
            own = (mix(rows[:, 1].copy()) % np.uint64(blocks)).astype(np.int64)
            rows, own = rows[order := np.argsort(own, kind="stable")], own[order]
            at, starts = np.unique(own, return_index=True)
            held = [x.tobytes() for x in np.split(rows, starts[1:])] if len(at) else []
            for k, x in zip(at.tolist(), held):
                a, b = np.minimum(k, np.arange(blocks)), np.maximum(k, np.arange(blocks))
                role = np.where(a == b, BOTH, np.where(a == k, HOME, PROBER))
                yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in (a, b, role)), pa.array([x] * blocks, pa.binary())], names=["a", "b", "role", "held"])

    rows = mapped(entries.select(*ENTRY), run, "a int, b int, role int, held binary")
    return rows.repartition(blocks * (blocks + 1) // 2, "a", "b").sortWithinPartitions("a", "b")


def _bucketed(homes: np.ndarray, probers: np.ndarray, made: Plan, p: SimHashParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of homes and of probers that are candidates of different groups, by the buckets that the homes lie in and the probers probe; some pairs come again."""
    for _, mask, flips in _tables(made):
        keys = [x[:, 0] & np.uint64(mask) for x in (homes, probers)]
        of_homes, of_probers = (np.argsort(k, kind="stable") for k in keys)
        known, first, count = np.unique(keys[0][of_homes], return_index=True, return_counts=True)
        lined = keys[1][of_probers]
        for lo in range(0, len(known), max(1, (1 << 17) // len(flips))):
            probes = known[lo : lo + max(1, (1 << 17) // len(flips)), None] ^ flips[None, :]
            starts = np.searchsorted(lined, probes, "left")
            times = np.searchsorted(lined, probes, "right") - starts
            for k in np.flatnonzero(times.any(1)).tolist():
                took = times[k]
                near = of_probers[np.arange(took.sum()) + np.repeat(starts[k] - np.cumsum(took) + took, took)]
                own = of_homes[first[lo + k] : first[lo + k] + count[lo + k]]
                for x in range(0, len(near), 1 << 13):
                    some = near[x : x + (1 << 13)]
                    for i, j, _ in _near(homes[own], probers[some], p.distance, p):
                        i, j = own[i], some[j]
                        ok = homes[i, 4] != probers[j, 4]
                        if ok.any():
                            yield i[ok], j[ok]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of each of n places' component, by links between i and j."""
    label = np.arange(n)
    while True:
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            return label
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


_MEET = ["a", "b", "key", "x", "y"]


def meetings(entries: DataFrame, made: Plan, n: int, p: SimHashParams) -> DataFrame:
    """The entries that have candidates, by pair of blocks (a, b) and there by component of the candidates (key), of which large ones are cut into blocks x and y again."""
    side = max(1, p.block // 2)

    def whole(at, homes: np.ndarray, probers: np.ndarray) -> Iterator[pa.RecordBatch]:
        # places: homes, then probers; within one block, where each is both, the smaller node of a pair is home
        i, j, size = [], [], 0
        for x, y in _bucketed(homes, probers, made, p):
            if at[0] == at[1]:
                once = homes[x, 1] < probers[y, 1]
                x, y = x[once], y[once]
            i, j, size = [*i, x], [*j, y + len(homes)], size + len(x)
            if size > 1 << 21:
                i, j, size = *([v] for v in forest(len(homes) + len(probers), i, j)), 0
        if not i:
            return
        i, j = np.concatenate(i), np.concatenate(j)
        label, used = _labels(len(homes) + len(probers), i, j), np.zeros(len(homes) + len(probers), bool)
        used[i] = used[j] = True
        place = np.flatnonzero(used)
        place = place[np.argsort(label[place], kind="stable")]
        for own in np.split(place, np.flatnonzero(np.diff(label[place])) + 1):
            h, q = homes[own[own < len(homes)]], probers[own[own >= len(homes)] - len(homes)]
            key = int(h[:, 1].min())
            for x in range(0, len(h), side):
                for y in range(0, len(q), side):
                    yield from sent((*at, key, x // side, y // side), h[x : x + side], q[y : y + side])

    def forest(n: int, i: list[np.ndarray], j: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        label = _labels(n, np.concatenate(i), np.concatenate(j))
        leaf = np.flatnonzero(label != np.arange(n))
        return leaf, label[leaf]

    def sent(at, homes: np.ndarray, probers: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, role = np.concatenate([homes, probers]), np.repeat([HOME, PROBER], [len(homes), len(probers)])
        place = [pa.array(np.full(len(rows), v, kind)) for v, kind in zip(at, (np.int32, np.int32, np.uint64, np.int32, np.int32))]
        place[2] = place[2].view(pa.int64())
        yield pa.RecordBatch.from_arrays([*place, pa.array(role.astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(5))], names=[*_MEET, "role", *ENTRY])

    def run(batches):
        now, sides = None, ([], [])
        for b in batches:
            for at, role, held in zip(zip(*(column_of(b, k).to_pylist() for k in "ab")), column_of(b, "role").to_pylist(), column_of(b, "held").to_pylist()):
                if at != now:
                    if all(sides):
                        yield from gathered(whole(now, *map(unpacked, sides)))
                    now, sides = at, ([], [])
                for k, other in enumerate((PROBER, HOME)):
                    if role != other:
                        sides[k].append(held)
        if all(sides):
            yield from gathered(whole(now, *map(unpacked, sides)))

    return mapped(paired(entries, paired_blocks(made, n, p)), run, "a int, b int, key long, x int, y int, role int, fp long, node long, s0 long, s1 long, group long")


def unpacked(held: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(held), np.uint64).reshape(-1, len(ENTRY))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    some, n = [], 0
    for b in batches:
        some, n = [*some, b], n + b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, n = [], 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def similar(x: np.ndarray, y: np.ndarray, p: SimHashParams) -> bool:
    """Whether two sorted arrays of different shingles are similar enough."""
    if min(len(x), len(y)) < p.similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= p.similarity * (len(x) + len(y) - both) - 1e-9


def verified_meetings(rows: DataFrame, p: SimHashParams) -> DataFrame:
    """src and dst of links that connect all candidates of meetings() that link; rows have held, the set of shingles, too."""

    def found(at, roles: list[int], entries: list[tuple], held: list[bytes]):
        rows, role = np.array(entries, np.int64).view(np.uint64).reshape(-1, 5), np.array(roles)
        home, prober = np.flatnonzero(role == HOME), np.flatnonzero(role == PROBER)
        sets, joined, out, pairs = [np.frombuffer(x, np.uint64) for x in held], Union(), [], []
        for i, j, apart in _near(rows[home], rows[prober], p.distance, p):
            i, j = home[i], prober[j]
            ok = rows[i, 4] != rows[j, 4]
            if at[0] == at[1]:  # the smaller node is home there
                ok &= rows[i, 1] < rows[j, 1]
            pairs.append(np.stack([apart[ok].astype(np.int64), i[ok], j[ok]], 1))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        group = rows[:, 4].tolist()
        for _, i, j in pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))].tolist():
            if joined.find(group[i]) != joined.find(group[j]) and similar(sets[i], sets[j], p):
                joined.join(group[i], group[j])
                out.append((i, j))
        if out:
            i, j = np.array(out).T
            yield _longs(["src", "dst"], rows[i, 1], rows[j, 1])

    def run(batches):
        now, roles, entries, held = None, [], [], []
        for b in batches:
            for key, role, entry, own in zip(zip(*(column_of(b, k).to_pylist() for k in _MEET)), column_of(b, "role").to_pylist(), zip(*(column_of(b, k).to_pylist() for k in ENTRY)), column_of(b, "held").to_pylist()):
                if key != now:
                    if len(entries) > 1:
                        yield from found(now, roles, entries, held)
                    now, roles, entries, held = key, [], [], []
                roles.append(role)
                entries.append(entry)
                held.append(own)
        if len(entries) > 1:
            yield from found(now, roles, entries, held)

    dealt = rows.repartition(*_MEET).sortWithinPartitions(*_MEET)
    return mapped(dealt, run, "src long, dst long")


def components(edges: DataFrame, params: SimHashParams | None = None) -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an edge; src and dst are longs.

    Alternates large-star and small-star until nothing changes; each round is written to the shared folder. A star's
    centre is found by a partial aggregate and joined back, so no node's neighbours are gathered in one task.
    """
    p = params or SimHashParams()
    now = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    for _ in range(p.max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        grown = materialise(large.distinct(), "large-star")
        low = grown.groupBy("u").agg(F.min("v").alias("m"))
        small = grown.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        after = materialise(small.distinct(), "small-star")
        # stars only: no node is both a leaf and a centre, and each leaf has one centre
        ends = after.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))).alias("e")).select("e.*")
        odd = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or leaf > 0 and centre > 0").limit(1).count()
        for t in (now, grown):
            discard(t)
        now = after
        if not odd:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sample(distinct: DataFrame, p: SimHashParams) -> np.ndarray:
    return distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(p.sample).toArrow()["fp"].to_numpy().view(np.uint64)


def _hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, params: SimHashParams | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, fingerprint (hex) and component_id of every row."""
    p = params or SimHashParams()
    fps = materialise(fingerprints(docs, p, text, id), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min(id).alias("first")), "distinct")
    n = distinct.count()
    edges = materialise(links(distinct, plan(_sample(distinct, p), n, p), n, p), "links")
    if edges.limit(1).count():
        comp = materialise(components(edges, p), "components")
        members = distinct.join(comp, distinct["fp"] == comp["node"]).select("fp", "first", "root")
        ids = members.groupBy("root").agg(F.min("first").alias("least"))
        grouped = members.join(ids, "root").select("fp", "least")
        of = materialise(distinct.join(grouped, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "first").alias("component_id")), "classes")
    else:
        of = distinct.select(F.col("fp").alias("_fp"), F.col("first").alias("component_id"))
    joined = fps.join(of, fps["fp"] == of["_fp"])
    return joined.select(id, _hex("fp").alias("fingerprint"), "component_id")


def sketch(own: np.ndarray) -> np.ndarray:
    """Two words: the lowest bit of the smallest hash in each of 128 equal ranges, 0 for empty ones. own is sorted."""
    ranges = (own >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(own) else np.zeros(0, np.int64)
    bits = np.zeros(128, np.uint8)
    bits[ranges[first]] = (own[first] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def _signed(docs: DataFrame, p: SimHashParams, text: int) -> DataFrame:
    """All columns of docs as c0, c1 and so on, a number of the row, its fingerprint, its sketch, and node, a hash of its set of shingles."""
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("row", F.monotonically_increasing_id())
    more = ["fp", "s0", "s1", "node"]

    def run(batches):
        for b in batches:
            rows = []
            for x in texts(b.column(text)):
                parts = list(hashes(x, p))
                own = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                rows.append((majority(parts), *sketch(own).tolist(), xxhash.xxh64_intdigest(own.tobytes(), p.seed)))
            words = np.array(rows, np.uint64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(4))], names=[*b.schema.names, *more])

    return mapped(named, run, T.StructType([*named.schema.fields, *(T.StructField(k, T.LongType()) for k in more)]))


def _sets(wanted: DataFrame, nodes: DataFrame, signed: DataFrame, p: SimHashParams, text: str) -> DataFrame:
    """node and held, the sorted hashes of its shingles, of the wanted nodes, from one row of each."""

    def run(batches):
        for b in batches:
            own = [np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes(x, p)])).tobytes() for x in texts(column_of(b, text))]
            yield pa.RecordBatch.from_arrays([column_of(b, "node"), pa.array(own, pa.binary())], names=["node", "held"])

    chosen = wanted.distinct().join(nodes, "node").select(F.col("first.row").alias("row"))
    return materialise(mapped(signed.join(chosen, "row", "left_semi").select("node", text), run, "node long, held binary"), "shingles")


def _verified(pairs: DataFrame, held: DataFrame, p: SimHashParams) -> DataFrame:
    """The pairs of nodes (src, dst) whose sets of shingles are similar enough."""

    def judge(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), p) for x, y in zip(*(texts(column_of(b, k)) for k in ("a", "b")))]
            yield pa.RecordBatch.from_arrays([column_of(b, k) for k in ("src", "dst")], names=["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    a, b = (held.select(F.col("node").alias(k), F.col("held").alias(v)) for k, v in (("src", "a"), ("dst", "b")))
    return mapped(pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b"), judge, "src long, dst long")


def _verified_edges(signed: DataFrame, nodes: DataFrame, p: SimHashParams, text: str) -> DataFrame:
    """Links between nodes that connect all that link."""
    n, sample = nodes.count(), _sample(nodes, p)
    first = replace(p, distance=min(p.first_distance, p.distance))
    pairs = materialise(nearest(nodes, plan(sample, n, first), n, first), "candidates")
    held = _sets(pairs.select(F.explode(F.array("src", "dst")).alias("node")), nodes, signed, p, text)
    edges = materialise(_verified(pairs, held, p), "verified")
    joined = materialise(components(edges, p), "joined")
    entries = materialise(nodes.join(joined, "node", "left").select(*ENTRY[:4], F.coalesce("root", "node").alias("group")), "entries")
    made = plan(sample, n, p)
    meet = materialise(meetings(entries, made, n, p), "meetings")
    held = _sets(meet.select("node"), nodes, signed, p, text)
    return edges.unionByName(materialise(verified_meetings(meet.join(held, "node"), p), "verified"))


def one_of_each(docs: DataFrame, params: SimHashParams | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Of each component the row with the smallest id, with all its columns; of several rows with that id, one whose set of shingles has the smallest hash."""
    p, names = params or SimHashParams(), docs.columns
    key, place = f"c{names.index(id)}", f"c{names.index(text)}"
    signed = materialise(_signed(docs, p, names.index(text)), "signatures")
    node = F.col("node") if p.similarity is not None else F.col("fp")
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("node").alias("node"), F.col("row").alias("row"))
    nodes = materialise(signed.groupBy(node.alias("node")).agg(F.min(first).alias("first"), *(F.min(k).alias(k) for k in ENTRY if k in ("fp", "s0", "s1"))), "nodes")
    if p.similarity is not None:
        edges = _verified_edges(signed, nodes, p, place)
    else:
        n = nodes.count()
        edges = links(nodes, plan(_sample(nodes, p), n, p), n, p)
    comp = materialise(components(edges, p), "components")
    members = nodes.join(comp, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    keep = members.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return signed.join(keep, "row", "left_semi").select(*(F.col(f"c{i}") for i in range(len(names)))).toDF(*names)
