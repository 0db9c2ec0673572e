"""SimHash fingerprints and their near-duplicate groups by the generalised pigeonhole principle.

Fingerprints link at ``tau`` or fewer differing bits.  The 64 bits are grouped into m parts, correlated bits
together.  Part i gets a threshold e_i >= -1 (-1: the part is not used) with sum(e_i + 1) = tau + 1: two
fingerprints within tau then differ in at most e_i bits of some part i, or they would differ in tau + 1 bits.
Dynamic programming picks m and the thresholds with the least estimated cost, candidates and signatures
both counted; the estimate comes from a bounded sample and bears on cost alone, never on results.

A part with threshold e is probed by signatures: the part with e of its bits masked out, for each choice of
e bits.  Two values within e bits share one.  So every bucket of equal signatures is a set of candidates.
A bucket is verified whole, and what leaves it is a spanning forest of its links, not all pairs; groups are
the components of the links, which a forest keeps.  Buckets above ``big`` are probed again: their members
agree in the signature's bits, so within tau they agree in one of tau + 1 groups of the other bits, too.  What
is still too large after two such rounds is dealt out in pairs of blocks.  Equal fingerprints are one node throughout, so copies cost nothing here.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 64


# -- fingerprints


def fingerprint(text: str | None, size: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a text; 0 for a text without words."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = list(itertools.accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends][:n]
    x = xxhash.xxh64_intdigest
    h = np.array([x(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :] or ends[-1:], strict=False)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 15):
        ones += np.unpackbits(h[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the unsigned fingerprint's bits as a signed long) of every whole text."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# -- parts and thresholds


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of near equal size, correlated bits together (greedy on absolute correlation)."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0)
    sd = bits.std(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(bits.T @ bits) / max(len(bits), 1) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        rest = sorted(left)
        group = [max(rest, key=lambda i: (corr[i, rest].max(initial=0), -i))]
        left.discard(group[0])
        while len(group) < size:
            nxt = max(sorted(left), key=lambda j: (corr[j, group].mean(), -j))
            group.append(nxt)
            left.discard(nxt)
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def plan(sample: np.ndarray, n: int, tau: int, row_cost: float = 60.0, most: int = 400) -> list[tuple[int, int]]:
    """(part's mask, threshold) of the parts in use, for ``n`` fingerprints.

    ``row_cost``: the cost of one signature in units of one verified pair; ``most``: signatures per part.
    """
    xs = sample[:1500]
    pairs = xs[:, None] ^ xs[None, :]
    upper = pairs[np.triu_indices(len(xs), 1)]
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, tau + 2):
        groups = group_bits(sample, m) if len(sample) > 1 else [list(range(k, BITS, m)) for k in range(m)]
        costs = []
        for g in groups:
            d = np.bitwise_count(upper & np.uint64(mask_of(g)))
            seen = np.bincount(d, minlength=BITS + 1) / max(len(upper), 1)
            w, row = len(g), [0.0]
            for e in range(tau + 1):
                if math.comb(w, e) > most:
                    row.append(math.inf)
                    continue
                # a pair at distance j <= e shares C(w - j, e - j) signatures; the second term smooths small samples
                share = sum((seen[j] + math.comb(w, j) / 2.0**w) * math.comb(w - j, e - j) for j in range(e + 1))
                row.append(share * n * n / 2 + row_cost * math.comb(w, e) * n)
            costs.append(row)
        # DP over parts: table[u] = least cost with u of the tau + 1 units given out
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (c, picks) in table.items():
                for units in range(tau + 2 - used):
                    x = (c + row[units], [*picks, units])
                    if x[0] < step.get(used + units, (math.inf,))[0]:
                        step[used + units] = x
            table = step
        if tau + 1 in table and table[tau + 1][0] < best[0]:
            best = (table[tau + 1][0], [(mask_of(g), u - 1) for g, u in zip(groups, table[tau + 1][1], strict=True) if u])
    return best[1]


def signature_masks(parts: list[tuple[int, int]]) -> list[int]:
    """The bits that each kind of signature looks at."""
    out = []
    for mask, e in parts:
        bits = [b for b in range(BITS) if mask >> b & 1]
        out += [mask & ~mask_of(gone) for gone in itertools.combinations(bits, e)]
    return out


# -- buckets


def forest(x: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Links (index pairs) that connect what distances of at most tau connect among x: a spanning forest."""
    n = len(x)
    if n <= 128:
        i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= tau, 1))
        if not len(i):
            return []
        root = list(range(n))

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        out = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
        return out
    left, out = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(x[left] ^ x[u]) <= tau
            if near.any():
                found = left[near].tolist()
                out += [(u, v) for v in found]
                queue += found
                left = left[~near]
    return out


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())])


def _bucket_runner(keys: int, tau: int, big: int | None):
    """mapInArrow function over rows sorted by their first ``keys`` columns; the fingerprint is the last column.

    Gives links (a, b), or, of buckets above ``big``, their members (a = b = fingerprint, kind, value), passed
    on as they come, so that a task holds no more of a bucket than ``big`` and one batch.
    """

    def run(batches):
        from_rows = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LINKS, strict=True)], schema=LINKS)
        held: list[np.ndarray] = []  # members of the bucket that is still open, at most ``big``
        held_key, n_held, spilling, rows = None, 0, False, []

        def members(x):
            return [(v, v, held_key[0], held_key[1]) for v in x.view(np.int64).tolist()]

        def close():
            if n_held < 2:
                return []
            x = np.concatenate(held) if len(held) > 1 else held[0]
            s = x.view(np.int64)
            return [(int(s[i]), int(s[j]), None, None) for i, j in forest(x, tau)]

        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            fp = b.column(keys).to_numpy(zero_copy_only=False).view(np.uint64)
            n = len(fp)
            if not n:
                continue
            change = np.zeros(n, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), n]
            for a, z in zip(edges, edges[1:], strict=False):
                key = tuple(c[a].item() for c in cols)
                if key != held_key:
                    rows += close()
                    held, held_key, n_held, spilling = [], key, 0, False
                if spilling:
                    rows += members(fp[a:z])
                    continue
                held.append(fp[a:z])
                n_held += z - a
                if big is not None and n_held > big:
                    for x in held:
                        rows += members(x)
                    held, n_held, spilling = [], 0, True
            while len(rows) >= 10_000:
                yield from_rows(rows[:10_000])
                rows = rows[10_000:]
        rows += close()
        for a in range(0, len(rows), 10_000):
            yield from_rows(rows[a : a + 10_000])

    return run


def _probe(spark: SparkSession, sigs: DataFrame, tau: int, big: int | None, keys: list[str]) -> DataFrame:
    """Rows of :func:`_bucket_runner` over (``keys``, fp), buckets kept together."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sigs.select(*keys, "fp").repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_bucket_runner(len(keys), tau, big), "a long, b long, kind int, value long")


def _narrower(mask: int, tau: int) -> list[int]:
    """``mask`` with one of tau + 1 groups of the other bits added: fingerprints that agree in ``mask`` and differ in at most tau bits agree in one of these."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | mask_of(rest[i :: tau + 1]) for i in range(tau + 1)]


def links(distinct: DataFrame, tau: int = 4, sample: int = 4096, big: int = 8192, again: int = 2) -> DataFrame:
    """Links (a, b) of the distinct fingerprints ``fp`` that keep their components.

    ``sample``: how many fingerprints, by hash, the driver sees to estimate candidates.  Buckets of more than ``big``
    members are probed again on further bits, up to ``again`` times; what is still larger is dealt out in pairs of
    blocks, so every pair of a bucket is compared in some task and none holds more than ``big`` members.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    low = F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, 2 * sample / max(1, n)) * (1 << 30))
    some = distinct.where(low).select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    masks = signature_masks(plan(np.array([r.fp for r in some], np.int64).view(np.uint64), n, tau))
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    kinds = lambda ms: F.array(*[F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(signed(m)).alias("value")) for k, m in ms])
    sigs = distinct.select("fp", F.inline(kinds(list(enumerate(masks)))))
    out = None
    for _ in range(again + 1):
        found = common.saved(_probe(spark, sigs, tau, big, ["kind", "value"]), "links")
        small, large = found.where("kind IS NULL").select("a", "b"), found.where("kind IS NOT NULL").select("kind", "value", F.col("a").alias("fp"))
        out = small if out is None else out.unionByName(small)
        heavy = sorted(r.kind for r in large.select("kind").distinct().collect())  # at most as many as there are masks
        if not heavy:
            return out
        nxt = sorted({m for k in heavy for m in _narrower(masks[k], tau)})
        place = {m: k for k, m in enumerate(nxt)}
        sub = F.coalesce(*[F.when(F.col("kind") == k, kinds([(place[m], m) for m in _narrower(masks[k], tau)])) for k in heavy])
        last, masks = large, nxt
        sigs = large.select("fp", F.inline(sub)).distinct()  # two heavy kinds can have a narrower mask in common
    blocks = last.groupBy("kind", "value").agg(F.ceil(F.count(F.lit(1)) / (big // 2)).cast("int").alias("g"))
    dealt = last.join(blocks, ["kind", "value"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("kind", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    return out.unionByName(_probe(spark, dealt, tau, None, ["kind", "value", "lo", "hi"]).select("a", "b"))


# -- components


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node of its component.

    Labels go to neighbours, then each label is replaced by its own label, which halves distances each
    round.  Every round is a written table, so a lost executor costs a round at most.  The joins are plain
    equi-joins of which adaptive execution can split a hot side; aggregates combine before they shuffle.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    e = common.saved(both.where("src <> dst").distinct(), "edges")
    lab = common.saved(e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")), "labels")
    while lab.where("changed").limit(1).count():
        near = e.join(lab.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("m"))
        hooked = common.saved(lab.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = common.saved(hooked.join(up, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("old")).alias("changed")), "labels")
        common.forget(lab, hooked)
        lab = new
    common.forget(e)
    return lab.select("node", "label")


def near_groups(docs: DataFrame, tau: int = 4, sample: int = 4096, big: int = 8192) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text).

    Null and word-less texts have fingerprint zero and link like any other.  Repeated rows stay.  Rows with a
    null doc_id link too; a group of such rows alone has a null component_id.  An empty table gives none.
    """
    fps = common.saved(fingerprints(docs), "fingerprints")
    began = common.mark()
    nodes = common.saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    lab = components(links(nodes, tau, sample, big))
    linked = nodes.join(lab.select(F.col("node").alias("fp"), "label"), "fp")
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    of = common.saved(linked.join(least, "label").select("fp", "component_id"), "groups")
    ids = nodes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    ids = common.saved(ids, "ids")
    common.sweep(docs.sparkSession, began, keep=("ids-",))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the one row of each near-duplicate group that has the smallest (doc_id, text hash), all columns as they were.

    Rows that share a doc_id are told apart by their texts: each group keeps one.  Rows without a doc_id stand behind
    all others (ids from 2 ** 62 on, by text, so that equal texts count as one).
    """
    own, key = (next(n for n in names if n not in docs.columns) for names in (("_id", "_id_", "_own_id_"), ("_key", "_key_", "_own_key_")))
    spare = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    keyed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), spare)).withColumn(key, F.xxhash64(own, F.coalesce("text", F.lit(""))))
    groups = near_groups(keyed.select(F.col(key).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias(key), "component_id").distinct()
    first = keyed.select(key, own).distinct().join(groups, key).groupBy("component_id").agg(F.min(F.struct(own, key)).alias("first"))
    kept = first.select(F.col("first")[key].alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(own, key)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(common.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
