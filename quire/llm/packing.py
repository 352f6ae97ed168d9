"""Problem 7: texts assigned to containers of fixed capacity with as little free space as possible.

The linear grouping scheme.  Sizes above a share of the capacity are large: their histogram is cut
into groups of about equal cardinality, and each group is rounded up to its largest size.  For these
few sizes, configurations (which sizes fill one container) are optimised by column generation: a
revised simplex whose new columns come from a knapsack over the capacity.  Whole parts of the
solution become containers; actual texts take the places of their group by rank, and what is left,
with all small texts, goes by best fit (largest first) into the space that remains.

Driver-side work depends on the capacity and the number of groups only, never on the number of
texts.  Ranks are taken within salted groups and shifted by their counts, so a size that a third of
the texts share is spread over many tasks; best fit runs in blocks of bounded size.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import vector as V
from quire.llm.tokens import KEEP, TOKENIZERS, VOCABULARY
from quire.plans import read_table, spread, staged

#: A size above capacity / LARGE is large; groups of large sizes; salts of a group; texts of a best-fit block.
LARGE, GROUPS, SALTS, BLOCK = 8, 32, 16, 60_000
#: Capacities add up to this at most, as histograms by size go to the driver.
MAX_CAPACITIES = 4_000_000


# ---- exact token numbers of a rank-file tokenizer -------------------------------------------------


_classes: list[np.ndarray] = []


def _pattern_classes() -> np.ndarray:
    """The classes that the rank files' splitting pattern knows: 0 space, 1 letter, 2 number, 3 other."""
    if not _classes:
        import unicodedata

        t = np.full(0x110000, 3, np.uint8)
        for c in (*range(0xD800), *range(0xE000, 0x110000)):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                t[c] = 1 if k == "L" else 2
        t[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
        _classes.append(t)
    return _classes[0]


def pretokens(text: V.Text) -> tuple[np.ndarray, np.ndarray]:
    """The pieces that the splitting pattern makes before merges, for all rows at once."""
    cp = text.cp
    kind = _pattern_classes()[cp]
    start, end = V.runs(kind, text.rows)
    if not len(start):
        return start, end
    head = np.zeros(len(cp) + 1, bool)
    head[text.rows] = True
    # the last space before other text: joined to it if it is U+0020, else a piece of its own
    space = np.flatnonzero(kind[start] == 0)
    space = space[~head[end[space]]]
    plain = cp[end[space] - 1] == 32
    joined, alone = space[plain], space[~plain]
    start[joined + 1] -= 1
    end[joined] -= 1
    long = alone[end[alone] - start[alone] > 1]
    extra_start, extra_end = end[long] - 1, end[long].copy()
    end[long] -= 1
    # contractions take one or two letters from the run that follows the apostrophe
    quote = np.flatnonzero((cp[start] == 39) & (end - start == 1))
    quote = quote[quote + 1 < len(start)]
    quote = quote[(start[quote + 1] == end[quote]) & ~head[end[quote]] & (kind[np.minimum(end[quote], len(cp) - 1)] == 1)]
    if len(quote):
        a = cp[start[quote] + 1]
        b = np.where(end[quote + 1] - start[quote + 1] >= 2, cp[np.minimum(start[quote] + 2, len(cp) - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((b == ord("e")) & np.isin(a, [ord("r"), ord("v")])) | ((a == ord("l")) & (b == ord("l")))
        take = np.where(one, 1, np.where(two, 2, 0))
        end[quote] += take
        start[quote + 1] += take
    start, end = np.concatenate([start, extra_start]), np.concatenate([end, extra_end])
    keep = end > start
    return start[keep], end[keep]


class Exact:
    """Exact token numbers; remembers the number of each distinct piece."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.keys, self.vals = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def numbers(self, part: pa.Array) -> np.ndarray:
        text = V.Text(part)
        start, end = pretokens(text)
        if not len(start):
            return np.zeros(len(text), np.int64)
        code, distinct = pd.factorize(V.Spans(text.cp).of(start, end))
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        value = np.zeros(len(distinct), np.int64)
        value[known] = self.vals[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            first = np.full(len(distinct), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            value[new] = [len(self.encoding.encode_ordinary(text.string(start[k], end[k]))) for k in first[new]]
            if len(self.keys) + len(new) > KEEP:
                self.keys, self.vals = self.keys[:0], self.vals[:0]
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.vals = keys[order], np.concatenate([self.vals, value[new]])[order]
        return np.bincount(text.row_of(start), weights=value[code], minlength=len(text)).astype(np.int64)


_exact: dict[str, Exact] = {}


def exact_tokens(df: DataFrame, text: str, into: str = "tokens", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the exact number of tokens that a rank-file tokenizer gives ``text``; null text has null."""
    path = os.path.join(folder, vocabulary)

    from pyspark.sql.types import LongType

    @F.arrow_udf(LongType())
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _exact:
            _exact[path] = Exact(path)
        for batch in batches:
            parts = [_exact[path].numbers(p) for _, p in V.slices(batch)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64(), mask=~np.asarray(batch.is_valid()))

    return df.withColumn(into, number(F.col(text)))


# ---- configurations -------------------------------------------------------------------------------


def groups(sizes: np.ndarray, counts: np.ndarray, many: int = GROUPS) -> np.ndarray:
    """Upper sizes of at most ``many`` groups of about equal cardinality, ascending."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    total = np.cumsum(counts)
    cuts = np.searchsorted(total, np.arange(1, many + 1) * total[-1] / many)
    return np.unique(sizes[np.minimum(cuts, len(sizes) - 1)])


def _knapsack(sizes: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, by the number of items in it (large sizes: few items fit)."""
    deep = int(capacity // sizes.min())
    best = np.zeros(capacity + 1)
    picks = np.full((deep, capacity + 1), -1, np.int16)
    for d in range(deep):
        new, pick = best.copy(), np.full(capacity + 1, -1, np.int16)
        for k, (s, v) in enumerate(zip(sizes, value, strict=True)):
            if v <= 1e-12 or most[k] <= 0:
                continue
            with_k = best[: capacity + 1 - s] + v
            better = with_k > new[s:] + 1e-12
            new[s:][better] = with_k[better]
            pick[s:][better] = k
        picks[d] = pick
        if (pick < 0).all():
            break
        best = new
    column = np.zeros(len(sizes), np.int64)
    w, d = capacity, deep - 1
    while d >= 0:
        k = picks[d, w]
        if k >= 0:
            column[k] += 1
            w -= sizes[k]
        d -= 1
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(items of each size in a container, number of such containers): the whole part of an optimal fractional solution."""
    k = len(sizes)
    if not k:
        return []
    columns = [np.eye(k, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(k)]
    basis = np.stack(columns, axis=1).astype(float)
    x = counts / np.diag(basis)
    inverse = np.linalg.inv(basis)
    for _ in range(rounds):
        dual = np.ones(k) @ inverse
        gain, column = _knapsack(sizes, np.maximum(dual, 0), counts, capacity)
        if gain <= 1 + 1e-7:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - direction * ratio[out]
        x[out] = ratio[out]
        columns[out] = column
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ counts, 0)
    return [(c, int(np.floor(n + 1e-9))) for c, n in zip(columns, x, strict=True) if n >= 1 - 1e-9]


def best_fit(sizes: list[int], free: list[int], capacity: int) -> tuple[list[int], int]:
    """The container of each item, largest items first by the caller: existing ones by their place, new ones after them.

    Of the containers that can take an item, one of least free space does.  ``free`` of existing containers is not changed.
    """
    at: dict[int, list[int]] = defaultdict(list)
    bits = 0
    for k in range(len(free) - 1, -1, -1):
        at[free[k]].append(k)
        bits |= 1 << free[k]
    where, n = [], len(free)
    for s in sizes:
        fit = bits >> s
        if fit:
            space = s + (fit & -fit).bit_length() - 1
            k = at[space].pop()
            if not at[space]:
                bits &= ~(1 << space)
        else:
            space, k = capacity, n
            n += 1
        rest = space - s
        at[rest].append(k)
        bits |= 1 << rest
        where.append(k)
    return where, n - len(free)


# ---- the operator ---------------------------------------------------------------------------------


def pack(sizes: DataFrame, targets: list[tuple[int, int]], key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(target_id, container, doc_id, part, tokens): every text in a container of each target.

    A text larger than the capacity is cut: parts 0, 1, ... of the capacity's size, each alone in a container,
    and a rest that is packed as any text; other texts are part 0, whole.  Null keys and null, zero or negative
    sizes are not packed.  Repeated rows are repeated texts, so give distinct keys.  Ties are taken by key.
    """
    spark = sizes.sparkSession
    targets = sorted({(int(t), int(c)) for t, c in targets if t is not None and c is not None and c > 0})
    schema = f"target_id int, container bigint, {key} bigint, part int, tokens int"
    if not targets:
        return spark.createDataFrame([], schema)
    if sum(c for _, c in targets) > MAX_CAPACITIES:
        raise ValueError("capacities are too large for histograms by size; scale sizes and capacities down")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target_id"), F.lit(c).alias("capacity")) for t, c in targets])).alias("t")
    base = sizes.select(F.col(key).cast("bigint").alias("k"), F.col(size).cast("bigint").alias("n")).filter("k is not null and n > 0").select("k", "n", each).select("k", "n", "t.*")
    whole = F.floor(F.col("n") / F.col("capacity"))
    # parts that fill a container by themselves: their containers are numbered below zero, once, in a written table
    full = base.filter("n >= capacity").select("target_id", "k", F.explode(F.sequence(F.lit(1).cast("bigint"), whole)).alias("p"), "capacity")
    full = full.select("target_id", (-F.monotonically_increasing_id() - 1).alias("container"), F.col("k").alias(key), (F.col("p") - 1).cast("int").alias("part"), F.col("capacity").cast("int").alias("tokens"))
    full = staged(full, "full")
    items = base.select("target_id", "capacity", "k", whole.cast("int").alias("part"), (F.col("n") % F.col("capacity")).cast("int").alias("s")).filter("s > 0")
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for r in items.groupBy("target_id", "s").count().collect():  # at most one row for each size below each capacity
        histogram[r["target_id"]][r["s"]] = r["count"]
    uppers, plans, blocks, n_containers = {}, {}, {}, {}
    for t, c in targets:
        have = histogram[t]
        large = np.array(sorted(s for s in have if s * LARGE > c), np.int64)
        many = np.array([have[s] for s in large], np.int64)
        uppers[t] = groups(large, many)
        of = np.searchsorted(uppers[t], large)
        counts = np.bincount(of, many, len(uppers[t])).astype(np.int64) if len(large) else np.zeros(0, np.int64)
        plans[t] = configurations(uppers[t], counts, c)
        n_containers[t] = sum(n for _, n in plans[t])
        blocks[t] = max(1, -(-(sum(have.values()) + n_containers[t]) // BLOCK))
    group = F.lit(None).cast("int")
    for t, c in targets:
        upper = uppers[t]
        if len(upper):
            places = F.array(*[F.lit(int(u)) for u in upper])
            found = F.size(F.filter(places, lambda u: u < F.col("s")))
            group = F.when((F.col("target_id") == t) & (F.col("s") * LARGE > c), found).otherwise(group)
    items = items.withColumn("g", group).withColumn("salt", F.pmod(F.xxhash64("k", "part"), F.lit(SALTS)).cast("int"))
    big, small = items.filter("g is not null"), items.filter("g is null")
    offsets, last = [], {}
    for r in sorted(big.groupBy("target_id", "g", "salt").count().collect()):  # targets x groups x salts
        before = last.get((r["target_id"], r["g"]), 0)
        offsets.append((r["target_id"], r["g"], r["salt"], before))
        last[r["target_id"], r["g"]] = before + r["count"]
    from pyspark.sql import Window as W

    order = W.partitionBy("target_id", "g", "salt").orderBy(F.desc("s"), "k", "part")
    ranked = big.join(F.broadcast(spark.createDataFrame(offsets, "target_id int, g int, salt int, before bigint")), ["target_id", "g", "salt"])
    ranked = ranked.withColumn("rank", F.row_number().over(order) - 1 + F.col("before"))
    slots = []
    for t, _ in targets:
        base_id, low = 0, defaultdict(int)
        for column, n in plans[t]:
            for g in np.flatnonzero(column):
                slots.append((t, int(g), low[g], low[g] + int(column[g]) * n, n, base_id))
                low[g] += int(column[g]) * n
            base_id += n
    slots = spark.createDataFrame(slots, "target_id int, g int, low bigint, high bigint, many bigint, first bigint")
    a, b = ranked.alias("a"), F.broadcast(slots).alias("b")
    placed = a.join(b, (F.col("a.target_id") == F.col("b.target_id")) & (F.col("a.g") == F.col("b.g")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    placed = staged(placed.select("a.target_id", "a.capacity", "a.k", "a.part", "a.s", (F.col("first") + F.pmod(F.col("rank") - F.col("low"), F.col("many"))).alias("container")), "packed")
    seated = placed.filter("container is not null")
    rest = placed.filter("container is null").drop("container").unionByName(small.select("target_id", "capacity", "k", "part", "s"))
    n_blocks = F.lit(1)
    for t, n in blocks.items():
        n_blocks = F.when(F.col("target_id") == t, F.lit(n)).otherwise(n_blocks)
    spaces = seated.groupBy("target_id", "capacity", "container").agg((F.first("capacity") - F.sum("s")).cast("int").alias("s"))
    spaces = spaces.select("target_id", "capacity", F.pmod(F.xxhash64("container"), n_blocks).cast("int").alias("block"), F.col("container").alias("k"), F.lit(-1).alias("part"), "s")
    rest = rest.select("target_id", "capacity", F.pmod(F.xxhash64("k", "part"), n_blocks).cast("int").alias("block"), "k", "part", "s")

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        t, c, block = (int(frame[x].iloc[0]) for x in ("target_id", "capacity", "block"))
        space = frame[frame["part"] < 0].sort_values("k")
        some = frame[frame["part"] >= 0].sort_values(["s", "k", "part"], ascending=[False, True, True])
        where, _ = best_fit(some["s"].tolist(), space["s"].tolist(), c)
        ids = space["k"].to_numpy()
        where = np.asarray(where, np.int64)
        new = ((block + 1) << 40) + where - len(ids)
        container = np.where(where < len(ids), ids[np.minimum(where, max(len(ids) - 1, 0))] if len(ids) else 0, new)
        return pd.DataFrame({"target_id": np.int32(t), "container": container, key: some["k"].to_numpy(), "part": some["part"].to_numpy(np.int32), "tokens": some["s"].to_numpy(np.int32)})

    fitted = spaces.unionByName(rest).groupBy("target_id", "block").applyInPandas(fill, schema)
    return fitted.unionByName(seated.select("target_id", "container", F.col("k").alias(key), "part", F.col("s").alias("tokens"))).unionByName(full)


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    docs = exact_tokens(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "text").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    targets = [tuple(r) for r in read_table(spark, sf_dir, "pack_targets").select("target_id", "capacity_tokens").collect()]
    return pack(staged(docs, "sizes"), targets), targets


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of their capacity that is used, by target."""
    packed, targets = _packed(spark, sf_dir)
    capacity = F.create_map(*[F.lit(x) for pair in targets for x in pair])
    per = packed.groupBy("target_id", "container").agg(F.sum("tokens").alias("used"))
    return per.groupBy("target_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")).withColumn("fill", F.col("tokens") / (F.col("containers") * capacity[F.col("target_id")]))
