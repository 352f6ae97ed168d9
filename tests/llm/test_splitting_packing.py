import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import packing, splitting
from quire.llm import vector as V


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("ab .\n,字", max_size=120), min_size=1, max_size=5), st.integers(4, 40), st.integers(0, 30))
def test_pieces_cover_within_the_limit(texts, most, overlap):
    t = V.Text(pa.array(texts, pa.large_string()))
    row, start, fresh, end = splitting.cut(t, np.full(len(texts), most), np.full(len(texts), overlap))
    for k in range(len(texts)):
        mine = np.flatnonzero(row == k)
        if not texts[k]:
            assert not len(mine)
            continue
        assert fresh[mine[0]] == t.rows[k] and end[mine[-1]] == t.rows[k + 1]
        assert (fresh[mine[1:]] == end[mine[:-1]]).all() and (start[mine] <= fresh[mine]).all() and (fresh[mine] < end[mine]).all()
        assert (end[mine] - start[mine] <= most).all() and (fresh[mine] - start[mine] <= min(overlap, most // 2)).all()


def test_all_cuts_are_the_greedy_ones():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcd .,\n"), 3000))
    t = V.Text(pa.array([text], pa.large_string()))
    _, _, fresh, end = splitting.cut(t, np.array([60]), np.array([12]))
    place, at = dict(zip(fresh.tolist(), end.tolist(), strict=True)), 0
    seen = []
    while at < len(text):
        seen.append(at)
        at = place[at]
    assert seen == fresh.tolist()


def test_cuts_fall_at_sentences():
    text = "The parser checks it all. " * 30
    t = V.Text(pa.array([text], pa.large_string()))
    _, _, _, end = splitting.cut(t, np.array([200]), np.array([0]))
    assert all(text[: e].rstrip().endswith(".") for e in end)


def test_items_by_preset(spark):
    options = spark.createDataFrame([("p", 10, 3), ("q", 5, None), ("p", 12, 1)], "preset string, max_tokens int, overlap_tokens int")
    rows = [(1, "p", "word " * 30), (2, "p", "short"), (3, None, "x" * 100), (4, "q", None), (5, "z", "x" * 100), (6, "q", ""), (7, "q", "x" * 99), (1, "p", "word " * 30)]
    items = spark.createDataFrame(rows, "key int, preset string, content string").withColumn("max_tokens", F.lit(1)).withColumn("pieces", F.lit(1))
    got = splitting.split_items(items, options, "section", "key").collect()
    assert {r["item_key"] for r in got} == {1, 2, 7} and {r["item_key"] for r in got if r["pieces"] > 1} == {1, 7}
    assert all(r["size"] <= (10 if r["item_key"] < 3 else 5) and r["content"] == dict((k, t) for k, _, t in rows)[r["item_key"]][r["start"] : r["end"]] for r in got)
    assert any(r["overlap"] > 0 for r in got) and len({(r["item_key"], r["piece"]) for r in got if r["item_key"] == 1}) * 2 == sum(r["item_key"] == 1 for r in got)
    assert splitting.split_items(items.limit(0), options, "s", "key").count() == 0


# ---- packing ---------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=30), st.lists(st.integers(0, 50), max_size=10))
def test_best_fit_takes_the_tightest(sizes, free):
    sizes = sorted(sizes, reverse=True)
    where, new = packing.best_fit(sizes, free, 50)
    left = list(free) + [50] * new
    opened = len(free)
    for s, k in zip(sizes, where, strict=True):
        fitting = [left[j] for j in range(opened) if left[j] >= s]
        if fitting:
            assert left[k] == min(fitting)
        else:
            assert k == opened
            opened += 1
        left[k] -= s
    assert min(left, default=0) >= 0


def test_configurations_fill_containers():
    sizes, counts = np.array([20, 34, 50]), np.array([50, 60, 40])
    plan = packing.configurations(sizes, counts, 100)
    assert all(c @ sizes <= 100 for c, _ in plan)
    used = sum(c * n for c, n in plan)
    assert (used <= counts).all() and (counts - used).sum() <= 12
    assert packing.configurations(sizes[:0], counts[:0], 100) == []


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(4)
    sizes = {k: int(x) for k, x in enumerate(np.minimum(rng.lognormal(4.5, 1.1, 3000), 3000).astype(int))}
    rows = [*sizes.items(), (9001, None), (9002, 0), (None, 5), (9003, 2048)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens int").withColumn("part", F.lit("x")).withColumn("container", F.lit(1))
    out = packing.pack(df, [(1, 512), (2, 2048)]).toPandas()
    for target, capacity in ((1, 512), (2, 2048)):
        mine = out[out.target_id == target]
        want = {k: n for k, n in rows if k is not None and n}
        assert mine.groupby("doc_id").tokens.sum().to_dict() == want
        assert not mine.duplicated(["doc_id", "part"]).any()
        used = mine.groupby("container").tokens.sum()
        assert used.max() <= capacity
        split = mine.groupby("doc_id").size()
        assert all(want[k] > capacity for k in split[split > 1].index)
        assert used.sum() / (len(used) * capacity) > 0.97
    assert packing.pack(df.limit(0), [(1, 512)]).count() == 0 and packing.pack(df, []).count() == 0


def test_equal_sizes(spark):
    df = spark.createDataFrame([(k, 300) for k in range(100)], "doc_id bigint, tokens int")
    out = packing.pack(df, [(1, 900)]).toPandas()
    assert len(out) == 100 and out.container.nunique() == 34
