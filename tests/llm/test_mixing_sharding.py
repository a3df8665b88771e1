import re
import zlib

import pytest

from sievewright.llm.mixing import mix, mixed
from sievewright.llm.sharding import shard

DOCS = "doc_id long, text string, source string"


def rows(spark, data):
    return spark.createDataFrame(data, DOCS).repartition(3)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: repeats * n for s, n in sizes.items()}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= cap[s]}
        if not full:
            for s in open_:
                target[s] = w[s] * level
            break
        for s in full:
            target[s] = float(cap[s])
            left -= cap[s]
        open_ -= full
    return target


@pytest.fixture(scope="module")
def corpus(spark):
    data = [(i, "w " * (1 + i * 7 % 40), [None, "a", "b", "é", "z", "b"][i % 6]) for i in range(900)]
    data += [(1000, None, "a"), (1001, "", None), (1002, "\n \t", "empty"), (1003, "x" * 100_000, "b"), (5, "w w", "a"), (5, "w w", "a")]
    return data


def test_targets_and_takes(spark, corpus):
    got = mix(rows(spark, corpus)).collect()
    assert len(got) == len(corpus)
    sizes = {}
    for _, t, s in corpus:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 41
    again = {(r["doc_id"], r["taken"]) for r in mix(rows(spark, corpus).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_mixed_rows_are_the_takes(spark, corpus):
    data = [r for r in corpus if r[0] != 5]
    frame = rows(spark, data).selectExpr("*", "1 as h", "2 as times", "3 as row", "4 as size")
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mix(frame).collect() if r["size"]}
    seen = {}
    for r in mixed(frame).collect():
        assert r.asDict().keys() == {"doc_id", "text", "source", "h", "times", "row", "size"}
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert {k: v for k, v in times.items() if v} == {k: v for k, v in seen.items() if k in times}


def test_smaller_budgets_are_nested(spark, corpus):
    low, high = ({r["doc_id"]: r["taken"] for r in mix(rows(spark, corpus), share=s).collect()} for s in (0.4, 0.7))
    assert all(high[k] >= v for k, v in low.items())


def test_empty_and_one_source(spark):
    assert mix(rows(spark, [])).count() == 0 and mixed(rows(spark, [])).count() == 0 and shard(rows(spark, [])).count() == 0
    no_source = rows(spark, [(1, "a b", "x"), (2, "c", "y")]).drop("source")
    assert {r["target"] for r in mix(no_source).collect()} == {4.5}
    assert {(r["shard"], r["slot"]) for r in shard(no_source, shards=2).collect()} == {(0, 0), (1, 0)}


def test_shards(spark, corpus):
    got = shard(rows(spark, corpus), shards=40).collect()
    assert len(got) == len(corpus)
    by, mixture = {}, {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        mixture.setdefault(r["source"], {}).setdefault(r["shard"], []).append(1)
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(v) for v in by.values()]
    assert set(by) == set(range(40)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    for shards in mixture.values():
        n = [len(shards.get(k, [])) for k in range(40)]
        assert max(n) - min(n) <= 2
    text = {i: t for i, t, _ in corpus}
    assert all(r["doc_id"] == 5 or r["size"] == len((text[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in shard(rows(spark, corpus).repartition(5)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def test_fewer_rows_than_shards(spark):
    got = shard(rows(spark, [(1, "a", "s"), (2, None, None)]), shards=5).collect()
    assert sorted(r["slot"] for r in got) == [0, 0] and len({r["shard"] for r in got}) == 2


def test_null_and_repeated_ids_and_clashing_columns(spark):
    """Each text of a shared or missing id is a document; the mix still comes near its targets, the shards keep their law."""
    data = [(None if k % 3 else 7, f"w{k} " * (1 + k % 9), "ab"[k % 2]) for k in range(400)]
    frame = rows(spark, data).selectExpr("*", "1 as h", "2 as taken", "3 as size", "4 as shard", "5 as position", "6 as _rank", "7 as slot")
    got = mix(frame).collect()
    sizes = {s: sum(1 + k % 9 for k in range(400) if "ab"[k % 2] == s) for s in "ab"}
    want = brute_targets(sizes)
    for s in "ab":
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) <= 9
    assert mixed(frame).columns == frame.columns
    shards = shard(frame, shards=8).collect()
    by = {}
    for r in shards:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(shards) == 400 and all(sorted(v) == list(range(50)) for v in by.values()) and len(by) == 8
