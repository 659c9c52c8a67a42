"""What tasks hold and what they leave in their workers."""

import numpy as np
import pyarrow as pa
from llm import bpe, common, suffix_dedup


def test_a_task_drops_what_other_operators_keep():
    assert common.KEPT["encoders"] is bpe.Encoder._cache
    before = dict(bpe.Encoder._cache)
    try:
        bpe.Encoder._cache["a file"] = "its encoder"
        assert list(common.lean(iter, "encoders")(iter([1, 2]))) == [1, 2] and bpe.Encoder._cache
        assert list(common.lean(iter)(iter([1, 2]))) == [1, 2] and not bpe.Encoder._cache
    finally:
        bpe.Encoder._cache.update(before)
        bpe.Encoder._cache.pop("a file", None)


def texts(n: int, size: int) -> pa.RecordBatch:
    letters = np.random.default_rng(7).integers(97, 123, (n, size), np.uint8)
    return pa.RecordBatch.from_pydict({"id": pa.array(range(n), pa.int64()), "tie": pa.array([0] * n, pa.int64()), "text": [x.tobytes().decode() for x in letters], "copies": pa.array([1] * n, pa.int64())})


def records(out: list[pa.RecordBatch]) -> tuple[list[int], list[tuple]]:
    """(how many names each batch has, all names)."""
    each = [{n: np.frombuffer(b"".join(b.column(n).to_pylist()), k) for n, k in suffix_dedup.KINDS} for b in out]
    return [len(x["core"]) for x in each], sorted(z for x in each for z in zip(*(x[n].tolist() for n, _ in suffix_dedup.KINDS)))


def test_names_are_sent_before_they_are_many():
    plan, batch = suffix_dedup.Plan(400), texts(1200, 5000)
    sizes, all_names = records(list(suffix_dedup._sample(plan, 4)(iter([batch]))))
    assert sum(sizes) > suffix_dedup.FLUSH and max(sizes) < 1.1 * suffix_dedup.FLUSH
    whole, want = records(list(suffix_dedup._sample(plan, 4, flush=1 << 40)(iter([batch]))))
    assert len(whole) == 1 and all_names == want


def test_names_of_parts_are_sent_before_they_are_many():
    plan, batch = suffix_dedup.Plan(400), texts(600, 2000)
    places = plan.places(1500)
    runs = pa.array([[{"pos": int(p), "lo": 0} for p in places]] * 600, pa.list_(pa.struct([("pos", pa.int32()), ("lo", pa.int16())])))
    batch = pa.RecordBatch.from_arrays([*batch.columns, runs], names=[*batch.schema.names, "open"])
    sizes, all_names = records(list(suffix_dedup._split(plan, 1, 4)(iter([batch]))))
    assert sum(sizes) > suffix_dedup.FLUSH and max(sizes) < 1.3 * suffix_dedup.FLUSH
    whole, want = records(list(suffix_dedup._split(plan, 1, 4, flush=1 << 40)(iter([batch]))))
    assert len(whole) == 1 and all_names == want


def test_pieces():
    got = list(common.pieces(iter([texts(5, 3), texts(0, 3), texts(2, 3)]), 2))
    assert [b.num_rows for b in got] == [2, 2, 1, 2] and [x for b in got for x in b.column("id").to_pylist()] == [0, 1, 2, 3, 4, 0, 1]
