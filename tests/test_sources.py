"""Tensor files, large codebooks in blocks, the second stage's dataset."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrec.operators import drivers, quantize
from loomrec.sources import files, tensors


def test_tensors_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    some = {"in.weight": rng.normal(size=(50, 6)).astype(np.float32), "out.weight": rng.normal(size=(4, 3, 2)), "bias": rng.integers(-9, 9, 7), "one": np.array(2.5), "none": np.zeros((0, 3), np.float32)}
    path = f"{tmp_path}/m.tensors"
    tensors.write_tensors(path, some)
    tensors.register(spark)
    df = spark.read.format("tensors").options(path=path, part_bytes=240).load()
    back = {}
    for r in df.orderBy("name", "row").collect():
        back.setdefault(r.name, []).append(r["values"])
    for name, x in some.items():
        if x.size:
            assert np.allclose(np.array(back[name]).reshape(x.shape), x)
    assert "none" not in back
    two = spark.read.format("tensors").options(path=f"file://{path}", names="bias, in.weight", part_bytes=240).load()
    assert {r.name for r in two.select("name").distinct().collect()} == {"bias", "in.weight"}
    assert two.where("name = 'in.weight'").rdd.getNumPartitions() >= 5
    with pytest.raises(Exception, match="no tensor gone"):
        spark.read.format("tensors").options(path=path, names="gone").load().count()


def test_tensors_of_other_kinds_and_broken_files(tmp_path):
    path = tmp_path / "half"
    head = json.dumps({"__metadata__": {"a": "b"}, "x": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}}).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + struct.pack("<HH", 0x3FC0, 0xC000))
    (part,) = tensors.TensorReader(str(path), []).partitions()
    (batch,) = tensors.TensorReader(str(path), []).read(part)
    assert batch.column("values").to_pylist() == [[1.5, -2.0]]
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(ValueError, match="ends within x"):
        tensors.header(str(path))
    path.write_bytes(b"abc")
    with pytest.raises(ValueError, match="no file of tensors"):
        tensors.header(str(path))


def test_codebooks_of_any_size(spark, monkeypatch):
    """Blocks of codes give what the codebook as a whole gives, ties and most rows on one code included."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 5)) * rng.lognormal(size=(150, 1)), np.tile([0.1, 0, 0, 0, 0], (80, 1))])
    book = rng.normal(size=(2, 60, 5)) * rng.lognormal(size=(2, 60, 1))
    book[0, 7] = book[0, 3] = [0.1, 0, 0, 0, 0]
    rows = spark.createDataFrame([(i, v.tolist(), f"k{i}") for i, v in enumerate(x)], "id long, embedding array<double>, kept string").repartition(3)
    codes = spark.createDataFrame([(k, i, v.tolist()) for k in range(2) for i, v in enumerate(book[k])], "level int, code int, vector array<double>")
    want = {r.id: r for r in quantize.encode(rows, codes, keep=("kept",), errors=True).collect()}
    monkeypatch.setattr(quantize, "CODEBOOK_VALUES", 100)
    plain = quantize.nearest_in_blocks
    monkeypatch.setattr(quantize, "nearest_in_blocks", lambda a, b, key: plain(a, b, key, 16))
    got = quantize.encode(rows, codes, keep=("kept",), errors=True).collect()
    assert len(got) == len(x)
    for r in got:
        w = want[r.id]
        assert r.codes == w.codes and r.kept == w.kept and np.allclose(r.residual, w.residual) and np.allclose(r.errors, w.errors)
    assert {r.codes[0] for r in got if r.id >= 150} == {3}


def test_second_stage(spark, tmp_path):
    rows = [("say", f"in {k}", f"out {k}", t, None) for k, t in enumerate(["grounding_id2name", "asy", "sequential"])]
    df = spark.createDataFrame(rows, files.SFT)
    files.write_examples(df.coalesce(1), f"{tmp_path}/train")
    files.write_examples(df.limit(1), f"{tmp_path}/val")
    out, probe = drivers.fine_tuning_dataset(spark, f"{tmp_path}/train", f"{tmp_path}/val")
    assert probe == "in 1" and out.columns == ["split", "prompt", "completion"] and out.where("split = 'val'").count() == 1
    one = out.where(F.col("completion") == "out 2</s>").first()
    assert "say" in one.prompt and "in 2" in one.prompt
    with pytest.raises(ValueError, match="no history"):
        drivers.fine_tuning_dataset(spark, f"{tmp_path}/val", f"{tmp_path}/val")
    with pytest.raises(FileNotFoundError, match="first stage"):
        drivers.stage_two_from(spark, f"{tmp_path}/none")
