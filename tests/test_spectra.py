"""Spectrograms by stretches against one transform of the whole signal."""

import numpy as np
import pytest

from captionlake.operators import audio, blocks, spectra
from captionlake.sources.work import Work


@pytest.mark.parametrize("frames", [1, 3, 50])
def test_stretches_equal_the_whole_signal(spark, frames):
    rng = np.random.default_rng(1)
    signals = {"long": rng.normal(size=3_000), "odd": rng.normal(size=1_113), "shortest": rng.normal(size=201), "silent": np.zeros(700), None: rng.normal(size=805), "none": rng.normal(size=200), "tiny": np.ones(1)}
    quiet = signals["long"][:900] * 1e-6
    signals["long"][:900] = quiet
    signals = {k: x.astype("<f4") for k, x in signals.items()}
    rows = spark.createDataFrame([(k, x.tobytes()) for k, x in signals.items()], "file_id string, samples binary")
    work = Work(spark) if frames == 3 else None
    got = spectra.log_mel(blocks.to_blocks(rows, 128), frames=frames, size=128, work=work).orderBy("k").collect()
    for name, x in signals.items():
        mine = [r for r in got if r.file_id == name]
        if len(x) <= 200:
            assert not mine
            continue
        want = audio.log_mel(x).T
        assert [r["first"] for r in mine] == list(range(0, len(want), frames))
        assert np.allclose(np.concatenate([r["values"] for r in mine]), want, atol=1e-5)
    if work:
        work.release()


def test_empty(spark):
    none = spark.createDataFrame([], "file_id string, block long, samples binary")
    assert spectra.log_mel(none).count() == 0
